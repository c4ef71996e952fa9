"""SentencePiece encoding and decoding for merge-type (BPE) models, without the library's encoder.

A text is escaped (a space becomes U+2581, one is put before it) and cut into units, each a
run of U+2581 and what follows up to the next; no piece crosses such a border, which
``Codec`` checks. A unit is encoded by backtracking: an Aho-Corasick pass gives the longest
piece from each place; a piece may follow another only if merging the two texts anew gives
just the two; where none fits, the last piece is shortened or taken back, and a bitfield of
the places that can't be reached any more keeps the search linear. Runs of U+2581, whose pieces
tie in score, are merged from the left by rule. Characters without a piece become byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cadastra.llm.common import in_arrow, pick, table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Units up to this length are remembered, this many in one worker.
UNIT, REMEMBERED = 32, 300_000


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Memo(dict):
    """Ids of a space and the key behind it, as text; made when first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> str:
        ids = self.make(word)
        if len(word) <= UNIT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids


class Codec:
    """Encoder and decoder of one model. The model's normaliser must be the identity, with a
    dummy prefix and all spaces kept; other models are refused."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("Ａ  b ") != "▁Ａ▁▁b▁":
            raise ValueError("only models with the identity normaliser and a dummy prefix")
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.control = {i for i in range(n) if sp.is_control(i)}
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: sp.get_score(i) for i in plain}
        spaces = {p for p in self.id if not p.strip(SPACE)}
        if any(SPACE in p.lstrip(SPACE) or p.startswith(SPACE * 2) for p in self.id if p not in spaces):
            raise ValueError("a piece crosses a word border")
        rest = [self.score[p] for p in self.id if len(p) > 1 and p not in spaces]
        if len(set(rest)) < len(rest):
            raise ValueError("pieces tie in score")
        if spaces and (len({self.score[p] for p in spaces if len(p) > 1}) > 1 or min(rest, default=0) <= max([self.score[p] for p in spaces if len(p) > 1], default=-1e18)):
            raise ValueError("runs of spaces aren't merged last")
        self.halves: dict[str, tuple[str, str]] = {}
        self.runs = sorted((len(p) for p in spaces), reverse=True)
        if any(self._run(k) != [len(p) for p in self._merge(SPACE * k)] for k in range(1, 3 * max(self.runs))):
            raise ValueError("runs of spaces aren't merged from the left")
        self.fits: dict[tuple[str, str], bool] = {}
        # what merging can't make never appears in a result; a single character is there from the start
        words = [p for p in self.id if p not in spaces or p == SPACE]
        order = {p: k for k, p in enumerate(sorted(words, key=lambda p: -self.score[p]))}
        self.rank = {p: order[p] if len(p) > 1 else -1 for p in words}
        self.reached = {p for p in words if self._merge(p) == [p]}
        self.shorter = {}
        for p in self.reached:
            self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in self.reached), None)
        self.find = ahocorasick.Automaton()
        for p in self.reached:
            self.find.add_word(p, (len(p) - 1, p))
        self.find.make_automaton()
        self.known = _Memo(self._word)
        self.letters = {p for p in self.id if len(p) == 1 and p != SPACE}
        self.id_text = {p: str(i) for p, i in self.id.items()}
        # pieces by their id as text; bytes beyond ASCII need their neighbours and are left out
        self.shown = {str(i): p.replace(SPACE, " ") for p, i in self.id.items()}
        self.shown |= {str(i): chr(b) for b, i in self.byte.items() if b < 128}

    def _run(self, size: int) -> list[int]:
        """Lengths of the pieces of a run of U+2581: from the left, the longest there is."""
        out = []
        while size:
            out.append(next(k for k in self.runs if k <= size))
            size -= out[-1]
        return out

    def _merge(self, text: str) -> list[str]:
        """Merging by definition: the best-scored neighbours first, the leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when their text is merged anew: the merges that made them
        are undone, latest first; at each step the neighbours across the border must not
        merge earlier than what was undone."""
        key, rank, before = (a, b), self.rank, 1 << 60
        while True:
            r = rank.get(a + b)
            if r is not None and r < before:
                ok = False
                break
            if rank[a] > rank[b]:
                before, a = rank[a], self.halves[a][1]
            elif rank[b] < 0:
                ok = True
                break
            else:
                before, b = rank[b] + 1, self.halves[b][0]
        if len(self.fits) >= 250_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def _search(self, text: str) -> list[str]:
        """Pieces of a text all of whose characters are pieces."""
        if text in self.shorter:
            return [text]
        # matches come by their ends, so the last one from a place is the longest
        longest = {end - before: p for end, (before, p) in self.find.iter(text)}
        size, out, at = len(text), [], 0
        failed = bytearray(size // 8 + 1)
        fits, shorter = self.fits, self.shorter
        p: str | None = longest[0]
        while True:
            end = at + len(p)
            if not failed[end >> 3] >> (end & 7) & 1:
                ok = not out or fits.get((out[-1], p))
                if ok or ok is None and self._fit(out[-1], p):
                    out.append(p)
                    if end == size:
                        return out
                    at, p = end, longest[end]
                    continue
            p = shorter[p]
            if p is None:  # nothing fits here: this place is out, and the last piece is tried shorter
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no sequence of pieces fits")
                p = out.pop()
                at -= len(p)

    def _word(self, word: str) -> str:
        """Ids of one space and the word behind it, as text."""
        unit = SPACE + word
        if word and self.letters.issuperset(word):
            return ",".join(map(self.id_text.__getitem__, self._search(unit)))
        return ",".join(map(str, self._unit(unit)))

    def _unit(self, unit: str) -> list[int]:
        """Ids of a run of U+2581 and the characters behind it."""
        word = unit.lstrip(SPACE)
        run = len(unit) - len(word)
        ids: list[int] = []
        parts: list[str | int] = []
        head = SPACE + word if run else word
        piece = ""
        for c in head:  # stretches of known characters, and bytes between them
            if c in self.id:
                piece += c
            else:
                if piece:
                    parts += self._search(piece)
                piece = ""
                parts += [self.byte[b] for b in c.encode()]
        if piece:
            parts += self._search(piece)
        if run:
            if parts[0] == SPACE:
                parts = parts[1:]
            else:
                run -= 1
            ids += [self.id[SPACE * k] for k in self._run(run)]
        return ids + [p if isinstance(p, int) else self.id[p] for p in parts]

    def units(self, text: str) -> list[str]:
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", SPACE + text.replace(" ", SPACE)) if text else []

    def encode_text(self, text: str) -> str:
        """The ids, joined by commas."""
        if not text:
            return ""
        if "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            return ",".join([",".join(map(str, self._unit(u))) for u in self.units(text)])
        return ",".join(map(self.known.__getitem__, text.split(" ")))

    def encode(self, text: str) -> list[int]:
        return [i for u in self.units(text) for i in self._unit(u)]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, byte pieces as UTF-8 with U+FFFD for each byte that isn't, U+2581 as a
        space, without the dummy prefix."""
        out, held, first = [], bytearray(), True
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
                first = False
            if i is None or i in self.control:
                continue
            p = " ⁇ " if i == self.unknown else self.pieces[i]
            if first and p.startswith(SPACE):
                p = p[1:]
            first = False
            out.append(p.replace(SPACE, " "))
        return "".join(out)

    def decode_text(self, ids: str) -> str:
        """As ``decode``, of ids joined by commas."""
        if not ids:
            return ""
        each = ids.split(",")
        try:
            text = "".join(map(self.shown.__getitem__, each))
        except KeyError:
            return self.decode([int(x) for x in each])
        return text[1:] if self.shown[each[0]].startswith(" ") and int(each[0]) not in self.byte_of else text


def _utf8(raw: bytes) -> str:
    """Each byte that starts no whole character becomes one U+FFFD."""
    out = []
    while raw:
        try:
            return "".join(out) + raw.decode()
        except UnicodeDecodeError as e:
            out.append(raw[: e.start].decode() + "�")
            raw = raw[e.start + 1 :]
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per worker process and model."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


#: Rows encoded at a time, for bounded memory.
SLICE = 256


def _coded(path: str, ids_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for whole in batches:
            for at in range(0, len(whole), SLICE):
                b = whole.slice(at, SLICE)
                ids = [c.encode_text(t or "") for t in b.column("text").to_pylist()]
                back = [hashlib.sha256(c.decode_text(x).encode()).hexdigest() for x in ids]
                cols = {
                    "doc_id": b.column("doc_id"),
                    "n_tokens": pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids], pa.string()),
                    "decoded_sha256": pa.array(back, pa.string()),
                }
                if ids_too:
                    lists = [np.fromstring(x, np.int32, sep=",") if x else np.empty(0, np.int32) for x in ids]
                    cols["ids"] = pa.array(lists, pa.list_(pa.int32()))
                yield pa.record_batch(list(cols.values()), list(cols))

    return run


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """Token count and digests of every text of ``docs`` (doc_id, text), encoded and decoded
    again; with ``ids`` also the ids themselves (array of int).

    A null text is an empty one, with no ids. Every row gives a row, repeated ones too;
    doc_id is passed on as it is. Other columns are ignored; an empty table gives an empty result.
    """
    schema = DIGESTS + (", ids array<int>" if ids else "")
    return in_arrow(pick(docs, "doc_id", "text"), _coded(path, ids), schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"), model_path())


QUERIES = {"op7_sentencepiece": op7_sentencepiece}
ORACLES: dict = {}
