"""License scans by ordered signature rules.

Rules are regular expressions written by hand (``license_rules``), each with a label, a priority and
keywords. A text's keywords are found first, and only rules of which all are there are tried, in
order of priority. Of two detections one of which lies inside the other, the one of higher priority
stays, of equal ones the longer; detections that overlap in part both stay. Rules that deny a
license have the highest priority, so what they cover is gone.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cadastra.llm.common import each, in_arrow, pick, table
from cadastra.llm.license_rules import PARTS, TABLE

#: Phrases of the base scan, whose words must stand consecutively, and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

DENIED = "!"


class Rule(NamedTuple):
    label: str
    priority: int
    keywords: tuple[tuple[str, ...], ...]
    find: re.Pattern


@lru_cache(1)
def rules() -> list[Rule]:
    """All rules by falling priority."""
    out = []
    for line in TABLE.strip().splitlines():
        label, priority, words, pattern = line.split(" | ", 3)
        for name, part in PARTS.items():
            pattern = pattern.replace(name, part)
        keywords = tuple(tuple(w.replace("_", " ") for w in k.split("/") if w) if "/" in k.strip("/") else (k.replace("_", " "),) for k in words.split())
        out.append(Rule(label, int(priority), keywords, re.compile(rf"(?:{pattern})(?!\w)")))
    return sorted(out, key=lambda r: -r.priority)


@lru_cache(1)
def _by_keyword() -> list[tuple[tuple[str, ...], list[Rule]]]:
    """Rules under the longest of their keywords, which is sought first."""
    found: dict[tuple[str, ...], list[Rule]] = {}
    for r in rules():
        found.setdefault(max(r.keywords, key=lambda k: min(map(len, k))), []).append(r)
    return list(found.items())


def tried(text: str) -> list[Rule]:
    """Rules whose keywords are in the text."""
    out = []
    for first, group in _by_keyword():
        if any(w in text for w in first):
            out += [r for r in group if all(any(w in text for w in k) for k in r.keywords)]
    return out


class Found(NamedTuple):
    start: int
    end: int
    label: str
    priority: int


def matches(rule: Rule, text: str) -> Iterator[Found]:
    """Places of a rule that begin at a word's border, from left to right without overlap."""
    at, find = 0, rule.find.search
    place = "at" if "at" in rule.find.groupindex else 0
    while m := find(text, at):
        start = m.start(place)
        if start and (text[start - 1].isalnum() or text[start - 1] == "_") and (text[start].isalnum() or text[start] == "_"):
            at = m.start() + 1
        else:
            yield Found(start, m.end(place), rule.label, rule.priority)
            at = max(m.end(), m.start() + 1)


def unsuppressed(found: list[Found]) -> list[Found]:
    """Detections that stay, by place. None of those kept lies in another, so their ends are in
    order as their starts are, and one look to each side tells."""
    starts: list[int] = []
    kept: list[Found] = []
    for f in sorted(set(found), key=lambda f: (-f.priority, f.start - f.end, f.start, f.label)):
        before = bisect_right(starts, f.start) - 1
        after = bisect_left(starts, f.start)
        inside = before >= 0 and kept[before].end >= f.end
        around = after < len(kept) and kept[after].end <= f.end
        if not inside and not around:
            starts.insert(after, f.start)
            kept.insert(after, f)
    return kept


#: White space, with the mark that begins a comment's line.
_GAPS = re.compile(r"\s+(?:(?:\*|#+|//+|;+|%+)\s+)?")


def _single_blanks(text: str) -> tuple[str, list[int], list[int]]:
    """The text with one blank for each gap; from which places on, and how far, it is shifted."""
    ends, taken = [], []
    for m in _GAPS.finditer(text):
        if len(m[0]) > 1:
            ends.append(m.end())
            taken.append(len(m[0]) - 1)
    shifts = list(accumulate(taken))
    return _GAPS.sub(" ", text), [e - s for e, s in zip(ends, shifts, strict=True)], shifts


def detect_all(text: str, prefilter: bool = True) -> list[Found]:
    """Like ``detect``, with denials (label ``!``)."""
    plain, places, shifts = _single_blanks(text)
    found = unsuppressed([f for r in (tried(plain) if prefilter else rules()) for f in matches(r, plain)])
    if not places:
        return found

    def back(at: int) -> int:
        k = bisect_right(places, at)
        return at + (shifts[k - 1] if k else 0)

    return [Found(back(f.start), back(f.end - 1) + 1, f.label, f.priority) for f in found]


def detect(text: str, prefilter: bool = True) -> list[Found]:
    """Detections in a text in lower case that no other one suppresses, by place. The prefilter
    only saves time."""
    return [f for f in detect_all(text, prefilter) if f.label != DENIED]


_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TO_SPACE = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_PHRASES = [(re.compile(rb"(?<![^ ])" + rb" +".join(p.encode().split()) + rb"(?![^ ])"), max(p.encode().split(), key=len), label) for p, label in BASE]


def _bytes_at(text: str, places: list[int]) -> list[int]:
    """UTF-8 offsets of rising character offsets."""
    return list(accumulate(len(text[a:b].encode()) for a, b in zip([0, *places], places, strict=False)))


def scan(text: bytes) -> dict:
    """Base places (word number, label), detections, and the number of words of one text."""
    line = text.translate(_TO_SPACE)
    hits = sorted((m.start(), m.end(), label) for find, word, label in _PHRASES if word in line for m in find.finditer(line))
    places, words, at = [], 0, 0
    for start, _, label in hits:  # words are counted once, from one place to the next
        words += len(line[at:start].split())
        at = start
        places.append((words, label))
    low = text.translate(_LOWER).decode(errors="replace")
    found = detect_all(low)
    starts, ends = _bytes_at(low, [f.start for f in found if f.label == DENIED]), _bytes_at(low, [f.end for f in found if f.label == DENIED])

    def denied(start: int, end: int) -> bool:
        k = bisect_right(starts, start) - 1
        return k >= 0 and end <= ends[k]

    open_ = [h for h in hits if not denied(h[0], h[1])]
    found = [f for f in found if f.label != DENIED]
    base = sorted({x for _, x in places})
    labels = sorted({*base, *(f.label for f in found)})
    score = max([f.priority / 100 for f in found] + [0.95 * bool(open_)])
    return {"n_words": words + len(line[at:].split()), "places": places, "base": base, "labels": labels, "found": found, "score": score}


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:int,end:int,label:string,priority:int>>"


def _scans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("priority", pa.int32())]))
    for b in batches:
        got = [scan(t) for t in each(b.column("text"))]
        cols = {
            "doc_id": b.column("doc_id"),
            "n_words": pa.array([g["n_words"] for g in got], pa.int64()),
            "n_base": pa.array([len(g["places"]) for g in got], pa.int64()),
            "first_word": pa.array([g["places"][0][0] if g["places"] else None for g in got], pa.int64()),
            "last_word": pa.array([g["places"][-1][0] if g["places"] else None for g in got], pa.int64()),
            "base_labels": pa.array([",".join(g["base"]) for g in got], pa.string()),
            "labels": pa.array([",".join(g["labels"]) for g in got], pa.string()),
            "score": pa.array([g["score"] for g in got], pa.float64()),
            "detections": pa.array([[f._asdict() for f in g["found"]] for g in got], kind),
        }
        yield pa.record_batch(list(cols.values()), list(cols))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License detections of every text of ``docs`` (doc_id, text); positions are characters.

    A null text counts as empty: no words, empty labels, score 0. Every row gives a row, repeated
    ones too; other columns are ignored. score is the best detection's priority out of 100, and at
    least 0.95 for a text with a base phrase that isn't denied. A denied base phrase keeps its label.
    """
    return in_arrow(pick(docs, "doc_id", "text"), _scans, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


QUERIES = {"op9_license_scan": op9_license_scan}
ORACLES: dict = {}
