import pytest
from pyspark.sql import functions as F

from cadastra.llm.line_dedup import line_dedup

LINE = "This line stands on every site."


def by_definition(rows, min_sites, min_chars=20):
    def key(line):
        return " ".join(line.split(" ")).strip().lower() if line else ""

    sites, first = {}, {}
    for d, t, s in rows:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            k = key(line)
            if len(k) >= min_chars:
                sites.setdefault(k, set()).add(s)
                first[k] = min(first.get(k, (True, 0, 0)), (d is None, d or 0, i))
    out = []
    for d, t, s in rows:
        keep = [
            line for i, line in enumerate(t.split("\n")) if len(key(line)) < min_chars or len(sites[key(line)]) < min_sites or first[key(line)] == (d is None, d or 0, i)
        ] if t is not None else None
        out.append((d, None if keep is None else "\n".join(keep)))
    return sorted(out, key=str)


def test_equals_exact_counts_around_the_threshold(docs):
    rows = []
    for n in range(1, 25):  # the line of n sites is on exactly n
        rows += [(100 * n + s, f"own words {n} {s} and more\nA line that is on {n} sites, no more\n\nshort", f"site{s}") for s in range(n)]
    rows += [(9000 + i, LINE, "site0") for i in range(40)]  # many documents, one site
    for min_sites, few in ((5, 200_000), (10, 200_000), (10, 0)):  # by lines at all tasks, and by the join
        got = sorted(((r.doc_id, r.text) for r in line_dedup(docs(rows), min_sites=min_sites, broadcast_lines=few).collect()), key=str)
        assert got == by_definition(rows, min_sites)


@pytest.mark.parametrize("few", [200_000, 0])
def test_the_first_place_stays_and_counts_add_up(docs, few):
    rows = [(i, f"{LINE}\n  {LINE.upper()}  \nbody of document {i} here", f"s{i}") for i in range(12)] + [(50, None, "s1"), (51, "", None), (None, LINE, "z")]
    got = {r.doc_id: r for r in line_dedup(docs(rows), min_sites=10, broadcast_lines=few).collect()}
    assert got[0].text.split("\n")[0] == LINE and got[0].n_removed == 1
    assert got[5].text == "body of document 5 here" and (got[5].n_lines, got[5].n_removed) == (3, 2) and got[5].n_chars == len(got[5].text)
    assert got[50].text is None and got[50].n_lines == 0 and got[51].text == "" and got[None].text == ""
    assert line_dedup(docs([])).count() == 0


INNER = ["r1", "r2", "gone", "site", "pos", "place", "first", "k1", "k2", "line", "n", "sites", "N_LINES", "n_removed", "a.b", "no_id"]


@pytest.mark.parametrize("few", [200_000, 0])
def test_columns_of_any_name_are_kept(docs, few):
    rows = [(i, f"{LINE}\nbody of document {i} here", f"s{i}") for i in range(12)]
    df = docs(rows).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in INNER})
    out = line_dedup(df, broadcast_lines=few)
    kept = [c for c in df.columns if c not in ("N_LINES", "n_removed")]
    assert out.columns == [*kept, "n_lines", "n_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[7]["gone"] == "gone7" and got[7]["a.b"] == "a.b7" and (got[7].n_lines, got[7].n_removed) == (2, 1)
    assert got[0].n_removed == 0


def test_long_texts_wide_characters_and_repeats(docs):
    long = "\n".join(f"line {i} of a very long text" for i in range(50_000)) + "\n" + LINE
    rows = [(i, LINE + "\n" + "\u00e4" * 19 + "\n" + "\u00e4" * 20, f"s{i}") for i in range(12)] + [(99, long, "t")] + [(5, "x\n" + LINE, "s5")] * 2
    got = sorted(((r.doc_id, r.text) for r in line_dedup(docs(rows)).collect()), key=str)
    assert got == by_definition(rows, 10)
