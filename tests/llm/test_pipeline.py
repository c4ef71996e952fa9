import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    rnd = random.Random(9)
    voc = ["river", "stone", "house", "field", "green", "slow", "walks", "under", "light", "morning", "blue", "tree", "hill", "boat", "rain"]
    body = lambda n: " ".join(rnd.choice(voc) + str(rnd.randrange(50)) for _ in range(n))
    item = body(20)
    rows, labels = [], []
    for i in range(300):
        low = i % 6 == 0
        rows.append((i, " ".join(w + "###" for w in body(60).split()) if low else body(60), "en", f"s{i % 12}"))
        labels.append((i, int(not low), 0))
    clean = [(1000 + i, body(80), "en", f"s{i}") for i in range(20)]
    boiler = "All pages of this site end with this very line."
    lines = [(2000 + i, body(60) + "\n" + boiler, "en", f"s{i}") for i in range(12)]
    copies = [(3000 + i, clean[0][1], "en", "s1") for i in range(30)]
    leak = [(4000, body(5) + " " + item + " " + body(5), "en", "s2")]
    table = [(*r, len(r[1])) for r in rows + clean + lines + copies + leak]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = {r[0] for r in docs.select("doc_id").collect()}
    quality, line, near, leaks, last = seen.values()
    low = {r[0] for r in rows if "###" in r[1]}
    assert not quality & low and {r[0] for r in clean} <= quality
    assert line == quality
    assert 1000 in near and not near & {r[0] for r in copies}
    assert near - leaks == {4000} and leaks == last
    assert {r[0] for r in clean} <= last
    after_lines = spark.read.parquet(f"{tmp_path}/1").where(F.col("text").contains(boiler))
    assert [r[0] for r in after_lines.select("doc_id").collect()] == [2000]
    final = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(final) == last and min(final.values()) > 0


FIELDS = "doc_id long, text string, lang string, source string, n_chars long, row_hash string, win string, n_hit long, component string, score double, r1 string, __r1 string"


def table(spark, rows):
    """Rows of (doc_id, text) with columns that clash with names inside the stages."""
    return spark.createDataFrame([(d, t, "en", f"s{i % 3}", len(t or ""), "x", "x", 1, "x", 0.0, "x", "x") for i, (d, t) in enumerate(rows)], FIELDS)


VOC = [f"word{i}" for i in range(4000)]


def text(rnd, n):
    return " ".join(rnd.choice(VOC) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Benchmark items and labels, among them null, empty and repeated ones."""
    rnd = random.Random(1)
    out = tmp_path_factory.mktemp("stages")
    items = [text(rnd, 40), text(rnd, 13), text(rnd, 4), None, "", "..."]
    spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(0, items[0])], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out), items


def dirty(items, t):
    """Whether a text holds 13 words in a row of an item, or all of a shorter one."""
    words = lambda x: [w for w in "".join(c if c.isalnum() else " " for c in (x or "").lower()).split()]
    ws = words(t)
    spans = {tuple(w[i : i + min(13, len(w))]) for x in items if (w := words(x)) for i in range(len(w) - min(13, len(w)) + 1)}
    return any(tuple(ws[i : i + len(s)]) == s for s in spans for i in range(len(ws) - len(s) + 1))


def test_short_passages_in_long_texts_are_found(spark, folder):
    path, items = folder
    rnd = random.Random(2)
    passage = lambda n, at: " ".join(items[0].split()[at : at + n])
    rows = [(i, text(rnd, 2000) + " " + passage(n, 5) + ", " + text(rnd, 500)) for i, n in enumerate((13, 12, 20))]
    rows += [(10, text(rnd, 3000) + " " + items[2].upper()), (11, text(rnd, 60)), (12, None), (12, ""), (None, passage(15, 0)), (None, text(rnd, 20)), (11, items[1]), (13, "..."), (14, items[1]), (14, items[1])]
    got = corpus_pipeline.decontamination_stage(spark, table(spark, rows), path)
    assert got.columns == corpus_pipeline.DOCUMENT_COLUMNS
    wanted = [(d, t) for d, t in rows if not dirty(items, t)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(wanted, key=str) and len(wanted) == 6


def test_near_dedup_keeps_unlike_texts_of_one_id(spark, folder):
    rnd = random.Random(3)
    a, b, c = (text(rnd, 60) for _ in range(3))
    rows = [(5, a), (5, b), (7, a), (2, c), (2, c), (None, c), (None, b), (None, text(rnd, 9)), (9, None), (8, ""), (3, " ")]
    got = corpus_pipeline.near_dedup_stage(spark, table(spark, rows), folder[0])
    assert got.columns == corpus_pipeline.DOCUMENT_COLUMNS
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(5, a), (5, b), (2, c), (None, rows[7][1]), (3, " ")], key=str)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_every_stage_takes_any_rows(spark, folder, stage):
    rows = [(1, "a b c"), (None, None), (2, ""), (2, ""), (3, "x " * 30_000), (1, "other text")]
    got = stage(spark, table(spark, rows), folder[0])
    last = stage is corpus_pipeline.STAGES[-1][1]
    assert last or got.columns == corpus_pipeline.DOCUMENT_COLUMNS
    assert got.count() == (4 if stage is corpus_pipeline.near_dedup_stage else 6)
    empty = stage(spark, table(spark, rows).where("doc_id > 99"), folder[0])
    assert empty.count() == 0 and empty.columns == got.columns


def test_lines_go_from_every_site_but_the_first(spark, folder):
    line = "this line stands at the end of every page"
    rows = [(i, f"own text of page {i}\n{line}") for i in range(12)] + [(None, line), (20, None)]
    df = table(spark, rows).withColumn("source", F.concat(F.lit("s"), F.coalesce("doc_id", F.lit(99)).cast("string")))
    got = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, df, folder[0]).collect()}
    assert got[0].text == rows[0][1] and got[5].text == "own text of page 5" and got[5].n_chars == 18 and got[None].text == "" and got[20].text is None
