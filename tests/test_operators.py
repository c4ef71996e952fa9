"""Operators without an SQL twin: brute force, invariants, round trips."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadastra.functions import text
from cadastra.operators import entities, forecast, graph, labels, notices, panels, serving, spatial, tokens
from cadastra.plans import text_queries
from cadastra.sources import sinks, tables
from cadastra.streaming import events as stream

ROOT = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in (".git", "corpus_pipeline.py", "tests"):
            (shutil.copytree if p.is_dir() else shutil.copy)(p, tmp_path / p.name)
    shutil.rmtree(tmp_path / "cadastra/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'cue_summary_by_source' in q and 'pipeline' not in q; print(len(q), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_greedy_spans_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(g, int(a), int(a + n), int(n), f"x{i}") for i, (g, a, n) in enumerate(zip(rng.integers(0, 20, 400), rng.integers(0, 60, 400), rng.integers(1, 9, 400)))]
    rows = [(int(r[0]), *r[1:]) for r in rows]
    df = spark.createDataFrame(rows, "g int, start_pos int, end_pos int, score int, name string")
    got = {(r.g, r.start_pos, r.end_pos, r.name) for r in entities.greedy(df, ["g"], ["score"], ["start_pos", "end_pos", "name"]).collect()}
    want = set()
    for g in range(20):
        kept = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1], r[2], r[4])):
            if all(r[2] <= k[1] or k[2] <= r[1] for k in kept):
                kept.append(r)
        want |= {(g, k[1], k[2], k[4]) for k in kept}
    assert got == want


def test_token_offsets(spark):
    df = spark.createDataFrame([("a bb a, bb", ["a", "bb", "a", ",", "bb"]), ("", []), ("xyz", ["q", "z"])], "s string, t array<string>")
    got = [r[0] for r in df.select(tokens.token_offsets(F.col("s"), F.col("t"))).collect()]
    assert got == [[0, 2, 5, 6, 8], [], [0, 2]]


def test_tail_extrapolation_equals_a_loop(spark):
    def loop(values, lower, upper):
        out = []
        for x in values:
            if x is None and out and out[-1] is not None:
                rates = [b / a - 1 for a, b in zip(out, out[1:]) if a][-5:]
                mean = sum(rates) / len(rates) if rates else 0.0
                x = out[-1] * (1 + min(max(mean, lower), upper))
            out.append(x)
        return out

    cases = [[1.0, 1.1, 1.3, None, None, None], [5.0, None], [2.0, 1.0, 4.0, 4.4, 4.0, 4.1, 4.2, None, None], [None, None]]
    df = spark.createDataFrame([(c,) for c in cases], "v array<double>")
    got = [r[0] for r in df.select(panels.extrapolate_tail(F.col("v"), -0.05, 0.15)).collect()]
    for c, g in zip(cases, got):
        assert g == pytest.approx(loop(c, -0.05, 0.15) if any(x is not None for x in c) else [0.0, 0.0])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0, 1e6), min_size=4, max_size=30), st.floats(-3, 3))
def test_huber_fits_lines_and_ignores_an_outlier(noise, slope):
    x = np.arange(len(noise) + 6, dtype=float)
    y = 5 + slope * x
    c, w = forecast.huber(x, y)
    assert c == pytest.approx(5, abs=1e-3) and w[0] == pytest.approx(slope, abs=1e-3)
    y[len(y) // 2] += 1000
    assert abs(forecast.huber(x, y)[1][0] - slope) < abs(forecast.ols(x, y)[1][0] - slope) + 1e-6


def test_poisson_is_stationary():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = rng.poisson(np.exp(0.5 + x @ [0.4, -0.3])).astype(float)
    c, w = forecast.poisson(x, y, 0.1)
    error = np.exp(c + x @ w) - y
    assert abs(error.mean()) < 1e-6 and np.allclose(x.T @ error / 60 + 0.1 * w, 0, atol=1e-6)


def test_holt_follows_a_damped_trend():
    y = 10 + np.cumsum(2 * 0.9 ** np.arange(20))
    fitted, ahead = forecast.holt_damped(y, 3)
    assert np.abs(y - fitted)[3:].max() < 0.3 and (np.diff(ahead) > 0).all() and abs(ahead[0] - (y[-1] + 2 * 0.9**20)) < 0.3


def test_panel_forecast_has_its_interval_and_status(spark):
    rows = [("a", y, float(100 + 3 * y - 6000), "observed") for y in range(2005, 2020)] + [("b", 2018, 7.0, "observed"), ("b", 2019, 9.0, "interpolated"), ("c", 2019, None, None)]
    df = spark.createDataFrame(rows, "unit_id string, year int, pop double, status_pop string")
    got = forecast.forecast_panel(df, ["pop"], 2021, 2023).collect()
    assert {(r.unit_id, r.status) for r in got} == {("a", "forecast"), ("b", "weak_history_forecast")}
    assert all(r.lower95 <= r.value <= r.upper95 for r in got) and all(r.value == pytest.approx(7.0) for r in got if r.unit_id == "b")


def test_counts_blend_with_outside_indicators(spark):
    years = list(range(2005, 2020))
    panel = spark.createDataFrame([("u", y, 100 + 2 * (y - 2005)) for y in years], "unit_id string, year int, n int")
    outside = spark.createDataFrame([("u", y, 1e6 * 1.02 ** (y - 2005)) for y in range(2005, 2026)], "unit_id string, year int, gdp double")
    plain = forecast.forecast_counts(panel, ["n"], 2021, 2025).collect()
    mixed = forecast.forecast_counts(panel, ["n"], 2021, 2025, outside, ["gdp"]).collect()
    assert {r.forecast_model_n for r in plain} == {"damped_huber_trend"} and {r.forecast_model_n for r in mixed} == {"hybrid_damped_huber_trend_external_gdp"}
    assert all(abs(a.n - b.n) <= 0.25 * a.n for a, b in zip(plain, mixed))


def test_components_of_chains(spark):
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in (100, 101, 102)} == {100}


def test_ancestors_end_at_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "x string, y string")
    got = {(r.node, r.ancestor, r.distance) for r in graph.ancestors(edges, "x", "y").collect()}
    assert ("d", "c", 3) in got and len([g for g in got if g[0] == "a"]) == 2


def test_dense_ids_have_no_gaps(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") % 13).alias("k"), "id")
    got = notices.dense_ids(df, ["k", "id"], "n", "%04d").orderBy("k", "id").collect()
    assert [r.n for r in got] == [f"{i:04d}" for i in range(1, 501)]


def test_tf_idf_has_unit_length_and_classifier_learns(spark):
    rows = [(i, ("red apple tree " if i % 2 else "blue boat sail ") * 3 + str(i % 7), ["fruit"] if i % 2 else ["sea"]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, t string, l array<string>")
    norms = labels.tf_idf(df, "k", labels.char_ngrams(F.col("t"))).groupBy("k").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(r.n == pytest.approx(1) for r in norms)
    got = labels.train_and_predict(df, "k", "t", "l", ["fruit", "sea"]).where("is_test").collect()
    assert got and all(r.predicted == r.l for r in got)


def test_tf_idf_deals_documents_by_key_and_shuffles_no_rows(spark, monkeypatch):
    monkeypatch.setattr(labels, "TASK_TERMS", 100)
    df = spark.createDataFrame([(i, f"red Apple  {i % 9}") for i in range(40)], "k int, t string")
    got = labels.tf_idf(df, "k", labels.char_ngrams(F.col("t")))
    assert {(r.term, r.tf) for r in got.where("k = 3").collect()} >= {("re", 1), ("pp", 1), ("e 3", 1)} and got.count() == 40 * len({x for n in (2, 3, 4) for x in ("red apple 1"[i : i + n] for i in range(12 - n))})
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_classifier_learns_from_every_record(spark):
    # 30,000 records of which one in 3,000 has the only text of its label: a sample has them by chance only
    rows = spark.range(30_000).select("id", F.when(F.col("id") % 3_000 == 7, F.concat(F.lit("green pear "), "id")).otherwise(F.concat(F.lit("blue boat "), F.col("id") % 5)).alias("t"))
    df = rows.withColumn("l", F.array(F.when(F.col("t").startswith("green"), "fruit").otherwise("sea"))).withColumn("test", F.lit(False))
    texts = df.groupBy(F.col("t").alias("text")).agg(F.count("*").alias("records"), F.count("*").alias("learned"), F.array(F.count_if(F.col("t").startswith("green")), F.count_if(F.col("t").startswith("blue"))).alias("positive"))
    model = labels.fit_one_vs_rest(texts, ["fruit", "sea"], 2)
    assert {r.term for r in labels.weight_rows(spark, model).where("label = 'fruit' and weight != 0").collect()} > {f" {i}"[:4] for i in range(7, 30_000, 3_000)}
    got = labels.train_and_predict(df, "id", "t", "l", ["fruit", "sea"], is_test="test")
    assert got.where("predicted = l").count() == 30_000


def test_gradients_of_many_tasks_and_label_groups_are_the_same(spark, monkeypatch):
    rows = [(f"{a} {b}", 3, 2, [2 * (a == "red"), 2 * (a != "red")]) for a in ("red", "blue", "green") for b in range(20)]
    texts = spark.createDataFrame(rows, "text string, records long, learned long, positive array<long>")
    one = labels.fit_one_vs_rest(texts, ["r", "o"], 3)
    for name, value in (("ALONE", 0), ("TASK_LEAST", 50), ("TASK_MOST", 60), ("STATE", 1), ("SLICE", 7)):
        monkeypatch.setattr(labels, name, value)
    many = labels.fit_one_vs_rest(texts, ["r", "o"], 3)
    assert one.terms == many.terms and abs(one.weights - many.weights).max() < 1e-9 and abs(one.weights).max() > 0


def test_rings(spark):
    square = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0], [0.0, 0.0]]
    df = spark.createDataFrame([([square, [[0.5, 0.5], [1.5, 0.5], [1.5, 1.5], [0.5, 1.5], [0.5, 0.5]]],)], "p array<array<array<double>>>")
    got = df.select(
        spatial.ring_area(F.get("p", F.lit(0))).alias("a"), spatial.ring_area(F.get(spatial.rewound(F.col("p")), F.lit(0))).alias("b"),
        spatial.in_polygon(F.col("p"), F.lit(0.25), F.lit(1.0)).alias("i"), spatial.in_polygon(F.col("p"), F.lit(1.0), F.lit(1.0)).alias("h"), spatial.in_polygon(F.col("p"), F.lit(3.0), F.lit(1.0)).alias("o"),
    ).first()
    assert (got.a, got.b, got.i, got.h, got.o) == (4.0, -4.0, True, False, False)


def test_text_expressions(spark):
    df = spark.createDataFrame([("1100.0", "b / a /  / b", " 县　乡 。甲！乙")], "c string, l string, s string")
    got = df.select(
        text.admin_code(F.col("c")).alias("code"), text.join_distinct(text.split_list(F.col("l"))).alias("l"), text.canonical(text.split_list(F.col("l")), ["a", "b"]).alias("o"),
        text.canonical(F.array(F.lit("q")), ["a"], "a").alias("f"), text.split_sentences(F.col("s")).alias("s"), text.code_level(text.admin_code(F.col("c"))).alias("v"),
    ).first()
    assert (got.code, got.l, got.o, got.f, got.s, got.v) == ("001100", "b / a", ["a", "b"], ["a"], ["县 乡 。", "甲！", "乙"], "prefecture")


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1999_x.txt").write_text("一、甲。\r\n\n二、乙；丙。\n", encoding="utf-8")
    (tmp_path / "in/skip.csv").write_text("no")
    lines = tables.read_notices(spark, f"{tmp_path}/in").orderBy("line_no").collect()
    assert [(r.year, r.line_no, r.raw_line) for r in lines] == [(1999, 1, "一、甲。"), (1999, 2, ""), (1999, 3, "二、乙；丙。")]
    df = spark.createDataFrame([("001", ["a", "b"]), ("002", [])], "code string, names array<string>")
    sinks.write_csv(df, f"{tmp_path}/csv")
    back = tables.read_csv(spark, f"{tmp_path}/csv", required=["code"]).orderBy("code").collect()
    assert [(r.code, r.names) for r in back][0] == ("001", "a / b")
    with pytest.raises(ValueError, match="missing columns: other"):
        tables.read_csv(spark, f"{tmp_path}/csv", required=["other"])
    assert tables.read_optional(spark, f"{tmp_path}/none", "a string").count() == 0
    sinks.write_tables({"t": df.select("code")}, f"{tmp_path}/db")
    cat = sinks.catalogue(spark, f"{tmp_path}/db", ["t"]).first()
    assert (cat.table_name, cat.row_count, cat.column_count) == ("t", 2, 1) and cat.size_bytes > 0
    older = spark.createDataFrame([("t",), ("u",)], "table_name string").withColumn("modified", F.lit("2000-01-01").cast("timestamp"))
    assert {(r.table_name, r.stale) for r in sinks.needs_rebuild(sinks.catalogue(spark, f"{tmp_path}/db", ["t"]), older).collect()} == {("t", False), ("u", True)}
    assert sinks.markdown_table(df.select("code")).splitlines()[:3] == ["| code |", "| --- |", "| 001 |"]
    assert "MERGE (a)-[r:X" in sinks.cypher_script("n.csv", "e.csv", ["X"])


def test_geojson_and_indicators(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"features":[{"properties":{"adcode":1,"name":"a","center":[1.0,2.0]},"geometry":{"type":"Polygon","coordinates":[[[0,0]]]}}]}')
    assert [(r.adcode, r.lon, r.lat) for r in tables.read_features(spark, f"{tmp_path}/g.json").collect()] == [("1", 1.0, 2.0)]
    payload = spark.createDataFrame([('[{"page":1},[{"date":"2001","value":2.5},{"date":"2003","value":null}]]',)], "j string")
    one = tables.read_indicator_json(payload, "j", "gdp_current_lcu")
    got = tables.macro_table(spark, [one, one.withColumnRenamed("gdp_current_lcu", "population_total")], 2000, 2003).orderBy("year").collect()
    assert [(r.year, r.gdp_per_capita_lcu) for r in got] == [(2000, None), (2001, 1.0), (2002, None), (2003, None)]


def test_units_with_parents(spark):
    p = spark.createDataFrame([("11", "北京")], "code string, name string")
    c = spark.createDataFrame([("1101", "市辖区", "11")], "code string, name string, provinceCode string")
    got = tables.admin_units([("province", p), ("city", c)]).orderBy("unit_id").collect()
    assert [(r.unit_id, r.level, r.province, r.city) for r in got] == [("11", "province", "北京", None), ("1101", "city", "北京", "市辖区")]


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, "ab"[i % 2], float(i), 60 * i) for i in range(200)], "event_id long, user_id long, event_type string, value double, s long")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_600_000_000)).drop("s")
    df.write.parquet(f"{tmp_path}/e")
    query = stream.tumbling(stream.read_events(spark, f"{tmp_path}/e", 10), "10 minutes", late="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    key = lambda rows: sorted((r.window_start, r.event_type, r.events, r.value) for r in rows)
    assert key(spark.sql("SELECT * FROM w").collect()) == key(stream.tumbling(df, "10 minutes").collect())


def test_serving_bounds_and_filters(spark):
    assert [serving.bounded(x, 5, 1, 9) for x in ("7", None, "x", 99, -1)] == [7, 5, 5, 9, 1]
    df = spark.createDataFrame([(1, "50% off", "a"), (2, None, "b"), (3, "50 off", "a")], "k int, t string, l string")
    assert [r.k for r in df.where(serving.holds("50%", ["t"])).collect()] == [1]
    assert df.where(serving.where_all(l="a", t=None)).count() == 2
    assert [r.k for r in serving.limited(df, [F.desc("k")], 2).collect()] == [3, 2] and serving.limited(df, ["k"]).count() == 3


def test_token_context_in_batches_of_arrays(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BATCH", 3)
    rows = [(1, ["a", "b", "c", "d", "e"], ["v", "w", "n", "n", "LOC"]), (2, [], []), (3, None, None), (4, ["x"] * 128, ["v", "vn"] * 64)]
    df = spark.createDataFrame(rows, "k long, tokens array<string>, tags array<string>")
    got = tokens.token_context(df)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    rows = {(r.k, r.token_index): r for r in got.collect()}
    assert len(rows) == 133 and [rows[1, i].near_location for i in range(1, 6)] == [0, 1, 1, 1, 1]
    assert (rows[4, 1].prev_token, rows[4, 1].prev_pos, rows[1, 5].next_token, rows[1, 3].prev_pos, rows[1, 3].is_after_punctuation) == ("", "", "", "w", 1)
    assert rows[4, 1].token_position_ratio == 0.007812 and rows[4, 3].token_position_ratio == 0.023438  # half-even
    verbs = tokens.verb_rows(df, ["k"]).collect()
    assert [sum(r.kind == kind for r in verbs) for kind in (tokens.PLACE, tokens.VERB, tokens.FRAME)] == [129, 2, 5]


def test_sentences_are_split_once_a_line(spark):
    lines = spark.createDataFrame([("f", 2001, 1, "a.b . c!"), ("f", 2001, 2, " "), ("f", 2001, 3, None)], "source_file string, year int, line_no int, raw_line string")
    got = notices.sentences(notices.parse_lines(lines, ends=".!"))
    plan = got.drop("item_no")._jdf.queryExecution().optimizedPlan().toString()  # without it nothing holds a filter above the window
    assert plan.count("filter(transform(") == 1  # Spark's guard of a plain posexplode had the whole expression once more
    assert [(r.line_no, r.sentence_no, r.sentence) for r in got.collect()] == [(1, 0, "a."), (1, 1, "b ."), (1, 2, "c!")]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(" .!?;a　\u0085 \n\tß😀", max_size=12), min_size=1, max_size=20))
def test_sentences_equal_a_split(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "k int, s string")
    got = df.select("k", text.split_sentences(F.col("s"), ".!?;").alias("a"), text.split_sentences(text.clean_line(F.col("s")), ".!?;", cleaned=True).alias("b")).collect()
    for r in got:
        want = [x.strip(" ") for x in re.split(r"(?<=[.!?;]) *", re.sub(r"\s+", " ", lines[r.k]).strip(" "))]
        assert r.a == r.b == [x for x in want if x]


def test_cooccurrence_makes_tokens_once_and_joins_only_sentences_with_pairs(spark, monkeypatch):
    made, joined = spark.sparkContext.accumulator(0), []
    words = ["walking", "told", "united", "sing", "ed", "x"]
    rng = np.random.default_rng(7)
    said = [(i, " ".join(words[j] for j in rng.integers(0, 6, rng.integers(0, 7)))) for i in range(60)] + [(60, ""), (61, " ".join(f"v{i:03d}" for i in range(120)))]

    def split(s):
        made.add(1)
        return s.split(" ") if s else []

    settle = tokens.settle
    monkeypatch.setattr(tokens, "settle", lambda df: joined.append(settle(df)) or joined[-1])
    df = spark.createDataFrame(said, "k int, sentence string")
    df = tokens.tag_sentences(df, F.udf(split, "array<string>")("sentence"), lambda t: F.when(t.isin("x", "ed"), "n").otherwise("v"))
    got = {(r.verb_a, r.verb_b): tuple(r)[2:] for r in tokens.verb_cooccurrence(df, ["k"], "sentence").select("verb_a", "verb_b", "cooccurrence_score", "sentence_count", "example_sentence").collect()}
    want = {}
    for _, s in said:
        n = {w: s.split(" ").count(w) for w in s.split(" ") if w not in ("x", "ed", "")}
        for a in n:
            for b in n:
                if a < b:
                    score, count, first = want.get((a, b), (0, 0, s))
                    want[a, b] = score + n[a] + n[b], count + 1, first
    assert got == want and made.value == len(said) and len(joined) == 1


def test_cooccurrence_leaves_out_no_sentence_with_a_pair(spark, tmp_path):
    texts = ["united\nhe WalkINg walked, singing; ed ing led|fed:", "a.ended-x ended ended.being;bed", "led　fed", "led\u0085fed. Xed ted", "ing ed", "leding fed1 shed", None, "fed,led"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    key = lambda df: sorted(tuple(r) for r in df.select("verb_a", "verb_b", "cooccurrence_score", "sentence_count", "example_sentence").collect())
    got = key(text_queries.q_cooccurrence(spark, str(tmp_path)))
    assert got == key(tokens.verb_cooccurrence(text_queries.tagging(spark, str(tmp_path)), text_queries.KEYS, "sentence"))
    assert [r[:4] for r in got] == [("fed", "led", 8, 4), ("leding", "shed", 2, 1), ("singing", "walked", 2, 1)]
