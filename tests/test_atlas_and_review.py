import pytest
from pyspark.sql import functions as F

from cadastra.operators import atlas, labels, relations, serving
from cadastra.plans import notice_queries as q


def test_count_panel_fills_and_carries(spark):
    names = {2010: ["甲镇", "乙乡", "丙街道"], 2013: ["甲镇", "丁镇", "乙苏木", "丙街道", "戊街道办事处", "己农场"]}
    streets = spark.createDataFrame([(y, n, "11") for y, ns in names.items() for n in ns] + [(2010, "x镇", "99")], "year int, name string, provinceCode string")
    centres = spark.createDataFrame([("110000", "北京", 1.0, 2.0)], "unit_id string, province string, lon double, lat double")
    got = {r.year: r for r in atlas.count_panel(streets, centres, 2015).collect()}
    assert sorted(got) == list(range(2010, 2016))
    assert (got[2013].street_count, got[2013].town_count, got[2013].township_count, got[2013].other_township_level_count) == (2, 2, 1, 1)
    assert [got[y].township_street_count for y in (2010, 2011, 2012, 2013, 2015)] == [3, 4, 5, 6, 6]
    assert [got[y].status_township_street_count for y in (2010, 2011, 2013, 2014)] == ["observed", "interpolated", "observed", "nowcast"]
    ahead = atlas.with_forecast(atlas.count_panel(streets, centres, 2015), 2016, 2018).where("year > 2015").collect()
    assert len(ahead) == 3 and all(r.township_street_count >= 6 and r.province == "北京" for r in ahead)


def test_national_series(spark):
    got = {r.year: r for r in atlas.national_series(spark).collect()}
    assert sorted(got) == list(range(2009, 2036)) and got[2026].township_street_count == 38712 and got[2027].status_township_street_count == "forecast"
    assert all(r.other_township_level_count >= 0 for r in got.values())


def test_weights_and_schema():
    assert atlas.metric_weights({"metrics": {"a": {"weight": 3}, "b": {}}}) == {"a": 0.75, "b": 0.25}
    assert atlas.metric_weights({"metrics": {"a": {"weight": 0}, "b": {"weight": 0}}}) == {"a": 0.5, "b": 0.5}
    assert atlas.panel_schema(["m"]).names[-4:] == ["m", "source_m", "status_m", "source_note"]


def test_outside_indicators_keep_both_sides(spark):
    a = spark.createDataFrame([("u", 2000, 5.0)], "unit_id string, year int, population_external double")
    b = spark.createDataFrame([("u", 2001, 7.0), ("u", 2001, 9.0)], "unit_id string, year int, gdp_external double")
    got = sorted((r.year, r.population_external, r.gdp_external) for r in atlas.outside_indicators(a, b).collect())
    assert got == [(2000, 5.0, None), (2001, None, 7.0)]


def test_candidate_review_cascade(spark):
    types = relations.relation_types(spark)
    rows = [("撤销", 9), ("为", 9), ("至", 9), ("恢复", 9), ("公布", 9), ("某", 9), ("走走", 2), ("走走走", 9)]
    got = {r.candidate_relation: (r.mapped_relation_type_id, r.review_label) for r in relations.candidate_review(spark.createDataFrame(rows, "candidate_relation string, count int"), types).collect()}
    assert got["撤销"] == ("REVOKE_ADMIN", "core") and got["为"][0] in ("AREA_INHERITANCE", "AUX_CONNECTOR") and got["至"][1] == "auxiliary_pattern"
    assert [got[k][1] for k in ("恢复", "公布", "某", "走走", "走走走")] == ["context_dependent", "exclude", "review_or_noise", "review_or_noise", "manual_review"]
    verbs = spark.createDataFrame([("撤销", 5, 4)], "verb string, count long, sentence_count long")
    archive = relations.trigger_archive(types, verbs).where("trigger_word = '撤销'").first()
    assert (archive.verb_count, archive.is_exact_verb) == (5, 1)


def test_overview_and_evidence(spark):
    sents, triples = q.related(spark)
    summary = relations.sentence_relations(sents, triples)
    o = relations.relation_overview(summary, triples).first()
    assert o.triple_count == triples.count() and o.sentence_count == sents.count() and o.excluded_publication_notice_sentence_count == 1
    none, notices = relations.residuals(summary)
    assert notices.count() == 1 and none.count() == o.zero_relation_sentence_count
    assert relations.rule_samples(triples, 1).count() == o.relation_type_count
    verbs = spark.createDataFrame([("撤销", 5)], "verb string, count long")
    row = relations.schema_evidence(sents, verbs, relations.relation_types(spark)).where("relation_type_id = 'REVOKE_ADMIN'").first()
    assert (row.trigger_count, row.evidence_sentence_count) == (5, 2)


@pytest.mark.parametrize(
    ("text", "unit"),
    [("撤销昌平县", "昌平县"), ("原昌平县的行政区域", "昌平县"), ("行政区划调整", ""), ("无新区划（撤销）", "无新区划（撤销）"), ("某事", ""), ("区人民政府驻城区镇", "城区镇"), (None, "")],
)
def test_plain_ends(spark, text, unit):
    assert spark.range(1).select(serving.unit_end(F.lit(text).cast("string"))).first()[0] == unit


def test_full_names_come_from_the_evidence(spark):
    of = lambda name, evidence: spark.range(1).select(serving.full_name(F.lit(name), F.lit(evidence))).first()[0]
    assert of("平县", "撤销昌平县，设立昌平区") == "昌平县"
    assert of("级北屯市", "") == "北屯市"
    df = spark.createDataFrame([("撤销昌平县", "昌平区", "撤销昌平县，设立昌平区"), ("某事", "昌平区", "")], "subject string, object string, evidence_text string")
    assert [(r.subject, r.object) for r in serving.with_plain_ends(df).collect()] == [("昌平县", "昌平区")]


def test_sentence_samples_stay_on_the_training_side(spark):
    t = spark.createDataFrame([("k1", "s1", "x", "B"), ("k1", "s1", "x", "A"), ("k2", "s2", "y", "A"), ("k1", "s3", "z", "?")], "record_key string, sentence_id string, sentence string, relation_type_id string")
    r = spark.createDataFrame([("k1", "r1"), ("k2", "r2")], "record_key string, record_id string")
    got = labels.sentence_samples(t, r, r.where("record_id = 'r1'"), ["A", "B"]).collect()
    assert [(g.record_id, g.label_set) for g in got] == [("r1::s1", ["A", "B"])]
