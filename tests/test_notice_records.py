"""Records, edges and graph of the sample notices, held against what they say."""

import pytest

from cadastra.operators import graph, records
from cadastra.plans import notice_queries as q


@pytest.fixture(scope="module")
def parts(spark):
    rec, dynamic, units, up = q.graph_parts(spark, "")
    return rec.cache(), dynamic.cache(), units.cache(), up.cache()


def test_records_fold_their_sentences(parts):
    rec = {r["record_key"]: r for r in parts[0].collect()}
    assert [r["record_id"] for r in sorted(rec.values(), key=lambda r: r["record_id"])] == [f"CR{i:06d}" for i in range(1, len(rec) + 1)]
    first = rec["1999_a.txt::一"]
    assert first["before_entities"].split(" / ")[0] == "昌平县" and "昌平区" in first["after_entities"].split(" / ")
    assert first["relation_type_ids"].split(" / ")[:2] == ["REVOKE_ADMIN", "ESTABLISH_ADMIN"] and "AREA_INHERITANCE" in first["relation_type_ids"]
    assert first["record_text"].startswith("撤销北京市昌平县") and first["effective_time"] == "1999年"
    assert "公布" not in "".join(r["record_text"] for r in rec.values())
    assert rec["1999_a.txt::三"]["action_keywords"].split(" / ")[0] == "划归"
    assert 0.6 <= min(r["classification_confidence"] for r in rec.values())


def test_dynamic_triples(parts):
    got = {(r["subject"], r["predicate"], r["object"]) for r in parts[1].collect()}
    for edge in [
        ("昌平县", "变更为", "昌平区"), ("潞西市", "变更为", "芒市"), ("寿县", "划归", "淮南市"), ("汤旺县", "隶属于", "伊春市"), ("共青城市", "直辖于", "江西省"),
        ("简阳市", "代管于", "成都市"), ("莆田县", "撤销", "无新区划（撤销）"), ("无旧区划（新设）", "设立", "北屯市"), ("宁冈县", "合并为", "井冈山市"),
    ]:
        assert edge in got, (edge, got)
    rows = parts[1].collect()
    keys = [(r["record_key"], r["subject"], r["predicate"], r["object"]) for r in rows]
    assert len(keys) == len(set(keys)) and all(r["subject"] != r["object"] for r in rows)


def test_static_edges_are_nodes_but_the_root(parts):
    _, _, units, up = parts
    assert up.count() == units.count() - 1
    parent = {r["subject_name"]: r["object_name"] for r in up.collect()}
    assert parent["井冈山市"] == "吉安市" and parent["吉安市"] == "江西省" and parent["江西省"] == "中国"
    assert parent["芒市"] == "中国" and parent["昌平区"] == "北京市"


def test_graph_is_whole(parts):
    rec, dynamic, units, up = parts
    nodes = graph.build_nodes(rec, dynamic, units)
    edges = graph.numbered_edges(graph.build_edges(rec, dynamic, up, units))
    ids = [n["node_id"] for n in nodes.collect()]
    assert len(ids) == len(set(ids))
    rows = edges.collect()
    assert {e["start_id"] for e in rows} | {e["end_id"] for e in rows} <= set(ids)
    assert sorted(e["edge_id"] for e in rows) == [f"KG_E{i:08d}" for i in range(1, len(rows) + 1)]
    assert all(e["end_id"] == "ADM_533103" for e in rows if e["relation"] == "变更为" and "芒市" in e["evidence_text"])
    near, links = graph.neighbourhood(nodes, edges, "淮南")
    assert near.count() > 2 and links.count() > 0
    doc = graph.tree(units, up, "CN", 4)
    assert [c["name"] for c in doc["children"]][:2] == ["北京市", "河北省"]


@pytest.mark.parametrize(
    ("text", "units"),
    [("东升镇、西苑乡和南关3个街道", ["东升镇", "西苑乡", "南关街道"]), ("甲村（含乙村）", ["甲村"]), ("某国道", []), ("", [])],
)
def test_unit_lists(text, units):
    assert records.unit_names(text) == units


def test_relations_that_a_text_says():
    got = records.supplements("将东升镇、西苑乡划归海淀区管辖。南关区辖甲街道、乙镇。")
    assert ("东升镇", "划归", "海淀区", "TEXT_UNIT_TRANSFER", "将东升镇、西苑乡划归海淀区管辖") in got
    assert [g[:3] for g in got if g[3] == "TEXT_UNIT_JURISDICTION"] == [("甲街道", "隶属于", "南关区"), ("乙镇", "隶属于", "南关区")]
