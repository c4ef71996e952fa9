"""Classes, the archive, the graph around a keyword, pages, and sources beyond CSV."""

import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadastra import cli
from cadastra.operators import archive, classes, endpoints, spatial, subgraph
from cadastra.plans import notice_queries as q
from cadastra.sources import raster, sinks, tables, web, workbook


def test_views_and_filters():
    assert classes.view_of(" SEM ") == "semantic" and classes.view_of(None) == "detail"
    assert classes.type_filter("REVOKE_ADMIN") == "撤销建制" and classes.type_filter("撤销建制") == "撤销建制" and classes.type_filter("x") == ""
    assert classes.type_filter("撤销建制 / 名称变更", "semantic") == "建制变更" and classes.type_filter("区域划转", "semantic") == "区域划转"
    assert classes.type_filter("x", "semantic") == "x" and classes.type_filter("", "semantic") == ""
    assert classes.type_names("驻地变更", "semantic") == ["政府驻地", "驻地迁移"] and classes.type_names("名称变更") == ["名称变更"] and classes.type_names("x", "semantic") == []
    assert classes.level_set("city, town,,county") == ["county", "prefecture", "township"] and classes.level_set("") == []


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_relation_ids_and_classes(spark):
    ids = lambda s, t: one(spark, classes.relation_ids(F.lit(s).cast("string"), F.lit(t).cast("string")))
    assert ids("REVOKE_ADMIN+ESTABLISH_ADMIN", "") == ["REVOKE_ADMIN", "ESTABLISH_ADMIN"]
    assert ids("TEXT_UNIT_TRANSFER", "") == ["TRANSFER_ADMIN"] and ids("?", "名称变更 / 合并建制") == ["RENAME_ADMIN", "MERGE_ADMIN"] and ids(None, None) == ["ADJUSTMENT_EVENT"]
    assert one(spark, classes.classes_of(F.array(F.lit("GOV_RESIDENCE"), F.lit("?"), F.lit("MERGE_ADMIN")))) == ["建制变更", "驻地变更", "其他综合调整"]
    assert one(spark, classes.area_text(F.lit("中国/河北省 /廊坊市\t"))) == "河北省廊坊市"
    assert one(spark, classes.township_source(F.lit(None).cast("string"))) == "未标注来源"


def test_distribution_counts_a_class_once_for_a_label(spark):
    df = spark.createDataFrame([("撤销建制 / 设立建制", 3), ("名称变更", 2), ("", 9)], "type_label string, value long")
    assert {r.type: r.value for r in classes.type_distribution(df).collect()} == {"撤销建制": 3, "设立建制": 3, "名称变更": 2}
    got = {r.type: r.value for r in classes.type_distribution(df, "semantic").collect()}
    assert got["建制变更"] == 3 and got["名称变更"] == 2 and got["驻地变更"] == 0 and len(got) == 6


def test_six_class_classifier_learns_from_its_sample(spark):
    rows = [(f"r{i}", f"撤销甲{i}县" if i % 2 else f"乙{i}县更名为丙", "REVOKE_ADMIN" if i % 2 else "RENAME_ADMIN") for i in range(120)]
    df = spark.createDataFrame(rows, "record_id string, record_text string, relation_type_ids string")
    split = classes.six_class_split(df, 10).collect()
    assert sum(r.is_sample for r in split) == 20 and not any(r.is_sample and r.is_test for r in split)
    got = classes.six_class_evaluation(df, 10).first()
    assert got.exact_match_accuracy == 1.0 and got.rule_ml_agreement_rate == 1.0 and (got.total_labeled_sample_count, got.training_sample_count) == (120, 20)


def test_archive(spark):
    rows = archive.relation_archive(spark).orderBy("schema_order").collect()
    assert [r.relation_type_id for r in rows] == archive.ORDER and all(r.subject_hint and r.notes for r in rows) and rows[0].triggers == ["撤销", "撤"]
    text = archive.archive_document(archive.relation_archive(spark))
    assert text.count("\n## ") == 13 and "| REVOKE_ADMIN | 撤销建制 |" in text


@pytest.fixture(scope="module")
def town(spark):
    """A province with two cities; 70 counties in one of them."""
    units = [("13", "甲省", "province", "甲省", "CN"), ("1301", "乙市", "prefecture", "甲省/乙市", "13"), ("1302", "丙市", "prefecture", "甲省/丙市", "13"), ("14", "丁省", "province", "丁省", "CN")]
    units += [(f"1301{i:02}", f"县{i:02}", "county", f"甲省/乙市/县{i:02}", "1301") for i in range(70)]
    nodes = spark.createDataFrame([(f"ADM_{c}", c, n, lv, p, "t") for c, n, lv, p, _ in units] + [("CN", "CN", "中国", "country", "中国", "t")], "node_id string, admin_code string, admin_name string, admin_level string, full_path string, source_table string")
    up = spark.createDataFrame([(f"ADM_{c}", "CN" if u == "CN" else f"ADM_{u}") for c, _, _, _, u in units], "subject_node_id string, object_node_id string")
    rel = [
        ("县69", "划归", "乙市", "R1", 2001, "x"), ("县69", "划归", "乙市", "R1", 2001, "x"), ("旧乙市县", "变更为", "新乙市县", "R2", 2002, "丙市的旧乙市县"), ("乙市", "撤销", "无新区划（撤销）", "R3", 2003, "x"),
        ("乙市", "发生调整", "调整事件", "R4", 2003, "x"), ("丁省", "划归", "乙市", "R5", 2004, "x"), ("其他", "划归", "别处", "R6", 2004, "x"), (" ", "划归", "乙市", "R7", 2004, "x"),
    ]
    dynamic = spark.createDataFrame(rel, "subject string, predicate string, object string, record_id string, year int, evidence_text string")
    return nodes, up, dynamic


def test_subgraph_of_a_unit(town):
    nodes, links = subgraph.keyword_subgraph(*town, "乙市")
    found = {r.id: r for r in nodes.collect()}
    edges = {(r.source, r.target, r.relation, r.edge_type) for r in links.collect()}
    assert found["ADM_1301"].category == subgraph.ROOT and found["ADM_13"].category == subgraph.UNIT and found["TEXT::无新区划（撤销）"].category == subgraph.MISSING
    assert sum(r.admin_level == "county" for r in found.values()) == 61  # the first 60 and the one that a relation names
    assert ("ADM_13", "ADM_1301", "下辖", "static") in edges and ("ADM_1301", "ADM_130169", "下辖", "static") in edges
    assert ("ADM_130169", "ADM_1301", "划归", "dynamic") in edges and ("TEXT::丁省", "ADM_1301", "划归", "dynamic") in edges  # a unit elsewhere is a text
    # what nothing else ties to the root hangs on it: its evidence names a city that isn't under the root
    assert ("ADM_1301", "TEXT::新乙市县", "下辖", "context") in edges
    assert not any("调整事件" in s + t or "其他" in s + t for s, t, _, _ in edges) and len([e for e in edges if e[3] == "dynamic"]) == 4
    assert all(s in found and t in found for s, t, _, _ in edges)


def test_subgraph_ties_parts_by_their_evidence(town):
    nodes, links = subgraph.keyword_subgraph(town[0], town[1], town[2], "甲省")
    assert links.where("edge_type = 'dynamic'").count() == 0 and nodes.where("admin_level = 'prefecture'").count() == 2
    dynamic = town[2].withColumn("subject", F.concat(F.lit("甲省"), "subject"))
    _, links = subgraph.keyword_subgraph(town[0], town[1], dynamic, "甲省")
    assert ("ADM_1302", "TEXT::新乙市县") in {(r.source, r.target) for r in links.where("edge_type = 'context'").collect()}


def test_subgraph_makes_its_tables_once(spark, town):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    nodes = town[0].mapInArrow(seen, town[0].schema)
    up = town[1].mapInArrow(seen, town[1].schema)
    nodes_, links = subgraph.keyword_subgraph(nodes, up, town[2], "乙市")
    assert nodes_.count() and links.count() and made.value == town[0].count() + town[1].count()


def test_subgraph_without_a_unit(town):
    nodes, links = subgraph.keyword_subgraph(*town, "旧乙市")
    assert {r.id for r in nodes.collect()} == {"TEXT::旧乙市县", "TEXT::新乙市县"} and links.count() == 1


def test_pages(spark, town):
    nodes, up, dynamic = town
    assert [r.name for r in endpoints.provinces(nodes, up).collect()] == ["甲省", "丁省"]
    shown = endpoints.children(nodes, up, "1301", "county").collect()
    assert len(shown) == 70 and (shown[0].level_name, shown[0].parent_code) == ("县区级", "1301") and endpoints.children(nodes, up, "1301", "town").count() == 0
    page = endpoints.graph_node(nodes, up, dynamic, "乙市")
    assert page["area"].first().code == "1301" and page["relations"].count() == 5
    sents, triples = q.related(spark)
    rec = q.folded(spark, "")[0]
    labels = rec.select("record_id", "year", F.col("relation_type_ids").alias("type_id"), "type_label", "record_text", "classification_confidence", "classification_rule")
    got = endpoints.forecast_year(rec, labels, 1999)
    assert got["events"].count() == got["classifications"].count() == 3
    dyn = q.graph_parts(spark, "")[1]
    page = endpoints.relations(dyn, wanted="名称变更", view="semantic")
    assert page["relations"].count() >= 1 and page["types"].where("type = '名称变更'").first().value >= 1
    assert endpoints.classifications(labels, labels, labels, keyword="芒市")["records"].count() == 1


def book(rows, sheet="省市区"):
    """A workbook with one sheet: shared strings, inline strings, numbers and a gap."""
    shared = []

    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r}"
        if v is None:
            return ""
        if isinstance(v, int):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if v.startswith("="):
            return f'<c r="{ref}" t="inlineStr"><is><t>{v[1:]}</t></is></c>'
        shared.append(v)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{r}">' + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    (tmp_path / "codes.xlsx").write_bytes(book([["name", "code", "x"], ["中国,甲省", "010000", 1], ["=中国,甲省,乙市", "010100"], [None, 5, "y"]]))
    areas, streets = workbook.read_code_table(spark, str(tmp_path / "codes.xlsx"), townships=False)
    assert streets is None and sorted((r.code, r.name) for r in areas.collect()) == [("010000", "中国,甲省"), ("010100", "中国,甲省,乙市"), ("5", "")]
    with pytest.raises(ValueError, match="no sheet"):
        list(workbook.sheet_rows(book([["a"]]), "other"))


def tiff(values, tile=None, deflate=False, x0=10.0, y0=50.0, step=0.5):
    """A one-band float TIFF in strips of two rows, or in square tiles."""
    h, w = values.shape
    blocks = []
    if tile:
        for r in range(0, h, tile):
            for c in range(0, w, tile):
                b = np.zeros((tile, tile), "<f4")
                part = values[r : r + tile, c : c + tile]
                b[: part.shape[0], : part.shape[1]] = part
                blocks.append(b.tobytes())
    else:
        blocks = [values[r : r + 2].astype("<f4").tobytes() for r in range(0, h, 2)]
    blocks = [zlib.compress(b) if deflate else b for b in blocks]
    tags = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [32]), 259: ("H", [8 if deflate else 1]), 339: ("H", [3]), 33550: ("d", [step, step, 0.0]), 33922: ("d", [0.0, 0.0, 0.0, x0, y0, 0.0])}
    tags |= {322: ("I", [tile]), 323: ("I", [tile])} if tile else {278: ("I", [2])}
    places, sizes = (324, 325) if tile else (273, 279)
    tags |= {places: ("I", [0] * len(blocks)), sizes: ("I", [len(b) for b in blocks])}
    start = 8 + 2 + 12 * len(tags) + 4
    extra = {k: start for k in ()}
    at = start
    for k, (code, v) in sorted(tags.items()):
        size = struct.calcsize("<" + code * len(v))
        if size > 4:
            extra[k], at = at, at + size
    offsets = []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    tags[places] = ("I", offsets)
    kinds = {"H": 3, "I": 4, "d": 12}
    head, more = struct.pack("<2sHIH", b"II", 42, 8, len(tags)), b""
    for k, (code, v) in sorted(tags.items()):
        packed = struct.pack("<" + code * len(v), *v)
        head += struct.pack("<HHI", k, kinds[code], len(v)) + (struct.pack("<I", extra[k]) if k in extra else packed.ljust(4, b"\0"))
        more += packed if k in extra else b""
    return head + b"\0" * 4 + more + b"".join(blocks)


@pytest.mark.parametrize(("tile", "deflate"), [(None, False), (None, True), (4, False), (4, True)])
def test_rasters(spark, tmp_path, tile, deflate):
    values = np.arange(63, dtype="f4").reshape(7, 9)
    values[3, 3] = np.nan
    (tmp_path / "a.tif").write_bytes(tiff(values, tile, deflate))
    got = {(r.lon, r.lat): r.value for r in raster.read_pixels(spark, str(tmp_path / "a.tif")).collect()}
    assert got == {(10 + (c + 0.5) * 0.5, 50 - (r + 0.5) * 0.5): float(values[r, c]) for r in range(7) for c in range(9) if values[r, c] > 0}
    box = (11.0, 48.0, 12.0, 49.0)
    inside = {k: v for k, v in got.items() if box[0] <= k[0] <= box[2] and box[1] <= k[1] <= box[3]}
    assert {(r.lon, r.lat): r.value for r in raster.read_pixels(spark, str(tmp_path / "a.tif"), box).collect()} == inside != {}


def test_polygons_of_features(spark, tmp_path):
    square = lambda x: [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]
    features = [{"properties": {"adcode": 1, "name": "a"}, "geometry": {"type": "Polygon", "coordinates": square(0)}}, {"properties": {"adcode": 2, "name": "b"}, "geometry": {"type": "MultiPolygon", "coordinates": [square(3), square(5)]}}]
    (tmp_path / "f.json").write_text(json.dumps({"features": features}))
    polygons = spatial.feature_polygons(tables.read_features(spark, str(tmp_path / "f.json")))
    assert sorted((r.polygon_id, r.ordinal) for r in polygons.collect()) == [("1", 0), ("2", 0), ("2", 1)] and spatial.outline(polygons) == (0.0, 0.0, 6.0, 1.0)
    points = spark.createDataFrame([(1, 5.5, 0.5, 2.0), (2, 2.0, 0.5, 3.0)], "k int, lon double, lat double, value double")
    assert [(r.polygon_id, r.sum) for r in spatial.zonal_sum(points, polygons, ["k"], "value").collect()] == [("2", 2.0)]


def test_indicators_and_files(spark, tmp_path, monkeypatch):
    answers = {"NY.GDP": [{"date": "2001", "value": 10.0}, {"date": "2002", "value": None}], "SP.POP": [{"date": "2001", "value": 4.0}]}
    get = lambda url: json.dumps([{}, next(v for k, v in answers.items() if k in url)]).encode()
    rows = {r.year: r for r in web.read_indicators(spark, 2000, 2002, get).collect()}
    assert rows[2001].gdp_per_capita_lcu == 2.5 and rows[2000].gdp_current_lcu is None and len(rows) == 3
    with pytest.raises(RuntimeError, match="unexpected"):
        web.read_indicators(spark, 2000, 2001, lambda url: b"{}")
    waits = []

    def fails(*args, **kwargs):
        raise OSError("down")

    monkeypatch.setattr(web.urllib.request, "urlopen", fails)
    with pytest.raises(RuntimeError, match="down"):
        web.fetch("http://x", tries=3, wait=waits.append)
    assert waits == [2, 4]
    got = []
    for _ in range(2):
        web.fetch_once("http://x", str(tmp_path / "d/f.zip"), get=lambda u: got.append(u) or book([["a"]]))
    assert got == ["http://x"] and web.extract_first(str(tmp_path / "d/f.zip"), ".rels", str(tmp_path / "e")).name == "workbook.xml.rels"


def test_sinks_and_input_modes(spark, tmp_path):
    df = spark.createDataFrame([("甲", 1)], "`名` string, n int")
    sinks.write_csv(df, str(tmp_path / "c"), mark=True)
    assert next((tmp_path / "c").glob("*.csv")).read_bytes().startswith("﻿名".encode())
    assert tables.read_csv(spark, str(tmp_path / "c")).columns == ["名", "n"]
    assert sinks.markdown_table(spark.range(5), 3).endswith("The first 3 rows.")
    meta = sinks.run_metadata({"a": "b"}, {"x": df}, {"p": 1})
    assert meta == {"inputs": {"a": "b"}, "parameters": {"p": 1}, "outputs": {"x": {"rows": 1, "columns": 2}}}
    (tmp_path / "n").mkdir()
    (tmp_path / "n/2001_a.txt").write_text("一、撤销甲县。设立乙区。\n", encoding="utf-8")
    sents, lines = tables.read_sentences(spark, "source", str(tmp_path / "n"))
    assert sents.count() == 2 and lines.count() == 1
    sents.select("sentence_id", "source_file", "year", "line_no", "item_no", "sentence").write.option("header", True).csv(str(tmp_path / "s"))
    again, none = tables.read_sentences(spark, "csv", str(tmp_path / "s"), limit=1)
    assert again.first().sentence == "撤销甲县。" and none.count() == 0
    with pytest.raises(ValueError, match="input mode"):
        tables.read_sentences(spark, "other", "x")


def test_commands(spark, tmp_path):
    (tmp_path / "config.toml").write_text('[metrics.people]\nweight = 1.0\n')
    base = ["--config", str(tmp_path / "config.toml")]
    cli.main(["make-template", *base, "--output", str(tmp_path / "t.csv")])
    head = (tmp_path / "t.csv").read_text(encoding="utf-8-sig").strip().split(",")
    assert head[0] == "unit_id" and "source_people" in head
    rows = ["unit_id,unit_name,year,people,source_people"] + [f"u{u},n{u},{y},{100 + u * 10 + y - 2000},s" for u in range(3) for y in range(2000, 2006)]
    (tmp_path / "p.csv").write_text("\n".join(rows))
    cli.main(["run", *base, "--input", str(tmp_path / "p.csv"), "--output-dir", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out/panel")).count() == 18 and spark.read.parquet(str(tmp_path / "out/forecast")).count() == 15
    assert json.loads((tmp_path / "out/metadata.json").read_text())["outputs"]["panel"]["rows"] == 18
    (tmp_path / "bad.csv").write_text("unit_id,year,people\nu,2000,-1\n")
    with pytest.raises(SystemExit, match="negative"):
        cli.main(["validate", *base, "--input", str(tmp_path / "bad.csv")])
    cli.main(["nowcast-population", "--input", str(tmp_path / "p.csv"), "--output", str(tmp_path / "now"), "--source-year", "2005", "--target-year", "2026"])
    assert sorted({r.year for r in tables.read_csv(spark, str(tmp_path / "now")).collect()}) == ["2005", "2026"]
    (tmp_path / "r.tif").write_bytes(tiff(np.ones((4, 4), "f4"), x0=0.0, y0=2.0))
    ring = [[0, 0], [1, 0], [1, 2], [0, 2], [0, 0]]
    (tmp_path / "f.json").write_text(json.dumps({"features": [{"properties": {"adcode": 7, "name": "a"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    cli.main(["zonal-raster", "--units-geojson", str(tmp_path / "f.json"), "--raster", str(tmp_path / "r.tif"), "--output", str(tmp_path / "z"), "--metric", "people", "--source-id", "s", "--year", "2020"])
    row = tables.read_csv(spark, str(tmp_path / "z")).first()
    assert (row.unit_id, row.people, row.year) == ("7", "1.0", "2020")
    cli.main(["aggregate-ghsl", "--tif", str(tmp_path / "r.tif"), "--boundary-geojson", str(tmp_path / "f.json"), "--output", str(tmp_path / "g"), "--year", "2020", "--resolution", "1"])
    assert sum(float(r.population) for r in tables.read_csv(spark, str(tmp_path / "g")).collect()) == 8.0
