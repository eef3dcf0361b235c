import json

import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster, corrections, flatten, linkage, ordered, quality, search
from quarry.sources import readers, writers
from quarry.sources.schemas import PAGE
from quarry.streaming.corrections import merge_stream, newest


def pages(spark, *docs):
    rows = spark.createDataFrame([(d.pop("stem"), json.dumps(d)) for d in docs], "stem string, j string")
    return rows.select("stem", F.from_json("j", PAGE).alias("p")).select("stem", "p.*")


def test_flatten_inherits_and_numbers(spark):
    found = flatten.flatten_pages(
        pages(
            spark,
            {"stem": "s", "section": "street_register", "streets": [{"street_name": "A", "street_name_expanded": "Aa", "entries": [{"name": "x"}, {"name": "y", "address_street": "B"}]}, {"street_name": "C", "entries": [{"name": "z"}]}]},
            {"stem": "t", "section": "other", "addresses_found": [{"address_street": None, "address_number": "5"}]},
            {"stem": "u", "section": "advertisement", "advertisements": [{"business_name": "Firm"}]},
            {"stem": "v", "section": "front_matter", "entries": [{"name": "no"}]},
        )
    )
    rows = {r.stable_id: (r.name, r.address_street, r.address_street_expanded, r.address_full) for r in found.collect()}
    assert rows == {"s:0": ("x", "A", "Aa", None), "s:1": ("y", "B", None, None), "s:2": ("z", "C", None, None), "t:0": ("Unknown", None, None, "5"), "u:0": ("Firm", None, None, None)}


@pytest.mark.parametrize(
    ("section", "kind", "role", "name", "want"),
    [
        ("institutional", "person", "R", "x", "institutional"),
        ("institutional", None, None, "x", "organization"),
        ("name_register", None, None, "Firma Smith", "organization"),
        ("name_register", "person", None, "Firma Smith", "person"),
        ("advertisement", "person", None, "x", "advertisement"),
        ("other", None, None, "x", "text"),
        (None, None, None, None, "person"),
    ],
)
def test_entry_kind(spark, section, kind, role, name, want):
    row = spark.createDataFrame([(section, kind, role, name)], "a string, b string, c string, d string")
    assert row.select(flatten.entry_kind(*map(F.col, "abcd")).alias("k")).first()["k"] == want


def test_override_overwrites_present_nulls_only(spark):
    rows = spark.createDataFrame([(k, "old", "o") for k in "abcd"], "id string, x string, y string")
    held = spark.createDataFrame([("a", {"x": None}), ("b", {"x": "new"}), ("c", {})], "id string, fields map<string,string>")
    found = {r.id: (r.x, r.y, r.edited) for r in corrections.apply_overrides(rows, held, "id", ["x", "y"]).collect()}
    assert found == {"a": (None, "o", True), "b": ("new", "o", True), "c": ("old", "o", False), "d": ("old", "o", False)}


def test_last_writer_wins(spark):
    edits = spark.createDataFrame([("a", "2024-01-01T00:00:00Z", 2, "p"), ("a", "2024-01-01T00:00:00Z", 1, "q"), ("b", "bad", 1, "r"), ("b", "1999-01-01T00:00:00Z", 2, "s")], "id string, at string, source int, v string")
    found = corrections.last_writer_wins(edits, "id", corrections.moment(F.col("at")), "source")
    assert {r.id: r.v for r in found.collect()} == {"a": "q", "b": "s"}


def test_merge_stream_keeps_the_latest(spark, tmp_path):
    edits = spark.createDataFrame([(1, "2024-01-01", 1, "a"), (1, "2024-01-02", 2, "b"), (2, "2024-01-01", 3, "c")], "id int, at string, source int, v string")
    edits.write.parquet(str(tmp_path / "in"))
    stream = lambda: merge_stream(spark.readStream.schema(edits.schema).parquet(str(tmp_path / "in")), str(tmp_path / "table"), "id", "at", "source", str(tmp_path / "checkpoint")).awaitTermination()
    stream()
    spark.createDataFrame([(2, "2024-01-05", 4, "d"), (1, "2023-01-01", 5, "e")], edits.schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream()
    assert {r.id: r.v for r in newest(edits, str(tmp_path / "table")).collect()} == {1: "b", 2: "d"}


def test_tiers_follow_alias_then_tier(spark):
    index = spark.createDataFrame([("a st", 5, "b", "P1"), ("b st", 5, "", "P2"), ("a st", 7, "", "P3"), ("b st", 9, "a", "P4")], "street string, number int, letter string, place_id string")
    probes = spark.createDataFrame([(1, ["a st", "b st"], 5, ""), (2, ["b st", "a st"], 5, "z"), (3, ["a st"], 9, ""), (4, ["x"], 5, "")], "id int, aliases array<string>, number int, letter string")
    found = {r.id: (r.place_id, r.alias_rank) for r in linkage.tiered_match(probes, index, "id").collect()}
    assert found == {1: ("P1", 0), 2: ("P2", 0), 3: ("P3", 0)}


def test_components_of_chains_and_cycles(spark):
    nodes = spark.range(10).withColumnRenamed("id", "n")
    edges = spark.createDataFrame([(1, 2), (3, 2), (3, 4), (4, 1), (6, 5), (5, 5)], "a long, b long")
    found = {r.n: r.component for r in cluster.connected_components(nodes, edges, "n").collect()}
    assert found == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}


def test_canonical_values(spark):
    rows = spark.createDataFrame([(1, "p", "ab", None), (2, "p", "cd", "x"), (3, "p", None, "y"), (4, "q", "", None)], "i int, c string, t string, f string")
    found = {r.c: (r.t, r.f, r.entry_count) for r in cluster.canonical_values(rows, "c", "i", ["t"], ["f"]).collect()}
    assert found == {"p": ("ab", "x", 3), "q": (None, None, 1)}


def test_cascade_sees_only_what_is_left(spark):
    rows = spark.range(6)
    even = lambda left, _: left.where("id % 2 = 0").selectExpr("id", "'e' as place_id")
    rest = lambda left, placed: left.where(F.col("id") > placed.count()).selectExpr("id", "'r' as place_id")
    found = {r.id: r.rule for r in linkage.cascade(rows, "id", [("even", even), ("rest", rest)]).collect()}
    assert found == {0: "even", 2: "even", 4: "even", 5: "rest"}


def test_search_of_nothing(spark):
    index = search.build_index(spark.createDataFrame([(1, "abc")], "id long, t string"), "id", ["t"])
    assert search.rank_rows(*index, "? a").collect() == []
    assert search.rank_rows(*index, "ab zz").collect() == []


def test_rollup_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "s string, p string")
    found = quality.review_rollup(empty, "s", "p", F.lit(True), F.lit(False), F.lit(False)).collect()
    assert [r.grain for r in found] in ([], ["overall"])


def test_anchor_ahead_only_when_near(spark):
    rows = spark.createDataFrame([("p", k, "A" if k == 7 else None) for k in range(8)], "p string, i int, a string")
    found = {r.i: r.inferred for r in ordered.nearest_anchor(rows, "p", ["i"], F.col("a")).collect()}
    assert found[1] is None and found[2] == "A" and found[7] is None


def test_feature_collection_and_errors(spark):
    rows = spark.createDataFrame([("p", '{"type":"Point","coordinates":[6.1,53.1]}', None)], "id string, geometry string, year int")
    found = writers.feature_collection(rows, "geometry", ["id", "year"], "id").first()
    assert found.json == '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[6.1,53.1]},"properties":{"id":"p","year":null}}]}'
    with pytest.raises(Exception, match="invalid geometry of p"):
        writers.feature_collection(rows.withColumn("geometry", F.lit("no")), "geometry", ["id"], "id").collect()


def test_readers(spark, tmp_path):
    (tmp_path / "ov").mkdir()
    (tmp_path / "ov" / "s.json").write_text(json.dumps({"s:0": {"fields": {"name": None}, "edited_at": "2024"}, "t:1": {"fields": {}}}))
    (tmp_path / "ov" / "bad.json").write_text("{")
    found = readers.read_overrides(spark, str(tmp_path / "ov")).collect()
    assert [(r.stable_id, r.fields) for r in found] == [("s:0", {"name": None})]
    (tmp_path / "m.json").write_text(json.dumps({"_summary": {"n": 1}, "P": {"addresses": {"a": {"entries": ["s:0"], "approx": True}}}}))
    assert [tuple(r) for r in readers.read_matches(spark, str(tmp_path / "m.json")).collect()] == [("s:0", "P", True)]
    square = '{"type":"MultiPolygon","coordinates":[[[[0,0],[2,0],[2,4],[0,0]]]]}'
    (tmp_path / "f.json").write_text('{"features":[{"properties":{"id":"P"},"geometry":' + square + "}]}")
    row = readers.read_features(spark, str(tmp_path / "f.json"), "id: string").first()
    assert (row.id, row.west, row.north, row.mid_x) == ("P", 0.0, 4.0, 1.0)
    (tmp_path / "s.ocr.json").write_text(json.dumps({"schema_version": 2, "blocks": [{"id": "b", "lines": [{"id": "l", "words": [{"id": "w1", "text": "a<b", "bbox": [0, 0, 2, 3]}, {"id": "w2", "text": "c", "bbox": [3, 0, 4, 3]}]}]}]}))
    words = readers.ocr_words(readers.read_ocr(spark, str(tmp_path / "s.ocr.json")))
    assert readers.page_text(words).first().full_text == "a<b c"
    entries = spark.createDataFrame([("s", 0, ["w1"]), ("s", 3, ["w1"])], "stem string, entry_index int, word_ids array<string>")
    alto = writers.alto_pages(words, entries).first().alto
    assert 'CONTENT="a&lt;b" HPOS="0" VPOS="0" WIDTH="2" HEIGHT="3" TAGREFS="entry_0003"' in alto and alto.count("TAGREFS") == 1


def test_stream_rewrites_touched_buckets_only(spark, tmp_path):
    from pyspark.sql import functions as F

    from quarry.streaming.corrections import merge_stream, newest

    schema = "k long, at timestamp, source string, v string"
    told = lambda rows: spark.createDataFrame(rows, "k long, t string, source string, v string").select("k", F.col("t").cast("timestamp").alias("at"), "source", "v")
    first = told([(k, "2024-01-01", "a", f"old{k}") for k in range(200)])
    for n, rows in enumerate((first, told([(3, "2024-01-02", "b", "new"), (3, "2024-01-02", "a", "tie"), (4, "2023-01-01", "b", "late")]), told([(3, "2024-01-03", "b", "newest")]))):
        rows.write.mode("append").parquet(str(tmp_path / "in"))
        edits = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        merge_stream(edits, str(tmp_path / "out"), "k", "at", "source", str(tmp_path / "ck")).awaitTermination()
        found = {r.k: r.v for r in newest(first, str(tmp_path / "out")).collect()}
        assert len(found) == 200 and found[3] == ("old3", "tie", "newest")[n] and found[4] == "old4"
    assert len([p for p in (tmp_path / "out" / "batch=2").iterdir() if p.name.startswith("bucket=")]) == 1


def test_readers_of_logs_ids_and_matches(spark, tmp_path):
    from quarry.sources import readers

    (tmp_path / "a.json").write_text('{"model": "m", "units": 3}')
    (tmp_path / "b.json").write_text("{broken")
    assert [tuple(r) for r in readers.read_logs(spark, str(tmp_path / "*.json"), "model string, units long").collect()] == [("m", 3, "a")]
    (tmp_path / "ids.txt").write_text("p1\n\n# no\n p2 \np1\n")
    assert sorted(r.stem for r in readers.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["p1", "p2"]
    (tmp_path / "m.map").write_text('{"z": {"addresses": {"a 1": {"entries": ["s:0", "s:1"]}}}, "_summary": {}, "b": {"addresses": {"a 2": {"entries": ["s:1"], "approx": true}}}}')
    assert sorted(map(tuple, readers.read_matches(spark, str(tmp_path / "m.map")).collect())) == [("s:0", "z", False), ("s:1", "b", True)]


def test_similar_streets(spark):
    from pyspark.sql import functions as F

    from quarry.functions import streets

    rows = spark.createDataFrame([("Groote Markt", "Grote Markt"), ("Zandweg", "Havenkade"), ("", "x"), ("Heerestraat", "Heerestr.")], "a string, b string")
    assert [r[0] for r in rows.select(streets.same_street(F.col("a"), F.col("b"))).collect()] == [True, False, False, True]


def test_corrections_of_entries(spark):
    from quarry.operators import flatten, store
    from quarry.sources.schemas import OVERRIDE, PAGE

    pages = spark.createDataFrame([("p", '{"section": "name_register", "entries": [{"name": "A", "address_street": "S", "address_number": "1", "address_full": "S 1"}, {"name": "B"}]}')], "stem string, j string")
    from pyspark.sql import functions as F

    rows = flatten.flatten_pages(pages.select("stem", F.from_json("j", PAGE).alias("p")).select("stem", "p.*")).withColumn("searchable_text", F.lit("old"))
    rows = rows.withColumns({f"flag_{f}": F.lit(True) for f in store.FLAGS})
    edit = '{"fields": {"address_number": null, "name": "C"}, "flags": {"verified": false}, "bbox": {"value": [1, 2, 3, 4]}}'
    over = spark.createDataFrame([("p:0", edit)], "stable_id string, j string").select("stable_id", F.from_json("j", OVERRIDE).alias("o")).select("stable_id", "o.*")
    a, b = store.apply_corrections(rows, over).orderBy("stable_id").collect()
    assert (a.name, a.address_number, a.address_full, a.flag_verified, a.flag_needs_review, a.entry_bbox, a.searchable_text) == ("C", None, "S", False, True, [1, 2, 3, 4], "C S")
    assert (b.name, b.flag_verified, b.searchable_text) == ("B", True, "old")


def test_corrections_ask_for_every_row_of_the_queue(spark):
    from quarry.plans import queries

    sf_dir = "/root/testdata/sf0.01"
    want = {r.s_suppkey for r in spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_nationkey >= 10 and s_acctbal >= 0 and s_suppkey % 2 = 1").collect()}
    assert any(k % 5 == 0 for k in want) and any(k % 7 == 0 for k in want)
    assert {r.s_suppkey for r in queries.QUERIES["number_corrections"](spark, sf_dir).collect()} == want


def test_queue_needs_box_and_street(spark):
    from quarry.operators import review

    rows = spark.createDataFrame([(1, "123", "a", [1]), (2, "123", "", [1]), (3, "123", "a", []), (4, "123", None, None), (5, "12", "a", [1])], "id long, number string, street string, box array<int>")
    assert [r.id for r in review.suspicious_numbers(rows, "number", F.lit(False), F.lit(None).cast("boolean"), present=["box", "street"]).collect()] == [1]


def test_unique_owners_asks_for_every_street(spark):
    from quarry.plans import queries

    part = spark.read.parquet("/root/testdata/sf0.01/part.parquet").select("p_brand", "p_name", "p_size").distinct().collect()
    supplier = [r.s_suppkey for r in spark.read.parquet("/root/testdata/sf0.01/supplier.parquet").collect()]
    held = {}
    for r in part:
        held.setdefault((r.p_brand, r.p_name), set()).add(r.p_size)
    want = sorted((s, *sizes) for s in supplier for (brand, _), sizes in held.items() if brand == f"Brand#{s % 50}" and len(sizes) == 1)
    assert len(want) > len(supplier)
    assert sorted(tuple(r) for r in queries.QUERIES["unique_owners"](spark, "/root/testdata/sf0.01").collect()) == want


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_copies_of_boxes_and_points_meet_once(spark):
    boxes = spark.range(40).selectExpr("id AS box_id", "(id % 2) * 20 AS x1", "0L AS y1", "(id % 2) * 20 + 15 AS x2", "15L AS y2")
    points = spark.createDataFrame([*((k, 25.0, 5.0) for k in range(30)), (90, None, 1.0), (91, 17.0, 1.0)], "id long, x double, y double")
    for last, want in ((False, 1), (True, 39)):
        found = ordered.first_hit(points, boxes, "id", "box_id", 10.0, last)
        assert {(r.id, r.box_id) for r in found.collect()} == {(k, want) for k in range(30)}
    meeting = next(part for part in _plan(found).split("Join Inner") if "cx" in part.split("\n")[0])
    assert meeting.count("Aggregate [x") >= 2  # both sides are made distinct before they meet


def test_candidates_meet_one_person_a_link(spark):
    from quarry.operators import review

    persons = spark.range(60).selectExpr("id + 5 AS person_id", "'n' AS name", "if(id < 50, id % 3, NULL) AS seg")
    asked = spark.range(4).selectExpr("id AS ask_id", "'n' AS name", "id AS seg")
    found = review.candidate_persons(asked, persons, [["name", "seg"]])
    assert {tuple(r) for r in found.collect()} == {(0, 5), (1, 6), (2, 7)}
    assert "Aggregate" in _plan(found).split("Join Inner")[1]  # persons of one link are one before the join


def test_an_address_is_read_once(spark):
    from quarry.operators import store

    entries = spark.createDataFrame([(k, "Large ring 7B", 1.0, 1.0) for k in range(20)] + [(30, "no number", 1.0, 1.0), (31, "Large ring 7", None, 1.0), (32, "Far road 9", 2.0, 1.0)], "stable_id long, address string, lat double, lng double")
    index = spark.createDataFrame([("large ring", 7, "", 5)], "street string, number int, letter string, place_id long")
    out = store.link_book(entries, index, [("^large ", "l ")], [("ing", "yng")])
    assert {(r.stable_id, r.pand_id, r.address) for r in out["matches"].collect()} == {(k, 5, "large ring 7b") for k in range(20)}
    assert [(r.total, r.matched) for r in out["summary"].collect()] == [(21, 20)]
    assert [r.stable_id for r in out["unmatched"].collect()] == [32]
    # no filter works out addresses or aliases where rows are still all entries
    assert not [line for line in _plan(out["matches"]).split("\n") if "Filter" in line and "lambda" in line]
