"""Upkeep of clusters after edits against full runs."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster, upkeep

ROWS = "id long, block string, name string, street string"
LINKS = [["name"], ["street"]]


def full(spark, rows):
    df = spark.createDataFrame(rows, ROWS)
    return df, cluster.connected_components(df, cluster.star_edges(df, "id", ["block"], LINKS), "id")


def groups(df):
    return {r.id: r.component for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_refreshed_components_equal_a_full_run(spark, seed):
    rng = random.Random(seed)
    made = lambda k: (k, rng.choice(["a", "b", "c", None]), rng.choice(["x", "y", "z", "u", "v", "", None]) and f"{rng.choice('xyzuvw')}{rng.randrange(8)}", rng.choice([None, "", f"s{rng.randrange(25)}"]))
    before = {k: made(k) for k in range(120)}
    after = dict(before)
    for k in rng.sample(range(120), 8):
        after[k] = made(k)
    for k in rng.sample(range(120), 4):
        after.pop(k, None)
    after |= {k: made(k) for k in range(200, 204)}
    changed = [(k,) for k in {*before, *after} if before.get(k) != after.get(k)]
    old, components = full(spark, list(before.values()))
    new, want = full(spark, list(after.values()))
    found, frontier = upkeep.refreshed_components(old, new, spark.createDataFrame(changed, "id long"), components, "id", ["block"], LINKS)
    want = groups(want)
    assert groups(found) == want and found.count() == len(after)
    # rows worked out anew: those of components that an edge or a row came to or left
    was, anew = groups(components), {r.id for r in frontier.collect()}
    assert {k for k in after if was.get(k) != want[k]} <= anew
    assert len(anew) < len(after)
    hit = {was[k] for (k,) in changed if k in was} | {want[k] for (k,) in changed if k in want}
    near = {b for k in hit for b in [after.get(k, before.get(k))[1]]} | {(after.get(k) or before[k])[1] for (k,) in changed} | {before[k][1] for (k,) in changed if k in before}
    assert {after[k][1] for k in anew} <= near


def test_split_and_merge(spark):
    before = [(1, "a", "x", None), (2, "a", "x", "s"), (3, "a", "y", "s"), (4, "a", "z", "t"), (5, "b", "x", "s")]
    after = [(1, "a", "x", None), (2, "a", "x", "q"), (3, "a", "y", "t"), (4, "a", "z", "t"), (5, "b", "x", "s")]
    old, components = full(spark, before)
    new, _ = full(spark, after)
    found, frontier = upkeep.refreshed_components(old, new, spark.createDataFrame([(2,), (3,)], "id long"), components, "id", ["block"], LINKS)
    assert groups(components) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert groups(found) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert {r.id for r in frontier.collect()} == {1, 2, 3, 4}
    same, none = upkeep.refreshed_components(old, old, spark.createDataFrame([], "id long"), components, "id", ["block"], LINKS)
    assert groups(same) == groups(components) and none.count() == 0


def test_edits_bring_everything_that_follows(spark):
    entries = spark.createDataFrame(
        [("p:0", "Bos", "Oude weg", "Oude weg lang", "1", None, None, None, "old", None), ("p:1", "Bos", "Brink", None, "2", 5.0, 5.0, "b1", "Bos Brink 2", None), ("p:2", "Vos", "Markt", None, "3", None, None, None, "Vos Markt 3", None)],
        "stable_id string, name string, address_street string, address_street_expanded string, address_number string, lat double, lng double, pand_id string, searchable_text string, edited_at timestamp",
    )
    block, links = ["name"], [["address_street"]]
    components = cluster.connected_components(entries, cluster.star_edges(entries, "stable_id", block, links), "stable_id")
    edits = spark.createDataFrame([("p:0", {"address_street": "Brink", "address_number": "4"})], "stable_id string, fields map<string,string>").withColumn("edited_at", F.current_timestamp()).withColumn("base", F.lit(None).cast("timestamp"))
    geocodes = spark.createDataFrame([("brink 4", 5.0001, 5.0001)], "address string, lat double, lng double")
    buildings = spark.createDataFrame([("b2", 5.0002, 5.0001), ("far", 9.0, 9.0)], "pand_id string, lat double, lng double")
    out = upkeep.save_edits(entries, edits, geocodes, buildings, components, "stable_id", ["name", "address_street", "address_number"], ["name", "address_street", "address_number"], block, links, ["name", "address_street"])
    row = {r.stable_id: r for r in out["entries"].collect()}
    assert (row["p:0"].address_street, row["p:0"].address_street_expanded, row["p:0"].pand_id, row["p:0"].searchable_text) == ("Brink", None, "b2", "Bos Brink 4")
    assert row["p:1"].pand_id == "b1" and row["p:2"].searchable_text == "Vos Markt 3"
    assert {r.stable_id: r.component for r in out["components"].collect()} == {"p:0": "p:0", "p:1": "p:0", "p:2": "p:2"}
    assert [(r.component, r.name, r.address_street, r.entry_count) for r in out["clusters"].collect()] == [("p:0", "Bos", "Brink", 2)]
    assert [r.stable_id for r in out["reindex"].collect()] == ["p:0"]


def test_an_unlink_that_empties_a_building_removes_it(spark):
    entries = spark.createDataFrame([(1, 7, "a"), (2, 8, "b"), (3, None, "c")], "id long, place long, guard string")
    links = spark.createDataFrame([(1, 7, None), (3, 9, "c"), (2, 9, "b"), (99, 9, "x")], "id long, place long, guard string")
    held = spark.createDataFrame([(7, 1), (8, 1)], "place long, entry_count long")
    fresh = spark.createDataFrame([(9, 0), (10, 0)], "place long, entry_count long")
    after, buildings, report = upkeep.merge_links(entries, links, held, fresh, "id", "place", "guard")
    assert {(r.id, r.place) for r in after.collect()} == {(1, None), (2, 8), (3, 9)}
    assert {tuple(r) for r in buildings.collect()} == {(8, 1), (9, 1)}
    assert tuple(report.first()) == (1, 1, 2, 1, 2, 1)
    empty = upkeep.merge_links(entries, links.limit(0), held, fresh, "id", "place", "guard")
    assert empty[0].count() == 3 and tuple(empty[2].first()) == (0, 0, 0, 0, 0, 0)
