"""Page trees against plain loops, and readers and writers against files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import trees
from quarry.sources import readers, writers
from quarry.sources.schemas import OCR


def half_even(v):
    return round(v)


def laid_out(line):
    """The words of a line, with shares of it where half of the boxes are alike to the nearest ten."""
    words = [dict(w) for w in line["words"]]
    tens = [tuple(10 * half_even(v / 10) for v in w["bbox"]) for w in words]
    if len(words) < 2 or 2 * sum(tens.count(t) > 1 for t in tens) < len(words):
        return words
    widths = [max(1, len(w["text"])) for w in words]
    whole, left = sum(widths) + len(words) - 1, line["bbox"][0]
    span = max(1, line["bbox"][2] - left)
    top, low, at = min(w["bbox"][1] for w in words), max(w["bbox"][3] for w in words), 0
    for w, n in zip(words, widths, strict=True):
        w["bbox"] = [left + int(at / whole * span), top, left + int((at + n) / whole * span), low]
        at += n + 1
    return words


def plain_repair(page):
    blocks = [{**b, "lines": [{**x, "words": laid_out(x)} for x in b["lines"]]} for b in page["blocks"]]
    lines = [x for b in blocks for x in b["lines"]]
    mids = [(x["bbox"][0] + x["bbox"][2]) / 2 for x in lines]
    gap = None
    if len(lines) >= 6:
        order = sorted(mids)
        wide, k = max((b - a, -k) for k, (a, b) in enumerate(zip(order, order[1:], strict=False)))
        mid = (order[-k] + order[-k + 1]) / 2
        left = sum(m < mid for m in mids)
        if wide >= 0.08 * page["width"] and 0.3 * page["width"] <= mid <= 0.7 * page["width"] and min(left, len(mids) - left) >= max(3, 0.15 * len(mids)):
            gap = mid
    if gap is None:
        return blocks
    ranked = [x for _, _, _, x in sorted(((m >= gap, x["bbox"][1], k, x) for k, (x, m) in enumerate(zip(lines, mids, strict=True))), key=lambda t: t[:3])]
    out, n = [], 0
    for k, x in enumerate(ranked):
        name, words = f"line_{k + 1:04d}", []
        for w in x["words"]:
            n += 1
            words.append({**w, "id": f"w_{n:04d}", "line_id": name})
        if k % 50 == 0:
            out.append([])
        out[-1].append({"id": name, "bbox": x["bbox"], "words": words})
    box = lambda own: [f(x["bbox"][k] for x in own) for k, f in enumerate((min, min, max, max))]
    return [{"id": f"block_{k + 1}", "bbox": box(own), "lines": own} for k, own in enumerate(out)]


def made_page(rng, k):
    columns, blocks = rng.choice([1, 2, 2]), []
    for b in range(rng.randrange(0, 4)):
        lines = []
        for x in range(rng.choice([0, 2, 5, 40])):
            left = rng.randrange(0, 60) + (520 * rng.randrange(2) if columns == 2 else 200)
            box = [left, rng.randrange(0, 900), left + rng.randrange(1, 380), 0]
            box[3] = box[1] + 20
            alike = rng.random() < 0.5
            words = [{"id": f"x{j}", "text": rng.choice(["", "a", "een", "straatweg"]), "bbox": box[:] if alike else [rng.randrange(0, 900), box[1] + rng.randrange(4), rng.randrange(0, 900), box[3] + j], "confidence": 1, "line_id": "q"} for j in range(rng.randrange(0, 5))]
            lines.append({"id": f"l{b}_{x}", "bbox": box, "words": words})
        blocks.append({"id": f"b{b}", "bbox": [0, 0, 1, 1], "lines": lines})
    return {"scan_file": f"p{k}", "width": 1000, "height": 1000, "schema_version": 2, "blocks": blocks}


def plain(row):
    return json.loads(json.dumps(row.asDict(recursive=True)))["blocks"]


def test_repair_equals_a_loop_over_pages(spark, tmp_path):
    rng = random.Random(3)
    pages = {f"p{k}": made_page(rng, k) for k in range(60)}
    for name, p in pages.items():
        (tmp_path / f"{name}.ocr.json").write_text(json.dumps(p))
    (tmp_path / "old.ocr.json").write_text(json.dumps({**pages["p1"], "schema_version": 1}))
    (tmp_path / "bad.ocr.json").write_text("{")
    found = {r.stem: plain(r) for r in readers.read_ocr(spark, str(tmp_path)).collect()}
    assert set(found) == set(pages)
    moved = 0
    for name, p in pages.items():
        want = plain_repair(p)
        assert found[name] == want, name
        moved += bool(want) and want[0]["id"] == "block_1"
    assert 10 < moved < 60
    plan = trees.repaired(spark.createDataFrame([], OCR))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def built(rows, image):
    """A tree from level codes, page by page, with a stack."""
    scale, blocks, n, lines = image[0] / next(r[7] for r in rows if r[2] == 1), [], 0, 0
    box = lambda r: [round(r[5] * scale), round(r[6] * scale), round((r[5] + r[7]) * scale), round((r[6] + r[8]) * scale)]
    for r in rows:
        if r[2] == 3:
            blocks.append({"id": f"b_{len(blocks):03d}", "bbox": box(r), "lines": []})
        elif r[2] == 4:
            own = blocks[-1]["lines"]
            own.append({"id": f"l_{len(blocks) - 1:03d}_{len(own):03d}", "bbox": box(r), "words": []})
        elif r[2] == 5 and r[4].strip():
            n += 1
            line = blocks[-1]["lines"][-1]
            line["words"].append({"id": f"w_{n:04d}", "text": r[4].strip(), "bbox": box(r), "confidence": 50, "line_id": line["id"]})
    blocks = [{**b, "lines": [x for x in b["lines"] if x["words"]]} for b in blocks]
    return [b for b in blocks if b["lines"]]


def test_tree_from_level_codes(spark, tmp_path):
    rng = random.Random(9)
    rows, at = [], 0
    for page in (1, 2, 3):
        put = lambda level, text="": rows.append((page, len(rows), level, page, text, *[rng.randrange(0, 4000) / 8 for _ in range(4)]))  # noqa: B023, E731
        put(1)
        for _ in range(rng.randrange(2, 6)):
            put(3)
            for _ in range(rng.randrange(0, 4)):
                put(4)
                for _ in range(rng.randrange(0, 5)):
                    put(5, rng.choice(["", " ", "wo\"ord ", "x"]))
    lines = ["level\tpage_num\tpar_num\tblock_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"]
    lines += [f"{r[2]}\t{r[0]}\t0\t0\t0\t0\t{r[5]}\t{r[6]}\t{r[7]}\t{r[8]}\t-1\t{r[4]}" for r in rows]
    (tmp_path / "book.json").write_text("\n".join(lines) + "\n")
    read = readers.read_levels(spark, str(tmp_path / "book.json"))
    assert read.where("level = 5").count() == sum(r[2] == 5 for r in rows)
    images = spark.createDataFrame([(p, 1000 + p, 1500) for p in (1, 2, 3)], "page int, width int, height int")
    found = {r.page: plain(r) for r in trees.from_levels(read, images).collect()}
    for page in (1, 2, 3):
        assert found[page] == built([r for r in rows if r[0] == page], (1000 + page, 1500))
        at += len(found[page])
    assert at > 3 and trees.from_levels(read.limit(0), images).count() == 0


def test_readers_of_pages_caches_and_lists(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "pages" / "a_0003.json").write_text(json.dumps({"page_number": 3, "scan_file": "a_0003.jpg", "entries": [{"name": "Bos"}]}))
    (tmp_path / "pages" / "b.json").write_text("{ not json")
    pages = readers.read_pages(spark, str(tmp_path / "pages"))
    assert {(r.stem, r.page_number, r.entries and r.entries[0].name) for r in pages.collect()} == {("a_0003", 3, "Bos"), ("b", None, None)}
    assert [r.stem for r in readers.stems(pages).collect()] == ["a_0003", "b"]
    (tmp_path / "geo.json").write_text(json.dumps({"brink 1": {"status": "ok", "lat": 53.2, "lng": 6.5, "flags": ["x"]}, "weg 2": {"status": "none"}}))
    assert {(r.address, r.status, r.lat) for r in readers.read_geocodes(spark, str(tmp_path / "geo.json")).collect()} == {("brink 1", "ok", 53.2), ("weg 2", "none", None)}
    (tmp_path / "d.csv").write_text('a,b\n1,"x, y"\n2\n3,z,too many\n')
    told = readers.read_delimited(spark, str(tmp_path / "d.csv"), ["a", "b"]).cache()
    assert {(r.a, r.b, r._bad) for r in told.collect()} == {("1", "x, y", None), ("2", None, "2"), ("3", "z", "3,z,too many")}
    (tmp_path / "scans").mkdir()
    for name in ("s_0007.jpg", "s_0008.PNG", "notes.txt"):
        (tmp_path / "scans" / name).write_bytes(b"x")
    assert {(r.stem, r.page_number) for r in readers.discover_scans(spark, str(tmp_path / "scans")).collect()} == {("s_0007", 7), ("s_0008", 8)}
    houses = spark.createDataFrame([([("Brink",), ("Brink",), (None,), ("",)],), ([("Weg",)],)], "addresses array<struct<openbare_ruimte: string>>")
    assert {r.street for r in readers.canonical_streets(houses).collect()} == {"Brink", "Weg"}


def test_writers_of_indexes_stores_and_snapshots(spark, tmp_path):
    entries = spark.createDataFrame(
        [("s:1", "s", "Bos", "Brink 1", None, "Brink", [("see", 4, None, None)], "2024", False, None), ("s:0", "s", "Vos", "brink 1", "Lange Weg", "Weg", [], None, False, True), ("s:2", "s", None, "", None, None, None, None, False, False)],
        "stable_id string, stem string, name string, address_full string, address_street_expanded string, address_street string, cross_references array<struct<type: string, page: int, text: string, page_number: int>>, edited_at string, flag_verified boolean, flag_needs_review boolean",
    )
    pages = spark.createDataFrame([("s", "s.jpg", 1, None, (10, 20))], "stem string, scan_file string, page_number int, section string, dimensions struct<width: int, height: int>")
    found = writers.combined_indexes(entries, pages)
    assert {(r.key, tuple(e.id for e in r.entries)) for r in found["address"].collect()} == {("brink 1", ("entry_s:0", "entry_s:1"))}
    assert {r.key for r in found["street"].collect()} == {"brink", "lange weg"}
    assert [tuple(r) for r in found["cross_reference"].collect()] == [("entry_s:1", "s", "see", 4)] and found["manifest"].first().section == "unknown"
    writers.write_indexes(found, str(tmp_path / "idx"))
    assert spark.read.json(str(tmp_path / "idx" / "search_index")).count() == 3
    writers.write_store({"entries": entries.withColumn("section", F.lit("names")), "pages": pages}, str(tmp_path / "store"))
    assert (tmp_path / "store" / "entries" / "section=names").is_dir() and spark.read.parquet(str(tmp_path / "store" / "pages")).count() == 1
    writers.write_snapshot(entries, str(tmp_path / "snap"))
    assert {r.stable_id for r in spark.read.json(str(tmp_path / "snap")).collect()} == {"s:0", "s:1"}
    writers.write_delimited(entries.select("stable_id", "name"), str(tmp_path / "csv"), ";")
    read = readers.read_delimited(spark, str(tmp_path / "csv"), ["stable_id", "name"], ";")
    assert {(r.stable_id, r.name) for r in read.cache().collect()} == {("s:0", "Vos"), ("s:1", "Bos"), ("s:2", None)}


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_gestalt_pairs_equal_all_pairs(spark, least):
    import difflib

    from quarry.operators import linkage

    rng = random.Random(5)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(90)}) + ["", None, "jansen", "janssen", "janse", "jansens"]
    a, b = words[::2] + ["jansen"], words[1::2] + ["jansen"]
    pages = lambda own: spark.createDataFrame([(k % 2, w) for k, w in enumerate(own)], "page int, name string")
    like = lambda p, q: p == q or (p[:2] == q[:2] and difflib.SequenceMatcher(None, p, q).ratio() > least)
    want = {(i % 2, p, q) for i, p in enumerate(a) for j, q in enumerate(b) if p and q and i % 2 == j % 2 and like(p, q)}
    assert {(r.page, r["name"], r.other) for r in linkage.gestalt_pairs(pages(a), pages(b), "name", ["page"], 2, least).collect()} == want
    alone = {(s, k % 2, w) for s, own, others, turn in (("left", a, b, False), ("right", b, a, True)) for k, w in enumerate(own) if w and not any(q and j % 2 == k % 2 and like(w, q) for j, q in enumerate(others))}
    assert {(r.side, r.page, r["name"]) for r in linkage.two_sided_anti(pages(a), pages(b), "name", ["page"], 2, least).collect()} == alone
