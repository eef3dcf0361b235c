"""Chat formatting, packing and WARC."""

import gzip
import hashlib
import io
import json
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import chat_format, packing, warc
from quarry.llm.common import shared_dir

from .conftest import ODD


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_conversations_round_trip(spark):
    rows = [
        (1, 1, "assistant", "</s>[INST] ok [/INST] \\ \\[INST]"),
        (1, 0, "user", "<s>[/INST]\n\n</s>"),
        (2, 0, None, None),
        (2, 0, None, None),
        (3, 5, "sys\ntem</s>", "a\\"),
        (3, 4, "assistant", ""),
        (None, 0, "user", "x" * 20_000),
        (3, 6, "assistant", "ends with \\"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    found = {r.conv_id: r for r in chat_format.digest_conversations(df).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert found[conv].n_turns == len(turns)
        assert found[conv].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        learnt = "".join(x for _, r, x in turns if r == "assistant")
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(learnt), sha(learnt))
    assert chat_format.digest_conversations(df.limit(0)).count() == 0


def test_no_control_string_survives_inside_texts(spark):
    df = spark.createDataFrame([("<s></s>[INST][/INST]<</s>s>",)], "t string")
    told = df.select(chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).first()
    assert not any(c in told.e for c in chat_format.CONTROLS)
    assert told.u == "<s></s>[INST][/INST]<</s>s>"


@pytest.mark.parametrize(
    ("record", "layout", "turns"),
    [
        ({"prompt": "p", "response": "r"}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"instruction": "i", "input": "", "output": "o", "id": 7}, "instruction_input_output", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "n", "output": "o"}, "instruction_input_output", [("user", "i\n\nn"), ("assistant", "o")]),
        ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]}, "messages", [("system", "s"), ("user", "u")]),
        ({"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}]}, "from_value", [("user", "h"), ("assistant", "g")]),
        ({"unknown": 1}, None, None),
        ({"prompt": "p", "response": "r", "text": "t", "messages": [{"role": "user"}]}, "prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"messages": [], "meta": {"deep": {"er": [[{"x": 1}]]}}}, "messages", []),
        ({"messages": [{"role": "user", "content": "u", "tool": {"name": "n"}}, {"weight": 1}]}, "messages", [("user", "u"), (None, None)]),
        ({"prompt": {"response": 1}, "response": "r"}, None, None),
        ({"prompt": None, "response": "r"}, "prompt_response", [("user", None), ("assistant", "r")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "system_prompt_response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"system": "", "prompt": "p", "response": "r"}, "system_prompt_response", [("user", "p"), ("assistant", "r")]),
        ({"system": "s", "instruction": "i", "input": "n", "output": "o"}, "system_instruction_input_output", [("system", "s"), ("user", "i\n\nn"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o", "history": [["a", "b"], ["c"]]}, "instruction_history", [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", None), ("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "", "output": "o", "history": []}, "instruction_history", [("user", "i"), ("assistant", "o")]),
        ({"system": "s", "conversations": [{"from": "human", "value": "h"}]}, "system_from_value", [("system", "s"), ("user", "h")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}, {"role": "assistant", "content": "plain"}]}, "content_parts", [("user", "ab"), ("assistant", "plain")]),
        ({"data": {"messages": [{"role": "user", "content": "u"}]}, "id": 1}, "data_messages", [("user", "u")]),
    ],
)
def test_layouts_by_fingerprint(spark, record, layout, turns):
    row = chat_format.turns_of_records(spark.createDataFrame([(json.dumps(record),)], "record string")).first()
    assert row.layout == layout
    assert (row.turns and [tuple(t) for t in row.turns]) == turns


def test_tables_are_read_by_the_columns_they_hold(spark):
    rows = [(1, 0, "user", "u", "c", "a", 5, 6), (1, 1, "assistant", "v", "c", "a", 5, 6)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string, author string, position long, thread_id long")
    for extra in (["content"], ["content", "author"], ["content", "author", "position"], ["content", "author", "position", "thread_id"]):
        out = chat_format.turns_of_rows(df.select("conv_id", "turn", "role", "text", *extra)).collect()
        assert [(r.conv_id, [tuple(t) for t in r.turns]) for r in out] == [(1, [("user", "u"), ("assistant", "v")])]
    assert [r.conv_id for r in chat_format.turns_of_rows(df.drop("turn")).collect()] == [6]
    with pytest.raises(ValueError, match="no row layout"):
        chat_format.turns_of_rows(df.select("conv_id", "role"))


def test_long_conversations_read_back(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"t{k} </s>") for k in range(20_000)]
    out = chat_format.digest_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert out.n_turns == 20_000 and out.loss_sha256 == sha("".join(r[3] for r in rows if r[1] % 2))


@pytest.mark.parametrize("record", ["no json", "[1]", "5", "null", "{", "[" * 100_000, None])
def test_what_is_no_record_has_no_layout(record):
    assert chat_format.record_layout(record, chat_format.Registry({"pair": ("prompt", "response")})) is None


def test_a_schema_is_fitted_once():
    registry = chat_format.Registry({m.name: m.paths for m in chat_format.MAPPINGS})
    assert chat_format.record_layout('{"prompt": "a", "response": "b"}', registry) == "prompt_response" and registry.fitted == 0
    for k in range(50):
        assert chat_format.record_layout(json.dumps({"prompt": "a", "response": k, "meta": {"n": [k]}}), registry) == "prompt_response"
        assert chat_format.record_layout(json.dumps({"other": k}), registry) is None
    assert registry.fitted == 2


def ids_of(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    whole.encode_special_tokens = True
    return [*whole.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 1'\n\t\x1c\x85é½²中.!<|>endoftxs"), max_size=60))
def test_encoding_equals_the_tokenizer(text):
    assert packing.encode_text(text, packing.tokenizer_path()) == np.array(ids_of(text), "<u4").tobytes()


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "a" + " " * 1_000_000 + "b", "\n" * 1_000_000])
def test_added_tokens_and_long_white_space_are_encoded_as_by_the_tokenizer(text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(packing.tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert packing.encode_text(text, packing.tokenizer_path()) == np.array([*ids, 0], "<u4").tobytes()


def check_packing(rows, texts, capacity):
    by_place, pieces = {}, {}
    for r in rows:
        by_place.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for places in by_place.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    want = {}
    for doc, text in texts:
        want.setdefault(doc, []).append(ids_of(text))
    for doc, copies in want.items():
        ids = copies[0]
        first = len(ids) % capacity or capacity
        cuts = [(0, first), *((k, k + capacity) for k in range(first, len(ids), capacity))]
        told = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[doc])
        assert told == sorted((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(cuts) for _ in copies)


def test_packing_of_odd_rows(odd, docs_of):
    check_packing(packing.pack(odd).collect(), ODD, 2048)
    small = [(k, "a b c " * (k % 17)) for k in range(300)]
    rows = packing.pack(docs_of(small), capacity=64).collect()
    check_packing(rows, small, 64)
    assert len({r.sequence_id for r in rows}) <= 1.03 * sum(r.length for r in rows) / 64 + 2
    assert packing.pack(odd.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 30)), max_size=20))
def test_plans_are_whole(lengths):
    counts = np.zeros(41, int)
    for k, n in lengths:
        counts[k] += n
    plan = packing.plan_packing(counts, 40, 4)
    used, fill = {}, {}
    for length, rank, n, sequence, offset in sorted(plan.runs):
        assert used.get(length, 0) == rank
        used[length] = rank + n
        for k in range(n):
            fill.setdefault(sequence + k, []).append((offset, length))
    assert used == {k: int(c) for k, c in enumerate(counts) if c}
    for places in fill.values():
        assert [o for o, _ in sorted(places)] == [sum(x for _, x in sorted(places)[:k]) for k in range(len(places))]
        assert sum(x for _, x in places) <= 40
    assert len(fill) == plan.sequences


PAGES = "page_id long, url string, html string, payload string, first long"


def test_archives_round_trip(spark):
    long, short = "é" * 60 + "\r\n\r\nWARC/1.1\r\n", "short"
    rows = [(3, "u", long, "c", 0), (1, "u\nv", long, "c", 0), (1, "u", long, "c", 0), (9, None, short, "c", 0), (2, "u", short, "c", 0), (None, "u", long, "c", 0), (5, "u", None, "c", 0), (6, "u", "", "c", 0), (7, "u", "z" * 300_000, "c", 0)]
    df = spark.createDataFrame(rows, PAGES)
    found = warc.archive_round_trip(df, split_bytes=700).collect()
    want = []
    for page, _, html, _, _ in rows:
        body = (html or "").encode()
        again = len(body) >= 100 and html == long and page != 1
        want.append((page, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", 1 if again else None))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_archives_are_plain_gzip_members(spark):
    path = warc.write_archives(spark.createDataFrame([(1, "u", "a" * 200, "", 0)], PAGES), f"{shared_dir(spark)}/plain-{id(spark)}")
    store, top = warc.place(path)
    name = json.loads(store.open_input_stream(f"{top}/_MANIFEST").read())["file"]
    text = gzip.decompress(store.open_input_stream(f"{top}/{name}", compression=None).read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"a\r\n\r\n")


@pytest.mark.parametrize("step", [1, 7, 64, 1000, 1 << 20])
def test_every_record_has_one_owner(step):
    class Row:
        record_type, refers_to, url, payload_digest = "response", None, "u", "d"

        def __init__(self, page_id, payload):
            self.page_id, self.payload, self.payload_bytes = page_id, payload, len(payload)

    rng = np.random.default_rng(1)
    inner = warc.record_bytes(Row(99, b"inside"))[:40]  # a cut record inside a payload is no record
    rows = [Row(k, rng.integers(0, 256, 50 * k, dtype=np.uint8).tobytes() + inner) for k in range(20)]
    data = b"".join(map(warc.record_bytes, rows))
    found = [warc.parse_record(raw)[0] for at in range(0, len(data), step) for _, raw in warc.records_in(io.BytesIO(data), at, min(at + step, len(data)))]
    assert found == list(range(20))


def member(headers, body=b"", name=None):
    head = "WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(body)}\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(filename=name or "", fileobj=out, mode="wb") as f:
        f.write(head.encode() + body + b"\r\n\r\n")
    return out.getvalue()


def foreign_archive():
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    noise = np.random.default_rng(3).integers(0, 256, 90_000, dtype=np.uint8).tobytes()
    inner = gzip.compress(b"no record") + member({"WARC-Type": "response", "WARC-Record-ID": "<inner>"}, b"x" * 50) * 3 + b"end"
    bodies = [noise + inner + noise, inner * 20 + noise, b"plain", b""]
    uuid_of = lambda k: f"<urn:uuid:{k:08d}-0000-4000-8000-000000000000>"
    records = [member({"WARC-Type": "warcinfo", "WARC-Record-ID": uuid_of(99), "Content-Type": "application/warc-fields"}, b"software: x\r\n", "n" * 600)]
    for k, body in enumerate(bodies):
        records.append(member({"WARC-Type": "request", "WARC-Record-ID": uuid_of(k), "Content-Type": "application/http; msgtype=request"}, b"GET / HTTP/1.1\r\n\r\n"))
        records.append(member({"WARC-Type": "response", "WARC-Record-ID": uuid_of(10 + k), "WARC-Target-URI": f"http://h/{k}", "Content-Type": "application/http; msgtype=response"}, http + body, "n" * 600 if k % 2 else None))
        records.append(member({"WARC-Type": "metadata", "WARC-Record-ID": uuid_of(20 + k), "X-Folded": "one\r\n two"}, b"about it"))
    records.append(member({"WARC-Type": "revisit", "WARC-Record-ID": uuid_of(30), "WARC-Refers-To": uuid_of(10)}, b""))
    return bodies, records


@pytest.mark.parametrize("step", [997, 20_000, 200_000, 1 << 24])
def test_foreign_and_nested_archives(step):
    bodies, records = foreign_archive()
    data = b"".join(records)
    found = [(at, warc.parse_record(raw)) for s in range(0, len(data), step) for at, raw in warc.records_in(io.BytesIO(data), s, min(s + step, len(data)))]
    assert [at for at, _ in found] == [sum(map(len, records[:k])) for k in range(len(records))]
    rows = [r for _, r in found]
    assert [r[5] is not None and r[6] for r in rows if r[2] == "response"] == bodies
    assert [r[2] for r in rows] == ["warcinfo", *["request", "response", "metadata"] * len(bodies), "revisit"]
    assert all(r[0] is None and r[1].startswith("<urn:uuid:") for r in rows)
    assert rows[3][4]["x-folded"] == "one two" and rows[-1][6] is None and rows[-1][9].startswith("<urn:uuid:")


def test_damaged_members_are_stepped_over(spark):
    _, records = foreign_archive()
    broken = bytearray(b"".join(records[3:6]))
    broken[len(records[3]) + 40] ^= 0xFF  # inside the second of them
    data = b"".join(records[:3]) + bytes(broken) + records[-1] + records[1][:-9]
    for step in (5000, 1 << 24):
        found = [warc.parse_record(raw)[1] for s in range(0, len(data), step) for _, raw in warc.records_in(io.BytesIO(data), s, min(s + step, len(data)))]
        want = [warc.parse_record(gzip.decompress(records[k]))[1] for k in (0, 1, 2, 3, 5, len(records) - 1)]
        assert [x for x in found if x in want] == want
    store, top = warc.place(f"{shared_dir(spark)}/foreign-{id(spark)}")
    store.create_dir(top)
    with store.open_output_stream(f"{top}/a.warc.gz", compression=None) as f:
        f.write(b"".join(records))
    out = warc.read_archives(spark, f"{shared_dir(spark)}/foreign-{id(spark)}", 50_000)
    assert out.count() == len(records) and out.where("record_type = 'warcinfo'").first().headers["content-type"] == "application/warc-fields"
