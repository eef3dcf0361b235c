"""Chat formatting by schema fingerprints.

All nested field paths of a record or a table are gathered and hashed. The
fingerprint is looked up among those of the layouts; one that isn't known yet
(a record with further fields, or with fields left out) is settled once, by the layouts all
of whose paths it has, and looked up from then on, so a corpus costs as many
comparisons as it has schemas. Of several layouts that fit, the one that most paths
speak for, then the first listed, is taken. It names a declarative mapping that turns
the record (prompt and completion, instruction with input, system text and history,
message lists, content in parts, rows by turn) into canonical turns
``array<struct<role, text>>``. A template marks them.

The template writes ``<s>role\\n`` + text + ``</s>`` for each turn, with the text
of every role but the assistant's between ``[INST] `` and `` [/INST]``. Control
strings inside roles and texts are broken by a backslash after their first
character, and backslashes are doubled, so that reading back restores every
character. The loss mask covers the assistant's texts alone.

Defined results: a null role or text counts as empty; an empty table gives an
empty result; an empty list of messages has all paths of its layout and no turns;
repeated rows stay as repeated turns; ties on the order column go by role, then
text; rows with a null conversation id form one conversation; a record that no
layout fits, or that is no JSON object, gets null turns; a table that no layout
fits raises; long texts and long conversations are read in time linear in their
length; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Strings with a meaning in the template; fixed values.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]")
TURNS = "array<struct<role: string, text: string>>"
LEARNT = "assistant"


@dataclass(frozen=True)
class Mapping:
    """One layout: its fields as DDL, the SQL that makes turns of a record ``r``, and the DDL to read it by where that isn't ``fields``."""

    name: str
    fields: str
    turns: str
    read: str | None = None

    @property
    def paths(self) -> tuple[str, ...]:
        return field_paths(T._parse_datatype_string(self.fields))


def _pair(asked: str, said: str) -> str:
    return f"array(struct('user' as role, {asked} as text), struct('assistant' as role, {said} as text))"


def _led(turns: str) -> str:
    """Turns after the record's system text, if it has one."""
    return f"if(coalesce(r.system, '') = '', {turns}, concat(array(struct('system' as role, r.system as text)), {turns}))"


_ASKED = "if(coalesce(r.input, '') = '', r.instruction, concat(coalesce(r.instruction, ''), '\\n\\n', r.input))"
_SENT = "transform(r.conversations, m -> struct(case m.`from` when 'human' then 'user' when 'gpt' then 'assistant' else m.`from` end as role, m.value as text))"
_LISTED = "array<struct<role: string, content: string>>"
#: Text of content in parts; content that is no list of parts stays as it is.
_PARTS = "coalesce(array_join(transform(filter(from_json(m.content, 'array<struct<type: string, text: string>>'), p -> p.type = 'text'), p -> coalesce(p.text, '')), ''), m.content)"

#: Layouts of single records.
MAPPINGS = (
    Mapping("prompt_response", "prompt string, response string", _pair("r.prompt", "r.response")),
    Mapping("prompt_completion", "prompt string, completion string", _pair("r.prompt", "r.completion")),
    Mapping("question_answer", "question string, answer string", _pair("r.question", "r.answer")),
    Mapping("instruction_output", "instruction string, output string", _pair("r.instruction", "r.output")),
    Mapping(
        "instruction_input_output",
        "instruction string, input string, output string",
        _pair(_ASKED, "r.output"),
    ),
    Mapping("messages", "messages array<struct<role: string, content: string>>", "transform(r.messages, m -> struct(m.role as role, m.content as text))"),
    Mapping(
        "from_value",
        "conversations array<struct<`from`: string, value: string>>",
        _SENT,
    ),
    Mapping("role_text", "turns array<struct<role: string, text: string>>", "transform(r.turns, m -> struct(m.role as role, m.text as text))"),
    Mapping("system_prompt_response", "system string, prompt string, response string", _led(_pair("r.prompt", "r.response"))),
    Mapping("system_instruction_input_output", "system string, instruction string, input string, output string", _led(_pair(_ASKED, "r.output"))),
    Mapping(
        "instruction_history",
        "instruction string, input string, output string, history array<array<string>>",
        f"concat(coalesce(flatten(transform(r.history, h -> {_pair('get(h, 0)', 'get(h, 1)')})), array()), {_pair(_ASKED, 'r.output')})",
    ),
    Mapping("system_from_value", "system string, conversations array<struct<`from`: string, value: string>>", _led(_SENT)),
    Mapping("content_parts", "messages array<struct<role: string, content: array<struct<type: string, text: string>>>>", f"transform(r.messages, m -> struct(m.role as role, {_PARTS} as text))", f"messages {_LISTED}"),
    Mapping("data_messages", f"data struct<messages: {_LISTED}>", "transform(r.data.messages, m -> struct(m.role as role, m.content as text))"),
)
#: Fingerprints that a task remembers besides those of the layouts.
REMEMBERED = 10_000
#: Layouts with a row for each turn; ``turns`` names key, order, role and text.
ROW_MAPPINGS = (
    Mapping("turn_rows", "conv_id bigint, turn bigint, role string, text string", "conv_id, turn, role, text"),
    Mapping("message_rows", "thread_id bigint, position bigint, author string, content string", "thread_id, position, author, content"),
)


def field_paths(kind: T.DataType, at: str = "") -> tuple[str, ...]:
    """Sorted leaf paths of a nested type, such as ``messages[].content``."""
    if isinstance(kind, T.StructType):
        return tuple(sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)))
    return field_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else (at,)


def value_paths(value, at: str = "") -> Iterator[str]:
    """Leaf paths of a decoded JSON value; dots, brackets and backslashes of names are escaped."""
    if isinstance(value, dict) and value:
        for name, inner in value.items():
            told = re.sub(r"([.\[\\])", r"\\\1", name)
            yield from value_paths(inner, f"{at}.{told}" if at else told)
    elif isinstance(value, list):
        if not value:
            yield f"{at}[]"
        for inner in value:
            yield from value_paths(inner, f"{at}[]")
    else:
        yield at


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fitting(paths, layouts: dict[str, tuple[str, ...]]) -> str | None:
    """The layout all of whose paths are there, of several the one that most of them speak for, then the first.

    An empty list stands for all that its items could hold, and speaks once.
    """
    paths = set(paths)
    empty = tuple(p for p in paths if p.endswith("[]"))
    fits = [(name, {p if p in paths else next(e for e in empty if p.startswith(e)) for p in own}) for name, own in layouts.items() if all(p in paths or p.startswith(empty) for p in own)]
    return max(fits, key=lambda f: len(f[1]))[0] if fits else None


class Registry:
    """Layouts by fingerprint; what is met for the first time is fitted once and then known."""

    def __init__(self, layouts: dict[str, tuple[str, ...]]):
        self.layouts, self.fitted = layouts, 0
        self.known: dict[str, str | None] = {fingerprint(own): name for name, own in layouts.items()}

    def layout(self, paths) -> str | None:
        paths = set(paths)
        key = fingerprint(paths)
        if key not in self.known:
            if len(self.known) > REMEMBERED + len(self.layouts):
                self.known = {fingerprint(own): name for name, own in self.layouts.items()}
            self.known[key], self.fitted = fitting(paths, self.layouts), self.fitted + 1
        return self.known[key]


def record_layout(record: str | None, registry: Registry) -> str | None:
    """Name of the layout that fits a JSON record."""
    try:
        value = json.loads(record or "")
    except (ValueError, RecursionError):
        return None
    return registry.layout(value_paths(value)) if isinstance(value, dict) else None


def turns_of_records(df: DataFrame, record: str = "record") -> DataFrame:
    """Add ``layout`` and ``turns``, in place of columns so named, to rows that hold a JSON record each."""

    registry = Registry({m.name: m.paths for m in MAPPINGS})

    @F.pandas_udf("string")
    def layout(records: pd.Series) -> pd.Series:
        return records.map(lambda r: record_layout(r, registry)).astype(object)

    at, named = f"`{record}`", df.withColumn("layout", layout(F.col(record)))
    turns = F.lit(None).cast(TURNS)
    for m in MAPPINGS:
        parsed = f"from_json({at}, '{m.read or m.fields}')"
        made = F.expr(f"element_at(transform(array({parsed}), r -> {m.turns}), 1)").cast(TURNS)
        turns = F.when(F.col("layout") == m.name, made).otherwise(turns)
    return named.withColumn("turns", turns)


def turns_of_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turns) of a table with a row for each turn, by the fingerprint of its columns.

    A conversation becomes one row, so its turns meet in one task; no other
    grouping happens.
    """
    found = Registry({m.name: m.paths for m in ROW_MAPPINGS}).layout(field_paths(df.schema))
    if found is None:
        raise ValueError(f"no row layout has the columns {sorted(df.columns)}")
    key, order, role, text = next(m.turns for m in ROW_MAPPINGS if m.name == found).split(", ")
    rows = df.select(F.col(key).alias("conv_id"), F.struct(F.col(order).alias("at"), _filled(role).alias("role"), _filled(text).alias("text")).alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: Column) -> Column:
    """The marked string of canonical turns."""

    def one(t: Column) -> Column:
        text, role = escape(F.coalesce(t["text"], F.lit(""))), F.coalesce(t["role"], F.lit(""))
        shown = F.when(role == LEARNT, text).otherwise(F.concat(F.lit(BEFORE), text, F.lit(AFTER)))
        return F.concat(F.lit("<s>"), F.replace(escape(role), F.lit("\n"), F.lit("\\\n")), F.lit("\n"), shown, F.lit("</s>"))

    return F.array_join(F.transform(turns, one), "")


TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*+)\n(.*?)</s>", re.DOTALL)
BEFORE, AFTER = "[INST] ", " [/INST]"


def read_turns(formatted: str) -> list[dict]:
    """Turns of a marked string: role, text, whether it is learnt, and the place of the escaped text (code points, from 0)."""
    out = []
    for m in TURN.finditer(formatted):
        role = re.sub(r"(?s)\\(.)", r"\1", m[1])
        learnt, (start, end) = role == LEARNT, m.span(2)
        if not learnt:
            start, end = start + len(BEFORE), end - len(AFTER)
        out.append({"role": role, "text": re.sub(r"(?s)\\(.)", r"\1", formatted[start:end]), "start": start, "end": end, "learnt": learnt})
    return out


def parse_formatted(formatted: Column) -> Column:
    """The turns that ``read_turns`` finds, for a column."""

    @F.pandas_udf("array<struct<role: string, text: string, start: int, end: int, learnt: boolean>>")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(read_turns, na_action="ignore").astype(object)

    return read(formatted)


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns, loss_spans): the marked string and what reads back from it."""
    made = turns_of_rows(rows).select("conv_id", format_turns(F.col("turns")).alias("formatted"))
    read = made.withColumn("turns", parse_formatted(F.col("formatted")))
    spans = F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))
    return read.withColumn("loss_spans", spans)


def said(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n"))), "")


def digest_conversations(rows: DataFrame) -> DataFrame:
    """Counts and digests of what reads back from the formatted strings."""
    out = format_conversations(rows)
    masked = F.array_join(F.transform(F.filter("turns", lambda t: t["learnt"]), lambda t: t["text"]), "")  # what lies under loss_spans, unescaped
    out = out.withColumns({"_said": said(F.col("turns")), "_masked": masked})
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2("_said", 256).alias("turns_sha256"),
        F.length("_masked").cast("long").alias("loss_chars"),
        F.sha2("_masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The digests in DuckDB; a template's marks add a fixed number of characters to a turn.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, role = 'assistant' AS learnt,
  length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) AS n,
  length(replace(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), chr(10), '\' || chr(10))) AS m FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE learnt), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE learnt), '')) AS loss_sha256,
  CAST(sum(n + m + 8 + CASE WHEN learnt THEN 0 ELSE 15 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record): conversations as JSON records, dealt by their ids to the list layouts, and their first exchanges to the pair layouts."""
    turns = turns_of_rows(rows)
    named = lambda role, text, renamed: F.transform("turns", lambda t: F.struct(renamed(t["role"]).alias(role), t["text"].alias(text)))
    plain = lambda r: r
    other = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    lists = [("messages", named("role", "content", plain)), ("conversations", named("from", "value", other)), ("turns", named("role", "text", plain))]
    lot = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(15))
    record = F.lit(None).cast("string")
    for k, (name, value) in enumerate(lists):
        record = F.when(lot % 3 == k, F.to_json(F.struct(value.alias(name), F.col("conv_id").alias("id")))).otherwise(record)
    first = lambda role: F.get(F.filter("turns", lambda t: t["role"] == role), 0)["text"]
    asked, answer = first("user"), first("assistant")
    pair = F.lit(None).cast("string")
    for k, (a, b) in enumerate((("prompt", "response"), ("prompt", "completion"), ("question", "answer"), ("instruction", "output"))):
        pair = F.when(lot % 5 == k, F.to_json(F.struct(asked.alias(a), answer.alias(b), F.lit("x").alias("note")))).otherwise(pair)
    pair = F.when(lot % 5 == 4, F.to_json(F.struct(asked.alias("instruction"), answer.alias("input"), answer.alias("output")))).otherwise(pair)
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), t["text"].alias("text"))).alias("content")))
    rich = [
        F.struct(parts.alias("messages")),
        F.struct(F.struct(named("role", "content", plain).alias("messages")).alias("data"), F.lit(1).alias("version")),
        F.struct(F.lit("be kind").alias("system"), named("from", "value", other).alias("conversations")),
        F.struct(asked.alias("instruction"), F.lit("").alias("input"), answer.alias("output"), F.array(F.array(asked, answer)).alias("history")),
    ]
    more = F.lit(None).cast("string")
    for k, value in enumerate(rich):
        more = F.when(F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4)) == k, F.to_json(value)).otherwise(more)
    both = asked.isNotNull() & answer.isNotNull()
    pairs = turns.where(both).select("conv_id", pair.alias("record"))
    richer = turns.where(both | (F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4)) < 3)).select("conv_id", more.alias("record"))
    return turns.select("conv_id", record.alias("record")).unionByName(pairs).unionByName(richer)


def digest_layouts(rows: DataFrame) -> DataFrame:
    """(conv_id, layout, n_turns, turns_sha256) of what every layout's records are mapped to."""
    out = turns_of_records(records_of_rows(rows))
    return out.select("conv_id", "layout", F.size("turns").cast("long").alias("n_turns"), F.sha2(said(F.col("turns")), 256).alias("turns_sha256"))


#: What the layouts' records say, in DuckDB.
LAYOUTS_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, (conv_id % 15 + 15) % 15 AS lot FROM conversations),
p AS (SELECT conv_id, any_value(lot) AS lot, first(text ORDER BY turn, text) FILTER (WHERE role = 'user') AS a, first(text ORDER BY turn, text) FILTER (WHERE role = 'assistant') AS b FROM c GROUP BY conv_id)
SELECT conv_id, CASE any_value(lot) % 3 WHEN 0 THEN 'messages' WHEN 1 THEN 'from_value' ELSE 'role_text' END AS layout, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256 FROM c GROUP BY conv_id
UNION ALL SELECT conv_id, CASE lot % 5 WHEN 0 THEN 'prompt_response' WHEN 1 THEN 'prompt_completion' WHEN 2 THEN 'question_answer' WHEN 3 THEN 'instruction_output' ELSE 'instruction_input_output' END, 2,
  sha256('user' || chr(10) || a || CASE WHEN lot % 5 = 4 AND b <> '' THEN chr(10) || chr(10) || b ELSE '' END || chr(10) || 'assistant' || chr(10) || b || chr(10))
FROM p WHERE a IS NOT NULL AND b IS NOT NULL
UNION ALL SELECT conv_id, CASE conv_id % 4 WHEN 0 THEN 'content_parts' WHEN 1 THEN 'data_messages' ELSE 'system_from_value' END, count(*) + CASE WHEN conv_id % 4 = 2 THEN 1 ELSE 0 END,
  sha256(CASE WHEN conv_id % 4 = 2 THEN 'system' || chr(10) || 'be kind' || chr(10) ELSE '' END || string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) FROM c WHERE conv_id % 4 < 3 GROUP BY conv_id
UNION ALL SELECT conv_id, 'instruction_history', 4, sha256(repeat('user' || chr(10) || a || chr(10) || 'assistant' || chr(10) || b || chr(10), 2)) FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND conv_id % 4 = 3
"""
