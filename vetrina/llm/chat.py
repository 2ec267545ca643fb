"""Chat formatting by schema fingerprint, JVM-side throughout.

A record's nested field paths are compared layout by layout: those that a layout uses are sorted and hashed, and the first
layout whose own hash comes out maps the record to canonical turns (role, text). Fields of no layout, and those of later
layouts, so never stand in the way. For typed tables the paths come from the schema (a field that is null in a row is not
there), for JSON strings from each row and from all elements of its lists. Role names of other layouts are mapped to user,
assistant and system; turn rows keep theirs. Turns are written with a template whose control strings are escaped inside
roles and texts, reversibly: one backslash more behind the bracket. The output is a list of segments, each under the loss
mask or not; only assistant texts are. Segments joined are the formatted conversation.

Defined cases: null roles and texts are empty; turns that tie are ordered by role, then text; repeated rows are turns of
their own; a null conv_id is one conversation; an unknown layout gives no turns (JSON: null) or an error (typed table
that fits none); an empty list of messages is a conversation without turns, which has no segments; a message without
role or text has an empty one; an empty table gives an empty result; unknown columns are ignored.
"""

from __future__ import annotations

import hashlib
import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetrina.llm import common

#: Role names of other layouts, and what they mean.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "chatbot": "assistant", "model": "assistant"}
_CONTROL = r"s>|INST\]|ROLE\]"
_TURNS = "array<struct<role: string, text: string>>"
_SEGMENTS = "array<struct<text: string, loss: boolean>>"


def escape(text: Column) -> Column:
    """``text`` without control strings of the template."""
    return F.regexp_replace(text, rf"([<\[])(\\*/?(?:{_CONTROL}))", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*/?(?:{_CONTROL}))", "$1$2")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.cast("string").alias("role"), text.cast("string").alias("text"))


def _pair(first: str, second: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda field: F.array(_turn(F.lit("user"), field(first)), _turn(F.lit("assistant"), field(second)))


def _instruction(field: Callable[[str], Column]) -> Column:
    asked = F.concat_ws("\n\n", field("instruction"), F.when(field("input") != "", field("input")))
    return F.array(_turn(F.lit("user"), asked), _turn(F.lit("assistant"), field("output")))


def _role(name: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    plain = F.lower(F.trim(name))
    return F.coalesce(F.try_element_at(known, plain), F.when(plain.isin("user", "assistant", "system"), plain), name)


def _list(name: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda field: F.transform(field(name), lambda m: _turn(_role(m[role]), m[text]))


#: Layouts in their order of preference: nested field paths, the schema that reads them from JSON, the mapping to turns.
LAYOUTS: dict[str, tuple[list[str], str, Callable[[Callable[[str], Column]], Column]]] = {
    "messages": (["messages[].content", "messages[].role"], "messages array<struct<role: string, content: string>>", _list("messages", "role", "content")),
    "conversations": (["conversations[].from", "conversations[].value"], "conversations array<struct<from: string, value: string>>", _list("conversations", "from", "value")),
    "instruction": (["input", "instruction", "output"], "instruction string, input string, output string", _instruction),
    "instruction_only": (["instruction", "output"], "instruction string, output string", _pair("instruction", "output")),
    "prompt_completion": (["completion", "prompt"], "prompt string, completion string", _pair("prompt", "completion")),
    "prompt_response": (["prompt", "response"], "prompt string, response string", _pair("prompt", "response")),
    "question_answer": (["answer", "question"], "question string, answer string", _pair("question", "answer")),
    "turn_rows": (["conv_id", "role", "text", "turn"], "conv_id long, turn long, role string, text string", lambda field: F.array(_turn(field("role"), field("text")))),
}
_CONTAINERS = [p[0].split("[]")[0] for p, _, _ in LAYOUTS.values() if "[]" in p[0]]


def fingerprint(paths: list[str], layout: str) -> str:
    """Hash of those of some nested field paths that a layout uses."""
    return hashlib.sha256("\n".join(sorted(set(paths) & set(LAYOUTS[layout][0]))).encode()).hexdigest()


_PRINTS = {name: fingerprint(paths, name) for name, (paths, _, _) in LAYOUTS.items()}


def field_paths(schema: T.StructType) -> list[str]:
    """Nested field paths of a schema; elements of an array are marked by ``[]``."""
    out = []
    for f in schema:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out += [f"{f.name}[].{p}" for p in field_paths(f.dataType.elementType)]
        elif isinstance(f.dataType, T.StructType):
            out += [f"{f.name}.{p}" for p in field_paths(f.dataType)]
        else:
            out.append(f.name)
    return out


def layouts_of(schema: T.StructType) -> list[str]:
    """The layouts that a typed table has, in their order."""
    paths = field_paths(schema)
    found = [name for name, own in _PRINTS.items() if fingerprint(paths, name) == own]
    if not found:
        raise ValueError(f"no chat layout has the fields {paths}")
    return found


def typed_turns(layouts: list[str]) -> Column:
    """Turns of a row of a typed table, by the first of ``layouts`` of which the row has a field that is not null."""
    out = F.expr("array()").cast(_TURNS)
    for name in reversed(layouts):
        fields = {p.split("[]")[0] for p in LAYOUTS[name][0]}
        some = reduce(operator.or_, (F.col(f).isNotNull() for f in sorted(fields)))
        needed = F.col(_CONTAINERS[_CONTAINERS.index(name)]).isNotNull() if name in _CONTAINERS else some
        out = F.when(needed, LAYOUTS[name][2](F.col)).otherwise(out)
    return out


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _prefixed(names: Column, prefix: str) -> Column:
    return F.transform(names, lambda k: F.concat(F.lit(prefix), k))


def json_paths(record: Column) -> Column:
    """The nested field paths of a JSON string: its keys, and those of any element of the lists that layouts know."""
    none = F.expr("array()").cast("array<string>")
    parts = [F.coalesce(F.json_object_keys(record), none)]
    for name in _CONTAINERS:
        elements = F.from_json(F.get_json_object(record, f"$.{name}"), "array<map<string,string>>")
        keys = F.flatten(F.transform(F.filter(elements, lambda m: m.isNotNull()), F.map_keys))
        parts.append(F.coalesce(_prefixed(keys, f"{name}[]."), none))
    return F.array_distinct(F.concat(*parts))


def json_turns(record: Column) -> Column:
    """Turns of a JSON string in any known layout; null if the layout is unknown."""

    def by_paths(paths: Column) -> Column:
        out = F.lit(None).cast(_TURNS)
        for name in reversed(_CONTAINERS):
            out = F.when(F.json_array_length(F.get_json_object(record, f"$.{name}")) == 0, F.expr("array()").cast(_TURNS)).otherwise(out)
        for name, (own, schema, mapping) in reversed(LAYOUTS.items()):
            parsed = F.from_json(record, schema)
            found = F.sha2(F.concat_ws("\n", F.array_sort(F.array_intersect(paths, F.array(*map(F.lit, own))))), 256)
            out = F.when(found == _PRINTS[name], mapping(lambda f, parsed=parsed: parsed[f])).otherwise(out)
        return out

    return _let(json_paths(record), by_paths)


def turn_segments(turn: Column) -> Column:
    """The segments of one turn: its head, its text and its end."""
    role, text = F.coalesce(turn["role"], F.lit("")), F.coalesce(turn["text"], F.lit(""))
    own = role == "assistant"
    head = F.concat(F.lit("<s>[ROLE]"), escape(role), F.lit("[/ROLE]"), F.when(own, "").otherwise("[INST] "))
    part = lambda t, loss: F.struct(t.alias("text"), loss.alias("loss"))
    return F.array(part(head, F.lit(False)), part(escape(text), own), part(F.when(own, "</s>").otherwise(" [/INST]</s>"), F.lit(False)))


def format_turns(turns: Column) -> Column:
    """Segments of a conversation given as an array of turns."""
    return F.flatten(F.transform(F.coalesce(turns, F.expr("array()").cast(_TURNS)), turn_segments))


def format_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, segments) from a typed table: of turn rows, or of a conversation per row in any known layout.

    A table may hold several layouts; each row has its own. Turn rows are gathered by conversation as they are, and
    formatted behind the shuffle.
    """
    layouts = layouts_of(rows.schema)
    if layouts != ["turn_rows"]:
        key = F.col("conv_id").cast("long") if "conv_id" in rows.columns else F.lit(None).cast("long")
        return rows.select(key.alias("conv_id"), format_turns(typed_turns(layouts)).alias("segments"))
    one = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.select("conv_id", one.alias("_turn")).groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    return whole.select("conv_id", F.flatten(F.transform("_turns", turn_segments)).alias("segments"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back from its text."""
    ends = F.split(formatted, "</s>")
    bodies = F.slice(ends, 1, F.size(ends) - 1)

    def turn(body: Column) -> Column:
        role = F.substring_index(F.substr(body, F.lit(10)), "[/ROLE]", 1)
        rest = F.substr(body, F.length(role) + 17)
        role = unescape(role)
        inner = F.substr(rest, F.lit(8), F.length(rest) - 15)
        return F.struct(role.alias("role"), unescape(F.when(role == "assistant", rest).otherwise(inner)).alias("text"))

    return F.transform(bodies, turn)


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    out = format_rows(rows.unionByName(extra))
    out = out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    out = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*/?(?:s>|INST\]|ROLE\]))', '\1\\\2', 'g')) AS r,
         length(regexp_replace(text, '([<\[])(\\*/?(?:s>|INST\]|ROLE\]))', '\1\\\2', 'g')) AS t
  FROM rows_)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(9 + r + 7 + t + CASE WHEN role = 'assistant' THEN 4 ELSE 19 END)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
