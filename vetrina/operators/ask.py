"""Models as sources of typed values: texts, numbers within bounds, lists and vectors, for rows that may hold pictures.

Each answer is checked against the declared fields, value by value. A value that does not fit is rejected with its reason
and leaves the others alone, unless its field is required: then the row has no answer. A call that fails marks only the
rows that it was made for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetrina.operators.enrich import Pacer, is_quota_message, pause_seconds

#: A model gets rows as dicts, among them a picture's bytes, and answers by key.
Model = Callable[[Sequence[Mapping[str, object]]], Mapping[object, Mapping[str, object]]]
_SPARK = {"text": "string", "number": "double", "texts": "array<string>", "vector": "array<float>"}
_ARROW = {"text": pa.string(), "number": pa.float64(), "texts": pa.list_(pa.string()), "vector": pa.list_(pa.float32())}


@dataclass(frozen=True)
class Field:
    """A value that a model is asked for: its kind, whether an answer needs it, and what it may be.

    ``low`` and ``high`` bound numbers, ``size`` is a vector's length or the most of a list, ``among`` are the texts there
    may be.
    """

    name: str
    kind: str = "text"
    required: bool = False
    low: float | None = None
    high: float | None = None
    size: int | None = None
    among: tuple[str, ...] = ()

    def accepted(self, value: object) -> object:
        """``value`` in its type; ValueError if it does not fit."""
        if value is None:
            if self.required:
                raise ValueError("missing")
            return None
        if self.kind == "text":
            if not isinstance(value, str) or self.among and value not in self.among:
                raise ValueError("not a text" if not isinstance(value, str) else "not one of the values")
            return value
        if self.kind == "number":
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                raise ValueError("not a number")
            if self.low is not None and value < self.low or self.high is not None and value > self.high:
                raise ValueError("out of bounds")
            return float(value)
        if not isinstance(value, (list, tuple)):
            raise ValueError("not a list")
        if self.kind == "texts":
            if self.size is not None and len(value) > self.size:
                raise ValueError(f"more than {self.size}")
            return [Field(self.name, among=self.among, required=True).accepted(x) for x in value]
        if self.size is not None and len(value) != self.size:
            raise ValueError(f"{len(value)} numbers instead of {self.size}")
        return [Field(self.name, "number", True, self.low, self.high).accepted(x) for x in value]


def ask(rows: DataFrame, model: Model, fields: Sequence[Field], key: str = "id", columns: Sequence[str] = (), block: int = 8, pacer: Callable[[], Pacer] | None = None) -> DataFrame:
    """(key, the fields, rejected, error, tokens_in, tokens_out) for every row of ``rows``.

    The model sees ``key`` and ``columns``, ``block`` rows at a time. ``rejected`` has a reason for each value that did not
    fit. With ``pacer`` all calls run in one task, one after another, and what a quota refuses is repeated after its pause.
    Write the result before using it twice, or the model is called twice.
    """
    fields, columns = list(fields), [key, *columns]
    key_type = rows.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = pacer() if pacer else None
        call = model if pace is None else lambda part: pace.call(lambda: model(part), lambda e: is_quota_message(str(e)), lambda e: pause_seconds(str(e)))
        for batch in batches:
            asked = batch.to_pylist()
            out: dict[str, list] = {n: [] for n in (*(f.name for f in fields), "rejected", "error", "tokens_in", "tokens_out")}
            for at in range(0, len(asked), block):
                part, problem, answers = asked[at : at + block], None, {}
                try:
                    answers = call(part)
                except Exception as error:
                    problem = f"{type(error).__name__}: {error}"[:500]
                for r in part:
                    answer = answers.get(r[key])
                    values: dict[str, object] = {}
                    rejected: dict[str, str] = {}
                    failed = problem or (None if answer is not None else "no answer")
                    for f in fields if answer is not None else ():
                        try:
                            values[f.name] = f.accepted(answer.get(f.name))
                        except ValueError as error:
                            rejected[f.name] = str(error)
                            if f.required:
                                failed = f"{f.name}: {error}"
                    for f in fields:
                        out[f.name].append(None if failed else values.get(f.name))
                    out["rejected"].append(list(rejected.items()))
                    out["error"].append(failed)
                    for n in ("tokens_in", "tokens_out"):
                        out[n].append(int((answer or {}).get(n, 0)))
            kinds = [*(_ARROW[f.kind] for f in fields), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], names=[key, *out])

    schema = ", ".join([f"`{key}` {key_type}", *(f"`{f.name}` {_SPARK[f.kind]}" for f in fields), "rejected map<string,string>, error string, tokens_in long, tokens_out long"])
    asked = rows.select(*columns)
    return (asked.coalesce(1) if pacer else asked).mapInArrow(run, schema)


#: What is asked about a picture. Names, bounds and values are those of the catalogue's tags.
TAGS = (
    Field("colore_principale", required=True),
    Field("colori_visibili", "texts", size=5),
    Field("materiale_visivo", required=True),
    Field("confidenza_materiale", required=True, among=("alta", "media", "bassa", "sconosciuta")),
    Field("stile", "texts", size=4),
    Field("motivo", "texts"),
    Field("dettagli_visivi", "texts", size=5),
    Field("confidenza_generale", "number", required=True, low=0, high=100),
)


def vector(size: int) -> tuple[Field, ...]:
    return (Field("embedding", "vector", required=True, size=size),)


def pictures(fetched: DataFrame, have: DataFrame | None = None) -> DataFrame:
    """(image_sha256, content) of the usable pictures of ``fetched`` (content), one row each, without those of ``have``."""
    from vetrina.operators.assets import mime_type

    rows = fetched.where(mime_type(F.col("content")).isNotNull()).select(F.sha2("content", 256).alias("image_sha256"), "content")
    if have is not None:
        rows = rows.join(have.select("image_sha256").distinct(), "image_sha256", "left_anti")
    # Equal digests are equal pictures: any of them will do.
    return rows.groupBy("image_sha256").agg(F.first("content").alias("content"))
