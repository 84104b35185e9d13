"""Adapters for work on pixels and models. No model or image library is needed to import this module; a
deterministic stub stands in where none is given, and real ones are plugged in by name."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pixels

_REGISTRY: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str) -> Callable:
    def put(make: Callable) -> Callable:
        _REGISTRY[kind, name] = make
        return make

    return put


def create(kind: str, name: str = "stub", **options) -> Callable:
    """The function of an adapter; unknown names raise KeyError with the known ones."""
    return factory(kind, name)(**options)


def factory(kind: str, name: str) -> Callable:
    """What makes an adapter's function; looked up on the driver and sent to the tasks, so that they need no
    registration of their own."""
    if (kind, name) not in _REGISTRY:
        raise KeyError(f"no {kind} adapter {name!r}; known: {sorted(n for k, n in _REGISTRY if k == kind)}")
    return _REGISTRY[kind, name]


def _unit(data: bytes, n: int) -> list[float]:
    raw = b"".join(hashlib.sha256(data + bytes([i])).digest() for i in range(-(-n // 32)))[:n]
    v = [b - 127.5 for b in raw]
    size = sum(x * x for x in v) ** 0.5
    return [x / size for x in v]


@register("encoder", "stub")
def _stub_encoder(dimension: int = 64) -> Callable[[bytes], list[float]]:
    return lambda data: _unit(data, dimension)


@register("hash", "stub")
def _stub_hash() -> Callable[[bytes], int]:
    return lambda data: int.from_bytes(hashlib.sha256(data).digest()[:8], "little", signed=True)


@register("blur", "stub")
def _stub_blur() -> Callable[[bytes], float]:
    return lambda data: len(set(data)) * 10.0


@register("faces", "stub")
def _stub_faces() -> Callable[[bytes], list[dict]]:
    return lambda data: [{"x": 0.1, "y": 0.1, "w": 0.2, "h": 0.2, "score": 0.9}] if data else []


@register("vision", "stub")
def _stub_vision() -> Callable[[bytes], dict]:
    return lambda data: {"is_junk": False, "kind": "photo", "confidence": 0.5}


@register("attributes", "stub")
def _stub_attributes() -> Callable[[bytes], dict]:
    return lambda data: {"gender": "f" if data and data[0] % 2 else "m", "age": len(data) % 90}


@register("text", "stub")
def _stub_text() -> Callable[[bytes], list[dict]]:
    return lambda data: [{"text": w.decode("utf-8", "replace"), "confidence": 0.9 if w.isalnum() else 0.3} for w in data.split()]


def _of_pixels(measure: Callable) -> Callable[[], Callable]:
    def make() -> Callable:
        def run(data: bytes):
            image = pixels.read(data)
            return None if image is None else measure(image)

        return run

    return make


register("hash", "pixels")(_of_pixels(pixels.difference_hash))
register("blur", "pixels")(_of_pixels(pixels.sharpness))
register("tones", "pixels")(_of_pixels(pixels.tone_stats))
register("edges", "pixels")(_of_pixels(pixels.edge_stats))


class RateLimited(Exception):
    """The service asks to come back later."""


def with_backoff(call: Callable, waits: tuple[float, ...] = (5, 10, 20, 40), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """Repeats a rate-limited call after the waits; other errors and the last one become an error record."""

    def run(*args):
        for wait in (*waits, None):
            try:
                return {"result": call(*args), "error": None}
            except RateLimited as e:
                if wait is None:
                    return {"result": None, "error": f"rate limited: {e}"}
                sleep(wait)
            except Exception as e:
                return {"result": None, "error": f"{type(e).__name__}: {e}"}

    return run


def apply(df: DataFrame, kind: str, name: str, column: str, out: str, schema: str, **options) -> DataFrame:
    """Adds out, the adapter's value for each row's binary column, in Arrow batches; null stays null."""
    from pyspark.sql.types import _parse_datatype_string

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    _parse_datatype_string(schema)
    make = factory(kind, name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = make(**options)
        for pdf in parts:
            yield pdf.assign(**{out: [None if x is None else f(bytes(x)) for x in pdf[column]]})

    return df.mapInPandas(run, f"{kinds}, `{out}` {schema}")


def call(df: DataFrame, kind: str, name: str, column: str, schema: str, waits: tuple[float, ...] = (5, 10, 20, 40), **options) -> DataFrame:
    """Adds result and error: a service's answer per row, called again after the waits when it is rate-limited.
    A row that fails has an error and no result; the others go on. Null input isn't sent."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    make = factory(kind, name)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = with_backoff(make(**options), waits)
        for pdf in parts:
            got = [{"result": None, "error": None} if x is None else f(bytes(x) if isinstance(x, (bytes, bytearray)) else x) for x in pdf[column]]
            yield pdf.assign(result=[g["result"] for g in got], error=[g["error"] for g in got])

    return df.mapInPandas(run, f"{kinds}, result {schema}, error string")


def ask_json(df: DataFrame, kind: str, name: str, column: str, schema: str, waits: tuple[float, ...] = (5, 10, 20, 40), **options) -> DataFrame:
    """Adds answer, a struct of the schema, and error: a model's answer per row (`call`), of which the first JSON object or array is
    read. An answer without any, or one that isn't of the schema, is an error of its row; null input has neither."""
    from .expr import json_payload

    said = call(df, kind, name, column, "string", waits, **options)
    answer = F.from_json(json_payload("result"), schema, {"mode": "PERMISSIVE"})
    said = said.withColumn("answer", F.when(F.trim(F.coalesce(json_payload("result"), F.lit(""))) != "", answer))
    empty = F.col("answer").isNull() | F.forall(F.array(*[F.col(f"answer.{f}").isNull() for f in _fields(schema)]), lambda x: x)
    bad = F.col("result").isNotNull() & empty
    said = said.withColumn("error", F.when(bad, F.concat(F.lit("no such JSON: "), F.substring("result", 1, 200))).otherwise(F.col("error")))
    return said.withColumn("answer", F.when(~bad, F.col("answer"))).drop("result")


def _fields(schema: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).fieldNames()


def found(df: DataFrame, kind: str, name: str, column: str, out: str, schema: str, **options) -> DataFrame:
    """A row per thing that an adapter finds in a row's content, none or many; schema is one thing's."""
    many = apply(df, kind, name, column, "__found", f"array<{schema}>", **options)
    return many.withColumn(out, F.explode("__found")).drop("__found")


def frames(df: DataFrame, media_type: str = "media_type", duration: str = "duration") -> DataFrame:
    """Adds at, the seconds to look at: 0 for a photo, 10, 50 and 90 % of a video's duration."""
    spots = F.transform(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), lambda p: p * F.col(duration))
    return df.withColumn("at", F.explode(F.when(F.col(media_type) == "video", spots).otherwise(F.array(F.lit(0.0)))))
