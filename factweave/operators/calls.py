"""Calls of a provider: batches of requests, paced and retried, with answers checked and every attempt metered.

A call runs in a task; its answers are rows, and so is what it cost, so a lost task repeats its own calls
only. Limits hold for each worker process: a quota for all of them is divided by the number of tasks.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .meter import ItemRateLimiter, RateLimiter, with_retry

CALL = "struct<id:string,at:double,kind:string,label:string,items:long,bytes:long,attempts:array<struct<duration_ms:double,ok:boolean>>>"


def structured(answer: str | dict | None, kind: T.StructType) -> dict | None:
    """An answer with the fields of kind and no others; None for what is no such object."""
    try:
        found = json.loads(answer) if isinstance(answer, str) else answer
    except ValueError:
        return None
    if not isinstance(found, dict):
        return None
    out = {}
    for f in kind.fields:
        value = found.get(f.name)
        if value is not None and not _fits(value, f.dataType):
            return None
        out[f.name] = value
    return out


def _fits(value, kind: T.DataType) -> bool:
    if isinstance(kind, T.BooleanType):
        return isinstance(value, bool)
    if isinstance(kind, (T.DoubleType, T.LongType, T.IntegerType)):
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    if isinstance(kind, T.StringType):
        return isinstance(value, (str, int, float))
    if isinstance(kind, T.ArrayType):
        return isinstance(value, list) and all(v is None or _fits(v, kind.elementType) for v in value)
    return structured(value, kind) is not None


class Paced:
    """Calls of one worker, by the provider's limits: min_interval_ms, items_per_minute, status_of(error), wait_ms(error)."""

    def __init__(self, provider, kind: str):
        self.provider, self.kind = provider, kind
        self.starts = RateLimiter(getattr(provider, "min_interval_ms", 0))
        most = getattr(provider, "items_per_minute", None)
        self.items = ItemRateLimiter(most) if most else lambda n, work: work()

    def __call__(self, ask: Callable[[list], list], requests: list, bytes_: int) -> tuple[list, dict]:
        """(answers, the call); raises what the last attempt raised."""
        attempts, began = [], time.time()

        def once():
            at = time.monotonic()
            try:
                out = self.starts(lambda: self.items(len(requests), lambda: ask(requests)))
                attempts.append({"duration_ms": 1000 * (time.monotonic() - at), "ok": True})
                return out
            except Exception:
                attempts.append({"duration_ms": 1000 * (time.monotonic() - at), "ok": False})
                raise

        answers = with_retry(once, getattr(self.provider, "status_of", lambda e: getattr(e, "status", None)), getattr(self.provider, "wait_ms", lambda e: None))
        return answers, {"id": uuid.uuid4().hex, "at": began, "kind": self.kind, "label": self.provider.name, "items": len(requests), "bytes": bytes_, "attempts": attempts}


def fixed(size: int) -> Callable[[pd.DataFrame], np.ndarray]:
    return lambda frame: np.arange(len(frame)) // size


def ask(requests: DataFrame, key: str, provider, kind: str, batches: Callable[[pd.DataFrame], np.ndarray], call: Callable[[list[dict]], list]) -> DataFrame:
    """(key, result JSON, call): one row per request that got an answer, and one without a key for a call without any.

    call gets a batch's columns as dicts and answers in its order, None for nothing.
    """

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paced = Paced(provider, kind)
        for frame in frames:
            at = batches(frame)
            for b in np.unique(at):
                part = frame[at == b]
                rows = part.to_dict("records")
                answers, cost = paced(call, rows, sum(len(str(v)) for r in rows for v in r.values()))
                if len(answers) != len(rows):
                    raise ValueError(f"{len(rows)} requests got {len(answers)} answers")
                kept = [i for i, a in enumerate(answers) if a is not None]
                if not kept:  # the call counts, whatever came of it
                    yield pd.DataFrame({key: [None], "result": [None], "call": [cost]})
                    continue
                yield pd.DataFrame({key: part[key].to_numpy()[kept], "result": [json.dumps(answers[i]) for i in kept], "call": [cost] * len(kept)})

    return requests.dropDuplicates([key]).mapInPandas(work, f"{key} string, result string, call {CALL}")


def cacheable(answered: DataFrame) -> DataFrame:
    """Rows for a cache: those with a key, without what they cost."""
    return answered.filter(F.col(answered.columns[0]).isNotNull()).drop("call").withColumn("created_at", F.current_timestamp())


def events(answered: DataFrame) -> DataFrame:
    """Rows of meter_events: one per attempt of each call."""
    calls = answered.select("call.*").dropDuplicates(["id"])
    each = calls.select(F.timestamp_seconds("at").alias("at"), "kind", "label", "items", "bytes", F.explode("attempts").alias("a"))
    none = F.lit(None).cast("long")
    return each.select("at", "kind", "label", F.col("a.duration_ms").alias("duration_ms"), F.col("a.ok").alias("ok"), none.alias("input_tokens"), none.alias("output_tokens"), "items", "bytes")
