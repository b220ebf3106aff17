"""Trace spans as a table: recording around driver steps, trees and roll-ups."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestral.functions.session import checkpoint

SPAN = "trace_id string, span_id string, parent_span_id string, name string, started_at timestamp, ended_at timestamp, duration_seconds double, status string, input string, output string, attributes map<string,string>, error struct<error_type:string,message:string>"
_OPEN: ContextVar[str | None] = ContextVar("open_span", default=None)


def plain(value) -> str | None:
    """JSON of a value; what JSON can't hold becomes its type's name."""
    return None if value is None else json.dumps(value, default=lambda x: type(x).__name__, sort_keys=True)


class Tracer:
    """Spans of one trace; ids count up, so a rerun gives the same."""

    def __init__(self, trace_id: str):
        self.trace_id, self.rows = trace_id, []
        self._n = 0

    @contextmanager
    def span(self, name: str, input=None, **attributes) -> Iterator[dict]:
        self._n += 1
        row = {
            "trace_id": self.trace_id, "span_id": f"{self.trace_id}-{self._n:06d}", "parent_span_id": _OPEN.get(), "name": name,
            "started_at": datetime.now(UTC), "status": "ok", "input": plain(input), "output": None, "attributes": {k: str(v) for k, v in attributes.items()},
            "error": None
        }
        token, began = _OPEN.set(row["span_id"]), time.perf_counter()
        held: dict = {}
        try:
            yield held
        except Exception as e:
            row |= {"status": "error", "error": {"error_type": type(e).__name__, "message": str(e)}}
            raise
        finally:
            _OPEN.reset(token)
            row |= {"ended_at": datetime.now(UTC), "duration_seconds": time.perf_counter() - began, "output": plain(held.get("output"))}
            self.rows.append(row)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([[r[c.split()[0]] for c in SPAN.replace(":string,", "_").replace(",string>", ">").split(", ")] for r in self.rows], SPAN)


def completed_steps(spans: DataFrame) -> DataFrame:
    """Successful agent steps with both parts of their output, by step."""
    found = spans.filter("name = 'agent.step' and status = 'ok'").select(
        "trace_id", F.get_json_object("output", "$.action").alias("action"), F.get_json_object("output", "$.observation").alias("observation"),
        F.col("attributes")["step_index"].cast("int").alias("step_index")
    )
    return found.filter("action is not null and observation is not null").orderBy("trace_id", "step_index")


def root_seconds(spans: DataFrame, name: str = "agent.run") -> DataFrame:
    return spans.filter((F.col("name") == name) & F.col("parent_span_id").isNull()).select("trace_id", F.col("duration_seconds").alias("total_seconds"))


def depth(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, depth) of the spans below a root, by pointer doubling.

    Each round doubles how far up a span sees, so the number of jobs is the logarithm of
    the depth.  Spans whose ancestors are missing or lead in a circle have no depth.
    """
    up = checkpoint(spans.select("trace_id", "span_id", F.col("parent_span_id").alias("up"), F.when(F.col("parent_span_id").isNotNull(), 1).otherwise(0).alias("depth")))
    for _ in range(up.count().bit_length() + 1):
        if up.filter("up is not null").isEmpty():
            break
        above = up.select("trace_id", F.col("span_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        open_ = up.filter("up is not null").join(above, ["trace_id", "up"]).select(
            "trace_id", "span_id", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth")
        )
        up = checkpoint(up.filter("up is null").unionByName(open_))
    return up.filter("up is null").select("trace_id", "span_id", "depth")
