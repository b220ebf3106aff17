"""Evidence groups, citation resolution and tab-separated answers."""

from __future__ import annotations

import csv
import io
import json

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestral.functions.values import citations, preview


def evidence_groups(evidence: DataFrame, documents: DataFrame, most: int = 10, size: int = 300) -> DataFrame:
    """Active documents in order, S1..Sn per run, each with its first ``most`` evidence items."""
    active = documents.filter("lifecycle = 'active'")
    first = evidence.withColumn("nth", F.row_number().over(W.partitionBy("run_id", "document_id").orderBy("ord"))).filter(F.col("nth") <= most)
    groups = first.groupBy("run_id", "document_id").agg(F.array_sort(F.collect_list(F.struct("ord", preview(F.col("claim"), size).alias("claim")))).alias("items"))
    joined = groups.join(active.select("run_id", "document_id", F.col("ord").alias("doc_ord")), ["run_id", "document_id"])
    position = F.row_number().over(W.partitionBy("run_id").orderBy("doc_ord"))
    return joined.withColumn("position", position).withColumn("ref", F.concat(F.lit("S"), F.col("position").cast("string")))


def resolve_citations(answers: DataFrame, groups: DataFrame) -> DataFrame:
    """(run_id, cite_order, position, document_id): mentions in order, once each; others dropped."""
    mentioned = answers.select("run_id", F.posexplode(citations(F.col("answer"))).alias("cite_order", "position"))
    return mentioned.join(groups.select("run_id", "position", "document_id"), ["run_id", "position"])


#: Keys of the JSON object that an answer of each kind consists of; no others may be there.
SHAPES = {"item": {"value"}, "set": {"items"}, "list": {"items"}, "table": {"columns", "rows"}}


def _cell(value) -> str:
    """A scalar as text: strings trimmed and not blank, numbers and truth values as Python writes them."""
    if isinstance(value, str) and (value := value.strip()) or isinstance(value, bool | int | float):
        return str(value)
    raise ValueError(f"not a scalar: {value!r}")


def _list(value) -> list:
    if not isinstance(value, list) or not value:
        raise ValueError("not a list of one or more")
    return value


def tsv(kind: str, payload: str) -> str:
    """A fenced block for an answer of kind item, set, list or table; ValueError if it doesn't fit.

    An item is one scalar, a set or list one or more of them (a set keeps the first of equal
    texts).  A table has columns with different names and rows as wide as these, whose
    cells may be null.
    """
    data = json.loads(payload)
    if not isinstance(data, dict) or data.keys() != SHAPES[kind]:
        raise ValueError(f"not the keys of {kind}")
    if kind == "table":
        names = [_cell(c) if isinstance(c, str) else _cell(None) for c in _list(data["columns"])]
        lines = [["" if c is None else _cell(c) for c in _row] if isinstance(_row, list) else _list(None) for _row in _list(data["rows"])]
        if len(set(names)) < len(names) or {len(line) for line in lines} != {len(names)}:
            raise ValueError("columns repeat or rows differ in width")
    else:
        cells = [_cell(data["value"])] if kind == "item" else [_cell(i) for i in _list(data["items"])]
        names, lines = ["Value" if kind == "item" else "Item"], [[c] for c in (dict.fromkeys(cells) if kind == "set" else cells)]
    out = io.StringIO()
    csv.writer(out, delimiter="\t", lineterminator="\n").writerows([names, *lines])
    return f"```tsv\n{out.getvalue()}```"


def render(answers: DataFrame) -> DataFrame:
    """Adds ``block`` and ``error`` to (kind, payload); an answer that doesn't fit its kind has an error."""

    @F.pandas_udf("block string, error string")
    def make(kind: pd.Series, payload: pd.Series) -> pd.DataFrame:
        def one(k: str | None, p: str | None) -> tuple[str | None, str | None]:
            try:
                return tsv(k, p), None
            except (ValueError, KeyError, TypeError, RecursionError):
                return None, "invalid answer"

        return pd.DataFrame([one(k, p) for k, p in zip(kind, payload)], columns=["block", "error"], dtype=object)

    return answers.withColumn("r", make("kind", "payload")).select(*answers.columns, "r.block", "r.error")
