"""Language-model steps of a research run with pluggable models.

A model is a function of a list of prompts that returns as many responses; it is shipped
to the executors and called once per Arrow batch.  Every parser is a Column expression,
so a response table can be stored and read again without calling the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestral.functions.urls import bare_domain
from lodestral.functions.values import claims, unfence, without_thoughts

Model = Callable[[list[str]], list[str]]


def fake_model(answer: str = "{}") -> Model:
    """The same response to every prompt."""
    return lambda prompts: [answer] * len(prompts)


def generate(prompt: Column, model: Model, attempts: int = 2) -> Column:
    """struct(response, error, attempts, prompt_tokens, completion_tokens) of each prompt; errors are data."""

    @F.pandas_udf("response string, error string, attempts int, prompt_tokens long, completion_tokens long")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            prompts, out, error, tried = part.fillna("").tolist(), None, None, 0
            while out is None and tried < attempts:
                tried += 1
                try:
                    out, error = list(model(prompts)), None
                    if len(out) != len(prompts):
                        out, error = None, "response count differs from prompt count"
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
            answers = out if out is not None else [None] * len(prompts)
            yield pd.DataFrame(
                {
                    "response": answers, "error": error, "attempts": tried, "prompt_tokens": [len(p.split()) for p in prompts],
                    "completion_tokens": [len((a or "").split()) for a in answers]
                }
            )

    return run(prompt)


def usage(calls: DataFrame, *keys: str) -> DataFrame:
    total = F.col("prompt_tokens") + F.col("completion_tokens")
    return calls.groupBy(*keys).agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum(total).alias("total_tokens"),
        F.count("*").alias("calls")
    )


def _string(v: Column, path: str) -> Column:
    found = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.nullif(F.trim(F.try_variant_get(found, "$", "string")), F.lit("")))


def _number(v: Column, path: str) -> Column:
    """A JSON number, or a boolean as 0 or 1; anything else is null."""
    found = F.try_variant_get(v, path, "variant")
    kind = F.schema_of_variant(found)
    return F.when(kind == "BOOLEAN", F.try_variant_get(found, "$", "boolean").cast("double")).when(
        kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(found, "$", "double")
    )


def evidence(responses: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(evidence, failures) of chunk responses (document_id, position, response, error).

    The first ``most`` items of each chunk count; an item without a claim, an odd response
    or a model error fails its whole document.
    """
    found = claims(F.col("response"))
    items = F.slice(F.try_variant_get(found, "$", "array<variant>"), 1, most)
    parsed = responses.select(
        "document_id", "position", items.alias("items"),
        F.when(F.col("error").isNotNull(), "llm_error").when(
            F.try_parse_json(unfence(F.col("response"))).isNull(), "invalid_json"
        ).when(items.isNull(), "invalid_schema").alias("bad")
    )
    rows = parsed.select("document_id", "position", "bad", F.posexplode_outer("items").alias("nth", "item"))
    rows = rows.select(
        "document_id", "position", "nth", _string(F.col("item"), "$.claim").alias("claim"),
        _string(F.col("item"), "$.supporting_text").alias("supporting_text"), _number(F.col("item"), "$.confidence").alias("confidence"), "bad"
    )
    rows = rows.withColumn("bad", F.coalesce("bad", F.when(F.col("nth").isNotNull() & F.col("claim").isNull(), "invalid_schema")))
    failures = rows.filter("bad is not null").groupBy("document_id").agg(F.min_by("bad", F.struct("position", F.coalesce("nth", F.lit(-1)))).alias("reason"))
    good = rows.filter("nth is not null").join(failures, "document_id", "left_anti").drop("bad")
    order = F.row_number().over(W.partitionBy("document_id").orderBy("position", "nth"))
    return good.withColumn("ord", order - 1).withColumn("evidence_id", F.sha2(F.concat_ws("|", "document_id", "position", "nth"), 256)), failures


def selection(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Selected candidates (run_id, ref, result_id, ord) in candidate order; an unknown reference raises."""
    refs = F.from_json(unfence(F.col("response")), "selected_refs array<string>")["selected_refs"]
    chosen = responses.select("run_id", F.explode(F.array_distinct(refs)).alias("ref"))
    odd = chosen.join(candidates, ["run_id", "ref"], "left_anti").first()
    if odd:
        raise ValueError(f"unknown reference {odd['ref']}")
    return candidates.join(chosen, ["run_id", "ref"], "left_semi").orderBy("run_id", "ord")


def number_candidates(results: DataFrame) -> DataFrame:
    return results.withColumn("ref", F.concat(F.lit("C"), F.row_number().over(W.partitionBy("run_id").orderBy("ord")).cast("string")))


def actions(responses: DataFrame, available: DataFrame) -> DataFrame:
    """Parsed policy responses: type, params and ``error`` where they aren't valid now."""
    body = F.from_json(
        unfence(without_thoughts(F.col("response"))),
        "type string, rationale string, params struct<query:string,route:string,source_domains:array<string>,active_refs:array<string>>"
    )
    p = responses.select("run_id", body.alias("a")).select("run_id", "a.type", "a.rationale", "a.params").join(available, "run_id", "left")
    domains = F.coalesce("params.source_domains", F.array().cast("array<string>"))
    error = (
        F.when(F.col("type").isNull(), "invalid action").when(~F.coalesce(F.array_contains("actions", F.col("type")), F.lit(False)), "action not available")
        .when((F.col("type") == "research") & (F.trim(F.coalesce("params.query", F.lit(""))) == ""), "blank query")
        .when((F.col("type") == "research") & ~F.coalesce("params.route", F.lit("web")).isin("web", "local"), "unknown route")
        .when(
            (F.col("params.route") == "local") & (F.size(domains) > 0), "domains need the web route"
        ).when(F.size(F.array_distinct(domains)) < F.size(domains), "duplicate domains")
        .when(F.exists(domains, lambda d: ~bare_domain(d)), "bad domain")
    )
    return p.select("run_id", "type", "rationale", "params", error.alias("error"))


def rule_action(step: Column) -> Column:
    """Research, then finish, then stop."""
    return F.when(step == 0, "research").when(step == 1, "finish").otherwise("stop")


def synthesis_prompt(groups: DataFrame, queries: DataFrame) -> DataFrame:
    """(run_id, prompt): the question and each source's claims under its reference."""
    block = F.concat(F.lit("["), F.col("ref"), F.lit("]\n"), F.array_join(F.transform("items", lambda i: F.concat(F.lit("- "), i["claim"])), "\n"))
    joined = groups.select("run_id", "position", block.alias("block")).groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("position", "block"))).alias("b"))
    text = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return queries.join(joined, "run_id").select("run_id", F.concat(F.lit("Question: "), "query", F.lit("\n\nSources:\n"), text).alias("prompt"))
