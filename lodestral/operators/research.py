"""Research-run state as tables: lifecycle, budgets, history and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lodestral.functions.values import preview


def lifecycle(outcomes: DataFrame) -> DataFrame:
    """State of each (run_id, document_id) after its events in order of step.

    ``event`` is evidence (n_evidence of it), failure, shelve or reactivate.  Extraction
    makes a document active or, without evidence or on failure, unusable for good;
    curation moves active and shelved ones.
    """
    born = F.when((F.col("event") == "evidence") & (F.col("n_evidence") > 0), "active").when(F.col("event").isin("evidence", "failure"), "unusable")
    moved = F.when(F.col("event") == "shelve", "shelved").when(F.col("event") == "reactivate", "active")
    g = outcomes.groupBy("run_id", "document_id").agg(
        F.min_by(F.struct(born.alias("state"), F.col("reason"), F.col("step")), F.when(born.isNotNull(), F.col("step"))).alias("b"),
        F.max_by(F.struct(moved.alias("state"), F.col("reason"), F.col("step")), F.when(moved.isNotNull(), F.col("step"))).alias("m"),
    )
    use = F.col("m.state").isNotNull() & (F.col("b.state") == "active")
    return g.select(
        "run_id", "document_id", F.when(use, F.col("m.state")).otherwise(F.col("b.state")).alias("lifecycle"),
        F.when(use, F.col("m.reason")).otherwise(F.col("b.reason")).alias("reason"),
        F.when(use, F.col("m.step")).otherwise(F.col("b.step")).alias("updated_at_step")
    )


def lifecycle_counts(documents: DataFrame) -> DataFrame:
    """Per run: documents by state, and evidence of active and shelved ones."""
    is_ = lambda s: F.col("lifecycle") == s
    return documents.groupBy("run_id").agg(
        F.count("*").alias("documents"), *(F.count_if(is_(s)).alias(s) for s in ("active", "shelved", "unusable")),
        F.sum("n_evidence").alias("evidence"), F.sum(F.when(is_("active"), F.col("n_evidence")).otherwise(0)).alias("active_evidence"), F.sum(F.when(is_("shelved"), F.col("n_evidence")).otherwise(0)).alias("shelved_evidence"),
    )


def budgets(runs: DataFrame) -> DataFrame:
    """Remaining steps and research capacity; whether curation and finishing are open."""
    return runs.select(
        "run_id", F.greatest(F.col("max_steps") - F.col("current_step"), F.lit(0)).alias("remaining_steps"), F.greatest(F.col("max_researches") - F.col("researches"), F.lit(0)).alias("remaining_researches"),
        (F.col("active") + F.col("shelved") > 0).alias("curatable"), ((F.col("active") > 0) & (F.col("active") <= F.col("max_active_documents"))).alias("finishable"),
    )


def available_actions(budget: DataFrame) -> DataFrame:
    """Actions in order; on the last step only finish and stop."""
    some = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    more = F.col("remaining_steps") > 1
    return budget.select(
        "run_id",
        F.concat(
            some(more & (F.col("remaining_researches") > 0), "research"), some(more & F.col("curatable"), "curate_evidence"),
            some(F.col("finishable"), "finish"), F.array(F.lit("stop"))
        ).alias("actions"),
    )


def curation(active: Column, requested: Column) -> tuple[Column, Column, Column]:
    """(shelve, reactivate, changes): set differences both ways."""
    shelve, reactivate = F.array_sort(F.array_except(active, requested)), F.array_sort(F.array_except(requested, active))
    return shelve, reactivate, (F.size(shelve) + F.size(reactivate)) > 0


def curation_errors(requests: DataFrame, documents: DataFrame, max_active: DataFrame) -> DataFrame:
    """Illegal transitions and runs whose active documents would exceed the limit."""
    wanted = requests.join(documents, ["run_id", "document_id"], "left")
    legal = ((F.col("target") == "shelved") & (F.col("lifecycle") == "active")) | ((F.col("target") == "active") & (F.col("lifecycle") == "shelved"))
    bad = wanted.filter(~F.coalesce(legal, F.lit(False))).select("run_id", "document_id", F.lit("illegal transition").alias("error"))
    change = requests.groupBy("run_id").agg(F.sum(F.when(F.col("target") == "active", 1).otherwise(-1)).alias("change"))
    now = documents.groupBy("run_id").agg(F.count_if(F.col("lifecycle") == "active").alias("active"))
    over = change.join(now, "run_id").join(max_active, "run_id").filter(F.col("active") + F.col("change") > F.col("max_active_documents"))
    return bad.union(over.select("run_id", F.lit(None).cast("string").alias("document_id"), F.lit("too many active documents").alias("error")))


def latest(history: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Last action and number of actions of each run."""
    at = F.struct(*order)
    return history.groupBy(key).agg(
        F.max_by(F.struct(*columns), at).alias("last"), F.count("*").alias("steps")
    ).select(key, *(F.col(f"last.{c}").alias(f"last_{c}") for c in columns), "steps")


def research_history(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Roll-up of one research: retrieved, new, reused, selected, fetch and extraction outcomes."""
    kinds = ("retrieved", "new", "reused", "selected", "fetch_success", "fetch_failure", "extraction_success", "extraction_failure")
    return outcomes.groupBy(*keys).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))


def research_refs(links: DataFrame) -> DataFrame:
    """(run_id, document_id, refs): unique research references R1..Rn in order."""
    return links.groupBy("run_id", "document_id").agg(
        F.transform(F.array_sort(F.collect_set("research_index")), lambda i: F.concat(F.lit("R"), i.cast("string"))).alias("research_refs")
    )


def context(documents: DataFrame, evidence: DataFrame, max_evidence: int = 10, max_claim: int = 300) -> DataFrame:
    """Documents with a lifecycle, numbered D1..Dn, with their first evidence and previews."""
    numbered = documents.filter("lifecycle is not null").withColumn("ref", F.concat(F.lit("D"), F.row_number().over(W.partitionBy("run_id").orderBy("ord")).cast("string")))
    first = evidence.withColumn("nth", F.row_number().over(W.partitionBy("run_id", "document_id").orderBy("ord"))).filter(F.col("nth") <= max_evidence)
    listed = first.groupBy("run_id", "document_id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "evidence_id", preview(F.col("claim"), max_claim).alias("claim")))).alias("evidence")
    )
    return numbered.join(listed, ["run_id", "document_id"], "left")


def source_domains(evidence: DataFrame, domain: Column) -> DataFrame:
    return evidence.groupBy("run_id").agg(F.count_distinct(F.nullif(domain, F.lit(""))).alias("source_domains"))
