"""Row-level evaluation of retrieval and of answers.  Expected cells come first: a missing answer is a row too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import parse_many_values, parse_one_value
from ..functions.text import normalised_value

#: Fixed order in which a wrong cell's cause is looked for.
CAUSES = ("missing_response", "evidence_unreachable", "retrieval", "format", "generation")


def retrieval_outcome(required: Column, readable: Column, retrieved: Column) -> tuple[Column, Column]:
    """(reachable, success): success is null, not false, where the evidence was out of reach."""
    reachable = F.size(F.array_except(required, readable)) == 0
    return reachable, F.when(reachable, F.size(F.array_except(required, retrieved)) == 0)


def evidence_loss(required: Column, readable: Column, retrieved: Column) -> tuple[Column, Column]:
    """(out of reach, readable but not retrieved) evidence ids."""
    unreachable = F.array_except(required, readable)
    return unreachable, F.array_except(F.array_except(required, unreachable), retrieved)


def last_per_key(log: DataFrame, key: list[str], position: list[str]) -> DataFrame:
    """The last row of each key by position."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(p) for p in position])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def pending(planned: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Planned rows without a finished one."""
    return planned.join(done.select(*key).distinct(), key, "left_anti")


def expected_cells(requests: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """Every expected cell with its response, if any; status ``missing`` otherwise."""
    return requests.join(responses, key, "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def value_cells(cells: DataFrame, sibling_facts: DataFrame) -> DataFrame:
    """Evaluate one-value answers.  cells: cell_id, episode, activity, status, content, expected, context, reachable,
    success.  sibling_facts: episode, activity, field, value.  A wrong value that another activity of the episode has
    counts as confusion."""
    p = cells.withColumn("p", F.when(F.col("status") == "ok", parse_one_value("content")))
    p = p.withColumn("format_ok", F.coalesce("p.ok", F.lit(False))).withColumn("value", F.col("p.value"))
    p = p.withColumn("norm", normalised_value("value")).withColumn("want", normalised_value("expected"))
    p = p.withColumn("exact_match", F.coalesce(F.col("norm") == F.col("want"), F.lit(False)))
    p = p.withColumn("supported", F.when(F.col("value").isNotNull(), (F.col("norm") != "") & normalised_value("context").contains(F.col("norm"))))
    facts = sibling_facts.select("episode", F.col("activity").alias("a"), F.concat_ws(".", "activity", "field").alias("name"), normalised_value("value").alias("n"))
    wrong = p.where(F.col("value").isNotNull() & ~F.col("exact_match")).select("cell_id", "episode", "activity", "norm")
    confused = wrong.join(facts, (wrong["episode"] == facts["episode"]) & (F.col("activity") != F.col("a")) & (F.col("norm") == F.col("n"))).groupBy("cell_id").agg(F.array_sort(F.collect_list("name")).alias("confused_with"))
    p = p.join(confused, "cell_id", "left")
    p = p.withColumn("confusion", F.when(F.col("value").isNotNull() & ~F.col("exact_match"), F.col("confused_with").isNotNull()))
    p = p.withColumn("null_despite_evidence", F.coalesce(F.col("format_ok") & F.col("value").isNull() & F.col("success"), F.lit(False)))
    return p.withColumn("cause", cause(F.col("exact_match"), F.col("status"), F.col("reachable"), F.col("success"), F.col("format_ok"))).drop("p", "norm", "want")


def cause(exact: Column, status: Column, reachable: Column, success: Column, format_ok: Column) -> Column:
    """The first cause in order that explains a wrong cell; null for a right one."""
    return (
        F.when(exact, F.lit(None).cast("string")).when(status != "ok", F.lit(CAUSES[0])).when(~F.coalesce(reachable, F.lit(False)), F.lit(CAUSES[1]))
        .when(~F.coalesce(success, F.lit(False)), F.lit(CAUSES[2])).when(~format_ok, F.lit(CAUSES[3])).otherwise(F.lit(CAUSES[4]))
    )


def set_scores(expected: Column, predicted: Column, detectable: Column) -> dict[str, Column]:
    """Set-valued comparison; intrusion is null where none could be detected."""
    e, p = F.array_distinct(expected), F.array_distinct(predicted)
    extra = F.array_except(p, e)
    return {
        "exact": (F.size(extra) == 0) & (F.size(F.array_except(e, p)) == 0),
        "tp": F.size(F.array_intersect(p, e)).cast("long"),
        "fp": F.size(extra).cast("long"),
        "fn": F.size(F.array_except(e, p)).cast("long"),
        "unsupported": F.size(extra) > 0,
        "intrusion": F.when(F.size(detectable) > 0, F.arrays_overlap(extra, detectable)),
    }


def set_cells(cells: DataFrame) -> DataFrame:
    """Evaluate set answers.  cells: cell_id, condition (sufficient, insufficient), status, content, prompt_sha,
    answered_sha, expected and detectable (arrays of normalised values).  An answer to another prompt is stale; missing,
    stale and malformed answers stay in the denominators as failures."""
    stale = (F.col("status") != "missing") & ~F.col("prompt_sha").eqNullSafe(F.col("answered_sha"))
    x = cells.withColumn("status", F.when(stale, F.lit("stale_prompt")).otherwise(F.col("status")))
    x = x.withColumn("p", F.when(F.col("status") == "ok", parse_many_values("content")))
    x = x.withColumn("format_ok", F.coalesce("p.ok", F.lit(False))).withColumn("format_error", (F.col("status") == "ok") & ~F.col("format_ok"))
    flat = x.select("cell_id", F.explode("p.values").alias("v")).select("cell_id", normalised_value("v").alias("v")).groupBy("cell_id").agg(F.array_sort(F.collect_set("v")).alias("predicted"))
    x = x.join(flat, "cell_id", "left").withColumn("predicted", F.when(F.col("format_ok"), F.coalesce("predicted", F.array().cast("array<string>"))))
    s = set_scores(F.col("expected"), F.col("predicted"), F.col("detectable"))
    full, none = F.col("condition") == "sufficient", F.col("condition") == "insufficient"
    x = x.withColumn("exact_match", F.when(full, F.coalesce(s["exact"], F.lit(False)))).withColumn("correct_abstention", F.when(none, F.coalesce(F.size("predicted") == 0, F.lit(False)) & F.col("format_ok")))
    for n in ("tp", "fp", "fn"):
        x = x.withColumn(n, F.when(full & F.col("format_ok"), s[n]))
    return x.withColumn("unsupported", F.when(F.col("format_ok"), s["unsupported"])).withColumn("intrusion", F.when(F.col("format_ok"), s["intrusion"])).drop("p")


def fact_coverage(facts: DataFrame, corpus: DataFrame, context: DataFrame, key: list[str]) -> DataFrame:
    """Per key: facts whose sources are all in the corpus, and all in the context; the loss between the two.
    facts: key, fact, message (one row a source); corpus, context: key, message."""
    mark = lambda df, name: df.select(*key, "message").distinct().withColumn(name, F.lit(True))
    x = facts.join(mark(corpus, "c"), [*key, "message"], "left").join(mark(context, "x"), [*key, "message"], "left")
    per = x.groupBy(*key, "fact").agg(F.bool_and(F.col("c").isNotNull()).alias("in_corpus"), F.bool_and(F.col("x").isNotNull()).alias("in_context"))
    out = per.groupBy(*key).agg(F.count("*").alias("facts"), F.count_if("in_corpus").alias("facts_in_corpus"), F.count_if("in_context").alias("facts_in_context"))
    return out.withColumn("retrieval_loss", F.col("facts_in_corpus") - F.col("facts_in_context"))


def flags(answer: Column, context: Column, obsolete: Column, salient: str) -> dict[str, Column]:
    """Automatic flags of a free answer: obsolete phrases used, and salient tokens that the context does not have."""
    tokens = F.array_distinct(F.regexp_extract_all(answer, F.lit(salient), F.lit(0)))
    return {"obsolete_used": F.filter(obsolete, lambda o: F.lower(answer).contains(F.lower(o))), "unsupported_tokens": F.filter(tokens, lambda t: ~context.contains(t))}


def merge_judgements(cells: DataFrame, judgements: DataFrame, key: list[str]) -> DataFrame:
    """Approved human judgements; every other cell is pending."""
    approved = judgements.where(F.col("review") == "approved").drop("review")
    return cells.join(approved, key, "left").withColumn("judgement", F.coalesce("judgement", F.lit("pending")))
