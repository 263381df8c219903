"""Whether files of an experiment can be made again, and whether its parts stay apart.

Tables are compared as multisets by fingerprints: the number of rows and two sums of 64-bit row hashes (128 bits together), by
bucket of the key.  Sums merge in any order, so a table is one partial aggregation, and only rows of buckets whose
fingerprints differ are compared one by one.  Equal tables are never joined.

Values are looked for inside texts by one automaton of all values (see ``naming``), not by texts times values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .naming import LIMIT, found_forms
from .quality import duplicates, field_rules, union, violation

BUCKETS = 4096
#: Fixed strings that lead back to a source; none may be in a prompt, in any case.
FORBIDDEN_SUBSTRINGS = (
    "http://",
    "https://",
    "github.com/advisories",
    "advisory-database",
    "github-reviewed",
    "nvd.nist.gov",
    "osv.dev",
)
#: Fixed patterns of record numbers.
RECORD_IDS = {"ghsa_id": r"(?i)GHSA(-[23456789cfghjmpqrvwx]{4}){3}", "cve_id": r"(?i)CVE-[0-9]{4}-[0-9]{3,}"}


def row_hash(columns: list[str], seed: int) -> Column:
    """A 64-bit hash of values and of which of them are null (a null alone changes no hash)."""
    cells = [F.col(f"`{c}`") for c in columns]
    return F.xxhash64(F.lit(seed), *cells, *[c.isNull() for c in cells])


def fingerprints(rows: DataFrame, columns: list[str], by: list[Column] | None = None) -> DataFrame:
    """(by, n, a, b): number of rows and sums of two hashes of each, in any order and partitioning the same."""
    sums = [F.sum(row_hash(columns, seed).cast("decimal(38,0)")).alias(name) for name, seed in (("a", 17), ("b", 4711))]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *sums)


def differences(saved: DataFrame, again: DataFrame, key: list[str], code: str = "E-REPRODUCE", columns: list[str] | None = None) -> DataFrame:
    """Violations where a table made again (``again``) differs from the one that was saved, in the columns of both: missing
    (not saved), unexpected (saved only), changed, or repeated another number of times."""
    columns = columns or [c for c in again.columns if c in saved.columns]
    bucket = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in key]), F.lit(BUCKETS)).alias("_bucket")
    prints = [fingerprints(x, columns, [bucket]) for x in (saved, again)]
    l, r = (p.select("_bucket", F.struct("n", "a", "b").alias(s)) for p, s in zip(prints, ("_l", "_r")))
    # a few thousand rows at most
    unlike = cut(l.join(r, "_bucket", "full").where(~F.col("_l").eqNullSafe(F.col("_r"))).select("_bucket"))
    near = lambda x, name: x.select(*columns, bucket).join(F.broadcast(unlike), "_bucket", "left_semi").groupBy(*key, row_hash(columns, 17).alias("_h"), row_hash(columns, 4711).alias("_g")).agg(F.count("*").alias(name))
    same = F.lit(True)
    a, b = near(saved, "_saved").alias("a"), near(again, "_again").alias("b")
    for c in [*key, "_h", "_g"]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    x = a.join(b, same, "full").select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in key], F.coalesce("_saved", F.lit(0)).alias("_s"), F.coalesce("_again", F.lit(0)).alias("_m"))
    per = x.where("_s <> _m").groupBy(*key).agg(F.sum("_s").alias("_s"), F.sum("_m").alias("_m"))
    what = F.when(F.col("_s") == 0, "missing").when(F.col("_m") == 0, "unexpected").when(F.col("_s") == F.col("_m"), "changed").otherwise("repeated")
    return violation(per, code, key, what)


def disjoint(rows: DataFrame, split: str, ids: list[str], code: str = "E-SPLIT") -> DataFrame:
    """Ids that occur in more than one split: one violation for each kind of id and id."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("id")) for c in ids]))
    x = rows.select(split, pairs.alias("p")).where("p.id IS NOT NULL").groupBy("p.kind", "p.id").agg(F.array_join(F.array_sort(F.collect_set(F.col(split).cast("string"))), ",").alias("splits"), F.count_distinct(split).alias("n"))
    return violation(x.where("n > 1"), code, ["kind", "id"], F.col("splits"))


def paired(rows: DataFrame, key: list[str], condition: str, allowed: list[str], code: str = "E-PAIR-FIELD") -> DataFrame:
    """Rows of one key under several conditions must agree in all columns but ``condition`` and ``allowed``: the columns in which
    they do not."""
    fields = [c for c in rows.columns if c not in (*key, condition, *allowed)]
    kinds = [F.struct(F.lit(c).alias("field"), F.count_distinct(F.struct(F.col(c))).alias("n")) for c in fields]
    x = rows.groupBy(*key).agg(F.array(*kinds).alias("f")) if fields else rows.limit(0).select(*key, F.array(F.struct(F.lit("").alias("field"), F.lit(0).alias("n"))).alias("f"))
    unlike = F.array_join(F.array_sort(F.transform(F.filter("f", lambda s: s["n"] > 1), lambda s: s["field"])), ",")
    return violation(x.withColumn("d", unlike).where("d <> ''"), code, key, F.col("d"))


def audit(snapshot: DataFrame, candidates: DataFrame, exclusions: DataFrame, key: str, criteria: list[str]) -> DataFrame:
    """A snapshot's records must be a candidate or excluded, once, by a known criterion."""
    of = lambda x, name: x.groupBy(key).agg(F.count("*").alias(name))
    x = of(snapshot, "s").join(of(candidates, "c"), key, "full").join(of(exclusions, "e"), key, "full")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = {"E-AUDIT-MISSING": (zero("s") == 0) | (zero("c") + zero("e") > 0), "E-AUDIT-UNKNOWN": zero("s") > 0, "E-AUDIT-BOTH": (zero("c") == 0) | (zero("e") == 0), "E-AUDIT-DUP": (zero("c") <= 1) & (zero("e") <= 1)}
    return union([field_rules(x, [key], rules), violation(exclusions.where(~F.coalesce(F.col("criterion").isin(*criteria), F.lit(False))), "E-CRITERION", [key], F.col("criterion"))])


def value_places(texts: DataFrame, values: DataFrame, scope: list[str], text_id: str, limit: int = LIMIT) -> DataFrame:
    """(scope, value_id, text_id): the texts (scope, text_id, content) that hold a value (scope, value_id, value) of their scope
    somewhere, letter for letter.  Null and empty values are nowhere."""
    asked = cut(values.select(*scope, "value_id", F.col("value").alias("form")).where("form <> ''"))
    found = found_forms(texts.select(*scope, text_id, F.col("content").alias("form")), asked, "raw", limit)
    return found.join(asked, [*scope, "form"]).select(*scope, "value_id", text_id)


def oracle(questions: DataFrame, answers: DataFrame, messages: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Expected answers (question_id, episode, activity, value, evidence_id) against questions (question_id, text) and messages
    (message_id, episode, activity, content): one a question; the value trimmed and in exactly one message of its activity,
    its evidence; not in the question."""
    values = answers.select("episode", "activity", F.col("question_id").alias("value_id"), "value")
    at = value_places(messages, values, ["episode", "activity"], "message_id", limit).groupBy("value_id").agg(F.count("*").alias("n"), F.min("message_id").alias("only"))
    told = answers.join(at.withColumnRenamed("value_id", "question_id"), "question_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    unique = violation(told.where(~((F.col("n") == 1) & F.coalesce(F.col("only") == F.col("evidence_id"), F.lit(False)))), "E-UNIQUE", ["question_id"], F.col("n"))
    inside = questions.select("question_id", "text").join(answers.select("question_id", "value"), "question_id").where(F.contains("text", F.col("value")) & (F.col("value") != ""))
    evidence = answers.join(messages.select(F.col("message_id").alias("evidence_id"), F.col("activity").alias("_of")), "evidence_id", "left")
    both = questions.select("question_id").distinct().withColumn("q", F.lit(1)).join(answers.groupBy("question_id").agg(F.count("*").alias("a")), "question_id", "full")
    return union([
        unique, violation(inside, "E-QUESTION-LEAK", ["question_id"], F.col("value")),
        violation(evidence.where(~F.coalesce(F.col("_of") == F.col("activity"), F.lit(False))), "E-EVIDENCE", ["question_id"], F.col("evidence_id")),
        violation(both.where("q IS NULL OR a IS NULL OR a > 1"), "E-ORACLE-ROWS", ["question_id"], F.coalesce(F.col("a"), F.lit(0))),
        field_rules(answers, ["question_id"], {"E-TRIM": F.col("value") == F.trim("value")}),
    ])


def retrieval(rows: DataFrame, accessible: DataFrame, key: list[str], k: int) -> DataFrame:
    """Retrievals (key, rank, message_id, score) against what a key may read (key, message_id): nothing else, each once, ranks from
    1 without gaps, scores that do not rise, and as many as there are, up to k."""
    n = accessible.groupBy(*key).agg(F.count("*").alias("n"))
    per = rows.groupBy(*key).agg(F.count("*").alias("m"), F.max("rank").alias("last"), F.count_distinct("message_id").alias("different"), F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"))
    x = n.join(per, key, "left")
    falls = F.forall(F.sequence(F.lit(1), F.greatest(F.size("s") - 1, F.lit(1))), lambda i: (i >= F.size("s")) | (F.get("s", i)["score"] <= F.get("s", i - 1)["score"]))
    rules = {"E-TOP-K": F.coalesce("m", F.lit(0)) == F.least("n", F.lit(k)), "E-RANK": F.col("m").isNull() | ((F.col("last") == F.col("m")) & (F.col("different") == F.col("m"))), "E-SCORE-ORDER": F.col("m").isNull() | falls}
    return union([field_rules(x, key, rules), violation(rows.join(accessible, [*key, "message_id"], "left_anti"), "E-ACCESS", [*key, "message_id"])])


def prompt_leaks(rows: DataFrame, key: list[str], text: str, code: str = "E-PROMPT") -> DataFrame:
    """Texts with a record number or a forbidden string, one violation for each of them."""
    low = F.lower(F.col(text))
    found = [F.when(F.col(text).rlike(p), F.lit(n)) for n, p in RECORD_IDS.items()] + [F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in FORBIDDEN_SUBSTRINGS]
    return violation(rows.withColumn("_leak", F.explode(F.array_compact(F.array(*found)))), code, key, F.col("_leak"))


def unique_ids(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    return union([duplicates(rows, [key], f"E-DUP-{name}") for name, (rows, key) in tables.items()])
