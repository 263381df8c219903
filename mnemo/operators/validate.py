"""Validators of the experiment's files.  Each gives violations (code, key, detail), empty when all is well.

Inputs are flat tables; keys name the scenario, question, mode, operation or cell at fault.  A check looks at all rows in
one pass, or joins two tables on their keys; none compares rows with all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keys import private
from .perimeter import ACTIVE, RETRACTED, SUPERSEDED
from .quality import duplicates, field_rules, missing_reference, union, violation

#: Fixed values of annotations, conditions, categories' opposite, operations and answer classes.
CONDITIONS = ("C0", "C1", "C2")
DIAGNOSTIC = "FULL_HISTORY"
MODES = (*CONDITIONS, DIAGNOSTIC)
ANSWER_CLASSES = ("complete", "partial", "incorrect", "correct_abstention")
EXPECTED_BEHAVIORS = ("complete_answer", "abstention")
OPERATIONS = ("ADD", "UPDATE", "DELETE", "NOOP")
STATES = (ACTIVE, SUPERSEDED, RETRACTED)
ABSENT = "absent_information"
CROSS = "cross_session_link"
KEY = ["scenario", "question", "mode"]
#: Fields that only an oracle has.
ORACLE = ("expected_answer", "required_facts", "required_evidence_ids", "mandatory_facts", "expected_behavior", "obsolete_information")


def without_oracle(rows: DataFrame, forbidden: tuple[str, ...] = ORACLE) -> DataFrame:
    """``rows``, for a step that must not see the oracle; a table with one of its fields is an error."""
    if seen := sorted(set(rows.columns) & set(forbidden)):
        raise PermissionError("oracle fields reach a step that must not read them: " + ", ".join(seen))
    return rows


def all_present(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner") -> DataFrame:
    """An inner join that fails where a row of ``left`` has no partner."""
    (there,) = private(left.join(right.limit(0), key), "there")
    x = left.join(right.withColumn(there, F.lit(True)), key, "left")
    lost = F.raise_error(F.concat_ws("|", F.lit("no partner"), *[F.col(k).cast("string") for k in key])).cast("boolean")
    return x.where(F.coalesce(there, lost)).drop(there)


def group_of(question: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """The group that lists a question, else an error."""
    out = F.raise_error(F.concat(F.lit("question of no group: "), question))
    for name, ids in reversed(list(groups.items())):
        out = F.when(question.isin(*ids), F.lit(name)).otherwise(out)
    return out


def chosen(rows: DataFrame, modes: list[str] | None = None, questions: list[str] | None = None, limit: int | None = None, order: list[str] = KEY) -> DataFrame:
    """Rows to run: of some modes and questions, the first ``limit`` in their order."""
    x = rows if modes is None else rows.where(F.col("mode").isin(*modes))
    x = x if questions is None else x.where(F.col("question").isin(*questions))
    return x if limit is None else x.orderBy(*order).limit(limit)


def totals(rows: DataFrame, column: str, expected: dict[str, int], code: str = "E-COUNT") -> DataFrame:
    """Values of a column that do not occur as often as expected, those that are absent too."""
    want = rows.sparkSession.createDataFrame(list(expected.items()), f"{column} string, want long")
    n = want.join(rows.groupBy(column).agg(F.count("*").alias("n")), column, "left")
    return violation(n.where(F.coalesce("n", F.lit(0)) != F.col("want")), code, [column], F.coalesce("n", F.lit(0)))


def both_sides(rows: DataFrame, source: DataFrame, key: list[str], fields: list[str], missing: str, match: str, extra: str | None = None) -> DataFrame:
    """Rows without their source row (``missing``), fields that differ from it (``match``, one violation a field, null
    equal to null), and source rows that no row names (``extra``)."""
    pick = lambda df, mark: df.select(*key, F.struct(*fields).alias(mark))
    x = pick(rows, "_l").join(pick(source, "_r"), key, "full")
    found = [violation(x.where("_r IS NULL"), missing, key)]
    if extra:
        found.append(violation(x.where("_l IS NULL"), extra, key))
    unlike = F.array_compact(F.array(*[F.when(~F.col(f"_l.{f}").eqNullSafe(F.col(f"_r.{f}")), F.lit(f)) for f in fields]))
    met = x.where("_l IS NOT NULL AND _r IS NOT NULL").select(*key, F.explode(unlike).alias("_f"))
    return union([*found, violation(met, match, key, F.col("_f"))])


def annotations(rows: DataFrame, retrieval: DataFrame, inputs: DataFrame, per_mode: int) -> DataFrame:
    """Human annotations (key, reachable, retrieval_success, answer_class, expected_behavior) in themselves, against the
    retrieval's outcome and against the inputs that were run."""
    known = F.col("mode").isin(*MODES)
    want = F.when(F.col("reachable"), "complete_answer").otherwise("abstention")
    rules = {
        "E-VALUE": known,
        "E-VALUE-CLASS": ~known | F.col("answer_class").isin(*ANSWER_CLASSES),
        "E-VALUE-BEHAVIOR": ~known | F.col("expected_behavior").isin(*EXPECTED_BEHAVIORS),
        "E-RETRIEVAL-NULL": ~known | F.col("reachable") | F.col("retrieval_success").isNull(),
        "E-DIAGNOSTIC": ~known | (F.col("mode") != DIAGNOSTIC) | F.col("retrieval_success").isNull(),
        "E-ABSTENTION": ~known | (F.col("answer_class") != "correct_abstention") | ~F.col("reachable"),
        "E-EXPECTED": ~known | ~F.col("expected_behavior").isin(*EXPECTED_BEHAVIORS) | (F.col("expected_behavior") == want),
    }
    fields = ["reachable", "retrieval_success"]
    return union([
        field_rules(rows, KEY, rules), duplicates(rows, KEY), totals(rows, "mode", dict.fromkeys(MODES, per_mode)),
        both_sides(rows.where(F.col("mode").isin(*CONDITIONS)), retrieval, KEY, fields, "E-RETRIEVAL-MISSING", "E-RETRIEVAL-MATCH"),
        both_sides(rows, inputs, KEY, fields, "E-INPUT-MISSING", "E-INPUT-MATCH", "E-INPUT-MISSING"),
    ])


def scenario(sessions: DataFrame, messages: DataFrame, perimeters: DataFrame, n_sessions: int) -> DataFrame:
    """Structure of conversations.  sessions: scenario, session, place (from 1), order; messages: scenario, session, place,
    message, order, role, content, declared (the session that it names); perimeters: scenario, condition, session."""
    sk, mk = ["scenario", "session"], ["scenario", "session", "message"]
    count = sessions.groupBy("scenario").agg(F.count("*").alias("n"))
    last = sessions.groupBy("scenario").agg(F.max(F.struct("place", "session")).alias("x")).select("scenario", F.lit("C1").alias("condition"), F.col("x.session").alias("session"))
    canon = last.union(sessions.select("scenario", F.lit("C2"), "session"))
    pk = ["scenario", "condition", "session"]
    return union([
        violation(count.where(F.col("n") != n_sessions), "E-COUNT", ["scenario"], F.col("n")),
        field_rules(sessions, sk, {"E-ORDER": F.col("order") == F.col("place")}),
        violation(sessions.join(messages, sk, "left_anti"), "E-COUNT-MESSAGES", sk),
        field_rules(messages, mk, {"E-ORDER": F.col("order") == F.col("place"), "E-FIELD-ROLE": F.col("role").isin("user", "assistant"), "E-FIELD-CONTENT": F.trim("content") != "", "E-EVIDENCE-SESSION": F.col("declared").eqNullSafe(F.col("session"))}),
        duplicates(sessions, sk), duplicates(messages, ["scenario", "message"]),
        violation(perimeters.join(sessions.select(*sk), sk, "left_anti"), "E-PERIMETER-UNKNOWN", pk),
        violation(perimeters.join(canon, pk, "left_anti"), "E-PERIMETER", pk), violation(canon.join(perimeters, pk, "left_anti"), "E-PERIMETER", pk),
    ])


def questions(rows: DataFrame, evidence: DataFrame, messages: DataFrame, perimeters: DataFrame, categories: list[str], declared_totals: DataFrame) -> DataFrame:
    """Questions (scenario, question, category, text, present, note) with their evidence (scenario, question, message) and
    declared reachability (rows: c0, c1, c2): computed from the perimeters, for each condition.  declared_totals: scenario,
    condition, n (reachable questions)."""
    qk = ["scenario", "question"]
    e = evidence.join(messages.select("scenario", "message", "session"), ["scenario", "message"], "left")
    known = e.where("session IS NOT NULL")
    grid = rows.select(*qk, "present", F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c.lower()).alias("declared")) for c in CONDITIONS])).alias("x")).select(*qk, "present", "x.*")
    inside = perimeters.select("scenario", "condition", "session").distinct().withColumn("_in", F.lit(True))
    per = grid.select(*qk, "condition").join(known, qk).join(inside, ["scenario", "condition", "session"], "left").groupBy(*qk, "condition").agg(F.bool_and(F.col("_in").isNotNull()).alias("reach"))
    grid = grid.join(per, [*qk, "condition"], "left").withColumn("computed", F.col("present") & F.coalesce("reach", F.lit(False)))
    has = rows.join(evidence.select(*qk).distinct().withColumn("_has", F.lit(True)), qk, "left").withColumn("has", F.coalesce("_has", F.lit(False)))
    sessions = known.groupBy(*qk).agg(F.count_distinct("session").alias("n"))
    cross = rows.where(F.col("category") == CROSS).join(sessions, qk, "left").where(F.coalesce("n", F.lit(0)) < 2)
    covered = grid.where("declared").groupBy("scenario", "condition").agg(F.count("*").alias("n"))
    wanted = rows.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    absent = rows.select("scenario").distinct().join(F.broadcast(wanted)).join(rows, ["scenario", "category"], "left_anti")
    return union([
        duplicates(rows, qk), duplicates(evidence, [*qk, "message"], "E-DUP-EVIDENCE"),
        field_rules(has, qk, {
            "E-CATEGORY": F.col("category").isin(*categories), "E-FIELD": F.trim("text") != "",
            "E-ABSENT": (F.col("category") == ABSENT) != F.col("present"), "E-ABSENT-EVIDENCE": F.col("present") == F.col("has"),
            "E-ABSENT-NOTE": F.col("present") | (F.trim(F.coalesce("note", F.lit(""))) != ""),
        }),
        violation(e.where("session IS NULL"), "E-EVIDENCE-MISSING", [*qk, "message"]),
        violation(grid.where(~F.col("declared").eqNullSafe(F.col("computed"))), "E-REACH", [*qk, "condition"], F.col("computed")),
        violation(cross, "E-CROSS", qk, F.coalesce("n", F.lit(0))),
        violation(absent, "E-CATEGORY-MISSING", ["scenario", "category"]),
        both_sides(declared_totals, covered, ["scenario", "condition"], ["n"], "E-COVERAGE", "E-COVERAGE", "E-COVERAGE"),
    ])


def operations(ops: DataFrame, messages: DataFrame) -> DataFrame:
    """Expected operations (scenario, place, op, kind, claim_key, session_order, supersedes, message, message_session) in
    their order; messages: scenario, message, session_order."""
    ok = ["scenario", "op"]
    made = ops.select("scenario", F.col("op").alias("supersedes"), F.col("claim_key").alias("_key"), F.lit(True).alias("_there"))
    x = ops.join(made, ["scenario", "supersedes"], "left")
    before = F.lag("session_order").over(Window.partitionBy("scenario").orderBy("place"))
    x = x.join(messages.select("scenario", "message", F.col("session_order").alias("_of")), ["scenario", "message"], "left").withColumn("_before", before)
    named, change = F.col("supersedes").isNotNull(), F.col("kind").isin("UPDATE", "DELETE")
    kinds = ops.groupBy("scenario").agg(F.collect_set("kind").alias("k"))
    lack = kinds.select("scenario", F.explode(F.array_except(F.array(*map(F.lit, OPERATIONS)), F.col("k"))).alias("kind"))
    return union([
        duplicates(ops, ok),
        field_rules(x, ok, {
            "E-OPS-KIND": F.col("kind").isin(*OPERATIONS), "E-OPS-TARGET": ~change | named, "E-OPS-NO-TARGET": ~F.col("kind").isin("ADD", "NOOP") | ~named,
            "E-OPS-UNKNOWN": ~named | F.coalesce("_there", F.lit(False)), "E-OPS-KEY": F.col("_there").isNull() | (F.col("_key") == F.col("claim_key")),
            "E-OPS-ORDER": F.col("_before").isNull() | (F.col("_before") <= F.col("session_order")),
            "E-PROVENANCE": F.col("_of").isNotNull(), "E-PROVENANCE-SESSION": F.col("_of").isNull() | (F.col("_of") == F.col("session_order")),
        }),
        violation(lack, "E-OPS", ["scenario", "kind"]),
    ])


def expected_state(entries: DataFrame, ops: DataFrame) -> DataFrame:
    """Expected entries (scenario, entry, claim_key, status, superseded_by) against the operations (scenario, op, claim_key)."""
    ek, by = ["scenario", "entry"], F.col("superseded_by").isNotNull()
    x = entries.join(ops.select("scenario", F.col("op").alias("superseded_by")).distinct().withColumn("_there", F.lit(True)), ["scenario", "superseded_by"], "left")
    keys = lambda df: df.select("scenario", "claim_key").distinct()
    return union([
        field_rules(x, ek, {"E-STATE": F.col("status").isin(*STATES), "E-STATE-ACTIVE": (F.col("status") != ACTIVE) | ~by, "E-STATE-BY": ~F.col("status").isin(SUPERSEDED, RETRACTED) | by, "E-STATE-UNKNOWN": ~by | F.coalesce("_there", F.lit(False))}),
        violation(keys(ops).join(keys(entries), ["scenario", "claim_key"], "left_anti"), "E-STATE-CLAIM", ["scenario", "claim_key"]),
        violation(keys(entries).join(keys(ops), ["scenario", "claim_key"], "left_anti"), "E-STATE-CLAIM", ["scenario", "claim_key"]),
    ])


def graph_annotation(entities: DataFrame, relations: DataFrame, chains: DataFrame) -> DataFrame:
    """Entities (scenario, entity), relations (scenario, relation, subject, object, n_sources) and explanatory chains
    (scenario, question, place, relation): ends are declared, sources exist, and neighbours in a chain share an end."""
    rk = ["scenario", "relation"]
    ends = relations.select(*rk, F.explode(F.array("subject", "object")).alias("entity"))
    pair = Window.partitionBy("scenario", "question").orderBy("place")
    x = chains.join(relations.select(*rk, F.array("subject", "object").alias("_e")), rk, "left").withColumn("_next", F.lead("_e").over(pair)).withColumn("_r", F.lead("relation").over(pair))
    apart = x.where(F.col("_e").isNotNull() & F.col("_next").isNotNull() & ~F.arrays_overlap("_e", "_next"))
    return union([
        duplicates(entities, ["scenario", "entity"], "E-DUP-ENTITY"), duplicates(relations, rk),
        violation(ends.join(entities, ["scenario", "entity"], "left_anti"), "E-GRAPH", [*rk, "entity"]),
        field_rules(relations, rk, {"E-GRAPH-SOURCE": F.col("n_sources") > 0}),
        violation(x.where("_e IS NULL"), "E-GRAPH-UNKNOWN", ["scenario", "question", "relation"]),
        violation(apart, "E-GRAPH-CHAIN", ["scenario", "question", "relation", "_r"]),
    ])


def generation_inputs(inputs: DataFrame, retrieval: DataFrame) -> DataFrame:
    """Prompts about to be sent (key, item_ids, context_tokens, budget_applies, retrieval_used, prompt, question_text,
    expected_answer, model_answer) against the saved retrieval (key, item_ids, context_tokens, budget, first_over, context,
    counted); of full histories the retrieval has the chronological ids."""
    r = retrieval.select(*KEY, F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in ("item_ids", "context_tokens", "budget", "first_over", "context", "counted")])
    x = inputs.join(r, KEY, "left")
    there, full = F.coalesce("_there", F.lit(False)), F.col("mode") == DIAGNOSTIC
    marks = F.regexp_count("prompt", F.lit("Question:"))
    return union([
        duplicates(inputs, KEY), violation(r.join(inputs, KEY, "left_anti"), "E-INPUT-MISSING", KEY),
        field_rules(x, KEY, {
            "E-RETRIEVAL-MISSING": there,
            "E-CONTEXT": ~there | F.col("item_ids").eqNullSafe(F.col("_item_ids")), "E-TOKENS": ~there | full | (F.col("context_tokens") == F.col("_context_tokens")),
            "E-RECOUNT": ~there | full | (F.col("_counted") == F.col("context_tokens")),
            "E-BUDGET": ~there | full | F.col("_budget").isNull() | (F.col("_counted") <= F.col("_budget")) | F.col("_first_over"),
            "E-UNLIMITED": ~there | full | F.col("_budget").isNotNull() | (~F.col("budget_applies") & F.col("retrieval_used")),
            "E-LINES": ~there | F.contains("prompt", F.coalesce("_context", F.lit(""))),
            "E-FULL-HISTORY": ~full | (~F.col("budget_applies") & ~F.col("retrieval_used")),
            "E-LEAK": ~F.contains("prompt", F.col("expected_answer")), "E-ONE-QUESTION": marks == 1, "E-LAST": F.endswith("prompt", F.col("question_text")), "E-ANSWER": F.col("model_answer").isNull(),
        }),
    ])


def evaluations(rows: DataFrame, answers: DataFrame, retrieval: DataFrame, summary: DataFrame, classes: list[str], model: str) -> DataFrame:
    """Evaluations (key, context_tokens, item_ids, budget, answer_class, supported, counts, source, obsolete, model) against
    answers (key, model, answer, error), the retrieval (key, context_tokens, item_ids, budget) and a published summary
    (scenario, mode, answer_class, n)."""
    counted = (F.col("answer_class") == "complete") & F.coalesce("supported", F.lit(False))
    mine = rows.groupBy("scenario", "mode", "answer_class").agg(F.count("*").alias("n"))
    return union([
        duplicates(rows, KEY), duplicates(answers, KEY, "E-DUP-ANSWER"),
        field_rules(answers, KEY, {"E-CALL": F.col("error").isNull(), "E-EMPTY": F.coalesce("answer", F.lit("")) != "", "E-MODEL": F.col("model") == model}),
        both_sides(rows, answers, KEY, ["model"], "E-ANSWER-MISSING", "E-ANSWER-MATCH", "E-EVAL-MISSING"),
        both_sides(rows, retrieval, KEY, ["context_tokens", "item_ids", "budget"], "E-RETRIEVAL-MISSING", "E-RETRIEVAL-MATCH"),
        field_rules(rows, KEY, {"E-COUNTS": F.col("counts") == counted, "E-CLASS": F.col("answer_class").isin(*classes), "E-PROPOSED": F.col("source") == "proposed", "E-OBSOLETE": ~F.col("obsolete") | (F.col("answer_class") != "complete")}),
        both_sides(summary, mine, ["scenario", "mode", "answer_class"], ["n"], "E-SUMMARY", "E-SUMMARY", "E-SUMMARY"),
    ])


def requests(rows: DataFrame, bounds: dict[str, tuple[int, int]], per_cell: dict[str, int], models: list[str]) -> DataFrame:
    """Requests (request, split, condition, episode, question, prompt, prompt_sha256, members, target): unique, of the split
    that their episode belongs to, as many as planned, free of models, hashed as stated, and with contexts that differ
    between the conditions by the target alone.  members: array of context blocks in order."""
    of = F.lit(None).cast("string")
    for name, (lo, hi) in bounds.items():
        of = F.when(F.col("episode").between(lo, hi), F.lit(name)).otherwise(of)
    named = F.lit(False)
    for m in models:
        named = named | F.contains("prompt", F.lit(m))
    full, none = (rows.where(F.col("condition") == c) for c in ("sufficient", "insufficient"))
    pair = full.select("question", F.col("members").alias("_full"), "target").join(none.select("question", F.col("members").alias("_none")), "question")
    kept = F.filter("_full", lambda m: m != F.col("target"))
    cell = rows.withColumn("cell", F.concat_ws("|", "split", "condition"))
    return union([
        duplicates(rows, ["request"]), duplicates(rows, ["split", "condition", "question"], "E-DUP-QUESTION"), totals(cell, "cell", per_cell),
        field_rules(rows, ["request"], {"E-SPLIT": F.col("split").eqNullSafe(of), "E-MODEL": ~named, "E-HASH": F.col("prompt_sha256") == F.sha2("prompt", 256)}),
        violation(pair.where((kept != F.col("_none")) | F.array_contains("_none", F.col("target"))), "E-PAIR", ["question"]),
    ])


def reuse(plan: DataFrame, cells: DataFrame) -> DataFrame:
    """A plan (cell, kind, reused_from) against its cells (cell, pos, model, prompt_sha256): every cell once, reuse only
    from an earlier call of the same model with the same input, and no input called twice."""
    x = plan.join(cells, "cell", "left")
    src = cells.select(F.col("cell").alias("reused_from"), F.col("pos").alias("_pos"), F.col("model").alias("_model"), F.col("prompt_sha256").alias("_sha")).join(plan.select(F.col("cell").alias("reused_from"), F.col("kind").alias("_kind")), "reused_from")
    x = x.join(src, "reused_from", "left")
    again = F.col("kind") == "reuse"
    twice = x.where("kind = 'call'").groupBy("model", "prompt_sha256").agg(F.count("*").alias("n")).where("n > 1")
    return union([
        duplicates(plan, ["cell"]), missing_reference(plan, ["cell"], cells.select(F.col("cell").alias("_cell")), [("cell", "_cell")]), violation(cells.join(plan, "cell", "left_anti"), "E-PLAN-MISSING", ["cell"]),
        field_rules(x, ["cell"], {"E-KIND": F.col("kind").isin("call", "reuse"), "E-REUSE-SOURCE": ~again | (F.coalesce(F.col("_kind"), F.lit("")) == "call"), "E-REUSE-MODEL": ~again | F.col("_model").isNull() | (F.col("_model") == F.col("model")), "E-REUSE-INPUT": ~again | F.col("_sha").isNull() | (F.col("_sha") == F.col("prompt_sha256")), "E-REUSE-ORDER": ~again | F.col("_pos").isNull() | (F.col("_pos") < F.col("pos"))}),
        violation(twice, "E-CALLED-TWICE", ["model", "prompt_sha256"], F.col("n")),
    ])
