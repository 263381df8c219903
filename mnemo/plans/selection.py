"""Queries on eligibility, reproducible selection, deduplication, data quality and text rewriting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import plain_spaces, sha_int, usable_value
from ..operators import budget, evaluate, metrics, perimeter, quality, resample
from ..operators.positions import numbered_within
from ..operators.quality import LEAKS
from .common import BUDGET, ranked, table
from .retrieval import TIERS_SQL

SEED = "20260923"
CRITERIA = ("no_text", "too_short", "too_long", "language_not_in_scope", "unlabelled", "low_quality", "leaks_address")
EMAIL = LEAKS["email"]


def _criteria(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    x = table(spark, d, "documents").join(labels, "doc_id", "left")
    checks = [
        ("no_text", F.length(F.trim("text")) > 0),
        ("too_short", F.col("n_chars") >= 200),
        ("too_long", F.col("n_chars") <= 20000),
        ("language_not_in_scope", F.col("lang").isin("en", "fr", "de")),
        ("unlabelled", F.col("quality").isNotNull()),
        ("low_quality", F.col("quality") == 1),
        ("leaks_address", ~F.col("text").rlike(EMAIL)),
    ]
    return x.withColumn("criterion", perimeter.first_failing(checks))


def eligibility_cascade(spark, d):
    return _criteria(spark, d).select("doc_id", "criterion")


def funnel_cumulative(spark, d):
    return metrics.funnel(_criteria(spark, d), "criterion", list(CRITERIA)).select(F.col("pos").cast("long").alias("pos"), "criterion", "excluded", "remaining")


def error_histogram(spark, d):
    """Counts of criteria in their order, those that exclude nothing included."""
    x = _criteria(spark, d).withColumn("c", F.coalesce("criterion", F.lit("eligible")))
    return metrics.histogram(x, "c", [*CRITERIA, "eligible", "unheard_of"]).select(F.col("pos").cast("long").alias("pos"), "value", "n")


def hash_order_selection(spark, d):
    x = resample.hash_rank(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], SEED, ["lang", "doc_id"])
    return x.where(F.col("place") <= 10).select("lang", "doc_id", F.col("place").cast("long").alias("place"), "rank_key")


def greedy_strata(spark, d):
    x = resample.hash_rank(table(spark, d, "documents").select("lang", "doc_id", "source"), ["lang"], SEED, ["lang", "doc_id"])
    return resample.greedy_strata(x, "lang", "doc_id", "source", 3, 10, strict=False)


def sequential_dedupe(spark, d):
    """Profile: language, source and size class; summary: the plain text."""
    x = table(spark, d, "documents").select("doc_id", F.concat_ws("|", "lang", "source", F.floor(F.col("n_chars") / 100).cast("string")).alias("profile"), F.md5(plain_spaces(F.col("text"))).alias("summary"))
    x = x.withColumn("rank_key", F.sha2(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string")), 256))
    return resample.sequential_dedupe(x, "rank_key", "profile", "summary", "doc_id")


def exact_dedupe_reuse_plan(spark, d):
    x = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("prompt_sha256"))
    return resample.reuse_plan(x, ["prompt_sha256"], [], "doc_id").select("doc_id", "kind", "reused_from")


def generation_counts(spark, d):
    """Real and reused calls by source."""
    x = table(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("k"))
    return resample.reuse_plan(x, ["k"], [], "doc_id").groupBy("source").agg(F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "reuse").alias("reused"))


def last_row_per_key(spark, d):
    x = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return evaluate.last_per_key(x, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def resume_pending(spark, d):
    """Cells (user, type) whose last event is no success (value above 50)."""
    e = table(spark, d, "events")
    done = evaluate.last_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).where("value > 50")
    cells = e.select("user_id").distinct().join(F.broadcast(e.select("event_type").distinct()))
    return evaluate.pending(cells, done, ["user_id", "event_type"])


def _blocks(spark, d):
    x = table(spark, d, "documents").select("doc_id", "lang", F.sha2(F.concat_ws(":", F.lit(SEED), F.col("doc_id").cast("string")), 256).alias("k"))
    return resample.in_blocks(numbered_within(x, "lang", ["k", "doc_id"], "n"), "n", 3)


def block_of_three(spark, d):
    """Hash-ordered documents of a language in triples, with the rotation that each would get."""
    x = _blocks(spark, d)
    return x.select("lang", "doc_id", "block", "place", (sha_int(f"{SEED}:questions", F.col("doc_id")) % 3).alias("rotation"), ((F.col("place") + F.col("block")) % 3).alias("message_place"))


def context_builder(spark, d):
    """Two contexts for each document: with the target and the others of its triple, or the others alone (the last triple of
    a language may lack some)."""
    x = _blocks(spark, d)
    other = x.select("lang", "block", F.col("doc_id").alias("member"), F.sha2(F.concat_ws(":", F.lit("order"), F.col("doc_id").cast("string")), 256).alias("o"))
    cells = x.select("lang", "block", "doc_id").withColumn("condition", F.explode(F.array(F.lit("sufficient"), F.lit("insufficient"))))
    seen = F.when((F.col("condition") == "sufficient") | (F.col("member") != F.col("doc_id")), F.struct("o", "member"))
    y = cells.join(other, ["lang", "block"]).groupBy("doc_id", "condition").agg(F.array_sort(F.collect_list(seen)).alias("m"))  # two cells for each of three members
    return y.select("doc_id", "condition", F.size("m").cast("long").alias("members"), F.array_join(F.transform("m", lambda s: s["member"].cast("string")), ",").alias("context"))


def leak_detector(spark, d):
    docs = quality.leaks(table(spark, d, "documents"), "doc_id", "text").withColumn("source", F.lit("documents"))
    pages = quality.leaks(table(spark, d, "pages"), "page_id", "html").withColumn("source", F.lit("pages"))
    return docs.union(pages).select("source", "key", "code", "n")


def quality_duplicates(spark, d):
    li, docs = table(spark, d, "lineitem"), table(spark, d, "documents").withColumn("sha", F.sha2("text", 256))
    return quality.union([quality.duplicates(li, ["l_orderkey", "l_linenumber"]), quality.duplicates(docs, ["sha"], "E-TEXT")])


def quality_fk(spark, d):
    """References without target: orders to customers with an account above 0, lines to orders, labels to documents."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal > 0")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return quality.union([
        quality.missing_reference(o, ["o_orderkey"], c, [("o_custkey", "c_custkey")]),
        quality.missing_reference(li, ["l_orderkey", "l_linenumber"], o, [("l_orderkey", "o_orderkey")]),
        quality.missing_reference(table(spark, d, "labels"), ["doc_id"], table(spark, d, "documents"), [("doc_id", "doc_id")]),
    ])


def quality_order(spark, d):
    t = table(spark, d, "conversations").where(F.col("role") != "system")
    return quality.union([quality.order_gaps(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber"), quality.order_gaps(t, ["conv_id"], "turn", 0)])


def quality_match(spark, d):
    """Recorded character counts against the texts' own; orders' line counts against four."""
    docs = table(spark, d, "documents")
    return quality.union([
        quality.mismatch(docs.select("doc_id", "n_chars"), docs.select("doc_id", F.length("text").cast("long").alias("n_chars")), ["doc_id"], "n_chars"),
        quality.wrong_count(table(spark, d, "lineitem"), ["l_orderkey"], F.lit(4)),
    ])


def quality_fields(spark, d):
    x = table(spark, d, "documents")
    return quality.field_rules(x, ["doc_id"], {"E-FIELD": F.length(F.trim("text")) > 0, "E-LANG": F.col("lang").isin("en", "fr", "de"), "E-SIZE": F.col("n_chars").between(100, 10000)})


def tier_properties(spark, d):
    """A selection made for one budget, held against a smaller one, with every fifth conversation's first item twice: the
    properties of a strict selection that it breaks."""
    x = ranked(spark, d).withColumn("level", budget.level(F.col("session_order"), F.col("n_user") - 1)).withColumn("item_id", F.col("turn"))
    x = budget.two_phase(x, ["conv_id"], F.lit(BUDGET))
    again = x.where((F.col("conv_id") % 5 == 0) & (F.col("rank") == 1))
    return quality.tier_properties(x.union(again), ["conv_id"], BUDGET * 3 // 4)


def freq_tables(spark, d):
    docs = table(spark, d, "documents")
    parts = [docs.groupBy(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")) for c in ("lang", "source")]
    kinds = table(spark, d, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("value")).groupBy(F.lit("type_word").alias("field"), "value").agg(F.count("*").alias("n"))
    return reduce(lambda a, b: a.union(b), [*parts, kinds])


def shared_groups(spark, d):
    """Normalised texts that several documents have: the five largest groups."""
    x = table(spark, d, "documents").groupBy(F.md5(plain_spaces(F.col("text"))).alias("text_md5")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")
    return x.orderBy(F.desc("n"), "first_doc").limit(5)


#: Ordered rewrites of a reversible anonymisation, and their inverses: each stand-in occurs in no text before.
REWRITES = (("the ", "<<A1>> "), ("que ", "<<A2>> "), ("der ", "<<A3>> "))


def anonymize_roundtrip(spark, d):
    text = F.col("text")
    hidden = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), REWRITES, text)
    back = reduce(lambda c, r: F.replace(c, F.lit(r[1]), F.lit(r[0])), reversed(REWRITES), hidden)
    return table(spark, d, "documents").select("doc_id", F.md5(hidden).alias("hidden_md5"), (hidden != text).alias("changed"), (back == text).alias("restored"))


def usable_values(spark, d):
    """Each line of each document, numbered from 0; a null text is one line."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "v"))
    return x.select("doc_id", F.coalesce("line", F.lit(0)).cast("long").alias("line"), usable_value("v").alias("usable"))


def phase_and_split(spark, d):
    """Sessions by phase and conversations by split; numbers outside every bound would fail."""
    t = table(spark, d, "conversations").select("conv_id", "turn").distinct()
    p = perimeter.phase(F.col("turn"), {"before": (0, 1, 2, 3), "after": (4, 5, 6, 7)})
    s = perimeter.split_of(F.col("conv_id"), {"development": (0, 9), "evaluation": (10, 10**9)})
    return t.groupBy(s.alias("split"), p.alias("phase")).agg(F.count("*").alias("n"))


def budget_resolution(spark, d):
    x = table(spark, d, "documents").select("source").distinct()
    b = perimeter.budget_for(F.col("source"), 200, {"src1": None, "src2": 500})
    return x.select("source", b.alias("budget"), b.isNull().alias("unlimited"))


_CASE = f"""CASE WHEN NOT (length(trim(text)) > 0) IS TRUE THEN 'no_text' WHEN NOT (n_chars >= 200) IS TRUE THEN 'too_short' WHEN NOT (n_chars <= 20000) IS TRUE THEN 'too_long'
  WHEN NOT (lang IN ('en', 'fr', 'de')) IS TRUE THEN 'language_not_in_scope' WHEN quality IS NULL THEN 'unlabelled' WHEN quality <> 1 THEN 'low_quality' WHEN regexp_matches(text, '{EMAIL}') THEN 'leaks_address' END"""
_CASE = _CASE.replace("NOT (", "((").replace(") IS TRUE", ") IS NOT TRUE)")
_CRIT = f"c AS (SELECT documents.doc_id, {_CASE} AS criterion FROM documents LEFT JOIN labels USING (doc_id))"
_DIM = "k AS (SELECT pos - 1 AS pos, value FROM (SELECT generate_subscripts(v, 1) AS pos, unnest(v) AS value FROM (SELECT [{}] AS v)))"
_LIST = ", ".join(f"'{c}'" for c in CRITERIA)
_REUSE = "r AS (SELECT doc_id, source, sha256(text) AS s, min(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents)"
_BLOCKS = f"b AS (SELECT *, (n // 3 + 1)::BIGINT AS block, (n % 3)::BIGINT AS place FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('{SEED}:' || doc_id), doc_id) - 1 AS n FROM documents))"
_LAST = "l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)"
_HIDE = reduce(lambda c, r: f"replace({c}, '{r[0]}', '{r[1]}')", REWRITES, "text")
_BACK = reduce(lambda c, r: f"replace({c}, '{r[1]}', '{r[0]}')", reversed(REWRITES), _HIDE)


def _leak_sql(name: str, key: str, text: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS source, {key} AS key, '{c}' AS code, len(regexp_extract_all({text}, '{p}'))::BIGINT AS n FROM {name} WHERE regexp_matches({text}, '{p}')" for c, p in LEAKS.items())


def _gap_sql(rows: str, group: str, order: str, first: int) -> str:
    return f"SELECT 'E-ORDER' AS code, {group} || '|' || {order} AS key, want::VARCHAR AS detail FROM (SELECT {group}, {order}, coalesce(lag({order}) OVER (PARTITION BY {group} ORDER BY {order}) + 1, {first}) AS want FROM {rows}) WHERE {order} IS DISTINCT FROM want"


QUERIES = {
    "eligibility_cascade": (eligibility_cascade, f"WITH {_CRIT} SELECT * FROM c"),
    "funnel_cumulative": (funnel_cumulative, f"""WITH {_CRIT}, {_DIM.format(_LIST)}, n AS (SELECT pos, value, count(c.doc_id) AS excluded FROM k LEFT JOIN c ON c.criterion = k.value GROUP BY ALL)
SELECT pos, value AS criterion, excluded, ((SELECT count(*) FROM c) - sum(excluded) OVER (ORDER BY pos))::BIGINT AS remaining FROM n"""),
    "error_histogram": (error_histogram, f"WITH {_CRIT}, {_DIM.format(_LIST + ", 'eligible', 'unheard_of'")} SELECT pos, value, count(c.doc_id) AS n FROM k LEFT JOIN c ON coalesce(c.criterion, 'eligible') = k.value GROUP BY ALL"),
    "hash_order_selection": (hash_order_selection, f"WITH h AS (SELECT lang, doc_id, sha256('{SEED}:' || lang || ':' || doc_id) AS rank_key FROM documents), p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY rank_key, lang, doc_id) AS place FROM h) SELECT lang, doc_id, place, rank_key FROM p WHERE place <= 10"),
    "greedy_strata": (greedy_strata, None),
    "sequential_dedupe": (sequential_dedupe, None),
    "exact_dedupe_reuse_plan": (exact_dedupe_reuse_plan, f"WITH {_REUSE} SELECT doc_id, CASE WHEN doc_id = f THEN 'call' ELSE 'reuse' END AS kind, CASE WHEN doc_id <> f THEN f END AS reused_from FROM r"),
    "generation_counts": (generation_counts, f"WITH {_REUSE} SELECT source, count(*) FILTER (WHERE doc_id = f) AS calls, count(*) FILTER (WHERE doc_id <> f) AS reused FROM r GROUP BY source"),
    "last_row_per_key": (last_row_per_key, f"WITH {_LAST} SELECT user_id, event_type, event_id, value FROM l"),
    "resume_pending": (resume_pending, f"WITH {_LAST} SELECT u.user_id, t.event_type FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = u.user_id AND l.event_type = t.event_type AND value > 50)"),
    "block_of_three": (block_of_three, f"WITH {_BLOCKS} SELECT lang, doc_id, block, place, ('0x' || substr(sha256('{SEED}:questions:' || doc_id), 1, 8))::BIGINT % 3 AS rotation, (place + block) % 3 AS message_place FROM b"),
    "context_builder": (context_builder, f"""WITH {_BLOCKS}, x AS (SELECT a.doc_id, o.doc_id AS member, sha256('order:' || o.doc_id) AS k FROM b a JOIN b o ON a.lang = o.lang AND a.block = o.block)
SELECT doc_id, condition, count(*) FILTER (WHERE condition = 'sufficient' OR member <> doc_id) AS members, coalesce(string_agg(member::VARCHAR, ',' ORDER BY k) FILTER (WHERE condition = 'sufficient' OR member <> doc_id), '') AS context
FROM x CROSS JOIN (VALUES ('sufficient'), ('insufficient')) c(condition) GROUP BY doc_id, condition"""),
    "leak_detector": (leak_detector, _leak_sql("documents", "doc_id", "text") + " UNION ALL " + _leak_sql("pages", "page_id", "html")),
    "quality_duplicates": (quality_duplicates, "SELECT 'E-DUP' AS code, l_orderkey || '|' || l_linenumber AS key, count(*)::VARCHAR AS detail FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT 'E-TEXT', sha256(text), count(*)::VARCHAR FROM documents GROUP BY text HAVING count(*) > 1"),
    "quality_fk": (quality_fk, """SELECT 'E-REF' AS code, o_orderkey::VARCHAR AS key, o_custkey::VARCHAR AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'E-REF', l_orderkey || '|' || l_linenumber, l_orderkey::VARCHAR FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'E-REF', doc_id::VARCHAR, doc_id::VARCHAR FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)"""),
    "quality_order": (quality_order, _gap_sql("lineitem", "l_orderkey", "l_linenumber", 1) + " UNION ALL " + _gap_sql("(SELECT * FROM conversations WHERE role <> 'system')", "conv_id", "turn", 0)),
    "quality_match": (quality_match, "SELECT 'E-MATCH' AS code, doc_id::VARCHAR AS key, n_chars || ' <> ' || length(text) AS detail FROM documents WHERE n_chars <> length(text) UNION ALL SELECT 'E-COUNT', l_orderkey::VARCHAR, count(*)::VARCHAR FROM lineitem GROUP BY l_orderkey HAVING count(*) <> 4"),
    "quality_fields": (quality_fields, " UNION ALL ".join(f"SELECT '{c}' AS code, doc_id::VARCHAR AS key, '' AS detail FROM documents WHERE ({p}) IS NOT TRUE" for c, p in (("E-FIELD", "length(trim(text)) > 0"), ("E-LANG", "lang IN ('en', 'fr', 'de')"), ("E-SIZE", "n_chars BETWEEN 100 AND 10000")))),
    "tier_properties": (tier_properties, f"""{TIERS_SQL},
  sp AS (SELECT conv_id, turn, level, tokens, one, one OR two AS sel FROM g UNION ALL SELECT conv_id, turn, level, tokens, one, one OR two FROM g WHERE conv_id % 5 = 0 AND rank = 1)
SELECT 'E-BUDGET' AS code, conv_id::VARCHAR AS key, sum(tokens)::BIGINT::VARCHAR AS detail FROM sp WHERE sel GROUP BY conv_id HAVING sum(tokens) > {BUDGET * 3 // 4}
UNION ALL SELECT 'E-QUOTA', conv_id || '|' || level, sum(tokens)::BIGINT::VARCHAR FROM sp WHERE one GROUP BY conv_id, level HAVING sum(tokens) > CASE level WHEN 'recent' THEN {BUDGET * 3 // 4 // 2} ELSE {BUDGET * 3 // 4 - BUDGET * 3 // 4 // 2} END
UNION ALL SELECT 'E-DUP', conv_id || '|' || turn, count(*)::VARCHAR FROM sp GROUP BY conv_id, turn HAVING count(*) > 1"""),
    "freq_tables": (freq_tables, "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'type_word', w, count(*) FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS w FROM part) GROUP BY w"),
    "shared_groups": (shared_groups, r"SELECT md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS text_md5, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, first_doc LIMIT 5"),
    "anonymize_roundtrip": (anonymize_roundtrip, f"SELECT doc_id, md5({_HIDE}) AS hidden_md5, {_HIDE} <> text AS changed, {_BACK} = text AS restored FROM documents"),
    "usable_values": (usable_values, None),
    "phase_and_split": (phase_and_split, "SELECT CASE WHEN conv_id <= 9 THEN 'development' ELSE 'evaluation' END AS split, CASE WHEN turn <= 3 THEN 'before' ELSE 'after' END AS phase, count(*) AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations) GROUP BY ALL"),
    "budget_resolution": (budget_resolution, "SELECT DISTINCT source, CASE source WHEN 'src1' THEN NULL WHEN 'src2' THEN 500 ELSE 200 END::BIGINT AS budget, source = 'src1' AS unlimited FROM documents"),
}
