"""Mixing sources to target weights, with DataFrame functions only.

Words are counted per source; sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all
words.  A target stops at twice its source's words and the excess goes to the others by weight until none is above.
That fixed point has a closed form: with sources ordered by (cap / weight), the first ones are capped and every other
gets ``level * weight``.  A source's repetition rate is target / words; each of its documents is taken floor(rate)
times plus one more with probability equal to the fraction, decided by a hash of its id.

Independent draws of a few long documents miss a target by chance (14 % at 50 documents a source).  So the draws are
tied together, with each document's probability unchanged: a source's documents fall into cells of like size, longest
first, and the k-th cell takes floor(N_k * fraction + u) - floor(N_(k-1) * fraction + u) further copies, N_k being the
documents up to it and u a hash of the source; a cell's copies go to the documents of its smallest id hashes.  A cell of
n documents thus takes n * fraction copies in expectation, each of its documents equally likely, and a source's number
of copies is off by less than one.

A cell is described by one number, the largest hash that is taken, so rows with texts only meet a table of cells.  That
number is found by counting hashes in buckets and ranking one bucket a cell: a cell of n documents has sqrt(n) buckets of
sqrt(n) documents in expectation, so no task ranks a hot source.

Rows: a null or wordless text has size 0 and is taken as often as any other, which adds no words.  Null sources are one
source.  A source without words has target 0 and rate 0.  Rows with one id (or a null one) and like sizes get the same
draw.  An empty table gives an empty result.  Texts are counted whole.  Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, private, unit_hash

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SALTS = 16
#: Rows of a table of sources or cells that is broadcast; they hold a name and a few numbers each.
BROADCAST_ROWS = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).  The windows run over that table,
    one small row a source, never over documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * cap).alias("cap"))
    t = t.withColumn("goal", F.sum("source_size").over(whole) * share).withColumn("all_w", F.sum("w").over(whole)).withColumn("n", F.row_number().over(by_name))
    filled = Window.orderBy(F.col("cap") / F.col("w"), "n").rowsBetween(Window.unboundedPreceding, -1)
    # the level if all sources before this one are capped and the others are not
    level = (F.col("goal") - F.coalesce(F.sum("cap").over(filled), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("w").over(filled), F.lit(0.0)))
    t = t.withColumn("level", level)
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("n"), F.col("level")))).over(whole).getField("level"))
    return t.select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def size_class(size: Column) -> Column:
    """A number that grows with the size: its binary length and the two digits after the first."""
    digits = F.rpad(F.bin(size), 3, "0")
    return F.length(F.bin(size)) * 4 + F.substring(digits, 2, 1).cast("int") * 2 + F.substring(digits, 3, 1).cast("int")


def with_cells(rows: DataFrame, cells: DataFrame, keys: dict[str, str], id_col: str) -> DataFrame:
    """Join a table with one row a source or cell to rows; keys: columns of rows to those of ``cells``.  The size of
    ``cells`` is checked: up to BROADCAST_ROWS are broadcast; more are joined with each source in SALTS slices by a
    hash of the id, so that one source's rows never meet in one task."""
    same = lambda: [F.col(f"`{a}`").eqNullSafe(F.col(b)) for a, b in keys.items()]
    if cells.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(cells), same(), "inner")
    p = private(rows, "salt", "slice")
    cut_ = rows.withColumn(p["salt"], F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(SALTS)))
    many = cells.withColumn(p["slice"], F.explode(F.array(*[F.lit(k).cast("long") for k in range(SALTS)])))
    return cut_.join(many, [*same(), F.col(p["salt"]) == F.col(p["slice"])], "inner").drop(*p.values())


def draw(id_: Column) -> Column:
    return unit_hash("mix", id_)


def cell_table(light: DataFrame) -> DataFrame:
    """(source, class, source_size, target, whole, most) of each cell of ``light`` (doc_id, source, size, class): its
    documents are taken ``whole`` times, and once more if their hash is at most ``most`` (null: none)."""
    counts = light.groupBy("source", "class").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = cut(counts)
    per_source = targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per_source = per_source.select(F.col("source").alias("of"), "source_size", "target", F.floor(rate).alias("whole"), (rate - F.floor(rate)).alias("part"))
    cells = counts.join(per_source, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    upto = Window.partitionBy("source").orderBy(F.desc("class"))
    cells = cells.withColumn("upto", F.sum("n").over(upto)).withColumn("u", unit_hash("cells", F.col("source")))
    copies = lambda n: F.floor(n * F.col("part") + F.col("u"))
    cells = cells.withColumn("k", copies(F.col("upto")) - copies(F.col("upto") - F.col("n")))
    cells = cut(cells.withColumn("buckets", F.ceil(F.sqrt("n"))).select("source", "class", "n", "source_size", "target", "whole", "k", "buckets"))
    open_ = cells.where("k > 0 AND k < n").select(F.col("source").alias("s"), F.col("class").alias("c"), "k", "buckets")
    marked = with_cells(light, open_, {"source": "s", "class": "c"}, "doc_id").withColumn("h", draw(F.col("doc_id")))
    marked = marked.select("source", "class", "k", "h", F.floor(F.col("h") * F.col("buckets")).alias("bucket"))
    hist = marked.groupBy("source", "class", "bucket").agg(F.count("*").alias("m"), F.first("k").alias("k"))
    before = Window.partitionBy("source", "class").orderBy("bucket")
    hist = hist.withColumn("before", F.sum("m").over(before) - F.col("m")).where("before < k AND before + m >= k")
    hist = cut(hist.select(F.col("source").alias("s"), F.col("class").alias("c"), F.col("bucket").alias("b"), "before"))
    near = with_cells(marked, hist, {"source": "s", "class": "c", "bucket": "b"}, "h")
    # ids that repeat are one hash, counted before hashes are ranked
    near = near.groupBy("source", "class", "h").agg(F.count("*").alias("m"), F.first("k").alias("k"), F.first("before").alias("before"))
    ranked = near.withColumn("upto", F.sum("m").over(Window.partitionBy("source", "class").orderBy("h")) + F.col("before"))
    edge = ranked.where("upto >= k").groupBy("source", "class").agg(F.min("h").alias("h")).select(F.col("source").alias("s"), F.col("class").alias("c"), "h")
    out = cells.join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c")), "left")
    return cut(out.select("source", "class", "source_size", "target", "whole", F.when(F.col("k") >= F.col("n"), 1.0).otherwise(F.col("h")).alias("most")))


def sizes(docs: DataFrame, text_col: str, id_col: str, source_col: str) -> DataFrame:
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    return light.withColumn("class", size_class(F.col("size")))


def plan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of each row.  Texts are read once; a light table
    of ids and sizes is kept in the checkpoint folder.  Sources are pre-aggregated before any shuffle."""
    light = cut(sizes(docs, text_col, id_col, source_col))
    cells = cell_table(light).withColumnsRenamed({"source": "s", "class": "c"})
    copies = F.col("whole") + F.coalesce((draw(F.col("doc_id")) <= F.col("most")).cast("long"), F.lit(0))
    out = with_cells(light, cells, {"source": "s", "class": "c"}, "doc_id").withColumn("copies", copies.cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The documents of the mix: each row of ``docs`` as many times as the plan takes it, with its own columns.  The
    table of cells is joined to the rows; texts are not shuffled while it fits a broadcast."""
    p = private(docs, "source", "cell", "class", "whole", "most", "copies")
    cells = cell_table(cut(sizes(docs, text_col, id_col, source_col)))
    cells = cells.select(F.col("source").alias(p["source"]), F.col("class").alias(p["cell"]), F.col("whole").alias(p["whole"]), F.col("most").alias(p["most"]))
    rows = docs.withColumn(p["class"], size_class(n_words(F.col(f"`{text_col}`"))))
    more = F.coalesce((draw(F.col(f"`{id_col}`")) <= F.col(p["most"])).cast("long"), F.lit(0))
    out = with_cells(rows, cells, {source_col: p["source"], p["class"]: p["cell"]}, id_col).withColumn(p["copies"], F.col(p["whole"]) + more)
    out = out.where(F.col(p["copies"]) > 0)
    return out.withColumn(p["copies"], F.explode(F.array_repeat(F.lit(0), F.col(p["copies"]).cast("int")))).select(*[f"`{c}`" for c in docs.columns])


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w
  FROM d GROUP BY source),
fill AS (
  SELECT 0 AS round, source, source_size, w, {SHARE}::DOUBLE * sum(source_size) OVER () * w / sum(w) OVER () AS target FROM s
  UNION ALL
  SELECT round + 1, source, source_size, w,
    CASE WHEN target >= {CAP} * source_size THEN {CAP} * source_size
      ELSE target + w * sum(greatest(target - {CAP} * source_size, 0)) OVER () / nullif(sum(CASE WHEN target < {CAP} * source_size THEN w ELSE 0 END) OVER (), 0) END
  FROM fill WHERE round < 60),
t AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM fill WHERE round = 60),
h AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, floor(t.rate) AS whole, t.rate - floor(t.rate) AS part,
    length(bin(d.size)) * 4 + substr(rpad(bin(d.size), 3, '0'), 2, 1)::INT * 2 + substr(rpad(bin(d.size), 3, '0'), 3, 1)::INT AS class,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS h,
    ('0x' || substr(md5('cells:' || coalesce(d.source, 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (
  SELECT *, count(*) OVER (PARTITION BY source ORDER BY class DESC) AS upto, count(*) OVER (PARTITION BY source, class) AS n,
    rank() OVER (PARTITION BY source, class ORDER BY h) AS place FROM h),
k AS (SELECT *, whole + (place <= floor(upto * part + u) - floor((upto - n) * part + u))::INT AS copies FROM r)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken FROM k
"""
