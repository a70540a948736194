"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

A source's target says how often its words are taken: every document
``floor(target / source_size)`` times, and the rest from documents whose hash
lies below a threshold. The threshold comes from histograms of words by
(source, hash bucket): the bucket where the running sum crosses the budget is
refined into finer buckets, only that one, until it holds about one document.
Nothing is sorted by document and no document leaves its partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgate.llm.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
LEVEL_BITS = 10
LEVELS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    """60 bits of md5 of the id's decimal text (null: empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _bucket(h: Column, level: int) -> Column:
    """The first ``level * LEVEL_BITS`` bits of the hash."""
    return F.shiftright(h, 60 - level * LEVEL_BITS)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """One row per source: source_size, target.

    Sources in code-point order (null last) weigh ``weights`` in turn. Pouring
    the total in by weight under the caps ``max_repeat * source_size`` ends at
    one level L: target = min(cap, L * weight). L follows from the sources
    ordered by cap / weight, so no rounds are needed.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_repeat)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    per = per.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(full), F.lit(0))) / F.sum("weight").over(rest))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(Window.partitionBy()))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return per.select("source", "source_size", F.coalesce(target, F.col("cap").cast("double")).alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source: base copies for all, and the hash bucket below which one more is taken."""
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    edge = targets.withColumn("base", base.cast("long"))
    edge = edge.withColumn("budget", F.col("target") - F.col("base") * F.col("source_size")).withColumn("bucket", F.lit(0).cast("long"))
    for level in range(1, LEVELS + 1):
        inside = sizes.select(F.col("source").alias("s"), "size", _bucket(F.col("h"), level - 1).alias("outer"), _bucket(F.col("h"), level).alias("inner"))
        inside = inside.filter("size > 0").groupBy("s", "outer", "inner").agg(F.sum("size").alias("mass"))
        grown = edge.drop("mass").join(inside, F.col("source").eqNullSafe(F.col("s")) & (F.col("outer") == F.col("bucket")), "left")
        run = Window.partitionBy("source").orderBy("inner").rowsBetween(Window.unboundedPreceding, -1)
        grown = grown.withColumn("before", F.coalesce(F.sum("mass").over(run), F.lit(0)))
        grown = grown.withColumn("last", F.lead("inner").over(Window.partitionBy("source").orderBy("inner")).isNull())
        at = F.col("inner").isNull() | ((F.col("before") <= F.col("budget")) & ((F.col("budget") < F.col("before") + F.col("mass")) | F.col("last")))
        edge = grown.filter(at).select("source", "source_size", "target", "base", (F.col("budget") - F.col("before")).alias("budget"), F.coalesce("inner", F.lit(0)).alias("bucket"), "mass")
    stop = F.col("bucket") + F.when(F.col("budget") * 2 > F.coalesce("mass", F.lit(0)), 1).otherwise(0)
    return edge.select("source", "source_size", "target", "base", stop.alias("stop"))


def copies(max_repeat: int = MAX_REPEAT) -> Column:
    more = F.when(_bucket(F.col("h"), LEVELS) < F.col("stop"), 1).otherwise(0)
    return F.least(F.col("base") + more, F.lit(max_repeat)).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> tuple[DataFrame, DataFrame]:
    """(per-document plan, per-source thresholds).

    Null or blank texts have size 0 and are taken as often as their hash says,
    adding no words. Rows that share a doc_id share its hash: all or none gets
    the extra copy. A null source is a source of its own. Columns other than
    doc_id, text and source are ignored here. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id")).alias("h"))
    sizes = scratch.put(sizes, "sizes")
    edges = scratch.put(thresholds(sizes, source_targets(sizes, weights, max_repeat)), "edges")
    e = edges.withColumnRenamed("source", "s")
    plan = sizes.join(e, F.col("source").eqNullSafe(F.col("s")), "left")
    plan = plan.select("doc_id", "source", "size", "source_size", "target", copies(max_repeat).alias("copies"))
    return plan.withColumn("taken", F.col("copies") * F.col("size")), edges


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """The documents of the mix, a row for each copy taken; columns as in ``docs``, whatever their names. Else as ``mix``: texts without words may go or stay."""
    _, edges = mix(docs, weights, max_repeat)
    e = edges.select(F.col("source").alias("__s"), "base", "stop")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = docs.select(row, id_hash(F.col("doc_id")).alias("h"), F.col("source").alias("source"))
    out = out.join(e, F.col("source").eqNullSafe(F.col("__s")), "left").withColumn("n", copies(max_repeat).cast("int"))
    return out.select("row", F.explode(F.array_repeat(F.lit(1), F.col("n")))).select("row.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, _ = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT >> 30 AS b
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight, 3 * source_size AS cap,
             (sum(source_size) OVER ())::BIGINT AS total FROM s),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
                / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM w),
m AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS lam FROM l),
t AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, lam * weight), cap::DOUBLE) AS target FROM m),
u AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
h AS (SELECT source, b, sum(size)::BIGINT AS mass FROM d WHERE size > 0 GROUP BY source, b),
c AS (SELECT h.*, u.target - u.base * u.source_size AS budget,
             coalesce(sum(mass) OVER (PARTITION BY h.source ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
             lead(b) OVER (PARTITION BY h.source ORDER BY b) IS NULL AS last
      FROM h JOIN u ON h.source IS NOT DISTINCT FROM u.source),
e AS (SELECT source, b + CASE WHEN (budget - before) * 2 > mass THEN 1 ELSE 0 END AS stop FROM c
      WHERE before <= budget AND (budget < before + mass OR last))
SELECT d.doc_id, d.size, u.source_size, u.target,
       (least(u.base + CASE WHEN d.b < coalesce(e.stop, 0) THEN 1 ELSE 0 END, 3) * d.size)::BIGINT AS taken
FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
