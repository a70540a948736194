"""Cross-site line removal by the spread of each line over distinct sites (DataFrame functions only).

Every line is hashed; a HyperLogLog sketch of the sites per line hash merges by
aggregation. Lines whose estimate lies near the threshold are counted exactly.
Lines on ``min_sites`` sites or more are boilerplate and go from every text
that has other lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.scratch import Scratch

MIN_SITES = 10
LG_K = 8
#: Estimates within this share of the threshold are counted exactly: four standard errors of a sketch with 2^8 registers.
MARGIN = 4 * 1.04 / 16


def bare_line(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\x0c\r"))


def line_key(line: Column) -> Column:
    """Two hashes of the trimmed line (128 bits in all); null for blank lines."""
    bare = bare_line(line)
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare, F.lit(2)).alias("b")))


def _lines(docs: DataFrame) -> DataFrame:
    """A row per non-blank line: who (document row), site, k (line key), at."""
    who = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"))
    cut = docs.filter(F.col("text").isNotNull()).select(who.alias("who"), F.coalesce("source", F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return cut.select("who", "site", "at", line_key(F.col("line")).alias("k")).filter("k IS NOT NULL")


def boilerplate_lines(lines: DataFrame, scratch: Scratch, min_sites: int = MIN_SITES) -> DataFrame:
    """Keys of lines that stand on ``min_sites`` distinct sites or more.

    A line seen fewer than ``min_sites`` times cannot be on as many sites, which
    leaves few keys to sketch. The sketch decides where its error cannot matter.
    """
    often = lines.groupBy("k").agg(F.count("*").alias("c")).filter(F.col("c") >= min_sites).select("k")
    often = scratch.put(often, "often")
    seen = lines.select("k", "site").join(often, "k", "left_semi")
    spread = seen.groupBy("k").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    spread = scratch.put(spread.select("k", F.hll_sketch_estimate("sketch").alias("sites")), "spread")
    clear = spread.filter(F.col("sites") > min_sites * (1 + MARGIN)).select("k")
    near = spread.filter(F.col("sites").between(min_sites * (1 - MARGIN), min_sites * (1 + MARGIN))).select("k")
    pairs = seen.join(near, "k", "left_semi").groupBy("k", "site").agg(F.count("*"))
    exact = pairs.groupBy("k").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites).select("k")
    return clear.unionByName(exact)


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES, names: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and two columns more: its lines, and how many of them went.

    A site is a ``source`` (null counts as the empty one). Lines are compared
    without surrounding white space; blank lines stay. A document that would be
    left with no non-blank line stays whole, for the stages that look for
    copies. Null texts stay null with 0 lines; a text of any length is cut whole;
    an empty table gives no rows; repeated rows are treated alike; further
    columns pass through, but for those called like the two new ``names``.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = scratch.put(_lines(docs), "lines")
    keys = scratch.put(boilerplate_lines(lines, scratch, min_sites), "keys")
    found = lines.join(keys, "k", "left_semi")
    cuts = found.groupBy("who").agg(F.collect_set("at").alias("cut"))
    cuts = scratch.put(cuts, "cuts")
    scratch.drop("lines", "often", "spread", "keys")
    order = [c for c in docs.columns if c not in names]
    row = F.struct(*[F.col(f"`{c}`") for c in order]).alias("row")
    out = docs.select(row, F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), F.split("text", "\n").alias("l")).alias("d")
    cuts = cuts.select(F.col("who.id").alias("id"), F.col("who.t").alias("t"), "cut").alias("c").hint("merge")  # grows with the documents: never broadcast, at any size
    out = out.join(cuts, F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.t") == F.col("c.t")), "left").select("row", "l", "cut")
    filled = F.size(F.filter("l", lambda x: bare_line(x) != ""))
    drops = F.when(F.col("cut").isNotNull(), F.size("cut") < filled).otherwise(False)
    out = out.select("row", "l", "cut", F.when(F.col("row.text").isNull(), 0).otherwise(filled).alias("filled"), drops.alias("drops"))
    text = F.when(F.col("drops"), F.array_join(F.filter("l", lambda x, i: ~F.array_contains("cut", i)), "\n")).otherwise(F.col("row.text"))
    kept = [text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in order]
    return out.select(*kept, F.col("filled").cast("long").alias(names[0]), F.when(F.col("drops"), F.size("cut")).otherwise(0).cast("long").alias(names[1]))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_lines(docs.select("doc_id", "text", "source")).select("doc_id", "n_lines", "n_removed", "text")


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS k FROM l),
b AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT site) >= 10),
m AS (SELECT k.*, k.k <> '' AND k.k IN (SELECT k FROM b) AS cut FROM k),
g AS (SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (cut) AS n,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT cut), '') AS kept
      FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, (CASE WHEN n < n_lines THEN n ELSE 0 END)::BIGINT AS n_removed,
       CASE WHEN n > 0 AND n < n_lines THEN kept ELSE d.text END AS text
FROM documents d LEFT JOIN g USING (doc_id)
"""
