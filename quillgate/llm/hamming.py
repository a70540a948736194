"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into 16-bit segments, each with an index of its own. For a query
the search radius grows segment by segment: once every segment has been probed
to radius r, and the first s + 1 of them to radius r + 1 at last, every code
within m * (r + 1) + s of the query has been seen (m segments). The search stops
when the k-th verified distance lies within that bound, so ties at the k-th
place are complete too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgate.llm.scratch import Scratch

K = 10
QUERY_EVERY = 20
SEGMENT_BITS = 16
#: Distinct codes of an index block, and most and least query codes that go through it together.
INDEX_BLOCK = 65_536
QUERY_BLOCK = (64, 65_536)

_VALUES = np.arange(1 << SEGMENT_BITS, dtype=np.uint16)
_MASKS = [_VALUES[np.bitwise_count(_VALUES) == r] for r in range(SEGMENT_BITS + 1)]


class MultiIndex:
    """Index of distinct codes (rows of bytes, a multiple of 8 each); ``weights`` says how many ids each stands for."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray) -> None:
        self.words, self.weights = codes.view(np.uint64), weights
        self.parts = np.ascontiguousarray(codes.view(np.uint16).T)
        self.order = [np.argsort(p, kind="stable") for p in self.parts]
        self.start = [np.searchsorted(p[o], np.arange((1 << SEGMENT_BITS) + 1)) for p, o in zip(self.parts, self.order, strict=True)]
        self.present = [np.unique(p) for p in self.parts]

    def _probe(self, s: int, value: np.uint16, radius: int) -> np.ndarray:
        """Rows whose segment ``s`` lies at exactly ``radius`` from ``value``."""
        if len(_MASKS[radius]) < len(self.present[s]):
            keys = _MASKS[radius] ^ value
        else:
            keys = self.present[s][np.bitwise_count(self.present[s] ^ value) == radius]
        first, last = self.start[s][keys], self.start[s][keys.astype(np.int64) + 1]
        count = last - first
        used = count > 0
        first, count = first[used], count[used]
        if not len(count):
            return np.zeros(0, dtype=np.int64)
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return self.order[s][np.repeat(first, count) + step]

    def nearest(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, distances) of every code up to the distance at which ``k`` ids are reached."""
        word, parts, m = query.view(np.uint64), query.view(np.uint16), len(self.parts)
        seen = np.zeros(len(self.words), dtype=bool)
        reached = np.zeros(64 * len(word) + 1, dtype=np.int64)
        rows, distances = [], []
        for radius in range(SEGMENT_BITS + 1):
            for s in range(m):
                found = self._probe(s, parts[s], radius)
                found = found[~seen[found]]
                if len(found):
                    seen[found] = True
                    far = np.bitwise_count(self.words[found] ^ word).sum(axis=1)
                    reached += np.bincount(far, weights=self.weights[found], minlength=len(reached)).astype(np.int64)
                    rows.append(found)
                    distances.append(far)
                if reached[: m * radius + s + 1].sum() >= k:  # all codes this near have been seen
                    break
            else:
                continue
            break
        rows = np.concatenate(rows) if rows else np.zeros(0, dtype=np.int64)
        distances = np.concatenate(distances) if distances else np.zeros(0, dtype=np.int64)
        enough = np.flatnonzero(np.cumsum(reached) >= k)
        near = distances <= (enough[0] if len(enough) else len(reached))
        return rows[near], distances[near]


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): one bit per component, set where it is positive, padded to whole 64-bit words.

    Null vectors and vectors with a null or non-finite component have no code.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, codes = [], []
            for name, vector in zip(pdf["id"], pdf["v"], strict=True):
                x = np.asarray(vector, dtype=np.float64)
                if np.isfinite(x).all() and len(x):
                    bits = np.packbits(x > 0, bitorder="little")
                    ids.append(name)
                    codes.append(np.r_[bits, np.zeros(-len(bits) % 8, dtype=np.uint8)].tobytes())
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "code": pd.Series(codes, dtype=object)})

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.filter("id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    return rows.mapInPandas(encode, "id bigint, code binary")


def top_k(index: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, id, distance): the k nearest ids of each query row, itself left out.

    ``index`` and ``queries`` hold (id, code). Order is distance, then id; every
    tie is decided by id. Codes of another length are never compared. With fewer
    than k other rows, all of them are returned. Equal codes are searched once:
    of each code only its k + 1 smallest ids can ever be returned, which bounds
    what a much-repeated code costs. Empty tables give no rows.
    """
    spark = index.sparkSession
    scratch = Scratch(spark, "hamming")
    place = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    firsts = index.select("code", "id").withColumn("r", place).filter(F.col("r") <= k + 1)
    entries = scratch.put(firsts.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = scratch.put(queries.select("code").distinct(), "asked")
    n_entries, n_asked = entries.count(), asked.count()
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, -(-n_entries // INDEX_BLOCK))
    group = min(max(n_asked // (2 * slots), QUERY_BLOCK[0]), QUERY_BLOCK[1])
    groups = max(1, -(-n_asked // group))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        counts = pdf["ids"].map(len).to_numpy("<i8")
        return pd.DataFrame({"width": [key[0]], "block": [key[1]], "codes": [b"".join(pdf["code"])], "counts": [counts.tobytes()], "ids": [np.concatenate(pdf["ids"].tolist()).astype("<i8").tobytes()]})

    def pack_asked(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"width": [key[0]], "asker": [key[1]], "wanted": [b"".join(pdf["code"])]})

    shard = lambda n: F.pmod(F.xxhash64("code"), F.lit(n)).cast("int")
    width = F.octet_length("code")
    packed = entries.groupBy(width.alias("width"), shard(blocks).alias("block")).applyInPandas(pack, "width int, block int, codes binary, counts binary, ids binary")
    packed = packed.withColumn("asker", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    wanted = asked.groupBy(width.alias("width"), shard(groups).alias("asker")).applyInPandas(pack_asked, "width int, asker int, wanted binary")
    pairs = packed.join(wanted, ["width", "asker"]).repartition(slots, "block", "asker")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                codes = np.frombuffer(row.codes, dtype=np.uint8).reshape(-1, row.width)
                counts, ids = np.frombuffer(row.counts, dtype="<i8"), np.frombuffer(row.ids, dtype="<i8")
                starts = np.cumsum(counts) - counts
                index = MultiIndex(codes, counts)
                out = []
                for query in np.frombuffer(row.wanted, dtype=np.uint8).reshape(-1, row.width):
                    rows, far = index.nearest(query, k + 1)
                    names = np.concatenate([ids[starts[i] : starts[i] + counts[i]] for i in rows]) if len(rows) else ids[:0]
                    far = np.repeat(far, counts[rows])
                    best = np.lexsort((names, far))[: k + 1]
                    out.append((query.tobytes(), [{"distance": int(d), "id": int(i)} for d, i in zip(far[best], names[best])]))
                yield pd.DataFrame(out, columns=["code", "near"])

    near = pairs.select("width", "codes", "counts", "ids", "wanted").mapInPandas(search, "code binary, near array<struct<distance: int, id: bigint>>")
    near = near.groupBy("code").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near"))
    near = scratch.put(near, "near")
    out = queries.select(F.col("id").alias("query_id"), "code").join(near, "code")
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("place", "hit"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("id"), F.col("hit.distance").alias("distance"))


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    codes = Scratch(spark, "codes").put(codes, "codes")
    found = top_k(codes, codes.filter(F.col("id") % QUERY_EVERY == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP1_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.b, c.b), lambda z: abs(z[1] - z[2])))::INTEGER AS distance
      FROM c AS q JOIN c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
