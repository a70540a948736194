"""Packing documents into fixed-length sequences by a grouping genetic algorithm on islands.

Documents longer than a sequence are cut; whole-length pieces fill sequences of
their own. All other pieces are dealt into shards of bounded size, and each
shard is evolved on several islands at once. A crossover puts whole well-filled
bins of one parent into the other, drops the bins that held the same pieces,
lets the displaced take the places of shorter pieces and best-fits the rest. Between epochs each island sends its best to the
next. The best of a shard's islands becomes its sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.scratch import Scratch, small_batches
from quillgate.llm.tokenizing import END_ID, default_path, encoder
from quillgate.llm.worker import release

CAPACITY = 1024
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
GENERATIONS = 16
POPULATION = 4
#: Most bins that a crossover injects, and that it dissolves as poor and as random ones; passes of displaced items over shorter ones.
INJECTED, DISSOLVED, SWAP_TURNS = 32, 8, 3

# --- the genetic algorithm ---------------------------------------------------


def best_fit(items: list[int], lengths: list[int], assign: np.ndarray, fill: list[int], capacity: int) -> None:
    """Put each item, in order, into the fullest bin that holds it, else into a new one; changes assign and fill."""
    by_free: dict[int, list[int]] = {}
    mask = 0
    for b, used in enumerate(fill):
        if used < capacity:
            by_free.setdefault(capacity - used, []).append(b)
            mask |= 1 << (capacity - used)
    for i in items:
        n = lengths[i]
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            bins = by_free[free]
            b = bins.pop()
            if not bins:
                mask ^= 1 << free
        else:
            free, b = capacity, len(fill)
            fill.append(0)
        assign[i] = b
        fill[b] += n
        if free > n:
            by_free.setdefault(free - n, []).append(b)
            mask |= 1 << (free - n)


def fitness(assign: np.ndarray, lengths: np.ndarray) -> tuple[int, float]:
    """(bins, minus the mean squared fill): smaller is better."""
    fill = np.bincount(assign, weights=lengths)
    return len(fill), -float((fill**2).mean()) if len(fill) else 0.0


def _compact(assign: np.ndarray) -> np.ndarray:
    return np.unique(assign, return_inverse=True)[1].astype(np.int32)


def swap_in(out: list[int], child: np.ndarray, fill: np.ndarray, lengths: np.ndarray, capacity: int) -> list[int]:
    """Displaced items take the places of shorter ones, each where the bin ends up fullest; returns what is displaced then.

    Items without a place have -1 in ``child``; changes child and fill.
    """
    placed = np.flatnonzero(child >= 0)
    size = lengths[placed]
    most = capacity - fill[child[placed]] + size  # the longest item that fits in place of this one
    for _ in range(SWAP_TURNS):
        moved = False
        out.sort(key=lambda i: (-lengths[i], i))
        for k, item in enumerate(out):
            n = lengths[item]
            left = np.where((size < n) & (most >= n), most - n, capacity + 1)
            at = int(left.argmin()) if len(left) else 0
            if not len(left) or left[at] > capacity:
                continue
            home = child[placed[at]]
            fill[home] += n - size[at]
            child[item], child[placed[at]] = home, -1
            out[k], placed[at], size[at] = int(placed[at]), item, n
            same = child[placed] == home
            most[same] = capacity - fill[home] + size[same]
            moved = True
        if not moved:
            break
    return out


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """A child of ``a`` with some well-filled whole bins of ``b``.

    Bins of ``a`` that hold the same items go, as do a few poor and a few random
    ones. What they displace first takes the places of shorter items where that
    fills a bin better; the rest is best-fitted.
    """
    fill_b = np.bincount(b, weights=lengths)
    good = rng.permutation(np.flatnonzero(fill_b >= 0.99 * capacity))
    injected = np.zeros(len(fill_b), dtype=bool)
    injected[good[: min((len(good) + 1) // 2, INJECTED)]] = True
    taken = injected[b]
    fill_a = np.bincount(a, weights=lengths)
    gone = np.zeros(len(fill_a), dtype=bool)
    gone[a[taken]] = True
    few = min(max(1, len(fill_a) // 20), DISSOLVED)
    gone[np.argsort(fill_a, kind="stable")[:few]] = True
    gone[rng.integers(0, len(fill_a), few)] = True
    displaced = gone[a] & ~taken
    child = np.where(taken, len(fill_a) + b, a)
    child[~displaced] = _compact(child[~displaced])
    child[displaced] = -1
    fill = np.bincount(child[~displaced], weights=lengths[~displaced]).astype(np.int64)
    rest = swap_in(np.flatnonzero(displaced).tolist(), child, fill, lengths, capacity)
    bins = fill.tolist()
    best_fit(sorted(rest, key=lambda i: (-lengths[i], i)), lengths.tolist(), child, bins, capacity)
    return _compact(child)


def least_bins(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below.

    For every threshold t up to half a bin: items over capacity - t are alone,
    other items over half are alone among themselves, and items of t or more
    fill what these leave.
    """
    order = np.sort(lengths)
    sums = np.r_[0, np.cumsum(order)]
    half = np.searchsorted(order, capacity // 2, side="right")
    best = -(-int(sums[-1]) // capacity)
    for t in np.unique(order[:half]):
        first, alone = np.searchsorted(order, t), np.searchsorted(order, capacity - t, side="right")
        spare = (alone - half) * capacity - (sums[alone] - sums[half])
        best = max(best, len(order) - half + max(0, -(-int(sums[half] - sums[first] - spare) // capacity)))
    return int(best)


def founders(lengths: np.ndarray, capacity: int, size: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best-fit decreasing, and best-fit in blurred decreasing orders."""
    plain, out = lengths.tolist(), []
    for k in range(size):
        order = np.argsort(-lengths * (1 + 0.1 * k * rng.random(len(lengths))), kind="stable")
        assign, fill = np.zeros(len(lengths), dtype=np.int32), []
        best_fit(order.tolist(), plain, assign, fill, capacity)
        out.append(assign)
    return out


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, generations: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The population after some generations, best first; stops where no packing can have fewer bins."""
    least = least_bins(lengths, capacity)
    ranked = sorted(population, key=lambda x: fitness(x, lengths))
    for _ in range(generations):
        if fitness(ranked[0], lengths)[0] <= least or len(ranked) < 2:
            break
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(ranked[min(i, j)], ranked[max(i, j)], lengths, capacity, rng)
        ranked = sorted([*ranked, child], key=lambda x: fitness(x, lengths))[: len(population)]
    return ranked


# --- on Spark ----------------------------------------------------------------


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, end: int = END_ID) -> DataFrame:
    """A row per piece: uid, doc_id, piece, start, length, ids_crc32, shard (null for whole-length pieces)."""
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        uid, small = part << 40, 0
        for pdf in batches:
            ids = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None).tolist()
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for at in range(0, len(texts), 1000):
                rows = []
                for name, data in zip(ids[at : at + 1000], encoder(path).encode(texts[at : at + 1000], end), strict=True):
                    n = len(data) // 4
                    first = n % capacity or capacity
                    borders = [0, *range(min(first, n), n + 1, capacity)]
                    for piece, (a, b) in enumerate(zip(borders, borders[1:])):
                        shard = None
                        if b - a < capacity:
                            shard = (part << 20) + small // SHARD
                            small += 1
                        rows.append((uid, name, piece, a, b - a, zlib.crc32(data[4 * a : 4 * b]), shard))
                        uid += 1
                frame = pd.DataFrame(rows, columns=["uid", "doc_id", "piece", "start", "length", "ids_crc32", "shard"])
                yield frame.astype({"doc_id": object, "shard": "Int64"})
        release()

    return docs.select("doc_id", "text").mapInPandas(cut, f"uid bigint, doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, shard bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS, path: str | None = None, end: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone, one piece; texts are taken whole,
    however long. Repeated rows are
    packed as documents of their own. A document over ``capacity`` ids is cut
    into pieces of that length, its first piece taking the remainder. Columns
    besides doc_id and text are ignored; an empty table gives no rows. Shards
    hold up to SHARD pieces whatever the input's size.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    with small_batches(docs.sparkSession):
        pieces = scratch.put(cut_pieces(docs, capacity, path, end), "pieces")
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        uids, lengths = pdf["uid"].to_numpy("<i8").tobytes(), pdf["length"].to_numpy("<i8").tobytes()
        return pd.DataFrame({"shard": key[0], "island": range(islands), "uids": uids, "lengths": lengths})

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lengths = np.frombuffer(row.lengths, dtype="<i8")
                rng = np.random.default_rng([row.epoch, row.island, row.shard])
                if row.epoch == 0:
                    population = founders(lengths, capacity, POPULATION, rng)
                else:
                    population = [np.frombuffer(x, dtype="<i4") for x in (*row.population, row.immigrant) if x is not None]
                ranked = evolve(lengths, population, capacity, GENERATIONS, rng)[:POPULATION]
                bins, spread = fitness(ranked[0], lengths)
                yield pd.DataFrame({"shard": [row.shard], "island": [row.island], "uids": [row.uids], "lengths": [row.lengths], "population": [[x.astype("<i4").tobytes() for x in ranked]], "bins": [bins], "spread": [spread]})

    state_type = "shard bigint, island int, uids binary, lengths binary, population array<binary>, bins bigint, spread double"
    small = pieces.filter("shard IS NOT NULL").select("shard", "uid", "length")
    state = small.groupBy("shard").applyInPandas(gather, "shard bigint, island int, uids binary, lengths binary")
    state = state.selectExpr("*", "0 AS epoch", "CAST(NULL AS array<binary>) AS population", "CAST(NULL AS binary) AS immigrant")
    for epoch in range(epochs):
        if epoch:
            best = state.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), F.element_at("population", 1).alias("immigrant"))
            state = state.join(best, ["shard", "island"]).withColumn("epoch", F.lit(epoch))
        state = state.repartition(slots, "shard", "island").select("shard", "island", "uids", "lengths", "epoch", "population", "immigrant")
        state = scratch.put(state.mapInPandas(step, state_type), f"epoch{epoch}")
    winner = state.groupBy("shard").agg(F.min_by(F.struct("uids", "lengths", F.element_at("population", 1).alias("assign")), F.struct("bins", "spread", "island")).alias("w"))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lengths, assign = np.frombuffer(row.lengths, dtype="<i8"), np.frombuffer(row.assign, dtype="<i4").astype(np.int64)
                order = np.argsort(assign, kind="stable")
                ends = np.cumsum(lengths[order])
                begins = ends - lengths[order]
                first = np.r_[True, assign[order][1:] != assign[order][:-1]]
                base = np.maximum.accumulate(np.where(first, begins, 0))
                yield pd.DataFrame({"uid": np.frombuffer(row.uids, dtype="<i8")[order], "sequence_id": row.shard * (2 * SHARD) + assign[order], "offset": begins - base})

    placed = winner.select("shard", "w.*").mapInPandas(spread, "uid bigint, sequence_id bigint, offset bigint")
    out = pieces.join(placed, "uid", "left")
    whole = F.col("shard").isNull()
    return out.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(whole, -F.col("uid") - 1).otherwise(F.col("sequence_id")).alias("sequence_id"), F.when(whole, 0).otherwise(F.col("offset")).cast("long").alias("offset"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
