"""Near-duplicate documents by min-max hashing, bands, and exact confirmation.

Both the smallest and the largest hash under each permutation are kept, so 64
hash evaluations per shingle give a signature of 128 values. Texts with equal
shingle sets are one class from the start. Classes that share a band bucket are
compared with the bucket's centre first; once links have joined most of a bucket
into one component, only pairs across components are left to compare. Every
link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.components import components
from quillgate.llm.scratch import Scratch
from quillgate.llm.worker import only, release

WORDS = 5
PERCENT = 80
PERMUTATIONS = 64
ROWS, BANDS = 5, 25
STAR_ROUNDS = 2
#: Classes of a bucket compared side by side.
BLOCK = 512
MEMO = 400_000

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_PLACES = _rng.integers(0, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def most_different(percent: int) -> int:
    """Differing places of the 256 sketch bits that a pair at the threshold exceeds with a chance of 1e-9 (six standard deviations)."""
    p = 1 - percent / 100
    return int(PERMUTATIONS * 2 * p + 6 * (PERMUTATIONS * 2 * (1.5 * p - p * p)) ** 0.5)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (a public finaliser with fixed constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()


def shingles(text: str | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles (A-Z lower-cased; fewer words: all as one)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(width, len(words))
    total = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        total += h[i : len(words) - n + 1 + i] * _PLACES[i]
    return np.unique(mix(total))


def signature(found: np.ndarray) -> np.ndarray:
    """64 minima, then 64 maxima; long sets are taken in parts."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, dtype=np.uint64), np.zeros(PERMUTATIONS, dtype=np.uint64)
    for at in range(0, len(found), 4096):
        values = _MULTIPLY[:, None] * found[None, at : at + 4096] + _ADD[:, None]
        low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
    return np.concatenate([low, high])


_BAND_PLACES = _PLACES[:ROWS]


def band_keys(values: np.ndarray) -> np.ndarray:
    groups = mix(values[: ROWS * BANDS]).reshape(BANDS, ROWS)
    return mix((groups * _BAND_PLACES).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def sketch_bits(values: np.ndarray) -> np.ndarray:
    """Two bits of every signature value in four longs."""
    mixed = mix(values + np.uint64(1))
    return np.packbits(np.stack([mixed & np.uint64(1), (mixed >> np.uint64(1)) & np.uint64(1)]).astype(np.uint8).ravel()).view(np.int64)


def set_key(found: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(found.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, ka, kb (key of the shingle set), b0..b3 (sketch bits), bands."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only("minhash", _HASHES.clear)
        for pdf in batches:
            rows = []
            for name, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found = shingles(text if isinstance(text, str) else None)
                if not len(found):
                    rows.append((name, 0, 0, 0, 0, 0, 0, 0, None))
                    continue
                values = signature(found)
                rows.append((name, len(found), *set_key(found), *sketch_bits(values).tolist(), band_keys(values)))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "ka", "kb", "b0", "b1", "b2", "b3", "bands"])
        release()

    kinds = "doc_id bigint, n bigint, ka bigint, kb bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint, bands array<bigint>"
    return docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInPandas(sketch, kinds)


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, set) for the classes of ``wanted`` (node, ka, kb), read from the documents again."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only("minhash", _HASHES.clear)
        for pdf in batches:
            found = [shingles(t if isinstance(t, str) else None) for t in pdf["text"]]
            keys = [set_key(f) if len(f) else (0, 0) for f in found]
            yield pd.DataFrame({"node": pdf["doc_id"], "ka": [k[0] for k in keys], "kb": [k[1] for k in keys], "set": [f.view(np.int64) for f in found]})
        release()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(wanted.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    rows = rows.mapInPandas(sets, "node bigint, ka bigint, kb bigint, set array<bigint>")
    return rows.join(wanted, ["node", "ka", "kb"], "left_semi").dropDuplicates(["node", "ka", "kb"]).select("node", "set")


def alike(nx: Column, ny: Column, shared: Column, percent: int = PERCENT) -> Column:
    return shared * 100 >= (nx + ny - shared) * percent


class Linker:
    """Confirms candidate pairs; holds the tables that all rounds share."""

    def __init__(self, docs: DataFrame, classes: DataFrame, scratch: Scratch, percent: int) -> None:
        self.docs, self.classes, self.scratch, self.percent, self.turn = docs, classes, scratch, percent, 0

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among ``pairs`` (x, y); y is the side that recurs."""
        self.turn += 1
        put, t = self.scratch.put, self.turn
        side = lambda s: self.classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), *[F.col(f"b{i}").alias(f"{s}{i}") for i in range(4)])
        apart = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(1, 4)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
        near = pairs.join(side("x"), "x").join(side("y"), "y").filter(apart <= most_different(self.percent))
        near = near.filter(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * self.percent)
        near = put(near.select("x", "y", "nx", "ny"), f"near{t}")
        nodes = near.select(F.col("x").alias("node")).unionByName(near.select(F.col("y").alias("node"))).distinct()
        wanted = put(self.classes.select("node", "ka", "kb").join(nodes, "node", "left_semi"), f"wanted{t}")
        sets = put(full_sets(self.docs, wanted), f"sets{t}")
        left = near.join(sets.select(F.col("node").alias("x"), F.col("set").alias("sx")), "x")
        right = sets.join(near.select(F.col("y").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("y"), F.col("set").alias("sy"))
        shared = F.size(F.array_intersect("sx", "sy")).cast("long")
        links = left.join(right, "y").filter(alike(F.col("nx"), F.col("ny"), shared, self.percent))
        links = put(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")), f"links{t}")
        self.scratch.drop(f"near{t}", f"wanted{t}", f"sets{t}")
        return links


def _stars(buckets: DataFrame, seed: int) -> DataFrame:
    """(x, y): every class of a bucket with the bucket's centre, the class of smallest hash."""
    centre = buckets.groupBy("band", "key").agg(F.min_by("node", F.struct(F.xxhash64("node", F.lit(seed)), "node")).alias("y"))
    pairs = buckets.join(centre, ["band", "key"]).filter("node <> y")
    return pairs.select(F.col("node").alias("x"), "y").distinct()


def _pairs_within(frame: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of pairs of one group (``group``, rows sorted by it) that may be alike and lie in different components.

    Pairs that an earlier band brings together are left to that band's bucket.
    """
    group, label, n, own, band = (frame[c].to_numpy() for c in ("group", "label", "n", "own", "band"))
    cross = (frame["i"] != frame["j"]).to_numpy()
    bits = frame[["b0", "b1", "b2", "b3"]].to_numpy(dtype=np.int64)
    bands = np.stack(frame["bands"].to_list()) if len(frame) else np.zeros((0, BANDS), dtype=np.int64)
    last = np.searchsorted(group, group, side="right")
    count = last - np.arange(len(group)) - 1
    total = np.cumsum(count)
    at = 0
    while at < len(group):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 100_000, side="right")))
        a = np.repeat(np.arange(at, stop), count[at:stop])
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count[at:stop]) - count[at:stop], count[at:stop])
        at = stop
        use = (label[a] != label[b]) & ((own[a] != own[b]) | ~cross[a])
        a, b = a[use], b[use]
        use = np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent
        a, b = a[use], b[use]
        use = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1) <= most_different(percent)
        a, b = a[use], b[use]
        use = np.argmax(bands[a] == bands[b], axis=1) == band[a]
        yield a[use], b[use]


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: one bit per shingle that two sets have, so many words at a time."""
    used = np.unique(np.r_[a, b])
    place = np.zeros(len(sets), dtype=np.int64)
    place[used] = np.arange(len(used))
    whole = np.concatenate([sets[u] for u in used]) if len(used) else np.zeros(0, dtype=np.int64)
    owner = np.repeat(np.arange(len(used)), [len(sets[u]) for u in used]) if len(used) else np.zeros(0, dtype=np.int64)
    _, which, often = np.unique(whole, return_inverse=True, return_counts=True)
    common = np.cumsum(often > 1) - 1
    keep = often[which] > 1
    owner, bit = owner[keep], common[which[keep]]
    out = np.zeros(len(a), dtype=np.int64)
    width = 1 << 15
    for low in range(0, int(common[-1]) + 1 if len(common) else 0, width):
        inside = (bit >= low) & (bit < low + width)
        table = np.zeros((len(used), width // 8), dtype=np.uint8)
        np.bitwise_or.at(table, (owner[inside], (bit[inside] - low) // 8), np.uint8(1) << ((bit[inside] - low) % 8).astype(np.uint8))
        words = table.view(np.uint64)
        words = words[:, : -(-min(width, int(common[-1]) + 1 - low) // 64)]
        for lo in range(0, len(a), 4096):
            x, y = place[a[lo : lo + 4096]], place[b[lo : lo + 4096]]
            out[lo : lo + 4096] += np.bitwise_count(words[x] & words[y]).sum(axis=1, dtype=np.int64)
    return out


def _by_group(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches of whole groups out of rows sorted by (band, key, i, j); adds ``group``."""
    held, keys = None, ["band", "key", "i", "j"]
    for pdf in batches:
        pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        change = (pdf[keys].shift() != pdf[keys]).any(axis=1).to_numpy()
        group = np.cumsum(change)
        rest = group == group[-1] if len(group) else np.zeros(0, dtype=bool)
        held = pdf[rest]
        if not rest.all():
            yield pdf[~rest].assign(group=group[~rest]).reset_index(drop=True)
    if held is not None and len(held):
        yield held.assign(group=0).reset_index(drop=True)


def _across(docs: DataFrame, open_buckets: DataFrame, classes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links (a, b) that join the components of pairs of one bucket which are still apart.

    A bucket is cut into blocks: those of its largest component, whose members
    need no comparison with each other, and those of all the rest. Every block of
    the rest is compared with every block by itself, so no task holds more than
    two blocks whatever the bucket's size, and a stray class costs its bucket one
    copy, not one for each of its blocks. Sketches
    say which classes a comparison needs; only their sets are brought to it, and
    it returns no more than a spanning forest of its links.
    """
    counts = open_buckets.groupBy("band", "key", "label").agg(F.count("*").alias("k"))
    sizes = counts.groupBy("band", "key").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("c"))
    few, many = F.ceil((F.col("c") - F.col("most")) / BLOCK).cast("int"), F.ceil(F.col("most") / BLOCK).cast("int")
    sizes = sizes.select("band", "key", "main", few.alias("few"), many.alias("many"))
    rows = open_buckets.join(sizes, ["band", "key"])
    deal, inside = lambda n: F.pmod(F.xxhash64("node"), F.col(n).cast("long")).cast("int"), F.col("label") == F.col("main")
    rows = rows.withColumn("own", F.when(inside, F.col("few") + deal("many")).otherwise(deal("few")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1)))
    rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).select("band", "key", "i", "j", "own", "node", "label")
    sketch = classes.select("node", "n", "b0", "b1", "b2", "b3", "bands")
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("band", "key", "i", "j")

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_group(batches):
            hit = np.zeros(len(frame), dtype=bool)
            for a, b in _pairs_within(frame, percent):
                hit[a] = hit[b] = True
            yield frame.loc[hit, ["band", "key", "i", "j", "own", "node", "label"]]
        release()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _by_group(batches):
            node, n, sets = frame["node"].to_numpy(), frame["n"].to_numpy(), [np.asarray(x) for x in frame["set"]]
            found = []
            for a, b in _pairs_within(frame, percent):
                for lo in range(0, len(a), 200_000):
                    x, y = a[lo : lo + 200_000], b[lo : lo + 200_000]
                    both = _shared(sets, x, y)
                    good = both * 100 >= (n[x] + n[y] - both) * percent
                    found.append(np.c_[x[good], y[good]])
            links = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
            parent = np.arange(len(frame))
            forest = []
            for x, y in links.tolist():
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                while parent[y] != y:
                    parent[y] = y = parent[parent[y]]
                if x != y:
                    parent[y] = x
                    forest.append((x, y))
            ends = node[np.array(forest, dtype=np.int64).reshape(-1, 2)]
            yield pd.DataFrame({"a": ends.min(axis=1), "b": ends.max(axis=1)})
        release()

    kinds = "band int, key bigint, i int, j int, own int, node bigint, label bigint"
    dealt = rows.join(sketch, "node").repartition(slots, *keys).sortWithinPartitions(*keys)
    asked = scratch.put(dealt.select(*keys, "own", "node", "label", "n", "b0", "b1", "b2", "b3", "bands").mapInPandas(needed, kinds), "asked")
    wanted = scratch.put(classes.select("node", "ka", "kb").join(asked.select("node").distinct(), "node", "left_semi"), "asked_nodes")
    sets = scratch.put(full_sets(docs, wanted), "asked_sets")
    dealt = asked.join(sketch, "node").join(sets, "node").repartition(slots, *keys).sortWithinPartitions(*keys)
    dealt = dealt.select(*keys, "own", "node", "label", "n", "b0", "b1", "b2", "b3", "bands", "set")
    links = scratch.put(dealt.mapInPandas(compare, "a bigint, b bigint").distinct(), "across")
    scratch.drop("asked", "asked_nodes", "asked_sets")
    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row with a doc_id: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * shared shingles >= ``percent`` * all
    shingles of both. Null and wordless texts have no shingles and no links.
    Rows that share a doc_id are one document; rows without a doc_id are left
    out. Columns besides doc_id and text are ignored; an empty table gives none.
    A pair at the threshold meets in no band with a chance of 5e-5 at 80 percent
    and of 4e-7 at 85.
    """
    scratch = Scratch(docs.sparkSession, "near")
    rows = scratch.put(sketches(docs), "sketches")
    keys = rows.filter("n > 0").groupBy("ka", "kb").agg(F.min("doc_id").alias("node"))
    keys = scratch.put(keys, "keys")
    first = rows.join(keys.withColumnRenamed("node", "doc_id"), ["ka", "kb", "doc_id"], "left_semi").dropDuplicates(["ka", "kb", "doc_id"])
    classes = scratch.put(first.withColumnRenamed("doc_id", "node"), "classes")
    entries = classes.select("node", F.posexplode("bands").alias("band", "key"))
    crowded = entries.groupBy("band", "key").agg(F.count("*").alias("c")).filter("c > 1").select("band", "key")
    buckets = scratch.put(entries.join(crowded, ["band", "key"], "left_semi"), "buckets")
    linker = Linker(docs, classes, scratch, percent)
    links = scratch.put(linker.confirm(_stars(buckets, 0)), "all0")
    labels = components(links, scratch, "cc0")
    for turn in range(1, STAR_ROUNDS + 1):
        labelled = buckets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = labelled.groupBy("band", "key").agg((F.min("label") < F.max("label")).alias("m")).filter("m").select("band", "key")
        still = scratch.put(labelled.join(mixed, ["band", "key"], "left_semi"), f"open{turn}")
        if turn < STAR_ROUNDS:
            more = _stars(still.select("node", "band", "key"), turn)
            tags = labels.select(F.col("node").alias("x"), F.col("label").alias("lx")), labels.select(F.col("node").alias("y"), F.col("label").alias("ly"))
            more = more.join(tags[0], "x", "left").join(tags[1], "y", "left").filter(F.coalesce("lx", "x") != F.coalesce("ly", "y")).select("x", "y")
            fresh = linker.confirm(scratch.put(more, f"more{turn}"))
        else:
            fresh = _across(docs, still, classes, scratch, percent)
        links = scratch.put(links.unionByName(fresh), f"all{turn}")
        labels = components(links, scratch, f"cc{turn}")
        scratch.drop(f"open{turn}", f"more{turn}", f"all{turn - 1}")
    whole = keys.join(labels, "node", "left").select("ka", "kb", F.coalesce("label", "node").alias("component_id"))
    whole = scratch.put(whole, "components")
    scratch.drop("classes", "buckets", f"all{STAR_ROUNDS}")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "ka", "kb").join(whole, ["ka", "kb"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates (the one of smallest doc_id); rows without a doc_id stay."""
    lost = near_duplicates(docs, percent).filter("NOT kept").select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op2_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
