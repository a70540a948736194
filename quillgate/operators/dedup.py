"""Duplicate documents inside a batch: exact by content hash, near by trigram Jaccard."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgate.sources.scratch import materialise

THRESHOLD = 0.85
LEAST_CHARS = 100
#: Bits of a signature and of a folded one; texts in a block, in a piece of it and in a family; what rounding of the threshold may cost.
BITS, FOLD = 2048, 512
BLOCK, PIECE, FAMILY = 16384, 2048, 1024
SLACK = 1e-6
#: Pairs are counted by a matrix product if they are so many, and it multiplies at most so often for one; its cells at a time.
LEAST_DENSE, WORTH, CELLS = 64, 200_000, 1 << 22
NEAR = pa.schema([("b", pa.int64()), ("m", pa.int64()), ("others", pa.binary())])
PAIRS = pa.schema([("batch", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64())])
SPACE = r"[ \t\n\x0b\f\r]+"


def normalise(text: Column) -> Column:
    """Lower case, single spaces, no surrounding white space."""
    return F.lower(F.trim(F.regexp_replace(text, SPACE, " ")))


def trigram_set(normal: Column) -> Column:
    """Distinct character trigrams."""
    chars = F.split(normal, "")
    pairs = F.zip_with(chars, F.slice(chars, 2, 1 << 30), lambda a, b: F.concat(a, b))
    grams = F.zip_with(pairs, F.slice(chars, 3, 1 << 30), lambda a, b: F.concat(a, b))
    return F.array_distinct(F.filter(grams, lambda g: F.length(g) == 3))


def content_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("batch"), F.sha2(normalise(F.col("text")), 256).alias("content_hash"))


def _grams(text: str) -> np.ndarray:
    """Distinct trigrams as numbers: three code points of 21 bits."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])


def _signature(grams: np.ndarray) -> bytes:
    """The parity of the trigrams in each of ``BITS`` hash classes: two sets differ in at least as many trigrams as bits."""
    of = (grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS.bit_length() + 1)
    return np.packbits(np.bincount(of.astype(np.int64), minlength=BITS) & 1 > 0).tobytes()


def _signed(texts: DataFrame) -> DataFrame:
    """(doc_id, batch, h, n, k, sig): size and signature of each text's trigrams; h and n tell texts apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_grams(t.as_py()) for t in batch.column("t")]
            more = pa.array([len(g) for g in sets], pa.int32()), pa.array(map(_signature, sets), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns("t").columns, *more], ["doc_id", "batch", "h", "n", "k", "sig"])

    rows = texts.select("doc_id", "batch", F.xxhash64("t").alias("h"), F.length("t").alias("n"), "t")
    return rows.mapInArrow(run, "doc_id bigint, batch string, h bigint, n int, k int, sig binary")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """Rows of sorted batches by their ``key``."""
    at, held = None, []
    for batch in batches:
        runs, start = pc.run_end_encode(batch.column("key")), 0
        for end, key in zip(runs.run_ends.to_pylist(), runs.values.to_pylist(), strict=True):
            if key != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            at, start = key, end
    if held:
        yield at, pa.Table.from_batches(held)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows by ``key``, as many tasks as shuffles have: small rows that make much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key").sortWithinPartitions("key")


def _tiles(reps: DataFrame, threshold: float) -> DataFrame:
    """(key, side, doc_id, k, sig): texts of one batch and of sizes that can be alike, in pairs of blocks.

    A class of sizes is compared with itself and the next; a class has blocks of
    about ``BLOCK`` texts. The key names a pair of blocks and ends in the batch.
    """
    width = max(-math.log(threshold), 0.01) * (1 + 1e-9)
    reps = reps.withColumn("c", F.floor(F.log(F.col("k").cast("double")) / width).cast("int"))
    blocks = reps.groupBy("batch", "c").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("here"))
    for name, by in (("above", 1), ("below", -1)):
        blocks = blocks.join(blocks.select("batch", (F.col("c") - by).alias("c"), F.col("here").alias(name)), ["batch", "c"], "left")
    reps = reps.join(blocks, ["batch", "c"]).withColumn("i", F.pmod(F.xxhash64("doc_id"), "here").cast("int"))
    others = lambda n, tile: F.transform(F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda o: o < F.coalesce(n, F.lit(0))), tile)
    tile = lambda c, d, i, j, side: F.struct(F.concat_ws("|", c, F.lit(d), i, j, "batch").alias("key"), side.cast("int").alias("side"))
    own, c = F.col("i"), F.col("c")
    tiles = F.concat(
        others(F.col("here"), lambda o: tile(c, 0, F.least(own, o), F.greatest(own, o), own > o)),
        others(F.col("above"), lambda o: tile(c, 1, own, o, F.lit(0))),
        others(F.col("below"), lambda o: tile(c - 1, 1, o, own, F.lit(1))),
    )
    return reps.select(F.explode(tiles).alias("x"), "doc_id", "k", "sig").select("x.*", "doc_id", "k", "sig")


def _packed(ids: np.ndarray) -> bytes:
    """Ascending numbers in few bytes."""
    return zlib.compress(np.diff(ids, prepend=0).astype("<i8").tobytes(), 1)


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(packed), "<i8"))


def _lists(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each b with its a, ascending."""
    order = np.lexsort((a, b))
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.diff(b)) + 1
    return zip(b[np.concatenate(([0], cuts))].tolist(), np.split(a, cuts), strict=True)


def _candidates(tiles: DataFrame, threshold: float) -> DataFrame:
    """(b, m, others): the texts a < b that size and signatures do not rule out for b, packed, and the first of them.

    Each pair is in one row; a text has a row for each pair of pieces that finds
    some. First by signatures folded to ``FOLD`` bits, whose distances a matrix
    product yields together with what the sizes allow, then by all their bits.
    """
    share = (1 - threshold) / (1 + threshold)

    def side(rows: pa.Table) -> tuple[np.ndarray, ...]:
        k = rows.column("k").to_numpy().astype(np.int64)
        order = np.argsort(k, kind="stable")
        words = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint64).reshape(len(k), -1)[order]
        return rows.column("doc_id").to_numpy()[order], k[order], words

    def signs(k: np.ndarray, words: np.ndarray, left: bool) -> np.ndarray:
        folded = np.bitwise_xor.reduce(words.reshape(len(k), BITS // FOLD, -1), axis=1)
        size, one = np.minimum(2 * share * k, 2 * FOLD)[:, None], np.ones((len(k), 1))
        bits = np.unpackbits(folded.view(np.uint8), axis=1).astype(np.float32) * 2 - 1
        return np.hstack([bits, *((size, one) if left else (one, size))]).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches):
            name = key.split("|", 4)
            alone = name[1] == "0" and name[2] == name[3]
            x = side(rows.filter(pc.equal(rows.column("side"), 0)))
            y = x if alone else side(rows.filter(pc.equal(rows.column("side"), 1)))
            for i in range(0, len(x[0]), PIECE):
                doc, k, words = (v[i : i + PIECE] for v in x)
                left = None
                for j in range(i if alone else 0, len(y[0]), PIECE):
                    doc_y, k_y, words_y = (v[j : j + PIECE] for v in y)
                    if min(k[-1], k_y[-1]) + SLACK < threshold * max(k[0], k_y[0]):
                        continue
                    left = signs(k, words, True) if left is None else left
                    p, q = np.nonzero(left @ signs(k_y, words_y, False).T >= FOLD - 0.1)
                    ok = np.minimum(k[p], k_y[q]) + SLACK >= threshold * np.maximum(k[p], k_y[q])
                    p, q = p[ok & (p < q)] if alone and i == j else p[ok], q[ok & (p < q)] if alone and i == j else q[ok]
                    kept = []
                    for at in range(0, len(p), PIECE * 64):
                        r, s = p[at : at + PIECE * 64], q[at : at + PIECE * 64]
                        apart = np.bitwise_count(words[r] ^ words_y[s]).sum(axis=1, dtype=np.int64)
                        kept.append(apart <= share * (k[r] + k_y[s]) + SLACK)
                    ok = np.concatenate(kept) if kept else np.zeros(0, bool)
                    if ok.any():
                        a, b = doc[p[ok]], doc_y[q[ok]]
                        found = [(at, int(own[0]), _packed(own)) for at, own in _lists(np.minimum(a, b), np.maximum(a, b))]
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), NEAR.types, strict=True)], schema=NEAR)

    return _dealt(tiles).mapInArrow(run, "b bigint, m bigint, others binary")


def _named(near: DataFrame, slots: int) -> bytes:
    """A filter of ``slots`` bits that has those of all texts in ``near``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids = [batch.column("b").to_numpy(), *map(_unpacked, batch.column("others").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(ids)))], ["doc_id"])

    at = near.select("b", "others").mapInArrow(run, "doc_id bigint").select(_slot(slots).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("bits")).toArrow()
    out = np.zeros(slots // 64, np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def _slot(slots: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(slots))


def _wanted(texts: DataFrame, near: DataFrame, most: int) -> DataFrame:
    """(doc_id, batch, t) of the texts in ``near`` and a few others, compressed: all others are left where they are. ``most``: texts there are."""
    slots = 1 << min(26, max(10, (8 * most).bit_length()))
    bits = np.frombuffer(_named(near, slots), np.uint8)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("slot").to_numpy()
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))).drop_columns("slot")

    def press(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pressed = [zlib.compress(t.as_py().encode("utf-8", "surrogatepass"), 1) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("batch"), pa.array(pressed, pa.binary())], ["doc_id", "batch", "t"])

    found = texts.select("doc_id", "batch", "text", _slot(slots).alias("slot")).mapInArrow(pick, "doc_id bigint, batch string, text string")
    return found.select("doc_id", "batch", normalise(F.col("text")).alias("t")).mapInArrow(press, "doc_id bigint, batch string, t binary")


def _brought(near: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """(key, doc_id, others, batch, t): the texts of candidates, once for many pairs; others are lists of those to compare a text with.

    Texts whose first candidate, or its first one, is the same are mostly one family
    and meet in one group, or, if they are many, in groups of two of its parts.
    """
    first = near.groupBy("b").agg(F.min("m").alias("m"))
    before = first.select(F.col("b").alias("m"), F.col("m").alias("up"))
    first = first.join(before, "m", "left").select("b", F.coalesce("up", "m").alias("m"))
    parts = first.groupBy("m").agg(F.ceil(F.count("*") / FAMILY).cast("bigint").alias("n"))
    part = lambda ids, n: ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % n

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen = [], {}
            for b, m, n, others in zip(*(batch.column(c).to_pylist() for c in ("b", "m", "n", "others")), strict=True):
                ids, own = _unpacked(others), int(part(np.array([b]), n)[0])
                at = part(ids, n)
                for i in np.unique(at).tolist():
                    key, here = f"{m}|{min(i, own)}|{max(i, own)}", ids[at == i]
                    rows.append((key, b, _packed(here)))
                    seen.setdefault(key, []).append(here)
            rows += [(key, a, None) for key, lists in seen.items() for a in np.unique(np.concatenate(lists)).tolist()]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.binary()), strict=True)], ["key", "doc_id", "others"])

    rows = near.select("b", "others").join(first.join(parts, "m"), "b").select("b", "m", "n", "others").mapInArrow(deal, "key string, doc_id bigint, others binary")
    return rows.groupBy("key", "doc_id").agg(F.collect_list("others").alias("others")).join(_wanted(texts, near, most), "doc_id").select("key", "doc_id", "others", "batch", "t")


def _shared(sets: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Numbers of trigrams that the sets p and q of each pair share: by a matrix product where pairs are dense, else pair by pair."""
    left, right = np.unique(p), np.unique(q)
    words = np.unique(np.concatenate(sets)) if len(p) >= LEAST_DENSE else np.zeros(0, np.int64)
    if not len(words) or len(left) * len(right) * len(words) > WORTH * len(p):
        out = np.zeros(len(p), np.int64)
        for at, (i, j) in enumerate(zip(p.tolist(), q.tolist(), strict=True)):
            x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
            out[at] = np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x)
        return out
    at = [np.searchsorted(words, s) for s in sets]
    step = max(1, CELLS // max(len(left), len(right)))

    def cells(rows: np.ndarray, start: int) -> np.ndarray:
        out = np.zeros((len(rows), min(step, len(words) - start)), np.float32)
        for i, row in enumerate(rows.tolist()):
            low, high = np.searchsorted(at[row], (start, start + step))
            out[i, at[row][low:high] - start] = 1
        return out

    both = sum(cells(left, start) @ cells(right, start).T for start in range(0, len(words), step))
    return both[np.searchsorted(left, p), np.searchsorted(right, q)].astype(np.int64)


def _confirmed(rows: DataFrame, threshold: float, first: bool) -> DataFrame:
    """(batch, a, b, jaccard) of the rows of ``_brought`` that are alike; with ``first`` only the first of each text in a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batches):
            group = group.sort_by("doc_id")
            docs, names = group.column("doc_id").to_numpy(), group.column("batch")
            sets = [_grams(zlib.decompress(t.as_py()).decode("utf-8", "surrogatepass")) for t in group.column("t")]
            sizes = np.array([len(s) for s in sets], np.int64)
            pairs = [(i, np.concatenate([_unpacked(o) for o in others])) for i, others in enumerate(group.column("others").to_pylist()) if others]
            p = np.searchsorted(docs, np.concatenate([a for _, a in pairs]))
            q = np.repeat([i for i, _ in pairs], [len(a) for _, a in pairs])
            shared = _shared(sets, p, q)
            alike = shared / (sizes[p] + sizes[q] - shared)
            ok = np.flatnonzero(alike >= threshold)
            if first:
                ok = ok[np.lexsort((p[ok], q[ok]))]
                ok = ok[np.unique(q[ok], return_index=True)[1]]
            for at in range(0, len(ok), PIECE * 32):
                r = ok[at : at + PIECE * 32]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(q[r])).combine_chunks(), pa.array(docs[p[r]]), pa.array(docs[q[r]]), pa.array(alike[r])], schema=PAIRS)

    return _dealt(rows).mapInArrow(run, "batch string, a bigint, b bigint, jaccard double")


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_CHARS, first: bool = False) -> DataFrame:
    """(batch, a, b, jaccard) of distinct texts of one batch, a < b by doc_id, both at least ``least`` characters.

    Equal texts are one representative first. Of each there are the number of its
    trigrams and the parities of ``BITS`` hash classes of them, both exact bounds;
    they are compared in pairs of blocks inside tasks, and only what passes gets
    its texts, compressed, whose trigrams are intersected. Trigrams are made from the texts in each
    task and never stored. With ``first``, some pairs of a text may be missing,
    but never the one with its first a.
    """
    texts = docs.filter(F.length("text") >= least).select("doc_id", F.coalesce("source", F.lit("")).alias("batch"), "text")
    reps = _signed(texts.select("doc_id", "batch", normalise(F.col("text")).alias("t"))).groupBy("batch", "h", "n").agg(F.min("doc_id").alias("doc_id"), F.first("k").alias("k"), F.first("sig").alias("sig"))
    reps = materialise(reps.filter("k > 0").select("doc_id", "batch", "k", "sig"), "reps")
    near = materialise(_candidates(_tiles(reps, threshold), threshold), "near")
    return _confirmed(_brought(near, texts, reps.count()), threshold, first)


def first_matches(docs: DataFrame, threshold: float = THRESHOLD, least: int = LEAST_CHARS) -> DataFrame:
    """doc_id, match_id, kind for each document that has an earlier duplicate in its batch.

    An exact duplicate wins over a near one; among candidates the lowest doc_id.
    Near matches are found between representatives of equal texts and passed on
    to every copy.
    """
    texts = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("batch"), F.length("text").alias("n"), F.sha2(normalise(F.col("text")), 256).alias("h"))
    first = texts.groupBy("batch", "h").agg(F.min("doc_id").alias("first_id"))
    texts = texts.join(first, ["batch", "h"])
    pairs = similar_pairs(docs, threshold, least, first=True)
    earlier = pairs.groupBy("batch", F.col("b").alias("first_id")).agg(F.min("a").alias("near_id"))
    out = texts.filter(F.col("n").isNotNull()).join(earlier, ["batch", "first_id"], "left")
    exact = F.col("first_id") < F.col("doc_id")
    kind = F.when(exact, "exact").when(F.col("near_id").isNotNull() & (F.col("n") >= least), "near")
    match = F.when(exact, F.col("first_id")).when(F.col("n") >= least, F.col("near_id"))
    return out.select("doc_id", match.alias("match_id"), kind.alias("kind")).filter("kind IS NOT NULL")


def duplicate_groups(matches: DataFrame) -> DataFrame:
    """doc_id, group_id: the end of each document's chain of matches, by pointer jumping (log n joins)."""
    links = materialise(matches.select("doc_id", F.col("match_id").alias("up")), "links")
    for _ in range(64):
        higher = links.select(F.col("doc_id").alias("up"), F.col("up").alias("next"))
        jumped = materialise(links.join(higher, "up", "left").select("doc_id", F.coalesce("next", "up").alias("up"), F.col("next").isNotNull().alias("moved")), "links")
        links = jumped.select("doc_id", "up")
        if jumped.filter("moved").isEmpty():
            break
    return links.select("doc_id", F.col("up").alias("group_id"))
