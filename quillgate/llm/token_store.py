"""Token ids in directly addressable codes.

An id is split into chunks of 8 bits, the lowest first. Level k holds the k-th
chunk of every id that has one, a bitmap that says which of them go on to level
k + 1, and a rank directory (ones before each 512-bit block). Token i is read
by one look per level: its chunk, its bit, and the rank of the bit, which is its
place on the next level. No block is decoded on the way.

A segment is a self-contained byte string of whole documents; a store is a
Parquet table of segments in ascending doc_id order, so it lives in any file
system that Spark reads and writes.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgate.llm.scratch import Scratch
from quillgate.llm.tokenizing import END_ID, default_path, encoder
from quillgate.llm.worker import release

MAGIC = b"QDAC"
BLOCK = 512  # bits between rank directory entries
SEGMENT_TOKENS = 1 << 20
SEGMENT_DOCS = 4096


def pack_segment(ids: np.ndarray, bounds: np.ndarray) -> bytes:
    """Bytes of one segment: ``ids`` of all its documents, ``bounds`` where each begins and the last ends."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        chunk, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
        levels.append((chunk, more))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [struct.pack("<4sHQQ", MAGIC, len(levels), len(bounds) - 1, len(ids)), bounds.astype("<u8").tobytes()]
    for chunk, more in levels:
        bits = np.packbits(more, bitorder="little")
        bits = np.r_[bits, np.zeros(-len(bits) % (BLOCK // 8), dtype=np.uint8)]
        ones = np.bitwise_count(bits.view("<u8")).reshape(-1, BLOCK // 64).sum(1)
        ranks = np.r_[0, np.cumsum(ones)].astype("<u4")
        out += [struct.pack("<Q", len(chunk)), chunk.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Segment:
    """Reads a segment without decoding it."""

    def __init__(self, data: bytes) -> None:
        magic, n_levels, self.n_docs, self.n_tokens = struct.unpack_from("<4sHQQ", data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = struct.calcsize("<4sHQQ")
        take = lambda kind, n: np.frombuffer(data, dtype=kind, count=n, offset=at)
        self.bounds = take("<u8", self.n_docs + 1).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            chunk = take(np.uint8, n)
            at += n
            blocks = -(-n // BLOCK)
            bits = take(np.uint8, blocks * BLOCK // 8)
            at += blocks * BLOCK // 8
            ranks = take("<u4", blocks + 1)
            at += 4 * (blocks + 1)
            self.levels.append((chunk, bits, ranks))

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit ``i``: a directory entry and at most one block."""
        _, bits, ranks = self.levels[level]
        block = i // BLOCK
        head, tail = bits[block * BLOCK // 8 : i // 8], i % 8
        return int(ranks[block]) + int(np.bitwise_count(head).sum()) + (int(bits[i // 8] & ((1 << tail) - 1)).bit_count() if tail else 0)

    def token(self, i: int) -> int:
        """The i-th id of the segment."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = level = 0
        while True:
            chunk, bits, _ = self.levels[level]
            value |= int(chunk[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                return value
            i, shift, level = self._rank(level, i), shift + 8, level + 1

    def tokens(self, start: int, end: int) -> np.ndarray:
        """Ids start..end: each level's part is found by two ranks and read as it stands."""
        out = np.zeros(end - start, dtype=np.uint32)
        where, a, b = np.arange(end - start), start, end
        for level, (chunk, bits, _) in enumerate(self.levels):
            out[where] |= chunk[a:b].astype(np.uint32) << np.uint32(8 * level)
            if level + 1 == len(self.levels) or a == b:
                break
            more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
            where, a, b = where[more], self._rank(level, a), self._rank(level, b) if b % BLOCK or b // BLOCK < len(self.levels[level][2]) - 1 else int(self.levels[level][2][-1])
        return out

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.bounds[k]), int(self.bounds[k + 1]))


def write_store(docs: DataFrame, scratch: Scratch, path: str | None = None, end: int = END_ID) -> DataFrame:
    """Encode and write ``docs``; returns the store: part, place, doc_ids, n_tokens, start, segment.

    Parts are ranges of doc_id in ascending order, ``place`` orders the segments
    of a part, ``start`` counts the ids of the part before the segment. Null
    texts are empty (the end id alone); null doc_ids come first; rows that share
    a doc_id follow one another in the order of their texts.
    """
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, place, start = TaskContext.get().partitionId(), 0, 0
        names: list = []
        held: list[bytes] = []
        size = 0

        def flush() -> pd.DataFrame:
            nonlocal names, held, size, place, start
            bounds = np.cumsum([0, *(len(h) // 4 for h in held)])
            segment = pack_segment(np.frombuffer(b"".join(held), dtype="<u4"), bounds)
            row = pd.DataFrame({"part": [part], "place": [place], "doc_ids": [names], "n_tokens": [size], "start": [start], "segment": [segment]})
            place, start, names, held, size = place + 1, start + size, [], [], 0
            return row

        for pdf in batches:
            ids = pdf["doc_id"].astype(object).where(pdf["doc_id"].notna(), None).tolist()
            texts = pdf["text"].tolist()
            for at in range(0, len(texts), 1000):
                block = [t if isinstance(t, str) else "" for t in texts[at : at + 1000]]
                for name, data in zip(ids[at : at + 1000], encoder(path).encode(block, end), strict=True):
                    names.append(name)
                    held.append(data)
                    size += len(data) // 4
                    if size >= SEGMENT_TOKENS or len(held) >= SEGMENT_DOCS:
                        yield flush()
        if held:
            yield flush()
        release()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInPandas(encode, f"part int, place int, doc_ids array<{kind}>, n_tokens bigint, start bigint, segment binary")
    rows.write.option("compression", "zstd").parquet(scratch.path("store"))
    return scratch.get("store", rows)


def read_store(store: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    kind = store.schema["doc_ids"].dataType.elementType.simpleString()
    parts = store.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per partition of the writer
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("base"))

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, names, start, data in zip(pdf["part"], pdf["doc_ids"], pdf["start"], pdf["segment"], strict=True):
                segment = Segment(data)
                ids = segment.tokens(0, segment.n_tokens).astype("<u4").tobytes()
                bounds = segment.bounds.tolist()
                yield pd.DataFrame({
                    "doc_id": pd.Series(list(names), dtype=object), "part": part, "start": start + segment.bounds[:-1], "n_tokens": np.diff(segment.bounds),
                    "ids_crc32": [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(bounds, bounds[1:])],
                })

    rows = store.select("part", "doc_ids", "start", "segment").mapInPandas(decode, f"doc_id {kind}, part int, start bigint, n_tokens bigint, ids_crc32 bigint")
    rows = rows.join(F.broadcast(parts), rows["part"] == parts["p"])  # as many rows as the writer had partitions
    return rows.select("doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_store(write_store(docs, Scratch(spark, "tokens")))
