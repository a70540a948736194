"""Near-duplicate embeddings with hierarchical navigable small-world graphs.

Vectors are dealt into shards by label; each shard gets a graph, and every shard
of a label is searched with the vectors of every other (and its own). Searches
run side by side: the beams of many queries advance together in array steps. A
beam that is full of links is widened, and all beams are widened until an audit
of random queries against brute force finds their links. Pairs are verified by cosine in
double precision; components are joined by contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.components import components
from quillgate.llm.scratch import Scratch

COSINE = 0.98
SHARD = 8192
DEGREE = 16
BEAM = 48
RECALL = 0.995
#: Audited queries are drawn by the AUDIT until AUDIT_LINKED with links are seen, AUDIT_MOST at most.
AUDIT, AUDIT_LINKED, AUDIT_MOST = 64, 128, 1024
QUERIES = 256
#: Single-precision slack of the search; verification is in double precision.
SLACK = 1e-4


class Graph:
    """Layers of neighbour lists over unit vectors; layer 0 holds all nodes and twice the degree."""

    def __init__(self, unit: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.unit, self.layers = unit, layers

    @classmethod
    def build(cls, unit: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 7) -> Graph:
        """Insert nodes from the highest layer down, in growing batches; a batch also sees its own earlier members."""
        n, rng = len(unit), np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(degree)).astype(int), 6)
        order = np.lexsort((rng.random(n), -level))
        top = int(level.max()) if n else 0
        # A node's row in the arrays of a layer is the node itself; upper layers are sparse but small.
        layers = [(np.zeros(0, dtype=np.int64), np.full((n, degree * (2 if k == 0 else 1)), -1, dtype=np.int32)) for k in range(top + 1)]
        graph = cls(unit, layers)
        at, size = 0, 1
        while at < n:
            batch = order[at : at + size]
            for k in range(top, -1, -1):
                members = batch[level[batch] >= k]
                if len(members):
                    graph._insert(members, k, beam, degree)
            at, size = at + len(batch), min(max(1, at + len(batch)), QUERIES)
        return graph

    def _insert(self, members: np.ndarray, k: int, beam: int, degree: int) -> None:
        present, table = self.layers[k]
        own = np.where(np.arange(len(members))[None, :] < np.arange(len(members))[:, None], members[None, :], -1)
        if len(present):
            found, _ = self._beam(self.unit[members], k, beam, self._entries(self.unit[members], k))
            found = np.concatenate([found, own], axis=1)
        else:
            found = own
        chosen = self._select(members, found, table.shape[1] // 2 if k == 0 else degree)
        table[members, : chosen.shape[1]] = chosen
        target, source = chosen.ravel(), np.repeat(members, chosen.shape[1])
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        nodes, first, count = np.unique(target[by], return_index=True, return_counts=True)
        for lo in range(0, len(nodes), QUERIES):
            part, width = nodes[lo : lo + QUERIES], int(count[lo : lo + QUERIES].max()) if len(nodes) else 0
            step = np.arange(width)[None, :]
            index = np.minimum(first[lo : lo + QUERIES, None] + step, len(by) - 1)
            fresh = np.where(step < count[lo : lo + QUERIES, None], source[by][index], -1)
            table[part] = self._select(part, np.concatenate([table[part], fresh], axis=1), table.shape[1])
        self.layers[k] = (np.concatenate([present, members]), table)

    def _select(self, nodes: np.ndarray, found: np.ndarray, most: int) -> np.ndarray:
        """Neighbours for each node: near ones that are nearer to the node than to a neighbour already taken, then the nearest rest."""
        sims = np.einsum("bd,bcd->bc", self.unit[nodes], self.unit[np.maximum(found, 0)])
        sims[(found < 0) | (found == nodes[:, None])] = -np.inf
        width = min(found.shape[1], 2 * most)
        by = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        found, sims = np.take_along_axis(found, by, 1), np.take_along_axis(sims, by, 1)
        repeat = np.zeros(found.shape, dtype=bool)
        repeat[:, 1:] = (found[:, 1:] == found[:, :-1]) & (sims[:, 1:] > -np.inf)
        sims = np.where(repeat, -np.inf, sims)
        near = self.unit[np.maximum(found, 0)]
        mutual = np.einsum("bcd,bed->bce", near, near)
        taken = np.zeros(found.shape, dtype=bool)
        blocked = np.full(found.shape, -np.inf, dtype=sims.dtype)
        for c in range(width):
            good = (sims[:, c] > blocked[:, c]) & (sims[:, c] > -np.inf) & (taken.sum(1) < most)
            taken[:, c] = good
            blocked = np.where(good[:, None], np.maximum(blocked, mutual[:, c]), blocked)
        rank = np.where(sims == -np.inf, 2 * width, np.where(taken, 0, width)) + np.arange(width)[None, :]
        keep = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(sims, keep, 1) > -np.inf, np.take_along_axis(found, keep, 1), -1)
        if out.shape[1] < most:
            out = np.concatenate([out, np.full((len(out), most - out.shape[1]), -1, dtype=out.dtype)], axis=1)
        return out.astype(np.int32)

    def _entries(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Greedy descent through the layers above ``k``; a node that is on layer ``k`` for each query."""
        top = max((j for j in range(len(self.layers)) if len(self.layers[j][0])), default=k)
        at = np.full(len(queries), self.layers[top][0][0])
        for j in range(top, k, -1):
            found, _ = self._beam(queries, j, 4, at)
            at = found[:, 0]
        return at

    def _beam(self, queries: np.ndarray, k: int, beam: int, entries: np.ndarray, together: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities), best first, -1 where a beam isn't full. Every query opens its best closed nodes until none is left."""
        table, n, rows = self.layers[k][1], len(self.unit), len(queries)
        ids = np.full((rows, beam), -1, dtype=np.int64)
        sims = np.full((rows, beam), -np.inf, dtype=np.float32)
        opened = np.ones((rows, beam), dtype=bool)
        seen = np.zeros((rows, n), dtype=bool)
        ids[:, 0], sims[:, 0], opened[:, 0] = entries, np.einsum("bd,bd->b", queries, self.unit[entries]), False
        seen[np.arange(rows), entries] = True
        live = np.arange(rows)
        while len(live):
            waiting = np.where(opened[live], -np.inf, sims[live])
            pick = np.argsort(-waiting, axis=1, kind="stable")[:, :together]
            valid = np.take_along_axis(waiting, pick, 1) > -np.inf
            going = valid.any(axis=1)
            live, pick, valid = live[going], pick[going], valid[going]
            if not len(live):
                break
            opened[live[:, None], pick] = True
            around = table[np.where(valid, ids[live[:, None], pick], 0)]
            around = np.where(valid[:, :, None], around, -1).reshape(len(live), -1)
            flat = np.unique((np.arange(len(live))[:, None] * n + around)[around >= 0])
            row, node = flat // n, flat % n
            new = ~seen[live[row], node]
            row, node = row[new], node[new]
            seen[live[row], node] = True
            value = np.einsum("cd,cd->c", queries[live[row]], self.unit[node])
            good = value > sims[live[row], -1]
            row, node, value = row[good], node[good], value[good]
            if len(row):
                count = np.bincount(row, minlength=len(live))
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                wide = int(count.max())
                more_ids, more_sims = np.full((len(live), wide), -1, dtype=np.int64), np.full((len(live), wide), -np.inf, dtype=np.float32)
                more_ids[row, place], more_sims[row, place] = node, value
                all_ids = np.concatenate([ids[live], more_ids], 1)
                all_sims = np.concatenate([sims[live], more_sims], 1)
                all_open = np.concatenate([opened[live], more_ids < 0], 1)
                by = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
                ids[live], sims[live], opened[live] = (np.take_along_axis(x, by, 1) for x in (all_ids, all_sims, all_open))
        return ids, sims

    def linked(self, queries: np.ndarray, cosine: float, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs with a similarity of ``cosine`` or more; full beams are widened, up to the whole graph."""
        found_q, found_n = [], []
        for lo in range(0, len(queries), QUERIES):
            rest, width = np.arange(lo, min(lo + QUERIES, len(queries))), min(beam, len(self.unit))
            while len(rest):
                block = max(16, min(len(rest), 2_000_000 // width))
                full = []
                for at in range(0, len(rest), block):
                    some = rest[at : at + block]
                    ids, sims = self._beam(queries[some], 0, width, self._entries(queries[some], 0), 4 if width < 256 else 16)
                    close = (sims >= cosine) & (ids >= 0)
                    done = ~close.all(axis=1) if width < len(self.unit) else np.ones(len(some), dtype=bool)
                    row, place = np.nonzero(close & done[:, None])
                    found_q.append(some[row])
                    found_n.append(ids[row, place])
                    full.append(some[~done])
                rest, width = np.concatenate(full), min(4 * width, len(self.unit))
        return np.concatenate(found_q) if found_q else np.zeros(0, dtype=np.int64), np.concatenate(found_n) if found_n else np.zeros(0, dtype=np.int64)

    def dump(self) -> bytes:
        return b"".join([np.array([len(self.unit), len(self.layers)], dtype="<i8").tobytes(), *(np.array([len(p), t.shape[1]], dtype="<i8").tobytes() + p.astype("<i8").tobytes() + t[p].astype("<i4").tobytes() for p, t in self.layers)])

    @classmethod
    def load(cls, unit: np.ndarray, data: bytes) -> Graph:
        n, count = np.frombuffer(data, dtype="<i8", count=2)
        at, layers = 16, []
        for _ in range(count):
            size, width = np.frombuffer(data, dtype="<i8", count=2, offset=at)
            present = np.frombuffer(data, dtype="<i8", count=size, offset=at + 16)
            table = np.full((n, width), -1, dtype=np.int32)
            table[present] = np.frombuffer(data, dtype="<i4", count=size * width, offset=at + 16 + 8 * size).reshape(size, width)
            layers.append((present, table))
            at += 16 + 8 * size + 4 * size * width
        return cls(unit, layers)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def search(graph: Graph, nodes: np.ndarray, queries: np.ndarray, cosine: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Verified (query, node) pairs; ``nodes`` and ``queries`` are the vectors in double precision.

    Queries drawn at random, whatever was found for them, are also answered by
    brute force until AUDIT_LINKED of them have links (or AUDIT_MOST are done);
    all beams are widened until the mean share of a query's links that is found
    reaches RECALL. Each audited query counts alike, however many links it has.
    """
    unit, beam = unit_vectors(queries), BEAM
    length, own = np.linalg.norm(nodes, axis=1), np.linalg.norm(queries, axis=1)
    while True:
        q, x = graph.linked(unit, cosine - SLACK, beam)
        exact = np.zeros(len(q))
        for lo in range(0, len(q), 100_000):
            a, b = q[lo : lo + 100_000], x[lo : lo + 100_000]
            exact[lo : lo + 100_000] = np.einsum("nd,nd->n", queries[a], nodes[b]) / (own[a] * length[b])
        q, x = q[exact >= cosine], x[exact >= cosine]
        if beam >= len(nodes) or audited(nodes, queries, length, own, q, x, cosine) >= RECALL:
            return q, x
        beam *= 2


def audited(nodes: np.ndarray, queries: np.ndarray, length: np.ndarray, own: np.ndarray, q: np.ndarray, x: np.ndarray, cosine: float) -> float:
    """The mean share of its links that a random query with links found; 1 if no audited query has any."""
    order, shares = np.random.default_rng(11).permutation(len(queries))[:AUDIT_MOST], []
    for lo in range(0, len(order), AUDIT):
        sample = np.sort(order[lo : lo + AUDIT])
        truth = queries[sample] @ nodes.T / (own[sample][:, None] * length[None, :]) >= cosine
        mine = np.zeros(truth.shape, dtype=bool)
        asked = np.isin(q, sample)
        mine[np.searchsorted(sample, q[asked]), x[asked]] = True
        some = truth.any(axis=1)
        shares += ((truth & mine)[some].sum(axis=1) / truth[some].sum(axis=1)).tolist()
        if len(shares) >= AUDIT_LINKED:
            break
    return float(np.mean(shares)) if shares else 1.0


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component under links (a, b)."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label, ka, kb (key of the vector, null where it can't be compared), width, vec (bytes)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in pdf["v"]:
                x = np.asarray(v if v is not None else [], dtype=np.float64) + 0.0
                if len(x) and np.isfinite(x).all() and np.isfinite(x @ x) and x @ x > 0:
                    data = x.astype("<f8").tobytes()
                    digest = xxhash.xxh3_128_digest(data)
                    out.append((int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), len(x), data))
                else:
                    out.append((None, None, None, None))
            keys = pd.DataFrame(out, columns=["ka", "kb", "width", "vec"], dtype=object)
            keys[["ka", "kb", "width"]] = keys[["ka", "kb", "width"]].astype("Int64")
            yield pd.concat([pdf[["vec_id", "label"]].reset_index(drop=True), keys], axis=1)

    kind = vectors.schema[label_col].dataType.simpleString()
    whole = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), F.when(F.exists(whole, lambda x: x.isNull()), None).otherwise(whole).alias("v"))
    return rows.filter("vec_id IS NOT NULL").mapInPandas(read, f"vec_id bigint, label {kind}, ka bigint, kb bigint, width int, vec binary")


def link_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row with an id.

    Vectors of one label are linked at a cosine of ``cosine`` or more. Null and
    zero vectors, vectors with null or non-finite components and rows without a
    label have no links; vectors of different widths are never compared. Equal
    vectors are searched once and counted as often as they occur. Rows without
    an id are left out; further columns are ignored; an empty table gives none.
    """
    scratch = Scratch(vectors.sparkSession, "hnsw")
    slots = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scratch.put(usable(vectors, id_col, vector_col, label_col), "vectors")
    able = rows.filter("ka IS NOT NULL AND label IS NOT NULL")
    # Copies are joined before anything is compared; a partial result per task is all that a much-repeated vector shuffles.
    reps = able.groupBy("label", "ka", "kb").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("width").alias("width"), F.first("vec").alias("vec"))
    reps = scratch.put(reps, "reps")
    sizes = scratch.put(reps.groupBy("label", "width").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")), "sizes")
    dealt = reps.join(sizes, ["label", "width"]).withColumn("shard", F.pmod(F.xxhash64("ka", "kb"), F.col("shards").cast("long")).cast("int"))
    kind = reps.schema["label"].dataType.simpleString()

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        data = b"".join(pdf["vec"])
        graph = Graph.build(unit_vectors(np.frombuffer(data, dtype="<f8").reshape(len(pdf), -1)))
        return pd.DataFrame({
            "label": [key[0]], "width": [key[1]], "shard": [key[2]], "nodes": [pdf["node"].to_numpy("<i8").tobytes()],
            "copies": [pdf["copies"].to_numpy("<i8").tobytes()], "vecs": [data], "graph": [graph.dump()],
        })

    shards = dealt.groupBy("label", "width", "shard").applyInPandas(build, f"label {kind}, width int, shard int, nodes binary, copies binary, vecs binary, graph binary")
    shards = scratch.put(shards, "graphs")
    # Pairs of shard numbers first, half of a shard's pairs at home with it; the vectors are brought to them by shard, so no task sees a whole label.
    grid = sizes.select("label", "width", "shards", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.floor(F.col("shards") / 2).cast("int"))).alias("step")).withColumn("other", (F.col("shard") + F.col("step")) % F.col("shards"))
    grid = grid.filter("step = 0 OR 2 * step < shards OR shard < other").select("label", "width", "shard", "other").repartition(slots, "label", "width", "shard")
    asking = shards.select("label", "width", F.col("shard").alias("other"), F.col("nodes").alias("q_nodes"), F.col("copies").alias("q_copies"), F.col("vecs").alias("q_vecs"))
    pairs = grid.join(shards, ["label", "width", "shard"]).join(asking, ["label", "width", "other"]).repartition(slots, "label", "shard", "other")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                names = [np.frombuffer(x, dtype="<i8") for x in (row.nodes, row.q_nodes)]
                copies = [np.frombuffer(x, dtype="<i8") for x in (row.copies, row.q_copies)]
                nodes, queries = (np.frombuffer(x, dtype="<f8").reshape(-1, row.width) for x in (row.vecs, row.q_vecs))
                q, x = search(Graph.load(unit_vectors(nodes), row.graph), nodes, queries, cosine)
                if row.shard == row.other:
                    pair = np.unique(np.minimum(q, x)[q != x] * len(nodes) + np.maximum(q, x)[q != x])
                    a, b, all_names, all_copies = pair // len(nodes), pair % len(nodes), names[0], copies[0]
                else:
                    a, b, all_names, all_copies = x, q + len(nodes), np.concatenate(names), np.concatenate(copies)
                links = np.zeros(len(all_names), dtype=np.int64)
                np.add.at(links, a, all_copies[b])
                np.add.at(links, b, all_copies[a])
                order = np.argsort(all_names, kind="stable")
                place = np.empty(len(order), dtype=np.int64)
                place[order] = np.arange(len(order))
                root = all_names[order][_roots(len(order), place[a], place[b])][place]
                some = links > 0
                yield pd.DataFrame({"node": all_names[some], "links": links[some], "root": root[some]})

    found = scratch.put(pairs.select("width", "shard", "other", "nodes", "copies", "vecs", "graph", "q_nodes", "q_copies", "q_vecs").mapInPandas(ask, "node bigint, links bigint, root bigint"), "found")
    scratch.drop("graphs")
    labels = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = reps.select("label", "ka", "kb", "node", "copies").join(counts, "node", "left").join(labels.withColumnRenamed("label", "component"), "node", "left")
    whole = whole.select("label", "ka", "kb", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    whole = scratch.put(whole, "whole")
    scratch.drop("reps", "sizes", "found")
    out = rows.select("vec_id", "label", "ka", "kb").join(whole, ["label", "ka", "kb"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_hnsw_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
