"""Toxicity by compression distance: two zstandard dictionaries, calibrated window lengths.

Text is compressed in windows of fixed length, one from every word border on. Each
window is compressed with a dictionary of toxic text and with one of ordinary
text; the bytes that the toxic one saves are its gain. The shares of a document's
windows with gains over several thresholds go into a logistic calibration.

Most text of a toxic document is ordinary. Which of its passages are toxic is
found by compression too: the documents are dealt into parts, each part fills a
dictionary with whole texts, and a passage enters the final toxic dictionary if
the dictionaries of the other parts save more on it, on average against as many
ordinary ones, than on all but a thousandth of held-back ordinary passages. Both
final dictionaries begin with the same whole ordinary texts, so that ordinary
windows cost the same under both.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgate.llm.worker import only, release

#: Every run of ASCII signs that are no letters becomes this mark, in dictionaries and windows alike.
MARK = b"\x01\x02\x03 "
BORDER = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
#: Bytes of running text in a window, after the mark that it starts with.
WINDOW = 10
#: Stands around every window, and at the end of both dictionaries, so that a block is always worth compressing.
CARRIER = b"<<[window of text]>>"
#: Bytes of ordinary text that both dictionaries share, and the most of the passages after it.
SHARED_BYTES, PASSAGE_BYTES = 131_072, 16_384
#: Parts of the toxic documents that judge each other's passages, and the most bytes of text in the dictionary of a part.
PARTS, PART_BYTES = 8, 100_000
STRICT = 0.999
#: Bytes that one dictionary's saving counts at most.
MOST_SAVED = 4
#: Pairs of dictionaries whose mean gain is taken.
PAIRS = 2
#: Ordinary dictionaries for each toxic one: there is more ordinary text, and their mean is the steadier for it.
PLAIN = 3
#: Bytes that one text gives to a dictionary at most, so that many texts, in all their languages, have a share in it.
SHARE_BYTES = 3000
LEVELS = (1, 2, 3, 4, 5, 6)
#: Most labelled documents of either class that a model is fitted on; of a longer text among them the fit reads so many characters from a place chosen by its id.
SAMPLE = 3000
LONGEST = 20_000
THRESHOLD = 0.3
#: Texts of fewer windows count as this long where gains are set against length, so that an empty text is no extreme.
SHORT = 100
RIDGE = 2e-3
#: Bytes of text whose windows are held at once.
CHUNK = 2_000_000
#: Windows whose gains a worker remembers.
MEMO = 400_000


def marked(text: str | None) -> bytes:
    """Lower-cased bytes with a mark in front and in place of every word border."""
    return MARK + BORDER.sub(MARK, (text or "").lower().encode("utf-8", "replace")).removeprefix(MARK)


def windows(text: bytes, own: int | None = None) -> np.ndarray:
    """A row of bytes for every mark of ``text`` with something behind it, or only of its first ``own`` bytes: the mark and WINDOW bytes after it (blanks beyond the end)."""
    codes = np.frombuffer(text + b" " * WINDOW, dtype=np.uint8)
    last = max(0, len(text) - len(MARK))
    at = np.flatnonzero(codes[: last if own is None else min(own, last)] == MARK[0])
    return codes[at[:, None] + np.arange(len(MARK) + WINDOW)]


def windows_of(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts and the number of the text of each."""
    found = [windows(t) for t in texts]
    empty = np.zeros((0, len(MARK) + WINDOW), dtype=np.uint8)
    return np.concatenate([empty, *found]), np.repeat(np.arange(len(found)), [len(w) for w in found])


def joined(texts: Sequence[bytes], most: int) -> bytes:
    """Text of a dictionary: a stretch of each text, ``most`` bytes in all."""
    return b"".join(t[:SHARE_BYTES] for t in texts)[:most]


def tally(texts: Sequence[bytes], together: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The different windows of all texts and how often each occurs, gathered some texts at a time."""
    rows, often = np.zeros((0, len(MARK) + WINDOW), dtype=np.uint8), np.zeros(0, dtype=np.int64)
    parts, counts, held = [], [], 0
    for lo in range(0, len(texts), together):
        part, which = distinct(windows_of(texts[lo : lo + together])[0])
        parts.append(part)
        counts.append(np.bincount(which, minlength=len(part)))
        held += len(part)
        if held > 2 * len(rows) + 100_000 or lo + together >= len(texts):
            rows, which = distinct(np.concatenate([rows, *parts]))
            often = np.bincount(which, weights=np.concatenate([often, *counts]), minlength=len(rows)).astype(np.int64)
            parts, counts, held = [], [], 0
    return rows, often


def least_of_share(values: np.ndarray, often: np.ndarray, share: float) -> float:
    """The value that ``share`` of all stay below or at, each counted as often as it occurs."""
    order = np.argsort(values, kind="stable")
    running = np.cumsum(often[order])
    return float(values[order][min(len(order) - 1, np.searchsorted(running, share * running[-1]))])


class Dictionary:
    """Compressed lengths of windows under one raw-content dictionary."""

    def __init__(self, content: bytes) -> None:
        settings = zstandard.ZstdCompressionParameters.from_level(
            9, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            strategy=zstandard.STRATEGY_LAZY2, min_match=4, search_log=5, hash_log=17, chain_log=17, window_log=19,
        )
        held = zstandard.ZstdCompressionDict(content + CARRIER, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(compression_params=settings, dict_data=held).multi_compress_to_buffer

    def lengths(self, rows: np.ndarray) -> np.ndarray:
        edge, out = np.frombuffer(CARRIER, dtype=np.uint8), [np.zeros(0, dtype=np.int16)]
        for lo in range(0, len(rows), 20_000):
            part = rows[lo : lo + 20_000]
            blocks = np.empty((len(part), part.shape[1] + 2 * len(edge)), dtype=np.uint8)
            blocks[:, : len(edge)] = blocks[:, -len(edge) :] = edge
            blocks[:, len(edge) : -len(edge)] = part
            places = np.full((len(part), 2), blocks.shape[1], dtype="<u8")
            places[:, 0] *= np.arange(len(part), dtype=np.uint64)
            packed = self.compress(zstandard.BufferWithSegments(blocks.tobytes(), places.tobytes()), threads=1)
            out.append(np.fromiter((len(packed[i]) for i in range(len(part))), dtype=np.int16, count=len(part)))
        return np.concatenate(out)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and for every row the place of its equal among them."""
    if not len(rows):
        return rows, np.zeros(0, dtype=np.int64)
    keys = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0]  # marked text holds no zero byte
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return rows[first], which


class Panel:
    """Pairs of dictionaries; ``gains`` are the bytes that the toxic ones save over the ordinary ones, per window, on average."""

    def __init__(self, dictionaries: Sequence[tuple[bytes, bytes]], memo: int = MEMO) -> None:
        self.pairs, self.most = [(Dictionary(a), Dictionary(b)) for a, b in dictionaries], memo
        self.memo: dict[bytes, float] = {}

    def gains(self, rows: np.ndarray) -> np.ndarray:
        rows, which = distinct(rows)
        if len(self.memo) > self.most:
            self.memo.clear()
        names = np.ascontiguousarray(rows).view(f"V{rows.shape[1]}")[:, 0].tolist() if len(rows) else []
        fresh = [i for i, name in enumerate(names) if name not in self.memo]
        if fresh:
            part = rows[fresh]
            gain = sum((b.lengths(part) - a.lengths(part) for a, b in self.pairs), np.zeros(len(part))) / max(1, len(self.pairs))
            self.memo.update(zip([names[i] for i in fresh], gain.tolist(), strict=True))
        return np.fromiter(map(self.memo.__getitem__, names), dtype=np.float64, count=len(names))[which]

    def counts(self, texts: Sequence[str | None]) -> np.ndarray:
        """Per text: different windows, their summed gains, those of a gain at every level; long texts are taken in parts cut at marks."""
        out = np.zeros((len(texts), 2 + len(LEVELS)))
        held, owner, size = [], [], 0

        def flush() -> None:
            cut = [distinct(windows(t, n))[0] for t, n in held]
            gain = self.gains(np.concatenate([windows(b""), *cut]))
            at = np.repeat(np.array(owner, dtype=np.int64), [len(w) for w in cut])
            for column, weight in enumerate((None, gain, *(gain >= k for k in LEVELS))):
                out[:, column] += np.bincount(at, weights=weight, minlength=len(texts))
            held.clear(), owner.clear()

        for i, text in enumerate(texts):
            whole, start = marked(text), 0
            while start < len(whole):
                cut = whole.find(MARK, start + CHUNK) if len(whole) - start > CHUNK else -1
                stop = cut if cut >= 0 else len(whole)
                held.append((whole[start : stop + WINDOW], stop - start))  # the last windows reach beyond the cut
                owner.append(i)
                size, start = size + stop - start, stop
                if size >= CHUNK:
                    flush()
                    size = 0
        flush()
        return out


def features(counts: np.ndarray) -> np.ndarray:
    """Mean gain, for every level the share of windows and the logarithm of their number, and that of all windows (SHORT at least)."""
    n = np.maximum(counts[:, :1], 1)
    return np.concatenate([counts[:, 1:2] / n, counts[:, 2:] / n, np.log1p(counts[:, 2:]), np.log(np.maximum(n, SHORT))], axis=1)


@dataclass(frozen=True)
class ToxicModel:
    dictionaries: tuple[tuple[bytes, bytes], ...]
    mean: tuple
    scale: tuple
    weights: tuple

    def pair(self) -> Panel:
        return Panel(self.dictionaries)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        x = (rows - np.array(self.mean)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + x @ np.array(self.weights[1:]), -50, 50)))


def toxic_passages(parts: list[list[bytes]], ordinary: list[bytes], calibration: list[bytes]) -> list[Counter]:
    """For every part of the toxic texts, its windows that the other parts' dictionaries compress well, with how often they occur."""
    volume = min(PART_BYTES, int(np.median([len(joined(p, PART_BYTES)) for p in parts])))
    own = [Dictionary(joined(p, volume)) for p in parts]
    many = max(1, min(PLAIN * len(parts), len(joined(ordinary, PLAIN * PARTS * PART_BYTES)) // max(1, volume)))
    plain = [Dictionary(joined(ordinary[i::many], volume)) for i in range(many)]
    usual, usually = tally(calibration)

    def ordinary_length(rows: np.ndarray) -> np.ndarray:
        return sum((j.lengths(rows) for j in plain), np.zeros(len(rows), dtype=np.float32)) / len(plain)

    def saved(ordinary: np.ndarray, judges: list[np.ndarray]) -> np.ndarray:
        """Mean saving of the judges against the mean ordinary length; copies let a few save very much, so each counts up to MOST_SAVED."""
        return sum((np.minimum(ordinary - j, MOST_SAVED) for j in judges), np.zeros(len(ordinary), dtype=np.float32)) / len(judges)

    usual_plain, usual_own, found = ordinary_length(usual), [j.lengths(usual) for j in own], []
    for i, part in enumerate(parts):
        rows, often = tally(part)
        least = max(1.0, least_of_share(saved(usual_plain, usual_own[:i] + usual_own[i + 1 :]), usually, STRICT)) if len(usual) else 1.0
        good = saved(ordinary_length(rows), [j.lengths(rows) for j in own[:i] + own[i + 1 :]]) >= least
        found.append(Counter({rows[k].tobytes(): int(often[k]) for k in np.flatnonzero(good)}))
    return found


def contents(passages: list[Counter], ordinary: list[bytes]) -> list[tuple[bytes, bytes]]:
    """Pairs of a toxic and an ordinary dictionary: both hold the same ordinary text, then toxic passages (the most frequent last) or as many bytes of further ordinary text."""
    total = sum(passages, Counter())
    toxic = b"".join(reversed(sorted(total, key=lambda w: (-total[w], w))[: PASSAGE_BYTES // (len(MARK) + WINDOW)]))
    out = []
    for i in range(PAIRS):
        text = joined(ordinary[i::PAIRS], SHARED_BYTES + len(toxic))
        shared = text[: max(len(text) - len(toxic), len(text) // 2)]
        out.append((shared + toxic, text))
    return out


def fit(samples: Sequence[tuple[str | None, int]], prior: float | None = None) -> ToxicModel:
    """A model from (text, 0/1) rows; ``prior`` is the share of class 1 that the scores are calibrated to.

    Rows of one class alone, or fewer than two different toxic texts, give a
    model that scores every text with the prior.
    """
    rng = np.random.default_rng(5)
    by_class = [sorted({t for t, y in samples if y == k and t}) for k in (0, 1)]
    plain, toxic = ([marked(c[i]) for i in rng.permutation(len(c))] for c in by_class)
    texts = {marked(t): t for c in by_class for t in c}
    half = len(plain) // 2
    prior = (sum(y for _, y in samples) / max(1, len(samples))) if prior is None else prior
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    zeros = (0.0,) * features(np.zeros((1, 2 + len(LEVELS)))).shape[1]
    if len(toxic) < 2 or half < 1:
        return ToxicModel((), zeros, tuple(1.0 for _ in zeros), (float(np.log(prior / (1 - prior))), *zeros))
    source, calibration = plain[:half], plain[half:]
    k = min(PARTS, len(toxic))
    parts = [toxic[i::k] for i in range(k)]
    passages = toxic_passages(parts, source, calibration)
    rows, y = [], []
    for i in range(k):  # a text's features come from a dictionary without its own passages
        pair = Panel(contents(passages[:i] + passages[i + 1 :], source), memo=0)
        for part, label in ((parts[i], 1), (calibration[i::k], 0)):
            rows.append(features(pair.counts([texts[t] for t in part])))
            y += [label] * len(part)
    x, y = np.concatenate(rows), np.array(y)
    weight = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    w, free = np.zeros(z.shape[1]), np.ones(z.shape[1], dtype=bool)
    signed = (np.arange(len(w)) > 0) & (np.arange(len(w)) < len(w) - 1)
    while True:  # no gain may speak against toxicity: features that would are left out, until none is left that does
        w[:] = 0
        w[free] = _logistic(z[:, free], y, weight)
        against = free & (w < 0) & signed
        if not against.any():
            break
        free &= ~against
    return ToxicModel(tuple(contents(passages, source)), tuple(mean), tuple(scale), tuple(w))


def _logistic(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression, by Newton steps."""
    w, ridge = np.zeros(z.shape[1]), RIDGE * np.eye(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        gradient = z.T @ (weight * (p - y)) / len(y) + ridge @ w
        curvature = (z * (weight * p * (1 - p))[:, None]).T @ z / len(y) + ridge
        w -= np.linalg.solve(curvature, gradient)
    return w


_LOADED: dict[ToxicModel, Panel] = {}


def toxicity(model: ToxicModel):
    """A pandas UDF from text to a score in 0..1; null and wordless texts get the score of no evidence."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only("toxicity", _LOADED.clear)
        if model not in _LOADED:
            _LOADED.clear()
            _LOADED[model] = model.pair()
        pair = _LOADED[model]
        for texts in batches:
            found = pair.counts([t if isinstance(t, str) else None for t in texts])
            yield pd.Series(model.scores(features(found)), dtype="float64")
        release()

    return score


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> ToxicModel:
    """Fit on at most ``sample`` labelled documents of either class, chosen by a hash of the id.

    A doc_id counts once: of several labels the highest, of several texts the
    first in order. Rows of the held-out quarter, null labels, ids and texts are
    left out of the fit. Of a text over ``longest`` characters the fit reads that
    many from a place chosen by its id (scoring reads all of every text). The
    share of toxic labels is counted over all labelled ids outside the held-out
    part. Empty tables give a model that scores with that share alone.
    """
    usable = labels.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    count = usable.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("k")).first()
    picks = [usable.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    picked = picks[0].unionByName(picks[1])  # at most 2 * sample rows of two numbers: broadcast whatever the table's size
    spare = F.length("text") - longest
    start = F.when(spare > 0, F.pmod(F.xxhash64("doc_id"), spare.cast("long"))).otherwise(0)
    rows = docs.filter("text IS NOT NULL").select("doc_id", F.substring("text", (start + 1).cast("int"), F.lit(longest)).alias("text"))
    rows = rows.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    rows = sorted((r.doc_id, r.text, r.y) for r in rows.collect())  # at most 2 * sample rows of ``longest`` characters
    model = fit([(t, y) for _, t, y in rows], (count.k / count.n) if count.n else None)
    del rows
    release()  # the driver goes on with other work
    return model


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted (1 at ``threshold`` or more); the same number of rows, each judged alone.

    Columns of these names are replaced. Null, empty and wordless texts get the
    score of no evidence; texts are read whole, however long; repeated rows get
    equal scores; an empty table gives no rows.
    """
    kept = [f"`{c}`" for c in docs.columns if c not in ("score", "predicted")]
    out = docs.select(*kept, toxicity(model)("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
