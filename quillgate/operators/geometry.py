"""Word layouts and boxes: locating text among words, and merging overlapping boxes."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONGEST = 80
WINDOW = 50
BOX = "pos_x double, pos_y double, pos_w double, pos_h double"
FOUND = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("text", pa.string()), ("n", pa.int32()), *((c, pa.float64()) for c in ("pos_x", "pos_y", "pos_w", "pos_h"))])

SPANS = pa.schema([("doc_id", pa.int64()), ("page", pa.int32()), ("text", pa.string()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("alone", pa.list_(pa.int32()))])


def percent(value: float, whole: float | None) -> float:
    """Two decimals, halves up; percent of ``whole`` where that is given."""
    return math.floor((value / whole * 100 if whole else value) * 100 + 0.5) / 100


def line_boxes(words: list[dict], width: float | None = None, height: float | None = None) -> list[tuple]:
    """One box per text line of ``words`` (text, polygon): lines collect words of nearly the same middle height."""
    tolerance = height * 0.015 if width and height else 15
    lines: list[tuple[float, list]] = []
    for word in words:
        polygon = word.get("polygon")
        if polygon is None or len(polygon) < 8:
            continue
        ys = list(polygon[1::2])
        middle = (min(ys) + max(ys)) / 2
        home = next((members for y, members in lines if abs(middle - y) < tolerance), None)
        if home is None:
            lines.append((middle, [polygon]))
        else:
            home.append(polygon)
    out = []
    for _, members in lines:
        xs, ys = [x for p in members for x in p[::2]], [y for p in members for y in p[1::2]]
        out.append((percent(min(xs), width), percent(min(ys), height), percent(max(xs) - min(xs), width), percent(max(ys) - min(ys), height)))
    return out


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text.lower())


def _plain(joined: str, n: int) -> bool:
    """Whether ``joined`` is ``n`` words with one space between each two, and white space nowhere else."""
    parts = joined.split()
    return len(parts) == n and " ".join(parts) == joined


def _windows(target: str, joined: str) -> list[tuple[int, int]]:
    """First and last word of the smallest windows that hold ``target``, one after the other, in a plain text (lower case)."""
    found: list[tuple[int, int]] = []
    size, at, seen, word = len(target), 0, 0, 0
    while (at := joined.find(target, at)) >= 0:
        word, seen = word + joined.count(" ", seen, at), at  # the word in which the target starts
        last = word + joined.count(" ", at, at + size)
        end = joined.find(" ", at + size)
        end, after = len(joined) if end < 0 else end, joined.find(" ", at) + 1  # ends of the window and of its first word
        if last - word < WINDOW and (not after or after > end or joined.find(target, after, end) < 0):
            found.append((word, last))
            after = end + 1
        if not after or after > len(joined):
            break
        at = after
    return found


def _scanned(target: str, words: list[dict]) -> list[tuple[int, int]]:
    """``_windows`` of any words, with empty ones and white space inside."""
    found: list[tuple[int, int]] = []
    start = 0
    while start < len(words):
        joined = ""
        step = 1
        for end in range(start, min(len(words), start + WINDOW)):
            joined = f"{joined} {words[end]['text']}" if end > start else words[end]["text"]
            if target in _flat(joined):
                if target not in _flat(joined[len(words[start]["text"]) :]):
                    found.append((start, end))
                    step = end - start + 1
                break
        start += step
    return found


def _wanted(text: str | None, long_ok: bool) -> str:
    target = _flat(text or "").strip()
    return "" if len(target) > LONGEST and not long_ok else target


def _once(boxes: list[tuple]) -> list[tuple]:
    """Near-equal boxes once, empty ones not at all."""
    unique: list[tuple] = []
    for box in boxes:
        if (box[2] or box[3]) and not any(all(abs(a - b) < 0.1 for a, b in zip(box, other)) for other in unique):
            unique.append(box)
    return unique


def locate(text: str, words: list[dict], width: float | None = None, height: float | None = None, long_ok: bool = False) -> list[tuple]:
    """Boxes of every occurrence of ``text`` among ``words``: smallest windows, one after the other, near-equal boxes once."""
    target = _wanted(text, long_ok)
    if not words or not target:
        return []
    found = [box for a, b in _scanned(target, words) for box in line_boxes(words[a : b + 1], width, height)]
    if not found and " " not in target:
        for word in words:
            if word["text"].lower() == target:
                found += line_boxes([word], width, height)
    return _once(found)


def locate_within(layouts: DataFrame) -> DataFrame:
    """(doc_id, page, text, box number, box) for each of the texts of layouts (doc_id, page, width, height, words, texts).

    Words stay in Arrow: only the joined text of a page and the polygons of the
    words found become Python values, except where words hold white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            first, items = words.offsets.to_numpy(), words.values
            polygons = items.field("polygon")
            joined = pc.binary_join(pa.ListArray.from_arrays(words.offsets, items.field("text")), " ").to_pylist()
            bounds, numbers, present = polygons.offsets.to_numpy(), polygons.values.to_numpy(zero_copy_only=False), polygons.is_valid().to_numpy(zero_copy_only=False)
            shape = lambda i: {"polygon": numbers[bounds[i] : bounds[i + 1]].tolist() if present[i] else None}  # noqa: B023, E731
            rows: list[tuple] = []
            for k, (doc, page, width, height, texts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "width", "height", "texts")), strict=True)):
                n = first[k + 1] - first[k]
                low = joined[k].lower() if joined[k] is not None and words[k].is_valid else None
                plain = low is not None and _plain(low, n)
                for text in texts:
                    target = _wanted(text, False)
                    if not target or not n:
                        continue
                    boxes = _once([box for a, b in _windows(target, low) for box in line_boxes([shape(first[k] + i) for i in range(a, b + 1)], width, height)]) if plain else []
                    if not boxes and (not plain or " " not in target and target in low):
                        boxes = locate(text, words[k].as_py(), width, height)
                    rows += [(doc, page, text, i + 1, *box) for i, box in enumerate(boxes)]
            columns = list(zip(*rows, strict=True)) or [()] * len(FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, FOUND.types, strict=True)], schema=FOUND)

    return layouts.select("doc_id", "page", "width", "height", "words", "texts").mapInArrow(run, f"doc_id bigint, page int, text string, n int, {BOX}")


def windows_within(pages: DataFrame) -> DataFrame:
    """(doc_id, page, text, spans, alone) for each of the texts of pages (doc_id, page, words, texts) that is found, words being strings.

    Spans are the first and last words of ``locate``'s windows, from 0; alone are
    the words that equal a text of one word. A page's boxes are not needed yet:
    bring or make those of the words found, for ``boxes_within``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("words")
            joined = pc.binary_join(pa.ListArray.from_arrays(words.offsets, words.values), " ").to_pylist()
            rows: list[tuple] = []
            for k, (doc, page, n, texts) in enumerate(zip(*(c.to_pylist() for c in (batch.column("doc_id"), batch.column("page"), pc.list_value_length(words), batch.column("texts"))), strict=True)):
                if not n:
                    continue
                low = joined[k].lower() if joined[k] is not None else None
                plain = low is not None and _plain(low, n)
                for text in texts:
                    target = _wanted(text, False)
                    if not target:
                        continue
                    own = None if plain else [{"text": w} for w in words[k].as_py()]
                    spans = _windows(target, low) if plain else _scanned(target, own)
                    alone = [] if " " in target else [i for i, w in enumerate(low.split(" ") if plain else [w["text"].lower() for w in own]) if w == target]
                    if spans or alone:
                        rows.append((doc, page, text, [{"first": a, "last": b} for a, b in spans], alone))
            columns = list(zip(*rows, strict=True)) or [()] * len(SPANS)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, SPANS.types, strict=True)], schema=SPANS)

    return pages.select("doc_id", "page", "words", "texts").mapInArrow(run, "doc_id bigint, page int, text string, spans array<struct<first:int,last:int>>, alone array<int>")


def boxes_within(found: DataFrame) -> DataFrame:
    """(doc_id, page, text, box number, box) for found (doc_id, page, text, width, height, spans, alone).

    Spans are lists of the polygons of their words, alone the polygons of single words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, page, text, width, height, spans, alone in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "page", "text", "width", "height", "spans", "alone")), strict=True):
                boxes = [box for span in spans for box in line_boxes([{"polygon": p} for p in span], width, height)]
                boxes = boxes or [box for p in alone for box in line_boxes([{"polygon": p}], width, height)]
                rows += [(doc, page, text, i + 1, *box) for i, box in enumerate(_once(boxes))]
            columns = list(zip(*rows, strict=True)) or [()] * len(FOUND)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, FOUND.types, strict=True)], schema=FOUND)

    return found.select("doc_id", "page", "text", "width", "height", "spans", "alone").mapInArrow(run, f"doc_id bigint, page int, text string, n int, {BOX}")


def texts_of(targets: DataFrame, pages: DataFrame) -> DataFrame:
    """``pages`` that have targets (doc_id, page, text), with all of them as ``texts``."""
    wanted = targets.groupBy(F.col("doc_id").alias("of"), F.col("page").alias("at")).agg(F.collect_list("text").alias("texts"))
    return pages.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("page").eqNullSafe(F.col("at"))).drop("of", "at")


def locate_all(targets: DataFrame, layouts: DataFrame) -> DataFrame:
    """``locate_within`` for targets (doc_id, page, text) on layouts (doc_id, page, width, height, words).

    Layouts are moved to their targets whole; where they are made from something
    smaller, find the words first (``windows_within``) and make the boxes of those.
    """
    return locate_within(texts_of(targets, layouts))


def alike(a: tuple, b: tuple) -> bool:
    """Overlap of more than nine tenths, or one strictly inside the other."""
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    shared = max(0.0, w) * max(0.0, h)
    union = a[2] * a[3] + b[2] * b[3] - shared
    if union > 0 and shared / union > 0.9:
        return True

    def inside(x: tuple, y: tuple) -> bool:
        return y[0] >= x[0] and y[1] >= x[1] and y[0] + y[2] <= x[0] + x[2] and y[1] + y[3] <= x[1] + x[3] and x[2] * x[3] > y[2] * y[3]

    return inside(a, b) or inside(b, a)


def merge_boxes(boxes: list[tuple]) -> list[tuple]:
    """Connected components of alike boxes, each as its hull, in the order of first members; hulls are not merged again."""
    parent = list(range(len(boxes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    order = sorted(range(len(boxes)), key=lambda i: boxes[i][1])
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if boxes[j][1] > boxes[i][1] + boxes[i][3]:
                break  # every later box starts below this one
            if alike(boxes[i], boxes[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups: dict[int, list[tuple]] = {}
    for i, box in enumerate(boxes):
        groups.setdefault(root(i), []).append(box)
    out = []
    for members in groups.values():
        x, y = min(b[0] for b in members), min(b[1] for b in members)
        right, low = max(b[0] + b[2] for b in members), max(b[1] + b[3] for b in members)
        out.append(members[0] if len(members) == 1 else tuple(math.floor(v * 100 + 0.5) / 100 for v in (x, y, right - x, low - y)))
    return out


def merge_page_boxes(boxes: DataFrame) -> DataFrame:
    """``merge_boxes`` for every (document_id, page) of boxes (seq, box).

    Rows are dealt and sorted by page, and whole pages are taken from each batch;
    the last page of a batch waits for the next.
    """
    names = ["pos_x", "pos_y", "pos_w", "pos_h"]

    def pages(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for key, part in pdf.groupby(["document_id", "page"], sort=False):
            merged = merge_boxes(list(zip(*(part[c] for c in names), strict=True)))
            rows += [(*key, i + 1, *b) for i, b in enumerate(merged)]
        return pd.DataFrame(rows, columns=["document_id", "page", "n", *names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["document_id"] == pdf["document_id"].iloc[-1]) & (pdf["page"] == pdf["page"].iloc[-1])
            held = pdf[last]
            yield pages(pdf[~last])
        if held is not None:
            yield pages(held)

    dealt = boxes.repartition("document_id", "page").sortWithinPartitions("document_id", "page", "seq")
    return dealt.select("document_id", "page", "seq", *names).mapInPandas(run, f"document_id bigint, page int, n int, {BOX}")
