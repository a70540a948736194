"""Structured text: marked segments of paragraphs, typed blocks, HTML blocks."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Spaces that count as a plain space when a detection is looked up (fixed values).
WIDE_SPACES = str.maketrans({" ": " ", " ": " ", " ": " ", "⁠": " "})


def segments(text: str, detections: list[tuple[int, str]]) -> list[tuple[str, int | None]]:
    """``text`` cut into (piece, detection id or None); each detection marks its first occurrence, the leftmost wins."""
    plain = text.translate(WIDE_SPACES).lower()
    marks = []
    for ident, wanted in detections:
        if not wanted:
            continue
        at = next((i for i in (text.find(wanted), text.lower().find(wanted.lower()), plain.find(wanted.translate(WIDE_SPACES).lower())) if i >= 0), -1)
        if at >= 0:
            marks.append((at, at + len(wanted), ident))
    out: list[tuple[str, int | None]] = []
    cursor = 0
    for start, end, ident in sorted(marks, key=lambda m: m[0]):
        if start < cursor:
            continue
        if start > cursor:
            out.append((text[cursor:start], None))
        out.append((text[start:end], ident))
        cursor = end
    if cursor < len(text) or not out:
        out.append((text[cursor:], None))
    return out


def block_rows(kind: str, content: str) -> list[tuple[int, int, str, bool]]:
    """(row, cell, text, header) of a block: list items a row each, table cells by tab, padded to the widest row, row 0 the header."""
    lines = [x for x in content.split("\n") if x.strip()]
    if kind == "list":
        return [(i, 0, x.strip(), False) for i, x in enumerate(lines)]
    if kind == "table":
        rows = [x.split("\t") for x in lines]
        width = max(map(len, rows), default=0)
        return [(i, j, (row + [""] * width)[j].strip(), i == 0) for i, row in enumerate(rows) for j in range(width)]
    return [(0, 0, content, False)]


class _Blocks(HTMLParser):
    HEADINGS = {f"h{i}": i for i in range(1, 7)}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, int]] = []
        self.kind, self.level, self.parts, self.depth, self.skip = "paragraph", 0, [], 0, 0

    def close_block(self) -> None:
        text = "".join(self.parts)
        text = "\n".join(re.sub(r"[ \r\f\v]+", " ", x).strip(" ") for x in text.split("\n"))
        text = re.sub(r"\n{2,}", "\n", text).strip()
        if text:
            self.blocks.append((self.kind, text, self.level))
        self.kind, self.level, self.parts = "paragraph", 0, []

    def handle_starttag(self, tag, attrs) -> None:
        if tag in ("script", "style", "title", "head"):
            self.skip += tag != "head"
        elif tag in self.HEADINGS or tag in ("p", "ul", "ol", "table"):
            if not self.depth:
                self.close_block()
            self.depth += tag in ("ul", "ol", "table")
            if self.depth <= 1:
                self.kind = "heading" if tag in self.HEADINGS else {"ul": "list", "ol": "list", "table": "table"}.get(tag, self.kind if self.depth else "paragraph")
                self.level = self.HEADINGS.get(tag, 0)
        elif tag in ("li", "tr", "br"):
            self.parts.append("\n")
        elif tag in ("td", "th"):
            self.parts.append("\t" if self.parts and not self.parts[-1].endswith("\n") else "")
        elif tag == "img":
            self.close_block()
            self.blocks.append(("image", dict(attrs).get("alt") or "", 0))

    def handle_endtag(self, tag) -> None:
        if tag in ("script", "style", "title"):
            self.skip = max(0, self.skip - 1)
        elif tag in ("ul", "ol", "table"):
            self.depth = max(0, self.depth - 1)
            if not self.depth:
                self.close_block()
        elif (tag in self.HEADINGS or tag == "p") and not self.depth:
            self.close_block()

    def handle_data(self, data) -> None:
        if not self.skip:
            self.parts.append(data if self.depth == 0 else data.replace("\n", " "))


def html_blocks(html: str | None) -> list[tuple[str, str, int]]:
    """(kind, text, level) of an HTML page: headings, paragraphs, lists, tables, images, and text between them."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.blocks
