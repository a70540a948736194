"""Readers and writers of document files: OOXML text and sheets, mail, archives, plain text.

Files come as rows (path, content) of Spark's binaryFile source; each reader is
a function of the bytes, applied to batches.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import struct
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

Page = tuple[int, str]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def docx_pages(data: bytes) -> list[Page]:
    """The raw text of a Word file as one page, paragraphs apart by an empty line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = []
    for p in body.iter(f"{_W}p"):
        parts = [(x.text or "") if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag == f"{_W}br" else "" for x in p.iter()]
        paragraphs.append("".join(parts))
    return [(1, "\n\n".join(paragraphs).strip())]


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(name, rows) of every sheet; blank rows are left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")]
        titles = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{_S}sheet")]
        out = []
        for i, title in enumerate(titles, 1):
            rows = []
            for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{_S}row"):
                cells: list[str] = []
                for c in row.iter(f"{_S}c"):
                    value = "".join(t.text or "" for t in c.iter() if t.tag in (f"{_S}v", f"{_S}t"))
                    at = _column(c.get("r")) if c.get("r") else len(cells)
                    cells += [""] * (at + 1 - len(cells))
                    cells[at] = shared[int(value)] if c.get("t") == "s" else value
                if any(x.strip() for x in cells):
                    rows.append(cells)
            out.append((title, rows))
    return out


def xlsx_pages(data: bytes) -> list[Page]:
    """A page per sheet: its name, then its rows as CSV."""
    pages = []
    for n, (title, rows) in enumerate(xlsx_sheets(data), 1):
        body = io.StringIO()
        csv.writer(body, lineterminator="\n").writerows(rows)
        pages.append((n, f"[Sheet: {title}]\n{body.getvalue().rstrip(chr(10))}"))
    return pages


def strip_html(html: str) -> str:
    for pattern, by in ((r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)</(?:div|li)>", "\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), (r"\n{3,}", "\n\n")):
        html = re.sub(pattern, by, html)
    return html.strip()


def mail_pages(headers: dict[str, str], text: str, html: str) -> list[Page]:
    """A page of headers and a page of body; HTML only where there is no text, a stub where there is neither."""
    lines = [f"{k}: {headers[k]}" for k in ("From", "To", "CC", "Date", "Subject", "Message-ID") if headers.get(k)]
    body = text or (strip_html(html) if html else "")
    return [(1, "[Email Headers]\n" + "\n".join(lines)), (2, body or "(No message body)")]


def eml_parts(data: bytes) -> tuple[list[Page], list[tuple[str, bytes]]]:
    """Pages and attachments (name, content) of an RFC 822 message."""
    message = email.message_from_bytes(data, policy=email.policy.default)
    text = message.get_body(("plain",))
    html = message.get_body(("html",))
    headers = {k: str(message[h]) for k, h in (("From", "from"), ("To", "to"), ("CC", "cc"), ("Date", "date"), ("Subject", "subject"), ("Message-ID", "message-id")) if message[h]}
    attached = [(a.get_filename() or "attachment", a.get_payload(decode=True) or b"") for a in message.iter_attachments()]
    return mail_pages(headers, text.get_content().rstrip("\n") if text else "", html.get_content() if html else ""), attached


def eml_pages(data: bytes) -> list[Page]:
    return eml_parts(data)[0]


def ole_streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by path (the public CFBF layout: FAT, mini FAT, directory)."""
    if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1"):
        raise ValueError("not a compound file")
    size, mini = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    first_dir, cutoff, first_mini = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0]
    listed = list(struct.unpack_from("<109I", data, 76))
    more, seen = struct.unpack_from("<I", data, 68)[0], set()
    while more < 0xFFFFFFFA:  # sectors of the DIFAT: FAT sectors, then the next of its kind
        if more in seen:
            raise ValueError("a loop of DIFAT sectors")
        seen.add(more)
        *rest, more = struct.unpack(f"<{size // 4}I", sector(more))
        listed += rest
    difat = [x for x in listed if x < 0xFFFFFFFA]
    fat = [x for s in difat for x in struct.unpack(f"<{size // 4}I", sector(s))]

    def chain(start: int, table: list[int]) -> Iterator[int]:
        while start < 0xFFFFFFFA:
            yield start
            start = table[start]

    read = lambda start: b"".join(map(sector, chain(start, fat)))
    minifat = [x for s in chain(first_mini, fat) for x in struct.unpack(f"<{size // 4}I", sector(s))]
    directory = read(first_dir)
    entries = []
    for at in range(0, len(directory), 128):
        raw = directory[at : at + 128]
        n = struct.unpack_from("<H", raw, 64)[0]
        entries.append((raw[: max(n - 2, 0)].decode("utf-16-le"), raw[66], *struct.unpack_from("<III", raw, 68), struct.unpack_from("<I", raw, 116)[0], struct.unpack_from("<Q", raw, 120)[0]))
    pool = read(entries[0][5]) if entries and entries[0][5] < 0xFFFFFFFA else b""
    out: dict[str, bytes] = {}

    def walk(i: int, path: str) -> None:
        if i >= len(entries):
            return
        name, kind, left, right, child, start, length = entries[i]
        walk(left, path)
        walk(right, path)
        if kind == 1:
            walk(child, f"{path}{name}/")
        elif kind == 2:
            body = b"".join(pool[m * mini : (m + 1) * mini] for m in chain(start, minifat)) if length < cutoff else read(start)
            out[path + name] = body[:length]

    if entries:
        walk(entries[0][4], "")
    return out


def msg_pages(data: bytes) -> list[Page]:
    """Pages of an Outlook message: its named properties by number."""
    streams = ole_streams(data)

    def prop(number: str) -> str:
        if f"__substg1.0_{number}001F" in streams:
            return streams[f"__substg1.0_{number}001F"].decode("utf-16-le").rstrip("\0")
        return streams.get(f"__substg1.0_{number}001E", b"").decode("latin-1").rstrip("\0")

    address = prop("5D01") or prop("0C1F")
    sender = f"{prop('0C1A')} <{address}>" if prop("0C1A") and address else address or prop("0C1A") or "(unknown sender)"
    return mail_pages({"From": sender, "To": prop("0E04"), "CC": prop("0E03"), "Subject": prop("0037"), "Message-ID": prop("1035")}, prop("1000"), "")


def txt_pages(data: bytes) -> list[Page]:
    return [(1, data.decode("utf-8", "replace"))]


READERS: dict[str, Callable[[bytes], list[Page]]] = {"DOCX": docx_pages, "XLSX": xlsx_pages, "EML": eml_pages, "MSG": msg_pages, "TXT": txt_pages}


def read_binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content) of the files below ``path``."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def extract_pages(files: DataFrame) -> DataFrame:
    """(file_id, page, text, error) of files (file_id, file_type, content); unknown types and unreadable files give one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ident, kind, data in zip(pdf["file_id"], pdf["file_type"], pdf["content"], strict=True):
                if kind not in READERS:
                    rows.append((ident, None, None, f"Unsupported file type: {kind}"))
                    continue
                try:
                    rows += [(ident, n, text, None) for n, text in READERS[kind](bytes(data))]
                except (KeyError, ValueError, zipfile.BadZipFile, ElementTree.ParseError, struct.error, IndexError) as error:
                    rows.append((ident, None, None, f"unreadable: {type(error).__name__}"))
            yield pd.DataFrame(rows, columns=["file_id", "page", "text", "error"]).astype({"page": "Int64"})

    return files.select("file_id", "file_type", "content").mapInPandas(run, "file_id bigint, page bigint, text string, error string")


def make_zip(parts: dict[str, bytes | str]) -> bytes:
    """A ZIP whose bytes depend on its parts alone."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def _xml(text: str) -> str:
    text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def make_docx(paragraphs: list[str], author: str = "") -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_xml(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return make_zip({"word/document.xml": f'<w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>', "docProps/core.xml": f"<core><creator>{_xml(author)}</creator></core>"})


def make_xlsx(sheets: dict[str, list[list[str]]]) -> bytes:
    parts: dict[str, bytes | str] = {"xl/workbook.xml": f'<workbook xmlns="{_S[1:-1]}"><sheets>' + "".join(f'<sheet name="{_xml(n)}"/>' for n in sheets) + "</sheets></workbook>"}
    for i, rows in enumerate(sheets.values(), 1):
        cells = "".join("<row>" + "".join(f'<c t="inlineStr"><is><t>{_xml(c)}</t></is></c>' for c in r) + "</row>" for r in rows)
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{_S[1:-1]}"><sheetData>{cells}</sheetData></worksheet>'
    return make_zip(parts)


def without_properties(data: bytes) -> bytes:
    """An Office file without its docProps parts; files that are no archives stay as they are."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return make_zip({n: z.read(n) for n in z.namelist() if not n.startswith("docProps/")})
    except zipfile.BadZipFile:
        return data
