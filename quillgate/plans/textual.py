"""Detection, structuring and scoring queries over page texts."""

from __future__ import annotations

from collections.abc import Callable

from quillgate.functions.spans import pinned, span_columns, spans
from quillgate.operators import detection as det
from quillgate.plans.dialect import Dialect
from quillgate.plans.relational import half_up, lookup, n
from quillgate.sources.model import RULES, values

Build = Callable[[Dialect], str]
QUERIES: dict[str, Build] = {}
SEEDS = [(1, -13, 1, "Ms Melissa Ferguson"), (2, -13, 2, "Mr Young"), (3, -10, 1, "Sarah Liang"), (4, -13, 1, "lower case"), (5, -13, 3, "Dr. Ferguson")]


def query(build: Build) -> Build:
    QUERIES[build.__name__] = build
    return build


@query
def detect_patterns(d):
    return det.detect_patterns(d, "page_text")


@query
def win_pattern_claim(d):
    return f"SELECT type, count(*) AS spans, {n('sum(length(text))')} AS characters FROM ({det.detect_patterns(d, 'page_text')}) AS x GROUP BY type"


@query
def regex_offsets(d):
    base = f"(SELECT doc_id, page, {spans(d, 'p', 'number')} AS found FROM {pinned(d, 'page_text', 'doc_id, page', span_columns(d, 'text', '[0-9]+', 'p'))} AS a)"
    return f"SELECT doc_id, page, item.s AS start, item.t AS text FROM {d.exploded(base, 'found', 'n', 'item')} AS z"


@query
def context_guard(d):
    return f"SELECT doc_id, page, {det.context_guard(d, 'text', '30', ('licence', 'the', 'de'), 25)} AS near FROM page_text"


@query
def detect_labels(d):
    return det.detect_labels(d, "page_text")


@query
def label_guard_gp(d):
    return f"SELECT doc_id, {d.rx('text', det.GP_VALUE)} AND length(text) >= 3 AS name_like FROM page_text"


@query
def label_guard_icd(d):
    return f"SELECT doc_id, {d.rx('text', det.ICD_VALUE)} AS code_like FROM (SELECT doc_id, text FROM page_text UNION ALL {values([(1, 'F43.23 noted'), (2, 'see F4'), (3, 'G31'), (4, 'Z0999')], 'doc_id, text', d)}) AS x"


@query
def detect_rules_exact(d):
    return det.rule_matches(d, "page_text", RULES, ("Exact",))


@query
def detect_rules_fuzzy(d):
    return det.rule_matches(d, "page_text", RULES, ("Fuzzy",))


@query
def detect_rules_regex(d):
    return det.rule_matches(d, "page_text", RULES, ("Regex",))


@query
def rule_test(d):
    return f"SELECT rule_id, doc_id, start, text, row_number() OVER (PARTITION BY doc_id ORDER BY start, rule_id) AS place FROM ({det.rule_matches(d, 'page_text', RULES, ('Exact', 'Fuzzy', 'Regex'))}) AS x"


@query
def rules_match_count(d):
    return f"SELECT r.rule_id, coalesce(r.match_count, 0) + coalesce(x.k, 0) AS match_count FROM rule AS r LEFT JOIN (SELECT rule_id, count(*) AS k FROM ({det.rule_matches(d, 'page_text', RULES, ('Exact', 'Fuzzy', 'Regex'))}) AS m GROUP BY rule_id) AS x ON x.rule_id = r.rule_id"


@query
def rules_validate(d):
    return "SELECT rule_id, coalesce(priority, 'Medium') AS priority, coalesce(match_count, 0) AS match_count, length(name) BETWEEN 1 AND 200 AND match_mode IN ('Exact', 'Fuzzy', 'Regex') AND coalesce(priority, 'Medium') IN ('Critical', 'High', 'Medium', 'Low') AS valid FROM rule"


@query
def rule_suggest(d):
    words = values([("Karaka Street",), ("Jane Doe",), ("Licence",), ("Copyright",)], "text", d)
    return f"SELECT w.text FROM ({words}) AS w WHERE NOT EXISTS (SELECT 1 FROM rule AS r WHERE r.status = 'Active' AND contains(lower(r.keywords), lower(w.text)))"


@query
def propagate_names(d):
    return det.propagate_names(d, "case_text", values(SEEDS, "seed_id, doc_id, page, seed_text", d))


@query
def name_parse(d):
    seeds = values([*SEEDS, (6, 1, 1, "Professor Ada B. Lovelace"), (7, 1, 1, "Smith")], "seed_id, doc_id, page, seed_text", d)
    return f"SELECT seed_id, {det.name_parts(d, 'seed_text')} FROM ({seeds}) AS s"


@query
def name_variants(d):
    seeds = values(SEEDS, "seed_id, doc_id, page, seed_text", d)
    base = f"(SELECT seed_id, {det.name_variants(d)} AS variants FROM (SELECT seed_id, seed_text, {det.name_parts(d, 'seed_text')} FROM ({seeds}) AS s) AS p WHERE named)"
    return f"SELECT seed_id, item AS variant, {n('min(n)')} AS place FROM {d.exploded(base, 'variants', 'n', 'item')} AS z GROUP BY seed_id, item"


@query
def seed_overlap(d):
    seeds = values([(1, -13, 1, "Ms Melissa Ferguson")], "seed_id, doc_id, page, seed_text", d)
    return f"SELECT page, text FROM ({det.propagate_names(d, 'case_text', seeds)}) AS x"


@query
def emit_once(d):
    return f"SELECT doc_id, lower(text) AS variant, page, count(*) AS times FROM ({det.propagate_names(d, 'case_text', values(SEEDS, 'seed_id, doc_id, page, seed_text', d))}) AS x GROUP BY doc_id, lower(text), page"


@query
def page_context(d):
    at = d.find("p.text", "x.text")
    head, tail = f"greatest({at} - 101, 0)", f"least({at} - 1 + length(x.text) + 100, length(p.text))"
    body = d.sub("p.text", f"{head} + 1", f"{tail} - {head}")
    return f"SELECT x.doc_id, x.page, x.start, CASE WHEN {at} = 0 THEN NULL ELSE concat(CASE WHEN {head} > 0 THEN '...' ELSE '' END, {body}, CASE WHEN {tail} < length(p.text) THEN '...' ELSE '' END) END AS context FROM ({det.detect_patterns(d, 'page_text')}) AS x JOIN page_text AS p ON p.doc_id = x.doc_id AND p.page = x.page"


def phrase_hits(d: Dialect) -> str:
    """(item_id, doc_id, phrase, text) of the documents that hold a whole benchmark text, in any case.

    Inside a phrase of seven words or more, words two to six stand between white
    space, so a document that holds the phrase holds these five words in a row:
    their hash is the join's key. Only shorter phrases are looked up one by one.
    """
    phrases = "SELECT item_id, text AS phrase FROM benchmark WHERE length(text) >= 3"
    if not d.spark:
        return f"SELECT b.item_id, c.doc_id, b.phrase, c.text FROM ({phrases}) AS b JOIN documents AS c ON contains(lower(c.text), lower(b.phrase))"
    words = lambda text: f"filter(split(lower({text}), '\\\\s+'), w -> w <> '')"
    keyed = f"SELECT item_id, phrase, w FROM (SELECT item_id, phrase, {words('phrase')} AS w FROM ({phrases}) AS p) AS q"
    five = lambda i: f"xxhash64(array_join(slice(w, {i}, 5), ' '))"
    grams = f"SELECT doc_id, explode(array_distinct(transform(sequence(1, size(w) - 4), i -> {five('i')}))) AS k FROM (SELECT doc_id, {words('text')} AS w FROM documents) AS t WHERE size(w) >= 5"
    near = f"SELECT DISTINCT b.item_id, b.phrase, g.doc_id FROM (SELECT item_id, phrase, {five('2')} AS k FROM ({keyed}) AS r WHERE size(w) >= 7) AS b JOIN ({grams}) AS g ON g.k = b.k"
    long = f"SELECT n.item_id, n.doc_id, n.phrase, c.text FROM ({near}) AS n JOIN documents AS c ON c.doc_id = n.doc_id WHERE contains(lower(c.text), lower(n.phrase))"
    short = f"SELECT b.item_id, c.doc_id, b.phrase, c.text FROM (SELECT item_id, phrase FROM ({keyed}) AS r WHERE size(w) < 7) AS b JOIN documents AS c ON contains(lower(c.text), lower(b.phrase))"
    return f"{long} UNION ALL {short}"


@query
def cross_doc_scan(d):
    at = d.find("lower(text)", "lower(phrase)")
    body = d.sub("text", f"greatest({at} - 40, 1)", f"least({at} + length(phrase) + 39, length(text)) - greatest({at} - 40, 1) + 1")
    return f"SELECT item_id, doc_id, {body} AS snippet FROM ({phrase_hits(d)}) AS h"


@query
def cross_doc_apply(d):
    return f"SELECT item_id, doc_id, 100 AS confidence, 'accepted' AS status FROM ({phrase_hits(d)}) AS h WHERE NOT EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = h.doc_id AND l.quality = 1)"


@query
def manual_create(d):
    return f"SELECT x.document_id, x.detection_id, {half_up('pos_x + 1e0', 2)} AS pos_x, 'accepted' AS status, 'manual' AS source, c.page_count + count(*) OVER (PARTITION BY x.document_id) AS counter FROM detection AS x JOIN document AS c ON c.document_id = x.document_id WHERE x.source = 'manual'"


@query
def ai_page_split(d):
    """Chunks of large pages at line ends, closed when the next line would pass the limit."""
    lines = d.rx_split("text", "\n")
    acc = "struct<kind:string, s:int, e:int, t:string>"
    last = d.at("acc", d.size("acc"))
    grown = d.record(kind="''", s="0", e=f"{last}.e + x.e + 1", t=f"concat({last}.t, {d.lit(chr(10))}, x.t)")
    rest = f"slice(acc, 1, size(acc) - 1)" if d.spark else "acc[1:len(acc) - 1]"
    step = f"CASE WHEN {d.size('acc')} > 0 AND {last}.e + x.e + 1 <= 4000 THEN {d.append(rest, d.single(grown))} ELSE {d.append('acc', d.single('x'))} END"
    items = d.each(lines, "y", d.record(kind="''", s="0", e="length(y)", t="y"))
    base = f"(SELECT doc_id, {d.fold(items, '[]', acc, 'acc', 'x', step)} AS chunks FROM documents WHERE length(text) > 5000)"
    return f"SELECT doc_id, n, item.t AS chunk FROM {d.exploded(base, 'chunks', 'n', 'item')} AS z"


@query
def ai_batching(d):
    size = "CASE WHEN pages <= 6 THEN pages ELSE 3 END"
    rows = f"SELECT doc_id, page, text, count(*) OVER (PARTITION BY doc_id) AS pages, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS r FROM thread_page"
    part = d.joined(f"concat('--- PAGE ', CAST(page AS STRING), ' ---', {d.lit(chr(10))}, text)", "\n\n", "page")
    return f"SELECT doc_id, batch, {d.sha256('content')} AS content_sha FROM (SELECT doc_id, CAST(floor((r - 1) / ({size})) AS BIGINT) AS batch, {part} AS content FROM ({rows}) AS a GROUP BY doc_id, CAST(floor((r - 1) / ({size})) AS BIGINT)) AS b WHERE length(content) >= 20"


@query
def ai_validate(d):
    raw = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '  ' ELSE concat(' ', event_type, ' ') END AS text, CASE WHEN event_id % 4 = 0 THEN NULL ELSE value * 3 - 40 END AS confidence, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'phone' END AS type FROM events"
    return f"SELECT event_id, trim(text) AS text, coalesce(type, 'sensitive-context') AS type, CAST(coalesce(greatest(0, least(100, floor(confidence + 0.5e0))), 50) AS BIGINT) AS confidence FROM ({raw}) AS x WHERE trim(text) <> ''"


# --- duplicates -------------------------------------------------------------------------


def normal(d: Dialect, text: str = "text") -> str:
    return f"lower({d.trim(d.rx_replace(text, r'[ \t\n\x0b\f\r]+', ' '))})"


@query
def content_hash(d):
    return f"SELECT doc_id, {d.sha256(normal(d))} AS content_hash FROM documents"


@query
def exact_dup(d):
    return f"SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, h) AS first_id, count(*) OVER (PARTITION BY source, h) AS k FROM (SELECT doc_id, source, {d.sha256(normal(d))} AS h FROM documents) AS a) AS b WHERE k > 1"


@query
def trigrams(d):
    c = d.chars("t")
    grams = d.each(d.indexes(f"{d.size('c')} - 2"), "i", f"concat({d.at('c', 'i')}, {d.at('c', 'i + 1')}, {d.at('c', 'i + 2')})")
    return f"SELECT doc_id, {n(d.size(d.distinct('g')))} AS trigrams FROM (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {c} AS c FROM (SELECT doc_id, {normal(d)} AS t FROM documents) AS a) AS b) AS e"


# --- structure -----------------------------------------------------------------------------


@query
def html_strip(d):
    steps = [(r"(?i)<br\s*/?>", "\n"), (r"(?i)</p>", "\n\n"), (r"(?i)</div>", "\n"), (r"(?i)</li>", "\n"), (r"<[^>]+>", ""), ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), (r"\n{3,}", "\n\n")]
    text = "html"
    for pattern, by in steps:
        text = d.rx_replace(text, pattern, by)
    return f"SELECT page_id, {d.trim(text)} AS text FROM pages"


def _blocks(d: Dialect, table: str, split: str) -> str:
    chunks = d.keep(d.each(split, "p", d.trim("p")), "p", "p <> ''")
    return d.exploded(f"(SELECT doc_id, page, {chunks} AS chunks FROM {table} WHERE text IS NOT NULL)", "chunks", "n", "chunk")


@query
def text_blocks(d):
    first = d.trim(d.at(d.rx_split("chunk", "\n"), "1"))
    heading = f"({d.rx(first, r'^\d+\.\s+[A-Z]')} AND length({first}) < 120 OR {d.rx(first, r'^[A-Z][A-Z\s\-:]{4,}$')} AND length({first}) < 80)"
    rows = f"SELECT doc_id, page, n, chunk, {first} AS first, {heading} AS heading FROM {_blocks(d, 'page_text', d.rx_split('text', '\n{2,}'))} AS z"
    rest = d.trim(d.sub("chunk", "length(first) + 1", "length(chunk)"))
    bracket = f"{d.starts('chunk', d.lit('['))} AND contains(chunk, ']')"
    return f"SELECT doc_id, page, n, CASE WHEN heading THEN 'heading' WHEN {bracket} THEN 'metadata' ELSE 'paragraph' END AS type, CASE WHEN heading THEN first ELSE chunk END AS content FROM ({rows}) AS a UNION ALL SELECT doc_id, page, n, 'paragraph', {rest} FROM ({rows}) AS b WHERE heading AND {rest} <> ''"


@query
def pages_to_review(d):
    return f"SELECT doc_id, page, count(*) AS blocks, {n('max(length(chunk))')} AS longest FROM {_blocks(d, 'thread_page', d.rx_split('text', '\n{2,}'))} AS z GROUP BY doc_id, page"


@query
def paragraphs(d):
    double, single = d.rx_split("text", "\n{2,}"), d.rx_split("text", "\n")
    pick = f"CASE WHEN {d.size(d.keep(d.each(double, 'p', d.trim('p')), 'q', chr(113) + chr(32) + '<>' + chr(32) + chr(39) * 2))} <= 1 AND length(text) > 500 THEN {single} ELSE {double} END"
    return f"SELECT doc_id, page, n, chunk, {d.rx('chunk', r'^\d+\.\s+[A-Z]')} AND length(chunk) < 120 AS numbered FROM {_blocks(d, 'page_text', pick)} AS z"


@query
def email_to_pages(d):
    line = lambda label, col: f"CASE WHEN {col} <> '' THEN concat('{label}: ', {col}) END"
    head = f"concat_ws({d.lit(chr(10))}, {line('From', 'sender')}, {line('To', 'recipient')}, {line('Subject', 'subject')})"
    mail = "SELECT conv_id, concat('user', CAST(conv_id AS STRING), '@example.org') AS sender, CASE WHEN conv_id % 3 = 0 THEN '' ELSE 'desk@example.org' END AS recipient, substring(text, 1, 20) AS subject, CASE WHEN conv_id % 4 = 0 THEN '' ELSE text END AS body FROM conversations WHERE turn = 0"
    return f"SELECT conv_id, concat('[Email Headers]', {d.lit(chr(10))}, {head}) AS page_1, CASE WHEN body = '' THEN '(No message body)' ELSE body END AS page_2, concat_ws({d.lit(chr(10) * 2)}, {head}, nullif(body, '')) AS total_text FROM ({mail}) AS m"


@query
def mail_sender_resolve(d):
    f = lambda k: f"CASE WHEN event_id % {k} = 0 THEN concat('a{k}-', CAST(event_id AS STRING)) ELSE '' END"
    row = f"SELECT event_id, {f(11)} AS smtp, {f(7)} AS creator, {f(5)} AS representing, event_id % 3 AS kind, {f(2)} AS email, {f(13)} AS inet, {f(17)} AS email1 FROM events"
    return f"SELECT event_id, coalesce(nullif(smtp, ''), nullif(creator, ''), nullif(representing, ''), CASE WHEN kind = 0 THEN nullif(email, '') END, nullif(inet, ''), nullif(email1, ''), email) AS sender FROM ({row}) AS r"


@query
def mail_recipients(d):
    one = "CASE WHEN turn % 3 = 0 THEN concat(role, ' <', role, '@example.org>') WHEN turn % 3 = 1 THEN concat(role, '@example.org') ELSE '(unknown)' END"
    return f"SELECT conv_id, {d.joined(one, ', ', 'turn')} AS recipients FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id"


@query
def attachment_expand(d):
    return "SELECT c.conv_id AS parent_id, c.conv_id * 100 + c.turn AS child_id, concat('attachment-', CAST(c.turn AS STRING), '.txt') AS name, c.text FROM conversations AS c WHERE c.turn > 0"


@query
def extract_route(d):
    t = "upper(regexp_extract(name, '[.]([a-z]+)$', 1))"
    return f"SELECT document_id, {t} AS file_type, CASE {t} WHEN 'PDF' THEN 'ocr' WHEN 'DOCX' THEN 'docx' WHEN 'EML' THEN 'mail' WHEN 'TXT' THEN 'text' ELSE 'reject' END AS route FROM document"


@query
def ext_type_map(d):
    ext = "lower(regexp_extract(name, '([.][A-Za-z0-9]+)$', 1))"
    kinds = {".pdf": "PDF", ".docx": "DOCX", ".xlsx": "XLSX", ".eml": "EML", ".msg": "MSG", ".txt": "TXT", ".pptx": "PPTX", ".png": "Image", ".jpg": "Image", ".jpeg": "Image", ".mp3": "MP3", ".wav": "WAV", ".m4a": "M4A", ".mp4": "MP4", ".mov": "MOV", ".avi": "AVI", ".webm": "WEBM"}
    return f"SELECT document_id, CASE WHEN {ext} = '' THEN 'UNKNOWN' ELSE {lookup(ext, kinds, f'upper(substring({ext}, 2, 20))')} END AS file_type FROM document"


@query
def doc_header(d):
    return f"SELECT document_id, {d.rx_replace('name', r'\.[^.]+$', '')} AS title, CAST(created_at AS DATE) AS updated_on, CASE WHEN assignee_id IS NULL THEN 'Unassigned' ELSE 'Assigned' END AS state FROM document"


@query
def text_selectable(d):
    return f"SELECT doc_id, {n('sum(length(text))')} > 50 AS selectable FROM page_text GROUP BY doc_id"


@query
def file_magic(d):
    sig = [("25504446", "PDF"), ("504B0304", "ZIP"), ("504B0506", "ZIP_EMPTY"), ("504B0708", "ZIP_SPANNED"), ("89504E470D0A1A0A", "PNG"), ("FFD8FF", "JPEG"), ("474946383761", "GIF87"), ("474946383961", "GIF89"), ("49492A00", "TIFF_LE"), ("4D4D002A", "TIFF_BE"), ("424D", "BMP"), ("D0CF11E0A1B11AE1", "OLE2"), ("494433", "ID3"), ("FFFB", "MP3_SYNC"), ("FFF3", "MP3_SYNC2"), ("FFF2", "MP3_SYNC3"), ("52494646", "WAV")]
    heads = values([(i, h + "00FF") for i, (h, _) in enumerate(sig)] + [(90, "0000001866747970"), (91, "0011"), (92, "")], "file_id, head", d)
    case = " ".join(f"WHEN {d.starts('head', d.lit(h))} THEN '{k}'" for h, k in sig)
    return f"SELECT file_id, CASE {case} WHEN substring(head, 9, 8) = '66747970' THEN 'MP4_FTYP' ELSE 'UNKNOWN' END AS magic FROM (SELECT file_id, head FROM ({heads}) AS h UNION ALL SELECT doc_id + 1000, hex({'encode(text, ' + chr(39) + 'UTF-8' + chr(39) + ')' if d.spark else 'encode(text)'}) FROM documents) AS x"


@query
def time_parse(d):
    s = "concat(lpad(CAST(event_id % 3 AS STRING), 2, '0'), ':', lpad(CAST(event_id % 60 AS STRING), 2, '0'), ':', lpad(CAST(event_id * 7 % 60 AS STRING), 2, '0'), '.500')"
    p = d.rx_split("stamp", ":")
    sec = f"CAST({d.at(p, '1')} AS DOUBLE) * 3600 + CAST({d.at(p, '2')} AS DOUBLE) * 60 + CAST({d.at(p, '3')} AS DOUBLE)"
    return f"SELECT event_id, seconds, concat(lpad(CAST(CAST(floor(seconds / 60) AS BIGINT) AS STRING), 3, '0'), ':', lpad(CAST(CAST(floor(seconds) AS BIGINT) % 60 AS STRING), 2, '0')) AS shown FROM (SELECT event_id, {sec} AS seconds FROM (SELECT event_id, {s} AS stamp FROM events) AS a) AS b"


@query
def polygon_hull(d):
    pts = ["pos_x", "pos_x + pos_w", "pos_x + pos_w / 2e0", "pos_x - 1e0"]
    return f"SELECT detection_id, least({', '.join(pts)}) AS min_x, greatest({', '.join(pts)}) AS max_x, pos_y AS min_y, pos_y + pos_h AS max_y FROM detection"


# --- geometry, redaction, verification -------------------------------------------------------


@query
def rect_iou(d):
    pair = "SELECT a.detection_id AS a_id, b.detection_id AS b_id, a.pos_x AS ax, a.pos_y AS ay, a.pos_w AS aw, a.pos_h AS ah, b.pos_x AS bx, b.pos_y AS by_, b.pos_w AS bw, b.pos_h AS bh FROM detection AS a JOIN detection AS b ON a.document_id = b.document_id AND a.page <> b.page AND a.detection_id < b.detection_id WHERE a.pos_w > 0 AND b.pos_w > 0"
    inter = "greatest(0e0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0e0, least(ay + ah, by_ + bh) - greatest(ay, by_))"
    inside = "bx >= ax AND by_ >= ay AND bx + bw <= ax + aw AND by_ + bh <= ay + ah"
    union = f"concat(CAST({half_up('least(ax, bx)', 2)} AS STRING), '')"
    del union
    return f"SELECT a_id, b_id, {half_up(f'({inter}) / (aw * ah + bw * bh - ({inter}))', 6)} AS iou, {inside} AS encloses, {half_up('least(ax, bx)', 2)} AS union_x, {half_up('greatest(ax + aw, bx + bw) - least(ax, bx)', 2)} AS union_w FROM ({pair}) AS p"


@query
def redact_coords(d):
    return "SELECT x.detection_id, x.pos_x / 100e0 * 595e0 AS left_pt, x.pos_y / 100e0 * 842e0 AS top_pt, (x.pos_x + x.pos_w) / 100e0 * 595e0 AS right_pt FROM detection AS x WHERE x.status = 'accepted' AND x.pos_w > 0"


TERMS = ("the", "der", "que", "555")


@query
def redact_text(d):
    """The first occurrence of each term in every line, the terms one after the other."""
    if d.spark:
        gone = "CASE WHEN instr(acc, t) > 0 THEN concat(substring(acc, 1, instr(acc, t) - 1), '[REDACTED]', substring(acc, instr(acc, t) + length(t))) ELSE acc END"
        line = f"aggregate({d.strings(list(TERMS))}, y, (acc, t) -> {gone})"
    else:
        line = "y"
        for t in TERMS:
            line = f"regexp_replace({line}, '{t}', '[REDACTED]')"
    return f"SELECT doc_id, {d.glue(d.each(d.rx_split('text', chr(10)), 'y', line), chr(10))} AS text FROM documents"


@query
def redact_all_occurrences(d):
    terms = values([(t,) for t in TERMS], "term", d)
    return f"SELECT c.doc_id, t.term, CAST((length(c.text) - length(replace(c.text, t.term, ''))) / length(t.term) AS BIGINT) AS applied FROM documents AS c JOIN ({terms}) AS t ON contains(c.text, t.term)"


@query
def verify_redaction(d):
    terms = values([(t,) for t in TERMS], "term", d)
    return f"SELECT c.doc_id, t.term, length(t.term) >= 3 AND contains(lower(replace(c.text, 'the', '[REDACTED]')), lower(t.term)) AS leaked FROM documents AS c JOIN ({terms}) AS t ON true"


# --- scalar families ---------------------------------------------------------------------------

MASKS = [(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "[redacted-email]"), (r"(?:\+?64|0)[\s-]?\d{1,4}[\s-]?\d{3,4}[\s-]?\d{3,4}", "[redacted-phone]"), (r"\d{2,3}[-\s]\d{3}[-\s]\d{3}", "[redacted-id]")]


@query
def mask_patterns(d):
    text = "text"
    for pattern, by in MASKS:
        text = d.rx_replace(text, pattern, by)
    nhi = r"(?<![A-Za-z0-9_])[A-Z]{3}\d{4}(?![A-Za-z0-9_])" if d.spark else r"\b[A-Z]{3}\d{4}\b"
    return f"SELECT doc_id, page, {d.rx_replace(text, nhi, '[redacted-nhi]')} AS text FROM page_text"


@query
def mask_entity(d):
    return f"SELECT detection_id, concat('[', type, ':sha:', substring({d.sha256('lower(trim(text))')}, 1, 8), ']') AS token FROM detection"


@query
def fn_string(d):
    return f"SELECT doc_id, {d.rx_replace('lower(trim(text))', r'[ \t\n\x0b\f\r]+', ' ')} AS normal, lpad(CAST(doc_id AS STRING), 6, '0') AS padded, CASE WHEN length(text) > 50 THEN concat(substring(text, 1, 50), '...') ELSE text END AS short FROM documents"


@query
def fn_math(d):
    return f"SELECT detection_id, {half_up('pos_x / 7e0', 2)} AS r2, {half_up('pos_x - 5.5e0', 0)} AS r0, greatest(0e0, least(100e0, confidence * 3 - 50)) AS clamped FROM detection"


@query
def fn_date(d):
    day = "CAST(ts AS DATE)"
    nxt = f"CASE {d.weekday(day)} WHEN 6 THEN 3 WHEN 7 THEN 2 ELSE 1 END"
    return f"SELECT event_id, {d.iso('ts')} AS iso, {day} AS day, CAST({d.days('ts', nxt)} AS DATE) AS next_working_day, {d.epoch('ts')} AS seconds FROM events"


@query
def fn_array(d):
    words = d.rx_split("text", r"\s+")
    return f"SELECT doc_id, {n(d.size(words))} AS words, {n(d.size(d.distinct(words)))} AS distinct_words, {n(d.size(d.keep(words, 'w', 'length(w) > 6')))} AS long_words FROM documents"


@query
def fn_map(d):
    return f"SELECT detection_id, {lookup('type', {'phone': 'Phone', 'email-addr': 'Email', 'nhi': 'NHI'}, 'type')} AS label FROM detection"


@query
def fn_json(d):
    get = (lambda k: f"get_json_object(props, '$.{k}')") if d.spark else (lambda k: f"json_extract_string(props, '$.{k}')")
    return f"SELECT event_id, coalesce({get('page')}, 'none') AS page, coalesce({get('k')}, 'none') AS k, props IS NULL AS missing FROM events"


@query
def fn_history_text(d):
    return "SELECT detection_id, CASE WHEN status = 'pending' THEN concat('Created as ', type) ELSE concat('Status changed from pending to ', status) END AS description FROM detection"


# --- scoring --------------------------------------------------------------------------------------

EXPECTED = [("F1", 1, "personal-name", "John Smith", "exact", 1), ("F1", 2, "phone", "555 1234", "sub", None), ("F1", 3, "personal-name", "John Smith", "exact", 1), ("F2", 1, "ird", "12-345-678", "exact", None), ("F2", 2, "custom-keyword", "secret", "sub", 2)]
ACTUAL = [("F1", 1, "personal-name", " john  smith", 1), ("F1", 2, "phone", "call 555 1234 now", 3), ("F1", 3, "address", "1 Rata Lane", 1), ("F2", 1, "ird", "98-765-432", 1), ("F2", 2, "custom-keyword", "a Secret plan", 2), ("F2", 3, "ird", "12-345-678", 4)]


@query
def score_match(d):
    norm = lambda c: d.rx_replace(f"lower(trim({c}))", r"\s+", " ")
    return f"SELECT e.fixture, e.k AS expected, a.k AS actual FROM ({values(EXPECTED, 'fixture, k, type, text, mode, page', d)}) AS e JOIN ({values(ACTUAL, 'fixture, k, type, text, page', d)}) AS a ON a.fixture = e.fixture AND a.type = e.type AND (e.page IS NULL OR e.page = a.page) AND CASE e.mode WHEN 'exact' THEN {norm('a.text')} = {norm('e.text')} ELSE contains({norm('a.text')}, {norm('e.text')}) END"


@query
def score_greedy(d):
    """Expected ones in order, each taking the first unclaimed actual; pairs are folded in (expected, actual) order."""
    pairs = f"SELECT fixture, expected, actual FROM ({score_match(d)}) AS m"
    packed = f"SELECT fixture, {d.listed(d.record(kind=chr(39) * 2, s='expected', e='actual', t=chr(39) * 2), 'expected * 1000 + actual')} AS pairs FROM ({pairs}) AS p GROUP BY fixture"
    hit = d.any("acc", "k", "k.s = x.s OR k.e = x.e")
    kept = d.fold("pairs", "[]", "struct<kind:string, s:int, e:int, t:string>", "acc", "x", f"CASE WHEN {hit} THEN acc ELSE {d.append('acc', d.single('x'))} END")
    return f"SELECT fixture, item.s AS expected, item.e AS actual FROM {d.exploded(f'(SELECT fixture, {kept} AS kept FROM ({packed}) AS a)', 'kept', 'n', 'item')} AS z"


@query
def score_pathway(d):
    path = "CASE WHEN type = 'sensitive-context' THEN 'context' WHEN type LIKE 'custom-%' OR type = 'manual' THEN NULL ELSE 'personal' END"
    return f"SELECT pathway, count(*) AS k FROM (SELECT {path} AS pathway FROM detection) AS x WHERE pathway IS NOT NULL GROUP BY pathway"


@query
def synth_pages(d):
    numbers = "range(200)" if d.spark else "range(200) AS r(id)"
    return f"SELECT CAST(id AS BIGINT) AS page, concat('Page ', CAST(id AS STRING), ' body', CASE WHEN id % 5 = 0 THEN concat(' person', CAST(id AS STRING), '@example.org 021 555 ', lpad(CAST(id AS STRING), 4, '0')) ELSE '' END) AS text FROM {numbers}"


# --- audit ------------------------------------------------------------------------------------------


def audit_body(d: Dialect) -> str:
    """What an entry's hash covers after the hash before it."""
    parts = [d.iso("ts"), "coalesce(CAST(user_id AS STRING), '')", "coalesce(type, '')", "coalesce(description, '')", "coalesce(target, '')", "coalesce(CAST(batch_id AS STRING), '')"]
    return f"concat_ws('|', {', '.join(parts)})"


def tampered(chain: str) -> str:
    """``chain`` with stored faults: hashes that are broken or missing, and texts altered after hashing."""
    return f"""SELECT audit_id, batch_id, ts, user_id, type, target, previous_hash,
        CASE WHEN audit_id % 4099 = 11 THEN 'altered' ELSE description END AS description,
        CASE WHEN audit_id % 4999 = 5 THEN 'broken' WHEN audit_id % 101 = 7 THEN NULL ELSE integrity_hash END AS integrity_hash FROM ({chain}) AS stored"""


def verify_chain(d: Dialect, rows: str) -> str:
    """Per batch its entries and the place of the first whose link or own hash does not hold; entries without a hash are passed over."""
    w = "OVER (PARTITION BY batch_id ORDER BY ts, audit_id)"
    again = d.sha256(f"concat(coalesce(previous_hash, ''), '|', {audit_body(d)})")
    bad = f"coalesce(integrity_hash, '') <> '' AND (coalesce(prior, '') <> '' AND coalesce(previous_hash, '') <> prior OR integrity_hash <> {again})"
    placed = f"SELECT *, lag(integrity_hash) {w} AS prior, row_number() {w} - 1 AS place FROM ({rows}) AS c"
    return f"SELECT batch_id, count(*) AS entries, {n(f'min(CASE WHEN {bad} THEN place END)')} AS broken_at FROM ({placed}) AS r GROUP BY batch_id"


def _json(d: Dialect) -> str:
    fields = {"id": "audit_id", "timestamp": d.iso("ts"), "userId": "user_id", "userName": "user_name", "userRole": "user_role", "type": "type", "description": "description", "target": "target", "batchId": "batch_id"}
    if d.spark:
        return "to_json(named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + "), map('ignoreNullFields', 'false'))"
    return "CAST(json_object(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ") AS VARCHAR)"


@query
def sink_jsonl(d):
    return f"SELECT audit_id, {_json(d)} AS line FROM audit"


@query
def sink_csv(d):
    cell = lambda c: f"CASE WHEN {d.rx(c, '[,' + chr(34) + '\\r\\n]')} THEN concat('\"', replace({c}, '\"', '\"\"'), '\"') ELSE {c} END"
    cells = ["CAST(audit_id AS STRING)", d.iso("ts"), "coalesce(CAST(user_id AS STRING), '')", "user_name", "user_role", "type", "target", "description"]
    return f"SELECT audit_id, concat_ws(',', {', '.join(map(cell, cells))}) AS line FROM audit"


# --- the whole dataflow -------------------------------------------------------------------------------


@query
def flagship(d):
    """Pages to review clusters: detect, keep the best of equal spans, route by tier, cluster by (type, text)."""
    found = f"""SELECT doc_id, page, type, text, 95 AS confidence, 'pattern' AS source, 1 AS source_rank, start FROM ({det.detect_patterns(d, 'page_text')}) AS a
        UNION ALL SELECT doc_id, page, type, text, 95, 'label-adjacent', 3, start FROM ({det.detect_labels(d, 'page_text')}) AS b
        UNION ALL SELECT doc_id, page, type, text, confidence, 'custom-rule', 2, start FROM ({det.rule_matches(d, 'page_text', RULES, ('Exact', 'Fuzzy', 'Regex'))}) AS c"""
    best = f"SELECT *, row_number() OVER (PARTITION BY doc_id, page, type, {det.folded(d, d.trim('text'))} ORDER BY confidence DESC, source_rank, start) AS r FROM ({found}) AS f"
    tier = "CASE WHEN confidence >= 85 OR source IN ('pattern', 'label-adjacent') THEN 'accepted' WHEN confidence >= 50 THEN 'pending' ELSE 'rejected' END"
    norm = d.rx_replace(det.folded(d, d.trim("text")), det.restated(r"\s+") if d.spark else r"\s+", " ")
    return f"SELECT type, norm, status, count(*) AS occurrences, count(DISTINCT doc_id) AS documents, avg(CAST(confidence AS DOUBLE)) AS mean_confidence FROM (SELECT doc_id, type, {norm} AS norm, {tier} AS status, confidence FROM ({best}) AS b WHERE r = 1) AS t GROUP BY type, norm, status"
