"""Scans, filters, joins, aggregates, windows, set operators and state changes over the model.

Every entry builds one SQL text; Catalyst plans it over the model's views, and
the same relation in the oracle's dialect checks it.
"""

from __future__ import annotations

from collections.abc import Callable

from quillgate.plans.dialect import Dialect
from quillgate.sources.model import TYPES, values

NOW = "2024-02-10 00:00:00"
DONE = "('ready', 'in-review', 'reviewed', 'signed-off', 'auto-redacted')"
#: Codes by detection type (fixed values); other types have none.
GROUNDS = {t: "s7_2a" for t in TYPES[:10]}
TIMELINE = {
    "document-upload": "Document Uploaded", "document-uploaded": "Document Uploaded", "processing-started": "Processing Started", "processing-start": "Processing Started",
    "processing-complete": "Processing Completed", "processing-completed": "Processing Completed", "processing-error": "Processing Error",
    "detection-accepted": "Detection Reviewed (Accepted)", "detection-rejected": "Detection Reviewed (Rejected)", "detection-reviewed": "Detection Reviewed",
    "detection-update": "Detection Updated", "review-submitted": "Review Submitted", "review-started": "Review Started", "sign-off": "Sign-Off", "signed-off": "Sign-Off",
    "export-generated": "Export Package Generated", "export-started": "Export Started", "redaction-verification": "Redaction Verified",
    "document-assigned": "Reviewer Assigned", "status-change": "Status Changed",
}


def lookup(key: str, table: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def n(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def count_if(condition: str) -> str:
    return n(f"sum(CASE WHEN {condition} THEN 1 ELSE 0 END)")


def half_up(x: str, places: int = 0) -> str:
    """Rounding with halves towards plus infinity."""
    scale = f"{10**places}e0"
    return f"floor(({x}) * {scale} + 0.5e0) / {scale}"


def share(part: str, whole: str) -> str:
    """Percent, halves up, 0 of nothing."""
    return f"CASE WHEN {whole} = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor({part} * 100e0 / {whole} + 0.5e0) AS BIGINT) END"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} = 0 THEN 1e0 ELSE {a} * 1e0 / ({b}) END"


Build = Callable[[Dialect], str]
QUERIES: dict[str, Build] = {}


def query(build: Build) -> Build:
    QUERIES[build.__name__] = build
    return build


def simple(**texts: str) -> None:
    for name, text in texts.items():
        QUERIES[name] = lambda d, text=text: text


# --- scans, projections, filters --------------------------------------------

simple(
    scan_table="SELECT batch_id, reference, name, status FROM batch",
    project_select="SELECT document_id, name, status FROM document",
    project_derive="SELECT document_id, CAST(floor(size_bytes / 1024e0 + 0.5e0) AS BIGINT) AS size_kb, coalesce(extraction_ms, 0) AS extraction_ms, coalesce(assignee_id, -1) AS assignee_id FROM document",
    filter_eq_in_notin="SELECT document_id, status, assignee_id FROM document WHERE status IN ('ready', 'reviewed', 'error') AND status <> 'error' AND assignee_id NOT IN (1, 2)",
    filter_null="SELECT batch_id, deleted_at IS NOT NULL AS in_trash FROM batch WHERE purged_at IS NULL",
    filter_range="SELECT detection_id, confidence FROM detection WHERE confidence > 85 AND confidence <= 98 AND page >= 2",
    filter_contains_ci="SELECT doc_id, page FROM page_text WHERE contains(lower(text), lower('KARAKA')) OR contains(lower(text), 'license')",
    ui_doc_search="SELECT document_id, name FROM document WHERE contains(lower(name), lower('FILE-12'))",
    confidence_band="SELECT detection_id, CASE WHEN confidence >= 85 THEN 'High' WHEN confidence >= 50 THEN 'Medium' ELSE 'Low' END AS band FROM detection",
    case_status_map="""SELECT audit_id, CASE WHEN contains(type, 'detection') OR contains(type, 'review') THEN 'review' WHEN contains(type, 'document') OR contains(type, 'processing') THEN 'document'
        WHEN contains(type, 'export') OR contains(type, 'redaction') THEN 'export' WHEN contains(type, 'sign') THEN 'sign-off' ELSE 'system' END AS category FROM audit""",
)


@query
def scan_raw_sql(d):
    return f"SELECT audit_id, {d.iso('ts')} AS ts_text, user_name, type FROM audit"


@query
def filter_prefix(d):
    return f"SELECT batch_id, reference FROM batch WHERE {d.starts('reference', d.lit('RB-2022-'))}"


@query
def ui_batch_search(d):
    return "SELECT batch_id, reference FROM batch WHERE status = 'processing' AND (contains(lower(reference), '1') OR contains(lower(name), '7'))"


@query
def ui_audit_search(d):
    return "SELECT audit_id, type FROM audit WHERE type = 'detection-update' AND (contains(lower(description), 'click') OR contains(lower(target), 'file-3') OR contains(lower(user_name), 'user-1'))"


@query
def ui_rule_search(d):
    return "SELECT rule_id, name FROM rule WHERE contains(lower(name), 'li') OR contains(lower(type), 'entity')"


@query
def enabled_types(d):
    toggles = values([(t, i % 3 != 0) for i, t in enumerate(TYPES)], "type, enabled", d)
    return f"""SELECT t.type, g.enabled OR t.type = 'nhi' AS for_patterns, g.enabled OR t.type IN ('nhi', 'sensitive-context') AS for_labels
        FROM type_list AS t JOIN ({toggles}) AS g ON t.type = g.type"""


@query
def case_timeline_label(d):
    return f"SELECT * FROM (SELECT audit_id, type, {lookup('type', TIMELINE)} AS label FROM audit) AS x WHERE label IS NOT NULL"


@query
def error_classify(d):
    raw = "CASE event_id % 11 WHEN 0 THEN 'Failed to download x' WHEN 1 THEN 'Document not found' WHEN 2 THEN 'connect ECONNREFUSED' WHEN 3 THEN 'HTTP 429' WHEN 4 THEN 'ETIMEDOUT' WHEN 5 THEN 'file corrupt' WHEN 6 THEN 'encrypted file' WHEN 7 THEN 'Unsupported type' WHEN 8 THEN 'AI detection unavailable: x' WHEN 9 THEN 'timeout and rate limit' ELSE event_type END"
    has = lambda *w: " OR ".join(f"contains(message, '{x}')" for x in w)
    return f"""SELECT event_id, CASE WHEN {has('Failed to download')} THEN 'missing-file' WHEN {has('Document not found')} THEN 'missing-record' WHEN {has('ECONNREFUSED', 'ENOTFOUND')} THEN 'network'
        WHEN {has('429', 'rate limit')} THEN 'rate-limit' WHEN {has('timeout', 'ETIMEDOUT')} THEN 'timeout' WHEN {has('corrupted', 'corrupt', 'unreadable')} THEN 'corrupt'
        WHEN {has('password', 'encrypted')} THEN 'encrypted' WHEN {has('unsupported', 'Unsupported')} THEN 'unsupported' WHEN {has('AI detection unavailable')} THEN 'ai-unavailable' ELSE 'other' END AS class
        FROM (SELECT event_id, {raw} AS message FROM events) AS e"""


@query
def deadline_class(d):
    left = f"datediff(CAST(updated_at AS DATE), DATE '2024-01-20')" if d.spark else "date_diff('day', DATE '2024-01-20', CAST(updated_at AS DATE))"
    return f"SELECT batch_id, {n(left)} AS days_left, CASE WHEN {left} <= 3 THEN 'urgent' WHEN {left} <= 7 THEN 'warning' ELSE 'safe' END AS class FROM batch"


# --- joins --------------------------------------------------------------------

simple(
    join_inner_fk="SELECT x.detection_id, x.type, c.name FROM detection AS x JOIN document AS c ON x.document_id = c.document_id",
    join_left_fk="SELECT c.document_id, coalesce(u.name, 'Unassigned') AS assignee FROM document AS c LEFT JOIN usr AS u ON c.assignee_id = u.user_id",
    join_semi_relation="SELECT detection_id, status FROM detection WHERE document_id IN (SELECT document_id FROM document WHERE batch_id % 10 = 3)",
    join_hash_map="""SELECT c.document_id, coalesce(a.k, 0) AS accepted FROM document AS c LEFT JOIN
        (SELECT document_id, count(*) AS k FROM detection WHERE status = 'accepted' GROUP BY document_id) AS a ON c.document_id = a.document_id""",
    join_theta_contains="""SELECT a.audit_id, f.name FROM audit AS a JOIN (SELECT DISTINCT target AS name FROM audit) AS f
        ON contains(lower(a.target), lower(f.name)) OR contains(lower(a.description), lower(f.name))""",
)


@query
def join_nested_collect(d):
    packed = d.listed("concat(CAST(detection_id AS STRING), ':', status)", "detection_id")
    return f"SELECT c.document_id, coalesce(x.k, 0) AS n_detections, {d.glue('x.items', ',')} AS detections FROM document AS c LEFT JOIN (SELECT document_id, count(*) AS k, {packed} AS items FROM detection GROUP BY document_id) AS x ON c.document_id = x.document_id"


@query
def join_full_outer_maps(d):
    return "SELECT coalesce(m.type, a.type) AS type, coalesce(m.k, 0) AS manual, coalesce(a.k, 0) AS ai FROM (SELECT type, count(*) AS k FROM detection WHERE source = 'manual' AND status = 'accepted' GROUP BY type) AS m FULL OUTER JOIN (SELECT type, count(*) AS k FROM detection WHERE source = 'ai' AND status = 'accepted' GROUP BY type) AS a ON m.type = a.type"


@query
def join_queue_groups(d):
    return f"SELECT b.batch_id, b.reference, b.updated_at, {d.glue(d.listed('c.name', 'c.document_id'), ';')} AS documents FROM batch AS b JOIN document AS c ON c.batch_id = b.batch_id WHERE c.status IN ('queued', 'processing', 'error') GROUP BY b.batch_id, b.reference, b.updated_at"


@query
def join_theta_containment(d):
    norm = "lower(trim(text))"
    base = f"SELECT detection_id, document_id, page, {norm} AS t FROM detection"
    return f"SELECT c.detection_id FROM ({base} WHERE source = 'custom-rule') AS c WHERE NOT EXISTS (SELECT 1 FROM ({base} WHERE source IN ('pattern', 'ai')) AS p WHERE p.document_id = c.document_id AND p.page = c.page AND (p.t = c.t OR contains(p.t, c.t) OR contains(c.t, p.t)))"


@query
def join_ai_overlap(d):
    base = "SELECT detection_id, document_id, lower(trim(text)) AS t FROM detection"
    return f"SELECT a.detection_id FROM ({base} WHERE source = 'ai') AS a WHERE NOT EXISTS (SELECT 1 FROM ({base} WHERE source = 'pattern') AS p WHERE p.document_id = a.document_id AND (p.t = a.t OR contains(p.t, a.t) OR contains(a.t, p.t)))"


@query
def join_interval_overlap(d):
    span = "SELECT detection_id, document_id, source, page * 10 AS s, page * 10 + CAST(pos_w AS INT) + 1 AS e FROM detection"
    return f"SELECT a.detection_id AS a_id, b.detection_id AS b_id FROM ({span}) AS a JOIN ({span}) AS b ON a.document_id = b.document_id AND a.detection_id < b.detection_id AND a.s < b.e AND a.e > b.s"


@query
def join_anti_existing(d):
    return "SELECT x.document_id, x.detection_id FROM detection AS x WHERE x.source = 'manual' AND NOT EXISTS (SELECT 1 FROM detection AS y WHERE y.document_id = x.document_id AND lower(y.text) = lower(x.text) AND y.source <> 'manual')"


@query
def join_recompute_latest(d):
    return "SELECT batch_id, audit_id, ts FROM (SELECT batch_id, audit_id, ts, row_number() OVER (PARTITION BY batch_id ORDER BY ts DESC, audit_id DESC) AS r FROM audit WHERE type = 'export-generated') AS x WHERE r = 1"


# --- aggregates ------------------------------------------------------------------


@query
def agg_dashboard(d):
    return f"SELECT status, count(*) AS batches, {count_if('deleted_at IS NULL')} AS live, {n('sum(owner_id)')} AS owners FROM batch GROUP BY status UNION ALL SELECT 'all', count(*), {count_if('deleted_at IS NULL')}, {n('sum(owner_id)')} FROM batch"


@query
def agg_detection_stats(d):
    states = ", ".join(f"{count_if(f'status = {chr(39)}{s}{chr(39)}')} AS {s}" for s in ("accepted", "rejected", "pending"))
    return f"SELECT document_id, count(*) AS total, {states} FROM detection GROUP BY document_id"


@query
def agg_type_breakdown(d):
    return f"SELECT type, k, {share('k', 'total')} AS percent FROM (SELECT type, count(*) AS k, {n('sum(count(*)) OVER ()')} AS total FROM detection WHERE status = 'accepted' GROUP BY type) AS x ORDER BY k DESC, type LIMIT 8"


@query
def agg_summary(d):
    return f"SELECT (SELECT count(*) FROM batch) AS batches, (SELECT count(*) FROM document) AS documents, (SELECT count(*) FROM detection WHERE status = 'accepted') AS redactions"


@query
def agg_accuracy(d):
    tp, fp = count_if("status = 'accepted'"), count_if("status = 'rejected'")
    band = "CASE WHEN confidence >= 85 THEN 'band-high' WHEN confidence >= 50 THEN 'band-medium' ELSE 'band-low' END"
    parts = [f"SELECT {key} AS grp, {tp} AS tp, {fp} AS fp FROM detection WHERE source = 'ai' AND status <> 'pending' GROUP BY {key}" for key in ("type", band)]
    parts.append(f"SELECT 'all' AS grp, {tp} AS tp, {fp} AS fp FROM detection WHERE source = 'ai' AND status <> 'pending'")
    return f"SELECT grp, tp, fp, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp * 1e0 / (tp + fp) END AS precision_, tp + fp >= 10 AS sufficient FROM ({' UNION ALL '.join(parts)}) AS x"


@query
def agg_false_negative(d):
    manual, ai = count_if("source = 'manual'"), count_if("source <> 'manual'")
    parts = f"SELECT type, {manual} AS manual, {ai} AS ai FROM detection WHERE status = 'accepted' GROUP BY type UNION ALL SELECT 'all', {manual}, {ai} FROM detection WHERE status = 'accepted'"
    return f"SELECT type, manual, ai, CASE WHEN manual + ai = 0 THEN 0e0 ELSE manual * 1e0 / (manual + ai) END AS rate FROM ({parts}) AS x"


@query
def agg_processing(d):
    last = f"completed_at >= {d.days(d.ts('1998-08-01 00:00:00'), '-1')} AND total_ms IS NOT NULL"
    avg = lambda c: f"CAST(floor(coalesce(avg({c}), 0e0) + 0.5e0) AS BIGINT) AS avg_{c}"
    return f"""SELECT count(*) AS documents, {count_if("status IN ('ready', 'in-review', 'excluded')")} AS processed, {count_if("status = 'error'")} AS failed,
        {count_if("status IN ('pending', 'queued', 'processing')")} AS waiting, {avg('extraction_ms')}, {avg('pattern_ms')}, {avg('ai_ms')}, {avg('total_ms')},
        CAST(floor(coalesce(sum(CASE WHEN {last} THEN page_count END), 0) / 24e0 + 0.5e0) AS BIGINT) AS pages_per_hour FROM document"""


@query
def agg_case_processing(d):
    return f"SELECT batch_id, count(*) AS documents, {n('sum(page_count)')} AS pages, {n('coalesce(sum(total_ms), 0)')} AS total_ms, CAST(floor(coalesce(avg(total_ms), 0e0) + 0.5e0) AS BIGINT) AS mean_ms FROM document GROUP BY batch_id"


@query
def agg_stats_matrix(d):
    return f"""SELECT t.type, {n("coalesce(sum(CASE WHEN x.status = 'accepted' THEN x.k END), 0)")} AS accepted, {n("coalesce(sum(CASE WHEN x.status = 'pending' THEN x.k END), 0)")} AS pending,
        {n("coalesce(sum(CASE WHEN x.status = 'rejected' THEN x.k END), 0)")} AS rejected, {n('coalesce(sum(x.k), 0)')} AS total
        FROM type_list AS t LEFT JOIN (SELECT type, status, count(*) AS k FROM detection GROUP BY type, status) AS x ON x.type = t.type GROUP BY t.type"""


@query
def agg_stats_grouping(d):
    return "SELECT document_id, type, status, count(*) AS k FROM detection GROUP BY GROUPING SETS ((document_id, type, status), (status), (type), ())"


@query
def agg_qa_simulation(d):
    return f"""SELECT c.document_id, coalesce(x.redactions, 0) AS redactions, coalesce(x.pages, 0) AS redacted_pages, coalesce(x.pages, 0) >= c.page_count AS fully_withheld,
        {share('coalesce(x.pages, 0)', 'c.page_count')} AS percent_pages, coalesce(x.low, 0) AS low_confidence, coalesce(x.waiting, 0) > 0 AS has_pending
        FROM document AS c LEFT JOIN (SELECT document_id, {count_if("status = 'accepted'")} AS redactions, count(DISTINCT CASE WHEN status = 'accepted' THEN page END) AS pages,
        {count_if("status = 'accepted' AND confidence < 0.6e0")} AS low, {count_if("status = 'pending'")} AS waiting FROM detection GROUP BY document_id) AS x ON x.document_id = c.document_id"""


@query
def agg_workload(d):
    return f"""SELECT user_id, {d.pick('user_name', 'audit_id', False)} AS name, count(*) AS actions, count(DISTINCT target) AS documents, {count_if("type = 'detection-accepted'")} AS accepted,
        {count_if("type = 'detection-rejected'")} AS rejected, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day
        FROM audit WHERE user_id IS NOT NULL AND type IN ('detection-accepted', 'detection-rejected', 'detection-update', 'review-submitted') GROUP BY user_id"""


@query
def agg_workload_days(d):
    return "SELECT CAST(ts AS DATE) AS day, count(*) AS actions FROM audit WHERE type LIKE 'detection-%' GROUP BY CAST(ts AS DATE)"


@query
def agg_tray_clusters(d):
    norm = d.rx_replace("lower(text)", r"\s+", " ")
    key = "(confidence * 1000000000 - detection_id)"
    return f"""SELECT type, norm, {d.pick('text', key, True)} AS shown, count(*) AS occurrences, count(DISTINCT document_id) AS documents, avg(confidence) AS mean_confidence, {n('min(detection_id)')} AS first_id
        FROM (SELECT *, {norm} AS norm FROM detection WHERE status = 'pending') AS x GROUP BY type, norm"""


@query
def agg_redaction_schedule(d):
    return "SELECT x.type, c.name, x.page, count(*) AS redactions FROM detection AS x JOIN document AS c ON c.document_id = x.document_id WHERE x.status = 'accepted' GROUP BY x.type, c.name, x.page"


@query
def agg_retention_status(d):
    return f"SELECT max(purged_at) AS latest_archive, {count_if('deleted_at IS NOT NULL AND purged_at IS NULL')} AS in_trash, {count_if('purged_at IS NOT NULL')} AS archived FROM batch"


@query
def agg_batch_status(d):
    all_in = lambda s: f"min(CASE WHEN c.status IN {s} THEN 1 ELSE 0 END) = 1"
    some = lambda s: f"max(CASE WHEN c.status IN {s} THEN 1 ELSE 0 END) = 1"
    return f"""SELECT b.batch_id, b.status AS old_status, CASE WHEN b.status IN ('draft', 'exported') OR b.deleted_at IS NOT NULL THEN b.status
        WHEN {some("('pending', 'processing')")} THEN 'processing' WHEN {some("('error')")} THEN 'processing' WHEN {all_in("('auto-redacted')")} THEN 'auto-redacted'
        WHEN {all_in("('reviewed', 'signed-off', 'auto-redacted')")} THEN 'reviewed' WHEN {all_in("('ready', 'in-review', 'reviewed', 'signed-off', 'auto-redacted')")} THEN 'ready-for-review' ELSE b.status END AS new_status
        FROM batch AS b JOIN document AS c ON c.batch_id = b.batch_id WHERE c.status <> 'excluded' GROUP BY b.batch_id, b.status, b.deleted_at"""


@query
def agg_doc_status(d):
    return f"""SELECT document_id, CASE WHEN {count_if("status = 'pending'")} = 0 AND {count_if("status = 'accepted'")} >= 1 THEN 'auto-redacted' ELSE 'ready' END AS status FROM detection GROUP BY document_id"""


@query
def agg_doc_review_status(d):
    return f"""SELECT c.document_id, CASE WHEN c.status = 'in-review' AND x.total >= 1 AND x.waiting = 0 THEN 'reviewed' ELSE c.status END AS status
        FROM document AS c JOIN (SELECT document_id, count(*) AS total, {count_if("status = 'pending'")} AS waiting FROM detection GROUP BY document_id) AS x ON x.document_id = c.document_id"""


@query
def agg_avg_confidence(d):
    return f"SELECT document_id, {half_up('avg(confidence)', 1)} AS avg_confidence FROM detection GROUP BY document_id"


@query
def agg_archive_summary(d):
    return f"SELECT batch_id, count(*) AS entries, min(CASE WHEN user_id IS NULL THEN 0 ELSE 1 END) = 1 AS chain_valid, min(min(CASE WHEN user_id IS NULL THEN 0 ELSE 1 END)) OVER () = 1 AS all_valid FROM audit GROUP BY batch_id"


@query
def agg_pending_docs(d):
    return f"SELECT {n('coalesce(sum(x.docs - x.reviewed), 0)')} AS pending FROM batch AS b JOIN (SELECT batch_id, count(*) AS docs, {count_if(chr(39).join(['status = ', 'reviewed', '']))} AS reviewed FROM document GROUP BY batch_id) AS x ON x.batch_id = b.batch_id WHERE b.status <> 'exported'"


@query
def agg_score(d):
    x = f"SELECT source, {count_if(chr(39).join(['status = ', 'accepted', '']))} AS tp, {count_if(chr(39).join(['status = ', 'rejected', '']))} AS fp, {count_if(chr(39).join(['status = ', 'pending', '']))} AS fn FROM detection GROUP BY source"
    return f"SELECT source, tp, fp, fn, {ratio('tp', 'tp + fp')} AS precision_, {ratio('tp', 'tp + fn')} AS recall, CASE WHEN {ratio('tp', 'tp + fp')} + {ratio('tp', 'tp + fn')} = 0 THEN 0e0 ELSE 2e0 * {ratio('tp', 'tp + fp')} * {ratio('tp', 'tp + fn')} / ({ratio('tp', 'tp + fp')} + {ratio('tp', 'tp + fn')}) END AS f1 FROM ({x}) AS x"


_SCORES = [("B1", "personal", 12.0, 11.5, 8.0), ("B1", "context", 3.0, 1.0, 2.0), ("B2", "personal", 10.0, 4.0, 5.0), ("B3", "personal", 0.0, 0.0, 0.0), ("B3", "context", 7.0, 3.0, 1.0)]


@query
def agg_suite(d):
    return f"SELECT pathway, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, {ratio('sum(tp)', 'sum(tp) + sum(fp)')} AS precision_, {ratio('sum(tp)', 'sum(tp) + sum(fn)')} AS recall FROM (SELECT fixture, pathway, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn FROM ({values(_SCORES, 'fixture, pathway, tp, fp, fn', d)}) AS v UNION ALL SELECT fixture, 'all', CAST(tp AS DOUBLE), CAST(fp AS DOUBLE), CAST(fn AS DOUBLE) FROM ({values(_SCORES, 'fixture, pathway, tp, fp, fn', d)}) AS w) AS x GROUP BY pathway"


@query
def agg_median_stddev(d):
    return f"SELECT type, median(value) AS median, {half_up('coalesce(stddev_samp(value), 0e0)', 6)} AS stddev, min(value) AS low, max(value) AS high FROM (SELECT type, confidence AS value FROM detection) AS x GROUP BY type"


# --- windows and ordering ------------------------------------------------------------


@query
def win_dedup_best(d):
    key = f"PARTITION BY document_id, type, lower({d.trim('text')}), {half_up('pos_y', 1)}"
    return f"SELECT detection_id, first_seq FROM (SELECT detection_id, min(seq) OVER ({key}) AS first_seq, row_number() OVER ({key} ORDER BY confidence DESC, seq) AS r FROM detection) AS x WHERE r = 1"


@query
def win_dedup_text(d):
    return "SELECT document_id, page, text FROM (SELECT document_id, page, text, row_number() OVER (PARTITION BY document_id, page, text ORDER BY detection_id) AS r FROM detection WHERE length(text) <= 80) AS x WHERE r = 1"


@query
def win_dedup_union(d):
    norm = d.rx_replace("lower(trim(text))", r"\s+", " ")
    return f"SELECT detection_id FROM (SELECT detection_id, row_number() OVER (PARTITION BY type, page, {norm} ORDER BY detection_id) AS r FROM detection) AS x WHERE r = 1"


@query
def win_bbox_merge(d):
    rank = "CASE status WHEN 'accepted' THEN 2 WHEN 'rejected' THEN 1 ELSE 0 END"
    return f"SELECT document_id, page, pos_x, pos_y, {n('min(detection_id)')} AS primary_id, {d.pick('text', d.record(i='detection_id', t='text'), False)} AS text, {n(f'max({rank})')} AS status_rank, count(DISTINCT type) AS types FROM detection GROUP BY document_id, page, pos_x, pos_y, pos_w, pos_h"


@query
def sort_position(d):
    return "SELECT detection_id, row_number() OVER (PARTITION BY document_id ORDER BY page, pos_y, detection_id) AS place FROM detection"


@query
def sort_multi(d):
    return "SELECT x.detection_id, row_number() OVER (PARTITION BY c.batch_id ORDER BY x.type, c.name, x.page, x.detection_id) AS place FROM detection AS x JOIN document AS c ON c.document_id = x.document_id"


@query
def sort_priority(d):
    return "SELECT rule_id, row_number() OVER (ORDER BY CASE priority WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 99 END, rule_id) AS place FROM rule"


@query
def sort_clusters(d):
    x = "SELECT type, lower(trim(text)) AS t, count(*) AS k FROM detection WHERE status = 'pending' GROUP BY type, lower(trim(text))"
    return f"SELECT type, t, k, row_number() OVER (ORDER BY k DESC, type, t) AS by_count, row_number() OVER (ORDER BY type, k DESC, t) AS by_type FROM ({x}) AS x"


@query
def topk_recent(d):
    return "SELECT document_id, name, completed_at FROM document WHERE completed_at IS NOT NULL ORDER BY completed_at DESC, document_id LIMIT 20"


@query
def claim_limit(d):
    return f"SELECT batch_id, purge_at FROM batch WHERE deleted_at IS NOT NULL AND purge_at <= {d.ts(NOW)} AND NOT claimed AND purged_at IS NULL ORDER BY purge_at, batch_id LIMIT 10"


@query
def next_reference(d):
    return f"SELECT concat('RB-2023-', lpad(CAST(CAST(substring(max(reference), 9, 10) AS INT) + 1 AS STRING), 3, '0')) AS reference FROM batch WHERE {d.starts('reference', d.lit('RB-2023-'))}"


@query
def interval_merge(d):
    spans = "SELECT document_id, page * 7 AS s, page * 7 + CAST(floor(pos_w) AS INT) % 9 AS e FROM detection"
    flag = "CASE WHEN s <= max(e) OVER (PARTITION BY document_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END"
    island = "sum(fresh) OVER (PARTITION BY document_id ORDER BY s, e, fresh DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"  # of equal spans the one that opens an island first
    return f"SELECT document_id, {n('min(s)')} AS s, {n('max(e)')} AS e FROM (SELECT document_id, s, e, {island} AS island FROM (SELECT document_id, s, e, {flag} AS fresh FROM ({spans}) AS a) AS b) AS c GROUP BY document_id, island"


@query
def segments_to_pages(d):
    minute = "CAST(floor(start / 60) AS BIGINT)"
    seg = "SELECT conv_id, turn, turn * 25 + turn * turn * 2 AS start, concat('[', role, '] ', text) AS line FROM conversations"
    flag = f"CASE WHEN {minute} > lag({minute}) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END"
    isl = "sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    mm = lambda m: f"concat(lpad(CAST({m} AS STRING), 2, '0'), ':00')"
    return f"""SELECT conv_id, page, concat('[', {mm('m')}, ' - ', CASE WHEN page = pages THEN 'end' ELSE {mm('m + 1')} END, ']', {d.lit(chr(10))}, body) AS text FROM (
        SELECT conv_id, {n('1 + island')} AS page, max(minute) AS m, {d.joined('line', ' ', 'turn')} AS body, {n('max(max(1 + island)) OVER (PARTITION BY conv_id)')} AS pages FROM (
        SELECT *, {isl} AS island FROM (SELECT *, {minute} AS minute, {flag} AS fresh FROM ({seg}) AS a) AS b) AS c GROUP BY conv_id, island) AS e"""


# --- set operators --------------------------------------------------------------------


@query
def union_sources(d):
    parts = [f"SELECT detection_id, document_id, '{s}' AS source, {i} AS source_rank FROM detection WHERE source = '{s}'" for i, s in enumerate(("pattern", "ai", "custom-rule", "label-adjacent"))]
    return f"SELECT detection_id, document_id, source, row_number() OVER (PARTITION BY document_id ORDER BY source_rank, detection_id) AS seq FROM ({' UNION ALL '.join(parts)}) AS x"


@query
def union_propagated(d):
    return "SELECT detection_id, source, confidence FROM detection WHERE source <> 'entity-propagation' UNION ALL SELECT detection_id, 'entity-propagation', 85e0 FROM detection WHERE source = 'entity-propagation'"


simple(
    distinct_docs="SELECT DISTINCT document_id FROM detection WHERE status = 'pending'",
    milestones="SELECT batch_id, stage, min(ts) AS reached_at FROM (SELECT batch_id, ts, CASE WHEN type = 'document-uploaded' THEN 'upload' WHEN type = 'export-generated' THEN 'export' ELSE 'review' END AS stage FROM audit WHERE type IN ('document-uploaded', 'export-generated', 'review-submitted')) AS x GROUP BY batch_id, stage",
)


@query
def full_key_union(d):
    old, new = values([("B1", 0.615), ("B2", 0.52), ("B4", 0.3)], "fixture, f1", d), values([("B1", 0.50), ("B2", 0.55), ("B3", 0.7)], "fixture, f1", d)
    return f"SELECT coalesce(o.fixture, w.fixture) AS fixture, CAST(o.f1 AS DOUBLE) AS old_f1, CAST(w.f1 AS DOUBLE) AS new_f1, o.fixture IS NULL AS added, w.fixture IS NULL AS missing FROM ({old}) AS o FULL OUTER JOIN ({new}) AS w ON o.fixture = w.fixture"


# --- decisions, state, gates ---------------------------------------------------------------


@query
def tier_route(d):
    tier = "CASE WHEN source IN ('pattern', 'custom-rule', 'label-adjacent', 'manual') THEN 'high' WHEN confidence >= 85 THEN 'high' WHEN confidence >= 50 THEN 'medium' ELSE 'low' END"
    return f"SELECT detection_id, tier, CASE tier WHEN 'high' THEN 'accepted' WHEN 'medium' THEN 'pending' ELSE 'rejected' END AS status FROM (SELECT detection_id, {tier} AS tier FROM detection) AS x"


@query
def default_ground(d):
    return f"SELECT detection_id, CASE WHEN {d.starts('type', d.lit('custom-'))} THEN '' ELSE {lookup('type', GROUNDS, chr(39) * 2)} END AS ground FROM detection"


@query
def bbox_policy(d):
    return "SELECT detection_id, CASE WHEN document_id % 5 = 0 THEN 'zero-box' WHEN length(text) > 6 AND source <> 'ai' THEN 'zero-box' WHEN page % 3 = 0 THEN CASE WHEN source = 'ai' AND length(text) > 6 THEN 'zero-box' ELSE 'drop' END ELSE 'located' END AS policy FROM detection"


@query
def selection_bbox(d):
    return f"SELECT detection_id, {half_up('pos_x / 10e0', 2)} AS x, {half_up('pos_y', 2)} AS y, {half_up('pos_w / 2e0', 2)} AS w, {half_up('pos_h', 2)} AS h FROM detection WHERE length(trim(text)) >= 2 AND pos_w / 2e0 >= 0.1e0 AND pos_h >= 0.1e0"


simple(
    ui_preview_visible="SELECT detection_id FROM detection WHERE page = 1 AND (pos_w > 0 OR pos_h > 0) AND status IN ('accepted', 'pending')",
    upd_threshold="SELECT detection_id, CASE WHEN status = 'pending' AND confidence > 85 THEN 'accepted' ELSE status END AS status FROM detection",
    upd_by_type="SELECT detection_id, CASE WHEN status = 'pending' AND type = 'phone' THEN 'accepted' ELSE status END AS status FROM detection",
    upd_similar="SELECT detection_id, CASE WHEN status = 'pending' AND lower(text) = lower('Term 7') THEN 'accepted' ELSE status END AS status FROM detection",
    upd_type="SELECT detection_id, CASE WHEN detection_id % 97 = 0 THEN 'manual' ELSE type END AS type FROM detection",
    upd_remaining="SELECT detection_id, CASE WHEN status = 'pending' AND document_id % 10 = 1 THEN 'accepted' ELSE status END AS status FROM detection",
    history_list="SELECT detection_id, 'status' AS field, 'pending' AS previous_value, status AS new_value, created_at FROM detection WHERE document_id = 1 AND status <> 'pending' ORDER BY created_at DESC, detection_id",
    manual_delete="SELECT c.document_id, greatest(0, c.page_count - coalesce(x.k, 0)) AS remaining FROM document AS c LEFT JOIN (SELECT document_id, count(*) AS k FROM detection WHERE source = 'manual' GROUP BY document_id) AS x ON x.document_id = c.document_id",
    rules_active="SELECT rule_id, name FROM rule WHERE status = 'Active'",
    doc_exclude="SELECT document_id, CASE WHEN document_id % 17 = 0 AND status NOT IN ('processing', 'excluded') THEN 'excluded' WHEN document_id % 17 = 1 AND status = 'excluded' THEN 'ready' ELSE status END AS status FROM document WHERE document_id % 19 <> 0",
)


@query
def upd_accept(d):
    decision = "CASE detection_id % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'pending' END"
    return f"SELECT detection_id, document_id, status AS previous_value, decision AS new_value FROM (SELECT *, {decision} AS decision FROM detection) AS x WHERE decision IS NOT NULL AND decision <> status"


@query
def upd_bulk_ids(d):
    return "SELECT x.detection_id, CASE WHEN x.status = 'pending' THEN 'accepted' ELSE x.status END AS status, (SELECT count(*) FROM detection AS y WHERE y.document_id IN (SELECT min(document_id) FROM document GROUP BY batch_id)) AS affected FROM detection AS x WHERE x.document_id IN (SELECT min(document_id) FROM document GROUP BY batch_id)"


@query
def doc_transitions(d):
    legal = values([("ready", "start", "in-review"), ("in-review", "finish", "reviewed"), ("reviewed", "sign", "signed-off"), ("reviewed", "changes", "in-review"), ("signed-off", "changes", "in-review")], "old, act, new_status", d)
    act = "CASE document_id % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'finish' WHEN 2 THEN 'sign' ELSE 'changes' END"
    return f"SELECT x.document_id, x.act, coalesce(t.new_status, x.status) AS status, t.old IS NULL AS illegal FROM (SELECT document_id, status, {act} AS act FROM document) AS x LEFT JOIN ({legal}) AS t ON t.old = x.status AND t.act = x.act"


@query
def batch_soft_delete(d):
    return f"SELECT batch_id, CASE WHEN batch_id % 5 = 0 AND status <> 'processing' AND deleted_at IS NULL THEN {d.ts(NOW)} WHEN batch_id % 5 = 1 AND purged_at IS NULL THEN NULL ELSE deleted_at END AS deleted_at, CASE WHEN batch_id % 5 = 0 AND status <> 'processing' AND deleted_at IS NULL THEN {d.days(d.ts(NOW), '7')} ELSE purge_at END AS purge_at FROM batch"


@query
def retention_due(d):
    return f"SELECT batch_id FROM batch WHERE deleted_at IS NOT NULL AND purge_at <= {d.ts(NOW)} AND purged_at IS NULL AND NOT claimed"


@query
def retention_auto(d):
    return f"SELECT batch_id, {d.ts(NOW)} AS deleted_at, {d.days(d.ts(NOW), '7')} AS purge_at FROM batch WHERE status = 'exported' AND deleted_at IS NULL AND updated_at < {d.days(d.ts(NOW), '-14')}"


@query
def purge_archive(d):
    return "SELECT c.document_id FROM document AS c WHERE NOT EXISTS (SELECT 1 FROM batch AS b WHERE b.batch_id = c.batch_id AND b.purged_at IS NOT NULL)"


@query
def counters(d):
    return f"SELECT batch_id, document_id, count(*) OVER (PARTITION BY batch_id ORDER BY document_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS documents, {n('sum(page_count) OVER (PARTITION BY batch_id ORDER BY document_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)')} AS pages FROM document"


@query
def export_gate(d):
    ok = "('reviewed', 'signed-off', 'auto-redacted', 'ready')"
    return f"SELECT batch_id, count(*) AS documents, {count_if(f'status NOT IN {ok}')} AS blocking, CASE WHEN {count_if(f'status NOT IN {ok}')} = 0 THEN 'open' ELSE 'blocked' END AS gate FROM document WHERE status <> 'excluded' GROUP BY batch_id"


@query
def tier_choice(d):
    return f"""SELECT document_id, CASE WHEN {count_if('pos_w > 0 AND pos_h > 0')} = count(*) THEN 'coordinates' WHEN {count_if('pos_w > 0 AND pos_h > 0')} > 0 THEN 'coordinates+search' WHEN max(length(text)) <= 80 THEN 'text-search' ELSE 'plain-text' END AS tier
        FROM detection WHERE status = 'accepted' GROUP BY document_id"""


@query
def metadata_leak(d):
    return "SELECT document_id, name <> '' OR assignee_id IS NOT NULL AS leaks, coalesce(CAST(assignee_id AS STRING), '') AS author FROM document"


@query
def export_manifest(d):
    body = d.joined("concat(name, ':', CAST(verified AS STRING))", ",", "document_id")
    return f"SELECT batch_id, count(*) AS documents, {count_if('verified')} AS ok, {d.sha256(body)} AS sha256 FROM document GROUP BY batch_id"


@query
def coverage_check(d):
    return "SELECT x.detection_id FROM detection AS x WHERE x.status <> 'rejected' AND NOT EXISTS (SELECT 1 FROM document AS c WHERE c.document_id = x.document_id AND c.page_count >= x.page)"


# --- logic of the review screens --------------------------------------------------------


@query
def ui_qa_inputs(d):
    return f"SELECT b.batch_id, {count_if(chr(39).join(['c.status = ', 'pending', '']))} AS pending, {count_if(f'c.status IN {DONE}')} AS processed, max(a.ts) AS last_verified FROM batch AS b JOIN document AS c ON c.batch_id = b.batch_id LEFT JOIN (SELECT batch_id, max(ts) AS ts FROM audit WHERE type = 'redaction-verification' GROUP BY batch_id) AS a ON a.batch_id = b.batch_id GROUP BY b.batch_id"


@query
def ui_qa_checklist(d):
    state = lambda bad, warn: f"CASE WHEN {bad} THEN 'fail' WHEN {warn} THEN 'warning' ELSE 'pass' END"
    x = f"""SELECT c.batch_id, count(*) AS docs, {count_if("c.status = 'error'")} AS errors, {count_if("c.status NOT IN ('reviewed', 'signed-off', 'auto-redacted')")} AS undone, {count_if('NOT c.verified')} AS unverified FROM document AS c WHERE c.status <> 'excluded' GROUP BY c.batch_id"""
    items = [("no-errors", state("errors > 0", "false")), ("all-reviewed", state("undone = docs", "undone > 0")), ("verified", state("unverified = docs", "unverified > 0")), ("non-empty", state("docs = 0", "docs < 3"))]
    return " UNION ALL ".join(f"SELECT batch_id, '{k}' AS item, {v} AS result FROM ({x}) AS x" for k, v in items)


@query
def ui_export_readiness(d):
    kind = "CASE WHEN status IN ('signed-off', 'auto-redacted') THEN 'exportable' WHEN status IN ('reviewed', 'in-review') THEN 'warning' ELSE 'blocked' END"
    return f"SELECT batch_id, {kind} AS readiness, count(*) AS documents, {n('sum(page_count)')} AS pages, {n('sum(size_bytes)')} AS bytes FROM document GROUP BY batch_id, {kind}"


@query
def ui_schedule_counts(d):
    return "SELECT type, count(*) AS k FROM detection WHERE status = 'accepted' GROUP BY type"


@query
def ui_review_tabs(d):
    personal = "type IN ('personal-name', 'phone', 'email-addr', 'ird', 'address', 'bank-account', 'nz-passport', 'nz-driver-licence', 'vehicle-reg', 'nhi')"
    return f"SELECT document_id, {count_if(personal)} AS personal, {count_if(chr(39).join(['type = ', 'commercial', '']))} AS commercial, {count_if(f'NOT ({personal})')} AS other FROM detection GROUP BY document_id"


@query
def ui_ingest_progress(d):
    done = count_if("status IN ('ready', 'auto-redacted')")
    return f"SELECT batch_id, {done} AS ready, {count_if(chr(39).join(['status = ', 'processing', '']))} AS processing, {count_if(chr(39).join(['status = ', 'queued', '']))} AS queued, {count_if(chr(39).join(['status = ', 'error', '']))} AS error, {share(done, 'count(*)')} AS percent FROM document GROUP BY batch_id"


@query
def ui_audit_csv(d):
    quote = lambda c: f"concat('\"', replace({c}, '\"', '\"\"'), '\"')"
    cells = [d.iso("ts"), "user_name", "user_role", "type", "target", "description", "CAST(batch_id AS STRING)"]
    return f"SELECT audit_id, concat_ws(',', {', '.join(map(quote, cells))}) AS line FROM audit"


@query
def ui_unique_users(d):
    return "SELECT count(DISTINCT user_name) AS users FROM audit"


@query
def queue_progress(d):
    step = "CASE status WHEN 'pending' THEN 0 WHEN 'queued' THEN 0 WHEN 'processing' THEN 2 WHEN 'error' THEN -1 ELSE 5 END"
    return f"SELECT document_id, {step} AS step, CASE WHEN {step} < 0 THEN 0 ELSE {step} * 20 END AS progress FROM document"


@query
def archive_key_group(d):
    key = "concat('archives/', CAST(2020 + batch_id % 5 AS STRING), '/', CAST(batch_id AS STRING), '/part-', CAST(document_id AS STRING), '.jsonl')"
    folder = d.rx_extract("k", r"^(archives/[0-9]+/[0-9]+)/", 1)
    return f"SELECT folder, {d.glue(d.listed('k', 'k'), ';')} AS keys FROM (SELECT k, {folder} AS folder FROM (SELECT {key} AS k FROM document) AS a) AS b GROUP BY folder"


@query
def bench_delta(d):
    both = values([("B1", 0.615, 0.565), ("B2", 0.6, 0.5499), ("B3", 0.4, 0.7)], "fixture, old_f1, new_f1", d)
    return f"SELECT fixture, CAST(new_f1 - old_f1 AS DOUBLE) AS delta, old_f1 - new_f1 > 0.05 AS regression FROM ({both}) AS v"


@query
def bench_compare(d):
    old, new = values([("B1", 0.615), ("B2", 0.52), ("B4", 0.3)], "fixture, f1", d), values([("B1", 0.49), ("B2", 0.55), ("B3", 0.7)], "fixture, f1", d)
    return f"SELECT coalesce(o.fixture, w.fixture) AS fixture, CASE WHEN w.fixture IS NULL THEN true WHEN o.fixture IS NULL THEN false ELSE o.f1 - w.f1 > 0.12 END AS regression FROM ({old}) AS o FULL OUTER JOIN ({new}) AS w ON o.fixture = w.fixture"


@query
def daily_tumbling(d):
    return "SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS actions FROM audit WHERE user_id IS NOT NULL GROUP BY CAST(ts AS DATE), user_id"


@query
def rolling_24h(d):
    return f"SELECT {n('coalesce(sum(page_count), 0)')} AS pages, CAST(floor(coalesce(sum(page_count), 0) / 24e0 + 0.5e0) AS BIGINT) AS per_hour FROM document WHERE completed_at >= {d.days(d.ts('1998-07-01 00:00:00'), '-1')} AND completed_at < {d.ts('1998-07-01 00:00:00')}"


@query
def retry_backoff(d):
    return "SELECT event_id, event_id % 6 AS attempt, least(30000, 500 * CAST(power(2, event_id % 6) AS BIGINT)) AS low_ms, least(30000, 500 * CAST(power(2, event_id % 6) AS BIGINT)) + 250 AS high_ms, event_type IN ('error', 'view') AS transient FROM events"


# --- corrected variants: the literal forms above keep known slips of the original logic ----------------


@query
def agg_qa_simulation_fixed(d):
    """Low confidence on the 0 to 100 scale that confidences have."""
    return f"SELECT document_id, {count_if("status = 'accepted' AND confidence < 60")} AS low_confidence FROM detection GROUP BY document_id"


@query
def agg_workload_fixed(d):
    """Review entries count too, also those without a user."""
    return f"SELECT coalesce(user_id, -1) AS user_id, count(*) AS actions FROM audit WHERE type IN ('detection-accepted', 'detection-rejected', 'detection-update', 'review-submitted', 'review') GROUP BY coalesce(user_id, -1)"


@query
def upd_similar_fixed(d):
    """The tray's own key: type, and text with collapsed white space."""
    norm = d.rx_replace("lower(trim(text))", r"\s+", " ")
    return f"SELECT detection_id, CASE WHEN status = 'pending' AND type = 'phone' AND {norm} = 'term 1' THEN 'accepted' ELSE status END AS status FROM detection"
