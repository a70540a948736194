"""The engine's data model, bound to the star-schema tables.

batch <- customer, document <- orders, detection <- lineitem, audit <- events,
usr <- supplier, page <- documents and conversations, review <- labels. Small
inline relations hold cases that the tables lack.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgate.plans.dialect import SPARK, Dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Detection types in fixed order.
TYPES = ("personal-name", "phone", "email-addr", "ird", "address", "bank-account", "nz-passport", "nz-driver-licence", "vehicle-reg", "nhi", "sensitive-context", "manual")
SOURCES = ("pattern", "ai", "custom-rule", "label-adjacent", "entity-propagation", "manual")
DOCUMENT_STATES = ("pending", "queued", "processing", "ready", "in-review", "reviewed", "signed-off", "auto-redacted", "excluded", "error")
BATCH_STATES = ("draft", "ingesting", "processing", "ready-for-review", "reviewed", "auto-redacted", "exported", "error")
AUDIT_TYPES = (
    "document-uploaded", "processing-started", "processing-complete", "processing-error", "detection-accepted", "detection-rejected", "detection-update",
    "review-submitted", "sign-off", "export-generated", "redaction-verification", "document-assigned", "login", "review",
)


def choose(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def values(rows: list[tuple], names: str, d: Dialect) -> str:
    """An inline relation."""

    def cell(x) -> str:
        if x is None:
            return "NULL"
        return d.lit(x) if isinstance(x, str) else repr(x)

    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS v({names})"


#: Texts with cases the document table lacks: (doc_id, page, text).
CASES = [
    (-1, 1, "IRD 12-345-678 and 123-456-789, cell 021 544 908."), (-2, 1, "Ring (06) 759 2217 or +64 21 555 1234; account 12-3056-0789123-00."),
    (-3, 1, "Mail jane.doe@council.govt.nz and NHI ABC1234, plate XYZ123."), (-4, 1, "Lives at 12 Karaka Street or 7 Te Rapa Road."),
    (-5, 1, "Driver licence AB123456 was shown."), (-6, 1, "Passport AB123456 was shown."), (-7, 1, "Code LM345678 in text."),
    (-8, 1, "Date of birth: 14 June 1983\nPhone | 06 759 2217\nSalary: the usual\nAddress\n12 Rata Lane"), (-9, 1, "DOB | 3 November 1978\nStaff ID | EMP-2019-0847\nEmail:\nPhone number"),
    (-10, 1, "GP: Dr Sarah Liang\nGP-12 grid reference\nICD-10: F43.23 noted\nICD-10: see below"), (-11, 1, "Employee number - ADC-2284\nTax number: 98-765-432"),
    (-12, 1, "1. INTRODUCTION\nThis is the first part.\n\nSUMMARY OF FACTS\nSome facts follow.\n\n[Email Headers]\nFrom: a@b.nz\n\nPlain paragraph here."),
    (-13, 1, "Ms Melissa Ferguson spoke. Later Ms Ferguson left."), (-13, 2, "Ferguson wrote again. Dr Ferguson agreed. Young people met Mr Young."), (-13, 3, "Nothing here."),
    (-14, 1, ""), (-15, 1, "aaa aaa AAA"),
]

RULES = [
    ("r1", "Licence lines", "custom-keyword", "Exact", "license, copyright", "Active", "Critical", 4), ("r2", "Secrets", "custom-pattern", "Regex", "(secret|token) ?= ?\\S+", "Active", "High", 0),
    ("r3", "Fuzzy karaka", "custom-keyword", "Fuzzy", "karaka, rata", "Active", "Low", 2), ("r4", "Broken", "custom-pattern", "Regex", "([a-z", "Active", "Medium", 1),
    ("r5", "Off", "custom-entity", "Exact", "ferguson", "Draft", "Other", 9), ("r6", "Mail", "custom-entity", "Exact", "jane", "Active", None, None),
]


def _views(d: Dialect) -> dict[str, str]:
    return {
        "usr": f"SELECT s_suppkey AS user_id, s_name AS name, {choose('s_nationkey % 3', ('reviewer', 'admin', 'auditor'))} AS role, s_acctbal > 0 AS is_active FROM supplier",
        "batch": f"""SELECT c_custkey AS batch_id, concat('RB-', CAST(2020 + c_custkey % 5 AS STRING), '-', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')) AS reference,
            c_name AS name, {choose('c_custkey % 8', BATCH_STATES)} AS status, c_nationkey AS owner_id,
            CASE WHEN c_custkey % 11 = 0 THEN {d.ts('2024-02-01 00:00:00')} END AS deleted_at,
            CASE WHEN c_custkey % 11 = 0 THEN {d.days(d.ts('2024-02-01 00:00:00'), 'CAST(c_custkey % 15 AS INT)')} END AS purge_at,
            CASE WHEN c_custkey % 33 = 0 THEN {d.ts('2024-02-20 00:00:00')} END AS purged_at, c_custkey % 22 = 11 AS claimed,
            {d.days(d.ts('2024-01-01 00:00:00'), 'CAST(c_custkey % 60 AS INT)')} AS updated_at,
            CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 3 = 1 END AS require_confirmation FROM customer""",
        "document": f"""SELECT o_orderkey AS document_id, o_custkey AS batch_id, concat('file-', CAST(o_orderkey AS STRING), {choose('o_orderkey % 4', ('.pdf', '.docx', '.eml', '.tar'))}) AS name,
            {choose('o_orderkey % 10', DOCUMENT_STATES)} AS status, CAST(1 + o_orderkey % 30 AS INT) AS page_count, CAST(floor(o_totalprice * 10) AS BIGINT) AS size_bytes,
            CASE WHEN o_orderkey % 10 > 2 THEN CAST(o_orderkey % 5000 AS INT) END AS extraction_ms, CASE WHEN o_orderkey % 10 > 2 THEN CAST(o_orderkey % 700 AS INT) END AS pattern_ms,
            CASE WHEN o_orderkey % 10 > 3 THEN CAST(o_orderkey % 9000 AS INT) END AS ai_ms, CASE WHEN o_orderkey % 10 > 2 THEN CAST(o_orderkey % 15000 AS INT) END AS total_ms,
            CASE WHEN o_orderkey % 10 > 2 THEN o_orderdate END AS completed_at, o_orderdate AS created_at,
            CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 13 + 1 END AS assignee_id, o_orderkey % 9 = 0 AS verified FROM orders""",
        "detection": f"""SELECT l_orderkey * 10 + l_linenumber AS detection_id, l_orderkey AS document_id, l_linenumber AS page, l_linenumber AS seq, {choose('l_partkey % 12', TYPES)} AS type,
            CASE l_suppkey % 3 WHEN 0 THEN concat('Term ', CAST(l_partkey % 40 AS STRING)) WHEN 1 THEN concat('term  ', CAST(l_partkey % 40 AS STRING)) ELSE concat(' TERM ', CAST(l_partkey % 40 AS STRING)) END AS text,
            l_quantity * 2 AS confidence, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'R' THEN 'rejected' ELSE 'pending' END AS status, {choose('l_suppkey % 6', SOURCES)} AS source,
            l_discount * 100 AS pos_x, l_tax * 100 AS pos_y, CASE WHEN l_linenumber % 4 = 0 THEN 0e0 ELSE l_quantity END AS pos_w, CASE WHEN l_linenumber % 4 = 0 THEN 0e0 ELSE 2e0 END AS pos_h,
            l_shipdate AS created_at FROM lineitem""",
        "audit": f"""SELECT event_id AS audit_id, ts, CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id, concat('user-', CAST(user_id AS STRING)) AS user_name,
            {choose('user_id % 3', ('reviewer', 'admin', 'auditor'))} AS user_role, {choose('event_id % 14', AUDIT_TYPES)} AS type, user_id % 7 AS batch_id,
            concat('file-', CAST(event_id % 50 + 1 AS STRING), '.pdf') AS target,
            CASE event_id % 4 WHEN 0 THEN concat(event_type, ' of FILE-', CAST(event_id % 9 + 1 AS STRING), '.PDF') WHEN 1 THEN concat('Said "', event_type, '", twice') ELSE event_type END AS description FROM events""",
        "page_text": f"SELECT doc_id, 1 AS page, text FROM documents UNION ALL {values(CASES, 'doc_id, page, text', d)}",
        "case_text": values(CASES, "doc_id, page, text", d),
        "thread_page": "SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, text, role FROM conversations",
        "review": "SELECT doc_id, quality = 1 AS accepted, toxic FROM labels",
        "rule": values(RULES, "rule_id, name, type, match_mode, keywords, status, priority, match_count", d),
        "type_list": values([(t, i) for i, t in enumerate(TYPES)], "type, type_rank", d),
    }


def compose(query: str, d: Dialect) -> str:
    """``query`` with the model views that it uses in front."""
    views = _views(d)
    used: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in used and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                used.append(name)

    visit(query)
    if not used:
        return query
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in used) + f"\nSELECT * FROM (\n{query}\n) AS q"


#: Text tables, whose rows cost far more to work on than to move.
TEXT_TABLES = ("documents", "pages", "conversations")
#: Up to this many bytes of files a text table is dealt to all cores; a larger one has enough splits of its own and is never shuffled for that.
SPREAD_BYTES = 256 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small text table (one file, often one row group, is one task) is spread over the cores."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXT_TABLES and int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SPREAD_BYTES:
        return table.repartition(spark.sparkContext.defaultParallelism)
    return table


def register(spark: SparkSession, sf_dir: str, text: str) -> None:
    """Temporary views over the tables that ``text`` names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", text):
            read_table(spark, sf_dir, name).createOrReplaceTempView(name)


def run_sql(spark: SparkSession, sf_dir: str, build: Callable[[Dialect], str]) -> DataFrame:
    text = compose(build(SPARK), SPARK)
    register(spark, sf_dir, text)
    return spark.sql(text)
