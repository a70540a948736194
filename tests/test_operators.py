"""Cases of single operators, and properties."""

import hashlib
import random
import struct
import sys

from quillgate.operators import dedup, detection, geometry, sequential, structure
from quillgate.plans import textual
from quillgate.plans.dialect import DUCK, SPARK
from quillgate.plans.textual import verify_chain
from quillgate.sources import files
from quillgate.sources.model import values


def detect(spark, *texts):
    pages = values([(i, 1, t) for i, t in enumerate(texts)], "doc_id, page, text", SPARK)
    rows = spark.sql(f"WITH p AS ({pages}) {detection.detect_patterns(SPARK, 'p')}").collect()
    return [sorted((r.type, r.text) for r in rows if r.doc_id == i) for i in range(len(texts))]


def test_patterns(spark):
    got = detect(spark, "call 021 544 908 now", "IRD 12-345-678", "(06) 759 2217", "12-3056-0789123-00", "Driver licence AB123456", "passport AB123456", "ABC1234 seen", "XYZ123", "12 Karaka Street", "a@b.co.nz", "")
    assert [[t for t, _ in g] for g in got] == [["phone"], ["ird"], ["phone"], ["bank-account"], ["nz-driver-licence"], ["nz-passport"], ["nhi"], ["vehicle-reg"], ["address"], ["email-addr"], []]


def test_claims_never_overlap(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("0123456789-- +()ABab@.") for _ in range(120)) for _ in range(60)]
    pages = values([(i, 1, t) for i, t in enumerate(texts)], "doc_id, page, text", SPARK)
    rows = spark.sql(f"WITH p AS ({pages}) {detection.detect_patterns(SPARK, 'p')}").collect()
    spans = sorted((r.doc_id, r.start, r.start + len(r.text)) for r in rows)
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    assert all(texts[r.doc_id][r.start :].lstrip().startswith(r.text) for r in rows)


def test_labels(spark):
    texts = ["Date of birth: 14 June 1983", "DOB | 3 November 1978", "Staff ID | EMP-2019-0847", "Salary: the usual", "GP-12 grid", "GP: Dr Liang", "my address is 5", "Email:\nPhone number"]
    pages = values([(i, 1, t) for i, t in enumerate(texts)], "doc_id, page, text", SPARK)
    rows = spark.sql(f"WITH p AS ({pages}) {detection.detect_labels(SPARK, 'p')}").collect()
    assert {r.doc_id: (r.type, r.text) for r in rows} == {0: ("personal-name", "14 June 1983"), 1: ("personal-name", "3 November 1978"), 2: ("sensitive-context", "EMP-2019-0847"), 5: ("personal-name", "Dr Liang")}


ODD = [
    "ring 021 544 9081 2345 now", "0443-6757-", "-.jane@b.nz wrote", "+-jane@b.nz", "64 KARAKA \u017ft", "9 Rata Cre\u017f x", "12 Rata Cre\u017fx", "DL\x0bAB123456", "12\x0b3456 0789123 00", "licen\u017fe AB123456",
    "\u0130 karaka, rata", "secret=a\x0bb", "\u017fecret = x", "LICEN\u017fE license", "to\u212aen=x", "Email: jane\u2028", "Tel:\x0b12345", "IRD: the\u0085", "secret= \u2028", "token= \u0130\u03a3 x \u03a3", "phone: \u03a3\u0391\u03a3", None, "", " ",
]


def sql_and_spark(spark, build):
    import duckdb

    pages = lambda d: values([(i, 1, t) for i, t in enumerate(ODD)], "doc_id, page, text", d)
    got = spark.sql(f"WITH page_text AS ({pages(SPARK)}) {build(SPARK)}")
    want = duckdb.sql(f"WITH page_text AS ({pages(DUCK)}) {build(DUCK)}")
    assert sorted(got.columns) == sorted(want.columns)
    return sorted(map(repr, map(tuple, got.select(want.columns).collect()))), sorted(map(repr, want.fetchall()))


def test_patterns_of_odd_texts_equal_sql(spark):
    got, want = sql_and_spark(spark, textual.detect_patterns)
    assert got == want and len(got) > 5
    got, want = sql_and_spark(spark, textual.win_pattern_claim)
    assert got == want


def test_patterns_of_long_texts_equal_sql(spark, monkeypatch):
    """Runs that a repeated group of Java's, by recursion, cannot follow, and words too short to stand in a street's name."""
    long = ["12" + " Karaka" * 20_000 + " Street", "12 " + "Karaka Street " * 3_000 + "x 5 Rata Ab Lane", "7 Rata St Rd, 8  Abc \t Def Ghij Ab Lane, 9 Rata Ab\tStreet 4 Ab Rata Way 6 Rata Hill Way End Rd", "021" + " " * 5_000 + "544 908", " \n" * 3_000]
    monkeypatch.setattr(sys.modules[__name__], "ODD", long)
    for build in (textual.detect_patterns, textual.win_pattern_claim):
        got, want = sql_and_spark(spark, build)
        assert got == want and got


def test_flagship_of_odd_texts_equals_sql(spark):
    for build in (textual.detect_labels, textual.detect_rules_exact, textual.detect_rules_fuzzy, textual.detect_rules_regex, textual.flagship):
        got, want = sql_and_spark(spark, build)
        assert got == want and got


def test_restated():
    assert detection.restated(r"(?i)a[^k-m]s\s$") == f"(?i)a[^k-m\u212a][s\u017f][{detection.BLANKS}]" + r"\z"
    assert detection.restated(r"[-\s]s.") == rf"[-{detection.BLANKS}]s[^\n]"


def test_similar_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcde ") for _ in range(160)) for _ in range(8)]
    texts = []
    for b in base:
        texts += [b, b[:100] + rng.choice("xyz") + b[101:], b[:40] + "qqqqqqqqqqqqqqqqqqqqqqqqqqqqqq" + b[70:]]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    sets = [{" ".join(t.split()).lower()[i : i + 3] for i in range(len(" ".join(t.split())) - 2)} for t in texts]
    want = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85 and sets[a] != sets[b]}
    got = {(r.a, r.b) for r in dedup.similar_pairs(docs).collect()}
    assert want <= got | {(a, b) for a, b in want if " ".join(texts[a].split()).lower() == " ".join(texts[b].split()).lower()}
    assert all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85 for a, b in got)


def test_similar_pairs_store_no_trigrams(spark, monkeypatch):
    """Texts with characters beyond the BMP, null sources and pairs at the threshold itself; only texts and candidates are written."""
    rng = random.Random(6)
    rows = []
    for _ in range(6):
        base = [rng.choice("abcdefgh \U0001f600\U0001f601\u00e9") for _ in range(200)]
        for _ in range(5):
            changed = list(base)
            for _ in range(rng.randrange(8)):
                changed[rng.randrange(200)] = rng.choice("xyz\U0001f602")
            rows.append(("".join(changed), rng.choice(["s", None])))
    line = "".join(chr(0x4E00 + i) for i in range(187))
    rows += [(line[:172], "line"), (line[15:187], "line"), (line[:171], "line"), (line[13:185], "line"), ("?" * 150, "line")]
    rows += [(line[:102], "edge"), (line[:119] + line[:1], "edge"), (line[:102] + "q", "edge"), (line[:87] + " ", "edge")]
    docs = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "doc_id bigint, text string, source string")
    flat = [" ".join(t.split()).lower() for t, _ in rows]
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in flat]
    ok = lambda a, b: rows[a][1] == rows[b][1] and len(rows[a][0]) >= 100 <= len(rows[b][0]) and flat[a] != flat[b]
    want = {(a, b): j for b in range(len(sets)) for a in range(b) if ok(a, b) and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.85}
    assert flat.index(line[:172]) == 30 and (30, 33) in want
    written, keep = [], dedup.materialise
    monkeypatch.setattr(dedup, "materialise", lambda df, label: written.append(label) or keep(df, label))
    assert {(r.a, r.b): r.jaccard for r in dedup.similar_pairs(docs).collect()} == want and len(want) >= 10
    assert written == ["reps", "near"]


def near_texts(rng, n, size):
    """Families of texts of ``size`` words of one made-up language, most of whose trigrams are shared by all."""
    lexicon = ["".join(rng.choice(["an", "er", "th", "in", "on", "re", "at"]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(lexicon) for _ in range(rng.randint(size, 2 * size))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            texts.append(" ".join(w if rng.random() < 0.97 else rng.choice(lexicon) for w in base))
    return texts[:n]


def alike_pairs(texts):
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    return {(a, b): j for b in range(len(sets)) for a in range(b) if (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.85 and texts[a] != texts[b]}


def test_similar_pairs_bring_few_texts(spark, monkeypatch):
    """Texts that share many trigrams without being alike are no candidates."""
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefghijkl ") for _ in range(1_600)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    rows, keep = {}, dedup.materialise

    def counted(df, label):
        out = keep(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(dedup, "materialise", counted)
    assert dedup.similar_pairs(docs).count() == 0 and rows["near"] < 60


def test_similar_pairs_in_small_blocks(spark, monkeypatch):
    """Blocks, pieces and families of a few texts give all pairs once; of each text the first match, through ``first_matches`` too."""
    for name, size in (("BLOCK", 4), ("PIECE", 2), ("FAMILY", 2)):
        monkeypatch.setattr(dedup, name, size)
    texts = [*{*near_texts(random.Random(8), 50, 40)}]
    texts.sort(key=lambda t: t[::-1])
    docs = spark.createDataFrame([(i, t, "s|1") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    want = alike_pairs(texts)
    got = [(r.a, r.b, r.jaccard) for r in dedup.similar_pairs(docs).collect()]
    assert sorted(got) == sorted((a, b, j) for (a, b), j in want.items()) and len(got) > 10
    firsts = {b: min(a for a, of in want if of == b) for _, b in want}
    assert {r.doc_id: r.match_id for r in dedup.first_matches(docs).collect() if r.kind == "near"} == firsts


def test_similar_pairs_move_little(spark, monkeypatch):
    """A family's pairs and texts are moved in few bytes, and a text that is like no other not at all."""
    rng = random.Random(9)
    base = [rng.choice("abcdefghijklm") for _ in range(2_000)]
    texts = ["".join(base[:i] + [rng.choice("xyz")] + base[i + 1 :]) for i in range(200)]
    texts += ["".join(rng.choice("abcdefghijklm") for _ in range(2_000)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    moved, keep = {}, dedup._brought

    def weighed(*args):
        out = keep(*args)
        moved.update({r.doc_id: len(r.t) for r in out.collect()}, pairs=sum(len(o) for r in out.collect() for o in r.others))
        return out

    monkeypatch.setattr(dedup, "_brought", weighed)
    monkeypatch.setattr(dedup, "CELLS", 5_000)  # a matrix in several parts
    got = {(r.a, r.b): r.jaccard for r in dedup.similar_pairs(docs).collect()}
    pairs = moved.pop("pairs")
    assert {*moved} == {*range(200)} and max(moved.values()) < 1_600 and pairs < 2 * len(got)
    assert got == alike_pairs(texts) and len(got) == 200 * 199 // 2


def words(*texts):
    return [{"text": t, "polygon": [i * 60, 10, i * 60 + 50, 10, i * 60 + 50, 22, i * 60, 22]} for i, t in enumerate(texts)]


def test_locate_within_pages(spark):
    """Plain pages by the joined text, others word by word; as ``locate`` finds them, with keys that repeat or are null."""
    rng = random.Random(4)
    key = [(1, 1), (1, 1), (None, 2), (2, None), *((i, 1) for i in range(3, 40))]
    pages = [(d, p, 600.0, 800.0, words(*(rng.choice(["a", "b", "A b", "c\u00a0", "", "ab"] if i % 2 else ["a", "b", "ba", "\u0130"]) for _ in range(rng.randrange(120))))) for i, (d, p) in enumerate(key)]
    for word in (w for *_, ws in pages for w in ws):
        word["polygon"] = [float(v) for v in word["polygon"]]
    wanted = [(d, p, " ".join(rng.choice(["a", "b", "A", "ba"]) for _ in range(rng.randint(1, 3)))) for d, p in {*key} for _ in range(2)]
    layouts = spark.createDataFrame(pages, "doc_id bigint, page int, width double, height double, words array<struct<text:string,polygon:array<double>>>")
    got = geometry.locate_all(spark.createDataFrame(wanted, "doc_id bigint, page int, text string"), layouts)
    assert "CoGroups" not in got._jdf.queryExecution().toString()  # a Python call per page
    want = [(d, p, t, i + 1, *box) for d, p, w, h, ws in pages for d2, p2, t in wanted if (d, p) == (d2, p2) for i, box in enumerate(geometry.locate(t, ws, w, h))]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 50


def test_windows_of_plain_texts_equal_a_scan():
    rng = random.Random(2)
    for _ in range(2000):
        low = " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 70)))
        target = " ".join("".join(rng.choice("ab") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 3)))
        assert geometry._windows(target, low) == geometry._scanned(target, [{"text": w} for w in low.split(" ")])


def test_bbox_queries_move_texts_once(spark, tmp_path):
    """Turns that share a key or have none, odd blanks and texts that repeat: as ``locate`` finds them in whole layouts, with one shuffle by key."""
    import re

    from quillgate.plans.programs import QUERIES

    rng = random.Random(12)
    turns = [(k if k % 7 else None, rng.randrange(2), "user", rng.choice(["", " ", "\n"]) + rng.choice([" ", "  ", "\t\n"]).join(rng.choice(["a", "b", "A", "ba", "\u0130", *(["c\u00a0d", "\u2003", "x" * 30] if k % 3 == 0 else [])]) for _ in range(rng.randrange(60)))) for k in range(60) for _ in range(2)]
    turns += [(99, 0, "user", None), (99, 0, "user", "p q r s t p q r s t u v w x y z p"), (100, None, "user", "one two three four five six")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    pages = [(c, None if t is None else t + 1, [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]) for c, t, _, text in turns if text is not None]
    shape = lambda i: [float(v) for v in ((i % 10) * 60, i // 10 * 20, (i % 10) * 60 + 50, i // 10 * 20, (i % 10) * 60 + 50, i // 10 * 20 + 12, (i % 10) * 60, i // 10 * 20 + 12)]
    for name, first, n in (("bbox_locate", 3, 3), ("bbox_lines", 9, 4)):
        want = []
        for doc, page, ws in pages:
            texts = [" ".join(w[first - 1 : first - 1 + n]) for d, p, w in pages if (d, p) == (doc, page) and len(w) >= first + n - 1]
            for text in texts:
                boxes = geometry.locate(text, [{"text": w, "polygon": shape(i)} for i, w in enumerate(ws)], 600.0, 800.0)
                want += [(doc, page, text, i + 1, *box) for i, box in enumerate(boxes)]
        got = QUERIES[name](spark, str(tmp_path))
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want)) and len(want) > 60


def test_windows_and_boxes_of_words_without_polygons(spark):
    """A text of one word whose windows have no boxes is looked for word by word, as ``locate`` does."""
    rng = random.Random(13)
    shape = lambda i: rng.choice([None, [float(i)], [i * 60.0, 10.0, i * 60.0 + 50, 10.0, i * 60.0 + 50, 22.0, i * 60.0, 22.0]])
    pages = [(k, [{"text": w, "polygon": shape(i)} for i, w in enumerate(rng.choice(["a", "b", "ab", "", "a b"] if k % 2 else ["a", "b", "ab"]) for _ in range(rng.randrange(9)))], rng.choice(["a", "b", "a b", "ab", " "])) for k in range(80)]
    found = geometry.windows_within(spark.createDataFrame([(k, 1, [w["text"] for w in ws], [t]) for k, ws, t in pages], "doc_id bigint, page int, words array<string>, texts array<string>")).collect()
    rows = [(r.doc_id, 1, r.text, None, None, [[pages[r.doc_id][1][i]["polygon"] for i in range(s.first, s.last + 1)] for s in r.spans], [pages[r.doc_id][1][i]["polygon"] for i in r.alone]) for r in found]
    kind = "doc_id bigint, page int, text string, width double, height double, spans array<array<array<double>>>, alone array<array<double>>"
    got = {(r.doc_id, r.n): tuple(r)[4:] for r in geometry.boxes_within(spark.createDataFrame(rows, kind)).collect()}
    assert got == {(k, i + 1): box for k, ws, t in pages for i, box in enumerate(geometry.locate(t, ws))} and len(got) > 20


def test_locate():
    assert geometry.locate("john smith", words("Mr", "John", "Smith", "left", "John", "Smith")) == [(60, 10, 110, 12), (240, 10, 110, 12)]
    assert geometry.locate("x" * 81, words("x" * 81)) == []
    assert len(geometry.locate("x" * 81, words("x" * 81), long_ok=True)) == 1
    assert geometry.locate("absent", words("a")) == [] and geometry.locate("a", []) == []


def test_merge_boxes_against_all_pairs():
    rng = random.Random(1)
    for _ in range(40):
        boxes = [(rng.randint(0, 9), rng.randint(0, 9), rng.randint(1, 6), rng.randint(1, 6)) for _ in range(14)]
        parent = list(range(len(boxes)))

        def root(i, parent=parent):
            return i if parent[i] == i else root(parent[i])

        for i in range(len(boxes)):
            for j in range(i):
                if geometry.alike(boxes[i], boxes[j]):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        assert len(geometry.merge_boxes(boxes)) == len({root(i) for i in range(len(boxes))})
    assert geometry.merge_boxes([(1, 10, 20, 5), (1, 10, 20, 5)]) == [(1, 10, 20, 5)]


def test_segments_rejoin():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aAbB c ") for _ in range(30))
        marks = [(i, "".join(rng.choice("ab c") for _ in range(rng.randint(1, 3)))) for i in range(4)]
        assert "".join(p for p, _ in structure.segments(text, marks)) == text
    assert structure.segments("", []) == [("", None)]


def test_html_blocks():
    html = "<html><head><title>x</title><script>var a</script></head><h2>Top</h2>between<p>One &amp; two</p><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table><img alt='pic'></html>"
    assert structure.html_blocks(html) == [("heading", "Top", 2), ("paragraph", "between", 0), ("paragraph", "One & two", 0), ("list", "a\nb", 0), ("table", "1\t2", 0), ("image", "pic", 0)]
    assert structure.html_blocks(None) == []


def test_files_round_trip():
    assert files.docx_pages(files.make_docx(["a & b", "<c>"])) == [(1, "a & b\n\n<c>")]
    assert files.xlsx_pages(files.make_xlsx({"S": [["k", "v,1"], ["", ""], ["2", 'q"x']]})) == [(1, '[Sheet: S]\nk,"v,1"\n2,"q""x"')]
    assert b"docProps" not in files.without_properties(files.make_docx(["x"], "me"))
    pages, attached = files.eml_parts(b"From: a@b.c\nTo: d@e.f\nSubject: hi\n\nbody text\n")
    assert pages == [(1, "[Email Headers]\nFrom: a@b.c\nTo: d@e.f\nSubject: hi"), (2, "body text")] and not attached
    assert files.mail_pages({"From": "x"}, "", "<p>a</p><br>b")[1][1] == "a\n\n\nb".replace("\n\n\n", "\n\n") and files.mail_pages({}, "", "")[1][1] == "(No message body)"


def test_unknown_and_broken_files_are_reported(spark):
    rows = [(1, "PST", b"x"), (2, "DOCX", b"no zip"), (3, "MSG", b"no ole"), (4, "TXT", b"hi")]
    got = {r.file_id: (r.text, r.error is not None) for r in files.extract_pages(spark.createDataFrame(rows, "file_id bigint, file_type string, content binary")).collect()}
    assert got == {1: (None, True), 2: (None, True), 3: (None, True), 4: ("hi", False)}


def test_message_with_more_fat_sectors_than_the_header_lists():
    body = b"".join(b"line %07d\r\n" % i for i in range(520_000))  # 7.3 MB in sectors of 512 bytes
    held = -(-len(body) // 512)
    fats = next(f for f in range(1, 999) if f * 128 >= f + 2 + held)
    assert fats > 109
    end, first = 0xFFFFFFFE, fats + 2
    table = [0xFFFFFFFD] * fats + [0xFFFFFFFC, end] + [*range(first + 1, first + held), end]
    table += [0xFFFFFFFF] * (fats * 128 - len(table))
    entry = lambda name, kind, child, start, size: struct.pack("<64sHBBIII36xIQ", (name + "\0").encode("utf-16-le"), 2 * len(name) + 2, kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child, start, size)
    head = bytes.fromhex("D0CF11E0A1B11AE1") + struct.pack("<16xHHHHH6xIIIIIIIII", 62, 3, 0xFFFE, 9, 6, 0, fats, fats + 1, 0, 4096, end, 0, fats, 1)
    head += struct.pack("<109I", *range(109))
    difat = struct.pack("<128I", *range(109, fats), *[0xFFFFFFFF] * (127 - (fats - 109)), end)
    listing = entry("Root Entry", 5, 1, end, 0) + entry("__substg1.0_1000001E", 2, 0xFFFFFFFF, first, len(body)) + bytes(256)
    data = head + struct.pack(f"<{len(table)}I", *table) + difat + listing + body + bytes(-len(body) % 512)
    assert files.msg_pages(data)[1] == (2, body.decode())


def test_sequential_operators_against_plain_loops(spark):
    rng = random.Random(7)
    events = [(rng.choice([1, 2, 3, None]), rng.randint(0, 400), i, rng.random() < 0.5) for i in range(600)]
    order = sorted(events, key=lambda e: (e[1], e[2]))
    frame = spark.createDataFrame(events, "user_id bigint, at bigint, event_id bigint, failed boolean")
    logs, allowed, circuits, calls = {}, {}, {}, {}
    for user, at, event, failed in order:
        log = logs.setdefault(user, [])
        allowed[event] = sum(at - t < 50 for t in log) < 3
        if allowed[event]:
            log.append(at)
        state = circuits.setdefault(user, {"state": "closed", "failures": 0, "opened": None})
        if state["state"] == "open":
            if at - state["opened"] < 30:
                calls[event] = (f"{event}:refused", "open")
                continue
            state["state"] = "half-open"
        if failed:
            state["failures"] += 1
            if state["state"] == "half-open" or state["failures"] >= 2:
                state |= {"state": "open", "opened": at}
        else:
            state |= {"state": "closed", "failures": 0}
        calls[event] = (f"{event}:{'failed' if failed else 'ok'}", state["state"])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # keys that span batches
    try:
        assert {r.event_id: r.allowed for r in sequential.rate_limited(frame.drop("failed"), 3, 50).collect()} == allowed
        assert {int(r.call.split(":")[0]): (r.call, r.state) for r in sequential.broken_circuits(frame, 2, 30).collect()} == calls
        entries = frame.selectExpr("user_id", "at", "event_id", "concat('body ', event_id) AS body")
        hashes = {(r.batch_id, r.audit_id): (r.previous_hash, r.integrity_hash) for r in sequential.chained(entries).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    last = {}
    for user, _, event, _ in order:
        own = hashlib.sha256(f"{last.get(user) or ''}|body {event}".encode()).hexdigest()
        assert hashes[user, event] == (last.get(user), own)
        last[user] = own


def verified(spark, entries):
    rows = [(1, i, f"2024-01-01 00:00:0{i}", *e) for i, e in enumerate(entries)]
    frame = spark.createDataFrame(rows, "batch_id bigint, audit_id bigint, at string, user_id bigint, type string, description string, target string, previous_hash string, integrity_hash string")
    frame = frame.selectExpr("*", "CAST(at AS TIMESTAMP_NTZ) AS ts").drop("at")
    return spark.sql(verify_chain(SPARK, "SELECT * FROM {rows}"), rows=frame).first().broken_at


def entry_chain(count):
    out, before = [], None
    for i in range(count):
        body = f"2024-01-01T00:00:0{i}.000Z|5|login|did {i}|file|1"
        own = hashlib.sha256(f"{before or ''}|{body}".encode()).hexdigest()
        out.append([5, "login", f"did {i}", "file", before, own])
        before = own
    return out


def test_audit_chain_verification(spark):
    assert verified(spark, entry_chain(5)) is None
    changed = entry_chain(5)
    changed[2][2] = "did something else"
    assert verified(spark, changed) == 2
    rewritten = entry_chain(5)  # a text altered together with its own hash and the next entry's link
    body = "2024-01-01T00:00:02.000Z|5|login|rewritten|file|1"
    rewritten[2][2], rewritten[2][5] = "rewritten", hashlib.sha256(f"{rewritten[1][5]}|{body}".encode()).hexdigest()
    assert verified(spark, rewritten) == 3
    rewritten[3][4] = rewritten[2][5]
    assert verified(spark, rewritten) == 3
    unlinked = entry_chain(5)
    unlinked[4][4] = "0" * 64
    assert verified(spark, unlinked) == 4
    legacy = entry_chain(5)
    legacy[1][5] = None
    assert verified(spark, legacy) is None


def test_lines_lose_the_first_occurrence_of_every_term(spark):
    spark.createDataFrame([(1, "the der que 555 the\nquery\n" + "x" * 250 + " 555 555")], "doc_id int, text string").createOrReplaceTempView("documents")
    got = spark.sql(textual.redact_text(SPARK)).first().text
    assert got == "[REDACTED] [REDACTED] [REDACTED] [REDACTED] the\n[REDACTED]ry\n" + "x" * 250 + " [REDACTED] 555"


def test_whole_phrases_are_found_anywhere(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(3))
    phrases = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 6, 7, 8, 12])))) for i in range(12)] + [(20, "ab"), (21, None)]
    docs = []
    for i in range(80):
        text = " ".join(word() for _ in range(30))
        if i % 2:
            text = text[:40] + rng.choice(phrases[:12])[1].upper() + text[40:]
        docs.append((i, text))
    spark.createDataFrame(phrases, "item_id int, text string").createOrReplaceTempView("benchmark")
    spark.createDataFrame([*docs, (99, None), (100, "")], "doc_id int, text string").createOrReplaceTempView("documents")
    got = sorted((r.item_id, r.doc_id) for r in spark.sql(textual.phrase_hits(SPARK)).collect())
    assert got == sorted((i, j) for i, p in phrases if p and len(p) >= 3 for j, t in docs if p.lower() in t.lower()) and got
