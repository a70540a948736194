"""One query text, two engines: the few places where Spark SQL and the oracle's SQL differ."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    spark: bool

    def lit(self, text: str) -> str:
        """A string literal, backslashes taken as they are."""
        quoted = text.replace("'", "''")
        if not self.spark:
            return f"'{quoted}'"
        return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"' if ("'" in text or "\\" in text or "\n" in text) else f"'{text}'"

    def ts(self, text: str) -> str:
        return f"CAST('{text}' AS TIMESTAMP_NTZ)" if self.spark else f"CAST('{text}' AS TIMESTAMP)"

    def iso(self, ts: str) -> str:
        return f"date_format({ts}, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")" if self.spark else f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ')"

    def days(self, ts: str, n: str) -> str:
        return f"({ts} + make_dt_interval({n}))" if self.spark else f"({ts} + to_days(CAST({n} AS INTEGER)))"

    def epoch(self, ts: str) -> str:
        """Whole seconds since 1970."""
        return f"unix_seconds(CAST({ts} AS TIMESTAMP))" if self.spark else f"CAST(floor(epoch({ts})) AS BIGINT)"

    def weekday(self, day: str) -> str:
        """1 Sunday to 7 Saturday."""
        return f"dayofweek({day})" if self.spark else f"(dayofweek({day}) + 1)"

    def rx(self, text: str, pattern: str) -> str:
        return f"({text} RLIKE {self.lit(pattern)})" if self.spark else f"regexp_matches({text}, {self.lit(pattern)})"

    def rx_replace(self, text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {self.lit(pattern)}, {self.lit(by)})" if self.spark else f"regexp_replace({text}, {self.lit(pattern)}, {self.lit(by)}, 'g')"

    def rx_extract(self, text: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({text}, {self.lit(pattern)}, {group})"

    def rx_split(self, text: str, pattern: str) -> str:
        return f"split({text}, {self.lit(pattern)})" if self.spark else f"string_split_regex({text}, {self.lit(pattern)})"

    def rx_all(self, text: str, pattern: str) -> str:
        return f"regexp_extract_all({text}, {self.lit(pattern)}, 0)" if self.spark else f"regexp_extract_all({text}, {self.lit(pattern)})"

    def trim(self, text: str) -> str:
        """Without surrounding ASCII white space."""
        blanks = r"[ \t\n\x0b\f\r]"  # Java's $ also stands before a last line end, and it would try every blank of a long run as the first
        return self.rx_replace(text, rf"^{blanks}+|(?<!{blanks}){blanks}+\z" if self.spark else rf"^{blanks}+|{blanks}+$", "")

    def sha256(self, text: str) -> str:
        return f"sha2({text}, 256)" if self.spark else f"sha256({text})"

    def contains(self, text: str, part: str) -> str:
        return f"contains({text}, {part})"

    def starts(self, text: str, part: str) -> str:
        return f"startswith({text}, {part})" if self.spark else f"starts_with({text}, {part})"

    def find(self, text: str, part: str) -> str:
        """1-based place of the first occurrence, 0 without one."""
        return f"instr({text}, {part})"

    def sub(self, text: str, start: str, length: str) -> str:
        return f"substring({text}, CAST({start} AS INT), CAST({length} AS INT))"

    def joined(self, value: str, sep: str, order: str) -> str:
        """Values of a group as one string in the given order."""
        return f"listagg({value}, {self.lit(sep)}) WITHIN GROUP (ORDER BY {order})" if self.spark else f"string_agg({value}, {self.lit(sep)} ORDER BY {order})"

    def listed(self, value: str, order: str) -> str:
        """Values of a group as an array in the given order."""
        return f"transform(sort_array(collect_list(struct({order} AS o, {value} AS v))), x -> x.v)" if self.spark else f"list({value} ORDER BY {order}, {value})"

    def fn(self, args: str, body: str) -> str:
        """A lambda."""
        if self.spark:
            return f"({args}) -> {body}" if "," in args else f"{args} -> {body}"
        return f"lambda {args}: {body}"

    def each(self, array: str, arg: str, body: str) -> str:
        return f"{'transform' if self.spark else 'list_transform'}({array}, {self.fn(arg, body)})"

    def keep(self, array: str, arg: str, body: str) -> str:
        return f"{'filter' if self.spark else 'list_filter'}({array}, {self.fn(arg, body)})"

    def size(self, array: str) -> str:
        return f"size({array})" if self.spark else f"len({array})"

    def glue(self, array: str, sep: str) -> str:
        return f"array_join({array}, {self.lit(sep)})" if self.spark else f"array_to_string({array}, {self.lit(sep)})"

    def exploded(self, table: str, array: str, pos: str, item: str) -> str:
        """``table`` (a subquery with alias t) with a row per element of ``array``; ``pos`` counts from 1."""
        if self.spark:
            return f"(SELECT t.*, p.pos + 1 AS {pos}, p.item AS {item} FROM {table} AS t LATERAL VIEW posexplode({array}) p AS pos, item)"
        return f"(SELECT t.*, CAST(generate_subscripts({array}, 1) AS INTEGER) AS {pos}, unnest({array}) AS {item} FROM {table} AS t)"

    def pick(self, value: str, key: str, greatest: bool) -> str:
        return f"{'max_by' if greatest else 'min_by'}({value}, {key})" if self.spark else f"{'arg_max' if greatest else 'arg_min'}({value}, {key})"

    def take(self, array: str, n: str) -> str:
        """The first n elements."""
        return f"slice({array}, 1, {n})" if self.spark else f"{array}[1:{n}]"

    def lengths(self, array: str) -> str:
        """Summed lengths of an array of strings."""
        return f"aggregate({array}, 0, (a, x) -> a + length(x))" if self.spark else f"CAST(coalesce(list_sum(list_transform({array}, lambda x: length(x))), 0) AS INTEGER)"

    def indexes(self, n: str) -> str:
        """1 to n, empty for 0."""
        return f"filter(sequence(1, greatest({n}, 1)), i -> i <= {n})" if self.spark else f"generate_series(1, {n})"

    def at(self, array: str, i: str) -> str:
        return f"element_at({array}, {i})" if self.spark else f"{array}[{i}]"

    def append(self, a: str, b: str) -> str:
        return f"concat({a}, {b})" if self.spark else f"list_concat({a}, {b})"

    def any(self, array: str, arg: str, test: str) -> str:
        return f"exists({array}, {arg} -> {test})" if self.spark else f"len(list_filter({array}, lambda {arg}: {test})) > 0"

    def fold(self, array: str, empty: str, kind: str, acc: str, x: str, step: str) -> str:
        """Left fold of an array of records into an array of ``kind``; ``step`` yields the new array from ``acc`` and the record ``x``."""
        if self.spark:
            return f"aggregate({array}, CAST(array() AS array<{kind}>), ({acc}, {x}) -> {step})"
        wrapped = f"list_transform({array}, lambda e: [e])"
        return f"list_reduce({wrapped}, lambda {acc}, {x}w: (list_transform([{x}w[1]], lambda {x}: {step}))[1], {empty})"

    def single(self, x: str) -> str:
        return f"array({x})" if self.spark else f"[{x}]"

    def strings(self, items: list[str]) -> str:
        body = ", ".join(map(self.lit, items))
        return f"array({body})" if self.spark else f"[{body}]"

    def chars(self, text: str) -> str:
        """One-character strings."""
        return f"filter(split({text}, ''), c -> c <> '')" if self.spark else f"string_split({text}, '')"

    def distinct(self, array: str) -> str:
        return f"array_distinct({array})" if self.spark else f"list_distinct({array})"

    def record(self, **fields: str) -> str:
        if self.spark:
            return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def hex(self, blob: str) -> str:
        return f"hex({blob})"


SPARK, DUCK = Dialect(True), Dialect(False)
