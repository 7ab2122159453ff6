"""One spelling of an expression for Spark and, so that results can be compared, for a second SQL engine.

Operators are functions from a dialect and SQL expressions to an SQL expression. Under SPARK they become native
Catalyst expressions. Patterns stay within what linear-time engines accept: no look-around, no back-references. Spark's
engine backtracks: where a pattern can be taken apart in many ways, `found` takes a second one that can't.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: A character that Python's \w accepts; Java's own \w is ASCII only.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}]"
#: No character of WORD before this place, as in (?:^|[^WORD]), but asked only where a word may begin. The letter beyond
#: the basic plane, one of \p{L} anyway, makes the engine look back by whole characters.
BEGIN = "(?<![\\p{L}\\p{N}_\U0001d400])"
#: The characters that SPACE stands for.
BLANKS = " \t\n\x0b\f\r\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Text without these characters is in normal form C.
BEYOND = r"[^\x{0000}-\x{02FF}]"


class Spark:
    name = "spark"

    def lit(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t").replace("\f", "\\u000c").replace("\r", "\\r") + "'"

    def _pattern(self, p: str) -> str:
        p = "(?d)" + p  # only \n ends a line
        return f"r'{p}'" if "'" not in p else f'r"{p}"' if '"' not in p else self.lit(p)

    def sub(self, s: str, pattern: str, to: str, steady: str = "") -> str:
        """steady: as in found; it may leave out what is replaced by itself."""
        to = re.sub(r"\\(\d)", r"$\1", to.replace("$", r"\$"))
        return f"regexp_replace({s}, {self._pattern(steady or pattern)}, {self.lit(to)})"

    def guarded(self, s: str, may: str, body: Callable[[str], str]) -> str:
        """body(s), which changes nothing in texts without a match of may."""
        return self.bind(s, "gu_", f"case when {self.found('gu_', may)} then {body('gu_')} else gu_ end")

    def strip(self, s: str, side: str = "both") -> str:
        return f"trim({side} {self.lit(BLANKS)} from {s})"

    def found(self, s: str, pattern: str, steady: str = "") -> str:
        """steady: a pattern of the same language that backtracks nowhere, for the engine that would."""
        return f"regexp_like({s}, {self._pattern(steady or pattern)})"

    def count(self, s: str, pattern: str) -> str:
        return f"cast(regexp_count({s}, {self._pattern(pattern)}) as bigint)"

    def all(self, s: str, pattern: str, group: int = 0, steady: str = "") -> str:
        return f"regexp_extract_all({s}, {self._pattern(steady or pattern)}, {group})"

    def first(self, s: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({s}, {self._pattern(pattern)}, {group})"

    def split(self, s: str, by: str = "\n") -> str:
        return f"split({s}, {self.lit(re.escape(by) if by not in (chr(10), chr(12)) else by)}, -1)"

    def join(self, a: str, by: str = "\n") -> str:
        return f"array_join({a}, {self.lit(by)})"

    def map(self, a: str, x: str, body: str) -> str:
        return f"transform({a}, {x} -> {body})"

    def enumerate(self, a: str, x: str, i: str, body: str) -> str:
        """i counts from 1."""
        return f"transform({a}, ({x}, {i}_0) -> {re.sub(rf"(?<![?.'\w]){i}(?!['\w])", f"({i}_0 + 1)", body)})"

    def filter(self, a: str, x: str, body: str) -> str:
        return f"filter({a}, {x} -> {body})"

    def fold(self, a: str, acc: str, x: str, body: str) -> str:
        """Left fold of a non-empty array; acc starts as its first element."""
        return self.bind(a, "fo_", f"aggregate(slice(fo_, 2, greatest(size(fo_) - 1, 0)), element_at(fo_, 1), ({acc}, {x}) -> {body})")

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})"

    def strings(self) -> str:
        return "cast(array() as array<string>)"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, cast({i} as int))"

    def part(self, a: str, start: str, n: str) -> str:
        return f"slice({a}, cast({start} as int), cast(greatest({n}, 0) as int))"

    def concat(self, *a: str) -> str:
        return f"concat({', '.join(a)})"

    def size(self, a: str) -> str:
        return f"cast(size({a}) as bigint)"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def any(self, a: str, x: str, body: str) -> str:
        return f"exists({a}, {x} -> {body})"

    def unique(self, a: str) -> str:
        return f"array_distinct({a})"

    def common(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def sorted(self, a: str) -> str:
        return f"sort_array({a})"

    def total(self, a: str, kind: str = "double") -> str:
        zero = "0D" if kind == "double" else "0L"
        return f"aggregate({a}, {zero}, (tot_, el_) -> tot_ + el_)"

    def range(self, n: str) -> str:
        """0 .. n - 1"""
        return f"(case when {n} > 0 then sequence(0L, cast({n} as bigint) - 1L) else cast(array() as array<bigint>) end)"

    def explode(self, cols: str, a: str, name: str, source: str, nth: str = "nth") -> str:
        return f"select {cols}, {nth}, {name} from {source} lateral view posexplode({a}) as {nth}, {name}"

    def gathered(self, value: str, order: str, by: str = "\n", where: str = "true") -> str:
        """An aggregate: values in order as one string."""
        return f"array_join(transform(sort_array(collect_list(case when {where} then struct({order} as o_, {value} as v_) end)), x_ -> x_.v_), {self.lit(by)})"

    def double(self, x: str) -> str:
        return f"cast({x} as double)"

    def sha(self, s: str) -> str:
        return f"sha2({s}, 256)"

    def upper(self, s: str) -> str:
        return f"upper({s})"

    def round_even(self, x: str, n: int = 0) -> str:
        return f"bround({x}, {n})"

    def count_if(self, x: str) -> str:
        return f"count_if({x})"

    def json(self, s: str, key: str) -> str:
        return f"get_json_object({s}, '$.{key}')"

    def quoted(self, name: str) -> str:
        return f"`{name}`"

    def json_keys(self, s: str) -> str:
        """The keys of a JSON object; null for any other text."""
        return f"case when try_parse_json({s}) is not null then json_object_keys({s}) end"

    def is_json(self, s: str) -> str:
        return f"(try_parse_json({s}) is not null)"

    def div(self, a: str, b: str) -> str:
        return f"cast(floor(({a}) / ({b})) as bigint)"

    def nfc(self, s: str) -> str:
        """Normal form C. Text below U+0300 has it already; the rest goes through the Unicode library that Spark brings
        along for its collations, inside the JVM."""
        made = f"java_method('com.ibm.icu.text.Normalizer', 'compose', nf_, false)"
        return self.bind(f"cast({s} as string)", "nf_", f"case when {self.found('nf_', BEYOND)} then {made} else nf_ end")

    def bind(self, value: str, name: str, body: str) -> str:
        """body, which sees value by name: neither engine computes it twice."""
        return self.at(self.map(self.array(value), name, body), "1")

    def once(self, value: str, name: str, body: Callable[[str], str]) -> str:
        """bind where the engine would compute each mention of value; elsewhere value stands in the body itself."""
        return self.bind(value, name, body(name))

    text_type = "string"
    number = "D"


class Duck(Spark):
    name = "duck"
    text_type = "varchar"
    number = "::double"

    def lit(self, s: str) -> str:
        body = s.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t").replace("\f", "\\f").replace("\r", "\\r")
        return f"E'{body}'" if "\\" in body else f"'{body}'"

    def _pattern(self, p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    def all(self, s: str, pattern: str, group: int = 0, steady: str = "") -> str:
        return f"regexp_extract_all({s}, {self._pattern(pattern)}, {group})"

    def guarded(self, s: str, may: str, body: Callable[[str], str]) -> str:
        return body(s)

    def sub(self, s: str, pattern: str, to: str, steady: str = "") -> str:
        raw = to.replace("'", "''")
        to = f"'{raw}'" if "\n" not in to else "(" + " || chr(10) || ".join(f"'{x}'" for x in raw.split("\n")) + ")"
        return f"regexp_replace({s}, {self._pattern(pattern)}, {to}, 'g')"

    def strip(self, s: str, side: str = "both") -> str:
        return self.sub(s, {"both": rf"^{SPACE}+|{SPACE}+\z", "trailing": rf"{SPACE}+\z", "leading": rf"^{SPACE}+"}[side], "")

    def found(self, s: str, pattern: str, steady: str = "") -> str:
        return f"regexp_matches({s}, {self._pattern(pattern)})"

    def count(self, s: str, pattern: str) -> str:
        return f"cast(len(regexp_extract_all({s}, {self._pattern(pattern)})) as bigint)"

    def split(self, s: str, by: str = "\n") -> str:
        return f"string_split({s}, {self.lit(by)})"

    def join(self, a: str, by: str = "\n") -> str:
        return f"coalesce(array_to_string({a}, {self.lit(by)}), '')"

    def map(self, a: str, x: str, body: str) -> str:
        return f"list_transform({a}, lambda {x}: {body})"

    def enumerate(self, a: str, x: str, i: str, body: str) -> str:
        return f"list_transform({a}, lambda {x}, {i}: {body})"

    def filter(self, a: str, x: str, body: str) -> str:
        return f"list_filter({a}, lambda {x}: {body})"

    def fold(self, a: str, acc: str, x: str, body: str) -> str:
        return f"list_reduce({a}, lambda {acc}, {x}: {body})"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]"

    def strings(self) -> str:
        return "cast([] as varchar[])"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def at(self, a: str, i: str) -> str:
        return f"({a})[{i}]"

    def part(self, a: str, start: str, n: str) -> str:
        return f"list_slice({a}, {start}, {start} + greatest({n}, 0) - 1)"

    def concat(self, *a: str) -> str:
        out = a[0]
        for x in a[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def size(self, a: str) -> str:
        return f"cast(len({a}) as bigint)"

    def has(self, a: str, x: str) -> str:
        return f"list_contains({a}, {x})"

    def any(self, a: str, x: str, body: str) -> str:
        return f"(len(list_filter({a}, lambda {x}: {body})) > 0)"

    def unique(self, a: str) -> str:
        return f"list_distinct({a})"

    def common(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def sorted(self, a: str) -> str:
        return f"list_sort({a})"

    def total(self, a: str, kind: str = "double") -> str:
        return f"coalesce(list_sum({a}), 0)"

    def range(self, n: str) -> str:
        return f"range(0, cast({n} as bigint))"

    def explode(self, cols: str, a: str, name: str, source: str, nth: str = "nth") -> str:
        return f"select {cols}, unnest(range(len({a}))) as {nth}, unnest({a}) as {name} from {source}"

    def gathered(self, value: str, order: str, by: str = "\n", where: str = "true") -> str:
        return f"coalesce(string_agg({value}, {self.lit(by)} order by {order}) filter (where {where}), '')"

    def sha(self, s: str) -> str:
        return f"sha256({s})"

    def upper(self, s: str) -> str:
        return f"replace(upper({s}), '\u1e9e', 'SS')"

    def round_even(self, x: str, n: int = 0) -> str:
        return f"round_even({x}, {n})"

    def count_if(self, x: str) -> str:
        return f"count(*) filter (where {x})"

    def json(self, s: str, key: str) -> str:
        return f"case when json_valid({s}) then json_extract_string({s}, '$.{key}') end"

    def quoted(self, name: str) -> str:
        return f'"{name}"'

    def json_keys(self, s: str) -> str:
        return f"case when json_valid({s}) and json_type({s}) = 'OBJECT' then json_keys({s}) end"

    def is_json(self, s: str) -> str:
        return f"json_valid({s})"

    def once(self, value: str, name: str, body: Callable[[str], str]) -> str:
        return body(value)

    def nfc(self, s: str) -> str:
        return f"nfc_normalize({s})"


SPARK, DUCK = Spark(), Duck()
