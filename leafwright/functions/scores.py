"""Fidelity and readability scores as expressions."""

from __future__ import annotations

from leafwright.dialect import Spark
from leafwright.functions import text as T


def trigrams(d: Spark, s: str) -> str:
    """The distinct character trigrams of a text whose white space is collapsed: its pieces of three characters from the
    first, the second and the third character on."""
    pieces = d.concat(*(d.all(x, "(?s).{3}") for x in ("tx_", "substring(tx_, 2)", "substring(tx_, 3)")))
    return d.bind(d.sub(s, r"\s+", " "), "tx_", d.unique(pieces))


def set_distance(d: Spark, a: str, b: str) -> str:
    """1 - Jaccard of two arrays of distinct values; 0 if both are empty."""
    common = d.size(d.common(a, b))
    union = f"({d.size(a)} + {d.size(b)} - {common})"
    return f"case when {union} = 0 then {d.double('0')} else 1 - {d.double(common)} / {union} end"


def clarity(d: Spark, s: str) -> str:
    plain = d.count(d.join("tr_", "\x01"), "(?:^|\x01)[A-Za-z0-9 ]{3}")
    ratio = f"case when {d.size('tr_')} = 0 then null else {d.double(plain)} / {d.size('tr_')} end"
    share = d.bind(trigrams(d, s), "tr_", ratio)
    return f"coalesce({share} - {d.double('0.02')} * {d.count(s, '[.,;:]{3,}')} - {d.double('0.01')} * {d.count(s, r'[^\x00-\x7e\s]')}, {d.double('0')})"


def tokens(d: Spark, s: str) -> str:
    return d.all(f"lower({s})", "[a-z0-9]+")


def jaccard(d: Spark, a: str, b: str) -> str:
    x, y = d.unique(tokens(d, a)), d.unique(tokens(d, b))
    common = d.size(d.common(x, y))
    return f"case when {d.size(x)} = 0 and {d.size(y)} = 0 then {d.double('1')} else {d.double(common)} / ({d.size(x)} + {d.size(y)} - {common}) end"


def _lines(d: Spark, s: str) -> str:
    return d.filter(d.split(s), "ln", f"{T.strip(d, 'ln')} <> ''")


def _base(d: Spark, lines: str) -> str:
    n, total = d.size(lines), d.total(d.map(lines, "ln", d.double("length(ln)")))
    avg = f"({total} / {n})"
    v = d.double
    return f"(case when {avg} between 60 and 110 then {v('1')} when {avg} < 60 then {avg} / 60 else greatest({v('0')}, (200 - least({avg}, {v('200')})) / 90) end)"


def readability(d: Spark, s: str, variant: str) -> str:
    """resume and canonical: line lengths with a bonus for bullets and headings; validator: with penalties."""
    lines = _lines(d, s)
    n, base, v = d.size(lines), _base(d, lines), d.double
    if variant == "validator":
        worse = f"(case when {T.opens(d, s)} <> {T.closes(d, s)} then {v('0.1')} else {v('0')} end + case when {d.found(s, r'\n{3,}')} then {v('0.05')} else {v('0')} end + case when {d.any(lines, 'ln', 'length(ln) > 180')} then {v('0.05')} else {v('0')} end)"
        score = f"greatest({v('0')}, least({v('1')}, {v('0.9')} * {base} - {worse}))"
    else:
        marks = "^\\s*\u2022 " if variant == "resume" else "^\\s*[\u2022*-] "
        t = T.strip(d, "ln")
        head = f"({T.is_upper(d, t)} and {T.words(d, t)} <= 4)" if variant == "resume" else T.heading(d, "ln", "canonical")
        share = f"({v('0.5')} * {d.size(d.filter(lines, 'ln', d.found('ln', marks)))} / {n} + {v('0.5')} * {d.size(d.filter(lines, 'ln', head))} / {n})"
        score = f"least({v('1')}, {v('0.9')} * {base} + least({v('0.1')}, {share}))"
    return f"case when {n} = 0 then {v('0')} else {score} end"


def word_error_rate(d: Spark, reference: str, hypothesis: str) -> str:
    """Edit distance over tokens by reference length. Tokens of both become characters of one alphabet, so that the
    engine's own edit distance over characters does the work. The second engine counts bytes: it is right up to 94
    distinct tokens only."""

    def coded(tokens: str) -> str:
        place = "array_position(ab_, tk)" if d.name == "spark" else "list_position(ab_, tk)"
        if d.name == "spark":  # chr() has 256 values; surrogates are no characters
            point = f"{place} + case when {place} < 55264 then 32 else 2080 end"
            return f"decode(unhex({d.join(d.map(tokens, 'tk', f"lpad(hex({point}), 8, '0')"), '')}), 'UTF-32')"
        return d.join(d.map(tokens, "tk", f"chr(cast({place} as int) + 32)"), "")

    edits = d.map(d.array(d.unique(d.concat(reference, hypothesis))), "ab_", f"levenshtein({coded(reference)}, {coded(hypothesis)})")
    n = d.size(reference)
    return f"case when {n} = 0 then (case when {d.size(hypothesis)} = 0 then {d.double('0')} else {d.double('1')} end) else {d.double(d.at(edits, '1'))} / {n} end"
