"""Decisions around text recognition: segmentation mode, language codes, retries, confidences, fusion of two results."""

from __future__ import annotations

from leafwright.dialect import Spark
from leafwright.functions import text as T

# Language hints and the codes they stand for.
LANGUAGES = {"en": "eng", "hi": "hin", "bn": "ben", "hr": "hrv", "und": "eng"}


def auto_psm(w: str, h: str, lines: str, d: Spark) -> str:
    aspect = f"(case when {h} <> 0 then {d.double(w)} / {h} else {d.double('1')} end)"
    return f"case when {lines} <= 3 then 11 when {aspect} > {d.double('1.55')} and {lines} < 35 then 4 when {lines} >= 8 then 6 else 4 end"


def choose_psm(override: str, enabled: str, auto: str) -> str:
    return f"coalesce({override}, case when not {enabled} then 6 else {auto} end)"


def should_retry(psm: str, mean: str) -> str:
    return f"({psm} in (4, 6) and {mean} < 70)"


def alternative(psm: str) -> str:
    """The mode that a retry takes."""
    return f"case when {psm} = 4 then 6 else 4 end"


def kept_of_retry(psm: str, first: str, second: str) -> str:
    """The mode of the better of two runs; a retry that is no better, or was not made (null), changes nothing."""
    return f"case when coalesce({second} > {first}, false) then {alternative(psm)} else {psm} end"


def config_string(d: Spark, psm: str, folder: str = "null") -> str:
    """The options of a recognition run; folder: where language data lies, if not in the default place."""
    base = f"'--oem 3 --psm ' || cast({psm} as {d.text_type}) || ' -c preserve_interword_spaces=1'"
    return f"case when coalesce({folder}, '') <> '' then '--tessdata-dir \"' || {folder} || '\" ' || {base} else {base} end"


def segments(d: Spark, hint: str) -> str:
    return d.filter(d.map(f"{d.split(f'lower({hint})', '+')}", "sg", T.strip(d, "sg")), "sg", "sg <> ''")


def have_packs(d: Spark, code: str, packs: str) -> str:
    s = segments(d, code)
    return f"({d.size(s)} > 0 and not {d.any(s, 'sg', f"sg <> 'osd' and not {d.has(packs, 'sg')}")})"


def resolve_language(d: Spark, hint: str, packs: str, osd: str = "true") -> str:
    h = f"lower(coalesce(nullif({hint}, ''), 'und'))"
    s = segments(d, h)
    base = d.filter(s, "sg", "sg <> 'osd'")
    composite = f"{d.size(s)} > 0 and not {d.any(s, 'sg', "length(sg) <> 3 and sg <> 'osd'")}"
    parts = f"case when {d.size(base)} = 0 then 'eng' else {d.join(base, '+')} end"
    known = "case " + h + " " + " ".join(f"when '{k}' then '{v}'" for k, v in LANGUAGES.items()) + f" else '{LANGUAGES['und']}' end"
    with_osd = f"case when {osd} or {d.has(s, d.lit('osd'))} then '+osd' else '' end"
    code = f"(case when {composite} then ({parts}) || ({with_osd}) else ({known}) || (case when {osd} then '+osd' else '' end) end)"
    return f"case when {have_packs(d, code, packs)} then {code} else 'eng+osd' end"


def mean(d: Spark, confidences: str) -> str:
    return f"case when {d.size(confidences)} = 0 then {d.double('0')} else {d.total(confidences)} / {d.size(confidences)} end"


def nearest_rank_p05(d: Spark, confidences: str) -> str:
    n = d.size(confidences)
    at = f"greatest(cast(floor({n} * {d.double('0.05')}) as bigint) - 1, 0) + 1"
    return f"case when {n} = 0 then {d.double('0')} else {d.at(d.sorted(confidences), at)} / 100 end"


def nearest_rank_p95(d: Spark, times: str) -> str:
    n = d.size(times)
    return d.at(d.sorted(times), f"least(cast(floor({d.double('0.95')} * {n}) as bigint), {n} - 1) + 1")


def quality_flags(d: Spark, sharpness: str, brightness: str, skew: str) -> str:
    flags = [(f"{sharpness} < 25", "low_sharpness"), (f"{brightness} < 0.18 or {brightness} > 0.92", "low_contrast"), (f"abs({skew}) > 6", "high_skew")]
    return d.join(d.filter(d.array(*(f"case when {c} then '{n}' end" for c, n in flags)), "fl", "fl is not null"), ",")


def rising_edges(d: Spark, fill: str, level: float = 0.12) -> str:
    """Text lines of a page: how often the share of ink in a row rises above the level."""
    on = d.map(fill, "r", f"case when r > {level} then 1 else 0 end")
    return f"{d.size(d.filter(d.enumerate(on, 'r', 'i', f'case when r = 1 and (i = 1 or {d.at(on, "i - 1")} = 0) then 1 else 0 end'), 'r', 'r = 1'))}"


def fusion_choice(mean_a: str, mean_b: str, distance: str, len_a: str, len_b: str, clarity_a: str, clarity_b: str, has_a: str, has_b: str, d: Spark) -> str:
    v = d.double
    better = f"({distance} >= {v('0.12')} or {len_b} > {len_a} * {v('1.05')} or {clarity_b} > {clarity_a} + {v('0.05')})"
    return f"case when not {has_a} then 'b' when not {has_b} then 'a' when {mean_b} > {mean_a} + {v('0.05')} then 'b' when {better} and {mean_a} - {mean_b} <= {v('0.05')} then 'b' else 'a' end"
