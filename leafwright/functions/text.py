"""Text rules as expressions: f(dialect, expression) -> expression."""

from __future__ import annotations

from leafwright.dialect import SPACE, WORD, Spark

# Characters that typesetters use, and what stands for them.
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
QUOTES = {"\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'"}
EXTENDED = {"\u2026": "...", "\u2013": "-", "\u2014": "-", "\u00a9": "", "\u00ae": "", "\u2122": ""}
ZERO_WIDTH = ["\u00ad", "\u200b", "\u200c", "\u200d"]
HEADINGS = ["OBJECTIVE", "EDUCATION", "CLINICAL SKILLS & COMPETENCIES", "PROJECTS & VOLUNTEER WORK", "CREDENTIALS"]
SECTIONS = ["EDUCATION", "EXPERIENCE", "SKILLS", "PROJECTS", "CERTIFICATIONS"]
PHRASES = {"fundamentals of nursing": "Fundamentals of Nursing", "psychology & sociology": "Psychology & Sociology"}
TYPOS = {"Kokata,India": "Kolkata, India", "Manglore,India": "Mangalore, India"}
CITIES = {"kokata": "kolkata", "manglore": "mangalore"}
LAYOUT_CITIES = CITIES | {"bangaluru": "bengaluru"}
SMALL_WORDS = ["and", "or", "the", "of", "in", "on", "for", "to", "with", "a", "an"]
PLACEHOLDERS = ["ar", "bn", "fa", "gu", "he", "hi", "ja", "kn", "ko", "ml", "mr", "pa", "ta", "te", "ur", "zh"]
ACRONYMS = ["S3", "EC2", "EKS", "ECS", "RDS", "SNS", "SQS", "GPU", "NLP", "GKE", "ELB"]
EOL_ABBREVIATIONS = ["S3", "GPU", "CPU", "API", "IAM", "SQL", "NLP", "GCP", "EC2", "EKS"]
BRAND_ABBREVIATIONS = ["S3", "EC2", "EKS", "GPU", "CPU", "API", "IAM", "SQL", "NLP"]
PAREN_TOKENS = ["S3", "EC2", "EKS", "GKE", "RDS", "SNS", "SQS", "ELB", "GCS", "BigQuery", "PostgreSQL", "MySQL"]

BARE_EMAIL = r"^(?i)(https?://)?[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}/?\s*$"
MONTH = "(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec|january|february|march|april|june|july|august|september|october|november|december)"


def strip(d: Spark, s: str) -> str:
    return d.strip(s)


def rstrip(d: Spark, s: str) -> str:
    return d.strip(s, "trailing")


def lstrip(d: Spark, s: str) -> str:
    return d.strip(s, "leading")


def is_upper(d: Spark, s: str) -> str:
    """A capital and no small letter; blanks around the text change nothing."""
    return d.found(s, r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*\z")


def one_of(d: Spark, s: str, values: list[str]) -> str:
    return f"{s} in ({', '.join(map(d.lit, values))})"


def replaced(d: Spark, s: str, table: dict[str, str]) -> str:
    for a, b in table.items():
        s = f"replace({s}, {d.lit(a)}, {d.lit(b)})"
    return s


def occurrences(d: Spark, s: str, chars: list[str]) -> str:
    return d.count(s, "[" + "".join(chars) + "]")


def unix_lines(d: Spark, s: str) -> str:
    return f"replace(replace({s}, {d.lit(chr(13) + chr(10))}, {d.lit(chr(10))}), {d.lit(chr(13))}, {d.lit(chr(10))})"


def glyphs(d: Spark, s: str, variant: str = "full") -> str:
    """full: ligatures and quotes; short: quotes, fi and fl; no_ff: all but the ff ligature; extended: with ellipsis,
    dashes and marks."""
    ligatures = {k: v for k, v in LIGATURES.items() if variant in ("full", "extended") or (variant == "short" and v in ("fi", "fl")) or (variant == "no_ff" and v != "ff")}
    return replaced(d, s, ligatures | QUOTES | (EXTENDED if variant == "extended" else {}))


def without_soft_hyphens(d: Spark, s: str) -> str:
    return replaced(d, s, {ZERO_WIDTH[0]: ""})


def without_zero_width(d: Spark, s: str) -> str:
    return replaced(d, s, dict.fromkeys(ZERO_WIDTH, ""))


def dehyphen(d: Spark, s: str, variant: str = "word") -> str:
    """word: a hyphen and newline between word characters; chained: also between single letters; ascii: ASCII only."""
    w = "[A-Za-z0-9]" if variant == "ascii" else WORD
    for _ in range(2 if variant == "chained" else 1):
        s = d.sub(s, rf"({w})-\n({w})", r"\1\2")
    return s


def by_line(d: Spark, s: str, x: str, body: str) -> str:
    return d.join(d.map(d.split(s), x, body))


def collapsed(d: Spark, s: str) -> str:
    return d.sub(s, r"[ \t]+", " ", r"(?: [ \t]|\t)[ \t]*")


def tidy_lines(d: Spark, s: str) -> str:
    """Each line right-stripped and with runs of blanks as one."""
    return by_line(d, s, "ln", collapsed(d, rstrip(d, "ln")))


def base_clean(d: Spark, s: str) -> str:
    """Line ends, normal form C, soft hyphens, glyphs and wrapped words; nothing else."""
    return dehyphen(d, glyphs(d, without_soft_hyphens(d, d.nfc(unix_lines(d, s)))))


def safe_clean(d: Spark, s: str) -> str:
    """base_clean, joined ampersands, and stripped, collapsed lines."""
    s = d.sub(base_clean(d, s), r"&\s*\n", "& ")
    return strip(d, by_line(d, s, "ln", collapsed(d, strip(d, "ln"))))


def bullets(d: Spark, s: str, variant: str = "loose", symbol: str = "\u2022") -> str:
    if variant == "loose":  # any run of marks, blanks after it optional and across lines
        s = d.sub(s, "(?m)^([ \\t]*)[-\u2022\u00b7\u25aa\u25e6*\u2013\u2014]+\\s*", rf"\1{symbol} ")
        return d.sub(s, f"(?m)^([ \\t]*){symbol}\\s*(?:{symbol}\\s*)+", rf"\1{symbol} ")
    marks = {"general": "-*\u2022\u25cf\u25aa", "resume": "-*\u2022\u00b7\u2013\u2014", "finisher": "-*\u2022"}[variant]
    if variant == "finisher":
        return d.sub(s, f"(?m)^[ \\t]*[{marks}][ \\t]+", f"{symbol} ")
    return by_line(d, s, "ln", d.sub("ln", f"^\\s*[{marks}]\\s+", f"{symbol} "))


def joined_orphans(d: Spark, s: str) -> str:
    """A capitalised word after a line that ends with a comma joins it."""
    return d.sub(s, f"(,)\\n(?:\u2022\\s*)?([A-Z][A-Za-z-]+[A-Za-z])({WORD.replace('[', '[^')}|\\z)", r"\1 \2\3")


def merged_hanging(d: Spark, s: str) -> str:
    """`label: item,` and the line after it become one bullet."""
    s = d.sub(s, "(?m)^[ \\t]*([^\\n]*?:[^\\n]*?),[ \\t]*\\n[ \\t]*[\u2022-]?[ \\t]*([\\p{L}\\p{N}_][^\\n]*?)[ \\t]*$", "\u2022 \\1, \\2")
    return s


def blanked_bad_urls(d: Spark, s: str) -> str:
    return d.sub(s, r"(?m)^https?://\S+@\S+[ \t]*$", "")


def is_bare_email(d: Spark, line: str) -> str:
    return d.found(strip(d, line), BARE_EMAIL.replace("^(?i)", "(?i)^"))


def without_bare_emails(d: Spark, s: str) -> str:
    return d.join(d.filter(d.split(s), "ln", f"not {is_bare_email(d, 'ln')}"))


def is_email_url(d: Spark, line: str) -> str:
    return d.found(line, r"(?i)^\s*https?://\S+@\S+/?\s*$")


def without_email_urls(d: Spark, s: str) -> str:
    return d.join(d.filter(d.split(s), "ln", f"not {is_email_url(d, 'ln')}"))


def email_tokens_dropped(d: Spark, s: str) -> str:
    """URL tokens whose authority holds an @ vanish; runs of blanks become one."""
    return d.sub(d.sub(s, r"(?i)\b(?:https?|ftp)://[^/\s]*@[^/\s]*[^\s]*", ""), r"[ \t]{2,}", " ")


def email_wrappers_dropped(d: Spark, s: str) -> str:
    return d.sub(s, r"(?i)https?://[^\s]*@[^\s/]+(?:/[^\s]*)?", "")


def emails_unwrapped(d: Spark, s: str) -> str:
    """http://user@host -> user@host; a slash before a word goes, one at the end stays."""
    return d.sub(s, r"(?i)\bhttps?://([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})(?:/)?\b", r"\1")


def emails_canonical(d: Spark, s: str) -> str:
    """An authority that is an e-mail address stands for its URL; other authorities with an @ drop the token."""
    s = d.sub(s, r"(?i)\b(?:https?|ftp)://([A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,})(?:/[^\s]*|(\s)|\z)", r"\1\2")
    s = d.sub(s, r"(?i)\b(?:https?|ftp)://[^/\s]*@[^/\s]*[^\s]*", "")
    return d.sub(s, r"[ \t]{2,}", " ")


def single_blank_lines(d: Spark, s: str) -> str:
    return d.sub(s, r"\n{3,}", "\n\n")


def one_blank_per_run(d: Spark, s: str) -> str:
    """Lines with runs of empty ones cut to one."""
    a = d.split(s)
    return d.join(d.filter(d.enumerate(a, "ln", "i", f"case when ln = '' and i > 1 and {d.at(a, 'i - 1')} = '' then null else ln end"), "ln", "ln is not null"))


def label_colons(d: Spark, s: str) -> str:
    fixed = d.sub(d.sub("ln", r"^([^:\n]{2,40}):([^\s])", r"\1: \2"), r"^([^:\n]{2,40}):\z", r"\1: ")
    return by_line(d, s, "ln", f"case when {d.found('ln', r'^\s*(?:https?://|ftp://|mailto:)')} then ln else {fixed} end")


def canonical_phrases(d: Spark, s: str) -> str:
    for a, b in PHRASES.items():
        s = d.sub(s, f"(?i){a}", b)
    return s


def typos(d: Spark, s: str) -> str:
    return replaced(d, s, TYPOS)


def cities(d: Spark, s: str, table: dict[str, str] = CITIES, keep_case: bool = False) -> str:
    def named(s: str) -> str:
        for a, b in table.items():
            if keep_case:
                s = d.sub(s, rf"\b{a.upper()}\b", b.upper())
                s = d.sub(s, rf"\b{a.capitalize()}\b", b.capitalize())
            s = d.sub(s, rf"(?i)\b{a}\b", b)
        return s

    return d.guarded(s, f"(?=[{''.join(sorted({c for a in table for c in (a[0], a[0].upper())}))}])(?i:{'|'.join(table)})", named)


def contact_line(d: Spark, s: str) -> str:
    t = strip(d, s)
    out = collapsed(d, d.sub(t, "\\s*[|\u2022\u2014]\\s*", " | "))
    for label in ("Email", "Mobile", "Phone"):
        out = d.sub(out, rf"(?i)\b{label}\s*:\s*", f"{label}: ")
    is_contact = d.found(t, r"@|(?i:\b(?:Email|Mobile|Phone)\b)")
    return f"case when {is_contact} then {strip(d, out)} else {t} end"


def spaced_commas_and_pipes(d: Spark, s: str) -> str:
    s = d.sub(d.sub(s, r"\s*\|\s*", " | "), r"\s*,\s*,+", ",")
    return strip(d, d.sub(d.sub(s, r",(\S)", r", \1"), r"\s{2,}", " "))


def spaced_dashes(d: Spark, s: str) -> str:
    return d.sub(s, "\\s*(?:-|\u2014)\\s*", " \u2013 ")


def punctuation(d: Spark, s: str) -> str:
    return d.sub(spaced_dashes(d, d.sub(s, r",(\S)", r", \1")), r"[ \t]{2,}", " ")


def pipes_before_url(d: Spark, s: str) -> str:
    """Pipes get one blank on each side, before the first `http` only."""
    head = d.first(s, r"^(.*?)(?:http.*)?\z", 1)
    tail = f"substring({s}, length({head}) + 1)"
    return f"({d.sub(head, r'\s*\|\s*', ' | ')} || {tail})"


def placeholders(d: Spark, s: str) -> str:
    codes = "|".join(PLACEHOLDERS)
    for _ in range(2):  # neighbours share the character between them
        s = d.sub(s, rf"(?m)(^|[^\p{{L}}\p{{N}}_])\((?:{codes})\)([^\p{{L}}\p{{N}}_]|$)", r"\1\2")
    return d.sub(s, r"[ \t]{2,}", " ")


# parentheses ----------------------------------------------------------------------------------------------------


def opens(d: Spark, s: str) -> str:
    return d.count(s, r"\(")


def closes(d: Spark, s: str) -> str:
    return d.count(s, r"\)")


def paren_unguarded(d: Spark, line: str) -> str:
    return f"case when {opens(d, line)} > {closes(d, line)} then {line} || ')' else {line} end"


def paren_at_end(d: Spark, line: str) -> str:
    return f"case when {opens(d, line)} > {closes(d, line)} and {d.found(line, r'[A-Za-z0-9]\s*\z')} then {line} || ')' else {line} end"


def paren_one_extra(d: Spark, line: str) -> str:
    known = d.found(line, rf"\((?i:{'|'.join(EOL_ABBREVIATIONS)})\s*\z")
    return f"case when {opens(d, line)} = {closes(d, line)} + 1 and {known} then {line} || ')' else {line} end"


def paren_known_token(d: Spark, line: str) -> str:
    tail = d.first(line, r"\(\s*([^(]*)\z", 1)
    known = d.found(tail, rf"^(?:{'|'.join(PAREN_TOKENS)})")
    return f"case when {opens(d, line)} > {closes(d, line)} and {known} then {line} || ')' else {line} end"


def paren_acronym(d: Spark, line: str) -> str:
    """A known acronym after the line's last parenthesis, with none that closes it."""
    return d.sub(line, rf"([A-Za-z0-9+/_-]\s*\((?:{'|'.join(ACRONYMS)}))([^A-Z0-9)][^)]*)?\z", r"\1)\2")


def paren_cloud(d: Spark, line: str) -> str:
    """The first `AWS (S3` of a line, unless a parenthesis closes within 20 characters."""
    head = r"^(.*?\b(?i:AWS)\s*\((?i:S3|EC2|RDS|ECS|EKS))\b(.*)\z"
    before, after = d.first(line, head, 1), d.first(line, head, 2)
    near = d.found(f"substring({after}, 1, 20)", r"\)")
    return f"case when {before} <> '' and not {near} then {before} || ')' || {after} else {line} end"


def paren_short(d: Spark, line: str) -> str:
    """An upper-case word, a parenthesis and a token of up to 12 characters that nothing closes on the line."""
    return d.sub(line, r"\b([A-Z]{2,}\s*\([A-Za-z0-9+/#-]{1,12})([^A-Za-z0-9+/#)-][^)]*)?\z", r"\1)\2")


def paren_brand(d: Spark, s: str) -> str:
    """A known brand and abbreviation after the last closing parenthesis of a page."""
    head = d.first(s, r"(?s)^(.*\))[^)]*\z", 1)
    tail = f"substring({s}, length({head}) + 1)"
    known = "|".join(BRAND_ABBREVIATIONS)
    return f"({head} || {d.sub(tail, rf'\b((?i:AWS|GCP))\s*\(((?i:{known}))([^A-Za-z0-9]|\z)', r'\1 (\2)\3')})"


# headings and labels ----------------------------------------------------------------------------------------------


def words(d: Spark, s: str) -> str:
    return d.count(s, r"\S+")


def heading(d: Spark, line: str, variant: str) -> str:
    # no text gets shorter in capitals
    short = lambda values: f"length(th_) <= {max(map(len, values))} and " if d.name == "spark" else ""
    known = lambda values: short(values) + one_of(d, "upper(th_)", values)
    upper = f"({is_upper(d, 'th_')} and length(th_) <= 64 and not {d.found('th_', r'[.,;:]\z')})"
    loose = f"({d.found('th_', '^[A-Z][A-Za-z &/]+$')})"  # a final . or ; is no letter anyway
    body = {
        "general": f"({upper} or {loose})",
        "document": f"({known(HEADINGS)} or {upper} or {loose})",
        "canonical": f"(({upper} and {words(d, 'th_')} <= 4) or {loose})",
        "finisher": f"({d.found('th_', r'''^[A-Z][A-Z &/.'-]{1,63}$''')} and {words(d, 'th_')} <= 6)",
        "spec": f"({is_upper(d, 'th_')} and length(th_) >= 6 and {words(d, 'th_')} <= 3)",
        "resume": f"({known(SECTIONS)} or {d.found('th_', '^[A-Z][A-Z &/]+$')})",
        "validator": f"({d.found('th_', r'''^[A-Z][A-Z &/()'-]+$''')} or {known(SECTIONS)})",
    }
    if variant in body:
        return d.bind(strip(d, line), "th_", body[variant])
    return {
        "cleaner": d.found(line, r"(?i)^(?:OBJECTIVE|EDUCATION|EXPERIENCE|SKILLS|PROJECTS(?:\s*&\s*OPEN-?SOURCE)?|CREDENTIALS)\b"),
        "layout": d.found(line, rf"(?i)^{SPACE}*(?:EDUCATION|ACADEMICS|EXPERIENCE|SKILLS|PROJECTS|CERTIFICATIONS|AWARDS){SPACE}*\z"),
        "section": d.found(strip(d, line), r"^[A-Z][A-Z /&-]{3,}$"),
    }[variant]


HEADING_VARIANTS = ["general", "document", "canonical", "finisher", "spec", "cleaner", "resume", "layout", "validator", "section"]


def is_label(d: Spark, line: str) -> str:
    return d.found(line, r"(?i)^\s*[A-Za-z ]{2,20}:")


def sentence_like(d: Spark, s: str) -> str:
    return f"({d.found(s, '[.]')} and {d.count(s, WORD + '+')} >= 6)"


def edge_candidate(d: Spark, s: str) -> str:
    t = strip(d, s)
    return f"({t} <> '' and length({t}) <= 120 and not {d.found(t, '@|http|[|]')} and not {sentence_like(d, t)})"


def counter_key(d: Spark, s: str) -> str:
    """A line without its counters: stripped, collapsed, lower-cased, digits deleted."""
    return d.sub(f"lower({collapsed(d, strip(d, d.nfc(s)))})", r"\p{Nd}+", "")


def title_words(d: Spark, s: str) -> str:
    """Each word capitalised, small words in lower case; separators stay. Pieces are cut at blanks, commas, & and /."""
    small = ", ".join(map(d.lit, SMALL_WORDS))
    marked = d.sub(s, r"([\s,&/])", "\x01\\1\x01")
    piece = f"case when lower(w) in ({small}) then lower(w) else {d.upper('substring(w, 1, 1)')} || lower(substring(w, 2)) end"
    return d.join(d.map(d.split(marked, "\x01"), "w", piece), "")


def title_item(d: Spark, s: str) -> str:
    return f"case when {is_upper(d, s)} or {d.found(s, r'^\p{Nd}+\z')} then {s} else {title_words(d, s)} end"


def section_case(d: Spark, s: str, style: str = "title") -> str:
    """`Label: a, b` lines with their items in title or sentence case."""
    pattern = r"^([^:\n]{2,40}?)\s*:\s*(.+)$"
    head, body = d.first("ln", pattern, 1), d.first("ln", pattern, 2)
    items = d.filter(d.map(d.split(body, ","), "it", strip(d, "it")), "it", "it <> ''")
    cased = title_words(d, "it") if style == "title" else f"{d.upper('substring(it, 1, 1)')} || lower(substring(it, 2))"
    return by_line(d, s, "ln", f"case when {d.found('ln', pattern)} then {head} || ': ' || {d.join(d.map(items, 'it', cased), ', ')} else ln end")


# Brands, degrees and labels with the case that they keep.
BRANDS = {"linkedin": "LinkedIn", "github": "GitHub", "gitlab": "GitLab", "coursera": "Coursera", "streamlit": "Streamlit", "aws": "AWS", "gcp": "GCP"}
DEGREES = ["Master of Technology", "Bachelor of Technology", "Master of Science", "Bachelor of Science", "Master of Engineering", "Bachelor of Engineering"]
LABELS = ["Email", "Mobile", "Phone", "Graduation", "Academic Performance", "Relevant Coursework"]


def brands(d: Spark, s: str) -> str:
    def named(s: str) -> str:
        for a, b in BRANDS.items():
            s = d.sub(s, rf"\b{a}\b", b)
        return s

    return d.guarded(s, f"(?=[{''.join(sorted({a[0] for a in BRANDS}))}])(?:{'|'.join(BRANDS)})", named)


def degrees(d: Spark, s: str) -> str:
    def named(s: str) -> str:
        for degree in DEGREES:
            s = d.sub(s, rf"(?i)\b{degree}\b", degree)
        return s

    return d.guarded(s, r"[rR] [oO][fF] [tTsSeE]", named)


def labels(d: Spark, line: str) -> str:
    """Known labels at the start of a line in title case, with one blank after the colon."""
    for label in LABELS:
        line = d.sub(line, rf"^(?i:{label})\s*:([^\s]|\z)", rf"{label}: \1")
    return line


def unified_phone(d: Spark, s: str) -> str:
    """Mobile and Phone labels of a page become one: Mobile if the page has it, else Phone."""
    has = d.found(s, r"(?mi)^[ \t]*mobile\s*:")
    pattern = r"(?mi)^[ \t]*(?:mobile|phone)\s*:"
    return f"case when {has} then {d.sub(s, pattern, 'Mobile: ')} else {d.sub(s, pattern, 'Phone: ')} end"
