"""Text normalisers, patterns and extractors as Column functions.

White space is the explicit ASCII class ``[ \\t\\r\\n]`` and patterns avoid look-around, so every engine agrees. Three
normalisers have names of their own because callers need different ones: :func:`norm_visible` (quotes, dashes, markup),
:func:`norm_key` (case and spaces) and :func:`norm_words` (words only).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns and sentences whose matches results depend on.
CITATION = r"""\[\s*["']?\s*([^,\[\]"']+?)\s*,\s*["']?([^,\[\]]+?)\s*,\s*([^,\[\]]+?)\s*,\s*p\.?\s*(\d+)[^\]]*\]"""
ADVICE = (
    r"(?i)\b(?:you should (?:go with|choose|pick|buy|take out|opt for)|i(?:'d| would) (?:recommend|suggest|go with|choose|pick)"
    r"|(?:i|we) recommend|(?:the )?best (?:option|choice|policy|insurer|cover) for you|your best bet"
    r"|you(?:'d| would) be better off (?:with|choosing)|most people (?:your age|like you) (?:pick|choose|go with)"
    r"|(?:is|would be) (?:the right|the best|ideal|perfect) (?:choice|policy|option) for you)\b"
)
MARKDOWN_HEADING = r"^#{1,4}[ \t]+(.+)$"
BOLD_HEADING = r"^\*\*([^*]{4,80})\*\*$"
SECTION_HEADING = r"^(?i)\**[ \t]*section[ \t]+([a-z]?[0-9]*[a-z]?[0-9]*)[ \t]*[:\-–—·•|. \t]*(.*?)\**$"
SECTION_TITLE = r"^(?i)section[ \t]+([a-z]?[0-9]+[a-z]?[0-9]*|[a-z][0-9]*)\b[ \t]*[:\-–—·•|. \t]*(.*)$"
SEGMENT = r"([.!?][ \t\r\n]+|\n+)"

BLANKS = "[ \\t\\r\\n]+"


def norm_visible(text: Column) -> Column:
    """Lower case, line-break markup, curly quotes and dashes folded, spaces and markdown marks collapsed."""
    t = F.regexp_replace(F.lower(text), r"<br[ \t\r\n]*/?>|&lt;br[ \t\r\n]*/?&gt;", " ")
    t = F.translate(t, "’‘“”–—", "''\"\"--")
    return F.trim(F.regexp_replace(t, r"[ \t\r\n*_#|•·]+", " "))


def norm_key(text: Column) -> Column:
    """Lower case, white space collapsed, trimmed: the key of exact-duplicate and equality checks."""
    return F.trim(F.regexp_replace(F.lower(text), BLANKS, " "))


def norm_words(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def fold(text: Column) -> Column:
    """:func:`norm_visible` with runs of hyphens as one."""
    return F.regexp_replace(norm_visible(text), "-{2,}", "-")


def norm_doc(token: Column) -> Column:
    """A document token without folder, ``.pdf``, quotes, marks and case."""
    t = F.regexp_replace(F.trim(token), r"^[\"']+|[\"']+$", "")
    t = F.regexp_replace(t, r"^[_*# ]+|[_*# ]+$", "")
    t = F.regexp_replace(t, r"^.*[/\\]", "")
    return norm_key(F.regexp_replace(t, r"(?i)\.pdf$", ""))


def norm_section(section: Column) -> Column:
    """A section without marks, case and the word itself."""
    t = F.regexp_replace(F.lower(F.trim(section)), r"^[_*# ]+|[_*# ]+$", "")
    return F.regexp_replace(t, "^section ", "")


def template_key(text: Column, names: Sequence[str] = ()) -> Column:
    """A text with numbers and ``names`` replaced by markers: what differs in them alone shares a key."""
    t = F.lower(text)
    if names:
        t = F.regexp_replace(t, "(?i)\\b(?:" + "|".join(names) + ")\\b", "<name>")
    t = F.regexp_replace(t, r"[0-9]+(?:[.,][0-9]+)*", "<number>")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}<>]+", " "))


def citations(text: Column) -> Column:
    """Every citation in order: array of its text, insurer, document, section and page."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)),
        lambda c: F.struct(
            c.alias("citation"),
            *(F.trim(F.regexp_extract(c, CITATION, i)).alias(n) for i, n in ((1, "insurer"), (2, "doc"), (3, "section"))),
            F.regexp_extract(c, CITATION, 4).cast("int").alias("page"),
        ),
    )


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, " ")


def count_citations(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CITATION))


def gives_advice(text: Column) -> Column:
    return F.rlike(text, F.lit(ADVICE))


def names_a_model(text: Column, names: Sequence[str]) -> Column:
    """Whether a text names one of ``names`` (with a version, if any) as a word."""
    return F.rlike(text, F.lit("(?i)\\b(?:" + "|".join(names) + ")[0-9.-]*\\b"))


def strip_reasoning(text: Column) -> Column:
    """Closed reasoning goes; an open one takes the rest of the text with it."""
    t = F.regexp_replace(text, r"(?s)<think>.*?</think>[ \t\r\n]*", "")
    return F.trim(F.substring_index(t, "<think>", 1))


def final_answer(raw: Column, reasoning_expected: Column) -> Column:
    """``answer``, ``truncated`` and ``present``: a model that should reason and never closed has no answer."""
    closed = F.contains(raw, F.lit("</think>"))
    truncated = reasoning_expected & ~closed
    answer = F.when(truncated, F.lit("")).when(closed, F.trim(F.substring_index(raw, "</think>", -1))).otherwise(F.trim(raw))
    return F.struct(answer.alias("answer"), truncated.alias("truncated"), (answer != "").alias("present"))


def heading(line: Column) -> Column:
    """Section id and title of a heading line, nulls for any other: markdown, then section, then bold headings."""
    s = F.trim(line)
    marks = r"^[ *:\-–—·•|.]+|[ *:\-–—·•|.]+$"
    clean = lambda c: F.regexp_replace(c, marks, "")
    md, bold = clean(F.regexp_extract(s, MARKDOWN_HEADING, 1)), clean(F.regexp_extract(s, BOLD_HEADING, 1))
    own, own_title = F.upper(F.regexp_extract(s, SECTION_HEADING, 1)), clean(F.regexp_extract(s, SECTION_HEADING, 2))
    is_md, is_section, is_bold = F.rlike(s, F.lit(MARKDOWN_HEADING)), F.rlike(s, F.lit(SECTION_HEADING)), F.rlike(s, F.lit(BOLD_HEADING))

    def titled(title: Column) -> Column:
        number, rest = F.upper(F.regexp_extract(title, SECTION_TITLE, 1)), clean(F.regexp_extract(title, SECTION_TITLE, 2))
        section = F.when(number != "", number).otherwise(F.substring(title, 1, 40))
        return F.struct(section.alias("section_id"), F.when((number != "") & (rest != ""), rest).otherwise(title).alias("section_title"))

    sectioned = F.struct(own.alias("section_id"), F.when(own_title != "", own_title).otherwise(F.concat(F.lit("Section "), own)).alias("section_title"))
    found = (
        F.when(is_md & (md != ""), titled(md))
        .when(is_section & (own != ""), sectioned)
        .when(is_section & (own_title != ""), titled(own_title))
        .when(is_bold & (bold != ""), titled(bold))
    )
    return F.when((s != "") & (F.length(s) <= 120), found)


def segments(text: Column) -> Column:
    """Lossless sentences: cuts follow ``.``, ``!`` or ``?`` with space, and line feeds; joined they are the text."""
    return F.filter(F.split(F.regexp_replace(text, SEGMENT, "$1\u0001"), "\u0001"), lambda s: s != "")


def resolve_span(span_id: Column, parts: Column) -> Column:
    """The text of ``A3`` or ``A3-A5`` among segments; null for another source, a bad order or out of range."""
    pattern = r"^([A-Z]+)([0-9]+)(?:-([A-Z]+)([0-9]+))?$"
    lo = F.regexp_extract(span_id, pattern, 2).try_cast("int")
    hi = F.coalesce(F.regexp_extract(span_id, pattern, 4).try_cast("int"), lo)
    end_source = F.regexp_extract(span_id, pattern, 3)
    same = (end_source == "") | (end_source == F.regexp_extract(span_id, pattern, 1))
    ok = F.rlike(span_id, F.lit(pattern)) & same & (lo <= hi) & (hi < F.size(parts))
    return F.when(ok, F.array_join(F.slice(parts, lo + 1, hi - lo + 1), ""))


def adapt(prompt: Column, changes: Sequence[tuple[str, str]]) -> Column:
    """A prompt with clauses replaced literally; one that lacks a clause is an error, as it was adapted to another."""
    for old, new in changes:
        prompt = F.when(F.contains(prompt, F.lit(old)), F.replace(prompt, F.lit(old), F.lit(new))).otherwise(F.raise_error(F.lit(f"the prompt lacks {old!r}")))
    return prompt


# Tier names, those of a brand first.
TIERS = ("Admiral Platinum", "Admiral Gold", "Platinum", "Gold", "Essential", "Standard", "Premier", "Premium")


def tiers(title: Column, text: Column, names: Sequence[str] = TIERS) -> Column:
    """Sorted distinct tier names in a title and the first 400 characters of a text; a longer name is taken whole."""
    head = F.concat_ws(" ", title, F.substring(text, 1, 400))
    return F.array_sort(F.array_distinct(F.regexp_extract_all(head, F.lit("\\b(" + "|".join(names) + ")\\b"), F.lit(1))))


def page_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), lambda p: p.cast("int"))


def collapse_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def chunk_header(insurer: Column, doc: Column, section: Column, page: Column, title: Column) -> Column:
    return F.trim(F.format_string("[%s, %s, Section %s, p.%s] %s", insurer, doc, section, page.cast("string"), F.coalesce(title, F.lit(""))))


#: What stands for the extracts where there are none.
NO_EXTRACTS = "(no policy extracts provided)"


def format_context(chunks: Column, most: int | None = None) -> Column:
    """Numbered extracts with their headers, in the order of the array; ``most`` cuts each text where a prompt has to be short.

    ``chunks``: structs of insurer, doc_short, section_id, page, section_title, text.
    """
    text = lambda c: c["text"] if most is None else F.substring(c["text"], 1, most)
    block = lambda c, i: F.concat(F.lit("--- Extract "), (i + 1).cast("string"), F.lit(": "), chunk_header(c["insurer"], c["doc_short"], c["section_id"], c["page"], c["section_title"]), F.lit("\n"), text(c))
    return F.when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, F.lit(NO_EXTRACTS)).otherwise(F.array_join(F.transform(chunks, block), "\n\n"))


def build_messages(system: str, question: Column, chunks: Column, switch: str | None = " /no_think") -> Column:
    """System and user messages; the system text's ``{context}`` takes the extracts, and a soft switch ends it."""
    filled = F.replace(F.lit(system), F.lit("{context}"), format_context(chunks))
    filled = filled if switch is None else F.concat(filled, F.lit(switch))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(message("system", filled), message("user", question))


def decimals(value: Column, digits: int = 6, missing: str = "Pending") -> Column:
    """Fixed decimals, or a word where the value is missing."""
    return F.when(value.isNull(), F.lit(missing)).otherwise(F.format_string(f"%.{digits}f", F.bround(value.cast("double"), digits)))


def signed(value: Column, digits: int = 3, missing: str = "—") -> Column:
    """Fixed decimals with their sign, or a word where the value is missing."""
    return F.when(value.isNull(), F.lit(missing)).otherwise(F.format_string(f"%+.{digits}f", F.bround(value.cast("double"), digits)))


def percent(value: Column, missing: str = "N/A") -> Column:
    """One decimal, ties to even, or a word where the value is missing: missing is not zero."""
    return F.when(value.isNull(), F.lit(missing)).otherwise(F.format_string("%.1f%%", F.bround(value.cast("double") * 100, 1)))


def formula_safe(cell: Column, rule: str = "first") -> Column:
    """A cell that no spreadsheet takes for a formula. Rules: ``first`` (first character, tab and return included),
    ``stripped`` (first non-space character, or a leading tab or return), ``lenient`` (first non-space character)."""
    pattern = {"first": r"^[=+\-@\t\r]", "stripped": r"^([ \t\r\n]*[=+\-@]|[\t\r])", "lenient": r"^[ \t\r\n]*[=+\-@]"}[rule]
    return F.when(F.rlike(cell, F.lit(pattern)), F.concat(F.lit("'"), cell)).otherwise(cell)


def safe_ratio(a: Column, b: Column, empty: float | None = None) -> Column:
    """``a / b``; ``empty`` where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty).cast("double"))


def median_low(x: Column) -> Column:
    """The lower of the middle values, which is always one of them."""
    return F.element_at(F.array_sort(F.collect_list(x)), F.ceil(F.count(x) / 2).cast("int"))


def digest24(*fields: tuple[str, Column]) -> Column:
    """First 24 hex digits of the SHA-256 of a JSON object with sorted keys and ``, `` and ``: `` separators."""
    parts = [F.concat(F.lit(f'"{k}": "'), v.cast("string"), F.lit('"')) for k, v in sorted(fields, key=lambda f: f[0])]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 24)


def strict_json(text: Column) -> Column:
    """Whether a text is one JSON value without repeated keys or non-finite numbers.

    The parser takes what follows a value for nothing, so the text has to parse within brackets and as a member.
    """
    within = [F.try_parse_json(F.concat(F.lit(before), text, F.lit(after))).isNotNull() for before, after in (("[", "]"), ('{"v":', "}"))]
    return F.coalesce(within[0] & within[1], F.lit(False))


def difflib_ratio(candidate: Column, protected: Column) -> Column:
    """Similarity of two texts as the standard library's SequenceMatcher gives it, in that argument order."""
    from millrace.functions import sequence

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else sequence.ratio(sequence.Text(x), sequence.Text(y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return ratio(candidate, protected)


def ratio_bounds(a: Column, b: Column, least: float) -> Column:
    """False where lengths alone rule out a ratio of ``least``: 2 * min / (a + b) bounds it."""
    x, y = F.length(a), F.length(b)
    return F.least(x, y) >= F.greatest(x, y) * (least / (2 - least))


def token_counter(tokenizer):
    """A vectorised column function that counts tokens with ``tokenizer(text) -> sequence``; built once a worker."""
    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(tokenizer(t or ""))).astype("int64")

    return count
