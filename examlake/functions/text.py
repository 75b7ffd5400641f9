"""Column builders over question text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters taken for misread glyphs; signs that no question may hold; any other sign beyond ASCII is notation.
MOJIBAKE = "[§$©¶|~<>^&•`]"
DISALLOWED = r"[\x{0900}-\x{097F}§©¶]"
NOTATION = r"[\x00-\x1F\x7F-\x{10FFFF}&&[^\n\r\t\x{0900}-\x{097F}§©¶]]"
ANY_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
LAST_SPACE = rf"[\x00-\x20\x{{00A0}}-\x{{FEFF}}&&{ANY_SPACE}]"  # the same signs; letters fail at the first test
SPACE = r"[\s ﻿]"


def worked_out(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row: filters and later columns read the values, as the optimizer does not move them past the generator."""
    held = F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("__held")
    return df.select(*[c for c in df.columns if c not in columns], held).select("*", "__held.*").drop("__held")


def once(value: Column, use) -> Column:
    """use(value) with value computed once, though use may name it several times."""
    return F.get(F.transform(F.array(value), use), 0)


def english_only(text: Column) -> Column:
    """Devanagari and misread glyphs become spaces; lines are squeezed, trimmed, and dropped when blank."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[ऀ-ॿ]+", " "), MOJIBAKE, " ")
    lines = F.transform(F.split(clean, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, f"^{ANY_SPACE}+|{LAST_SPACE}+$", ""), "[ \t]+", " "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def letters(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, "[A-Za-z]+", ""))


def letter_ratio(text: Column) -> Column:
    solid = F.length(F.regexp_replace(text, f"{SPACE}+", ""))
    return F.when(solid > 0, letters(text) / solid).otherwise(F.lit(0.0))


def readability(text: Column) -> Column:
    """12 a word of three letters or more, 40 times the letter share, less 8 a misread glyph."""
    return F.regexp_count(text, F.lit("[A-Za-z]{3,}")) * 12 + letter_ratio(text) * 40 - F.regexp_count(text, F.lit(MOJIBAKE)) * 8


def comparable(text: Column) -> Column:
    """Lower case, white space as one blank, then every sign but letters, digits and underscores deleted: don't -> dont."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), f"{SPACE}+", " "), r"[^\w ]+", ""))


def key_words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(comparable(text), " "), lambda w: F.length(w) > 3))


def jaccard(a: Column, b: Column) -> Column:
    """Share of two word sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.size(F.array_union(a, b)))


def disallowed(text: Column) -> Column:
    """How many signs a text has that no question may hold."""
    return F.regexp_count(text, F.lit(DISALLOWED))


def accepts_model_text(text: Column) -> Column:
    """True for English prose of 10 characters or more, with fewer letters where there is notation."""
    need = F.when(text.rlike(NOTATION), 0.30).otherwise(0.45)
    return (F.length(text) >= 10) & ~text.rlike(DISALLOWED) & (letter_ratio(text) >= need) & (F.regexp_count(text, F.lit("[A-Za-z]{2,}")) >= 2)


def accepts_plain_text(text: Column) -> Column:
    """True for text that reads as English: stricter than `accepts_model_text`, for what was cut out by rules."""
    clean = ~text.rlike(DISALLOWED) & ~text.rlike(MOJIBAKE)
    read = F.struct(text.rlike(NOTATION).alias("math"), letter_ratio(text).alias("ratio"), F.regexp_count(text, F.lit("[A-Za-z]{3,}")).alias("words"))

    def reads(r: Column) -> Column:
        # a clean text has no misread glyph, so that is its `readability`
        return (r["ratio"] >= F.when(r["math"], 0.35).otherwise(0.55)) & (r["math"] | (r["words"] >= 2)) & (r["math"] | (r["words"] * 12 + r["ratio"] * 40 >= 18))

    return (F.length(text) >= 12) & clean & once(read, reads)


def marks_in_text(text: Column) -> Column:
    """Marks, a double, written as [n marks], (n marks), 'n marks' at a line's end, or [n]; fractions inside brackets only."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in MARKS]
    return F.coalesce(*found).cast("double")


def stated_total(text: Column, patterns: list[str]) -> Column:
    """The first pattern's number that lies within 1 to 500."""
    numbers = [F.try_to_number(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit("999999")).cast("int") for p in patterns]
    return F.coalesce(*[F.when(n.between(1, 500), n) for n in numbers])


def default_marks(no: Column) -> Column:
    """The usual section marks of a 33-question paper."""
    return F.when(no.between(1, 16), 1).when(no.between(17, 21), 2).when(no.between(22, 28), 3).when(no.between(29, 30), 4).when(no.between(31, 33), 5)


def split_numbered(no: Column, text: Column) -> Column:
    """array<struct<no, text>>: a text cut before line-start numbers `n.`, white space, and A-Z, a quote or a bracket.

    Parts lose their number; the head has `no` and loses a number too. Without a cut the text stays as it is.
    """
    def part(x: Column, i: Column) -> Column:
        own = F.nullif(F.regexp_extract(x, r"^(\d{1,2})\.", 1), F.lit("")).cast("int")
        return F.struct(F.when(i == 0, no).otherwise(own).alias("no"), without_number(x).alias("text"))

    def cut(parts: Column) -> Column:
        whole = F.array(F.struct(no.alias("no"), text.alias("text")))
        return F.when(F.size(parts) > 1, F.filter(F.transform(parts, part), lambda x: F.length(x["text"]) > 8)).otherwise(whole)

    return once(F.split(strip(text), r"\n(?=\d{1,2}\.\s+[A-Z\"(])"), cut)


def without_number(text: Column) -> Column:
    """text without white space around it and without a leading `n.`; a bare number stays."""
    return strip(F.regexp_replace(strip(text), r"^\d{1,2}\.\s+", ""))


def repair_escapes(text: Column) -> Column:
    r"""Doubles the backslash of a \u that four hex digits don't follow; drops NUL."""
    put = F.regexp_replace(F.regexp_replace(text, r"\\u(?![0-9a-fA-F]{4})", r"\\\\u"), "\u0000", "")
    return F.when(F.contains(text, F.lit("\\u")) | F.contains(text, F.lit("\u0000")), put).otherwise(text)


def clamp(x: Column, low: float, high: float) -> Column:
    """x held to low..high; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def percent(x: Column) -> Column:
    """0 to 100, halves rounded up; null counts as 0, text that is no number and NaN give null."""
    n = x.try_cast("double")
    held = F.when(~F.isnan(n), F.floor(clamp(n, 0, 100) + 0.5).cast("int"))
    return F.when(x.isNull(), 0).otherwise(held)


def review_tier(confidence: Column) -> Column:
    """high, medium or low, by the bounds of `review_status`."""
    return F.when(F.isnan(confidence), "low").when(confidence >= 0.85, "high").when(confidence >= 0.6, "medium").otherwise("low")


def review_status(confidence: Column) -> Column:
    return F.when(F.isnan(confidence), "MANUAL_REVIEW_REQUIRED").when(confidence >= 0.85, "AUTO_APPROVED").when(confidence >= 0.6, "SUGGEST_REVIEW").otherwise("MANUAL_REVIEW_REQUIRED")


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty, of another length or of norm 0."""
    add = lambda acc, x: acc + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), add))
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot / size).otherwise(F.lit(0.0))


def ranges(numbers: Column) -> Column:
    """Sorted distinct numbers as '22-25, 31': runs by their first and last number."""
    first = F.filter(numbers, lambda x: ~F.array_contains(numbers, x - 1))
    last = F.filter(numbers, lambda x: ~F.array_contains(numbers, x + 1))
    return F.array_join(F.zip_with(first, last, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))), ", ")


def strip(text: Column) -> Column:
    """White space off both ends, line breaks too."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def notation(text: Column, strict: bool = True) -> Column:
    r"""Physics signs in one spelling: \vec{E}, \hat{i}, E₀, \frac{R}{μ−1}.

    `strict` leaves doubtful readings of stacked fractions as they are.
    """
    rules = [*VECTORS, *SUBSCRIPTS, *UNIT_VECTORS, *([] if strict else MISREAD_FRACTIONS), *PLAIN_FRACTIONS]
    out = text
    for pattern, put in rules:
        out = F.regexp_replace(out, pattern, put)
    return F.when(text.rlike(ANY_SIGN), out).otherwise(text) if strict else out


#: Spellings of signs, as (pattern, replacement), applied in this order.
VECTORS = [
    ("\r\n", "\n"),
    (r"\b([A-Za-z])\x{FE00}?\x{20D7}", r"\\vec{$1}"),
    (r"\b([A-Za-z])\s*→(?=\s*=)", r"\\vec{$1}"),
    (r"\b([A-Za-z])\s+→(?=\s)", r"\\vec{$1} "),
    (r"(?i)\belectric field\s+([A-Za-z])\s*→", r"electric field \\vec{$1}"),
]
SUBSCRIPTS = [(r"([A-Za-zμελρσπ])0(?=[\s=^²³⁰⁻⁺₀₁₂₃₄₅₆₇₈₉]|$)", "$1₀")]
UNIT_VECTORS = [
    ("î", r"\\hat{i}"),
    ("ĵ", r"\\hat{j}"),
    ("k̂", r"\\hat{k}"),
    (r"(?i)\bi\s*(?:hat|\^|\x{0302})", r"\\hat{i}"),
    (r"(?i)\bj\s*(?:hat|\^|\x{0302})", r"\\hat{j}"),
    (r"(?i)\bk\s*(?:hat|\^|\x{0302})", r"\\hat{k}"),
]
#: Some of this is in every text that the rules above, or the last one, change; most texts hold none of it.
ANY_SIGN = r"(?=[\r^0ijkIJKR\x{80}-\x{FFFF}])(?:[\r→\x{20D7}îĵ\x{0302}^]|(?<=[A-Za-zμελρσπ])0|\b[ijkIJK]\s*(?i:hat)|R/\(μ)"
MISREAD_FRACTIONS = [
    (r"(?i)\(A\)\s*R\s*[-–—]\s*1/μ", r"(A) \\frac{R}{μ−1}"),
    (r"(?i)\(B\)\s*R\s*[-–—]\s*-?\s*1/μ", r"(B) \\frac{−R}{μ−1}"),
    (r"(?i)\(C\)\s*2R\s*[-–—]\s*1/μ", r"(C) \\frac{2R}{μ−1}"),
    (r"(?i)\(D\)\s*2R\s*[-–—]\s*-?\s*1/μ", r"(D) \\frac{−2R}{μ−1}"),
    (r"2nπ\s*\+\s*4π", r"2nπ + \\frac{π}{4}"),
    (r"2nπ\s*\+\s*2π(?!\s*/)", r"2nπ + \\frac{π}{2}"),
]
PLAIN_FRACTIONS = [(r"(?<!\\frac\{)([−-]?[0-9]?R)/\(μ[−-]1\)", r"\\frac{$1}{μ−1}")]

#: How marks are written, in this order.
MARKS = (r"(?i)\[(\d+(?:\.\d+)?)\s*marks?\]", r"(?i)\((\d+(?:\.\d+)?)\s*marks?\)", r"(?im)(\d+)\s*marks?\s*$", r"\[(\d+(?:\.\d+)?)\]")

#: How section rules are written, starts of questions, of sub-parts and of their later parts.
SECTION_RULES = (
    r"(?is)Section\s+([A-E])\s*[–—-].*?Questions?\s*(?:no\.?\s*)?(\d{1,2})\s*(?:to|-)\s*(\d{1,2}).*?carries?\s*(\d{1,2})\s*marks?",
    r"(?is)Section\s+([A-E]).*?(\d{1,2})\s*(?:to|-)\s*(\d{1,2}).*?(\d{1,2})\s*marks?\s*each",
)
SUB_PART = r"(?i)^\s*\((?:i{1,3}|iv|v|vi{0,3}|ix|x|xi{0,3}|[a-d])\)\s"
EARLY_PART, LATER_PART = r"(?i)\([ia]\)\s", r"(?i)\((?:iii|iv|v|vi|vii|viii|ix|x)\)\s"
MARKED_START = r"(?i)(?=(?:^|\n)\s*(?:\(?\d{1,2}\)?[).:]\s+(?=[A-Za-z(\"'])|Q(?:uestion)?\.?\s*\d+|Question\s+\d+))"
NUMBERED_START = r"(?=(?:^|[\n\r])\s*\d{1,2}\.\s+(?=[A-Za-z(\"']))"
QUESTION_NUMBER = r"(?i)^(?:\(?(\d{1,2})\)?[).:]\s*|Q(?:uestion)?\.?\s*(\d+)\s*[:.\-]?\s*)"
PAGE_MARK = "\n\n---PAGE---\n\n"


def section_rules(text: Column) -> Column:
    """array<struct<from, to, section, marks>> read off printed instructions, by first number.

    The last rule written for a section holds, those of the second spelling after the first's.
    """
    empty = F.expr("cast(array() as array<struct<section:string,from:int,to:int,marks:int>>)")

    def read(pattern: str) -> Column:
        def rule(hit: Column) -> Column:
            a, b = (F.regexp_extract(hit, pattern, i).cast("int") for i in (2, 3))
            return F.struct(F.upper(F.regexp_extract(hit, pattern, 1)).alias("section"), F.least(a, b).alias("from"), F.greatest(a, b).alias("to"), F.regexp_extract(hit, pattern, 4).cast("int").alias("marks"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), rule)

    found = F.concat(*[F.coalesce(read(p), empty) for p in SECTION_RULES])
    last = F.aggregate(found, empty, lambda held, r: F.concat(F.filter(held, lambda h: h["section"] != r["section"]), F.array(r)))
    return F.array_sort(F.transform(last, lambda r: F.struct(r["from"].alias("from"), r["to"].alias("to"), r["section"].alias("section"), r["marks"].alias("marks"))))


def marks_by_rules(no: Column, rules: Column) -> Column:
    """Marks of the first rule whose numbers hold `no`; the usual section marks where there are no rules."""
    fitting = F.filter(rules, lambda r: no.between(r["from"], r["to"]))
    return F.when(F.size(F.coalesce(rules, F.array())) > 0, F.try_element_at(fitting, F.lit(1))["marks"]).otherwise(default_marks(no))


def is_sub_part(text: Column) -> Column:
    """True for a text that goes on with a question begun before: (ii) ... or (b) ..."""
    return F.coalesce(text.rlike(SUB_PART), F.lit(False))


def looks_unfinished(no: Column, text: Column) -> Column:
    """True where later parts are to be expected, or a long text of number 29 or more just breaks off."""
    early = text.rlike(EARLY_PART) & ~text.rlike(LATER_PART)
    half = text.rlike(r"(?i)\(a\)\s") & ~text.rlike(r"(?i)\(b\)\s")
    cut = (F.length(text) > 200) & ~strip(text).rlike(r"[.?:]\s*$") & (no >= 29)
    return F.coalesce(early | half | cut, F.lit(False))


def _parts(text: Column, pattern: str, least: int = 1) -> Column:
    return F.filter(F.transform(F.split(text, pattern), strip), lambda p: F.length(p) >= least)


def question_chunks(text: Column) -> Column:
    """Plain text cut into questions by the first way that finds two or more, else the whole.

    Ways: marked starts, numbered starts, numbered starts inside pages, blank lines, numbered lines. A
    way is tried only where the ones before it failed, and its cut is made once.
    """
    clean = strip(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[ \t]+\n", "\n"))
    none = F.array().cast("array<string>")

    def of_page(page: Column) -> Column:
        return once(_parts(page, NUMBERED_START, 20), lambda cut: F.when(F.size(cut) > 1, cut).when(F.length(page) >= 30, F.array(page)).otherwise(none))

    def cut(t: Column) -> Column:
        ways = [
            _parts(t, MARKED_START),
            _parts(t, NUMBERED_START),
            once(_parts(t, PAGE_MARK), lambda pages: F.when(F.size(pages) > 1, F.flatten(F.transform(pages, of_page)))),
            _parts(t, r"\n{2,}"),
            F.filter(_parts(t, r"\n", 20), lambda p: p.rlike(r"^\d{1,2}\.\s")),
        ]
        return F.coalesce(*[once(w, lambda x: F.when(F.size(x) > 1, x)) for w in ways], F.when(t != "", F.array(t)), none)

    return once(clean, cut)


def chunk_number(chunk: Column, position: Column) -> Column:
    """The number that a chunk starts with, else its 1-based position."""
    found = [F.nullif(F.regexp_extract(chunk, QUESTION_NUMBER, i), F.lit("")).try_cast("int") for i in (1, 2)]
    return F.coalesce(*found, position + 1)
