"""One row a question: fragments joined to their question, copies merged, repeats inside a text removed."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from examlake.functions import text as T
from examlake.operators.bank import near_duplicate_pairs
from examlake.operators.folds import Fold, fold_sorted, typed
from examlake.operators.scans import keys_of, paper_order, set_key, set_order
from examlake.sources.written import written

#: Word-set shares from which texts count as the same question, copy, or repeated section; lengths.
SAME_TEXT, SAME_QUESTION, SAME_BLOCK = 0.35, 0.38, 0.42
LONG_TEXT, SHORTEST_PART = 850, 8
FIGURE_NUMBERS = (17, 28)
#: Option lines, roman sub-parts, a line that opens a stem: option (A), or a capital, quote or bracket that is no option and runs on or ends as a question.
_OPTION_A, _OPTION_D = re.compile(r"^\(A\)", re.M), re.compile(r"^\(D\)", re.M)
_ROMAN = re.compile(r"\([ivx]+\)", re.I)
_STEM = re.compile(r"\s*(?:\([Aa]\)\s|(?!\([A-D]\)|\((?i:[ivx]+)\)|\.\.\.)[A-Z\"'(](?:.*[?:]\s*$|.{40}))")
_SECTION = re.compile(r"\n[ \t]*\n|\n(?=\.\.\.)")
_MANY = re.compile(r"\n[ \t]*\n|\n\.\.\.|^\(D\)", re.M)
_NOT_WORD, _SUB_PART = re.compile(r"[^a-z0-9_\s]"), re.compile(T.SUB_PART)


#: Fixed value: a line that starts a question, 1 to 40, and no sub-part.
_NUMBERED_LINE = r"[^\S\n]*(?:0?[1-9]|[1-3]\d|40)\.[^\S\n]+(?!(?i:\([a-d]\)|\([ivx]+\)))\S"


@dataclass(frozen=True)
class Telling:
    """A text and what merging asks of it; each is worked out when first asked for, and once."""

    text: str
    marked: bool = False  # its marks are known

    @staticmethod
    def of(text: str, marks: float | None = None) -> Telling:
        return Telling(text, bool(marks and marks > 0))

    @cached_property
    def _plain(self) -> str:
        return " ".join(self.text.lower().split())

    @cached_property
    def words(self) -> frozenset:
        return frozenset(w for w in set(_NOT_WORD.sub("", self._plain).split()) if len(w) > 3)

    @cached_property
    def head(self) -> str:
        """How it begins, for texts that break off."""
        return self._plain[:120]

    @cached_property
    def options(self) -> bool:
        """True for a full set of options."""
        return bool(_OPTION_A.search(self.text) and _OPTION_D.search(self.text))

    @cached_property
    def studies(self) -> int:
        """Roman sub-parts."""
        return len(_ROMAN.findall(self.text))

    @cached_property
    def score(self) -> int:
        """The better of two has more."""
        return len(self.text) + (50 if self.marked else 0) + (30 if self.options else 0) - (40 if self.text.lstrip().startswith("...") else 0)

    def share(self, other: Telling) -> float:
        both = len(self.words & other.words)
        return both / (len(self.words) + len(other.words) - both) if both else 0.0

    def same_matter(self, other: Telling) -> bool:
        """True where both tell the same, or one begins inside the beginning of the other."""
        heads = bool(self.head and other.head) and (self.head[:40] in other.head or other.head[:40] in self.head)
        return heads or self.share(other) >= SAME_TEXT


def better(a: Telling, b: Telling) -> Telling:
    return b if b.score > a.score else a


def joined(base: str, more: str) -> str:
    """base with more behind it, or the better of the two where they tell the same."""
    base, more = base.rstrip(), more.strip()
    if not (base and more):
        return base or more
    a, b = Telling.of(base.strip()), Telling.of(more)
    return better(a, b).text if a.same_matter(b) else f"{base}\n{more}"


def sections(text: str) -> Iterator[str]:
    """Parts between blank lines, before '...', and from one full set of options to the next stem."""
    for piece in _SECTION.split(text):
        part: list[str] = []
        first = last = studies = False
        for line in piece.split("\n"):
            if not line.strip():
                continue
            if first and last and not studies and _STEM.match(line):
                yield "\n".join(part)
                part, first, last = [], False, False
            part.append(line)
            first, last, studies = first or line.startswith("(A)"), last or line.startswith("(D)"), studies or bool(_ROMAN.search(line))
        if part:
            yield "\n".join(part)


class _Kept:
    """Different sections so far. The first that a new one is like is looked for among those that share one of its rarest words."""

    def __init__(self) -> None:
        self.told: list[Telling] = []
        self.having: dict[str, set[int]] = {}

    def _like(self, new: Telling) -> int | None:
        # a like section holds SAME_BLOCK of the new one's words or more, so it can't miss all of the rarest n - SAME_BLOCK * n + 1
        n = len(new.words)
        rare = sorted(new.words, key=lambda w: len(self.having.get(w, ())))[: n - math.ceil(SAME_BLOCK * n - 1e-9) + 1]
        some = set().union(*[self.having.get(w, ()) for w in rare])
        fitting = lambda m: m >= SAME_BLOCK * n - 1e-9 and n >= SAME_BLOCK * m - 1e-9
        return min((i for i in some if fitting(len(self.told[i].words)) and self.told[i].share(new) >= SAME_BLOCK), default=None)

    def add(self, new: Telling) -> None:
        i = self._like(new)
        if i is None:
            i = len(self.told)
            self.told.append(new)
        elif better(self.told[i], new) is new:
            for w in self.told[i].words:
                self.having[w].discard(i)
            self.told[i] = new
        else:
            return
        for w in new.words:
            self.having.setdefault(w, set()).add(i)


def without_repeats(text: str) -> str:
    """The one section that tells the question, where its stem or options were written twice.

    Like sections become the better one. Of several left it is the first case study (two sub-parts or
    more), else the first full multiple choice if there are two, else the best.
    """
    if not _MANY.search(text):
        return text.strip()
    held, parts = _Kept(), 0
    for told in map(Telling.of, sections(text.strip())):
        held.add(told)
        parts += 1
    kept = held.told
    if len(kept) < 2:
        return kept[0].text.strip() if parts > 1 else text.strip()
    studies = next((k for k in kept if k.studies > 1), None)
    if studies:
        return studies.text.strip()
    full = [k for k in kept if k.options and not k.text.lstrip().startswith("...") and len(k.text.strip().split("\n")[0]) > 25]
    return (min(full, key=lambda k: text.find(k.text)) if len(full) > 1 else max(kept, key=lambda k: k.score)).text.strip()


#: Texts without one of these have one section.
_MANY_SECTIONS = r"\n[ \t]*\n|\n\.\.\.|(?m)^\(D\)"
#: Texts without these are no sub-part, and are not cut where a line starts with a number; ends at which Java and Python see the same white space.
_MAY_BE_PART, _CUT, _PLAIN_EDGES = r"^\W*\(", r"\n\d{1,2}\.\s+[A-Z\"(]", r"^\s*[!-~](?s:.*[!-~])?\s*$"
RULES = "array<struct<from:int,to:int,section:string,marks:int>>"


@F.pandas_udf(StringType())
def _without_repeats(texts: pd.Series) -> pd.Series:
    return texts.map(without_repeats, na_action="ignore")


def without_repeats_column(text: Column) -> Column:
    """`without_repeats` of a column; texts of one section, most of them, are not sent to Python."""
    many = F.coalesce(text.rlike(_MANY_SECTIONS), F.lit(False))
    return F.when(many, _without_repeats(F.when(many, text))).otherwise(T.strip(text))


@dataclass(frozen=True)
class Standing:
    """What stands for a question so far: its text, whether that is a sub-part only, and the row it came from."""

    told: Telling
    part: bool
    marks: float | None
    figure: bool
    row: tuple

    @staticmethod
    def of(row) -> Standing:
        text, marks = row.question_text or "", getattr(row, "marks", None)
        marks = None if marks is None else float(marks)
        return Standing(Telling.of(text, marks), bool(_SUB_PART.match(text.strip())), marks, bool(getattr(row, "has_figure", False)), row)

    def saying(self, text: str, marks: float | None, figure: bool) -> Standing:
        told = Telling.of(text, marks)
        return Standing(self.told if told == self.told else told, self.part, marks, figure, self.row)


def met(a: Standing, b: Standing) -> Standing:
    """One of two for the same question, a the earlier.

    Texts that tell the same, and two whole questions, leave the better, of equals the earlier. A
    sub-part goes behind its question, whichever comes first; of two sub-parts the later goes behind
    the earlier. Marks are those of the text in front, or of the earlier where one text stands, else the
    other's; a figure of either counts.
    """
    figure = a.figure or b.figure
    if not (a.part or b.part) or a.told.share(b.told) >= SAME_QUESTION:
        stands = b if better(a.told, b.told) is b.told else a
        return stands.saying(stands.told.text, b.marks if a.marks is None else a.marks, figure)
    front, behind = (b, a) if a.part and not b.part else (a, b)
    text = joined(front.told.text, behind.told.text)
    return front.saying(without_repeats(text) if a.part and b.part else text, behind.marks if front.marks is None else front.marks, figure)


class _Merge(Fold):
    """Rows of one question, met in order; the row that stands keeps its other columns."""

    def __init__(self, clean: bool, names: list[str]) -> None:
        self.clean, self.names, self.now = clean, names, None

    def feed(self, row) -> list[tuple]:
        new = Standing.of(row)
        self.now = met(self.now, new) if self.now else new
        return []

    def end(self) -> list[tuple]:
        text = without_repeats(self.now.told.text) if self.clean else self.now.told.text
        put = {"question_text": text, "marks": self.now.marks, "has_figure": self.now.figure}
        return [tuple(put.get(n, getattr(self.now.row, n)) for n in self.names)]


def merge_rows(rows: DataFrame, keys: list[str], clean: bool = False) -> DataFrame:
    """One row for each of keys: its rows met pairwise by row_order (see `met`); `clean` removes repeats inside the texts.

    Columns beside question_text, marks (a double) and has_figure come from the row whose text stands,
    or stands in front. Keys of one row, for `clean` with one section, pass by in the JVM.
    """
    if "marks" in rows.columns:
        rows = rows.withColumn("marks", F.col("marks").cast("double"))
    names = rows.columns
    of_key = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    many = F.col("question_text").rlike(_MANY_SECTIONS) if clean else F.lit(False)
    marked = written(rows.withColumn("__simple", (of_key == 1) & ~F.coalesce(many, F.lit(False))), "marked")
    folded = fold_sorted(marked.where(~F.col("__simple")).drop("__simple"), keys, ["row_order", "question_text"], typed(rows, names), lambda: _Merge(clean, names))
    alone = marked.where("__simple").drop("__simple")
    return folded.unionByName(alone.withColumn("question_text", T.strip(F.col("question_text"))) if clean else alone)


def _merge_by_number(rows: DataFrame) -> DataFrame:
    keys = [*keys_of(rows), "question_no"]
    rows = rows.select(*keys, "question_text", "marks", F.coalesce("has_figure", F.lit(False)).alias("has_figure"), "row_order")
    return merge_rows(rows, keys, clean=True)


def merge_questions(questions: DataFrame) -> DataFrame:
    """One row for each paper and number: paper_id, question_no, question_text, marks, has_figure, row_order.

    Rows are read by row_order, which is unique in a paper, and those of one question met pairwise in
    that order. A sub-part, (ii) or (b), goes to the question opened last before it and takes its
    number; a paper's first row opens one whatever it is. Rows without text are dropped; a null number
    is a number of its own.
    """
    keys = keys_of(questions)
    by_order = Window.partitionBy(*keys).orderBy("row_order")
    rows = questions.where(F.col("question_text").rlike(r"\S"))
    rows = rows.withColumn("__main", ~T.is_sub_part(F.col("question_text")) | (F.row_number().over(by_order) == 1))
    same = Window.partitionBy(*keys, "question_no", "__main").orderBy("row_order")
    rows = rows.withColumn("__opens", F.col("__main") & (F.row_number().over(same) == 1))
    opened = F.last(F.when(F.col("__opens"), F.struct("question_no")), ignorenulls=True).over(by_order)
    rows = rows.withColumn("__to", opened).withColumn("question_no", F.when(F.col("__main"), F.col("question_no")).otherwise(F.col("__to.question_no")))
    return _merge_by_number(rows)


def split_long_rows(questions: DataFrame) -> DataFrame:
    """questions with embedded ones as rows of their own; in rows of 850 characters or more, also lines that start `n.`

    The latter holds for numbers 17 to 28 only, and not before a sub-part, (a) or (iv); lines before
    the first start are dropped. Other columns are repeated on each part.
    """
    rows = T.worked_out(questions, __text=T.strip(F.col("question_text")))
    text, no = F.col("__text"), F.col("question_no")
    rows = T.worked_out(rows, __cut=T.split_numbered(no, text), __lines=F.filter(F.split(text, rf"\n(?={_NUMBERED_LINE})"), lambda p: p.rlike(rf"^{_NUMBERED_LINE}")))
    cut, by_line = F.col("__cut"), F.col("__lines")
    parts = F.transform(by_line, lambda p: F.struct(F.regexp_extract(p, r"^\s*(\d{1,2})", 1).cast("int").alias("no"), T.without_number(p).alias("text")))
    parts = F.filter(parts, lambda p: F.length(p["text"]) > SHORTEST_PART)
    long = (F.length(text) >= LONG_TEXT) & no.between(*FIGURE_NUMBERS) & (F.size(cut) <= 1) & (F.size(by_line) > 1)
    whole = F.array(F.struct(no.alias("no"), text.alias("text")))
    chosen = F.when(F.size(cut) > 1, cut).when(long, parts).otherwise(whole)
    questions = rows
    rest = [c for c in questions.columns if c not in ("question_no", "question_text", "__text", "__cut", "__lines")]
    return questions.select(*rest, F.explode(chosen).alias("__p")).select(*rest, F.col("__p.no").alias("question_no"), F.col("__p.text").alias("question_text"))


def _seen_by_number(questions: DataFrame) -> DataFrame:
    """Rows with text, written, with __odd: true for papers in which merging or cutting has more to do than to drop copies.

    A paper is not odd if no text may be a sub-part, has several sections or a line that may start a
    question, and rows of one number have one text and one value of marks: its first row by row_order
    then stands. Of such papers only these rows are left, with a figure if any copy has one, and none
    without a number.
    """
    keys, text, no = keys_of(questions), F.col("question_text"), F.col("question_no")
    rows = questions.where(text.rlike(r"\S")).select(*keys, "question_no", "question_text", F.col("marks").cast("double").alias("marks"), F.coalesce("has_figure", F.lit(False)).alias("has_figure"), "row_order")
    long = (F.length(text) >= LONG_TEXT) & no.between(*FIGURE_NUMBERS)
    lines = F.contains(text, F.lit("\n")) & (text.rlike(_MANY_SECTIONS) | text.rlike(_CUT) | long)
    rows = rows.repartition(*keys).withColumn("__odd", text.rlike(_MAY_BE_PART) | F.coalesce(lines, F.lit(False)))
    of_number = Window.partitionBy(*keys, "question_no")
    rows = rows.withColumn("__place", F.row_number().over(of_number.orderBy("row_order", "question_text")))
    held = {"n": F.count(F.lit(1)), "low": F.min("question_text"), "high": F.max("question_text"), "marked": F.count("marks"), "least": F.min("marks"), "most": F.max("marks"), "figure": F.max("has_figure")}
    rows = rows.withColumns({f"__{name}": c.over(of_number) for name, c in held.items()})
    marks = (F.col("__marked") == 0) | ((F.col("__marked") == F.col("__n")) & (F.col("__least") == F.col("__most")) & ~F.isnan("__most"))
    one = (F.col("__n") == 1) | ((F.col("__low") == F.col("__high")) & marks & text.rlike(_PLAIN_EDGES))
    rows = rows.withColumn("__odd", F.max(F.col("__odd") | ~one).over(Window.partitionBy(*keys)))
    kept = rows.where(F.col("__odd") | ((F.col("__place") == 1) & no.isNotNull()))
    figure = F.when(F.col("__odd"), F.col("has_figure")).otherwise(F.col("__figure"))
    return written(kept.select(*keys, "question_no", "question_text", "marks", figure.alias("has_figure"), "row_order", "__odd"), "seen")


def finalize_questions(questions: DataFrame, papers: DataFrame, hold: bool = False) -> DataFrame:
    """merge_questions, embedded questions split off, numbers merged again, marks filled by the paper's rules.

    papers: paper_id, instructions (null, or no such column: the usual sections). Rows without a number
    are dropped; one row a number is left. Papers that only hold copies pass by (see `_seen_by_number`).
    With `hold` what was merged is written too, so the result may be read several times.
    """
    seen = _seen_by_number(questions)
    rows = seen.where("not __odd").drop("__odd").withColumn("question_text", T.strip(F.col("question_text")))
    odd = seen.where("__odd").drop("__odd")
    if not odd.isEmpty():
        parts = split_long_rows(merge_questions(odd)).where(F.col("question_no").isNotNull())
        merged = _merge_by_number(parts)
        rows = rows.unionByName(written(merged, "merged") if hold else merged)
    if "instructions" not in papers.columns:
        return infer_marks(rows, F.array().cast(RULES))
    keys = keys_of(rows, papers)
    rules = papers.where("instructions is not null").select(*keys, T.section_rules(F.col("instructions")).alias("__rules"))
    return infer_marks(rows.join(rules, keys, "left"), F.col("__rules")).drop("__rules")


def infer_marks(questions: DataFrame, rules) -> DataFrame:
    """questions whose marks, where null or not above 0, come from rules; marks_inferred tells which."""
    known = F.coalesce(F.col("marks") > 0, F.lit(False))
    found = T.marks_by_rules(F.col("question_no"), rules).cast("double")
    out = questions.withColumn("marks_inferred", ~known & found.isNotNull())
    return out.withColumn("marks", F.when(known, F.col("marks")).otherwise(F.coalesce(found, F.col("marks"))))


class _Greedy(Fold):
    """Fed pairs (place, earlier) by place: a place is dropped if one of its like earlier places was kept."""

    def __init__(self) -> None:
        self.key, self.place, self.hit, self.dropped = None, None, False, set()

    def _decided(self) -> list[tuple]:
        if not self.hit:
            return []
        self.dropped.add(self.place)
        return [(*self.key, self.place)]

    def feed(self, row) -> list[tuple]:
        out = []
        if row.place != self.place:
            out = self._decided()
            self.key, self.place, self.hit = tuple(getattr(row, k) for k in row._fields if k in ("owner_id", "paper_id")), row.place, False
        self.hit |= row.earlier not in self.dropped
        return out

    def end(self) -> list[tuple]:
        return self._decided()


def best_per_number(questions: DataFrame) -> DataFrame:
    """One row for each paper, set (series:set:code, where questions have them) and number: the best, of equals the first.

    A longer text is better; known marks count 50 characters, notation 10. A null number is one number.
    """
    keys = keys_of(questions)
    score = F.length(F.coalesce("question_text", F.lit(""))) + F.when(F.col("marks") > 0, 50).otherwise(0) + F.when(F.col("question_text").rlike(T.NOTATION), 10).otherwise(0)
    sets = [set_key()] if {"series", "set", "code_no"} <= set(questions.columns) else []
    best = Window.partitionBy(*keys, *sets, "question_no").orderBy(F.desc(score), "row_order")
    return questions.withColumn("__rn", F.row_number().over(best)).where("__rn = 1").drop("__rn")


def drop_near_copies(questions: DataFrame, threshold: float = 0.72) -> DataFrame:
    """The best row of each number, without rows that are like an earlier kept row of their paper (Jaccard of word sets).

    Rows are read by set, then number (unknown last), then row_order. Of rows with one word set the
    first stands for all: whatever drops it drops the others, and it drops them if it is kept. Only
    like pairs of such firsts enter the ordered pass.
    """
    keys = keys_of(questions)
    has_sets = {"series", "set", "code_no"} <= set(questions.columns)
    order = Window.partitionBy(*keys).orderBy(*(set_order() if has_sets else paper_order()), "row_order")
    placed = written(best_per_number(questions).withColumn("__place", F.row_number().over(order).cast("long")), "placed")
    pairs = near_duplicate_pairs(placed.select(*keys, F.col("__place").alias("row_order"), "question_text"), threshold)
    like = pairs.where("kind = 'like'").select(*keys, F.col("row_b").alias("place"), F.col("row_a").alias("earlier"))
    schema = ", ".join([*[f"{k} {questions.schema[k].dataType.simpleString()}" for k in keys], "place long"])
    gone = fold_sorted(like, keys, ["place", "earlier"], schema, _Greedy)
    copies = pairs.where("kind = 'copy'").select(*keys, F.col("row_b").alias("place"))
    return placed.join(gone.unionByName(copies).withColumnRenamed("place", "__place"), [*keys, "__place"], "left_anti").select(*questions.columns)


class _Continue(Fold):
    """Puts a question's continuations, in order, behind its text; repeats that arise are removed."""

    def __init__(self) -> None:
        self.key, self.text = None, None

    def feed(self, row) -> list[tuple]:
        self.key = row[:-3]
        if self.text is None:
            self.text = row.text or "" if row.place == 0 else row.text.strip()
        else:
            self.text = without_repeats(joined(self.text, row.text))
        return []

    def end(self) -> list[tuple]:
        return [(*self.key, self.text)]


def continue_questions(questions: DataFrame, continuations: DataFrame) -> DataFrame:
    """Paper keys, question_no, question_text with continuations (paper keys, question_no, pos, append_text) worked in.

    A continuation that tells what the question tells already leaves the better of both; any other is
    put behind it. A number that the paper lacks becomes a row of its own. Blank texts and null numbers
    among the continuations are passed over; questions are unique on the paper keys and question_no.
    """
    keys = [*keys_of(questions, continuations), "question_no"]
    base = questions.select(*keys, F.lit(0).alias("place"), F.lit(0).cast("long").alias("pos"), F.col("question_text").alias("text"))
    more = continuations.where(F.col("question_no").isNotNull() & F.col("append_text").rlike(r"\S"))
    more = more.select(*keys, F.lit(1).alias("place"), F.col("pos").cast("long").alias("pos"), F.col("append_text").alias("text"))
    return fold_sorted(base.unionByName(more), keys, ["place", "pos", "text"], typed(base, keys, "question_text string"), _Continue)
