"""Table functions for SQL: SELECT ... FROM papers, LATERAL question_chunks(text)."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from examlake.functions.text import MARKED_START, NUMBERED_START, PAGE_MARK, QUESTION_NUMBER

_MARKED, _NUMBERED, _NO = (re.compile(p, re.A) for p in (MARKED_START, NUMBERED_START, QUESTION_NUMBER))
_EDGES, _LINE, _BLANKS = re.compile(r"^\s+|\s+$", re.A), re.compile(r"\d{1,2}\.\s", re.A), re.compile(r"\n{2,}")


def _parts(pattern: re.Pattern, text: str, least: int = 1) -> list[str]:
    return [p for p in (_EDGES.sub("", x) for x in pattern.split(text)) if len(p) >= least]


def cut_questions(text: str) -> list[str]:
    """The chunks of `text.question_chunks`."""
    whole = _EDGES.sub("", re.sub(r"[ \t]+\n", "\n", text.replace("\r\n", "\n")))

    def of_pages() -> list[str]:
        pages, out = _parts(re.compile(re.escape(PAGE_MARK)), whole), []
        for page in pages if len(pages) > 1 else ():
            cut = _parts(_NUMBERED, page, 20)
            out += cut if len(cut) > 1 else [page] if len(page) >= 30 else []
        return out

    ways = (lambda: _parts(_MARKED, whole), lambda: _parts(_NUMBERED, whole), of_pages, lambda: _parts(_BLANKS, whole), lambda: [p for p in _parts(re.compile("\n"), whole, 20) if _LINE.match(p)])
    return next((found for way in ways if len(found := way()) > 1), [whole] if whole else [])


class QuestionChunks:
    """pos, question_no, chunk of each question of a text; null gives none."""

    def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
        for pos, chunk in enumerate(cut_questions(text) if text is not None else ()):
            found = _NO.match(chunk)
            no = found and (found[1] or found[2])
            yield pos, int(no) if no and int(no) < 2**31 else pos + 1, chunk


def register(spark: SparkSession) -> None:
    """Makes question_chunks(text) a table function of the session; rows travel as Arrow batches."""
    spark.udtf.register("question_chunks", F.udtf(QuestionChunks, returnType="pos int, question_no int, chunk string", useArrow=True))
