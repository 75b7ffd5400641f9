"""Switches of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """What a run does: solutions split off, chapters given (by vectors too), rows written; only symbols rewritten, or doubtful fractions too."""

    extract_solutions: bool = False
    classify: bool = True
    use_vectors: bool = True
    persist: bool = True
    strict_verbatim: bool = True
