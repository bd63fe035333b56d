"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from . import catalog, correct, dense, evidence, intervals, library, sampling, series, transcripts, words

_ALL = {**library.QUERIES, **intervals.QUERIES, **series.QUERIES, **words.QUERIES, **evidence.QUERIES, **dense.QUERIES, **correct.QUERIES, **transcripts.QUERIES, **sampling.QUERIES, **catalog.QUERIES}


def queries() -> dict[str, Callable]:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
