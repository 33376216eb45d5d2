"""Queries over the base tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from tessera.operators.scan import SLICE


def all_queries() -> dict:
    """name -> (query, SQL or None)."""
    from . import edits, editor, intervals, ranking, segments, streams, suggestions, timeline

    every = {**intervals.QUERIES, **segments.QUERIES, **ranking.QUERIES, **timeline.QUERIES, **streams.QUERIES, **editor.QUERIES, **edits.QUERIES, **suggestions.QUERIES}
    return {name: (_without_slices(query), sql) for name, (query, sql) in every.items()}


def _without_slices(query: Callable) -> Callable:
    """The query without the column that says where rows lie."""

    @wraps(query)
    def run(spark, sf_dir):
        return query(spark, sf_dir).drop(SLICE)

    return run
