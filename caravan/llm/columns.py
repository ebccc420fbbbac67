"""Keeping a caller's columns apart from those that an operator adds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def filtered(docs: DataFrame, added: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """keep(docs), a filter that adds columns on the way, with docs' own columns alone, those of the same names included."""
    away = {c: f"_own_{c}" for c in docs.columns if c in added}
    return keep(docs.withColumnsRenamed(away)).select(*(away.get(c, c) for c in docs.columns)).withColumnsRenamed({v: k for k, v in away.items()})
