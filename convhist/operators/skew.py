"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from convhist.session import materialize


def lookup_join(big: DataFrame, lookup: DataFrame, keys: Sequence[str], how: str = "left", spread: Sequence[str] | None = None) -> DataFrame:
    """Join ``big`` to ``lookup`` (unique per key), whatever share of ``big`` one key has.

    The lookup is stored first. So it is computed once, even where it is derived from ``big`` and used several times, and
    the join reads plain exchanges on both sides, which adaptive execution splits where a key is hot: the rows of that key
    go to several tasks, its lookup row to each. ``spread`` is kept for callers that name the columns which tell rows of
    one key apart; nothing depends on it.
    """
    return big.join(materialize(lookup), list(keys), how)
