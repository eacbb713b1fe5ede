"""Many-to-one joins."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join ``right``, which has one row per key, to ``left``.

    Both inputs are read once.  A key that owns much of the left side, or a
    missing one, makes a large partition of the left side only, which adaptive
    execution splits; nothing has to be counted or repeated for it.
    """
    return left.join(right, keys, how)
