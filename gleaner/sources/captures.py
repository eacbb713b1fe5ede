"""Choice among several landed captures of one target."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import strip, text


def prefer_capture(captures: DataFrame) -> DataFrame:
    """The first non-empty capture of every target in tier order.

    Only the (tier, capture_id) of a target is aggregated; bodies are not
    shuffled for the choice.
    """
    full = captures.where(strip(text("body")) != "")
    best = full.groupBy("url").agg(F.min(F.struct("tier", "capture_id")).alias("b")).select("url", "b.tier", "b.capture_id")
    return full.join(best, ["url", "tier", "capture_id"])
