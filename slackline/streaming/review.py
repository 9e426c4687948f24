"""The review log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from slackline.operators.review import effective


def first_decisions(log: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each item's first effective decision of a stream (seq, item_id, decision, ts, corrected_value) in append mode.

    Items are remembered for the watermark's length; a decision that arrives later than that is late data."""
    return effective(log).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["item_id"])
