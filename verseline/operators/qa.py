"""Offsets and quality flags on lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseline.functions import numbers, text
from verseline.functions.timecode import centiseconds
from verseline.operators.observations import same_text_line


def flag_neighbours(lines: DataFrame, min_gap_ms: int = 800, threshold: float = 90.0) -> DataFrame:
    """qa_flags of lines (track_id, start_time_raw, ordinal, text): short_gap and similar_to_previous.  Only flags; nothing merges."""
    order = Window.partitionBy("track_id").orderBy("start_time_raw", "ordinal")
    now = text.match(F.col("text"))
    with_match = lines.withColumn("_match", now)
    before = F.lag("_match").over(order)
    gap = (F.col("start_time_raw") - F.lag("start_time_raw").over(order)) * 1000.0
    close = F.coalesce(gap < min_gap_ms, F.lit(False))
    out = with_match.withColumns({"_before": before, "_close": close})
    alike = (F.col("_before") != F.col("_match")) & same_text_line(F.col("_before"), F.col("_match"), threshold)
    flags = F.array_compact(F.array(F.when(F.col("_close"), F.lit("short_gap")), F.when(F.coalesce(alike, F.lit(False)), F.lit("similar_to_previous"))))
    return out.withColumn("qa_flags", flags).drop("_match", "_before", "_close")


def apply_offset(lines: DataFrame, offset_ms: int = 0) -> DataFrame:
    """start_time_offset = start + offset, 0 at least; a clamped start is flagged."""
    if isinstance(offset_ms, bool) or not isinstance(offset_ms, int):
        raise ValueError("offset_ms must be an integer")
    has = lines.columns
    start = F.coalesce(F.col("start_time_raw"), F.col("start_time")) if {"start_time", "start_time_raw"} <= set(has) else F.col("start_time_raw" if "start_time_raw" in has else "start_time")
    moved = start + offset_ms / 1000.0
    flags = numbers.flags(F.col("qa_flags")) if "qa_flags" in has else F.array().cast("array<string>")
    return lines.withColumns({"start_time_offset": F.greatest(F.lit(0.0), moved), "qa_flags": numbers.with_flag(flags, "negative_offset_clamped", moved < 0)})


def prepare(lines: DataFrame, offset_ms: int = 0, position: str = "ordinal", strict: bool = False) -> DataFrame:
    """Lines in output order: offset applied, centiseconds, line_no, order flags before and after sorting.

    With ``strict`` duplicate timestamps are an error when the result is read.
    """
    given = Window.partitionBy("track_id").orderBy(position)
    out = apply_offset(lines, offset_ms).withColumn("centiseconds", centiseconds(F.col("start_time_offset")))
    out = out.withColumn("_before", F.lag("centiseconds").over(given))
    flags = numbers.with_flag(F.col("qa_flags"), "duplicate_timestamp", F.coalesce(F.col("centiseconds") == F.col("_before"), F.lit(False)))
    out = out.withColumn("qa_flags", flags)
    out = out.withColumn("qa_flags", numbers.with_flag(F.col("qa_flags"), "out_of_order_timestamp", F.coalesce(F.col("centiseconds") < F.col("_before"), F.lit(False))))
    sorted_ = Window.partitionBy("track_id").orderBy("centiseconds", position)
    out = out.withColumns({"_twin": F.coalesce(F.col("centiseconds") == F.lag("centiseconds").over(sorted_), F.lit(False)), "line_no": F.row_number().over(sorted_)})
    flags = numbers.with_flag(F.col("qa_flags"), "duplicate_timestamp", F.col("_twin"))
    if strict:
        flags = F.when(F.col("_twin"), F.raise_error(F.lit("duplicate timestamps")).cast("array<string>")).otherwise(flags)
    return out.withColumn("qa_flags", flags).drop("_before", "_twin")
