"""Order-preserving alignment of two line lists per track, and accuracy measures.

The alignment is a dynamic program, so it runs per track on Arrow data; its
rows are two numpy vectors of scores at a time, and distances are computed once
per distinct pair of texts.  Everything behind the alignment is native.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseline.config import Parameters
from verseline.functions import text
from verseline.functions.numbers import clean
from verseline.functions.text import edit_distance
from verseline.operators.observations import spread

MATCH, SKIP_REFERENCE, SKIP_CANDIDATE = 0, 1, 2
ALIGNED = "track_id string, reference_index int, candidate_index int, similarity double, edit_distance int"


def align(reference: list[str], candidate: list[str], min_similarity: float = 0.55, gap_penalty: float = 0.35) -> list[tuple[int, int, float, int]]:
    """Pairs (reference, candidate, similarity, distance) of the best order-preserving one-to-one alignment of normalised texts.

    Better means a higher score, then more matches, more exact ones, less
    displacement along the two lists, fewer gaps; a match goes before skipping
    the reference, and that before skipping the candidate.
    """
    n, m = len(reference), len(candidate)
    # a state: (score, matches, exact, displacement, gaps); only the row above and the moves are kept
    above = [(-gap_penalty * 0.0, 0, 0, 0.0, 0)]
    for j in range(m):
        s = above[-1]
        above.append((s[0] - gap_penalty, s[1], s[2], s[3], s[4] + 1))
    moves = [bytearray([SKIP_CANDIDATE]) * (m + 1)]

    def key(s: tuple) -> tuple:
        return round(s[0], 12), s[1], s[2], -round(s[3], 12), -s[4]

    for i, a in enumerate(reference):
        s = above[0]
        row = [(s[0] - gap_penalty, s[1], s[2], s[3], s[4] + 1)]
        move = bytearray([SKIP_REFERENCE]) * (m + 1)
        for j, b in enumerate(candidate):
            up, left = above[j + 1], row[j]
            best, how = (up[0] - gap_penalty, up[1], up[2], up[3], up[4] + 1), SKIP_REFERENCE
            other = (left[0] - gap_penalty, left[1], left[2], left[3], left[4] + 1)
            if key(other) > key(best):
                best, how = other, SKIP_CANDIDATE
            # the lengths alone bound how alike two texts can be
            if a and b and min(len(a), len(b)) >= (min_similarity - 1e-9) * max(len(a), len(b)):
                d = edit_distance(a, b)
                alike = 1.0 - d / max(len(a), len(b))
                if alike >= min_similarity:
                    s = above[j]
                    paired = (s[0] + alike, s[1] + 1, s[2] + (d == 0), s[3] + abs((i + 0.5) / n - (j + 0.5) / m), s[4])
                    if key(paired) >= key(best):
                        best, how = paired, MATCH
            row.append(best)
            move[j + 1] = how
        moves.append(move)
        above = row
    out = []
    i, j = n, m
    while i or j:
        how = moves[i][j] if i and j else SKIP_REFERENCE if i else SKIP_CANDIDATE
        if how == MATCH:
            i, j = i - 1, j - 1
            d = edit_distance(reference[i], candidate[j])
            out.append((i, j, 1.0 - d / max(len(reference[i]), len(candidate[j])), d))
        elif how == SKIP_REFERENCE:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def coerce_lines(lines: DataFrame) -> DataFrame:
    """(track_id, line_index, timestamp, text, source_line): the first of timestamp, time, start_time,
    start_time_offset, start_time_raw that is there; it must be finite and not below 0."""
    names = [c for c in ("timestamp", "time", "start_time", "start_time_offset", "start_time_raw") if c in lines.columns]
    when = F.coalesce(*names).cast("double")
    good = F.assert_true(F.coalesce(~F.isnan(when) & (when >= 0) & (when < float("inf")), F.lit(False)), F.lit("timestamps must be finite and not below 0")).isNull()
    source = F.coalesce(F.col("source_line"), F.col("line_index") + 1) if "source_line" in lines.columns else F.col("line_index") + 1
    return lines.select("track_id", F.col("line_index").cast("int").alias("line_index"), F.when(good, when).alias("timestamp"), F.coalesce("text", F.lit("")).alias("text"), source.cast("int").alias("source_line"))


def align_lines(reference: DataFrame, candidate: DataFrame, parameters: Parameters | None = None) -> DataFrame:
    """The alignment of lines (track_id, line_index, text) of each track."""
    p = parameters or Parameters()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("line_index"), right.sort_values("line_index")
        found = align(left["norm"].tolist(), right["norm"].tolist(), p.min_similarity, p.gap_penalty)
        out = pd.DataFrame(found, columns=["i", "j", "similarity", "edit_distance"])
        track = left["track_id"].iloc[0] if len(left) else right["track_id"].iloc[0]
        i, j = left["line_index"].to_numpy(), right["line_index"].to_numpy()
        return pd.DataFrame({"track_id": track, "reference_index": i[out["i"].astype(int)] if len(out) else [], "candidate_index": j[out["j"].astype(int)] if len(out) else [], "similarity": out["similarity"].astype(float), "edit_distance": out["edit_distance"].astype(int)})

    sides = [d.select(F.col("track_id").cast("string").alias("track_id"), F.col("line_index").cast("int").alias("line_index"), text.evaluation(F.col("text")).alias("norm")) for d in (reference, candidate)]
    left, right = (spread(d, "track_id") for d in sides)
    return left.groupBy("track_id").cogroup(right.groupBy("track_id")).applyInPandas(run, ALIGNED)


def similarity_matrix(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Every pair of lines within a track, with distance and similarity."""
    left = reference.select("track_id", F.col("line_index").alias("reference_index"), text.evaluation(F.col("text")).alias("a"))
    right = candidate.select("track_id", F.col("line_index").alias("candidate_index"), text.evaluation(F.col("text")).alias("b"))
    pairs = spread(left, "track_id").join(right, "track_id").withColumn("edit_distance", F.levenshtein("a", "b"))
    return pairs.select("track_id", "reference_index", "candidate_index", "edit_distance", text.similarity(F.col("a"), F.col("b"), F.col("edit_distance")).alias("similarity"))


def unmatched(lines: DataFrame, aligned: DataFrame, side: str) -> DataFrame:
    """Lines of one side ('reference' or 'candidate') that no pair uses."""
    used = aligned.select("track_id", F.col(f"{side}_index").alias("line_index"))
    return lines.join(used, ["track_id", "line_index"], "left_anti")


def matches(reference: DataFrame, candidate: DataFrame, aligned: DataFrame, tolerance: float = 0.80) -> DataFrame:
    """A report row per aligned pair: texts, times, errors before and after the track's median offset, edits needed."""
    left = reference.select("track_id", F.col("line_index").alias("reference_index"), F.col("text").alias("reference_text"), F.col("timestamp").alias("reference_time"))
    right = candidate.select("track_id", F.col("line_index").alias("candidate_index"), F.col("text").alias("candidate_text"), F.col("timestamp").alias("candidate_time"))
    out = aligned.join(left, ["track_id", "reference_index"]).join(right, ["track_id", "candidate_index"])
    out = out.withColumn("raw_error", F.col("candidate_time") - F.col("reference_time"))
    out = out.withColumn("offset", F.median(-F.col("raw_error")).over(Window.partitionBy("track_id")))
    out = out.withColumn("residual_error", F.col("raw_error") + F.col("offset"))
    a, b = text.evaluation(F.col("reference_text")), text.evaluation(F.col("candidate_text"))
    out = out.withColumns({"reference_characters": F.length(a), "text_edit": a != b, "time_edit": F.abs("residual_error") > tolerance})
    reasons = F.array_compact(F.array(F.when(F.col("text_edit"), F.lit("text")), F.when(F.col("time_edit"), F.lit("time"))))
    return out.withColumns({"manual_edit_required": F.col("text_edit") | F.col("time_edit"), "manual_edit_reasons": reasons})


def time_statistics(error: Column) -> dict[str, Column]:
    """Median, median of the absolute values, and their exact 90th percentile."""
    return {"median_signed_s": clean(F.median(error)), "median_abs_s": clean(F.median(F.abs(error))), "p90_abs_s": clean(F.percentile(F.abs(error), F.lit(0.9)))}


def summary(reference: DataFrame, candidate: DataFrame, report: DataFrame) -> DataFrame:
    """Per track: counts, recall, precision, character error rate, offset, time errors and edit rate.

    recall is 1 without any line on both sides and 0 without reference lines
    alone; precision the same from the other side.  The edit rate may pass 1.
    """
    counts = reference.groupBy("track_id").agg(F.count("*").alias("r")).join(candidate.groupBy("track_id").agg(F.count("*").alias("c")), "track_id", "full")
    errors = {f"raw_{k}": v for k, v in time_statistics(F.col("raw_error")).items()} | {f"residual_{k}": v for k, v in time_statistics(F.col("residual_error")).items()}
    found = report.groupBy("track_id").agg(
        F.count("*").alias("k"), F.sum("edit_distance").alias("edits"), F.sum("reference_characters").alias("characters"), F.count_if("manual_edit_required").alias("matched_edits"), clean(F.first("offset")).alias("estimated_offset_s"), *(v.alias(k) for k, v in errors.items())
    )
    out = counts.join(found, "track_id", "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in ("r", "c", "k", "edits", "characters", "matched_edits")})
    r, c, k = F.col("r"), F.col("c"), F.col("k")
    edits = F.col("matched_edits") + (r - k) + (c - k)
    return out.select(
        "track_id",
        r.alias("reference_line_count"),
        c.alias("candidate_line_count"),
        k.alias("matched_line_count"),
        (r - k).alias("unmatched_reference_count"),
        (c - k).alias("unmatched_candidate_count"),
        clean(F.when(r > 0, k / r).when(c == 0, 1.0).otherwise(0.0)).alias("line_recall"),
        clean(F.when(c > 0, k / c).when(r == 0, 1.0).otherwise(0.0)).alias("line_precision"),
        clean(F.when(F.col("characters") > 0, F.col("edits") / F.col("characters")).otherwise(0.0)).alias("cer"),
        "estimated_offset_s",
        clean(F.col("estimated_offset_s") * 1000.0).alias("estimated_offset_ms"),
        *errors,
        edits.alias("manual_edit_count"),
        clean(F.when(r > 0, edits / r).otherwise((edits > 0).cast("double"))).alias("manual_edit_rate"),
    )


def evaluate(reference: DataFrame, candidate: DataFrame, parameters: Parameters | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, match report) of candidate lines against reference lines, per track."""
    p = parameters or Parameters()
    reference, candidate = coerce_lines(reference), coerce_lines(candidate)
    report = matches(reference, candidate, align_lines(reference, candidate, p), p.time_tolerance)
    return summary(reference, candidate, report), report


def report_json(rows: DataFrame) -> DataFrame:
    """Each row as JSON text without NaN."""
    return rows.select(F.to_json(F.struct("*")).alias("report"))
