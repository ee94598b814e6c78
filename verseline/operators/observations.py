"""From frames of any source to canonical observations, and native analyses of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verseline.config import Parameters
from verseline.functions import numbers, text
from verseline.functions.geometry import bounds, same_row

def in_order():
    return Window.partitionBy("track_id").orderBy("time", "source_index")


#: input bytes for each partition of CPU-bound work, and partitions at most
PART_BYTES, MOST_PARTS = 64 << 20, 100_000


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that a plan reads, as far as they are known; estimates of what joins make of them are not used."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 60)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partitioned by keys, and kept so: what follows is short of CPU, not of bytes, so small partitions must not be
    merged.  There are as many as the session sets, as the cluster has cores, or as the input's size asks for,
    whichever is most."""
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, min(input_bytes(df) // PART_BYTES, MOST_PARTS))
    return df.repartition(parts, *keys)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def space_places(texts: pd.Series, fragments: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else text.boundaries(t, None if f is None else list(f)) for t, f in zip(texts, fragments)])


def observations(frames: DataFrame, style: str = "line", votes: bool = True) -> DataFrame:
    """Canonical observations of frames (track_id, text, and what there is of source_index, frame, time,
    confidence, box, status, fragments).

    Missing columns and values take the defaults: the index as time and frame
    name, a confidence of 1 with text and 0 without.  Without ``votes`` blanks
    inside lines are not reconstructed and no Python runs on ASCII texts.
    """
    has = set(frames.columns)
    col = lambda name, kind: F.col(name).cast(kind) if name in has else F.lit(None).cast(kind)
    index = col("source_index", "long")
    seen = frames.select(
        F.col("track_id").cast("string").alias("track_id"),
        index.alias("source_index"),
        F.coalesce(col("frame", "string"), index.cast("string")).alias("frame"),
        numbers.finite(col("time", "double"), index.cast("double")).alias("time"),
        F.coalesce(col("text", "string"), F.lit("")).alias("raw_text"),
        col("confidence", "double").alias("confidence"),
        col("box", "array<array<double>>").alias("box"),
        F.coalesce(col("status", "string"), F.lit("")).alias("status"),
        col("fragments", "array<string>").alias("fragments"),
    )
    seen = seen.withColumns({"display_text": text.display(F.col("raw_text")), "match_text": text.match(F.col("raw_text"))})
    default = F.when(F.col("display_text") != "", 1.0).otherwise(0.0)
    places = F.lit(None).cast("array<int>")
    if votes:
        split = F.contains("display_text", F.lit(" ")) | F.coalesce(F.size("fragments") > 1, F.lit(False))
        # Arrow-batched, and a fence: a native fold would be evaluated again wherever the column is used
        places = space_places(F.when(split, F.col("display_text")), "fragments")
    return seen.withColumns({"confidence": numbers.observed_confidence(F.col("confidence"), default), "boundaries": places, "style": F.lit(style)}).drop("fragments")


def same_line(left: Column, right: Column, threshold: float = 90.0, style: str = "line") -> Column:
    """Whether two observations (structs with match_text, and of short texts time, box, confidence) may be one line."""
    a, b = left["match_text"], right["match_text"]
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    # the distance may be given up beyond what the threshold allows
    most = F.floor(long * (1 - threshold / 100.0)).cast("int")
    distance = F.levenshtein(a, b)
    alike = (short / long >= 0.70) & (100.0 * (1.0 - distance / long) >= threshold) & (distance <= most + 1)
    noise = (long >= 3) & (distance == 1) & (F.abs(right["time"] - left["time"]) <= 0.50) & same_row(bounds(left["box"]), bounds(right["box"])) & (F.least(left["confidence"], right["confidence"]) < 0.80)
    grows = b.startswith(a) if style == "typewriter" else F.lit(False)
    return F.coalesce((a != "") & (b != "") & ((a == b) | grows | F.when(long >= 5, alike).otherwise(noise)), F.lit(False))


def same_text_line(a: Column, b: Column, threshold: float = 90.0) -> Column:
    """same_line for bare match texts: without place and time short texts are alike only if equal."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    alike = (long >= 5) & (short / long >= 0.70) & (100.0 * (1.0 - F.levenshtein(a, b) / long) >= threshold)
    return F.coalesce((a != "") & (b != "") & ((a == b) | alike), F.lit(False))


def style_details(seen: DataFrame, parameters: Parameters | None = None) -> DataFrame:
    """Per track the kinds of neighbouring pairs of confident observations, and a hint of how lines appear."""
    p = parameters or Parameters()
    sure = seen.where((F.col("match_text") != "") & (F.col("confidence") >= p.confidence_threshold))
    before, now = F.lag("match_text").over(in_order()), F.col("match_text")
    pairs = sure.withColumn("before", before)
    before = F.col("before")
    kind = (
        F.when(before.isNull(), None)
        .when(before == now, "exact")
        .when(now.startswith(before), "prefix")
        .when(text.similarity_percent(before, now) >= p.same_threshold, "similar")
        .otherwise("changed")
    )
    count = lambda k: F.count_if(F.col("kind") == k)
    out = pairs.withColumn("kind", kind).groupBy("track_id").agg(
        F.count("*").alias("non_empty_frames"),
        F.count("kind").alias("pair_count"),
        count("exact").alias("exact_pairs"),
        count("similar").alias("similar_pairs"),
        count("prefix").alias("prefix_extensions"),
        count("changed").alias("changed_pairs"),
    )
    n, prefix = F.col("pair_count"), F.col("prefix_extensions")
    typewriter = (n >= 2) & (prefix >= 2) & (prefix >= F.col("changed_pairs")) & (prefix / n >= 0.25)
    line = (n >= 1) & ((F.col("exact_pairs") + F.col("similar_pairs")) / n >= 0.40)
    return out.withColumn("style_hint", F.when(typewriter, "typewriter").when(line, "line").otherwise("uncertain"))


def with_hinted_style(seen: DataFrame, parameters: Parameters | None = None) -> DataFrame:
    """Observations with the style that their track's hint suggests; an uncertain one reads as line."""
    hints = style_details(seen, parameters).select("track_id", "style_hint")
    hint = F.when(F.col("style_hint") == "typewriter", "typewriter").otherwise("line")
    return seen.drop("style").join(hints, "track_id", "left").withColumn("style", hint).drop("style_hint")


def blank_intervals(seen: DataFrame) -> DataFrame:
    """Runs of blank observations per track; any other one, unsure ones included, ends a run."""
    blank = (F.col("display_text") == "") & (F.col("status") != "low_confidence")
    runs = seen.withColumn("blank", blank).withColumn("run", F.sum(F.when(blank, 0).otherwise(1)).over(in_order()))
    frames = F.transform(F.sort_array(F.collect_list(F.struct("time", "source_index", "frame"))), lambda s: s["frame"])
    return runs.where("blank").groupBy("track_id", "run").agg(F.min("time").alias("start_time"), F.max("time").alias("end_time"), F.count("*").alias("frame_count"), frames.alias("frames")).drop("run")


#: distinct texts of a group that one task compares with all of them
SIDE = 512


def medoids(members: DataFrame, group: str, order: str) -> DataFrame:
    """Per group the display text with the least total distance to all members' match texts
    (display_text, match_text, confidence); ties: surer, longer, first by ``order``.

    Distances are between distinct texts, weighted by how often they occur.
    """
    members = members.where(F.col("match_text") != "")
    texts = members.groupBy(group, "match_text").agg(F.count("*").alias("n"))
    faces = members.groupBy(group, "display_text").agg(F.min(F.struct(order, "match_text")).alias("first"), F.avg("confidence").alias("sure"))
    faces = faces.select(group, "display_text", F.col("first.match_text").alias("own"), F.col(f"first.{order}").alias("nth"), "sure")
    # each pair of distinct texts is measured once and counts for both; a large group is dealt over several tasks
    texts = texts.join(texts.groupBy(group).agg(F.ceil(F.count("*") / SIDE).cast("int").alias("deals")), group)
    left = texts.select(group, F.pmod(F.xxhash64("match_text"), "deals").cast("int").alias("deal"), F.col("match_text").alias("a"), F.col("n").alias("na"))
    right = texts.select(group, F.explode(F.sequence(F.lit(0), F.col("deals") - 1)).alias("deal"), F.col("match_text").alias("b"), F.col("n").alias("nb"))
    pairs = spread(left, group, "deal").join(right, [group, "deal"]).where("a < b").withColumn("d", F.levenshtein("a", "b"))
    both = pairs.select(group, F.explode(F.array(F.struct(F.col("a").alias("own"), (F.col("d") * F.col("nb")).alias("cost")), F.struct(F.col("b").alias("own"), (F.col("d") * F.col("na")).alias("cost")))).alias("s"))
    cost = both.groupBy(group, "s.own").agg(F.sum("s.cost").alias("cost"))
    ranked = faces.join(cost, [group, "own"], "left").withColumn("cost", F.coalesce("cost", F.lit(0).cast("long")))
    rank = F.struct("cost", (-F.col("sure")).alias("s"), (-F.length("own")).alias("l"), "nth")
    return ranked.groupBy(group).agg(F.min_by("display_text", rank).alias("medoid"), F.min("cost").alias("total_distance"))


def boundary_votes(members: DataFrame, group: str, weight: str | None = None) -> DataFrame:
    """Per group of observations with equal match text, the blank places that enough of them vote for.

    weight: a column that says how many equal observations a row stands for; without it a row is one.
    """
    n = F.col(weight) if weight else F.lit(1)
    size = members.groupBy(group).agg(F.sum(n).alias("compatible_frames"), F.max(F.length("match_text")).alias("longest"))
    votes = members.select(group, n.alias("n"), F.explode(F.array_distinct("boundaries")).alias("position")).groupBy(group, "position").agg(F.sum("n").alias("votes"))
    least = F.greatest(F.lit(2), F.ceil(F.col("compatible_frames") * 0.30))
    out = votes.join(size, group).where((F.col("votes") >= least) & (F.col("position") > 0) & (F.col("position") < F.col("longest")))
    return out.select(group, "position", "votes", "compatible_frames", F.round(F.col("votes") / F.col("compatible_frames"), 6).alias("ratio"))


def check_recognised(frames: DataFrame) -> DataFrame:
    """Per track: total, failed and usable frames, and why it cannot go on (null if it can)."""
    out = frames.groupBy("track_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.trim("text") != "").alias("usable"))
    problem = F.when(F.col("failed") == F.col("total"), "every frame failed").when(F.col("usable") == 0, "no usable text")
    return out.withColumn("problem", problem)


def failed_frames(frames: DataFrame) -> DataFrame:
    return frames.where("status = 'error'").select(*[c for c in ("track_id", "frame", "time", "error") if c in frames.columns])
