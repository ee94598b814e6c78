"""The queries of the timed-text operators, each over whole tables, with equivalent SQL.

The tables are re-read as operator inputs: ``events`` as a stream of noisy
observations (a track per user, the event type as text, 'error' as a blank,
value / 100, 1 at most, as confidence), ``conversations`` as line lists, ``lineitem`` as
boxes and times, ``part`` and ``orders`` as media metadata.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verseline.functions import geometry, numbers, text, timecode
from verseline.operators import alignment, line_tracker, observations, qa, recognition
from verseline.plans import sql
from verseline.sources import event_log, lrc, media


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events.select(
        F.col("user_id").cast("string").alias("track_id"),
        F.col("event_id").alias("source_index"),
        (F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6).alias("time"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"),
    )


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.observations(event_frames(spark, sf_dir), votes=False)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_tracker.detect(seen(spark, sf_dir), candidates=False)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_switches(spark, sf_dir)


def line_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T01, T02-T05, A03, A05, P07, P08, O01, O04."""
    return found(spark, sf_dir).where("kind = 'line'").select("track_id", "start_time", "end_time", "text", "support_frames", "confidence")


def rejected_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A06."""
    return found(spark, sf_dir).where("kind = 'rejected'").select("track_id", "reason", "start_time", "end_time", "text", "support_frames")


def low_confidence_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-confidence log of T01, F32, F35."""
    return found(spark, sf_dir).where("kind = 'low_confidence'").select("track_id", "start_time", "text", "confidence")


def short_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the detected lines; the gap is widened to suit the table's time scale."""
    lines = line_tracker.lines_of(found(spark, sf_dir))
    flagged = qa.flag_neighbours(lines, min_gap_ms=86_400_000)
    return flagged.select("track_id", "start_time_raw", "text", F.array_contains("qa_flags", "short_gap").alias("short_gap"), F.array_contains("qa_flags", "similar_to_previous").alias("similar"))


def blank_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W03."""
    return observations.blank_intervals(seen(spark, sf_dir)).select("track_id", "start_time", "end_time", "frame_count", F.array_join("frames", ",").alias("frames"))


def style_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A01."""
    return observations.style_details(seen(spark, sf_dir))


def neighbour_same_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P03, P04 on neighbouring observations of a track."""
    now = F.struct("match_text", "time", "box", "confidence")
    pairs = seen(spark, sf_dir).withColumn("now", now).withColumn("before", F.lag("now").over(observations.in_order()))
    pairs = pairs.where("before is not null")
    return pairs.select("track_id", "source_index", observations.same_line(F.col("before"), F.col("now")).alias("same"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def normalised_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F01-F04."""
    t = F.col("text")
    return turns(spark, sf_dir).select("conv_id", "turn", text.display(t).alias("display_text"), text.match(t).alias("match_text"), text.evaluation(t).alias("evaluation_text"))


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F05-F08 between a turn and the one before."""
    base = turns(spark, sf_dir).withColumn("now", text.match(F.col("text")))
    base = base.withColumn("before", F.lag("now").over(Window.partitionBy("conv_id").orderBy("turn"))).where("before is not null")
    a, b, d = F.col("before"), F.col("now"), F.col("distance")
    base = observations.spread(base, "conv_id", "turn").withColumn("distance", F.levenshtein("before", "now"))
    return base.select("conv_id", "turn", "distance", F.round(text.similarity_percent(a, b, d), 6).alias("percent"), F.round(text.similarity(a, b, d), 6).alias("similarity"), F.round(text.character_error_rate(a, b, d), 6).alias("cer"))


def turn_medoids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn of each conversation nearest to all of them."""
    members = turns(spark, sf_dir).select("conv_id", "turn", text.display(F.col("text")).alias("display_text"), text.match(F.col("text")).alias("match_text"), F.lit(1.0).alias("confidence"))
    return observations.medoids(members, "conv_id", "turn").select("conv_id", "medoid", "total_distance")


#: frames of a turn: text (T is the turn's, q and x have one character more), confidence, top of a box
SIMILAR = (("q", 0.9, 0), ("T", 0.8, 0), ("T", 0.95, 0))
NEAR_EXACT = (("q", 0.9, 0), ("q", 0.8, 0), ("x", 0.95, 0), ("x", 0.95, 0), ("q", 0.85, 0))
JITTER = (("T", 0.9, 0), ("T", 0.9, 0), ("T", 0.3, 0), ("zz", 0.9, 0), ("T", 0.7, 0))
SHORT = (("ab", 0.75, 0), ("ac", 0.7, 100), ("ab", 0.75, 0))
BLANKS = (("", 0.0, 0),) * 3


def frames_of_turns(spark: SparkSession, sf_dir: str, frames: Column) -> DataFrame:
    """A track per conversation: every turn gives frames (text, confidence, box), a quarter of a second apart, turns 100
    seconds; frames may use the columns conv_id, turn and T, the turn's text with single blanks."""
    t = turns(spark, sf_dir).select("conv_id", "turn", F.trim(F.regexp_replace("text", "\\s+", " ")).alias("T"))
    each = t.select("conv_id", "turn", F.posexplode(frames).alias("k", "f"))
    return each.select(F.col("conv_id").cast("string").alias("track_id"), (F.col("turn") * 100 + F.col("k")).cast("long").alias("source_index"), (F.col("turn") * 100 + F.col("k") * 0.25).alias("time"), "f.*")


def _frames(pattern: tuple, **texts: Column) -> Column:
    box = lambda top: F.array(F.array(F.lit(0.0), top), F.array(F.lit(50.0), top + 20.0))
    one = lambda text, sure, top: F.struct((texts[text] if text else F.lit("")).alias("text"), F.lit(sure).alias("confidence"), box(top if isinstance(top, Column) else F.lit(float(top))).alias("box"))
    return F.array(*(one(*f) for f in (*pattern, *BLANKS)))


def noisy_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as noisy lines, by turns with a similar text, a near-exact rival, jitter, and short texts in one place or two."""
    t, turn = F.col("T"), F.col("turn").cast("string")
    texts = {"T": t, "q": F.concat(t, F.lit("q")), "x": F.concat(t, F.lit("x")), "zz": F.concat(F.lit("zz"), turn), "ab": F.concat(F.lit("ab"), turn), "ac": F.concat(F.lit("ac"), turn)}
    moved = tuple((text, sure, F.when(F.col("conv_id") % 2 == 0, 0.0).otherwise(float(top)) if top else 0) for text, sure, top in SHORT)
    which = (F.col("conv_id") + F.col("turn")) % 4
    frames = F.when(which == 0, _frames(SIMILAR, **texts)).when(which == 1, _frames(NEAR_EXACT, **texts)).when(which == 2, _frames(JITTER, **texts)).otherwise(_frames(moved, **texts))
    return frames_of_turns(spark, sf_dir, frames)


def _told(lines: DataFrame) -> DataFrame:
    return lines.select("track_id", "kind", "reason", "start_time", "end_time", "text", "support_frames", "confidence")


def noisy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P03, P04, P06-P08, T01-T04, A02, A03, A05, A06 where texts are alike but not equal: the medoid of edited copies, a
    rival that differs by one character, jitter, and short texts that only their place tells apart."""
    return _told(line_tracker.detect(observations.observations(noisy_frames(spark, sf_dir), votes=False), candidates=False))


def similar_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P03, P04 between neighbouring frames of noisy turns."""
    now = F.struct("match_text", "time", "box", "confidence")
    pairs = observations.observations(noisy_frames(spark, sf_dir), votes=False).withColumn("now", now).withColumn("before", F.lag("now").over(observations.in_order()))
    return pairs.where("before is not null").select("track_id", "source_index", observations.same_line(F.col("before"), F.col("now")).alias("same"))


def typed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that appear bit by bit, in the style that their own hint tells."""
    t = F.col("T")
    part = lambda n: F.substr(t, F.lit(1), F.floor(F.length(t) * n / 3).cast("int"))
    frames = _frames((("one", 0.9, 0), ("two", 0.8, 0), ("T", 0.7, 0), ("T", 0.95, 0)), one=part(1), two=part(2), T=t)
    seen = observations.with_hinted_style(observations.observations(frames_of_turns(spark, sf_dir, frames), votes=False))
    return _told(line_tracker.detect(seen, candidates=False))


def fragment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns recognised without blanks, in fragments that tell where these were."""
    glued = F.replace(F.col("T"), F.lit(" "), F.lit(""))
    frames = F.transform(_frames((("T", 0.9, 0), ("T", 0.8, 0)), T=glued), lambda f: F.struct(f["text"].alias("text"), f["confidence"].alias("confidence"), F.when(f["text"] != "", F.split("T", " ")).alias("fragments")))
    return _told(line_tracker.detect(observations.observations(frames_of_turns(spark, sf_dir, frames)), candidates=False))


def boundary_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F19, F21, A04 over all lines of all documents that agree in their match text."""
    lines = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    # equal lines are one observation here that stands for all of them
    counted = observations.spread(lines.groupBy("text").agg(F.count("*").alias("n")), "text")
    t = F.col("text")
    layers = counted.select("n", text.display(t).alias("display_text"), text.match(t).alias("match_text")).where("match_text <> ''")
    # a place needs two votes, so a line that agrees with no other, itself included, needs no places
    groups = layers.withColumn("all", F.sum("n").over(Window.partitionBy("match_text"))).where(F.col("all") > 1)
    places = observations.space_places(F.when(F.contains("display_text", F.lit(" ")), F.col("display_text")), F.lit(None).cast("array<string>"))
    return observations.boundary_votes(groups.withColumn("boundaries", places), "match_text", weight="n")


def order_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 'frames' (orders): a lineitem is a box whose place comes from its part and supplier keys."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount")
    x, y = (F.col("l_partkey") % 400).cast("double"), (F.col("l_suppkey") % 8 * 15).cast("double")
    w, h = F.col("l_quantity") + 1, F.lit(12.0)
    box = F.array(F.array(x, y), F.array(x + w, y), F.array(x + w, y + h), F.array(x, y + h))
    one = F.struct(F.concat(F.col("l_returnflag"), F.col("l_linenumber").cast("string")).alias("text"), (1 - F.col("l_discount") * 6).alias("confidence"), box.alias("box"))
    return item.select("l_orderkey", "l_linenumber", one.alias("item"))


def box_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, F17, F24."""
    g = geometry.geometry(F.col("item.box"))
    return order_boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", g.alias("g")).select("l_orderkey", "l_linenumber", "g.x_min", "g.x_max", "g.y_min", "g.y_max", "g.x_center", "g.y_center", "g.width", "g.height")


def _frames_of_orders(items: DataFrame) -> DataFrame:
    every = items.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "item"))).alias("all"))
    return recognition.read_frames(every.select("l_orderkey", F.transform("all", lambda s: s["item"]).alias("raw_items")))


def frame_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P01, P02, F24, F33, A08 per order: items with blank texts and confidences that are no numbers among them."""
    item = order_boxes(spark, sf_dir)
    blank = F.when(F.col("l_linenumber") == 5, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("item.text")))
    sure = F.when(F.col("l_linenumber") == 2, F.lit("NaN")).when(F.col("l_linenumber") == 3, F.lit("sure")).otherwise(F.col("item.confidence").cast("string"))
    item = item.withColumn("item", F.struct(blank.alias("text"), sure.alias("confidence"), F.col("item.box").alias("box")))
    read = _frames_of_orders(item)
    return read.select("l_orderkey", F.size("raw_items").alias("n_raw"), F.size("items").alias("n_kept"), F.size("rejected_items").alias("n_rejected"), F.array_join(F.transform("items", lambda i: i["text"]), ",").alias("kept"), "status")


def active_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows clustered and one chosen per order."""
    read = _frames_of_orders(order_boxes(spark, sf_dir))
    return read.select("l_orderkey", F.size("visual_lines").alias("n_rows"), "text", F.round("confidence", 6).alias("confidence"), "status")


def adapted_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F31, J07, F23 on recognition results as JSON: parallel lists, wrapped and single items by turns."""
    item = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    lists = F.format_string('{"txts":["%s","  "],"scores":[0.9],"boxes":[[0,0,%d,9]]}', "p_name", "p_size")
    wrapped = F.format_string('{"res":[{"text":"%s","score":"0.5","bbox":[[0,0],[%d,9]]}]}', "p_name", "p_size")
    single = F.format_string('{"rec_text":" %s ","probability":0.25,"polygon":null,"size":%d}', "p_name", "p_size")
    made = item.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, lists).when(F.col("p_partkey") % 3 == 1, wrapped).otherwise(single).alias("result"))
    adapted = made.select("p_partkey", recognition.adapt_json("result").alias("items"))
    return adapted.select("p_partkey", F.size("items").alias("n_items"), F.col("items")[0]["text"].alias("text"), F.col("items")[0]["confidence"].alias("confidence"), F.size(F.col("items")[0]["box"]).alias("n_points"))


def timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F09, F10."""
    seconds = F.col("l_extendedprice") / 10.0 - 50.0
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", seconds.alias("seconds"))
    cs = timecode.centiseconds(F.col("seconds"))
    return item.select("l_orderkey", "l_linenumber", cs.alias("centiseconds"), timecode.timestamp(cs).alias("stamp"))


def frame_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11, F12, S03."""
    n = F.col("o_orderkey") % 999_999 + 1
    paths = table(spark, sf_dir, "orders").select("o_orderkey", F.format_string("/frames/%06d.png", n).alias("path"))
    index = media.frame_index(paths.select("path"), "30000/1001")
    return index.select("frame", "frame_number", F.round("time", 9).alias("time"), "time_fraction")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F13, F14, S02 filter text."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    share = F.format_string("%.2f,%.2f,%.2f,%.2f", F.col("p_size") / 100.0, F.col("p_size") / 100.0, F.lit(0.5), F.lit(0.25))
    out = part.select("p_partkey", geometry.resolve_roi(geometry.parse_roi(share), F.lit(1920), F.lit(1080)).alias("roi"), geometry.resolve_roi(geometry.bottom_roi(), F.lit(1280), F.col("p_size") + 700).alias("bottom"))
    return out.select("p_partkey", "roi.x", "roi.y", "roi.width", "roi.height", F.col("bottom.y").alias("bottom_y"), F.col("bottom.height").alias("bottom_height"), media.filter_chain(F.col("roi"), 4).alias("filter"))


def sample_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O08, S15 sampling."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(timecode.sample_times(F.col("p_retailprice"), 6)).alias("nth", "time"))
    return part.select("p_partkey", "nth", F.round("time", 6).alias("time"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S01, F15 on probe JSON of parts: a cover picture first, rotation in one of three places, durations by turns."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    k = F.col("p_partkey")
    turned = F.when(k % 3 == 0, F.lit('"side_data_list":[{"rotation":-90}],')).when(k % 3 == 1, F.lit('"tags":{"rotate":"180"},')).otherwise(F.lit(""))
    length = F.when(k % 2 == 0, F.format_string('"duration":"%.2f",', "p_retailprice")).otherwise(F.lit('"duration":"N/A",'))
    payload = F.concat(F.lit('{"streams":[{"index":0,"codec_type":"video","width":9,"height":9,"disposition":{"attached_pic":1}},{"index":1,"codec_type":"audio"},{"index":2,"codec_type":"video","codec_name":"h264",'), turned, length, F.format_string('"width":%d,"height":1080,"avg_frame_rate":"30000/1001","disposition":{"attached_pic":0}}],"format":{"duration":"99.5","start_time":"1.25"}}', F.col("p_size") + 100))
    info = media.video_info(p.select("p_partkey", payload.alias("payload")))
    return info.select("p_partkey", "stream_index", "codec_name", "display_width", "display_height", "rotation", "duration", "duration_source", "start_time", "start_time_source", F.round("average_frame_rate", 6).alias("average_frame_rate"))


def index_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier keys as an index of frames against part keys as files."""
    name = lambda c: F.format_string("%06d.png", F.col(c))
    index = table(spark, sf_dir, "supplier").select(name("s_suppkey").alias("frame"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).otherwise(-1.0).alias("time"))
    there = table(spark, sf_dir, "part").select(name("p_partkey").alias("frame"))
    return media.frame_index_problems(index, there)


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_tracker.lines_of(found(spark, sf_dir))
    first = F.min("start_time_raw").over(Window.partitionBy("track_id"))
    # times count in ten-thousandths from half a second before the track's first line, rounded as the SQL does: a tie is one of the thousandths
    scale = lambda c: F.round((F.col(c) - F.col("base")) / 10_000 * 1000) / 1000
    scaled = lines.withColumn("base", first).withColumns({"start_time_raw": scale("start_time_raw"), "end_time": scale("end_time")})
    return qa.prepare(scaled.withColumn("qa_flags", F.array().cast("array<string>")), offset_ms=-500)


def prepared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F26, F27, W04, W05, W07, O04."""
    p = prepared(spark, sf_dir)
    return p.select("track_id", "line_no", "centiseconds", "text", F.array_join("qa_flags", ";").alias("flags"))


def lrc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered documents."""
    return lrc.render(prepared(spark, sf_dir))


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The review table."""
    return lrc.review_rows(prepared(spark, sf_dir)).select("track_id", "line_no", "start_raw", "start_final", "end", "text", "support_frames", "qa_flags")


def parsed_lrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as LRC with two stamps a line, metadata and an offset, and parsed again."""
    line = F.format_string("[%02d:%02d.%02d][%d:%02d:5] %s", F.col("turn"), F.col("conv_id") % 60, F.col("turn") * 7 % 100, F.col("turn") + 60, F.col("turn"), F.regexp_replace("text", "\\s+", " "))
    rows = turns(spark, sf_dir).groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))), lambda r: r["line"]), "\n").alias("body"))
    documents = rows.select(F.col("conv_id").cast("string").alias("track_id"), F.concat(F.lit("﻿[ti:x]\n[offset:+100]\n[offset: -250]\n"), "body", F.lit("\n[00:01.00]   \nno stamp")).alias("content"))
    return lrc.parse(documents).select("track_id", "line_index", F.round("timestamp", 6).alias("timestamp"), "text", "source_line")


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Reference and candidate lines of each conversation: the reference has a title line first, the candidate a
    line of noise last; in between are all turns, the candidate's slightly changed and late."""
    t = turns(spark, sf_dir).select(F.col("conv_id").cast("string").alias("track_id"), F.col("turn").cast("int").alias("turn"), "text")
    tracks = t.groupBy("track_id").agg(F.max("turn").alias("last"))
    title = tracks.select("track_id", F.lit(0).alias("line_index"), F.lit(0.0).alias("timestamp"), F.concat(F.lit("title "), "track_id").alias("text"))
    reference = title.union(t.select("track_id", F.col("turn") + 1, F.col("turn") * 4.0 + 4, "text"))
    changed = F.when(F.col("turn") % 2 == 1, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    noise = tracks.select("track_id", F.col("last") + 1, F.col("last") * 4.0 + 9, F.lit("~"))
    candidate = t.select("track_id", F.col("turn").alias("line_index"), (F.col("turn") * 4.0 + 4.5 + F.col("turn") % 4 * 0.4).alias("timestamp"), changed.alias("text")).union(noise)
    return reference, candidate


def fixed_alignment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    reference, candidate = sides(spark, sf_dir)
    left = reference.select("track_id", F.col("line_index").alias("reference_index"), text.evaluation(F.col("text")).alias("a"))
    pairs = candidate.select("track_id", F.col("line_index").alias("candidate_index"), (F.col("line_index") + 1).alias("reference_index"), text.evaluation(F.col("text")).alias("b")).join(left, ["track_id", "reference_index"])
    pairs = observations.spread(pairs, "track_id").withColumn("edit_distance", F.levenshtein("a", "b"))
    aligned = pairs.select("track_id", "reference_index", "candidate_index", text.similarity(F.col("a"), F.col("b"), F.col("edit_distance")).alias("similarity"), "edit_distance")
    return reference, candidate, aligned


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dynamic program."""
    reference, candidate = sides(spark, sf_dir)
    out = alignment.align_lines(reference, candidate)
    return out.select("track_id", "reference_index", "candidate_index", F.round("similarity", 6).alias("similarity"), "edit_distance")


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report over the program's alignment."""
    reference, candidate = sides(spark, sf_dir)
    return alignment.evaluate(reference, candidate)[0]


def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A09-A12, J04, F25 over a fixed alignment."""
    reference, candidate, aligned = fixed_alignment(spark, sf_dir)
    reference, candidate = alignment.coerce_lines(reference), alignment.coerce_lines(candidate)
    return alignment.summary(reference, candidate, alignment.matches(reference, candidate, aligned))


def unmatched_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J03."""
    reference, _, aligned = fixed_alignment(spark, sf_dir)
    return alignment.unmatched(reference, aligned, "reference").select("track_id", "line_index", "text")


def similarity_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of lines of a track."""
    reference, candidate = sides(spark, sf_dir)
    out = alignment.similarity_matrix(reference, candidate)
    return out.select("track_id", "reference_index", "candidate_index", "edit_distance", F.round("similarity", 6).alias("similarity"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job per user: views start stages, clicks progress, purchases complete, errors fail, sign-ups cancel."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    kind = F.when(F.col("event_type") == "view", "stage_started").when(F.col("event_type") == "click", "progress").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("cancelled")
    stage = F.element_at(F.array(*map(F.lit, ("prepare", "extract", "ocr", "detector", "writer"))), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("job_id"), kind.alias("type"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), stage.alias("stage"), (F.col("value") / 500).alias("ratio"), F.struct("ts", "event_id").alias("seq_order"))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S12, F30, W07."""
    lines = event_log.emit(job_events(spark, sf_dir))
    return lines.select("job_id", "seq", F.substr("line", F.lit(1), F.lit(len(event_log.PREFIX))).alias("prefix"), F.get_json_object(F.substr("line", F.lit(len(event_log.PREFIX) + 1)), "$.type").alias("type"), F.get_json_object(F.substr("line", F.lit(len(event_log.PREFIX) + 1)), "$.stage").alias("stage"))


def parsed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good lines, noise and every kind of bad line."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    body = (
        F.when(F.col("event_id") % 7 == 0, F.lit("no json"))
        .when(F.col("event_id") % 7 == 1, F.lit("[1]"))
        .when(F.col("event_id") % 7 == 2, F.lit('{"job_id":"x"}'))
        .when(F.col("event_id") % 7 == 3, F.concat(F.lit('{"type":"'), "event_type", F.lit('","event":"other"}')))
        .when(F.col("event_id") % 7 == 4, F.concat(F.lit('{"event":"'), "event_type", F.lit('"}')))
        .otherwise(F.concat(F.lit('{"type":"'), "event_type", F.lit('","event":"'), "event_type", F.lit('"}')))
    )
    lines = e.select("event_id", F.when(F.col("event_id") % 11 == 0, F.lit("other output")).otherwise(F.concat(F.lit(event_log.PREFIX), body)).alias("line"))
    return event_log.parse(lines).select("event_id", F.col("event.type").alias("type"), "issue")


def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each job ended, crashed, without a result or while it was cancelled among them."""
    events = job_events(spark, sf_dir)
    numbered = events.withColumn("seq", F.row_number().over(Window.partitionBy("job_id").orderBy("seq_order")))
    jobs = event_log.terminal(numbered)
    job = F.col("job_id").cast("long")
    code = F.when(job % 13 == 0, 130).when(F.col("terminal_type") == "failed", 1).otherwise(0)
    ended = event_log.outcome(code, job % 7 == 0, F.col("terminal_type"), job % 5 != 0, F.col("terminal_type") == "failed", job % 11 == 0)
    return jobs.select("job_id", "terminal_type", "terminal_seq", ended.alias("outcome"))


def runner_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A runner per user whose signals come from events, out of turn as often as not."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    n, kind = F.col("event_id"), F.col("event_type")
    signal = F.when(kind == "view", "start").when(kind == "signup", "started").when((kind == "click") & (n % 3 == 0), "cancel").when(kind == "error", "exit").otherwise("event")
    end = F.when((kind == "purchase") & (n % 5 == 0), "cancelled").when((kind == "purchase") & (n % 5 == 1), "failed").when(kind == "purchase", "completed")
    signals = e.select(F.col("user_id").cast("string").alias("job_id"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"), signal.alias("signal"), F.when(kind == "error", F.element_at(F.array(F.lit(0), F.lit(0), F.lit(1), F.lit(130)), (n % 4 + 1).cast("int"))).alias("exit_code"), ((kind == "error") & (n % 7 == 0)).alias("crashed"), end.alias("terminal_type"), ((kind == "purchase") & (n % 4 != 0)).alias("has_result"), ((kind == "purchase") & (n % 5 == 1)).alias("has_error"))
    return event_log.runner_states(signals).select("job_id", "seq", "run", "state", "accepted")


def parsed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13 on a job's raw output: bytes cut anywhere, inside characters too, a last line without an end, and lines beyond
    the limit."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    long = F.when(F.col("event_id") % 17 == 0, F.repeat(F.lit("é"), 400)).otherwise(F.lit("é"))
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("some other output "), long)).otherwise(F.concat(F.lit(event_log.PREFIX + '{"type":"'), "event_type", F.lit('","message":"'), F.col("event_id").cast("string"), F.lit("-"), long, F.lit('"}')))
    jobs = e.groupBy("user_id").agg(F.encode(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))), lambda r: r["line"]), "\n"), "UTF-8").alias("out"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("out") - 1) / 37).cast("int")), lambda i: F.struct(i.alias("seq"), F.substring(F.col("out"), i * 37 + 1, F.lit(37)).alias("data")))
    chunks = jobs.select(F.col("user_id").cast("string").alias("job_id"), F.explode(cut).alias("c")).select("job_id", "c.*")
    lines = event_log.chunk_lines(chunks, most_bytes=500)
    good = event_log.parse(lines.where("issue is null").drop("issue")).select("job_id", "nth", "event.type", "event.message", "issue")
    bad = lines.where("issue is not null").select("job_id", "nth", F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("message"), "issue")
    return good.unionByName(bad)


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted work of a stage, and the whole job."""
    e = job_events(spark, sf_dir).withColumn("event_id", F.col("seq_order.event_id")).withColumn("total", F.col("event_id") % 7 * 10).withColumn("done", F.col("event_id") % 83)
    counted = event_log.progress(F.col("done"), F.col("total"))
    return e.select("job_id", "event_id", event_log.overall_progress(F.col("type"), F.col("stage"), F.col("ratio")).alias("overall"), F.round(counted["ratio"], 9).alias("ratio"), counted["percent"].alias("percent"))


def recognition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A08, P10."""
    return observations.check_recognised(_recognised(spark, sf_dir))


def _recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("text") == ""
    frames = event_frames(spark, sf_dir).withColumn("status", F.when(failed, "error").otherwise("ok"))
    return frames.withColumn("frame", F.format_string("%06d.png", "source_index")).withColumn("error", F.when(failed, "no image"))


def failed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that failed, in short."""
    return observations.failed_frames(_recognised(spark, sf_dir))


def cleaned_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F25, F32, F33 on numbers as text, some of them none."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    raw = F.when(F.col("l_linenumber") == 1, F.lit("NaN")).when(F.col("l_linenumber") == 2, F.lit("x")).otherwise((F.col("l_quantity") * 3 - 10).cast("string"))
    return item.select("l_orderkey", "l_linenumber", numbers.observed_confidence(raw, F.lit(1.0)).alias("observed"), numbers.recognised_confidence(raw).alias("recognised"), numbers.clean(F.col("l_discount") / 3).alias("cleaned"))


_QUERIES = (
    line_switches, rejected_clusters, low_confidence_frames, short_gaps, blank_intervals, style_details, neighbour_same_line, normalised_turns, turn_similarity, turn_medoids, noisy_lines, similar_neighbours, typed_lines, fragment_lines, boundary_votes, box_geometry, frame_status, active_rows, adapted_results,
    timestamps, frame_times, regions, sample_times, probes, index_problems, prepared_lines, lrc_texts, review_rows, parsed_lrc, alignments, evaluation, accuracy, unmatched_references, similarity_matrix, event_lines, parsed_events, parsed_chunks, job_outcomes, runner_states, progress, recognition_check, failed_frames, cleaned_numbers,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLES.items()}
