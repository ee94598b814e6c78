"""Media metadata, frame indexes and file fingerprints."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verseline.functions.timecode import frame_time, frame_time_text, rate_text
from verseline.sources.files import Files, stable_hash, uri

STREAM = "struct<index:int,codec_type:string,codec_name:string,width:string,height:string,duration:string,duration_ts:string,time_base:string,start_time:string,avg_frame_rate:string,r_frame_rate:string,nb_frames:string,rotation:string,tags:struct<rotate:string>,side_data_list:array<struct<rotation:string>>,disposition:struct<attached_pic:int>>"
PROBE = f"struct<streams:array<{STREAM}>,format:struct<duration:string,start_time:string>>"


def _number(text: Column) -> Column:
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def ratio(text: Column) -> Column:
    """'30000/1001' or a plain number as a double; null without a denominator."""
    parts = F.split(text, "/")
    return F.when(F.size(parts) == 2, F.try_divide(_number(parts[0]), _number(parts[1]))).otherwise(_number(text))


def video_info(probes: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds the first real video stream's metadata from probe JSON; columns are null where there is none, and ``error`` says why."""
    read = F.from_json(payload, PROBE)
    videos = F.filter(read["streams"], lambda s: s["codec_type"] == "video")
    real = F.filter(videos, lambda s: F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) == 0)
    out = probes.withColumn("_f", read["format"]).withColumn("_s", F.coalesce(F.get(real, F.lit(0)), F.get(videos, F.lit(0))))
    s, f = F.col("_s"), F.col("_f")
    turned = F.get(F.filter(s["side_data_list"], lambda d: d["rotation"].isNotNull()), F.lit(0))["rotation"]
    rotation_raw = F.coalesce(_number(F.coalesce(turned, s["tags"]["rotate"], s["rotation"], F.lit("0"))), F.lit(0.0))
    rotation = F.pmod(F.bround(rotation_raw, 0).cast("int"), F.lit(360))
    width, height = s["width"].try_cast("int"), s["height"].try_cast("int")
    ticks = _number(s["duration_ts"]) * ratio(s["time_base"])
    own = F.coalesce(_number(s["duration"]), ticks)
    rate = F.coalesce(F.nullif(s["avg_frame_rate"], F.lit("")), s["r_frame_rate"])
    upright = ~rotation.isin(90, 270)
    columns = {
        "stream_index": F.coalesce(s["index"], F.lit(0)),
        "codec_name": s["codec_name"],
        "width": width,
        "height": height,
        "display_width": F.when(upright, width).otherwise(height),
        "display_height": F.when(upright, height).otherwise(width),
        "rotation": rotation,
        "rotation_raw": rotation_raw,
        "duration": F.coalesce(own, _number(f["duration"]), F.lit(0.0)),
        "duration_source": F.when(own.isNotNull(), "stream").when(_number(f["duration"]).isNotNull(), "format").otherwise("unknown"),
        "start_time": F.coalesce(_number(s["start_time"]), _number(f["start_time"]), F.lit(0.0)),
        "start_time_source": F.when(_number(s["start_time"]).isNotNull(), "stream").when(_number(f["start_time"]).isNotNull(), "format").otherwise("default"),
        "average_frame_rate": F.when((rate != "0/0") & (ratio(rate) > 0), ratio(rate)),
        "average_frame_rate_raw": F.when(rate != "0/0", rate),
        "time_base": s["time_base"],
        "frame_count": F.when(s["nb_frames"].rlike("^[0-9]+$"), s["nb_frames"].cast("long")),
    }
    good = s.isNotNull() & (width > 0) & (height > 0)
    error = F.when(s.isNull(), "no video stream").when(~F.coalesce(good, F.lit(False)), "invalid dimensions")
    return out.withColumns({k: F.when(good, v) for k, v in columns.items()} | {"error": error}).drop("_s", "_f")


def filter_chain(roi: Column, fps) -> Column:
    """The decoder's filter text: zero the clock, crop, sample."""
    return F.format_string(f"setpts=PTS-STARTPTS,crop=%d:%d:%d:%d,fps={rate_text(fps)}", roi["width"], roi["height"], roi["x"], roi["y"])


def decoder_arguments(path: str, stream: int, filters: str, folder: str, program: str = "ffmpeg") -> list[str]:
    """The decoder's argument list, without a shell: one stream, filtered, as numbered PNG files."""
    return [program, "-hide_banner", "-nostdin", "-loglevel", "error", "-i", path, "-map", f"0:{stream}", "-vf", filters, "-start_number", "1", f"{folder}/%06d.png"]


def decode(jobs: DataFrame, program: str = "ffmpeg", timeout: float = 3600.0, run: Callable[[list[str], float], str | None] | None = None) -> DataFrame:
    """Runs the decoder for each of jobs (path, stream_index, filter, folder) where the row is; adds arguments and error.

    Input and folder must be mounted where workers run, and the folder is made and must hold no frames yet.  A job that
    fails says why in ``error`` and fails no other.  run: what runs an argument list for at most so many seconds and
    returns an error or None; by default a process of its own.
    """
    schema = jobs.schema.simpleString()[7:-1]
    start = run or run_process

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            arguments = [decoder_arguments(p, int(s), f, d, program) for p, s, f, d in zip(part["path"], part["stream_index"], part["filter"], part["folder"])]
            errors = []
            for folder, one in zip(part["folder"], arguments):
                try:
                    Path(folder).mkdir(parents=True, exist_ok=True)
                    errors.append("the folder holds frames already" if any(Path(folder).glob("*.png")) else start(one, timeout))
                except OSError as e:
                    errors.append(str(e))
            yield part.assign(arguments=arguments, error=errors)

    return jobs.mapInPandas(each, f"{schema}, arguments array<string>, error string")


def run_process(arguments: list[str], timeout: float) -> str | None:
    """Runs a program to its end; what it says last if it fails."""
    try:
        done = subprocess.run(arguments, capture_output=True, text=True, timeout=timeout, check=False)
    except subprocess.TimeoutExpired:
        return f"no end after {timeout:g} seconds"
    return None if done.returncode == 0 else (done.stderr.strip().splitlines() or [f"exit code {done.returncode}"])[-1]


def frame_index(paths: DataFrame, fps, path: str = "path") -> DataFrame:
    """(frame, path, frame_number, time, time_fraction) of six-digit PNG files."""
    name = F.regexp_extract(path, "([^/\\\\]+)$", 1)
    out = paths.select(name.alias("frame"), F.col(path).alias("path")).where(F.col("frame").rlike("^[0-9]{6}[.]png$"))
    out = out.withColumn("frame_number", F.substr("frame", F.lit(1), F.lit(6)).cast("int"))
    return out.withColumns({"time": frame_time(F.col("frame_number"), fps), "time_fraction": frame_time_text(F.col("frame_number"), fps)})


def frames_in(spark: SparkSession, folder: str, fps) -> DataFrame:
    """The frame index of a folder; file contents are not read."""
    return frame_index(spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(folder).select("path"), fps)


def frame_index_problems(index: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """(problem, frame) of an index: bad names, repeats, times that are not finite or below 0, and files on one side only."""
    name = index.where(~F.col("frame").rlike("^[0-9]{6}[.]png$") | F.col("frame").isNull()).select(F.lit("name").alias("problem"), "frame")
    twice = index.groupBy("frame").count().where("count > 1").select(F.lit("duplicate").alias("problem"), "frame")
    time = index.where(F.col("time").isNull() | F.isnan("time") | (F.col("time") < 0) | (F.col("time") == float("inf"))).select(F.lit("time").alias("problem"), "frame")
    out = name.unionByName(twice).unionByName(time)
    if there is not None:
        files, listed = there.select("frame").distinct(), index.select("frame").distinct()
        out = out.unionByName(listed.exceptAll(files).select(F.lit("missing file").alias("problem"), "frame")).unionByName(files.exceptAll(listed).select(F.lit("not listed").alias("problem"), "frame"))
    return out


def fingerprints(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, size, modified, sha256) of whole files; a file whose size is not what was listed when it was read is an error."""
    read = spark.read.format("binaryFile").load(list(paths))
    whole = F.assert_true(F.octet_length("content") == F.col("length"), F.concat(F.lit("changed while it was read: "), "path")).isNull()
    return read.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.when(whole, F.sha2("content", 256)).alias("sha256"))


def fingerprint(spark: SparkSession, path: str) -> dict:
    """One file's fingerprint; RuntimeError if the file changed between the first and the last look at it."""
    files = Files(spark)
    before = files.stamp(path)
    row = fingerprints(spark, uri(path)).first()
    if files.stamp(path) != before or row.size != before[0]:
        raise RuntimeError(f"{path} changed while it was read")
    return row.asDict()


def listing(spark: SparkSession, path: str) -> str:
    """What a file or folder holds by name, size and time, as one hash: it tells whether an input is the same as before."""
    files = Files(spark)
    return stable_hash(files.listed(path))
