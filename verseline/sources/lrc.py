"""LRC documents and review tables: parsing, rendering, guarded writing."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from verseline.functions.timecode import timestamp
from verseline.operators.qa import prepare
from verseline.sources.files import Files

#: fixed value: what ends a line of text
LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"
STAMP = "\\[([0-9]+):([0-5]?[0-9])(?:[.:]([0-9]{1,3}))?\\]"
OFFSET = "(?i)\\[offset\\s*:\\s*([+-]?[0-9]+)\\s*\\]"
SPACES = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+"


def parse(documents: DataFrame, key: str = "track_id", content: str = "content", apply_offset: bool = True) -> DataFrame:
    """(track_id, line_index, timestamp, text, source_line): every time stamp of every timed line, in playing order.

    A line may have several stamps; lines without text or stamp are left out.
    The last offset tag counts and is added; times are 0 at least.
    """
    whole = F.regexp_replace(F.col(content), "^\\x{feff}", "")
    offsets = F.regexp_extract_all(whole, F.lit(OFFSET), 1)
    shift = F.coalesce(F.try_element_at(offsets, F.lit(-1)).cast("double"), F.lit(0.0)) / 1000.0 if apply_offset else F.lit(0.0)
    lines = documents.select(F.col(key).alias("track_id"), shift.alias("shift"), F.posexplode(F.split(whole, LINE_BREAK)).alias("row", "line"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("line", "^\\x{feff}+", ""), f"^{SPACES}", ""), f"{SPACES}$", "")
    lines = lines.withColumn("line", bare).withColumn("lead", F.regexp_extract("line", f"^((?:{STAMP})+)", 1)).where("lead <> ''")
    lyric = F.regexp_replace(F.substr(F.col("line"), F.length("lead") + 1), f"^{SPACES}", "")
    lines = lines.withColumn("text", lyric).where("text <> ''")
    stamps = lines.select("track_id", "shift", (F.col("row") + 1).alias("source_line"), "text", F.posexplode(F.regexp_extract_all("lead", F.lit(STAMP), 0)).alias("nth", "stamp"))
    part = lambda i: F.regexp_extract("stamp", STAMP, i)
    fraction = F.when(part(3) == "", 0.0).otherwise(part(3).cast("double") / F.pow(F.lit(10.0), F.length(part(3))))
    seconds = F.greatest(F.lit(0.0), part(1).cast("double") * 60.0 + part(2).cast("double") + fraction + F.col("shift"))
    timed = stamps.withColumn("timestamp", seconds)
    order = Window.partitionBy("track_id").orderBy("timestamp", "source_line", "nth")
    return timed.select("track_id", (F.row_number().over(order) - 1).alias("line_index"), "timestamp", "text", F.col("source_line").cast("int").alias("source_line"))


def load(spark: SparkSession, *paths: str, apply_offset: bool = True) -> DataFrame:
    """Parsed lines of LRC files, one track per file, named by its path."""
    files = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("track_id"), F.col("value").alias("content"))
    return parse(files, apply_offset=apply_offset)


def _gathered(lines: DataFrame, line: Column) -> DataFrame:
    """(track_id, content): each track's lines in output order, each ended by a line feed."""
    rows = F.sort_array(F.collect_list(F.struct("line_no", line.alias("line"))))
    return lines.groupBy("track_id").agg(F.concat(F.array_join(F.transform(rows, lambda r: r["line"]), "\n"), F.lit("\n")).alias("content"))


def render(prepared: DataFrame) -> DataFrame:
    """LRC text of prepared lines, per track."""
    return _gathered(prepared, F.concat(F.lit("["), timestamp(F.col("centiseconds")), F.lit("]"), F.col("text")))


REVIEW = ("line_no", "start_raw", "start_final", "end", "text", "confidence", "support_frames", "qa_flags")


def review_rows(prepared: DataFrame) -> DataFrame:
    """The review table of prepared lines, all as text: times with 3, confidences with 4 decimals, flags joined by ';'."""
    three = lambda c: F.col(c).cast("double").cast("decimal(18,3)").cast("string")
    shown = {"start_raw": three("start_time_raw"), "start_final": three("start_time_offset"), "end": three("end_time"), "confidence": F.col("confidence").cast("double").cast("decimal(18,4)").cast("string"), "support_frames": F.col("support_frames").cast("string"), "qa_flags": F.array_join("qa_flags", ";")}
    return prepared.select("track_id", "line_no", *(shown[c].alias(c) if c in shown else F.col(c) for c in REVIEW if c != "line_no"))


def review_csv(prepared: DataFrame) -> DataFrame:
    """Review tables as CSV text with a byte-order mark, per track."""
    quoted = lambda c: F.when(F.col(c).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c))
    rows = review_rows(prepared)
    line = F.concat_ws(",", F.col("line_no").cast("string"), *(quoted(c) for c in REVIEW[1:]))
    body = _gathered(rows, line)
    return body.withColumn("content", F.concat(F.lit("﻿" + ",".join(REVIEW) + "\n"), F.col("content")))


def write_atomic(path: str | Path, data: str | bytes, overwrite: bool = False) -> Path:
    """Writes beside the target, syncs, and moves into place; refuses an existing target unless told."""
    path = Path(path)
    if path.exists() and not overwrite:
        raise FileExistsError(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(data.encode() if isinstance(data, str) else data)
            f.flush()
            os.fsync(f.fileno())
        if overwrite:
            os.replace(name, path)
        else:
            os.link(name, path)
            os.unlink(name)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise
    return path


def file_name(track: str) -> str:
    """A name for a track's files that no other track has and that cannot leave its folder: the track's own if that is
    plain, else its plain characters and a part of its hash."""
    if re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9._-]{0,150}", track):
        return track
    return f"{re.sub(r'[^A-Za-z0-9_-]', '_', track)[:100]}-{hashlib.sha256(track.encode()).hexdigest()[:16]}"


def write_outputs(lines: DataFrame, folder: str | Path, offset_ms: int = 0, force: bool = False, review: bool = True, dry_run: bool = False, preview_lines: int = 10, strict: bool = False) -> list[dict]:
    """One LRC and one review file per track, beside each other; a dry run returns the first lines instead.

    The folder may be on any file system that Spark reads; a path that ends in .lrc
    is the file of the one track there is.  Tracks come to the driver one at a
    time.  Lines need not have ``ordinal``; without it equal
    times are in order of end and text.
    """
    if "ordinal" not in lines.columns:
        when = [c for c in ("start_time_raw", "start_time", "end_time", "text") if c in lines.columns]
        lines = lines.withColumn("ordinal", F.row_number().over(Window.partitionBy("track_id").orderBy(*when)))
    lines = lines.withColumns({c: F.lit(None).cast(t) for c, t in (("end_time", "double"), ("confidence", "double"), ("support_frames", "long")) if c not in lines.columns})
    prepared = prepare(lines, offset_ms, strict=strict)
    if "start_time_raw" not in prepared.columns:
        prepared = prepared.withColumn("start_time_raw", F.col("start_time"))
    texts = render(prepared)
    if review:
        texts = texts.join(review_csv(prepared).withColumnRenamed("content", "review"), "track_id")
    files, out, one = Files(lines.sparkSession), [], str(folder).endswith(".lrc")
    if one and lines.select("track_id").distinct().limit(2).count() > 1:
        raise ValueError(f"{folder} takes one track, and there are more")
    for row in texts.toLocalIterator():
        stem = str(folder).removesuffix(".lrc") if one else f"{str(folder).rstrip('/')}/{file_name(row.track_id)}"
        target, beside = f"{stem}.lrc", f"{stem}.review.csv"
        if dry_run:
            out.append({"track_id": row.track_id, "preview": row.content.splitlines()[:preview_lines]})
            continue
        if not force and (files.exists(target) or review and files.exists(beside)):
            raise FileExistsError(target)
        files.write(target, row.content, force)
        if review:
            files.write(beside, row.review, force)
        out.append({"track_id": row.track_id, "lrc": target, "review": beside if review else None})
    return out


def _local(path: str) -> Path:
    """A folder that all nodes mount; other file systems are read by ``load`` and written by ``write_outputs``."""
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path} is not mounted: read it with lrc.load, write it with lrc.write_outputs")
    return Path(path.removeprefix("file://"))


class LrcSource(DataSource):
    """``spark.read.format("lrc").load(folder)``: (track_id, content) of LRC files; writing takes such rows.

    The folder must be mounted on all nodes.
    """

    @classmethod
    def name(cls) -> str:
        return "lrc"

    def schema(self) -> str:
        return "track_id string, content string"

    def reader(self, schema) -> "LrcReader":
        return LrcReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> "LrcWriter":
        return LrcWriter(self.options["path"], overwrite)


class LrcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        root = _local(self.path)
        return [InputPartition(str(p)) for p in (sorted(root.glob("*.lrc")) if root.is_dir() else [root])]

    def read(self, partition: InputPartition) -> Iterator[tuple[str, str]]:
        yield Path(partition.value).stem, Path(partition.value).read_text(encoding="utf-8-sig")


class LrcWriter(DataSourceWriter):
    """Files appear as each is complete; a failed task leaves no part of a file."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = _local(path), overwrite

    def write(self, rows) -> WriterCommitMessage:
        for row in rows:
            write_atomic(self.path / f"{file_name(row['track_id'])}.lrc", row["content"], self.overwrite)
        return WriterCommitMessage()
