"""Command lines: find the lines of frames, or evaluate LRC files.

    python -m verseline.plans.cli detect FRAMES [OUTPUT] [options]
    python -m verseline.plans.cli evaluate REFERENCE.lrc CANDIDATE.lrc [options]

FRAMES is a Parquet table of observations (track_id, text, ...), one of
recognised frames (track_id, raw_items, ...), or, with ``--engine``, a folder of
numbered PNG files, one track.  OUTPUT is a folder, or with one track a file
that ends in .lrc.  Paths are those of any file system that Spark reads.

Stages are written to a run folder below ``--workdir``, and events are sent
after the work they tell of; ``--resume`` goes on with the stages whose
settings and input are the same.

Exit codes: 0 done, 2 wrong use or input, 130 cancelled.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from importlib import import_module
from pathlib import PurePosixPath

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseline.config import EVALUATION, ROWS, STYLES, Parameters
from verseline.functions import timecode
from verseline.operators import alignment, line_tracker, observations, qa, recognition
from verseline.plans.stages import Cancellation, Cancelled, Events, Run, chain_keys
from verseline.sources import lrc, media
from verseline.sources.event_log import PREFIX
from verseline.sources.files import Files, uri

#: settings that each stage's result depends on
OCR = ("fps", "roi", "crop_bottom_ratio", "confidence_threshold", "raw_score_floor", "active_row", "line_tolerance")
DETECTOR = ("confidence_threshold", "same_threshold", "switch_confirm_frames", "min_line_gap_ms", "max_blank_frames", "style")


def _roi(text: str) -> tuple[float, ...]:
    try:
        return tuple(float(v) for v in text.split(","))
    except ValueError:
        raise argparse.ArgumentTypeError("a region is x,y,width,height") from None


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="verseline")
    todo = top.add_subparsers(dest="command", required=True)
    base = Parameters()
    detect = todo.add_parser("detect")
    detect.add_argument("frames")
    detect.add_argument("folder", nargs="?", metavar="output", help="where the LRC files go (default: beside the frames)")
    detect.add_argument("-o", "--output")
    detect.add_argument("--engine", help="module:factory of a recognition engine, for a folder of PNG files")
    detect.add_argument("--style", choices=STYLES, default=base.style)
    detect.add_argument("--active-row", choices=ROWS, default=base.active_row)
    region = detect.add_mutually_exclusive_group()
    region.add_argument("--roi", type=_roi, help="x,y,width,height in shares of the frame")
    region.add_argument("--crop-bottom-ratio", type=float)
    numbers = {"fps": float, "workers": int, "confidence-threshold": float, "raw-score-floor": float, "same-threshold": float, "switch-confirm-frames": int, "min-line-gap-ms": int, "max-blank-frames": int, "offset-ms": int, "line-tolerance": float}
    for name, kind in numbers.items():
        detect.add_argument(f"--{name}", *(["--max-blank-frames-inside-line"] if name == "max-blank-frames" else []), type=kind, default=getattr(base, name.replace("-", "_")))
    detect.add_argument("--preview-lines", type=int, default=10)
    detect.add_argument("--workdir")
    for flag in ("keep-workdir", "resume", "preview-roi", "force", "strict", "dry-run", "no-review", "json", "event-stream"):
        detect.add_argument(f"--{flag}", action="store_true")
    detect.add_argument("--job-id", default="job")
    detect.add_argument("--cancel-file")
    detect.add_argument("--log-level", choices=("DEBUG", "INFO", "WARNING", "ERROR"), default="INFO")
    evaluate = todo.add_parser("evaluate")
    evaluate.add_argument("reference")
    evaluate.add_argument("candidate")
    evaluate.add_argument("--output")
    for name in EVALUATION:
        evaluate.add_argument(f"--{name.replace('_', '-')}", type=float, default=getattr(base, name))
    for flag in ("compact", "force", "ignore-offset"):
        evaluate.add_argument(f"--{flag}", action="store_true")
    return top


def parameters(a: argparse.Namespace) -> Parameters:
    """The parameters that arguments give, checked."""
    return Parameters(**{n: v for n, v in vars(a).items() if n in Parameters.__dataclass_fields__})


def target(a: argparse.Namespace) -> str:
    """Where the output goes: beside the frames unless told."""
    if a.output and a.folder:
        raise ValueError("the output is given twice")
    head, slash, name = a.frames.rstrip("/").rpartition("/")
    return a.output or a.folder or f"{head}{slash}{name.rpartition('.')[0] or name}-lrc"


def engine(name: str):
    """The factory that ``module:factory`` names."""
    module, _, factory = name.partition(":")
    try:
        return getattr(import_module(module), factory)
    except (ImportError, AttributeError, ValueError) as e:
        raise ValueError(f"no engine {name}: {e}") from e


def recognised(spark: SparkSession, a: argparse.Namespace, p: Parameters) -> DataFrame:
    """Frames with their text, from whatever the input is."""
    if a.engine:
        frames = media.frames_in(spark, a.frames, p.fps).withColumn("track_id", F.lit(PurePosixPath(a.frames).name))
        frames = frames.withColumn("source_index", F.col("frame_number").cast("long")).repartition(p.workers)
        frames = recognition.recognise(frames, engine(a.engine), text_score=p.engine_score_floor)
    else:
        frames = spark.read.parquet(uri(a.frames))
    if "raw_items" not in frames.columns:
        return frames
    read = recognition.read_frames(frames, p.confidence_threshold, p.active_row, tolerance=p.line_tolerance)
    failed = F.col("error").isNotNull() if "error" in read.columns else F.lit(False)
    read = read.withColumn("status", F.when(failed, "error").otherwise(F.col("status")))
    # the fragments tell where blanks were
    return read.withColumn("fragments", F.transform("selected_line.items", lambda x: x["text"])).drop("raw_items", "items", "rejected_items", "visual_lines", "selected_line")


def found_lines(frames: DataFrame, p: Parameters) -> DataFrame:
    if "status" in frames.columns and (bad := observations.check_recognised(frames).where("problem is not null").head(1)):
        raise ValueError(f"track {bad[0].track_id}: {bad[0].problem}")
    seen = observations.observations(frames)
    if p.style == "auto":
        seen = observations.with_hinted_style(seen, p)
    elif p.style != "line":
        seen = seen.withColumn("style", F.lit(p.style))
    return qa.flag_neighbours(line_tracker.lines_of(line_tracker.detect(seen, p, candidates=False)), p.min_line_gap_ms, p.same_threshold)


def preview(frames: DataFrame, p: Parameters) -> dict:
    """Where and when a preview of the region looks: drawing it is left to a viewer."""
    length = frames.agg(F.coalesce(F.max("time"), F.lit(0.0)).alias("t"))
    times = length.select(timecode.sample_times(F.col("t"), 6).alias("times")).first().times
    ratio = p.crop_bottom_ratio or 0.40
    return {"times": [round(t, 6) for t in times], "roi": list(p.roi or (0.0, round(1 - ratio, 12), 1.0, ratio))}


def detect(spark: SparkSession, a: argparse.Namespace) -> list[dict] | dict:
    p, to = parameters(a), target(a)
    events = Events((lambda e: print(PREFIX + json.dumps(e), flush=True)) if a.event_stream else None, a.job_id)
    stop = Cancellation(a.cancel_file)
    given = lambda names: {n: getattr(p, n) for n in names}
    try:
        workdir = a.workdir or spark.conf.get("spark.checkpoint.dir", None) or f"{uri(to).rpartition('/')[0]}/verseline-work"
        with Run(spark, workdir, PurePosixPath(a.frames).stem or "run", a.resume) as run:
            to = run.check_output(a.frames, to)
            keys = chain_keys({"extract": {"source": media.listing(spark, a.frames)}, "ocr": {**given(OCR), "engine": a.engine}, "detector": given(DETECTOR), "writer": {"offset_ms": p.offset_ms}})

            def stage(name: str, make) -> DataFrame:
                stop.check()
                events.emit("stage_started", stage=name)
                out = run.stage(name, keys[name], make)
                events.emit("stage_completed", stage=name, reused=run.manifest["stages"][name]["reused"])
                return out

            frames = stage("ocr", lambda: recognised(spark, a, p))
            if a.preview_roi:
                done: list[dict] | dict = preview(frames, p)
            else:
                lines = stage("detector", lambda: found_lines(frames, p))
                stop.check()
                events.emit("stage_started", stage="writer")
                done = lrc.write_outputs(lines, to, p.offset_ms, a.force, not a.no_review, a.dry_run, a.preview_lines, a.strict)
                events.emit("stage_completed", stage="writer")
            run.clean("frames")
        if not (a.keep_workdir or a.resume):
            run.files.delete(run.folder)
        events.emit("completed", result=done)
        return done
    except Cancelled:
        events.emit("cancelled")
        raise
    except BaseException as e:
        events.emit("failed", error={"type": type(e).__name__, "message": str(e)})
        raise


def evaluate(spark: SparkSession, a: argparse.Namespace) -> str:
    """The report on two LRC files as JSON text; its lines are those of one file, so they come to the driver."""
    p, files = parameters(a), Files(spark)
    sides = []
    for path in (a.reference, a.candidate):
        text = files.read(path).decode("utf-8-sig")
        sides.append(lrc.parse(spark.createDataFrame([("track", text)], "track_id string, content string"), apply_offset=not a.ignore_offset))
    totals, report = alignment.evaluate(*sides, p)
    row = totals.first()
    out = {**(row.asDict() if row else {}), "matches": [r.asDict() for r in report.orderBy("reference_index").collect()]}
    return json.dumps(out, indent=None if a.compact else 2, ensure_ascii=False, allow_nan=False)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=getattr(a, "log_level", "INFO"))
    spark = SparkSession.builder.appName("verseline").getOrCreate()
    try:
        if a.command == "detect":
            print(json.dumps(detect(spark, a), ensure_ascii=False))
        else:
            text = evaluate(spark, a)
            if a.output is None:
                print(text)
            elif uri(a.output) in (uri(a.reference), uri(a.candidate)):
                raise ValueError("the report would overwrite an input")
            else:
                Files(spark).write(a.output, text + "\n", a.force)
    except Cancelled:
        return 130
    except (ValueError, OSError, RuntimeError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
