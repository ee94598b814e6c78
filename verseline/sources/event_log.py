"""Job event logs: one JSON object a line behind a prefix."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verseline.operators.observations import spread
from verseline.schemas import EVENT

#: what marks an event line among a job's other output; readers and writers of a log agree on it
PREFIX = "JOB_EVENT "
MOST_BYTES = 1 << 20
TERMINAL = ("completed", "cancelled", "failed")
#: fixed values: the share of overall progress at which each stage starts and ends
STAGES = {"prepare": (0, 8), "preview": (8, 100), "extract": (8, 30), "ocr": (30, 90), "detector": (90, 96), "writer": (96, 100)}


def emit(events: DataFrame, order: str = "seq_order", prefix: str = PREFIX) -> DataFrame:
    """(job_id, seq, line) of events (job_id, type, timestamp, ... payload); seq counts from 1 in ``order``.
    The envelope's own fields win over payload fields of the same name."""
    seq = F.row_number().over(Window.partitionBy("job_id").orderBy(order))
    payload = [c for c in events.columns if c not in ("type", "event", "job_id", "seq", "timestamp", order)]
    body = F.struct(F.col("type"), F.col("type").alias("event"), "job_id", "seq", "timestamp", *payload)
    return events.withColumn("seq", seq.cast("long")).select("job_id", "seq", F.concat(F.lit(prefix), F.to_json(body)).alias("line"))


def parse(lines: DataFrame, column: str = "line", prefix: str = PREFIX, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Event lines with the parsed ``event`` struct and an ``issue`` (null for good ones); other output is left out.

    Works alike on a table and on a stream of lines.
    """
    marked = lines.withColumn(column, F.regexp_replace(column, "[\\r\\n]+$", "")).where(F.col(column).startswith(prefix))
    body = F.substr(F.col(column), F.lit(len(prefix) + 1))
    tree = F.try_parse_json(body)
    out = marked.withColumn("_tree", F.when(F.octet_length(column) <= most_bytes, tree))
    is_object = F.schema_of_variant("_tree").startswith("OBJECT")
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get("_tree", f"$.{k}", "variant")) == "STRING", F.try_variant_get("_tree", f"$.{k}", "string"))
    present = lambda k: F.try_variant_get("_tree", f"$.{k}", "variant").isNotNull() & (F.schema_of_variant(F.try_variant_get("_tree", f"$.{k}", "variant")) != "VOID")
    out = out.withColumns({"_type": F.when(present("type"), text("type")).otherwise(text("event")), "_other": present("event") & ~F.coalesce(text("event") == F.when(present("type"), text("type")).otherwise(text("event")), F.lit(False))})
    issue = (
        F.when(F.octet_length(column) > most_bytes, "too long")
        .when(F.col("_tree").isNull(), "no JSON")
        .when(~is_object, "no object")
        .when(F.coalesce("_type", F.lit("")) == "", "no type")
        .when(F.col("_other"), "conflicting types")
    )
    event = F.from_json(body, EVENT)
    return out.withColumn("issue", issue).withColumn("event", F.when(F.col("issue").isNull(), event.withField("type", F.col("_type")))).drop("_tree", "_type", "_other")


class Lines:
    """Cuts a job's output, fed in pieces of any size, into lines.

    Pieces may end inside a line or a character.  A line that outgrows the limit
    is dropped up to its end, so memory stays bounded; it is told of only if it
    is an event line.  finish() gives an unterminated last line.
    """

    def __init__(self, prefix: str = PREFIX, most_bytes: int = MOST_BYTES):
        self.prefix, self.most = prefix.encode(), most_bytes
        if most_bytes < len(self.prefix) + 2:
            raise ValueError("the limit is below an event line's least size")
        self.held = bytearray()
        self.skipping = False

    def _told(self, line: bytes) -> list[tuple[str | None, str | None]]:
        line = line.rstrip(b"\r\n")
        if not line.startswith(self.prefix):
            return []
        if len(line) > self.most:
            return [(None, "too long")]
        try:
            return [(line.decode(), None)]
        except UnicodeDecodeError:
            return [(None, "no UTF-8")]

    def feed(self, piece: bytes) -> list[tuple[str | None, str | None]]:
        """(event line, None) or (None, what is wrong with it), for each event line that ended."""
        *ended, rest = piece.split(b"\n")
        out = []
        for part in ended:
            if not self.skipping:
                out += self._told(bytes(self.held) + part)
            self.held.clear()
            self.skipping = False
        if not self.skipping:
            self.held += rest
            if len(self.held) > self.most:
                if self.held.startswith(self.prefix):
                    out.append((None, "too long"))
                self.held.clear()
                self.skipping = True
        return out

    def finish(self) -> list[tuple[str | None, str | None]]:
        last, skipped = bytes(self.held), self.skipping
        self.held.clear()
        self.skipping = False
        return [] if skipped or not last else self._told(last)


def chunk_lines(chunks: DataFrame, prefix: str = PREFIX, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(job_id, nth, line, issue): the event lines of output chunks (job_id, seq, data), job by job in order of seq.

    One exchange by job, then a sorted pass that holds one unended line; line is
    null where issue says why.  ``parse`` takes the lines from here.
    """
    kind = chunks.schema["job_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job, cutter, nth = None, None, 0
        for batch in batches:
            rows: list[tuple] = []

            def told(found: list) -> None:
                nonlocal nth
                for line, issue in found:
                    nth += 1
                    rows.append((job, nth, line, issue))

            for this, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if cutter is None or this != job:
                    if cutter is not None:
                        told(cutter.finish())
                    job, cutter, nth = this, Lines(prefix, most_bytes), 0
                told(cutter.feed(data or b""))
            if rows:
                yield _rows(rows, batch.schema.field(0).type)
        if cutter is not None and (found := cutter.finish()):
            yield _rows([(job, nth + i, *f) for i, f in enumerate(found, 1)], batch.schema.field(0).type)

    def _rows(rows: list[tuple], job_type: pa.DataType) -> pa.RecordBatch:
        types = (job_type, pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["job_id", "nth", "line", "issue"])

    ready = spread(chunks.select("job_id", "data", "seq"), "job_id").sortWithinPartitions("job_id", "seq")
    return ready.select("job_id", "data").mapInArrow(run, f"job_id {kind}, nth long, line string, issue string")


def terminal(events: DataFrame) -> DataFrame:
    """Per job the first terminal event's type and place; later ones do not count."""
    return events.where(F.col("type").isin(*TERMINAL)).groupBy("job_id").agg(F.min_by("type", "seq").alias("terminal_type"), F.min("seq").alias("terminal_seq"))


def outcome(exit_code: Column, crashed: Column, terminal_type: Column, has_result: Column, has_error: Column, cancelling: Column) -> Column:
    """How a job ended.  Success takes a normal exit with 0, a completed event, a result and no error."""
    success = ~crashed & (exit_code == 0) & (terminal_type == "completed") & has_result & ~has_error
    cancelled = (terminal_type == "cancelled") | (exit_code == 130) | (cancelling & F.coalesce(terminal_type != "completed", F.lit(True)))
    return F.when(success, "succeeded").when(F.coalesce(cancelled, F.lit(False)), "cancelled").otherwise("failed")


def runner_states(signals: DataFrame) -> DataFrame:
    """signals (job_id, seq, signal, exit_code, crashed, terminal_type, has_result, has_error) with run, state and accepted.

    Signals: start, started, cancel, exit; any other is an event of the job's own, whose terminal_type counts.  A job is
    idle until its first start, then starting, running once started, cancelling once asked to, and after its exit
    succeeded, cancelled or failed until the next start.  A start while a run is active, and what comes without an
    active run, is not accepted and changes nothing.  Native windows over a job's signals, no state to keep.
    """
    order = Window.partitionBy("job_id").orderBy("seq")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = F.when(F.col("signal").isin("start", "exit"), F.col("signal"))
    before = F.coalesce(F.last(edge, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit("exit"))
    out = signals.withColumn("_active", before == "start")
    out = out.withColumn("accepted", F.when(F.col("signal") == "start", ~F.col("_active")).otherwise(F.col("_active")))
    out = out.withColumn("run", F.sum(F.when((F.col("signal") == "start") & F.col("accepted"), 1).otherwise(0)).over(so_far))
    within = Window.partitionBy("job_id", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lambda c: F.coalesce(F.max(F.when(F.col("accepted") & c, 1)).over(within), F.lit(0)) == 1
    last = lambda c: F.last(F.when(F.col("accepted") & (F.col("signal") == "exit"), c), ignorenulls=True).over(within)
    out = out.withColumns({
        "_cancel": seen(F.col("signal") == "cancel"),
        "_started": seen(F.col("signal") == "started"),
        "_over": seen(F.col("signal") == "exit"),
        "_end": F.last(F.when(F.col("accepted"), F.col("terminal_type")), ignorenulls=True).over(within),
        "_result": seen(F.col("has_result")),
        "_error": seen(F.col("has_error")),
        "_code": last(F.col("exit_code")),
        "_crashed": last(F.col("crashed")),
    })
    ended = outcome(F.col("_code"), F.coalesce("_crashed", F.lit(False)), F.col("_end"), F.col("_result"), F.col("_error"), F.col("_cancel"))
    state = F.when(F.col("run") == 0, "idle").when(F.col("_over"), ended).when(F.col("_cancel"), "cancelling").when(F.col("_started"), "running").otherwise("starting")
    return out.select(*signals.columns, F.col("run").cast("int").alias("run"), state.alias("state"), "accepted")


def overall_progress(type_: Column, stage: Column, ratio: Column) -> Column:
    """Percent of the whole job at an event: a stage's start, its end, or its share in between."""
    bound = lambda i: F.coalesce(*(F.when(stage == n, F.lit(r[i])) for n, r in STAGES.items()), F.lit((0, 100)[i]))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0))))
    between = F.bround(bound(0) + (bound(1) - bound(0)) * share, 0)
    return F.when(type_ == "stage_started", bound(0)).when(type_ == "stage_completed", bound(1)).when(type_ == "progress", between).cast("int")


def progress(done: Column, total: Column) -> dict[str, Column]:
    """ratio and percent of counted work."""
    ratio = F.when(total > 0, F.least(F.lit(1.0), done / total)).otherwise(1.0)
    return {"ratio": ratio, "percent": F.round(ratio * 100, 2)}


#: fixed values: what the engine says of a frame without text
EMPTY_FRAME = ("the text detection result is empty", "the identified content is empty")


#: ECMA-48: a control sequence is CSI, parameter bytes, intermediate bytes and a final byte; CSI is ESC [ or the one
#: character 9B.  OSC (and the other strings DCS, SOS, PM, APC) last to BEL or ST.  Any other ESC takes intermediate
#: bytes and one final byte
_CSI = "(?:\\x1b\\[|\\x{9b})[\\x30-\\x3f]*[\\x20-\\x2f]*[\\x40-\\x7e]"
_STRING = "(?:\\x1b[\\]PX^_]|[\\x{90}\\x{98}\\x{9d}-\\x{9f}])[^\\x07\\x1b\\x{9c}]*(?:\\x07|\\x1b\\x5c|\\x{9c})"
_ESCAPE = "\\x1b[\\x20-\\x2f]*[\\x30-\\x7e]"


def strip_ansi(text: Column) -> Column:
    """Terminal control sequences removed."""
    return F.regexp_replace(text, f"{_STRING}|{_CSI}|{_ESCAPE}", "")


def routine_warning(line: Column, engine_tag: str) -> Column:
    """Whether a log line is the engine's usual warning that a frame holds no text; engine_tag: its name in brackets."""
    bare = F.lower(strip_ansi(line))
    found = F.lit(False)
    for message in EMPTY_FRAME:
        found |= F.contains(bare, F.lit(message))
    return F.contains(bare, F.lit("[warning]")) & F.contains(bare, F.lit(engine_tag.lower())) & found
