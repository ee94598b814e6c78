"""Line detection over a stream, by the tracker of the batch pass.

For complete input in order the streamed lines equal the batch result.  A row
with status ``end`` closes its track; without one, the watermark does once it
has passed the track's last row by the idle time.
Rows older than what a track has already read are reported as kind ``late``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verseline.config import Parameters
from verseline.operators.line_tracker import Seen, Tracker
from verseline.schemas import FOUND

END = "end"
#: a stream's watermark starts at 0, so event times are moved past it
SHIFT_MS = 86_400_000
_FIELDS = ["frame", "time", "raw_text", "display_text", "match_text", "confidence", "box", "status", "boundaries"]


def detect_stream(observations: DataFrame, parameters: Parameters | None = None, idle_ms: int = 60_000, delay: str = "10 seconds") -> DataFrame:
    """Streaming counterpart of ``detect`` for observations; styles are 'line' and 'typewriter' only, as a hint needs the whole track.

    Times are seconds of one clock for all tracks; the watermark stays ``delay`` behind the latest.
    """
    p = parameters or Parameters()
    found_names = [f.split()[0] for f in _top_level(FOUND)]

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker: Tracker | None = None
        last = float("-inf")
        if state.exists:
            tracker, last = pickle.loads(state.get[0])
        rows: list[tuple] = []
        if state.hasTimedOut:
            if tracker is not None:
                rows = tracker.finish()
            state.remove()
        else:
            ended = False
            data = pd.concat(list(parts)).sort_values(["time", "source_index"])
            for r in data.itertuples(index=False):
                if r.status == END:
                    ended = True
                    continue
                if tracker is None:
                    tracker = Tracker(key[0], r.style, p)
                one = Seen(*(getattr(r, f) for f in _FIELDS))._replace(box=_plain(r.box), boundaries=_plain(r.boundaries))
                if r.time < last:
                    rows.append((key[0], "late", "late", -1, r.time, r.time, r.display_text, r.confidence, 1, [], [one._asdict()]))
                    continue
                last = r.time
                rows += tracker.feed(one)
            if ended:
                rows += tracker.finish() if tracker is not None else []
                if state.exists:
                    state.remove()
            else:
                state.update((pickle.dumps((tracker, last)),))
                state.setTimeoutTimestamp(int(max(last * 1000 + SHIFT_MS, state.getCurrentWatermarkMs(), 0)) + idle_ms)
        yield pd.DataFrame(rows, columns=found_names)

    timed = observations.withColumn("event_time", F.timestamp_millis((F.col("time") * 1000).cast("long") + SHIFT_MS)).withWatermark("event_time", delay)
    return timed.groupBy("track_id").applyInPandasWithState(run, FOUND, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def _plain(value):
    return None if value is None else [_plain(v) if hasattr(v, "__len__") else v for v in value]


def _top_level(schema: str) -> list[str]:
    """The fields of a schema text, cut at its outer commas."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def event_progress(events: DataFrame) -> DataFrame:
    """Overall progress of a stream of parsed job events, as a running maximum per job."""
    from verseline.sources.event_log import overall_progress

    percent = overall_progress(F.col("event.type"), F.col("event.stage"), F.col("event.ratio"))
    return events.where("issue is null").groupBy("event.job_id").agg(F.max(percent).alias("percent"))
