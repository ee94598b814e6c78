"""Line switches over noisy text observations, one track after another.

The tracker reads a track's observations in order and keeps two clusters: the
line on screen and the one that may follow it.  A cluster keeps its
observations and, per display text, what the consensus needs, so a comparison
costs one distance per distinct text.  The same tracker serves the batch pass,
which streams sorted partitions and never holds more than the open clusters,
and the stateful stream.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator
from math import ceil
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from verseline.config import Parameters
from verseline.functions.text import edit_distance, insert_spaces
from verseline.operators.observations import spread
from verseline.schemas import FOUND, FOUND_BARE, OBSERVATION

#: fixed values: votes a blank needs; how alike near-exact variants are, and the frames they need on top
SPACE_VOTES, SPACE_SHARE = 2, 0.30
NEAR_EXACT, NEAR_EXACT_FRAMES = 95.0, 1


class Seen(NamedTuple):
    """One observation."""

    frame: str
    time: float
    raw_text: str
    display_text: str
    match_text: str
    confidence: float
    box: list | None
    status: str | None
    boundaries: list | None


def _bounds(box: list | None) -> tuple[float, float] | None:
    """Top and bottom of a box."""
    if not box:
        return None
    if len(box) == 2 and (box[1][0] < box[0][0] or box[1][1] < box[0][1]):
        return None
    ys = [p[1] for p in box if p is not None and len(p) >= 2]
    return (min(ys), max(ys)) if ys else None


def same_row(a: list | None, b: list | None) -> bool:
    a, b = _bounds(a), _bounds(b)
    if a is None or b is None:
        return False
    low, high = sorted((max(a[1] - a[0], 1.0), max(b[1] - b[0], 1.0)))
    overlap = max(0.0, min(a[1], b[1]) - max(a[0], b[0]))
    return overlap / low >= 0.60 and abs(sum(a) - sum(b)) / 2 / high <= 0.40


def same_line(a: Seen, b: Seen, style: str, threshold: float) -> bool:
    """Whether b may show the line that a shows.  In typewriter style b may also continue a."""
    left, right = a.match_text, b.match_text
    if not left or not right:
        return False
    if left == right or style == "typewriter" and right.startswith(left):
        return True
    short, long = sorted((len(left), len(right)))
    if long >= 5:
        return short / long >= 0.70 and 100.0 * (1.0 - edit_distance(left, right) / long) >= threshold
    # of short texts only noise counts: one edit, at once, in place, and unsure
    return long >= 3 and edit_distance(left, right) == 1 and abs(b.time - a.time) <= 0.50 and same_row(a.box, b.box) and min(a.confidence, b.confidence) < 0.80


class Cluster:
    """Observations of one line, summed up by display text in order of appearance.

    keep: also holds the observations themselves, as the line's candidates.
    """

    def __init__(self, style: str, first: Seen, keep: bool = True):
        self.style = style
        self.size, self.total = 0, 0.0
        self.first = self.best = first
        self.start = self.end = first.time
        self.last: deque[Seen] = deque(maxlen=5)
        #: of each display text: match text, observations, sum of confidences, the surest one, its total distance
        self.faces: dict[str, list] = {}
        self.matches: Counter[str] = Counter()
        #: votes for blanks by match text
        self.votes: dict[str, Counter[int]] = {}
        self.kept: list[Seen] | None = [] if keep else None
        self._face: tuple[str, Seen] | None = None
        self.add(first)

    def add(self, one: Seen) -> None:
        self.size += 1
        self.total += one.confidence
        self.start, self.end = min(self.start, one.time), max(self.end, one.time)
        if one.confidence > self.best.confidence:
            self.best = one
        self.last.append(one)
        if self.kept is not None:
            self.kept.append(one)
        match = one.match_text
        self.matches[match] += 1
        if one.boundaries is not None and len(one.boundaries):
            self.votes.setdefault(match, Counter()).update(set(one.boundaries))
        if match:
            face = self.faces.get(one.display_text)
            if face is None or len(self.faces) > 1:
                for other in self.faces.values():
                    other[4] += edit_distance(other[0], match)
            if face is None:
                cost = sum(n * edit_distance(match, other) for other, n in self.matches.items() if other)
                self.faces[one.display_text] = [match, 1, one.confidence, one, cost]
            else:
                face[1] += 1
                face[2] += one.confidence
                if one.confidence > face[3].confidence:
                    face[3] = one
        self._face = None

    def medoid(self) -> str:
        """The display text nearest to all observations; then surest, longest, first."""
        if len(self.faces) == 1:
            return next(iter(self.faces))
        return min(self.faces, key=lambda t: ((f := self.faces[t])[4], -f[2] / f[1], -len(f[0])), default="")

    def face(self, style: str | None = None) -> Seen:
        """The observation that stands for the cluster."""
        style = style or self.style
        if self._face is None or self._face[0] != style:
            if style == "typewriter":
                chosen = max(self.last, key=lambda s: (len(s.match_text), s.confidence, s.time))
            else:
                face = self.faces.get(self.medoid())
                chosen = self.best if face is None else face[3]
            self._face = style, chosen
        return self._face[1]

    def spaces(self) -> list[dict]:
        """Places of the face's match text that enough of the equal observations vote a blank for."""
        whole = self.face().match_text
        votes = self.votes.get(whole)
        if not votes:
            return []
        equal = self.matches[whole]
        least = max(SPACE_VOTES, ceil(equal * SPACE_SHARE))
        return [{"position": p, "votes": n, "compatible_frames": equal, "ratio": round(n / equal, 6)} for p, n in sorted(votes.items()) if n >= least and 0 < p < len(whole)]

    def row(self, track: str, kind: str, reason: str | None, ordinal: int) -> tuple:
        """A row of FOUND."""
        spaces = self.spaces()
        shown = self.face().display_text
        text = insert_spaces(shown, [s["position"] for s in spaces]) if spaces else " ".join(shown.split())
        row = (track, kind, reason, ordinal, self.start, self.end, text, round(self.total / self.size, 6), self.size, spaces)
        return row if self.kept is None else (*row, [s._asdict() for s in self.kept])


class Tracker:
    """The state of one track; feed() and finish() give finished rows."""

    def __init__(self, track: str, style: str, parameters: Parameters, keep: bool = True):
        self.keep = keep
        self.track, self.style, self.p = track, "line" if style in ("auto", "uncertain", None) else style, parameters
        self.shown: Cluster | None = None
        self.next: Cluster | None = None
        self.blanks = self.ordinal = 0
        self.out: list[tuple] = []

    def _emit(self, cluster: Cluster, kind: str, reason: str | None = None) -> None:
        self.out.append(cluster.row(self.track, kind, reason, self.ordinal))
        self.ordinal += 1

    def _close(self) -> None:
        if self.shown:
            self._emit(self.shown, "line")
            self.shown = None

    def _drop_next(self, reason: str) -> None:
        if self.next:
            self._emit(self.next, "rejected", reason)
            self.next = None

    def _joins(self, cluster: Cluster, one: Seen) -> bool:
        return same_line(cluster.face(), one, self.style, self.p.same_threshold)

    def _near_exact(self) -> bool:
        """The next line's first frame differs from the line shown by one character of a long text."""
        left, right = self.shown.face("line").match_text, self.next.first.match_text
        if not left or len(left) != len(right) or edit_distance(left, right) != 1:
            return False
        return 100.0 * (1.0 - 1 / len(left)) >= max(self.p.same_threshold, NEAR_EXACT)

    def feed(self, one: Seen) -> list[tuple]:
        self.out = []
        unsure = one.status == "low_confidence"
        if not unsure and not one.display_text:
            self.blanks += 1
            if self.blanks > self.p.max_blank_frames:
                self._close()
                self._drop_next("blank_timeout")
            return self.out
        if unsure or one.confidence < self.p.confidence_threshold:
            self._emit(Cluster("line", one, self.keep), "low_confidence", "low_confidence")
            return self.out
        self.blanks = 0
        if self.shown and (self.shown.matches[one.match_text] or self.style == "typewriter" and self._joins(self.shown, one)):
            self._drop_next("ocr_jitter")
            self.shown.add(one)
            return self.out
        if self.next and self._joins(self.next, one):
            self.next.add(one)
        else:
            self._drop_next("unstable_pending")
            self.next = Cluster(self.style, one, self.keep)
        needed = self.p.switch_confirm_frames
        if self.shown and self.style == "line" and self._near_exact():
            needed += NEAR_EXACT_FRAMES
        if self.next.size >= needed:
            self._close()
            self.shown, self.next = self.next, None
        return self.out

    def finish(self) -> list[tuple]:
        self.out = []
        self._drop_next("unconfirmed_eof")
        self._close()
        return self.out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def detect(observations: DataFrame, parameters: Parameters | None = None, candidates: bool = True) -> DataFrame:
    """Lines, rejected clusters and low-confidence observations of all tracks, told apart by ``kind``.

    One exchange by track, then a single sorted pass; a track is in order of
    (time, source_index).  Memory holds the open clusters of one track.  Without
    ``candidates`` the observations of a line are not listed, so they need not be
    held, and neither names, raw texts nor boxes that no short text needs travel.
    """
    p = parameters or Parameters()
    found_type = observations.sparkSession.createDataFrame([], FOUND if candidates else FOUND_BARE).schema
    schema = to_arrow_schema(found_type)
    names = [c.split()[0] for c in OBSERVATION.split(", ") if candidates or c.split()[0] not in ("frame", "raw_text", "box", "source_index")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tracker: Tracker | None = None
        rows: list[tuple] = []
        for batch in batches:
            nothing = [None] * batch.num_rows
            at = {n: batch.column(i).to_pylist() if batch.column(i).null_count < batch.num_rows else nothing for i, n in enumerate(batch.schema.names)}
            seen = map(Seen, *(at.get(f, nothing) for f in Seen._fields))
            for track, style, one in zip(at["track_id"], at["style"], seen):
                if tracker is None or tracker.track != track:
                    if tracker is not None:
                        rows += tracker.finish()
                    tracker = Tracker(track, style, p, candidates)
                if found := tracker.feed(one):
                    rows += found
            if len(rows) > 2000:
                yield _batch(rows, schema)
                rows = []
        if tracker is not None:
            rows += tracker.finish()
        if rows:
            yield _batch(rows, schema)

    needed = observations if candidates else observations.withColumn("box", F.when(F.length("match_text").between(1, 4), F.col("box")))
    keys = ["track_id", "time", "source_index"]
    ready = spread(needed.select(*dict.fromkeys([*names, *keys, "box"])), "track_id").sortWithinPartitions(*keys)
    return ready.select(*names, *([] if candidates else ["box"])).mapInArrow(run, found_type)


def lines_of(found: DataFrame) -> DataFrame:
    """The lines alone, with start_time_raw."""
    return found.where("kind = 'line'").withColumn("start_time_raw", F.col("start_time"))
