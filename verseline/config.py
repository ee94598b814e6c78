"""Parameters of line detection, and the description of a job."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields
from pathlib import Path

STYLES = ("line", "typewriter", "auto")
ROWS = ("auto", "top", "bottom")


def _number(name: str, value: object, low: float, high: float = math.inf, open_low: bool = False) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    if value < low or value > high or open_low and value == low:
        raise ValueError(f"{name} is out of range")


def _whole(name: str, value: object, low: int | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or low is not None and value < low:
        raise ValueError(f"{name} must be an integer" + ("" if low is None else f" of {low} or more"))


@dataclass(frozen=True)
class Parameters:
    """Everything that decides which lines are found; checked on construction."""

    fps: float = 4
    workers: int = 4
    crop_bottom_ratio: float | None = None
    roi: tuple[float, float, float, float] | None = None
    confidence_threshold: float = 0.50
    raw_score_floor: float = 0.10
    same_threshold: float = 90.0
    switch_confirm_frames: int = 2
    min_line_gap_ms: int = 800
    max_blank_frames: int = 2
    offset_ms: int = 0
    style: str = "line"
    active_row: str = "auto"
    line_tolerance: float = 0.65
    min_similarity: float = 0.55
    gap_penalty: float = 0.35
    time_tolerance: float = 0.80

    def __post_init__(self):
        _number("fps", self.fps, 0, open_low=True)
        _whole("workers", self.workers, 1)
        _number("confidence_threshold", self.confidence_threshold, 0, 1)
        _number("raw_score_floor", self.raw_score_floor, 0, 1)
        _number("same_threshold", self.same_threshold, 0, 100)
        _whole("switch_confirm_frames", self.switch_confirm_frames, 1)
        _whole("min_line_gap_ms", self.min_line_gap_ms, 0)
        _whole("max_blank_frames", self.max_blank_frames, 0)
        _whole("offset_ms", self.offset_ms)
        _number("line_tolerance", self.line_tolerance, 0, open_low=True)
        _number("min_similarity", self.min_similarity, 0, 1)
        _number("gap_penalty", self.gap_penalty, 0)
        _number("time_tolerance", self.time_tolerance, 0)
        if self.style not in STYLES:
            raise ValueError(f"style must be one of {STYLES}")
        if self.active_row not in ROWS:
            raise ValueError(f"active_row must be one of {ROWS}")
        if self.roi is not None:
            if self.crop_bottom_ratio is not None:
                raise ValueError("roi and crop_bottom_ratio exclude each other")
            if len(self.roi) != 4:
                raise ValueError("roi must hold four numbers")
            x, y, w, h = self.roi
            for name, v in zip("xywh", self.roi):
                _number(f"roi {name}", v, 0, 1, open_low=name in "wh")
            if x + w > 1 or y + h > 1:
                raise ValueError("roi must stay inside the frame")
        if self.crop_bottom_ratio is not None:
            _number("crop_bottom_ratio", self.crop_bottom_ratio, 0, 1, open_low=True)

    @property
    def engine_score_floor(self) -> float:
        """What an engine is asked for: low, so that filtering stays a later step."""
        return min(self.raw_score_floor, self.confidence_threshold)


def short_number(value: float) -> str:
    """At most 12 significant digits, without trailing zeros."""
    return format(float(value), ".12g")


#: parameters that only the evaluation has
EVALUATION = ("min_similarity", "gap_penalty", "time_tolerance")


@dataclass(frozen=True)
class Job:
    """One table or folder of frames to process: input, output and parameters, as an argument list without a shell."""

    source: Path
    output: Path | None = None
    parameters: Parameters = field(default_factory=Parameters)
    workdir: Path | None = None
    force: bool = False
    resume: bool = False
    strict: bool = False
    keep_workdir: bool = False

    def __post_init__(self):
        object.__setattr__(self, "source", Path(self.source))
        if not str(self.source).strip() or str(self.source) == ".":
            raise ValueError("source is required")
        for name in ("output", "workdir"):
            if getattr(self, name) is not None:
                object.__setattr__(self, name, Path(getattr(self, name)))
        if self.output is not None and self.output == self.source:
            raise ValueError("the output would overwrite the source")
        for name in ("force", "resume", "strict", "keep_workdir"):
            if not isinstance(getattr(self, name), bool):
                raise ValueError(f"{name} must be true or false")

    @property
    def target(self) -> Path:
        return self.output or self.source.with_suffix(".lrc")

    def arguments(self, *, preview: bool = False, job_id: str | None = None, cancel_file: Path | None = None) -> list[str]:
        """The command line's arguments; of the parameters those that differ from the defaults."""
        out = ["detect", str(self.source), "--output", str(self.target)]
        base = Parameters()
        for f in fields(Parameters):
            value = getattr(self.parameters, f.name)
            if value == getattr(base, f.name) or f.name in EVALUATION:
                continue
            text = ",".join(map(short_number, value)) if isinstance(value, tuple) else value if isinstance(value, str) else short_number(value)
            # one word, as a value may begin with a minus sign
            out.append(f"--{f.name.replace('_', '-')}={text}")
        if self.workdir is not None:
            out += ["--workdir", str(self.workdir)]
        out += [f"--{n.replace('_', '-')}" for n in ("force", "resume", "strict", "keep_workdir") if getattr(self, n)]
        if preview:
            out.append("--preview-roi")
        if job_id is not None:
            if not job_id or "\0" in job_id:
                raise ValueError("job_id must be a text without null bytes")
            out += ["--event-stream", "--job-id", job_id]
        if cancel_file is not None:
            out += ["--cancel-file", str(cancel_file)]
        return out
