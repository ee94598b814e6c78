"""Reuse of stage results through content-addressed keys.

A stage's key hashes its parameters, the versions of what computes it and the
key of the stage before it, so a change reaches every later stage and none
before.  Results are Parquet folders; a manifest says which key each holds.
Run folders may be on any file system that Spark reads; on a cluster they must
be, as executors write the tables.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Callable
from datetime import datetime, timezone
from importlib import metadata
from pathlib import Path
from typing import Any
from urllib.parse import unquote, urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from verseline.sources.files import Files, stable_hash, uri

FORMAT = 1
ORDER = ("extract", "ocr", "detector", "writer")


def versions(*packages: str) -> dict[str, str | None]:
    def one(name: str) -> str | None:
        try:
            return metadata.version(name)
        except metadata.PackageNotFoundError:
            return None

    return {p: one(p) for p in packages}


def chain_keys(settings: dict[str, Any]) -> dict[str, str]:
    """A key for each stage of ORDER from its settings and the key before."""
    out, before = {}, None
    for name in ORDER:
        before = out[name] = stable_hash({"stage": name, "settings": settings.get(name), "before": before, "format": FORMAT})
    return out


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


class Run:
    """A run folder: manifest, stage tables and an exclusive lock; use as a context manager."""

    def __init__(self, spark: SparkSession, root: str | Path, base: str, resume: bool = False):
        self.spark, self.files, self.root = spark, Files(spark), uri(root).rstrip("/")
        self.files.make(self.root)
        same = sorted((at, name) for at, name in self.files.folders(self.root) if name == base or name.startswith(base + "-"))
        if resume and same:
            name = same[-1][1]
        else:
            name = base if not self.files.exists(f"{self.root}/{base}") else f"{base}-{uuid.uuid4().hex[:8]}"
            self.files.make(f"{self.root}/{name}")
        self.folder = f"{self.root}/{name}"
        self.lock = f"{self.folder}/.lock"
        self.manifest = self._load()

    def __enter__(self) -> "Run":
        if not self.files.claim(self.lock):
            raise RuntimeError(f"{self.folder} is in use")
        self.manifest["attempt"] = self.manifest.get("attempt", 0) + 1
        self.manifest["status"] = "running"
        self._save()
        return self

    def __exit__(self, kind, *_) -> None:
        self.manifest["status"] = "complete" if kind is None else "cancelled" if issubclass(kind, Cancelled) else "interrupted" if issubclass(kind, KeyboardInterrupt) else "failed"
        self._save()
        self.files.delete(self.lock)

    def _load(self) -> dict:
        empty = {"format": FORMAT, "stages": {}}
        path = f"{self.folder}/manifest.json"
        if not self.files.exists(path):
            return empty
        try:
            found = json.loads(self.files.read(path))
        except ValueError:
            return empty
        return found if isinstance(found, dict) and found.get("format") == FORMAT else empty

    def _save(self) -> None:
        self.files.write(f"{self.folder}/manifest.json", json.dumps(self.manifest, indent=2), overwrite=True)

    def reusable(self, stage: str, key: str, schema: StructType | None = None) -> DataFrame | None:
        """The stage's table if its key fits and it can be read with the schema."""
        entry = self.manifest["stages"].get(stage)
        if not entry or entry["key"] != key:
            return None
        try:
            found = self.spark.read.parquet(f"{self.folder}/{entry['table']}")
        except AnalysisException:
            return None
        return found if schema is None or [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in schema] else None

    def invalidate(self, *stages: str) -> None:
        for s in stages:
            self.manifest["stages"].pop(s, None)
        self._save()

    def stage(self, name: str, key: str, make: Callable[[], DataFrame], schema: StructType | None = None) -> DataFrame:
        """The reused table, or a new one; the old key and those of all later stages go before the table is replaced."""
        if (found := self.reusable(name, key, schema)) is not None:
            entry = self.manifest["stages"][name]
            entry |= {"reused": True, "reuse_count": entry["reuse_count"] + 1, "last_reused_at": _now()}
            self._save()
            return found
        self.invalidate(*ORDER[ORDER.index(name) :] if name in ORDER else (name,))
        table = f"{name}-{key[:16]}"
        make().write.mode("overwrite").parquet(f"{self.folder}/{table}")
        self.manifest["stages"][name] = {"key": key, "table": table, "completed_at": _now(), "reused": False, "reuse_count": 0, "last_reused_at": None}
        self._save()
        return self.spark.read.parquet(f"{self.folder}/{table}")

    def check_output(self, source: str | Path, output: str | Path) -> str:
        """The output's path; it must not be the source, nor lie where runs are kept."""
        to, here = _plain(output), _plain(self.root)
        if to == _plain(source):
            raise ValueError("the output would overwrite the source")
        if to == here or to.startswith(here + "/"):
            raise ValueError("the output must be outside of the run folders")
        return uri(output)

    def clean(self, name: str = "frames") -> bool:
        """Deletes a folder of this run by its name; False if there is none.  Whatever is not a plain folder inside the
        run's own is refused: a path, a link, the run itself."""
        if not name or "/" in name or "\\" in name or name in (".", ".."):
            raise ValueError(f"{name!r} names no folder of a run")
        run = self.folder.rpartition("/")
        if run[2] not in {n for _, n in self.files.folders(self.root)}:
            raise ValueError(f"{self.folder} is no folder of its own")
        if not self.files.exists(f"{self.folder}/{name}"):
            return False
        if name not in {n for _, n in self.files.folders(self.folder)}:
            raise ValueError(f"{name} is a link or no folder")
        return self.files.delete(f"{self.folder}/{name}")


def _plain(path: str | Path) -> str:
    """A path without links and detours, for comparison."""
    text = uri(path)
    if not text.startswith("file:"):
        return text.rstrip("/")
    return "file://" + str(Path(unquote(urlparse(text).path)).resolve())


class Cancelled(Exception):
    """The job was asked to stop."""


class Cancellation:
    """Asked to stop by a marker file, a callable or a call."""

    def __init__(self, marker: str | Path | None = None, asked: Callable[[], bool] | None = None):
        self.marker, self.asked, self.done = Path(marker) if marker else None, asked, False

    def cancel(self) -> None:
        self.done = True

    def is_cancelled(self) -> bool:
        return self.done or bool(self.asked and self.asked()) or bool(self.marker and self.marker.exists())

    def check(self) -> None:
        if self.is_cancelled():
            raise Cancelled


class Events:
    """Events of one job to a sink: an object with emit, a list or a callable.  After the first terminal event nothing
    more is sent.  A sink that fails does not fail the job: it is left alone from there on, and ``delivery_error`` tells
    what went wrong."""

    def __init__(self, sink: Any, job_id: str):
        self.sink, self.job_id, self.seq, self.terminal = sink, job_id, 0, None
        self.delivery_error: Exception | None = None

    def emit(self, kind: str, **payload: Any) -> dict | None:
        if self.terminal:
            return None
        self.seq += 1
        event = {**payload, "type": kind, "event": kind, "job_id": self.job_id, "seq": self.seq, "timestamp": _now()}
        if kind in ("completed", "cancelled", "failed"):
            self.terminal = kind
        if self.delivery_error is None and self.sink is not None:
            try:
                send = getattr(self.sink, "emit", None) or getattr(self.sink, "append", None) or self.sink
                send(event)
            except Exception as e:
                self.delivery_error = e
                warnings.warn(f"events are no longer delivered: {type(e).__name__}: {e}", RuntimeWarning, stacklevel=2)
        return event
