"""Files of any Hadoop file system, from the driver: whatever paths Spark reads, and local ones."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


def stable_hash(value: Any) -> str:
    """SHA-256 of the canonical JSON form."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def uri(path: str | Path) -> str:
    """A path as Spark takes it: one without a scheme is a local file."""
    text = str(path)
    return text if "://" in text or text.startswith("file:/") else Path(text).absolute().as_uri()


class Files:
    """One file system's files."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str | Path):
        where = self._jvm.org.apache.hadoop.fs.Path(uri(path))
        fs = where.getFileSystem(self._conf)
        # local files go without checksum files beside them
        return fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs, where

    def exists(self, path: str | Path) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def make(self, path: str | Path) -> None:
        fs, where = self._at(path)
        fs.mkdirs(where)

    def folders(self, path: str | Path) -> list[tuple[int, str]]:
        """(modification time, name) of the folders in a folder; links are no folders."""
        fs, where = self._at(path)
        if not fs.exists(where):
            return []
        plain = lambda s: s.isDirectory() and not s.isSymlink() and not (fs.getUri().getScheme() == "file" and os.path.islink(s.getPath().toUri().getPath()))
        return [(s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(where) if plain(s)]

    def stamp(self, path: str | Path) -> tuple[int, int]:
        """(size, modification time)."""
        fs, where = self._at(path)
        status = fs.getFileStatus(where)
        return status.getLen(), status.getModificationTime()

    def listed(self, path: str | Path) -> list[tuple[str, int, int]]:
        """(path, size, modification time) of a file, or of all files below a folder, in order of their paths."""
        fs, where = self._at(path)
        found, out = fs.listFiles(where, True), []
        while found.hasNext():
            one = found.next()
            out.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
        return sorted(out)

    def read(self, path: str | Path) -> bytes:
        fs, where = self._at(path)
        stream = fs.open(where)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def delete(self, path: str | Path) -> bool:
        fs, where = self._at(path)
        return fs.delete(where, True)

    def claim(self, path: str | Path) -> bool:
        """Makes an empty file; False if there is one already."""
        fs, where = self._at(path)
        try:
            fs.create(where, False).close()
        except Exception as e:  # py4j has one class for all Java exceptions
            if fs.exists(where):
                return False
            raise OSError(str(e)) from e
        return True

    def write(self, path: str | Path, data: str | bytes, overwrite: bool = False) -> str:
        """Writes beside the target and moves into place; refuses an existing target unless told."""
        fs, where = self._at(path)
        if not overwrite and fs.exists(where):
            raise FileExistsError(str(path))
        fs.mkdirs(where.getParent())
        beside = self._jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{where.getName()}.{uuid.uuid4().hex}")
        stream = fs.create(beside, False)
        try:
            stream.write(bytearray(data.encode() if isinstance(data, str) else data))
            stream.hsync()
            stream.close()
            options = self._jvm.org.apache.hadoop.fs.Options.Rename
            how = self.spark.sparkContext._gateway.new_array(options, 1)
            how[0] = options.OVERWRITE if overwrite else options.NONE
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self._conf).rename(beside, where, how)
        except Exception as e:
            fs.delete(beside, False)
            if not overwrite and fs.exists(where):
                raise FileExistsError(str(path)) from e
            raise OSError(str(e)) from e
        return uri(path)
