"""Hand-off tables named by what they are made of, so that any later session finds them.

A hand-off lives under ``<shared root>/stages/<name>-<key>``.  The key is a digest
of the stage's name and parameters, of the input files (names, sizes, times) and
of the library's own source, so a table is read again exactly while all of these
are the same.

* A build writes to an attempt folder of its own.  The table exists once the marker
  ``commit.json`` does, which names the attempt and holds its row count; of two
  builders the first marker counts, and the other's attempt is deleted.  An attempt
  without a marker is the remains of a lost driver and is never read.
* Who reads a table leaves a reference with its application id, and takes it away
  at the end.  ``collect`` deletes tables without a reference, attempts that no
  marker names, and references and attempts older than an age that no run reaches.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cache
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_root
from ..sources.files import write_counted

MARKER, WEEK = "commit.json", 7 * 86400.0


@dataclass(frozen=True)
class Handoff:
    """A committed table: where it is, what its marker says, and whether this call built it."""

    folder: str
    marker: dict[str, Any]
    built: bool

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{self.marker['attempt']}")


class _Store:
    """The few file operations hand-offs need, through the session's file system."""

    def __init__(self, spark: SparkSession, path: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._jvm = spark._jvm
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def list(self, path: str) -> list[tuple[str, float, int]]:
        """(name, modification time in seconds, bytes) of what is in a folder; a folder counts all it holds."""
        at = self._path(path)
        if not self._fs.exists(at):
            return []
        out = []
        for s in self._fs.listStatus(at):
            size = self._fs.getContentSummary(s.getPath()).getLength() if s.isDirectory() else s.getLen()
            out.append((s.getPath().getName(), s.getModificationTime() / 1000.0, int(size)))
        return sorted(out)

    def text(self, path: str) -> str | None:
        at = self._path(path)
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def create(self, path: str, text: str, overwrite: bool = False) -> bool:
        """Write a small file; False if it is there already and may not be overwritten."""
        at = self._path(path)
        if not overwrite and self._fs.exists(at):
            return False
        try:
            stream = self._fs.create(at, overwrite)
        except Exception as e:  # noqa: BLE001  the file came in between
            if "FileAlreadyExists" in str(e):
                return False
            raise
        stream.write(text.encode("utf-8"))
        stream.close()
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


@cache
def code_version() -> str:
    """Digest of the library's source, without the corpus part, which no hand-off uses."""
    root = Path(__file__).resolve().parents[1]
    files = sorted(p for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm")
    return hashlib.sha256(b"".join(str(p.relative_to(root)).encode() + b"\0" + p.read_bytes() for p in files)).hexdigest()


def input_state(spark: SparkSession, sf_dir: str) -> list[tuple[str, float, int]]:
    """Names, times and sizes of the input tables."""
    return [f for f in _Store(spark, sf_dir).list(sf_dir) if f[0].endswith(".parquet")]


def stage_key(spark: SparkSession, sf_dir: str, name: str, params: Mapping[str, Any] | None = None) -> str:
    made_of = [name, sf_dir.rstrip("/"), params or {}, input_state(spark, sf_dir), code_version()]
    return hashlib.sha256(json.dumps(made_of, sort_keys=True, default=str).encode()).hexdigest()[:32]


def _marker(store: _Store, folder: str) -> dict[str, Any] | None:
    text = store.text(f"{folder}/{MARKER}")
    try:
        return json.loads(text) if text else None
    except ValueError:  # a marker that is still being written
        return None


_REFERENCES: dict[str, set[str]] = {}


def _refer(spark: SparkSession, store: _Store, folder: str) -> None:
    app = spark.sparkContext.applicationId
    if folder not in _REFERENCES.setdefault(app, set()):
        store.create(f"{folder}/refs/{app}", str(time.time()), overwrite=True)
        _REFERENCES[app].add(folder)
        atexit.unregister(_release_at_exit)
        atexit.register(_release_at_exit)


def release(spark: SparkSession) -> None:
    """Take away this application's references; ``collect`` may then delete what nobody else uses."""
    app = spark.sparkContext.applicationId
    for folder in _REFERENCES.pop(app, set()):
        _Store(spark, folder).delete(f"{folder}/refs/{app}")


def _release_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        release(spark)


def write_once(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame],
               params: Mapping[str, Any] | None = None) -> Handoff:
    """The hand-off ``name`` over the tables in ``sf_dir``: found, or else built and committed."""
    folder = f"{shared_root(spark)}/stages/{name}-{stage_key(spark, sf_dir, name, params)}"
    store = _Store(spark, folder)
    found = _marker(store, folder)
    if found is None:
        attempt = f"attempt-{uuid.uuid4().hex}"
        rows = write_counted(build(), f"{folder}/{attempt}")
        own = {"stage": name, "attempt": attempt, "rows": rows, "application": spark.sparkContext.applicationId, "written": time.time()}
        if store.create(f"{folder}/{MARKER}", json.dumps(own)):
            _refer(spark, store, folder)
            return Handoff(folder, own, True)
        store.delete(f"{folder}/{attempt}")  # another builder was first
        found = _marker(store, folder)
        if found is None:
            raise RuntimeError(f"the marker of {folder} cannot be read")
    _refer(spark, store, folder)
    return Handoff(folder, found, False)


def collect(spark: SparkSession, max_age: float = WEEK) -> list[str]:
    """Delete tables without a reference, attempts no marker names, and references and attempts older than ``max_age`` seconds."""
    root, now, gone = f"{shared_root(spark)}/stages", time.time(), []
    store = _Store(spark, root)
    for name, _, _ in store.list(root):
        folder = f"{root}/{name}"
        marker = _marker(store, folder)
        live = [app for app, at, _ in store.list(f"{folder}/refs") if now - at <= max_age]
        young = [a for a, at, _ in store.list(folder) if a.startswith("attempt-") and (marker is None or a != marker["attempt"]) and now - at <= max_age]
        if marker is not None and live:
            for a, at, _ in store.list(folder):
                if a.startswith("attempt-") and a != marker["attempt"] and a not in young:
                    store.delete(f"{folder}/{a}")
                    gone.append(f"{name}/{a}")
        elif not young:
            store.delete(folder)
            gone.append(name)
    return gone
