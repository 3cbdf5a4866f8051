"""A job as resumable stages: each writes its table and a manifest, and a rerun starts at the first that differs.

A stage's key is a hash of its name, version and settings, of the files it reads (path,
size, time of change) and of the keys of the stages before it that it takes. A stage whose
manifest has this key is not run again; its table is read. A table counts only with its
manifest, which is written last, so a stage that was stopped is run anew.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

VERSION = "1"


@dataclass
class Stage:
    """run(spark, inputs, settings) gives the table; ``takes`` names earlier stages, ``reads`` paths of files."""

    name: str
    run: Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]
    takes: tuple[str, ...] = ()
    reads: tuple[str, ...] = ()
    settings: dict = field(default_factory=dict)


class Files:
    """What is needed of Hadoop's file systems, which reach every store that Spark does."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def listing(self, path: str) -> list[tuple[str, int, int]]:
        """(path, size, time of change) of all files below, sorted."""
        store, p = self._at(path)
        found, each = [], store.listFiles(p, True)
        while each.hasNext():
            s = each.next()
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(found)

    def read(self, path: str) -> str | None:
        store, p = self._at(path)
        if not store.exists(p):
            return None
        stream = store.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Under another name first, so that a reader sees all of it or nothing."""
        store, p = self._at(path)
        _, part = self._at(f"{path}.{uuid.uuid4().hex}")
        out = store.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        store.delete(p, False)
        store.rename(part, p)

    def delete(self, path: str) -> None:
        store, p = self._at(path)
        store.delete(p, True)


def key_of(stage: Stage, before: dict[str, str], files: Files, version: str) -> str:
    whole = {"name": stage.name, "version": version, "settings": stage.settings, "takes": {t: before[t] for t in stage.takes}, "reads": {r: files.listing(r) for r in stage.reads}}
    return hashlib.sha256(json.dumps(whole, sort_keys=True, default=str).encode()).hexdigest()


def run_stages(spark: SparkSession, stages: list[Stage], folder: str, version: str = VERSION) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables of all stages by name, and the names of those that were run, not taken over."""
    files, keys, tables, ran = Files(spark), {}, {}, []
    for stage in stages:
        missing = [t for t in stage.takes if t not in tables]
        if missing:
            raise ValueError(f"stage {stage.name} takes {', '.join(missing)}, which no stage before it makes")
        keys[stage.name] = key_of(stage, keys, files, version)
        manifest = f"{folder}/{stage.name}.json"
        held = json.loads(files.read(manifest) or "{}")
        if held.get("key") != keys[stage.name]:
            path = f"{folder}/{stage.name}-{keys[stage.name][:16]}"
            stage.run(spark, {t: tables[t] for t in stage.takes}, stage.settings).write.mode("overwrite").parquet(path)
            files.write(manifest, json.dumps({"key": keys[stage.name], "path": path, "settings": stage.settings, "version": version}, default=str))
            if held.get("path") not in (None, path):
                files.delete(held["path"])
            held = {"path": path}
            ran.append(stage.name)
        tables[stage.name] = spark.read.parquet(held["path"])
    return tables, ran
