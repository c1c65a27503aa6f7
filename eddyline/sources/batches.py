"""Batch folders behind a manifest: atomic commits, replays and compaction.

A writer adds each batch as a Parquet folder of its own and then publishes a
manifest that names the live folders.  A manifest is written aside and renamed
to the next version number, so a reader sees all of a batch or nothing, and a
batch that fails half-way leaves an unnamed folder that no reader opens.

* A batch committed again replaces its own folder.
* ``compact`` merges levels: once ``fan`` folders of a level are there, they
  become one folder of the next level, so a row is rewritten once a level.  A
  batch that comes again after it was merged changes nothing.
* Folders that a manifest has dropped are deleted one version later, so a
  reader of the version before still finds them.

One writer at a time (a streaming query has one); any number of readers.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FAN = 10
_VERSION = re.compile(r"_live-(\d{12})\.json$")


class BatchFolders:
    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._text = jvm.org.apache.commons.io.IOUtils.toString
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ---- manifest ----------------------------------------------------------

    def _versions(self) -> list[int]:
        root = self._path(self.path)
        if not self._fs.exists(root):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(root))
        return sorted(int(m[1]) for m in map(_VERSION.match, names) if m)

    def _file(self, version: int) -> str:
        return f"{self.path}/_live-{version:012d}.json"

    def _manifest(self) -> tuple[int, dict]:
        versions = self._versions()
        if not versions:
            return 0, {"live": [], "dropped": []}
        stream = self._fs.open(self._path(self._file(versions[-1])))
        try:
            return versions[-1], json.loads(self._text(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, live: list[dict]) -> None:
        version, before = self._manifest()
        kept = {e["folder"] for e in live}
        dropped = [e["folder"] for e in before["live"] if e["folder"] not in kept]
        aside = self._path(f"{self.path}/_next-{uuid.uuid4().hex}")
        out = self._fs.create(aside, True)
        out.write(bytearray(json.dumps({"live": live, "dropped": dropped}).encode()))
        out.close()
        if not self._fs.rename(aside, self._path(self._file(version + 1))):
            raise OSError(f"another writer has published version {version + 1} of {self.path}")
        for folder in before["dropped"]:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        for old in self._versions()[:-2]:
            self._fs.delete(self._path(self._file(old)), False)

    # ---- writing -----------------------------------------------------------

    def _write(self, df: DataFrame, name: str) -> str:
        folder = f"{re.sub(r'[^A-Za-z0-9-]', '-', name)}.{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def commit(self, batch, df: DataFrame, *, alone: bool = False) -> None:
        """Add ``df`` as ``batch``, or replace that batch.  ``alone`` drops all
        other batches (a result that is complete each time)."""
        name = str(batch)
        live = self._manifest()[1]["live"]
        if any(name in e["batches"] and e["level"] for e in live):
            return                                   # merged already: a replay
        folder = self._write(df, name)
        rest = [] if alone else [e for e in live if name not in e["batches"]]
        self._publish([*rest, {"folder": folder, "level": 0, "batches": [name]}])

    def compact(self, merge: Callable[[DataFrame], DataFrame], schema: StructType) -> bool:
        """Merge every level that holds ``fan`` folders; whether any did."""
        done, level = False, 0
        while True:
            live = self._manifest()[1]["live"]
            if not any(e["level"] >= level for e in live):
                return done
            own = [e for e in live if e["level"] == level]
            if len(own) >= self.fan:
                folder = self._write(merge(self._rows(own, schema)), f"level-{level + 1}")
                merged = {"folder": folder, "level": level + 1, "batches": [b for e in own for b in e["batches"]]}
                self._publish([*[e for e in live if e["level"] != level], merged])
                done = True
            level += 1

    # ---- reading -----------------------------------------------------------

    def live(self) -> list[dict]:
        """``folder``, ``level`` and ``batches`` of the live folders."""
        return self._manifest()[1]["live"]

    def _rows(self, entries: list[dict], schema: StructType) -> DataFrame:
        if not entries:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{e['folder']}" for e in entries])

    def rows(self, schema: StructType) -> DataFrame:
        """Rows of all live folders."""
        return self._rows(self.live(), schema)
