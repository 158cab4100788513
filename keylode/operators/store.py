"""A store of runs in a folder: generations published by a manifest that names them.

Each change writes new folders and then a new manifest file; readers take the newest manifest, so they
see a whole generation or the one before it.  A writer whose generation was taken meanwhile puts its run
on top of the newer one.  Inputs of a compaction stay until ``vacuum``.
"""

from __future__ import annotations

import json
import time
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keylode.operators import runs
from keylode.operators.state import lww
from keylode.schema import RUN, RUN_TRIGGER


#: A writer's mark that is so old is that of one that has died.
ABANDONED_S = 7 * 24 * 3600


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[str]:
        folder = self._path(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(x.getPath().getName() for x in self._fs.listStatus(folder) if not x.getPath().getName().startswith("."))

    def _current(self) -> tuple[int, list[dict]]:
        """The number of the next generation, and the runs of this one: both from one listing."""
        names = self._manifests()
        if not names:
            return 0, []
        text = "\n".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{names[-1]}").collect())
        return int(names[-1]) + 1, json.loads(text)

    def runs(self) -> list[dict]:
        """The current generation: run_id, level and folder of each run, oldest first."""
        return self._current()[1]

    def _publish(self, number: int, entries: list[dict]) -> bool:
        """Make entries generation ``number``; False if another writer has published it meanwhile."""
        held = self._path(f"{self.path}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(held)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()
        # A rename onto a name that exists fails, so of two writers of one generation one loses.
        target = self._path(f"{self.path}/manifest/{number:012d}")
        if not self._fs.exists(target) and self._fs.rename(held, target):
            return True
        self._fs.delete(held, False)
        return False

    def flush(self, log: DataFrame) -> int:
        """Write the log's state as a new run of level 0; its number is above all others'.

        The run's number is taken when it is published: the folder holds the state alone, and a writer
        that loses a generation reads the newest one and tries again.
        """
        with self._pending() as folder:
            runs.write_run(lww(log).select("key", "value", "tombstone", "seq"), folder)
            while True:
                number, entries = self._current()
                run_id = max((x["run_id"] for x in entries), default=-1) + 1
                if self._publish(number, [*entries, {"run_id": run_id, "level": 0, "folder": folder}]):
                    return run_id

    def read(self, entries: list[dict] | None = None) -> DataFrame:
        entries = self.runs() if entries is None else entries
        if not entries:
            return self.spark.createDataFrame([], RUN)
        parts = [self.spark.read.parquet(x["folder"]).select(F.lit(x["run_id"]).cast("long").alias("run_id"), F.lit(x["level"]).cast("int").alias("level"), "key", "value", "tombstone", "seq") for x in entries]
        return reduce(DataFrame.unionByName, parts)

    def state(self, log: DataFrame | None = None) -> DataFrame:
        """The state over all runs, and over the operations of a log that no run holds yet."""
        merged = runs.merge(self.read()).select("key", "value", "tombstone", "seq")
        return merged if log is None else lww(merged.unionByName(log.select("key", "value", "tombstone", "seq")))

    def get(self, key) -> DataFrame:
        """Point lookup over all runs; the key's predicate reaches the Parquet scans."""
        return runs.merge(self.read().filter(F.col("key") == F.lit(key))).select("key", "value", "tombstone")

    def compact(self, *, force: bool = False, trigger: int = RUN_TRIGGER) -> bool:
        """Merge all runs into one of level 1, without deleted keys, when there are enough of level 0."""
        entries = self.runs()
        if not entries or not (force or runs.needs_compaction(sum(x["level"] == 0 for x in entries), trigger)):
            return False
        run_id, merged = max(x["run_id"] for x in entries), {x["folder"] for x in entries}
        with self._pending() as folder:
            runs.write_run(runs.compact(self.read(entries)).select("key", "value", "tombstone", "seq"), folder)
            while True:  # runs that were flushed meanwhile stay above the merged one
                number, now = self._current()
                if not merged <= {x["folder"] for x in now}:
                    return False  # another writer has compacted them
                if self._publish(number, [{"run_id": run_id, "level": 1, "folder": folder}, *[x for x in now if x["folder"] not in merged]]):
                    return True

    @contextmanager
    def _pending(self):
        """A new run's folder, marked until it is published, so that no vacuum takes it."""
        name = uuid.uuid4().hex
        mark = self._path(f"{self.path}/pending/{name}")
        self._fs.create(mark).close()
        try:
            yield f"{self.path}/runs/{name}"
        finally:
            self._fs.delete(mark, False)

    def _listed(self, name: str) -> list:
        folder = self._path(f"{self.path}/{name}")
        return list(self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def vacuum(self, *, age_s: float = ABANDONED_S) -> int:
        """Delete folders that the current generation does not name and no writer has pending; marks older than age_s count no more.

        Folders are listed before marks, and marks before the generation: a folder whose mark has gone by then has been published.
        """
        folders = [x.getPath() for x in self._listed("runs")]
        pending = {x.getPath().getName() for x in self._listed("pending") if x.getModificationTime() / 1000 > time.time() - age_s}
        named = {x["folder"].rsplit("/", 1)[-1] for x in self.runs()}
        gone = [p for p in folders if p.getName() not in named | pending]
        for p in gone:
            self._fs.delete(p, True)
        return len(gone)
