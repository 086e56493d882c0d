"""Keyed content-hash state for runs that process only new or changed records.

A state lives in a folder. ``parts/<name>`` holds the rows one run put into the
state: the keys it found new or refetched, each with a mark whether its content
changed. ``commits/<n>`` is a small document that names the run and the parts
that make up the state after it. A run writes its part under a name of its own
and then puts down ``commits/<n>``, by a rename that fails if that commit is
there already. Whatever dies before the rename leaves the old state and the old
output in force and a part that nobody names; of two writers of one version one
fails. So no record is skipped and none is given twice. This asks for a file
system whose rename is atomic (HDFS, local disks); object stores need a committer
that offers it.

The work of a run goes with the keys it brings: of the state only those keys are
shuffled, and only they are written. Every ``COMPACT`` runs the parts are merged
into one.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.session import cut, scratch_path

STATE = "key string, version bigint, arrived timestamp_ntz, hash string, changed boolean"
COMPACT = 16  # runs between two mergers of the parts of a state


def content_hash(columns: list[str]) -> Column:
    """SHA-256 over the columns' texts; null counts as empty, and lengths keep the fields apart."""
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.length(t), F.lit(":"), t) for t in texts]), 256)


class Swap:
    """Small documents that are put down in one step, on any file system the engine knows."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path = jvm.org.apache.hadoop.fs.Path
        root = self.path(folder)
        self.files = root.getFileSystem(conf)
        # FileContext renames in one step, over an existing file or not; FileSystem does neither.
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), conf)
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        self._ways = {}
        for way in (rename.OVERWRITE, rename.NONE):
            self._ways[way.name()] = spark.sparkContext._gateway.new_array(rename, 1)
            self._ways[way.name()][0] = way

    def put(self, text: str, target: str, over: bool = True) -> None:
        """Write aside and rename; without ``over`` an existing target is an error and stays as it is."""
        fresh = self.path(f"{target}.{uuid.uuid4().hex}.next")
        stream = self.files.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            self._context.rename(fresh, self.path(target), self._ways["OVERWRITE" if over else "NONE"])
        except Exception:
            self.files.delete(fresh, False)
            raise

    def read(self, target: str) -> str:
        stream = self.files.open(self.path(target))
        try:
            size = self.files.getFileStatus(self.path(target)).getLen()
            return bytes(stream.readNBytes(int(size))).decode()
        finally:
            stream.close()


class RunState:
    """The versioned state of one incremental consumer."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._swap = Swap(spark, self.path)

    def committed(self) -> dict:
        """``version``, ``run``, the ``runs`` committed so far with their parts, and the ``parts`` of the state; version 0 before any."""
        folder = self._swap.path(f"{self.path}/commits")
        if not self._swap.files.exists(folder):
            return {"version": 0, "run": None, "runs": [], "outputs": [], "parts": []}
        names = [f.getPath().getName() for f in self._swap.files.listStatus(folder)]
        last = max(n for n in names if n.isdecimal())
        return json.loads(self._swap.read(f"{self.path}/commits/{last}"))

    def _parts(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(*[f"{self.path}/parts/{n}" for n in names])

    def read(self) -> DataFrame:
        """The state: ``key, version, arrived, hash``, one row per key."""
        return self._newest(self._parts(self.committed()["parts"])).select("key", "was.*")

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.max(F.struct("version", "arrived", "hash")).alias("was"))

    def run(self, run_id: int, newest: DataFrame, fail_before_swap: bool = False) -> None:
        """Take in ``newest(key, version, arrived, hash)``, one row per key, and commit as ``run_id``.

        A run that is already committed changes nothing. A commit that another
        writer has made meanwhile is an error. ``fail_before_swap`` is for tests:
        it dies at the worst moment.
        """
        state = self.committed()
        if run_id in state["runs"]:
            return
        parts = state["parts"]
        if len(parts) > COMPACT:
            merged = f"merged-{uuid.uuid4().hex}"
            rows = self._newest(self._parts(parts)).select("key", "was.*", F.lit(False).alias("changed"))
            rows.write.parquet(f"{self.path}/parts/{merged}")
            parts = [merged]
        # Of the state only the keys at hand are read on; old and new rows of a key meet in one aggregate.
        content = F.struct("version", "arrived", "hash")
        new = newest.select("key", F.lit(None).cast("struct<version:bigint,arrived:timestamp_ntz,hash:string>").alias("was"), content.alias("got"))
        old = self._parts(parts).join(newest.select("key"), "key", "left_semi").select("key", content.alias("was"), F.lit(None).alias("got"))
        both = (new.union(old) if parts else new).groupBy("key").agg(F.max("was").alias("was"), F.max("got").alias("got"))
        taken = both.filter(F.col("was").isNull() | (F.col("got") > F.col("was")))
        changed = F.col("was").isNull() | (F.col("got.hash") != F.col("was.hash"))
        name = f"run-{uuid.uuid4().hex}"
        taken.select("key", "got.*", changed.alias("changed")).write.parquet(f"{self.path}/parts/{name}")
        if fail_before_swap:
            raise RuntimeError("died before the swap")
        version = state["version"] + 1
        following = {"version": version, "run": run_id, "runs": [*state["runs"], run_id], "outputs": [*state["outputs"], name], "parts": [*parts, name]}
        self._swap.put(json.dumps(following), f"{self.path}/commits/{version:09d}", over=False)

    def changes(self) -> DataFrame:
        """``run_id, key`` of all committed runs."""
        state = self.committed()
        if not state["runs"]:
            return self.spark.createDataFrame([], "run_id bigint, key string")
        rows = self._parts(state["outputs"]).filter("changed")
        part = F.regexp_extract(F.input_file_name(), r"/parts/([^/]+)/[^/]*$", 1)
        runs = F.create_map(*[F.lit(x) for pair in zip(state["outputs"], state["runs"]) for x in pair])
        return rows.select(F.element_at(runs, part).cast("bigint").alias("run_id"), "key")


def epoch_seconds(value: Column) -> Column:
    """Epoch seconds from seconds or milliseconds; null and 0 become 0."""
    return F.coalesce(F.when(F.abs(value) >= F.lit(100_000_000_000), F.floor(value / 1000)).otherwise(value), F.lit(0)).cast("bigint")


def successful_runs(runs: DataFrame) -> list:
    """``(run_id, started_at)`` of runs with a row of status ``success``, by start. The log is small by nature: one row or a few per run."""
    rows = runs.groupBy("run_id").agg(F.min("started_at").alias("started_at"), F.max(F.coalesce(F.lower(F.trim("status")) == "success", F.lit(False))).alias("ok"))
    return [(r.run_id, r.started_at) for r in rows.filter("ok AND started_at IS NOT NULL AND run_id IS NOT NULL").orderBy("started_at", "run_id").collect()]


def replay_runs(deliveries: DataFrame, runs: DataFrame, key: Column, version: Column, arrived: str, content: list[str], empty: list[str], path: str | None = None) -> DataFrame:
    """Replay a run log over ``deliveries``; give ``run_id, key`` for each record new or changed in a successful run.

    ``deliveries`` is read once: each row is hashed, put to the first successful
    run that sees it, reduced to the newest per key and run, and laid out by run,
    so that a run reads only what arrived since the last success. Runs that failed
    commit nothing and the next success takes in what they would have seen.

    Cases: a row whose ``empty`` columns are all null or empty is a failed fetch
    and is ignored; null key, null arrival and rows after the last run are never
    seen; ties in version and arrival go to the greater hash; repeated rows change
    nothing; empty tables give no rows.
    """
    spark = deliveries.sparkSession
    done = successful_runs(runs)
    if not done:
        return spark.createDataFrame([], "run_id bigint, key string")
    starts = F.array(*[F.lit(s).cast("timestamp_ntz") for _, s in done])
    seen = F.col(arrived).cast("timestamp_ntz")
    failed = reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string"), F.lit("")) == "" for c in empty])
    rows = deliveries.filter(~failed).select(key.alias("key"), version.alias("version"), seen.alias("arrived"), content_hash(content).alias("hash"), F.size(F.filter(starts, lambda s: s < seen)).alias("run"))
    rows = rows.filter(F.col("key").isNotNull() & F.col("arrived").isNotNull() & (F.col("run") < len(done)))
    newest = rows.groupBy("run", "key").agg(F.max(F.struct("version", "arrived", "hash")).alias("n")).select("run", "key", "n.*")
    landing = cut(newest.repartitionByRange("run", "key").sortWithinPartitions("run", "key"), "landing")
    state = RunState(spark, path or scratch_path(spark, "state"))
    for n, (run_id, _) in enumerate(done):
        state.run(run_id, landing.filter(F.col("run") == n).drop("run"))
    return state.changes()
