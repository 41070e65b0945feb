"""Processing only what is new or changed since the last successful run.

A log of commits with a monotonic sequence is the only truth. A run reads the last commit, fixes the upper limit of
what it will process, writes its output under a name nobody refers to yet, and then publishes it together with the new
watermark by one atomic rename. A run that dies before the rename leaves nothing that a reader can see; one that dies
after it has committed. Of two runs that race, the second rename fails. The rename is atomic on HDFS and local file
systems; a store whose rename is a copy needs a table format with its own commit in place of ``Manifest``.

The watermark moves over runs that are final only, without a gap: a run that is still open holds back every later one,
so none can end below the watermark unprocessed. The output is the state as well: a path's last committed pair is its
newest row in it, else the one in the base, so what a run writes is in proportion to what changed. A new base is
written every ``COMPACT`` commits.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.sources.manifest import Manifest

CHANGES = "run_id int, path string, modified_ms bigint, size bigint"
STATE = "path string, modified_ms bigint, size bigint"
#: Statuses that do not change any more.
FINAL = ("ok", "failed")
#: Commits after which the state is written as a whole again.
COMPACT = 20


@dataclass(frozen=True)
class Commit:
    """``base``: the state before the changes of commit ``since``; ``rows``: rows of scans up to the watermark when it was read."""

    sequence: int
    watermark: int
    changes: str
    base: str
    since: int
    rows: int


class CommitLog:
    """Commits below ``base``."""

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark, self.manifest = spark, Manifest(spark, base)
        self.base = self.manifest.base

    def sequences(self) -> list[int]:
        return self.manifest.sequences()

    def read(self, sequence: int) -> Commit:
        return Commit(**self.manifest.read(sequence))

    def last(self) -> Commit | None:
        entry = self.manifest.last()
        return None if entry is None else Commit(**entry)

    def publish(self, commit: Commit) -> None:
        self.manifest.publish(commit.sequence, commit.__dict__)

    def changes(self) -> DataFrame:
        """All committed output."""
        parts = [self.read(s).changes for s in self.sequences()]
        if not parts:
            return self.spark.createDataFrame([], CHANGES)
        return self.spark.read.schema(CHANGES).parquet(*[f"{self.base}/{p}" for p in parts])

    def state(self) -> DataFrame | None:
        """``path, modified_ms, size`` as last committed; ``None`` before the first commit."""
        commit = self.last()
        if commit is None:
            return None
        base = self.spark.read.schema(STATE).parquet(f"{self.base}/{commit.base}")
        parts = [self.read(s).changes for s in self.sequences() if commit.since <= s <= commit.sequence]
        rows = base.select(F.lit(None).cast("int").alias("run_id"), "path", "modified_ms", "size")
        if parts:
            rows = rows.unionByName(self.spark.read.schema(CHANGES).parquet(*[f"{self.base}/{p}" for p in parts]))
        newest = rows.groupBy("path").agg(F.max(F.struct("run_id", "modified_ms", "size")).alias("s"))
        return newest.select("path", "s.modified_ms", "s.size")

    def clean(self, older_than_s: int = 86_400) -> int:
        """Remove what runs that died have left, and bases that nothing reads any more; how many folders went."""
        entries = [self.read(s) for s in self.sequences()]
        used = {e.changes for e in entries} | {e.base for e in [*entries[:1], *entries[-2:]]}  # the first one is read again if rows come late
        return self.manifest.remove_unused("staged-", used, older_than_s)


def valid_sightings(scans: DataFrame, runs: DataFrame, after: int, upto: int) -> DataFrame:
    """``run_id, path, modified_ms, size``: what the successful runs in (``after``, ``upto``] saw, once a run and path.

    Rows with a null path, time or size, and rows seen after their run had finished, do not count. Of several rows of
    a path the one seen last counts; of several at the same time the largest pair.
    """
    good = runs.where((F.col("status") == "ok") & (F.col("run_id") > after) & (F.col("run_id") <= upto)).groupBy("run_id").agg(F.max("finished_at").alias("finished_at"))
    rows = scans.where((F.col("run_id") > after) & (F.col("run_id") <= upto) & F.col("path").isNotNull() & F.col("modified_ms").isNotNull() & F.col("size").isNotNull())
    seen = rows.select("run_id", "path", "modified_ms", "size", "seen_at").join(good, "run_id")
    in_time = seen.where(~F.coalesce(F.col("seen_at") > F.col("finished_at"), F.lit(False)))
    last = in_time.groupBy("run_id", "path").agg(F.max(F.struct("seen_at", "modified_ms", "size")).alias("s"))
    return last.select("run_id", "path", F.col("s.modified_ms").alias("modified_ms"), F.col("s.size").alias("size"))


def diff_runs(state: DataFrame, sightings: DataFrame) -> DataFrame:
    """All states and sightings of a path in order of runs, each with ``changed`` (against the one before).

    ``state`` has one row a path, ``run_id`` null. A null in it differs from every value. A path's rows are as many as
    there are runs in the batch, whatever the size of its root.
    """
    order = Window.partitionBy("path").orderBy(F.col("run_id").asc_nulls_first())
    rows = state.select(F.lit(None).cast("int").alias("run_id"), "path", "modified_ms", "size").unionByName(sightings.select(F.col("run_id").cast("int").alias("run_id"), "path", "modified_ms", "size"))
    same = (F.lag("modified_ms").over(order) == F.col("modified_ms")) & (F.lag("size").over(order) == F.col("size"))
    return rows.select("*", (F.col("run_id").isNotNull() & ~F.coalesce(same, F.lit(False))).alias("changed"))


def final_upto(runs: DataFrame, after: int) -> int | None:
    """The newest successful run after ``after`` before which every run is final; ``None`` if there is none."""
    later = runs.where(F.col("run_id") > after)
    over = F.coalesce(F.col("status").isin(*FINAL), F.lit(False))
    first_open = later.where(~over).agg(F.min("run_id")).first()[0]
    good = later.where(F.col("status") == "ok")
    return (good if first_open is None else good.where(F.col("run_id") < first_open)).agg(F.max("run_id")).first()[0]


def process(log: CommitLog, scans: DataFrame, runs: DataFrame, initial: DataFrame, before_first: int = 0) -> Commit | None:
    """Handle the successful runs since the last commit and commit; ``None`` if there is nothing to do.

    ``initial`` (``path, modified_ms, size``) is the state before the first commit; of several rows of a path in it the
    largest counts, null paths do not. Runs up to ``before_first`` are never handled. The upper limit is fixed when the
    call begins: the newest successful run before the first one that is not final. Runs that failed are passed over for
    good. Rows of a run that arrive after it was committed are found by the number of rows up to the watermark; then
    all runs are gone through again and what has not come out yet does, once.
    """
    last = log.last()
    after = last.watermark if last else before_first
    upto = final_upto(runs, after)
    known = scans.where((F.col("run_id") > before_first) & (F.col("run_id") <= (after if upto is None else upto))) if last or upto is not None else None
    if known is None:
        return None
    count = known.agg(F.count_if(F.col("run_id") <= after).alias("old"), F.count(F.lit(1)).alias("all")).first()
    late = last is not None and count["old"] > last.rows
    if upto is None and not late:
        return None
    upto = after if upto is None else int(upto)
    first = initial.where(F.col("path").isNotNull()).groupBy("path").agg(F.max(F.struct("modified_ms", "size")).alias("s")).select("path", "s.modified_ms", "s.size")
    name = uuid.uuid4().hex
    origin = log.read(1).base if last else f"staged-{name}-base"
    if last is None:
        first.write.parquet(f"{log.base}/{origin}")
    stored = log.spark.read.schema(STATE).parquet(f"{log.base}/{origin}")
    begin = before_first if late or last is None else after
    state = stored if late or last is None else log.state()
    rows = diff_runs(state, valid_sightings(scans, runs, begin, upto)).where("changed").select("run_id", "path", "modified_ms", "size")
    if late:
        rows = rows.join(log.changes().select("run_id", "path"), ["run_id", "path"], "left_anti")
    changes = f"staged-{name}"
    rows.write.parquet(f"{log.base}/{changes}")
    log.manifest.ensure(changes)
    sequence = last.sequence + 1 if last else 1
    base, since = (last.base, last.since) if last else (origin, 1)
    if last is not None and sequence - since >= COMPACT:
        base, since = f"staged-{name}-base", sequence
        log.state().write.parquet(f"{log.base}/{base}")
    commit = Commit(sequence, upto, changes, base, since, int(count["all"]))
    log.publish(commit)
    return commit
