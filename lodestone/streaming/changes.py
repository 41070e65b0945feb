"""Change events: debouncing, root health, and applying changed paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.ranking import in_order, with_previous, with_running_sum

#: Fixed value: quiet time after which collected paths are handed on, in microseconds.
QUIET = 900_000


def debounce_stream(events: DataFrame, watermark: str = "10 seconds", gap_us: int = QUIET) -> DataFrame:
    """``begin, end, paths``: the distinct paths of each burst of events ``ts, path``; a burst ends with ``gap_us`` of quiet.

    A session window merges events exactly its gap apart, a burst splits there; the gap is shorter by a microsecond.
    """
    session = F.session_window("ts", f"{gap_us - 1} microseconds")
    scope = F.coalesce(F.char_length("path") * 0, F.lit(0))  # bursts are global, session windows need a key
    bursts = events.withWatermark("ts", watermark).groupBy(session.alias("s"), scope.alias("scope")).agg(F.array_sort(F.collect_set("path")).alias("paths"))
    return bursts.select(F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "paths")


def debounce(events: DataFrame, gap_us: int = QUIET, key: str | None = None) -> DataFrame:
    """``[key,] burst, begin, last, events, paths``: the bursts of a table of events ``ts, path``.

    Without ``key`` the bursts are global. Gaps are found over range partitions by key and time, each partition knowing
    the last event of those before it, so neither the table nor a key is ever sorted in one task. Events without a time
    are left out.
    """
    kind = dict(events.dtypes)["ts"]
    by = [key] if key is not None else []
    ordered = in_order(events.where("ts is not null").select(*by, F.col("ts").cast("timestamp").alias("ts"), "path"), by, "ts")
    gap = F.unix_micros("ts") - F.unix_micros("__before")
    marked = with_previous(ordered, by, "ts", "ts", "__before").withColumn("__new", F.when(gap < gap_us, 0).otherwise(1))
    numbered = with_running_sum(marked, by, "ts", "__new", "burst")
    ends = [F.min("ts").cast(kind).alias("begin"), F.max("ts").cast(kind).alias("last")]
    return numbered.groupBy(*by, "burst").agg(*ends, F.count(F.lit(1)).alias("events"), F.count_distinct("path").alias("paths"))


def event_stream(spark: SparkSession, folder: str, most_files: int = 1_000) -> DataFrame:
    """``ts, path`` as they come: the source of changes is a folder that watchers write JSON lines into, one file a flush."""
    return spark.readStream.schema("ts timestamp, path string").option("maxFilesPerTrigger", most_files).json(folder)


def root_health(probes: DataFrame) -> DataFrame:
    """``root, ts, change``: where a root went ``offline`` or came back (``recovered``), from probes ``root, ts, online``.

    Probes are compared over range partitions, so a root may have any share of them; those without a time are left out.
    """
    before = with_previous(in_order(probes.where("ts is not null"), ["root"], "ts"), ["root"], "ts", "online", "__was")
    edges = before.where(F.col("__was").isNotNull() & (F.col("__was") != F.col("online")))
    return edges.select("root", "ts", F.when(F.col("online"), "recovered").otherwise("offline").alias("change"))


def apply_stream(bursts: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand the distinct changed paths of each micro-batch to ``apply``; what comes meanwhile waits for the next one.

    ``apply`` must be repeatable: changes are known by path, time and size, so doing one twice changes nothing. Started again
    with the same ``checkpoint``, after a full task or a failure, it goes on where it was.
    """

    def each(batch: DataFrame, _: int) -> None:
        paths = batch.select(F.explode("paths").alias("path")).distinct()
        if not paths.isEmpty():
            apply(paths)

    return bursts.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
