"""Queries of the incremental run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.runtime import scratch_path, table
from lodestone.streaming.incremental import CommitLog, process


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = CommitLog(spark, scratch_path(spark, "incremental"))
    while process(log, table(spark, sf_dir, "scanned_files"), table(spark, sf_dir, "index_runs"), table(spark, sf_dir, "documents").select("path", "modified_ms", "size")):
        pass
    return log.changes().select("run_id", "path")


P7_SQL = """
WITH ok AS (SELECT run_id, max(finished_at) AS finished_at FROM index_runs WHERE status = 'ok' AND run_id >= 1 GROUP BY run_id),
seen AS (
  SELECT s.run_id, s.path, s.modified_ms, s.size,
         row_number() OVER (PARTITION BY s.run_id, s.path ORDER BY s.seen_at DESC NULLS LAST, s.modified_ms DESC, s.size DESC) AS rn
  FROM scanned_files s JOIN ok USING (run_id)
  WHERE s.path IS NOT NULL AND s.modified_ms IS NOT NULL AND s.size IS NOT NULL AND NOT coalesce(s.seen_at > ok.finished_at, false)),
states AS (
  SELECT run_id, path, modified_ms, size FROM seen WHERE rn = 1
  UNION ALL SELECT 0, path, modified_ms, size FROM documents),
steps AS (
  SELECT run_id, path, modified_ms, size,
         lag(modified_ms) OVER w AS before_ms, lag(size) OVER w AS before_size
  FROM states WINDOW w AS (PARTITION BY path ORDER BY run_id))
SELECT CAST(run_id AS INTEGER) AS run_id, path FROM steps
WHERE run_id >= 1 AND NOT coalesce(modified_ms = before_ms AND size = before_size, false)
"""


def queries() -> dict:
    return {"p7_found": p7_found}


def oracle_sql() -> dict[str, str]:
    return {"p7_found": P7_SQL}
