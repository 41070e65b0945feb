"""Exact vector search: stated queries against all rows."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors that are sent to every task at a time; more are handled in several passes.
PASS = 20_000


def _dense(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each non-zero length of vectors in it, the rows with that length and their vectors; null numbers count as 0."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for width in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == width)
        flat = pc.fill_null(column.take(pa.array(at)).flatten().cast(pa.float64()), 0.0)
        yield at, flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def top_k(queries: DataFrame, rows: DataFrame, k: int, floor: float | None = None, strict: bool = False) -> DataFrame:
    """``query_id, id, sim, place``: the ``k`` rows with the largest products for each query; 6 decimals, ties by id.

    ``queries``: ``query_id, vector``; ``rows``: ``id, vector``. Negative products count as 0; vectors of another length
    than the query's are passed over, whatever else their batch holds. Each batch multiplies one matrix for every length
    that is asked for and keeps its own best ``k`` of every query, so at most ``k`` rows a batch and query are shuffled.
    """
    stated = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
    passes = max(1, -(-stated.count() // PASS))
    data = rows.select("id", F.col("vector").cast("array<double>").alias("vector"))
    out = None
    for i in range(passes):
        part = (stated if passes == 1 else stated.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i)).toArrow()
        ids = part.column("query_id").to_numpy()
        sent = rows.sparkSession.sparkContext.broadcast({m.shape[1]: (ids[at], m) for at, m in _dense(part.column("vector").combine_chunks())})

        def nearest(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                every = batch.column("id").to_numpy()
                for own, vectors in _dense(batch.column("vector")):
                    if vectors.shape[1] not in sent.value:
                        continue
                    names, asked = sent.value[vectors.shape[1]]
                    order = np.argsort(every[own], kind="stable")
                    ids, vectors = every[own][order], vectors[order]
                    for a in range(0, len(names), 512):
                        sims = np.round(np.maximum(asked[a : a + 512] @ vectors.T, 0.0), 6)
                        top = np.argsort(-sims, axis=1, kind="stable")[:, :k]
                        best = np.take_along_axis(sims, top, 1)
                        yield pa.record_batch([pa.array(np.repeat(names[a : a + 512], top.shape[1])), pa.array(ids[top].reshape(-1)), pa.array(best.reshape(-1))], names=["query_id", "id", "sim"])

        found = data.mapInArrow(nearest, "query_id bigint, id bigint, sim double")
        out = found if out is None else out.unionByName(found)
    if floor is not None:
        out = out.where(F.col("sim") > floor if strict else F.col("sim") >= floor)
    order = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "id")
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat values of a list column and the row each belongs to."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), sizes)


def _scatter(batch: pa.RecordBatch | pa.Table, dimensions: int) -> np.ndarray:
    buckets, at = _rows_of(batch.column("buckets"))
    out = np.zeros((batch.num_rows, dimensions))
    out[at, buckets] = batch.column("weights").flatten().to_numpy(zero_copy_only=False)
    return out


def sparse_top_k(queries: DataFrame, rows: DataFrame, owner: str, dimensions: int, floor: float, strict: bool = False) -> DataFrame:
    """``query_id, budget, id, <owner>, sim``: at least the ``budget`` rows with the largest products for each query.

    ``queries``: ``query_id, ext, budget, buckets, weights``; ``rows``: ``id, <owner>, extension, buckets, weights``. Only
    rows of the query's extension (if it has one) and with a product of at least ``floor`` (``strict``: above it); 6
    decimals. One matrix product a batch, of which each query's own best ``budget`` rows go on; queries go to every task
    in passes of ``PASS``.
    """
    first = queries.limit(PASS + 1).toArrow()
    passes = 1 if first.num_rows <= PASS else -(-queries.count() // PASS)
    data = rows.select("id", owner, "extension", "buckets", "weights")
    kind = dict(rows.dtypes)
    schema = f"query_id {dict(queries.dtypes)['query_id']}, budget int, id {kind['id']}, owner string, sim double"
    out = None
    for i in range(passes):
        part = (first if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i).toArrow()).combine_chunks()
        asked = _scatter(part.to_batches()[0], dimensions) if part.num_rows else np.zeros((0, dimensions))
        sent = rows.sparkSession.sparkContext.broadcast((part.column("query_id").to_numpy(), part.column("ext").to_pylist(), part.column("budget").to_numpy(), asked))

        def nearest(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            names, exts, budgets, asked = sent.value
            wanted = {e: np.array([x is None or x == e for x in exts]) for e in set(exts) if e is not None}
            anywhere = np.array([x is None for x in exts], bool)
            for whole in batches:
                for begin in range(0, whole.num_rows, 4096):
                    batch = whole.slice(begin, 4096)
                    sims = np.round(np.maximum(asked @ _scatter(batch, dimensions).T, 0.0), 6)
                    good = sims > floor if strict else sims >= floor
                    if not anywhere.all():
                        good &= np.stack([wanted.get(e, anywhere) for e in batch.column("extension").to_pylist()], axis=1)
                    ids = batch.column("id")
                    for q in np.flatnonzero(good.sum(1) > budgets):
                        at = np.flatnonzero(good[q])
                        rest = pc.sort_indices(pa.table({"s": -sims[q, at], "i": ids.take(pa.array(at))}), [("s", "ascending"), ("i", "ascending")]).to_numpy()[budgets[q] :]
                        good[q, at[rest]] = False
                    q, r = np.nonzero(good)
                    if len(q):
                        yield pa.record_batch([pa.array(names[q]), pa.array(budgets[q], pa.int32()), ids.take(pa.array(r)), batch.column(owner).take(pa.array(r)), pa.array(sims[q, r])], names=["query_id", "budget", "id", "owner", "sim"])

        found = data.mapInArrow(nearest, schema)
        out = found if out is None else out.unionByName(found)
    return out.withColumnRenamed("owner", owner)
