"""Many requests at once against the whole index: a task holds some requests and reads the index block by block.

The index is written once to files of ``BLOCK`` rows in the folder all executors share, turned over to its terms. Since a
task sees every row for its requests, it gives their best rows and nothing else: pairs of requests and rows that are not
among them are never shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import cut, scratch_path

#: Rows of a file, and requests that a task holds at a time.
BLOCK, TOGETHER = 32_768, 512


def _path(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/*", "/", uri))


def _save(folder: str, name: str, table: pa.Table, **options) -> None:  # noqa: ANN003
    files, path = _path(folder)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}") as out:
        pq.write_table(table, out, compression="zstd", **options)


def _load(folder: str, name: str, columns: list[str] | None = None) -> pa.Table:
    files, path = _path(folder)
    with files.open_input_file(f"{path}/{name}") as f:
        return pq.read_table(f, columns=columns)


def _entries(column: pa.Array, weights: pa.Array | None, known: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every element; terms by their place in ``known``, others left out."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    row, flat = np.repeat(np.arange(len(column), dtype=np.int32), sizes), column.flatten()
    weight = np.ones(len(flat)) if weights is None else weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if known is None:
        return row, flat.to_numpy(zero_copy_only=False).astype(np.int32), weight
    at = pc.fill_null(pc.index_in(flat, known), -1).to_numpy(zero_copy_only=False)
    held = at >= 0
    return row[held], at[held].astype(np.int32), weight[held]


class Blocks:
    """The files of an index. ``rows``: ``id bigint, owner string, ext string, size double, terms, weights`` and, if
    ``shares`` is given, ``held``: terms that count for the share of a request's terms that the row holds.

    ``known`` and ``shares``: the terms that any request asks for; without ``known`` terms are numbers already.
    """

    def __init__(self, rows: DataFrame, known: list[str] | None = None, shares: list[str] | None = None) -> None:
        spark = self.spark = rows.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "blocks"))
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.folder, self.known = files.makeQualified(path).toString(), known
        files.mkdirs(path)
        files.deleteOnExit(path)  # results are read from it later
        self.sent = spark.sparkContext.broadcast((known, shares))
        schema = "file string, n bigint, size double, terms array<int>, counts array<bigint>"
        written = cut(rows.mapInArrow(self._writer(), schema))
        self.files = sorted(r.file for r in written.select("file").collect())
        self.rows, self.size = written.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0.0))).first()
        self._written = written

    def frequencies(self) -> np.ndarray:
        """How many rows have each known term."""
        pairs = self._written.select(F.explode(F.arrays_zip("terms", "counts")).alias("e")).groupBy("e.terms").agg(F.sum("e.counts").alias("n")).toArrow()
        out = np.zeros(len(self.known), np.int64)
        out[pairs.column(0).to_numpy()] = pairs.column("n").to_numpy()
        return out

    def _writer(self):  # noqa: ANN202
        folder, sent = self.folder, self.sent

        def flush(parts: list) -> pa.RecordBatch:
            name = uuid.uuid4().hex
            rows = pa.concat_tables([p[0] for p in parts])
            begins = np.cumsum([0, *[p[0].num_rows for p in parts]])
            found = None
            for kind in range(1, len(parts[0])):
                row = np.concatenate([p[kind][0] + b for p, b in zip(parts, begins[:-1], strict=True)]).astype(np.int32)
                term, weight = (np.concatenate([p[kind][i] for p in parts]) for i in (1, 2))
                order = np.argsort(term, kind="stable")
                terms, counts = np.unique(term, return_counts=True)
                found = found or (terms, counts)
                data = {"term": term[order], "row": row[order]} | ({"weight": weight[order]} if kind == 1 else {})
                _save(folder, f"{name}.{kind}", pa.table(data), use_dictionary=["term", "weight"][: len(data) - 1], column_encoding={"row": "DELTA_BINARY_PACKED"})
            _save(folder, f"{name}.rows", rows)
            total = pc.sum(rows.column("size")).as_py() or 0.0
            return pa.record_batch([pa.array([name]), pa.array([rows.num_rows]), pa.array([total]), pa.array([found[0].tolist()], pa.list_(pa.int32())), pa.array([found[1].tolist()], pa.list_(pa.int64()))], names=["file", "n", "size", "terms", "counts"])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, shares = (None if x is None else pa.array(x, pa.string()) for x in sent.value)
            parts, n = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                part = [pa.Table.from_batches([batch]).select(["id", "owner", "ext", "size"]), _entries(batch.column("terms"), batch.column("weights"), known)]
                if shares is not None:
                    part.append(_entries(batch.column("held"), None, shares))
                if n + batch.num_rows > BLOCK and parts:
                    yield flush(parts)
                    parts, n = [], 0
                parts.append(part)
                n += batch.num_rows
            if parts:
                yield flush(parts)

        return run

    def best(self, requests: DataFrame, digits: int, floor: float = 0.0, worth: np.ndarray | None = None, weigh: Callable | None = None) -> DataFrame:
        """``query_id, id, owner, score, top, place, share``: the ``budget`` best rows of each request, ties by id.

        ``requests``: ``query_id, ext, budget, terms`` with their ``weights`` or the ``worth`` of every known term (and
        ``asked`` for the share); only rows of the request's extension, if it has one. ``weigh``: what becomes of weights,
        given their rows' sizes. ``top`` is the request's best score.
        """
        kind = dict(requests.dtypes)["query_id"]
        schema = f"query_id {kind}, id bigint, owner string, score double, top double, place int, share double"
        tasks = max(-(-requests.count() // TOGETHER), requests.sparkSession.sparkContext.defaultParallelism)
        return requests.repartition(tasks).mapInArrow(self._reader(digits, floor, worth, weigh), schema)

    def _reader(self, digits: int, floor: float, worth: np.ndarray | None, weigh: Callable | None):  # noqa: ANN202
        folder, sent, files, worths = self.folder, self.sent, self.files, self.spark.sparkContext.broadcast(worth)

        def answer(asked: pa.Table, known: pa.Array | None, shares: pa.Array | None) -> Iterator[pa.RecordBatch]:
            def lists(column: str, weights: str | None, values: pa.Array | None) -> list[tuple[np.ndarray, np.ndarray]]:
                row, term, weight = _entries(asked.column(column).combine_chunks(), None if weights is None else asked.column(weights).combine_chunks(), values)
                cuts = np.searchsorted(row, np.arange(asked.num_rows + 1))
                return [(term[a:b], weight[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

            asks = lists("terms", "weights" if worths.value is None else None, known)
            if worths.value is not None:
                asks = [(terms, worths.value[terms]) for terms, _ in asks]
            wanted = None if shares is None else lists("asked", None, shares)
            sizes = None if shares is None else pc.list_value_length(asked.column("asked")).to_numpy()
            exts, budgets = asked.column("ext").to_pylist(), asked.column("budget").to_numpy()
            low = np.full(asked.num_rows, floor - 10.0**-digits if floor else 0.0)
            hits: list = [None] * asked.num_rows
            for f, name in enumerate(files):
                rows = _load(folder, f"{name}.rows", ["id", "ext", "size"])
                ids, size = rows.column("id").to_numpy(), rows.column("size").to_numpy()
                codes = rows.column("ext").combine_chunks().dictionary_encode()
                ext_of, places = pc.fill_null(codes.indices, -1).to_numpy(zero_copy_only=False), {e: i for i, e in enumerate(codes.dictionary.to_pylist())}
                data = _load(folder, f"{name}.1")
                row, weight = data.column("row").to_numpy(), data.column("weight").to_numpy()
                if weigh is not None:
                    weight = weigh(weight, size[row])
                ends = _ends(data.column("term").to_numpy())
                if wanted is not None:
                    cover = _load(folder, f"{name}.2")
                    cover_row, cover_ends = cover.column("row").to_numpy(), _ends(cover.column("term").to_numpy())
                sums, counts = np.zeros(len(ids)), np.zeros(len(ids), np.int32)
                for q, (terms, weights) in enumerate(asks):
                    if exts[q] is not None and exts[q] not in places:
                        continue
                    met = False
                    for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                        a, b = ends.get(t, (0, 0))
                        if a < b:
                            if not met:
                                sums[:] = 0.0
                                met = True
                            sums[row[a:b]] += w * weight[a:b]
                    if not met:
                        continue
                    at = np.flatnonzero(sums > low[q])
                    if exts[q] is not None:
                        at = at[ext_of[at] == places[exts[q]]]
                    score = np.round(sums[at], digits)
                    if floor:
                        at, score = at[score >= floor], score[score >= floor]
                    if not len(at):
                        continue
                    held = np.zeros(len(at), np.int32)
                    if wanted is not None:
                        counts[:] = 0
                        for t in wanted[q][0].tolist():
                            a, b = cover_ends.get(t, (0, 0))
                            counts[cover_row[a:b]] += 1
                        held = counts[at]
                    new = (score, ids[at], np.full(len(at), f, np.int32), at.astype(np.int32), held)
                    if hits[q] is not None:
                        new = tuple(np.concatenate(x) for x in zip(hits[q], new, strict=True))
                    if len(new[0]) > budgets[q]:
                        keep = _best(new[0], new[1], int(budgets[q]))
                        new = tuple(x[keep] for x in new)
                        low[q] = max(low[q], new[0].min() - 10.0**-digits)
                    hits[q] = new
            got = [q for q in range(asked.num_rows) if hits[q] is not None]
            if not got:
                return
            orders = [np.lexsort((hits[q][1], -hits[q][0])) for q in got]
            score, ids, file, at, held = (np.concatenate([hits[q][i][o] for q, o in zip(got, orders, strict=True)]) for i in range(5))
            n = np.array([len(o) for o in orders])
            query, begins = np.repeat(got, n), np.cumsum([0, *n[:-1]])
            place = np.arange(len(score)) - np.repeat(begins, n) + 1
            share = np.zeros(len(score)) if sizes is None else held / np.maximum(sizes[query], 1)
            by_file = np.argsort(file, kind="stable")
            cuts = np.searchsorted(file[by_file], np.arange(len(files) + 1))
            top = np.repeat(score[begins], n)
            names = asked.column("query_id").combine_chunks()
            for f, name in enumerate(files):
                own = by_file[cuts[f] : cuts[f + 1]]
                if len(own):
                    owner = _load(folder, f"{name}.rows", ["owner"]).column("owner").combine_chunks().take(pa.array(at[own]))
                    yield pa.record_batch([names.take(pa.array(query[own])), pa.array(ids[own]), owner, pa.array(score[own]), pa.array(top[own]), pa.array(place[own], pa.int32()), pa.array(share[own])], names=["query_id", "id", "owner", "score", "top", "place", "share"])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, shares = (None if x is None else pa.array(x, pa.string()) for x in sent.value)
            kept: list = []
            for batch in batches:
                for a in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(a, TOGETHER)
                    if sum(x.num_rows for x in kept) + part.num_rows > TOGETHER:
                        yield from answer(pa.Table.from_batches(kept), known, shares)
                        kept = []
                    kept.append(part)
            if kept:
                yield from answer(pa.Table.from_batches(kept), known, shares)

        return run


def _ends(terms: np.ndarray) -> dict[int, tuple[int, int]]:
    """Where each of the sorted terms begins and ends."""
    values, begins = np.unique(terms, return_index=True)
    return dict(zip(values.tolist(), zip(begins.tolist(), [*begins[1:].tolist(), len(terms)], strict=True), strict=True))


def _best(score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """The places of the ``most`` highest scores; among equal ones the lowest ids."""
    least = np.partition(score, len(score) - most)[len(score) - most]
    sure, ties = np.flatnonzero(score > least), np.flatnonzero(score == least)
    return np.concatenate([sure, ties[np.argsort(ids[ties], kind="stable")[: most - len(sure)]]])
