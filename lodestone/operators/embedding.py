"""Dense vectors of texts by a model that is given, with a tokeniser, batches under a budget and a fallback."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vectors import BUCKETS
from lodestone.sources.files import LongestMatch, plan_batches

#: Fixed value: the token that ends a text; texts of a batch are filled up with 0 on the left.
END = 65_535
_WORD = re.compile("[a-z0-9_]{2,}")
_IDEOGRAPH = re.compile("[㐀-鿿豈-﫿]+")


def token_ids(df: DataFrame, text: str, vocabulary: dict[bytes, int], out: str = "tokens") -> DataFrame:
    """Add ``out``: the ids of greedy longest match over the text's bytes. Null stays null, the empty text has no token."""
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    made: list[LongestMatch] = []  # one for each task

    @F.pandas_udf("array<int>")
    def encoded(texts):  # noqa: ANN001, ANN202
        if not made:
            made.append(LongestMatch(sent.value))
        return texts.map(lambda t: None if t is None else made[0].encode(t))

    return df.withColumn(out, encoded(F.col(text)))


def token_batches(df: DataFrame, key: str, length: str, rows: int = 4, budget: int = 8192) -> DataFrame:
    """``key, length, partition, batch``: which texts are computed together.

    A batch has at most ``rows`` texts, and as many times its longest within ``budget`` tokens; a text that breaks the
    budget alone is alone. Batches are planned among the rows of an Arrow batch. Null lengths count as 0.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 0
        for batch in batches:
            lengths = [x or 0 for x in batch.column("length").to_pylist()]
            plan = plan_batches(lengths, rows, budget)
            order = [i for b in plan for i in b]
            number = [first + j for j, b in enumerate(plan) for _ in b]
            first += len(plan)
            at = pa.array(order, pa.int64())
            yield pa.record_batch([batch.column("key").take(at), pa.array([lengths[i] for i in order], pa.int64()), batch.column("partition").take(at), pa.array(number, pa.int64())], names=["key", "length", "partition", "batch"])

    asked = df.select(F.col(key).alias("key"), F.col(length).cast("bigint").alias("length"), F.spark_partition_id().alias("partition"))
    return asked.mapInArrow(run, f"key {kind}, length bigint, partition int, batch bigint").withColumnRenamed("key", key)


def padded_tokens(batches: DataFrame) -> DataFrame:
    """One row: tokens that the batches hold, and tokens they take when filled up to their longest."""
    each = batches.groupBy("partition", "batch").agg(F.sum("length").alias("held"), (F.count(F.lit(1)) * F.max("length")).alias("taken"))
    return each.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held"), F.coalesce(F.sum("taken"), F.lit(0)).alias("taken"))


def recurrence(receptance: np.ndarray, decay: np.ndarray, key: np.ndarray, value: np.ndarray, removal: np.ndarray, replacement: np.ndarray, heads: int) -> np.ndarray:
    """The output of a generalised delta-rule recurrence for arrays of ``(texts, tokens, channels)``.

    Each head holds a matrix that decays by ``exp(-exp(decay))``, is corrected along ``removal`` towards ``replacement``, takes up
    ``value`` at ``key`` and is read at ``receptance``.
    """
    texts, tokens, channels = receptance.shape
    size = channels // heads
    r, w, k, v, a, b = (x.reshape(texts, tokens, heads, size).astype(np.float32) for x in (receptance, np.exp(-np.exp(decay)), key, value, removal, replacement))
    state = np.zeros((texts, heads, size, size), np.float32)
    out = np.empty((texts, tokens, heads, size), np.float32)
    for t in range(tokens):
        read = np.matmul(state, a[:, t, :, :, None])
        state = state * w[:, t, :, None, :] + read * b[:, t, :, None, :] + v[:, t, :, :, None] * k[:, t, :, None, :]
        out[:, t] = np.matmul(state, r[:, t, :, :, None])[..., 0]
    return out.reshape(texts, tokens, channels)


def hashed_vector(text: str) -> np.ndarray:
    """The dense form of the hashed bag-of-terms vector."""
    low = text.lower()
    found = set(_WORD.findall(low))
    for run in _IDEOGRAPH.findall(low):
        found |= set(run) | {run[i : i + 2] for i in range(len(run) - 1)}
    out = np.zeros(BUCKETS, np.float32)
    for term in found:
        bucket = int(hashlib.md5(term.encode()).hexdigest()[:8], 16) % BUCKETS
        out[bucket] += 1.0 if bucket % 2 == 0 else -1.0
    norm = np.linalg.norm(out)
    return out / norm if norm > 0 else out


class Embedder:
    """A model behind a state: not loaded until the first text, then ready, or for good on hashed vectors.

    ``load`` gives ``encode`` (text to token ids) and ``model`` (an array of ids, texts by tokens, to an array of vectors). A model
    that cannot be loaded, fails or gives vectors of another width leaves the fallback in its place.
    """

    def __init__(self, load: Callable[[], tuple[Callable[[str], list[int]], Callable[[np.ndarray], np.ndarray]]] | None, dimensions: int = BUCKETS) -> None:
        self.load, self.dimensions, self.loaded = load, dimensions, None
        self.state = "uninitialised" if load is not None else "fallback"

    def embed(self, texts: list[str]) -> np.ndarray:
        """One vector of length 1 for each text."""
        if self.state == "uninitialised" and texts:
            try:
                self.loaded, self.state = self.load(), "ready"
            except Exception:  # noqa: BLE001
                self.state = "fallback"
        if self.state == "ready":
            try:
                return self._by_model(texts)
            except Exception:  # noqa: BLE001
                self.state, self.loaded = "fallback", None
        return np.stack([hashed_vector(t) for t in texts]) if texts else np.zeros((0, self.dimensions), np.float32)

    def _by_model(self, texts: list[str]) -> np.ndarray:
        encode, model = self.loaded
        ids = [[*encode(t), END] for t in texts]
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for batch in plan_batches([len(x) for x in ids]):
            longest = max(len(ids[i]) for i in batch)
            given = np.array([[0] * (longest - len(ids[i])) + ids[i] for i in batch], np.int64)
            found = np.asarray(model(given), np.float32)
            if found.shape != (len(batch), self.dimensions):
                raise ValueError(f"the model gave {found.shape}")
            norm = np.linalg.norm(found, axis=1, keepdims=True)
            out[batch] = np.divide(found, norm, out=found.copy(), where=norm > 0)
        return out


def embed_texts(df: DataFrame, keys: list[str], text: str, make: Callable[[], Embedder]) -> DataFrame:
    """``keys, vector, backend``: every text's vector and what made it (``ready`` or ``fallback``); one embedder a task.

    Null texts give no row.
    """
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("__text"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = make()
        for batch in batches:
            vectors = embedder.embed(batch.column("__text").to_pylist())
            lists = pa.FixedSizeListArray.from_arrays(pa.array(vectors.reshape(-1)), vectors.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.record_batch([*[batch.column(k) for k in keys], lists, pa.array([embedder.state] * batch.num_rows)], names=[*keys, "vector", "backend"])

    return rows.mapInArrow(run, ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "vector array<float>", "backend string"]))


def to_bytes(df: DataFrame, vector: str, out: str = "bytes") -> DataFrame:
    """Add ``out``: the vector as little-endian 32-bit floats. Null stays null."""

    @F.pandas_udf("binary")
    def packed(vectors):  # noqa: ANN001, ANN202
        return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return df.withColumn(out, packed(F.col(vector).cast("array<float>")))


def from_bytes(df: DataFrame, raw: str, out: str = "vector") -> DataFrame:
    """Add ``out``: the vector that ``raw`` holds; null if it is null or no whole number of floats."""

    @F.pandas_udf("array<float>")
    def unpacked(values):  # noqa: ANN001, ANN202
        return values.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))

    return df.withColumn(out, unpacked(F.col(raw)))
