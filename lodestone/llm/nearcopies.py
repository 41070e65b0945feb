"""Near-duplicate records: several global token orders, their prefix filters intersected before verification.

The tokens of a text are its distinct sequences of ``n`` characters. A global order puts all tokens of the corpus in
one sequence; under a random order the first token of two texts (a prefix of one) agrees with the probability of their
Jaccard similarity J. ``ORDERS`` orders are intersected to one filter: a pair passes it if its prefixes agree under each
of them. A pair is a candidate if it passes one of ``FILTERS`` filters, so at J = 0.7 one in 60 000 is missed, and fewer
above: with prefixes of one token this is min-hash banding, chosen because the exact prefixes of the least frequent
tokens give a number of candidates that grows with the square of the corpus (README). A filter's intersection is one
hash of its prefix tokens, found by an equi-join. Beside it travel ``BITS`` sketch bits that differ with probability
(1 - J) / 2 each; pairs with more than ``MOST_BITS`` differing bits, 5.5 standard deviations over the mean at J = 0.7 (one
in ten million), are dropped inside the join. What is left is verified exactly on the whole texts. Long texts take
their orders from few hashes, by bins; texts of few distinct tokens would leave bins empty and so repeat orders, and
take a hash for every order.

Copies are one row from the join on, whichever tasks saw them, and a filter that very many texts pass is joined in
blocks, each pair of blocks by a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.batches import map_text
from lodestone.runtime import cut

ORDERS = 4
FILTERS = 40
BITS, MOST_BITS = 192, 56
#: Texts with no more distinct tokens take an own hash for every order: bins of a shared one would mostly be empty.
FEW = 150
#: Copies of one text that are paired with each other one by one; larger groups are linked to their representative.
EXPAND = 50
#: Texts of one filter that one task joins with each other; more are cut into blocks.
BLOCK = 2_000
_BINS, _CELLS = 64, 512
_PASSES = BITS // _BINS
_SEEDS = np.random.default_rng(20240).integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)


def text_hash(text: str) -> tuple[int, int]:
    """128 bits of a text, as two numbers."""
    h = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"))
    return (h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63)


def _mix(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * seed
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _tokens(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashed character sequences of all texts, and the text each belongs to."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(sizes)
    keep = np.ones(len(codes), bool)
    for back in range(1, n):
        tail = ends - back
        keep[tail[(tail >= ends - sizes) & (tail >= 0)]] = False
    at = np.flatnonzero(keep)
    owner = np.repeat(np.arange(len(texts)), np.maximum(sizes - n + 1, 0))
    h = np.zeros(len(at), np.uint64)
    for i in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[at + i]
    return h, owner


def _occupied(texts: list[str], n: int) -> np.ndarray:
    """Of ``_CELLS`` cells how many the tokens of each text fall into: never more than it has distinct tokens."""
    h, owner = _tokens(texts, n)
    table = np.zeros(len(texts) * _CELLS, bool)
    table[owner * _CELLS + (_mix(h, _SEEDS[300]) >> np.uint64(55)).astype(np.int64)] = True
    return table.reshape(len(texts), _CELLS).sum(1)


def prefixes(texts: list[str], n: int) -> np.ndarray:
    """For each text its first token under each of the orders (one row a text, ``_PASSES * _BINS`` orders).

    A pass hashes each token once; order ``b`` of the pass sequences the tokens by bin, beginning with bin ``b``, and
    by value within a bin. Every text must have a token.
    """
    h, owner = _tokens(texts, n)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.empty((len(texts), _PASSES * _BINS), np.uint64)
    for p in range(_PASSES):
        v = _mix(h, _SEEDS[p])
        table = np.full(len(texts) * _BINS, empty, np.uint64)
        np.minimum.at(table, owner * _BINS + (v >> np.uint64(58)).astype(np.int64), v)
        table = table.reshape(len(texts), _BINS)
        for _ in range(_BINS):  # an empty bin's order goes on with the next bin
            hollow = table == empty
            if not hollow.any():
                break
            table = np.where(hollow, np.roll(table, -1, axis=1), table)
        out[:, p * _BINS : (p + 1) * _BINS] = table
    return out


def short_prefixes(texts: list[str], n: int) -> np.ndarray:
    """The same for short texts: every order hashes all tokens of its own."""
    h, owner = _tokens(texts, n)
    starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return np.stack([np.minimum.reduceat(_mix(h, _SEEDS[i]), starts) for i in range(BITS)], axis=1)


def _fingerprints(n: int, short: bool) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    seen: set[tuple[int, int]] = set()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if len(seen) > 500_000:
            seen.clear()
        texts, hashes = [], []
        for t in batch.column("text").to_pylist():
            h = text_hash(t)
            if h not in seen:  # copies in a task are looked at once
                seen.add(h)
                texts.append(t)
                hashes.append(h[0])
        names = ["filter", "h", "s1", "s2", "s3"]
        if not texts:
            return pa.record_batch([pa.array([], pa.int64())] * 5, names=names)
        if short:
            found = [(short_prefixes(texts, n), np.array(hashes, np.int64))]
        else:
            # a text of up to FEW tokens is like none of more than FEW / 0.7: those between take part in both ways.
            # More than FEW tokens occupy more than 100 cells (seven standard deviations).
            sizes = _occupied(texts, n)
            found = []
            for make, on in ((short_prefixes, sizes <= FEW / 0.7), (prefixes, sizes > 100)):
                if on.any():
                    at = np.flatnonzero(on).tolist()
                    found.append((make([texts[i] for i in at], n), np.array([hashes[i] for i in at], np.int64)))
        cols: list[list[np.ndarray]] = [[], [], [], [], []]
        for firsts, own in found:
            used = firsts[:, : ORDERS * FILTERS].reshape(len(own), ORDERS, FILTERS)
            keys = np.broadcast_to(_SEEDS[100 : 100 + FILTERS], (len(own), FILTERS)).copy()
            for o in range(ORDERS):
                keys = _mix(keys ^ used[:, o, :], _SEEDS[200 + o])
            bits = ((firsts[:, :BITS] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.uint8)
            sketch = np.packbits(bits, axis=1).view(np.int64)
            for col, values in zip(cols, (keys.reshape(-1).view(np.int64), *(np.repeat(v, FILTERS) for v in (own, *sketch.T))), strict=True):
                col.append(values)
        return pa.record_batch([pa.array(np.concatenate(c)) for c in cols], names=names)

    return work


def candidates(texts: DataFrame, n: int, short: bool, block: int = BLOCK) -> DataFrame:
    """``h_a, h_b``: hashes of different texts that pass a filter."""
    rows = map_text(texts, "text", lambda: _fingerprints(n, short), "filter bigint, h bigint, s1 bigint, s2 bigint, s3 bigint")
    once = rows.repartition("filter").distinct()  # the same exchange serves copies, counts and the join
    sized = once.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("filter")))
    few = sized.where(F.col("n") <= block)
    out = _alike(few.alias("a"), few.alias("b"), F.col("a.h") < F.col("b.h"), "filter")
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    many = sized.where(F.col("n") > block).withColumn("own", F.pmod(F.xxhash64("h"), blocks).cast("int")).withColumn("last", blocks - 1)
    left = many.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence("own", "last")))
    right = many.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), "own")))
    order = (F.col("a.i") < F.col("a.j")) | (F.col("a.h") < F.col("b.h"))
    return out.unionByName(_alike(left.alias("a"), right.alias("b"), order, "filter", "i", "j")).distinct()


def _alike(a: DataFrame, b: DataFrame, order: Column, *keys: str) -> DataFrame:
    """Pairs of rows with the same keys whose sketches do not differ too much."""
    on = order
    for k in keys:
        on &= F.col(f"a.{k}") == F.col(f"b.{k}")
    differ = sum((F.bit_count(F.col(f"a.{s}").bitwiseXOR(F.col(f"b.{s}"))) for s in ("s2", "s3")), F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1"))))
    return a.join(b, on & (differ <= MOST_BITS)).select(F.least("a.h", "b.h").alias("h_a"), F.greatest("a.h", "b.h").alias("h_b"))


_LINK = ["h_a", "g_a", "h_b", "g_b"]


def similarity_at_least(a: set, b: set, at_least: float) -> bool:
    both = len(a & b)
    return both * 1_000_000 >= round(at_least * 1_000_000) * (len(a) + len(b) - both)


def _verifier(n: int, at_least: float) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    tokens = lru_cache(maxsize=256)(lambda t: frozenset(t[i : i + n] for i in range(len(t) - n + 1)))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = {c: batch.column(c).to_pylist() for c in (*_LINK, "text_a", "text_b")}
        good = []
        for h_a, g_a, h_b, g_b, x, y in zip(*rows.values(), strict=True):
            # a key may have two texts, and two texts half a hash: what is joined must be what is meant
            good.append(text_hash(x) == (h_a, g_a) and text_hash(y) == (h_b, g_b) and similarity_at_least(tokens(x), tokens(y), at_least))
        return batch.select(_LINK).filter(pa.array(good, pa.bool_()))

    return work


class NearCopies:
    """Near-duplicates among the texts of one column.

    ``n``: characters in a token; ``at_least``: the similarity that makes a link, 0.7 or more; ``least_chars``: shorter
    texts take no part; ``short``: for texts of few tokens such as names. Null keys and texts take no part; repeated
    rows count once; equal texts (by 128 bits) are always linked, those without any token only so. An empty table gives
    empty results. Other columns are not read.
    """

    def __init__(self, df: DataFrame, key: str, text: str, n: int, at_least: float = 0.7, least_chars: int = 0, short: bool = False) -> None:
        if at_least < 0.7:
            raise ValueError("the filters are made for a similarity of 0.7 or more")
        rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.char_length(text) >= least_chars))
        self.texts = rows.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
        self.n, self.at_least, self.short = n, at_least, short

        def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = np.array([text_hash(t) for t in batch.column("text").to_pylist()], np.int64).reshape(-1, 2)
            return pa.record_batch([batch.column("key"), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["key", "h", "g"])

        #: ``key, h, g``: which record has which text.
        self.members = cut(map_text(self.texts, "text", lambda: hashed, "key bigint, h bigint, g bigint").distinct())
        self.copies = self.members.groupBy("h", "g").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n"))

    def text_links(self) -> DataFrame:
        """``h_a, g_a, h_b, g_b``: verified links between different texts."""
        n, at_least = self.n, self.at_least
        long = self.texts.where(F.char_length("text") >= self.n)
        found = cut(candidates(long, self.n, self.short))
        ids = self.copies.select("h", "g", "rep")
        pairs = found.join(ids.toDF("h_a", "g_a", "key_a"), "h_a").join(ids.toDF("h_b", "g_b", "key_b"), "h_b")
        both = pairs.join(self.texts.toDF("key_a", "text_a"), "key_a").join(self.texts.toDF("key_b", "text_b"), "key_b")
        return map_text(both.select(*_LINK, "text_a", "text_b"), "text_a", lambda: _verifier(n, at_least), ", ".join(f"{c} bigint" for c in _LINK)).distinct()

    def pairs(self, expand: int | None = EXPAND) -> DataFrame:
        """``key_a, key_b, listed``: all linked records, those with equal texts included.

        In a group of more than ``expand`` copies every copy is paired with the representative (the smallest key), and
        only the representative with other texts; together with the group's own rows no link is lost. ``listed`` is false
        for a pair that stands for more in this way. ``None`` lists every pair, whatever their number.
        """
        sized = self.members.join(self.copies, ["h", "g"])
        whole = F.lit(True) if expand is None else F.col("n") <= expand
        shown = sized.where(whole | (F.col("key") == F.col("rep"))).select("h", "g", "key", whole.alias("w"))
        across = cut(self.text_links()).join(shown.toDF("h_a", "g_a", "a", "w_a"), ["h_a", "g_a"]).join(shown.toDF("h_b", "g_b", "b", "w_b"), ["h_b", "g_b"])
        some = sized.where((F.col("n") > 1) & whole).select("h", "g", "key")
        within = some.toDF("h", "g", "a").join(some.toDF("h", "g", "b"), ["h", "g"]).where("a < b").select("a", "b", F.lit(True).alias("w"))
        many = sized.where((F.col("n") > 1) & ~whole & (F.col("key") != F.col("rep"))).select(F.col("rep").alias("a"), F.col("key").alias("b"), F.lit(False).alias("w"))
        every = across.select("a", "b", (F.col("w_a") & F.col("w_b")).alias("w")).where("a <> b").unionByName(within).unionByName(many)
        return every.groupBy(F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b")).agg(F.bool_and("w").alias("listed"))

    def groups(self) -> DataFrame:
        """``key, class_id, class_size``: every record, with the smallest key of those it is connected to by links."""
        names = self.copies.select("h", "g", "rep")
        links = self.text_links().join(names.toDF("h_a", "g_a", "a"), ["h_a", "g_a"]).join(names.toDF("h_b", "g_b", "b"), ["h_b", "g_b"]).select("a", "b")
        label = components(links)
        texts = self.copies.join(label, self.copies["rep"] == label["node"], "left").select("h", "g", F.coalesce("root", "rep").alias("class_id"), "n")
        sizes = texts.groupBy("class_id").agg(F.sum("n").alias("class_size"))
        return self.members.join(texts.drop("n"), ["h", "g"]).join(sizes, "class_id").select("key", "class_id", "class_size")


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """``node, root``: connected components of undirected links ``a, b``; the root is the smallest node.

    Large stars and small stars in turn: every node's larger neighbours, then its smaller ones, are hung on the
    smallest node it knows, until nothing changes. Each round is two shuffles and is cut in the shared folder; a star
    is aggregated, never gathered in one task.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
    raise RuntimeError("the components did not settle")
