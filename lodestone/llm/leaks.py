"""Held-out passages inside a training corpus, by suffix arrays of the corpus.

Each shard of the corpus (a slice of one partition) gets a suffix array, sorted to the length of the longest test item;
every suffix of every test item is looked up in it by binary search. Both sides are reduced to letters and digits
without case. A match of ``at_least`` characters covers a suffix that starts at a multiple of ``STEP`` with
``at_least - STEP + 1`` characters after it, so the array needs every ``STEP``-th suffix only and no match is lost. The
suffixes found are widened to whole matches of ``at_least`` characters on either side of their start, and for each
document and item that have one the longest match is found by bisection of its length.

Equal test suffixes are one, and what is found is kept once for each document and item, so repeats cost memory in
proportion to the shard, never the product of both sides. The test items are small by definition (their size is
checked) and go to every task; no part of the corpus is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_text

AT_LEAST = 40
STEP = 8
#: Most bytes of test text that are looked up at a time, and that are sent to every task for one scan of the corpus.
PART_BYTES, SCAN_BYTES = 4_000_000, 64_000_000


def _folding() -> np.ndarray:
    """For each code point its lower-case letter or digit, or 0."""
    out = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalnum():
            low = char.lower()
            out[code] = ord(low) if len(low) == 1 else ord(low[0])
    return out


_FOLDING: list[np.ndarray] = []


def reduce_text(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one row of folded letters and digits, and where each begins and ends."""
    if not _FOLDING:
        _FOLDING.append(_folding())
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    raw = np.frombuffer("".join(t for t in texts if t).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _FOLDING[0][raw]
    kept = folded != 0
    edges = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(sizes)])]
    return folded[kept], edges


def _packed(chars: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
    """Four characters from ``at + first`` on as one sortable number; beyond 16 bits a character is folded, which can
    only add hits that the exact comparison drops."""
    out = np.zeros(len(at), np.uint64)
    for i in range(first, first + 4):
        out = (out << np.uint64(16)) | (chars[at + i] & np.uint32(0xFFFF)).astype(np.uint64)
    return out


class SuffixArray:
    """The suffixes of a shard that start at multiples of ``STEP``, in order of their first ``depth`` characters."""

    def __init__(self, chars: np.ndarray, edges: np.ndarray, depth: int) -> None:
        self.chars = np.concatenate([chars, np.zeros(64 + AT_LEAST, np.uint32)])
        self.edges = edges
        at = np.arange(0, len(chars), STEP)
        one, two = _packed(self.chars, at, 0), _packed(self.chars, at, 4)
        order = np.argsort(one, kind="stable")
        rank = self._refined(order, one, two)
        known = STEP  # characters that the ranks tell apart
        while known < depth:
            further = np.append(rank, np.zeros(known // STEP, np.int64))[known // STEP :][: len(rank)]
            if not len(self._tied(rank[order])):
                break
            rank = self._refined(order, rank, further)
            known *= 2
        self.at, self.one = at[order], one[order]

    @staticmethod
    def _tied(keys: np.ndarray) -> np.ndarray:
        same = keys[1:] == keys[:-1]
        return np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(keys) else np.zeros(0, np.int64)

    @classmethod
    def _refined(cls, order: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Sort ``order``, which is by ``first``, by ``second`` where ``first`` is equal; the new ranks, from 1."""
        tied = cls._tied(first[order])
        inner = order[tied]
        order[tied] = inner[np.lexsort((second[inner], first[inner]))]  # ties are sorted among themselves: their places are the same
        a, b = first[order], second[order]
        new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])) if len(order) else np.zeros(0, bool)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def find(self, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each prefix (one row of packed characters) the range of suffixes that begin with it."""
        lo, hi = np.searchsorted(self.one, prefixes[:, 0], "left"), np.searchsorted(self.one, prefixes[:, 0], "right")
        for word in range(1, prefixes.shape[1]):  # inside the range so far suffixes are in order of their next characters
            live = np.flatnonzero(hi > lo)
            lo[live], hi[live] = self._narrow(lo[live], hi[live], prefixes[live, word], word), self._narrow(lo[live], hi[live], prefixes[live, word], word, True)
        return lo, hi

    def _narrow(self, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, word: int, after: bool = False) -> np.ndarray:
        lo, hi = lo.copy(), hi.copy()
        while len(live := np.flatnonzero(lo < hi)):
            mid = (lo[live] + hi[live]) // 2
            here = _packed(self.chars, self.at[mid], 4 * word)
            up = here <= wanted[live] if after else here < wanted[live]
            lo[live[up]] = mid[up] + 1
            hi[live[~up]] = mid[~up]
        return lo


def _window_hashes(chars: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` characters, equal for equal runs."""
    h, size, out, used = chars.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(chars) - width + 1
    while True:  # runs of 1, 2, 4, ... characters, put together by the digits of ``width``
        if width & size:
            part = h[used : used + n]
            out = part.copy() if out is None else _mixed(out, part)
            used += size
        if 2 * size > width:
            return out
        h = _mixed(h[:-size], h[size:])
        size *= 2


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _common(a: np.ndarray, b: np.ndarray, width: int) -> tuple[int, int] | None:
    """Where a run of ``width`` characters that both have begins in each, the first such in ``a``; ``None`` without one."""
    if min(len(a), len(b)) < width:
        return None
    x, y = _window_hashes(a, width), _window_hashes(b, width)
    order = np.argsort(y, kind="stable")
    place = np.minimum(np.searchsorted(y, x, sorter=order), len(y) - 1)
    for i in np.flatnonzero(y[order[place]] == x).tolist():
        j = int(order[place[i]])
        if np.array_equal(a[i : i + width], b[j : j + width]):
            return i, j
    return None


def longest_common(a: np.ndarray, b: np.ndarray, at_least: int) -> tuple[int, int]:
    """Where the longest run that both have begins in ``a``, the first of equal ones, and its length; it has ``at_least``."""
    good, best, bad = at_least, _common(a, b, at_least), min(len(a), len(b)) + 1
    while best and bad - good > 1:
        middle = (good + bad) // 2
        found = _common(a, b, middle)
        good, best, bad = (middle, found, bad) if found else (good, best, middle)
    return (best[0], good) if best else (0, 0)


class Items:
    """The reduced test items and the suffixes to look up."""

    def __init__(self, ids: list[int], texts: list[str], at_least: int) -> None:
        self.ids, self.at_least = np.array(ids, np.int64), at_least
        chars, self.edges = reduce_text(texts)
        self.chars = np.concatenate([chars, np.zeros(64 + AT_LEAST, np.uint32)])
        self.depth = int(np.diff(self.edges).max(initial=0))
        owner = np.repeat(np.arange(len(ids)), np.diff(self.edges))
        at = np.arange(len(chars))
        left = self.edges[owner + 1] - at
        # eight words of four characters are less than every match has after its first suffix in the array
        some = at[left >= AT_LEAST - STEP + 1]
        packed = np.stack([_packed(self.chars, some, 4 * i) for i in range((AT_LEAST - STEP) // 4)], axis=1)
        self.prefixes = np.unique(packed, axis=0) if len(some) else packed
        #: Every run of ``at_least`` characters inside an item: its number, in order, and the item.
        whole = at[left >= at_least]
        runs = _window_hashes(self.chars, at_least)[whole]
        both = np.unique(np.stack([runs, owner[whole].astype(np.uint64)], axis=1), axis=0) if len(whole) else np.zeros((0, 2), np.uint64)
        self.runs, self.run_item = both[:, 0].copy(), both[:, 1].astype(np.int64)

    def matches(self, array: SuffixArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, item, position in the reduced document and length of the longest match, for all that have one."""
        lo, hi = array.find(self.prefixes)  # different prefixes have ranges that do not overlap
        n = hi - lo
        rank = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        t = array.at[rank]
        doc = np.searchsorted(array.edges, t, "right") - 1
        pairs, every_run = [np.zeros((0, 2), np.int64)], None
        for back in range(STEP):  # the match may begin up to STEP - 1 characters before the suffix
            begin = t - back
            on = (begin >= array.edges[doc]) & (begin + self.at_least <= array.edges[doc + 1])
            if not on.any() or not len(self.runs):
                continue
            begin, own = begin[on], doc[on]
            if len(begin) * 4 < len(array.chars) // self.at_least:
                run = _window_hashes(array.chars[begin[:, None] + np.arange(self.at_least)].reshape(-1), self.at_least)[:: self.at_least]
            else:
                every_run = _window_hashes(array.chars, self.at_least) if every_run is None else every_run
                run = every_run[begin]
            keys = np.unique(np.stack([run, own.astype(np.uint64)], axis=1), axis=0)
            a, b = np.searchsorted(self.runs, keys[:, 0], "left"), np.searchsorted(self.runs, keys[:, 0], "right")
            m = b - a
            at = np.repeat(a - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            pairs.append(np.unique(np.stack([np.repeat(keys[:, 1].astype(np.int64), m), self.run_item[at]], axis=1), axis=0))
        every = np.unique(np.concatenate(pairs), axis=0)
        out = []
        for d, i in every.tolist():
            start, length = longest_common(array.chars[array.edges[d] : array.edges[d + 1]], self.chars[self.edges[i] : self.edges[i + 1]], self.at_least)
            if length:
                out.append((d, i, start, length))
        cols = np.array(out, np.int64).reshape(-1, 4)
        return cols[:, 0], cols[:, 1], cols[:, 2], cols[:, 3]


def leaks(corpus: DataFrame, items: DataFrame, at_least: int = AT_LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, start, length``: the longest verbatim match of each item in each document it occurs in.

    ``start`` and ``length`` count letters and digits. ``at_least`` may not be under 40. Null keys and texts and texts
    without letters match nothing; copies of a document are each reported; of repeated rows one is. Empty corpus or
    items give an empty result.
    """
    if at_least < AT_LEAST:
        raise ValueError(f"at_least must be {AT_LEAST} or more")
    tests = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = tests.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    scans = max(1, -(-size // SCAN_BYTES))
    rows = corpus.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    out = None
    for i in range(scans):
        own = tests if scans == 1 else tests.where(F.pmod(F.xxhash64("item_id"), F.lit(scans)) == i)
        part = own.toArrow()
        sent = corpus.sparkSession.sparkContext.broadcast((part.column("item_id").to_pylist(), part.column("text").to_pylist()))
        found = map_text(rows, "text", lambda sent=sent: _searcher(*sent.value, at_least), "doc_id bigint, item_id bigint, start bigint, length bigint")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("length", (-F.col("start")).alias("s")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", (-F.col("b.s")).alias("start"), F.col("b.length").alias("length"))


def _searcher(ids: list[int], texts: list[str], at_least: int) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    parts, begin, size = [], 0, 0
    for i, t in enumerate([*texts, None]):
        if begin < i and (t is None or size > PART_BYTES):
            parts.append(Items(ids[begin:i], texts[begin:i], at_least))
            begin, size = i, 0
        size += 4 * len(t or "")
    depth = max((p.depth for p in parts), default=0)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        chars, edges = reduce_text(batch.column("text").to_pylist())
        array = SuffixArray(chars, edges, depth)
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
        for tests in parts:
            doc, item, start, length = tests.matches(array)
            for col, values in zip(cols, (keys[doc], tests.ids[item], start, length), strict=True):
                col.append(values)
        return pa.record_batch([pa.array(np.concatenate(c), pa.int64()) for c in cols], names=["doc_id", "item_id", "start", "length"])

    return work


def without_leaks(corpus: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The corpus without the documents concerned; rows with a null key stay."""
    bad = found.select(F.col("doc_id").alias("__leaked")).distinct()
    return corpus.join(bad, F.col(key) == F.col("__leaked"), "left_anti")
