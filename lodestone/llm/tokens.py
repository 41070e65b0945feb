"""Token ids of a whole corpus by a public byte-level BPE vocabulary: speculate and verify.

A word's tokens are first proposed by greedy longest match, for all new words of a batch at once. A sequence is what
merging would give exactly when every two neighbours are compatible, that is, when merging their joined bytes gives
the two again. Compatibility of all distinct pairs is checked with vectorised table look-ups by undoing merges along
the seam. Words with an incompatible pair, and only those, are merged exactly.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_text

#: Words a worker remembers before it starts anew; bounds its memory, not the result.
REMEMBERED = 250_000
# The usual byte-level pattern in the standard library's terms, for texts without the characters that differ: numbers
# that are no decimal digits, control characters, and whatever lies beyond the basic plane.
USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_FAST = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_UNLIKE = re.compile("[" + "".join(chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) in ("No", "Nl")) + "\x1c-\x1f\U00010000-\U0010ffff]")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class Table:
    """A fixed map from non-negative 63-bit keys to ints, looked up for whole arrays; -1 for what it lacks."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int64)
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]  # of several at one place the last one stays
            won = free[self.keys[at[free]] == keys[free]]
            self.values[at[won]] = values[won]
            lost = np.ones(len(keys), bool)
            lost[won] = False
            left = left[lost[left]]
            at[left] = (at[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.keys[at] != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            k = self.keys[at[open_]]
            hit = k == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (k != -1)]
        return out


class SpeculativeBpe:
    """Encodes words by a vocabulary of byte strings whose ids are their merge ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.words = regex.compile(pattern)
        self.usual = pattern == USUAL
        size = max(ranks.values()) + 1
        self.left, self.right = np.arange(size), np.arange(size)  # what a token was merged of; itself if a single byte
        for piece, rank in ranks.items():
            if len(piece) > 1:
                halves = self._halves(piece, rank)
                if halves:
                    self.left[rank], self.right[rank] = halves
        merged = np.flatnonzero(self.left != np.arange(size))
        self.merge = Table((self.left[merged] << 32) | self.right[merged], merged)
        self._build_trie()
        self.exact = self._exact()
        self.forget()

    def _halves(self, piece: bytes, rank: int) -> tuple[int, int] | None:
        parts = self._merge(piece, rank)
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None

    def _merge(self, piece: bytes, below: int | None = None) -> list[bytes]:
        """Exact merging: the adjacent pair of lowest rank first, the leftmost of equals; only ranks under ``below``.

        Waiting pairs are kept in order of rank and place, so a word of any length takes its length times its logarithm.
        """
        n = len(piece)
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        waiting: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n:
                rank = self.ranks.get(piece[i : end[j]])
                if rank is not None and (below is None or rank < below):
                    heappush(waiting, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, j, upto = heappop(waiting)
            if after[i] != j or end[i] != j or end[j] != upto:
                continue  # one of the two has become part of something else
            end[i], after[i] = end[j], after[j]
            end[j] = after[j] = -1
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(piece[i : end[i]])
            i = end[i]
        return out

    def _exact(self) -> Callable[[bytes], list[int]]:
        own = lambda piece: [self.ranks[p] for p in self._merge(piece)]
        try:
            import tiktoken
        except ImportError:
            return own
        library = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=self.ranks, special_tokens={})

        def exact(piece: bytes) -> list[int]:
            try:
                return library.encode_ordinary(piece.decode())
            except UnicodeDecodeError:
                return own(piece)

        return exact

    def _build_trie(self) -> None:
        nodes: dict[tuple[int, int], int] = {}
        token = [-1]
        for piece, rank in self.ranks.items():
            at = 0
            for byte in piece:
                nxt = nodes.get((at, byte))
                if nxt is None:
                    nxt = nodes[at, byte] = len(token)
                    token.append(-1)
                at = nxt
            token[at] = rank
        keys = np.array([a << 8 | b for a, b in nodes], np.int64)
        self.edges = Table(keys, np.array(list(nodes.values()), np.int64))
        self.node_token = np.array(token, np.int64)
        self.size = np.zeros(len(self.left), np.int64)
        for piece, rank in self.ranks.items():
            self.size[rank] = len(piece)

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.int32)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes of ``a`` and ``b`` gives the two again, for arrays of token ids.

        Going back in time from the whole tokens: at each moment the two pieces that touch at the seam must not have a
        merge that comes before the merge that made either of them part of something larger.
        """
        a, b = a.copy(), b.copy()
        until = np.full(len(a), np.iinfo(np.int64).max)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            joined = self.merge.get((x << 32) | y)
            bad = (joined >= 0) & (joined < until[live])
            good[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            can_x, can_y = self.right[x] != x, self.left[y] != y
            # the later merge is undone first; of equal ranks (a token beside itself) the left one happened first
            undo_x = can_x & (~can_y | (x > y))
            undo_y = can_y & ~undo_x
            i, j = live[undo_x], live[undo_y]
            until[i], a[i] = a[i], self.right[a[i]]
            until[j], b[j] = b[j] + 1, self.left[b[j]]
            live = live[undo_x | undo_y]
        return good

    def propose(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words at once: tokens, and the word each belongs to, in order."""
        reach = np.zeros(len(data), np.int64)
        best = np.zeros(len(data), np.int64)
        at, node, depth = np.arange(len(data)), np.zeros(len(data), np.int64), 0
        stop = np.repeat(ends, ends - starts)
        while len(at):
            node = self.edges.get((node << 8) | data[at + depth])
            on = node >= 0
            at, node = at[on], node[on]
            depth += 1
            token = self.node_token[node]
            is_token = token >= 0
            best[at[is_token]], reach[at[is_token]] = token[is_token], depth
            more = at + depth < stop[at]
            at, node = at[more], node[more]
        tokens, owners, place = [], [], starts.copy()
        live = np.flatnonzero(starts < ends)
        while len(live):
            p = place[live]
            tokens.append(best[p])
            owners.append(live)
            place[live] = p + reach[p]
            live = live[place[live] < ends[live]]
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(tokens)[order], owner[order]

    def learn(self, words: list[str]) -> None:
        """Encode words not seen before."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(sizes)
        tokens, owner = self.propose(np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), ends - sizes, ends)
        counts = np.bincount(owner, minlength=len(raw))
        beside = np.flatnonzero(owner[:-1] == owner[1:])
        pairs, which = np.unique((tokens[beside] << 32) | tokens[beside + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed = np.unique(owner[beside[~good[which]]])
        fixed = [self.exact(raw[i]) for i in failed.tolist()]
        keep = np.ones(len(raw), bool)
        keep[failed] = False
        base = len(self.pool)
        own = tokens[keep[owner]]
        ids = np.concatenate([own, np.fromiter((t for f in fixed for t in f), np.int64)]).astype(np.int32)
        lengths = np.where(keep, counts, 0)
        starts = base + np.cumsum(lengths) - lengths
        fixed_len = np.fromiter(map(len, fixed), np.int64, len(fixed))
        lengths[failed] = fixed_len
        starts[failed] = base + len(own) + np.cumsum(fixed_len) - fixed_len
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, ids])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin and end."""
        if len(self.known) > REMEMBERED:
            self.forget()
        slow, fast = self.words.findall, _FAST.findall if self.usual else self.words.findall
        split = [(slow if _UNLIKE.search(t) else fast)(t) if t else [] for t in texts]
        flat = [w for words in split for w in words]
        new = list(set(flat).difference(self.known))
        if new:
            self.learn(new)
        which = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        at = np.repeat(self.starts[which] - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)
        edge = np.cumsum([0, *map(len, split)])
        return self.pool[at], np.concatenate([[0], ends])[edge]


_BY_PATH: dict[tuple[str, str], SpeculativeBpe] = {}


def encoder(path: str, pattern: str) -> SpeculativeBpe:
    """One encoder a worker process and vocabulary; it is kept for later tasks."""
    if (path, pattern) not in _BY_PATH:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _BY_PATH[path, pattern] = SpeculativeBpe(ranks, pattern)
    return _BY_PATH[path, pattern]


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``doc_id, ids``: one row for each row of ``df``.

    Null and empty texts get the empty list; blank texts are encoded like any other; special tokens are never used.
    A null key stays null, repeated rows are kept. ``path``: a ``.tiktoken`` rank file that every executor can read.
    """
    path, pattern = path or default_vocabulary(), pattern or default_pattern()

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        bpe = encoder(path, pattern)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, edges = bpe.encode(batch.column("text").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids, pa.int32()))
            return pa.record_batch([batch.column("doc_id"), lists], names=["doc_id", "ids"])

        return work

    rows = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_text(rows, "text", make, "doc_id bigint, ids array<int>")
