"""Text read in the wrong character encoding: finding it and restoring the original.

Every pair of adjacent characters has a weight from counts over the whole corpus, its term of the mutual information
``p(ab) * log(p(ab) / (p(a) p(b)))`` (the logarithm counts as 1 at least, so that frequent chance pairs are not
punished). In these counts a run that is valid UTF-8 by an inverse mapping stands as what it was, and other certain
marks and long runs of Latin-1 bytes are left out, so that a source read wrongly is not made probable by its size.
Pairs below a threshold score positive, others negative, and the maximum-scoring segments of these scores are the
improbable runs; thresholds are set against the median pair of the corpus. Inverse mappings (encode by the encoding that was wrongly used, decode by the right one) are tried on
the characters of such runs only, and kept if they make the run clearly more probable. Texts with a run as described
or a certain mark are looked at in any case. Replacement characters, private-use characters and C1 controls are
garbled in any case; they may not be recoverable.
"""

from __future__ import annotations

import codecs
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.batches import map_text, sliced
from lodestone.llm.lookalikes import one_form, one_forms

#: Buckets of the pair table: what is collected and sent to every task is bounded by it.
PAIR_BUCKETS = 1 << 20
#: Thresholds are log10 weights under the corpus's own level, the median weight of its pairs beyond ASCII: what many
#: languages share is thinner for each of them, and so is their level. A pair that far below it is improbable; a run above
#: the second is left as it is; a repair must come out above the third; a text reads well in its one form above the fourth.
IMPROBABLE, PLAUSIBLE, ACCEPTABLE, FLUENT = 1.22, 0.22, 1.72, 0.72
#: The gain in mean log10 weight that a repair must bring.
GAIN = 0.7
#: Pairs seen no more often than this are no more than acceptable, however small the corpus is.
RARE = 4
#: What a pair that was never seen is below the level.
_FLOOR = 5.02
#: Right encodings by the encoding that was wrongly used to read.
INVERSE = {
    "cp1252": ("utf-8", "gb18030", "cp1251", "big5"),
    "latin-1": ("utf-8", "gb18030", "cp1251", "big5"),
    "cp437": ("utf-8", "cp1252"),
    "cp850": ("utf-8", "cp1252"),
    "mac_roman": ("utf-8", "cp1252"),
    "cp1251": ("utf-8", "cp1252", "koi8_r", "gb18030"),
    "koi8_r": ("utf-8", "cp1251"),
    "cp866": ("utf-8", "cp1251"),
    "cp1250": ("utf-8",),
    "gb18030": ("utf-8", "cp1251", "cp1252", "big5"),
    "big5": ("utf-8", "gb18030"),
    "cp932": ("utf-8",),
    "cp949": ("utf-8",),
    "utf-8": ("gb18030",),
}
#: Pairs that map one character to one: any text can be read so, so they need letters around them as well.
SINGLE = {"cp1252", "cp1251", "koi8_r"}

#: A text is looked at if one of its pairs lies so far below the threshold.
DOUBT = 0.5
#: Sum of a segment's scores from which it is tested inside a span that is likely as a whole.
CLEAR = 3.0
_CERTAIN = re.compile("[\ufffd\ue000-\uf8ff\x80-\x84\x86-\x9f]")
#: Encodings that UTF-8 may have been read in: of one byte a character, of two.
_ONE = [c for c, rights in INVERSE.items() if "utf-8" in rights and c not in ("gb18030", "big5", "cp932", "cp949")]
_TWO = [c for c in INVERSE if c in ("gb18030", "big5", "cp932", "cp949")]
#: So many adjacent characters of the upper half of Latin-1 are bytes of another encoding, not words.
_ALL_HIGH = 4
#: Runs of ideographs or of other characters beyond ASCII.
_ALIKE = re.compile(r"[\u2e80-\uffee]{2,}|[^\x00-\x7f\ufffd\u2e80-\uffee]{2,}")
_LOW = re.compile("[a-z]")
_NARROW = re.compile("[\x80-\u2e7f]")
_SPAN = re.compile(r"[^\x00-\x7f]+(?:[ -~]?[^\x00-\x7f]+)*[a-z]?")


_LETTER = np.array([chr(c).isalpha() for c in range(128)])


def _bucket(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The pair's bucket; odd ones are those of pairs with a character beyond ASCII."""
    h = a * 0x9E3779B1 + b * 0x85EBCA77
    return (h ^ (h >> 17)) & (PAIR_BUCKETS - 2) | ((a > 127) | (b > 127))


def _codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each text followed by a 0, and where each text begins."""
    sizes = np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts))
    joined = "\0".join(t or "" for t in texts) + "\0"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.cumsum(sizes) - sizes


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point, a bit for each encoding: it reads a lead byte so (of 2, of 3 or 4), or a continuation byte; then
    for encodings of two bytes the kinds of both, as bits: lead and continuation 1, continuation and lead 2, continuations 4.
    """
    lead2, lead3, further = (np.zeros(0x10000, np.uint16) for _ in range(3))
    for bit, codec in enumerate(_ONE):
        for byte in range(0x80, 0xF5):
            raw = bytes([byte])
            seen = raw.decode(codec, "ignore") or (raw.decode("latin-1") if codec == "cp1252" else "")
            for c in seen:
                table = further if byte < 0xC0 else lead2 if byte < 0xE0 else lead3
                table[ord(c)] |= 1 << bit
    pairs = np.zeros(0x10000, np.uint16)
    for i, codec in enumerate(_TWO):
        for code in range(0x80, 0x10000):
            raw = chr(code).encode(codec, "ignore") if not 0xD800 <= code < 0xE000 else b""
            if len(raw) == 2:
                one, two = (0 if b < 0x80 else 1 if b < 0xC0 else 2 if b < 0xF5 else 0 for b in raw)
                pairs[code] |= {(2, 1): 1, (1, 2): 2, (1, 1): 4}.get((one, two), 0) << (4 * i)
    return lead2, lead3, further, pairs


@lru_cache(maxsize=100_000)
def as_utf8(run: str, codecs_: tuple[str, ...] | None = None) -> str | None:
    """What the run was if it is UTF-8 read in another encoding (of ``codecs_``), perhaps more than once; else ``None``.

    The whole run must be valid; signs and letters of Latin script may stand alone, others need a second one.
    """
    for codec in (*_ONE, *_TWO) if codecs_ is None else codecs_:
        raw = _sloppy(run, codec)
        try:
            fixed = raw.decode("utf-8") if raw is not None else ""
        except UnicodeDecodeError:
            continue
        foreign = [c for c in fixed if c > "\x7f"]
        if not foreign or len(fixed) >= len(run) and codec in _ONE or _CERTAIN.search(fixed):
            continue
        known = sum("\xa0" <= c < "\u0180" or "\u2010" <= c < "\u2045" or c in "€™" for c in foreign)
        if known == len(foreign) or len(foreign) > 1 and all("\xa0" <= c < "\u0250" or "\u0370" <= c < "\u0530" or "\u2010" <= c < "\u2200" or "\u2e80" <= c < "\ua000" or "\uac00" <= c < "\ud7b0" or "\uff00" <= c < "\uffe7" for c in foreign):
            return as_utf8(fixed) or fixed
    return None


def _upper(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of all runs of characters beyond ASCII, and the places of those that ``_CERTAIN`` matches."""
    at = np.flatnonzero(codes > 127)
    if not len(at):
        return at, at, at
    cut = np.flatnonzero(np.diff(at) > 1)
    c = codes[at]
    certain = (c == 0xFFFD) | (c >= 0xE000) & (c <= 0xF8FF) | (c <= 0x9F) & (c != 0x85)
    return at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + 1, at[certain]


def _misread(texts: list[str | None], codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[str, list[tuple[int, int, str]]]:
    """The texts joined, and their runs that are UTF-8 read in another encoding, with what they were; weights play no part."""
    if not len(begin):
        return "", []
    lead2, lead3, further, pairs = _tables()
    last = len(codes) - 1  # a 0, as is what follows each text
    c0, c1, c2 = (np.minimum(codes[np.minimum(begin + i, last)], 0xFFFF) for i in range(3))
    one = (lead2[c0] & further[c1]) | (lead3[c0] & further[c1] & further[c2])
    size = end - begin
    p0, p1, p2 = pairs[c0], pairs[c1], pairs[c2]
    two = np.where(size > 2, (p0 & (p1 >> 1) & (p2 >> 2) & 0x1111) | (p0 & p1 & p2 & 0x1111), 0)
    before, after = codes[begin - 1], codes[end]
    inside = (size == 1) & (before >= 97) & (before <= 122) & (after >= 97) & (after <= 122)  # alone inside a word
    two |= np.where(inside, p0 & 0x1111, 0)
    at = np.flatnonzero((one > 0) | (two > 0))
    joined = "\0".join(t or "" for t in texts) + "\0" if len(at) else ""
    out = []
    for a, b, x, y in zip(begin[at].tolist(), end[at].tolist(), one[at].tolist(), two[at].tolist(), strict=True):
        # the first characters already say which encodings can be meant
        can = tuple(c for i, c in enumerate(_ONE) if x >> i & 1) + tuple(c for i, c in enumerate(_TWO) if y >> 4 * i & 1)
        if (fixed := as_utf8(joined[a:b], can)) is not None:
            out.append((a, b, fixed))
    return joined, out


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of what the texts say: UTF-8 that was read wrongly counts as what it was, other certain marks not at all.

    So a source that was read wrongly does not become probable by its size.
    """
    pairs, single = np.zeros(PAIR_BUCKETS, np.int64), np.zeros(0x110000, np.int64)
    for batch in sliced(batches, "text"):
        texts = batch.column("text").to_pylist()
        codes, _ = _codes(texts)
        begin, end, certain = _upper(codes)
        joined, misread = _misread(texts, codes, begin, end)
        if misread:
            parts, at = [], 0
            for a, b, fixed in misread:
                parts += [joined[at:a], fixed]
                at = b
            codes = np.frombuffer(("".join(parts) + joined[at:]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            begin, end, certain = _upper(codes)
        codes[certain] = 0
        long = (end - begin >= _ALL_HIGH) & (codes[begin] < 0x100)
        for a, b in zip(begin[long].tolist(), end[long].tolist(), strict=True):
            if codes[a:b].max() < 0x100:
                codes[a:b] = 0
        single += np.bincount(codes, minlength=0x110000)
        pairs += np.bincount(_bucket(codes[:-1], codes[1:])[(codes[:-1] > 0) & (codes[1:] > 0)], minlength=PAIR_BUCKETS)
    for kind, table in ((0, pairs), (1, single)):
        used = np.flatnonzero(table)
        yield pa.record_batch([pa.array(np.full(len(used), kind), pa.int32()), pa.array(used, pa.int64()), pa.array(table[used], pa.int64())], names=["kind", "slot", "n"])


class Weights:
    """Log10 weights of character pairs."""

    def __init__(self, pair_slots: np.ndarray, pair_counts: np.ndarray, chars: np.ndarray, char_counts: np.ndarray) -> None:
        self.pairs = np.zeros(PAIR_BUCKETS)
        self.pairs[pair_slots] = pair_counts
        self.single = np.ones(0x110000)
        self.single[chars] = char_counts
        self.total = max(1.0, float(self.pairs.sum()))
        beyond = np.sort(self.pairs[1::2])[::-1]
        level = beyond[np.searchsorted(np.cumsum(beyond), beyond.sum() / 2)] if beyond[0] else 1.0
        #: Log10 share of the pair that the median of all pairs beyond ASCII is.
        self.level = float(np.log10(level / self.total))
        self.floor = self.level - _FLOOR
        self._known: dict[str, float] = {}

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What the constructor takes, without zeros."""
        pairs, chars = np.flatnonzero(self.pairs), np.flatnonzero(self.single > 1)
        return pairs, self.pairs[pairs].astype(np.int64), chars, self.single[chars].astype(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """For each adjacent pair of ``codes``."""
        return self.of_pairs(codes[:-1], codes[1:])

    def of_pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n = self.pairs[_bucket(a, b)]
        with np.errstate(divide="ignore", invalid="ignore"):
            pmi = np.log(n * self.total / (self.single[a] * self.single[b]))
            weight = np.log10(n / self.total * np.maximum(1.0, pmi))
        weight = np.where(n > RARE, weight, np.minimum(weight, self.level - ACCEPTABLE))
        return np.where(n > 0, np.maximum(weight, self.floor), self.floor)

    def _one(self, a: int, b: int) -> float:
        """The same for one pair."""
        n = float(self.pairs[int(_bucket(a, b))])
        if n <= 0:
            return self.floor
        pmi = math.log(n * self.total / (float(self.single[a]) * float(self.single[b])))
        weight = math.log10(n / self.total * max(1.0, pmi))
        return max(self.floor, weight if n > RARE else min(weight, self.level - ACCEPTABLE))

    def mean(self, text: str) -> float:
        """Mean weight of the text's pairs; the floor for a text without any."""
        if len(text) > 64:
            return float(self.of(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)).mean())
        known = self._known
        total = 0.0
        for a, b in zip(text, text[1:], strict=False):
            pair = a + b
            weight = known.get(pair)
            if weight is None:
                if len(known) > 400_000:
                    known.clear()
                weight = known[pair] = self._one(ord(a), ord(b))
            total += weight
        return total / (len(text) - 1) if len(text) > 1 else self.floor


def corpus_weights(df: DataFrame, text: str = "text") -> Weights:
    """Counts over all texts; at most ``PAIR_BUCKETS`` and 1.1 million bounded rows come to the driver."""
    rows = df.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    counts = rows.mapInArrow(_count, "kind int, slot bigint, n bigint").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    kind, slot, n = (counts.column(c).to_numpy() for c in ("kind", "slot", "n"))
    return Weights(slot[kind == 0], n[kind == 0], slot[kind == 1], n[kind == 1])


def improbable_segments(scores: np.ndarray) -> list[tuple[int, int]]:
    """All maximum-scoring segments of a row of scores, as half-open ranges: disjoint, each of the largest sum."""
    if not len(scores):
        return []
    # neighbours of one sign go together
    starts = np.flatnonzero(np.concatenate([[True], (scores[1:] > 0) != (scores[:-1] > 0)]))
    sums = np.add.reduceat(scores, starts).tolist()
    places = [*starts.tolist(), len(scores)]
    stack: list[tuple[int, int, float, float]] = []  # begin, end, sum before the segment, sum at its end
    total = 0.0
    for i, s in enumerate(sums):
        if s <= 0:
            total += s
            continue
        begin, before = places[i], total
        total += s
        end, after = places[i + 1], total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= before:
                j -= 1
            if j < 0 or stack[j][3] >= after:
                stack.append((begin, end, before, after))
                break
            begin, before = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e) for b, e, _, _ in stack]


def _own_byte(error: UnicodeError) -> tuple[bytes, int]:
    part = error.object[error.start : error.end]
    if max(part) > "\xff":
        raise error
    return part.encode("latin-1"), error.end


codecs.register_error("own-byte", _own_byte)


def _sloppy(span: str, codec: str) -> bytes | None:
    """Encode; characters that CP1252 left as C1 controls when reading become their byte again."""
    try:
        return span.encode(codec, "own-byte" if codec == "cp1252" else "strict")
    except UnicodeEncodeError:
        return None


class Finder:
    """Finds and repairs garbled runs, given the weights of the corpus."""

    def __init__(self, weights: Weights) -> None:
        self.weights = weights
        self.improbable, self.plausible, self.acceptable, self.fluent = (weights.level - x for x in (IMPROBABLE, PLAUSIBLE, ACCEPTABLE, FLUENT))
        self.repair_span = lru_cache(maxsize=100_000)(self._repair_span)

    def doubtful(self, codes: np.ndarray, foreign: np.ndarray) -> np.ndarray:
        """Where pairs of ``codes`` begin that are clearly improbable, of those that are ``foreign``."""
        at = np.flatnonzero(foreign)
        # a pair seen so often is probable enough whatever its characters are
        few = max(RARE, self.weights.total * 10 ** (self.improbable - DOUBT))
        at = at[self.weights.pairs[_bucket(codes[at], codes[at + 1])] <= few]
        at = at[(codes[at] > 0) & (codes[at + 1] > 0)]
        return at[self.weights.of_pairs(codes[at], codes[at + 1]) < self.improbable - DOUBT]

    def _inverses(self, span: str) -> Iterator[tuple[str, str, str]]:
        for wrong, rights in INVERSE.items():
            raw = _sloppy(span, wrong)
            if raw is None:
                continue
            for right in rights:
                if right == wrong:
                    continue
                try:
                    fixed = raw.decode(right)
                except UnicodeDecodeError:
                    continue
                if fixed != span:
                    yield fixed, wrong, right

    def _repair_span(self, before: str, span: str, after: str, disguised: bool) -> tuple[str, str, str] | None:
        """The repaired span with the encodings used, or ``None`` if no inverse mapping makes it more probable."""
        now = self.weights.mean(before[-1:] + span + after[:1])
        if now > self.plausible:
            return None
        if not _NARROW.search(span) and not _LOW.search(before + after):
            # ideographs among such: what was garbled has an improbable pair of them, not only beside a sign
            if not any(a >= "\u2e80" <= b and self.weights.mean(a + b) < self.improbable for a, b in zip(span, span[1:], strict=False)):
                return None
        whole = before + span + after
        plain = one_form(whole) if disguised else whole
        if plain != whole and (as_seen := self.weights.mean(plain)) > self.fluent and as_seen > self.weights.mean(whole) + 0.3:
            return None  # disguised, not garbled: it reads well in its one form
        found, best = None, max(now + GAIN, self.acceptable)
        before, after = before[-1:], after[:1]
        for fixed, wrong, right in self._inverses(span):
            options = [(fixed, wrong, right)]
            if right == "utf-8" and not fixed.isascii():  # read wrongly twice
                options += [(f, f"{wrong} {w}", r) for f, w, r in self._inverses(fixed) if r == "utf-8"]
            for text, w, r in options:
                if _CERTAIN.search(text) or not self._fits(before, text, after, r):
                    continue
                score = self.weights.mean(before + text + after)
                if score > best:
                    found, best = (text, w, r), score
        return found

    @staticmethod
    def _fits(before: str, text: str, after: str, right: str) -> bool:
        """Whether the restored characters belong where they stand."""
        if right in ("gb18030", "big5"):
            return sum(c >= "\u2e80" for c in text) >= 3
        if right not in SINGLE:  # a single character: a sign, or a letter like its neighbours
            return len(text) > 1 or not text.isalpha() or text < "\u0250" or any(c.isalpha() and not c.isascii() for c in before + after)
        letters = [c for c in text if c.isalpha()]
        if len(letters) < 0.7 * len(text) or not text[0].isalpha():
            return False
        if right != "cp1252":
            return len(letters) >= 3
        low = sum(c.islower() for c in letters)
        touching = [c for c in (before[-1:], after[:1]) if c.isalpha() and c.isascii()]
        return low == len(letters) and bool(touching) or len(letters) >= 4 and low >= 0.7 * len(letters)

    def runs(self, text: str, weights: np.ndarray) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
        """The spans of foreign characters inside the improbable segments, these segments and the clear ones, in characters."""
        scores = np.clip(self.improbable - weights, -1.5, 3.0)
        segments = improbable_segments(scores)
        if not segments:
            return [], [], []
        spans = np.array([m.span() for m in _SPAN.finditer(text)], np.int64).reshape(-1, 2)
        begin, end = spans[:, 0], spans[:, 1]
        # the pair before a span is at begin - 1, the one after it at end - 1
        at = np.searchsorted([b for b, _ in segments], end, "left") - 1
        inside = (at >= 0) & (np.array([e for _, e in segments])[at] >= begin)
        sums = np.concatenate([[0.0], np.cumsum(weights)])
        first, last = np.maximum(begin - 1, 0), np.minimum(end, len(weights))
        unlikely = sums[last] - sums[first] <= (self.plausible + 0.05) * (last - first)
        gains = np.concatenate([[0.0], np.cumsum(scores)])
        clear = [(b, e + 1) for b, e in segments if gains[e] - gains[b] >= CLEAR]
        found = {(int(a), int(b)) for a, b in spans[inside & unlikely]}
        # inside a span that is likely as a whole the clear segments stand for themselves
        for a, b in spans[inside & ~unlikely].tolist():
            found |= {(max(a, x), min(b, y)) for x, y in clear if min(b, y) - max(a, x) >= 2}
        return sorted(found), [(b, e + 1) for b, e in segments], clear

    def garbled(self, text: str, weights: np.ndarray, disguised: bool = True) -> list[tuple[int, int, str | None, str]]:
        """``begin, end, repaired, encodings`` of each garbled run; ``repaired`` is null where nothing fits.

        ``disguised``: the text may have another one form.
        """
        out = []
        runs, segments, clear = self.runs(text, weights)
        for x, y in runs:
            if _CERTAIN.search(text[x:y]):
                out += [(x + m.start(), x + m.end(), None, "lost") for m in _CERTAIN.finditer(text[x:y]) if m[0] == "\ufffd"]
            fixed = self._try(text, x, y, disguised)
            if fixed is None and text[y - 1 : y].isascii():  # without the letter that may have been swallowed
                y -= 1
                fixed = self._try(text, x, y, disguised)
            out += [fixed] if fixed else self._parts(text, x, y, clear, disguised)
        if not out:
            out = [(m.start(), m.end(), None, "lost") for m in _CERTAIN.finditer(text)]
        return sorted(set(out) | set(self._alike(text, out, segments)))

    def _try(self, text: str, x: int, y: int, disguised: bool) -> tuple[int, int, str | None, str] | None:
        fixed = self.repair_span(text[max(0, x - 3) : x], text[x:y], text[y : y + 3], disguised)
        return (x, y, fixed[0], f"{fixed[1]} > {fixed[2]}") if fixed else None

    def _alike(self, text: str, found: list[tuple[int, int, str | None, str]], segments: list[tuple[int, int]]) -> Iterator[tuple[int, int, str | None, str]]:
        """The text's other improbable runs that a mapping found in it restores: what was read wrongly once was so throughout.

        Only UTF-8 as the right encoding counts here, since hardly anything else is valid in it. A run is improbable if
        it has part in any segment, however short.
        """
        done = [(a, b) for a, b, new, _ in found if new is not None]
        ends = [y if x < y else 0 for x, y in segments] or [0]
        for wrong, right in {tuple(e.split(" > ")) for *_, new, e in found if new is not None}:
            if right != "utf-8":
                continue
            for m in re.finditer(r"[^\x00-\x7f\ufffd]{2,}", text):
                a, b = m.span()
                if any(x < b and a < y for x, y in done) or not ends[max(0, bisect_left(segments, (b,)) - 1)] > a:
                    continue
                fixed = m[0]
                for codec in wrong.split():
                    raw = _sloppy(fixed, codec)
                    try:
                        fixed = raw.decode("utf-8") if raw is not None else ""
                    except UnicodeDecodeError:
                        fixed = ""
                    if not fixed:
                        break
                around = text[max(0, a - 1) : a], text[b : b + 1]
                if fixed and fixed != m[0] and not _CERTAIN.search(fixed) and self.weights.mean(fixed.join(around)) > self.weights.mean(m[0].join(around)):
                    done.append((a, b))
                    yield a, b, fixed, f"{wrong} > {right}"

    def _parts(self, text: str, a: int, b: int, segments: list[tuple[int, int]], disguised: bool) -> list[tuple[int, int, str | None, str]]:
        """The pieces of a span that can be repaired by themselves: between characters that are lost or ASCII, of ideographs
        or of none, and inside the improbable segments, with and without the characters at their ends."""
        pieces = [m.span() for m in re.finditer(r"[^\x00-\x7f\ufffd]+", text[a:b])]
        pieces += [m.span() for m in _ALIKE.finditer(text[a:b])]
        for x, y in segments[max(0, bisect_left(segments, (a,)) - 1) :]:
            if x >= b:
                break
            x, y = max(a, x), min(b, y)
            if y - x >= 2:
                for m in _ALIKE.finditer(text[x:y]):
                    u, v = x + m.start() - a, x + m.end() - a
                    pieces += [(u, v), (u + 1, v), (u, v - 1), (u + 1, v - 1)]
        out, done = [], [(a, b)]
        for u, v in dict.fromkeys(pieces):
            x, y = a + u, a + v
            if y > x and (x, y) not in done and not any(p < y and x < q for p, q, *_ in out):
                done.append((x, y))
                if fixed := self._try(text, x, y, disguised):
                    out.append(fixed)
        return out


def _found(finder: Finder, texts: list[str | None]) -> Iterator[tuple[int, list[tuple[int, int, str | None, str]]]]:
    """The texts with garbled runs, by their place in the list."""
    codes, begins = _codes(texts)
    foreign = (codes[:-1] > 127) | (codes[1:] > 127)
    edges = np.append(begins, len(codes))
    doubtful = finder.doubtful(codes, foreign)
    hot = np.zeros(len(texts), bool)
    hot[np.searchsorted(begins, doubtful, "right") - 1] = True
    # certain marks and runs of UTF-8 read wrongly are tested, however probable
    begin, end, certain = _upper(codes)
    sure = np.concatenate([certain, np.array([a for a, *_ in _misread(texts, codes, begin, end)[1]], np.int64)])
    marked = np.searchsorted(begins, sure, "right") - 1
    hot[marked] = True
    marked = set(marked.tolist())
    asked = np.flatnonzero(hot).tolist()
    for i, plain in zip(asked, one_forms([texts[i] for i in asked]), strict=True):
        text = texts[i]
        disguised = plain != text
        if disguised and i not in marked:  # disguised: is anything improbable in its one form?
            seen, _ = _codes([plain])
            sign = (seen < 128) & ~_LETTER[np.minimum(seen, 127)]  # beside signs its pairs are rare by its making only
            at = finder.doubtful(seen, ((seen[:-1] > 127) | (seen[1:] > 127)) & ~sign[:-1] & ~sign[1:])
            if not (np.diff(at) <= 2).any() and not (len(at) and (at[0] == 0 or at[-1] >= len(plain) - 2)):
                continue  # what is garbled has such pairs on both its sides, or stands at an end of the text
        own_codes = codes[edges[i] : edges[i + 1]]
        own = np.where(foreign[edges[i] : edges[i + 1] - 1], finder.weights.of(own_codes), 0.0)[: max(0, len(text) - 1)]
        if runs := finder.garbled(text, own, disguised):
            yield i, runs


def _restore(text: str, runs: list[tuple[int, int, str | None, str]]) -> str:
    fixed, at = [], 0
    for a, b, new, _ in runs:
        if a >= at and new is not None:
            fixed += [text[at:a], new]
            at = b
    return "".join(fixed) + text[at:]


def repair_texts(finder: Finder, texts: list[str]) -> list[str]:
    """The texts with their recoverable runs restored."""
    out = list(texts)
    for i, runs in _found(finder, texts):
        out[i] = _restore(texts[i], runs)
    return out


def _work(finder: Finder) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
        rows = []
        for i, runs in _found(finder, texts):
            repaired = _restore(texts[i], runs)
            rows.append((keys[i], sorted({e for *_, e in runs}), repaired, not _CERTAIN.search(repaired)))
        cols = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.bool_()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "mappings", "repaired", "complete"])

    return work


def garbled_rows(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, mappings, repaired, complete``: every row with a garbled run, its text with the recoverable runs restored.

    ``complete``: nothing lost is left in it. Null keys and texts, empty and clean texts give no row; repeated rows
    count once; an empty table gives an empty result. Texts are read whole. The weights come from all texts of ``df``; of
    less than about a hundred thousand characters they tell little, and only certain marks are found for sure. Texts of
    ASCII alone are passed over: all encodings considered read ASCII alike, so no inverse mapping changes such a text.
    """
    sent = df.sparkSession.sparkContext.broadcast(corpus_weights(df, text).packed())
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & ~F.col(text).rlike(r"\A[\x00-\x7f]*\z")).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    return map_text(rows, "text", lambda: _work(Finder(Weights(*sent.value))), "key bigint, mappings array<string>, repaired string, complete boolean").dropDuplicates(["key"])
