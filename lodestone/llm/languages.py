"""The language of documents and of the stretches inside them.

The languages are those of the labelled sentences, and ``OTHER`` for all else. Script ranges narrow the candidates of every
word: of a script with one candidate every word is its (unless an alphabet's word has a letter that the candidate's
sentences never use), of a script without any it is of another language, of a script with several it scores by character
n-grams learned from the sentences and by the documents of each language that have it. A Viterbi path over the word
scores, with a penalty for every switch, labels the spans. Garbled text is repaired and disguised text brought to its one
form first, so both count in the language they were written in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import encoding, lookalikes
from lodestone.llm.batches import map_text, sliced
from lodestone.runtime import cut

#: What no labelled sentence is in.
OTHER = "other"
#: Most labelled sentences a language that the model is fitted on.
SAMPLES = 2_000
#: What a switch costs, in nats of word scores; what one word can count; least characters of a foreign stretch.
SWITCH = 5.0
WORD_LIMIT = 4.0
STRETCH = 60
# Three-letter codes of languages, and ranges of the scripts' letters.
THREE = {"zho": "zh", "chi": "zh", "cmn": "zh", "eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "por": "pt", "rus": "ru"}
SCRIPTS = {
    "Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)),
    "Cyrillic": ((0x400, 0x52F),),
    "Han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)),
    "Kana": ((0x3041, 0x309F), (0x30A1, 0x30FA), (0x30FC, 0x30FF), (0x31F0, 0x31FF)),
    "Hangul": ((0x1100, 0x11FF), (0x3131, 0x318E), (0xAC00, 0xD7A3)),
    "Greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "Armenian": ((0x531, 0x587),),
    "Hebrew": ((0x5D0, 0x5F4), (0xFB1D, 0xFB4F)),
    "Arabic": ((0x620, 0x6D3), (0x6FA, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8C7), (0xFB50, 0xFDFB), (0xFE70, 0xFEFC)),
    "Indic": ((0x900, 0xDFF),),
    "Thai": ((0xE01, 0xEFF),),
    "Georgian": ((0x10A0, 0x10FF),),
    "Ethiopic": ((0x1200, 0x139F),),
    "Khmer": ((0x1780, 0x17D3),),
}
#: Scripts written without spaces between words: a character tells as much as two of an alphabet.
DENSE = {"Han", "Kana", "Hangul", "Thai", "Khmer"}


def _class(*scripts: str) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for name in scripts for a, b in SCRIPTS[name])


#: A run of letters of one script; Latin ones beside a digit are codes and no words.
_TOKEN = re.compile(f"(?<![0-9_{_class('Latin')}])[{_class('Latin')}]++(?![0-9_])|[{_class('Cyrillic')}]+|[{_class('Han')}]+|[{_class(*[x for x in SCRIPTS if x not in ('Latin', 'Cyrillic', 'Han')])}]+")
#: Stray letters between characters that are lost.
_LOST = re.compile(f"(?<=\ufffd)[{_class(*[x for x in SCRIPTS if x not in ('Latin', 'Han')])}]{{1,3}}|[{_class(*[x for x in SCRIPTS if x not in ('Latin', 'Cyrillic', 'Han')])}]{{1,3}}(?=\ufffd)")
_SENTENCE = re.compile(r"[^.!?。！？\n]*[.!?。！？\n]*(?:[\"”’»）)}]+)?\s*")
_KEPT = 300_000
#: Share of the documents (and least number) a word must occur in before the corpus says more about it than its
#: characters. So many words can reach it at most: a document's mean number of different words, divided by the share.
FREQUENT, FEWEST = 1 / 8_000, 12
#: What is added to a word's counts, and to the sum of all words', before they are compared.
SMOOTH, SMOOTH_ALL = 0.5, 655.0


@lru_cache(maxsize=None)
def script_of(char: str) -> str:
    code = ord(char)
    return next((name for name, ranges in SCRIPTS.items() if any(a <= code <= b for a, b in ranges)), "")


class Model:
    """Word scores from labelled sentences and, once counted, from the whole corpus."""

    ORDER = 4

    def __init__(self, sentences: list[tuple[str, str]], corpus: tuple[dict[str, np.ndarray], np.ndarray] | None = None, guess: bool = True) -> None:
        """``corpus``: the counts of frequent words by language, and those of all words; ``guess``: score words that
        neither the sentences nor the corpus have by their characters."""
        self.languages = [*sorted({lang for lang, _ in sentences}), OTHER]
        self.other = len(self.languages) - 1
        self.corpus, self.guess = corpus, guess
        tokens = {lang: Counter() for lang in self.languages}
        for lang, text in sentences:
            tokens[lang].update(_TOKEN.findall(text))
        #: The languages of each script: a language is of the script that most letters of its sentences have.
        self.scripts: dict[str, list[int]] = {}
        self.letters: dict[str, set[str]] = {}
        for i, lang in enumerate(self.languages[:-1]):
            sizes: Counter = Counter()
            for word, n in tokens[lang].items():
                sizes[script_of(word[0])] += n * len(word)
            if sizes:
                script = sizes.most_common(1)[0][0]
                self.scripts.setdefault(script, []).append(i)
                self.letters.setdefault(script, set()).update(c for word in tokens[lang] for c in word.lower())
        self.words: dict[int, Counter] = {}
        self.score_of: dict[str, dict[str, np.ndarray]] = {}
        for script, own in self.scripts.items():
            if len(own) == 1:
                continue
            grams = {i: Counter() for i in own}
            for i in own:
                self.words[i] = Counter()
                for word, n in tokens[self.languages[i]].items():
                    if self._plain(word) and script_of(word[0]) == script:
                        self.words[i][word.lower()] += n
                        for gram in self._grams(word.lower()):
                            grams[i][gram] += n
            every = set().union(*grams.values())
            sizes_ = np.array([max(1, sum(grams[i].values())) for i in own], float)
            prior = np.log(0.5 / (sizes_ + 0.5 * max(1, len(every))))
            counts = {g: np.array([grams[i][g] for i in own], float) for g in every}
            self.score_of[script] = {g: np.log((c + 0.5) / (sizes_ + 0.5 * len(every))) - prior for g, c in counts.items()}
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.languages)), np.float32)

    @staticmethod
    def _plain(word: str) -> bool:
        return len(word) > 1 and not word.isupper() or word in "aeoyàéèóôêA"

    @classmethod
    def _grams(cls, word: str) -> list[str]:
        w = f" {word} "
        return [w[i : i + n] for n in range(2, cls.ORDER + 1) for i in range(len(w) - n + 1)] + ([w] if len(w) > cls.ORDER else [])

    def score(self, word: str) -> np.ndarray:
        """Log scores of a word in all languages: 0 for the best, at least ``-WORD_LIMIT`` for the others."""
        out = np.full(len(self.languages), -WORD_LIMIT, np.float32)
        script = script_of(word[0])
        own = self.scripts.get(script, [])
        low = word.lower()
        if len(own) < 2 or not self._plain(word):
            if len(own) > 1:
                return np.zeros(len(self.languages), np.float32)
            # a letter that the sentences never use tells more than one that they do
            foreign = bool(own) and script not in DENSE and any(c not in self.letters[script] for c in low)
            n = min(len(word), 12) / (2 if script in DENSE else 4) * (2 if foreign or not own else 1)
            out *= n if len(word) > 1 else 0.25
            out[own[0] if own and not foreign else self.other] = 0
            return out
        if self.corpus is not None and (found := self.corpus[0].get(low)) is not None:
            odds = np.log((found[own] + SMOOTH) / (self.corpus[1][own] + SMOOTH_ALL))
            out[own] = np.maximum(odds - odds.max(), -WORD_LIMIT)
            return out
        seen = any(low in self.words[i] for i in own)
        if not seen and (word[0].isupper() or not self.guess):  # a name, as likely as not
            return np.zeros(len(self.languages), np.float32)
        if not seen and any(c not in self.letters[script] for c in low):
            out[self.other] = 0
            return out
        total = np.zeros(len(own))
        for gram in self._grams(low):
            known = self.score_of[script].get(gram)
            if known is not None:
                total += known
        total *= 0.6 if seen else 0.4
        out[own] = np.maximum(total - total.max(), -WORD_LIMIT)
        return out

    def countable(self, word: str) -> bool:
        """Whether documents are counted for the word: it is one of a script with several languages."""
        return len(self.scripts.get(script_of(word[0]), ())) > 1 and self._plain(word)

    def indices(self, words: list[str]) -> np.ndarray:
        """The table row of each word; it enlarges the table."""
        if len(self.known) > _KEPT:
            self.known.clear()
            self.table = self.table[:0]
        known = self.known
        new = list(set(words).difference(known))
        if new:
            known.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.stack([self.score(w) for w in new])])
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of a row of words: the sum of their scores less ``switch`` for every change."""
    return viterbi_rows(scores, np.array([0]), np.array([len(scores)]), switch)


def viterbi_rows(scores: np.ndarray, begin: np.ndarray, end: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The same for many rows side by side, row ``i`` being the words from ``begin[i]`` to ``end[i]``; other words get 0."""
    order = np.argsort(begin - end, kind="stable")  # the longest first, so that those still going on are the first ones
    begin, size = begin[order], (end - begin)[order]
    k = scores.shape[1]
    back = np.empty(scores.shape, np.int8)
    total = scores[begin].astype(float)
    stay, rows = np.arange(k), np.arange(len(begin))
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0)) + 1), "left")  # how many rows have more words than t
    for t in range(1, len(live) - 1):
        m = live[t]
        best = total[:m].argmax(1)
        moved = total[rows[:m], best] - switch
        from_best = total[:m] < moved[:, None]
        back[begin[:m] + t] = np.where(from_best, best[:, None], stay)
        total[:m] = np.where(from_best, moved[:, None], total[:m]) + scores[begin[:m] + t]
        if t % 4096 == 0:
            total[:m] -= total[:m].max(1, keepdims=True)
    path = np.zeros(len(scores), np.int64)
    path[begin + size - 1] = total.argmax(1)
    for t in range(len(live) - 2, 0, -1):
        at = begin[: live[t]] + t
        path[at - 1] = back[at, path[at]]
    return path


def _constant(scores: np.ndarray, edges: np.ndarray, main: np.ndarray, switch: float) -> np.ndarray:
    """Whether the best path of a document stays in its main language: no stretch in another one gains a switch."""
    doc = np.repeat(np.arange(len(main)), np.diff(edges))
    own = scores[np.arange(len(scores)), main[doc]].astype(float)
    out = np.ones(len(main), bool)
    starts = edges[:-1][np.diff(edges) > 0]
    some = np.flatnonzero(np.diff(edges) > 0)
    for lang in range(scores.shape[1]):
        gain = scores[:, lang] - own
        gain[starts] -= 1e5
        total = np.cumsum(gain)
        low = np.minimum.accumulate(np.concatenate([[0.0], total[:-1]]))
        # at a document's first word the sum drops below all before it, so that no stretch reaches back
        low[starts] = total[starts] - (gain[starts] + 1e5)
        low = np.minimum.accumulate(low)
        best = np.maximum.reduceat(total - low, starts)
        out[some] &= best < switch
    return out


class Spans:
    """Labels documents with a model."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def label(self, texts: list[str]) -> list[tuple[int, float, list[tuple[int, int, int, float]]]]:
        """For each text its main language, the confidence, and its stretches (begin, end, language, confidence).

        -1 and no stretch for a text without a word.
        """
        edge, scores, totals, main = self.scored(texts)
        same = _constant(scores, edge, main, SWITCH) if len(scores) else np.ones(len(texts), bool)
        mixed = np.flatnonzero(~same & (edge[1:] > edge[:-1]))
        path = viterbi_rows(scores, edge[mixed], edge[mixed + 1]) if len(mixed) else np.zeros(0, np.int64)
        out = []
        for i, text in enumerate(texts):
            a, b = int(edge[i]), int(edge[i + 1])
            if a == b:
                out.append((-1, 0.0, []))
            elif same[i]:
                sure = _confidence(totals[i], b - a, int(main[i]))
                out.append((int(main[i]), sure, [(0, len(text), int(main[i]), sure)]))
            else:
                out.append(self._mixed(path[a:b], scores[a:b], *_sentences(text)))
        return out

    def scored(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each text's words begin and end, their scores, and each text's summed scores and best language."""
        split = [_TOKEN.findall(t) for t in texts]
        edge = np.cumsum([0, *map(len, split)])
        self.at = self.model.indices(list(chain.from_iterable(split)))
        scores = self.model.table[self.at]
        totals = np.zeros((len(texts), len(self.model.languages)))
        some = np.flatnonzero(edge[1:] > edge[:-1])
        if len(some):
            totals[some] = np.add.reduceat(scores, edge[some], axis=0, dtype=float)
        return edge, scores, totals, totals.argmax(1)

    def _mixed(self, path: np.ndarray, scores: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[int, float, list[tuple[int, int, int, float]]]:
        begins = np.concatenate([[0], ends[:-1]])
        sums = np.concatenate([np.zeros((1, scores.shape[1])), np.cumsum(scores, axis=0, dtype=float)])
        told = -scores.min(1)  # words that tell nothing have no say
        votes = np.stack([np.concatenate([[0.0], np.cumsum(np.where(path == k, told + 1e-3, 0))]) for k in range(scores.shape[1])], axis=1)
        label = (votes[ends] - votes[begins]).argmax(1)
        weight = np.array([min(1.0, (b - a) / 20) for a, b in spans])
        count = np.bincount(label, weight, minlength=scores.shape[1])
        main = int(count.argmax())
        out, i = [], 0
        while i < len(label):
            j = i
            while j + 1 < len(label) and label[j + 1] == label[i]:
                j += 1
            evidence = sums[ends[j]] - sums[begins[i]]
            out.append((spans[i][0], spans[j][1], int(label[i]), _confidence(evidence, int(ends[j] - begins[i]), int(label[i]))))
            i = j + 1
        every = np.add.reduce(scores, axis=0, dtype=float)
        return main, _confidence(every, len(scores), main), out


def _sentences(text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The number of words up to the end of each sentence that has any, and where the sentence begins and ends."""
    ends, spans, n = [], [], 0
    for m in _SENTENCE.finditer(text):
        own = len(_TOKEN.findall(m[0]))
        if own:
            n += own
            ends.append(n)
            spans.append(m.span())
    return np.array(ends), spans


def _confidence(totals: np.ndarray, words: int, chosen: int) -> float:
    """The share of the chosen language, from evidence that counts as the root of the number of words."""
    z = totals / math.sqrt(max(1, words))
    z = np.exp(z - z.max())
    return round(float(z[chosen] / z.sum()), 4)


def normal_label(lang: Column) -> Column:
    """A two-letter code; null for a missing label (null, blank, und, unknown)."""
    first = F.split(F.lower(F.trim(lang)), "[-_]")[0]
    code = first
    for three, two in THREE.items():
        code = F.when(first == three, two).otherwise(code)
    return F.when(lang.isNull() | first.isin("", "und", "unknown"), F.lit(None).cast("string")).otherwise(code)


def fit(samples: DataFrame) -> list[tuple[str, str]]:
    """At most ``SAMPLES`` labelled sentences of each language, for the model."""
    rows = samples.where(F.col("text").isNotNull() & (F.trim("lang") != "")).select("lang", "text").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text"))
    return sorted((r["lang"], r["text"]) for r in rows.withColumn("n", place).where(F.col("n") <= SAMPLES).collect())


def _repairer(pairs: tuple) -> Callable[[list[str]], list[str]]:
    finder = encoding.Finder(encoding.Weights(*pairs))

    def clean(texts: list[str]) -> list[str]:
        out = encoding.repair_texts(finder, texts)
        return [_LOST.sub(lambda m: "\ufffd" * len(m[0]), f) if "\ufffd" in f else f for f in lookalikes.one_forms(out)]

    return clean


def corpus_words(rows: DataFrame, sentences: list[tuple[str, str]]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """In how many documents of each language the frequent words occur, and the sum of this over all words.

    The language of a whole document is sure from the sentences' model alone. Words are counted over the whole corpus by
    themselves; those of too few documents are left out before anything comes to the driver.
    """
    names = sorted({lang for lang, _ in sentences})
    fields = ["documents", *[f"n{i}" for i in range(len(names))]]

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_ = Spans(Model(sentences, guess=False))
        model, k, documents, counted = spans_.model, len(names), 0, np.zeros((0, len(names)), np.int64)

        def handed() -> pa.RecordBatch:
            held: dict[str, np.ndarray] = {}
            for word, i in model.known.items():
                if i < len(counted) and counted[i].any() and model.countable(word):
                    low = word.lower()
                    held[low] = held[low] + counted[i] if low in held else counted[i]
            every = np.zeros((len(held) + 1, k + 1), np.int64)
            every[-1, 0] = documents
            for i, row in enumerate(held.values()):
                every[i, 1:] = row
            return pa.record_batch([pa.array([*held, None], pa.string()), *[pa.array(every[:, i].copy(), pa.int64()) for i in range(k + 1)]], names=["word", *fields])

        for batch in sliced(batches, "text"):
            if len(model.known) > _KEPT:  # the model is about to forget its words
                yield handed()
                documents, counted = 0, counted[:0]
            texts = batch.column("text").to_pylist()
            documents += len(texts)
            edge, _, _, main = spans_.scored(texts)
            doc = np.repeat(np.arange(len(main)), np.diff(edge))
            at = np.unique(spans_.at * np.int64(len(texts)) + doc)  # a word once for each document
            word, doc = at // len(texts), at % len(texts)
            lang = main[doc]
            sums = np.bincount(word[lang < k] * k + lang[lang < k], minlength=len(model.table) * k).reshape(-1, k)
            sums[: len(counted)] += counted
            counted = sums
        if documents:
            yield handed()

    types = ", ".join(f"{f} bigint" for f in fields)
    counts = rows.select("text").mapInArrow(count, f"word string, {types}").groupBy("word").agg(*[F.sum(f).alias(f) for f in fields])
    counts = cut(counts)
    sums = counts.agg(*[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in fields]).first()
    least = max(FEWEST, sums["documents"] * FREQUENT)
    frequent = counts.where(F.col("word").isNotNull() & (sum((F.col(f) for f in fields[2:]), F.col(fields[1])) >= least)).toArrow() if names else None
    if frequent is None or not frequent.num_rows:
        return {}, np.array([*sums[1:], 0], float)
    table = np.stack([frequent.column(f).to_numpy() for f in fields[1:]], axis=1).astype(float)
    return dict(zip(frequent.column("word").to_pylist(), table, strict=True)), np.array([*sums[1:], 0], float)


SCHEMA = "doc_id bigint, lang string, confidence double, begin int, end int, span_lang string, span_confidence double"


def spans(docs: DataFrame, samples: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang, confidence, begin, end, span_lang, span_confidence``: each stretch of each document.

    ``begin`` and ``end`` count characters of the repaired text in its one form. Null keys, null and blank texts and
    texts without a word give no row; repeated rows are labelled alike and count once; an empty table gives an empty
    result. Texts are read whole, in bounded batches; nothing is shuffled but the corpus statistics.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    fitted = fit(samples)
    sent = context.broadcast((fitted, corpus_words(rows, fitted), encoding.corpus_weights(rows).packed()))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        sentences, words, pairs = sent.value
        labeller, clean = Spans(Model(sentences, words)), _repairer(pairs)
        names = labeller.model.languages

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols: list[list] = [[] for _ in range(7)]
            for k, (main, sure, parts) in zip(batch.column("key").to_pylist(), labeller.label(clean(batch.column("text").to_pylist())), strict=True):
                for a, b, lang, own in parts:
                    for col, value in zip(cols, (k, names[main], sure, a, b, names[lang], own), strict=True):
                        col.append(value)
            types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return work

    return map_text(rows, "text", make, SCHEMA)


def findings(docs: DataFrame, samples: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """``doc_id, kind, lang``: documents with a missing or wrong label (with the right one) and mixed ones.

    A document is mixed if a stretch of at least ``STRETCH`` characters is in another language than its main one; it
    then has one row for each of its languages. A document in ``OTHER`` has a wrong label only if it is missing or names
    a language of the samples.
    """
    named = [r[0] for r in samples.select("lang").distinct().collect()]
    labels = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), normal_label(F.col(lang)).alias("told")).distinct()
    found = spans(docs, samples, key, text)
    foreign = (F.col("span_lang") != F.col("lang")) & (F.col("end") - F.col("begin") >= STRETCH)
    each = found.groupBy("doc_id", "lang").agg(F.collect_set(F.when(foreign, F.col("span_lang"))).alias("others"))
    right = F.coalesce((F.col("told") == F.col("lang")) | ((F.col("lang") == OTHER) & ~F.col("told").isin(named)), F.lit(False))
    kinds = F.concat(
        F.when(right, F.array().cast("array<struct<kind:string,lang:string>>")).otherwise(F.array(F.struct(F.lit("label").alias("kind"), "lang"))),
        F.when(F.size("others") > 0, F.transform(F.array_union(F.array("lang"), "others"), lambda x: F.struct(F.lit("mixed").alias("kind"), x.alias("lang")))).otherwise(
            F.array().cast("array<struct<kind:string,lang:string>>")
        ),
    )
    return each.join(labels, "doc_id").select("doc_id", F.explode(kinds).alias("k")).select("doc_id", "k.kind", "k.lang").distinct()
