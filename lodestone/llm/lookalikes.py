"""One consistent form of text that looks the same.

Every token gets the set of scripts in which all its characters could be spelled (the intersection of the characters'
resolved script sets, look-alikes included). One script left: the token is spelled in it, so that mixed-script tokens
lose their foreign letters. Several left (the whole token could be of another script): it takes the script of the
unambiguous tokens around it. None left: each character takes its prototype. All of this depends on what can be seen
only, so texts that look the same come out equal. The remaining forms are normalised: width, radicals, accents,
invisible characters, single spaces. Case, accents, raised or circled digits, 0 and O stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestone.llm.batches import map_text

#: Copies of one spelling that are paired with other spellings one by one.
EXPAND = 50

# Letters drawn alike, by script, from Unicode's public list of confusable characters.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮԌԚԜаеѕіјорсухһԁԛԝѵԍӏ", "ABESIJKMHOPCTYXYGQWaesijopcyxhdqwvgl", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳοανιρυϲγσ", "ABEZHIKMNOPTYXCjoavipucyo", strict=True))
ARMENIAN = dict(zip("ՍՏՕԼօսհոզցյ", "USOLouhnqgj", strict=True))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᏒᏚᎢᏙᎳᏃ", "ABCDEHJKLMPRSTVWZ", strict=True))
LATIN_VARIANTS = dict(zip("ɑɡıʏɩƖᴏᴄᴠᴡᴢ", "agiyilocvwz", strict=True))
# Radicals without a decomposition of their own, and the ideographs drawn like them.
RADICALS = dict(
    zip("⺁⺇⺋⺎⺏⺐⺒⺓⺗⺙⺛⺜⺟⺠⺡⺢⺣⺦⺨⺪⺫⺬⺭⺮⺰⺱⺲⺹⺺⺻⺼⺽⺾⻁⻂⻃⻄⻅⻆⻇⻈⻉⻊⻋⻌⻍⻎⻐⻑⻒⻓⻔⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻰", "厂几㔾兀尣尢巳幺㣺攵旡日母民氵氺灬丬犭疋罒示礻𥫗纟罓罒耂肀聿月臼艹虎衤覀西见角𧢲讠贝𧾷车辶辶辶钅長镸长门阝雨青韦页风飞食𩙿饣马骨鬼鱼鸟卤麦黄黾齐齿龙", strict=True)
)
SCRIPTS: dict[str, dict[str, str]] = {"Latin": {}, "Cyrillic": CYRILLIC, "Greek": GREEK, "Armenian": ARMENIAN, "Cherokee": CHEROKEE}

IGNORABLE = [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0, *range(0xE0000, 0xE1000)]


def _forms() -> dict[int, str | None]:
    """What each character becomes apart from its script: nothing, a space, its normal width, its ideograph."""
    out: dict[int, str | None] = dict.fromkeys(IGNORABLE)
    for code in [*range(0xA0, 0x3400), *range(0xF900, 0x10000)]:
        char = chr(code)
        if code in out:
            continue
        if unicodedata.category(char) == "Zs":
            out[code] = " "
            continue
        kind, _, rest = unicodedata.decomposition(char).partition(" ")
        radical = 0x2E80 <= code < 0x2FE0
        if kind in ("<wide>", "<narrow>") or kind == "<compat>" and radical:
            out[code] = "".join(chr(int(x, 16)) for x in rest.split())
    out |= {ord(a): b for a, b in RADICALS.items()}
    out |= {ord(a): b for a, b in LATIN_VARIANTS.items()}
    return out


FORMS = _forms()
#: Ranges of the scripts' letters.
RANGES = {
    "Cyrillic": ((0x400, 0x530), (0x1C80, 0x1C90), (0x2DE0, 0x2E00), (0xA640, 0xA6A0)),
    "Greek": ((0x370, 0x3E2), (0x3F0, 0x400), (0x1F00, 0x2000)),
    "Coptic": ((0x3E2, 0x3F0), (0x2C80, 0x2D00)),
    "Armenian": ((0x530, 0x590),),
    "Cherokee": ((0x13A0, 0x1400), (0xAB70, 0xABC0)),
    "Lisu": ((0xA4D0, 0xA500), (0x11FB0, 0x11FC0)),
    "Tifinagh": ((0x2D30, 0x2D80),),
    "Deseret": ((0x10400, 0x10450),),
    "Osage": ((0x104B0, 0x10500),),
    "Georgian": ((0x10A0, 0x1100), (0x2D00, 0x2D30)),
    "Canadian": ((0x1400, 0x1680), (0x18B0, 0x1900)),
}
_GONE = 0xFFFFFFFF
_FAR = re.compile("[\U00010000-\U0010ffff]")
KANA = ((0x3041, 0x3097), (0x30A1, 0x30FB), (0x31F0, 0x3200))
HAN = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x2FA20))


def _in(char: str, ranges: tuple[tuple[int, int], ...]) -> bool:
    return any(a <= ord(char) < b for a, b in ranges)


@lru_cache(maxsize=None)
def _script(char: str) -> str:
    return next((name for name, ranges in RANGES.items() if _in(char, ranges)), "Latin")


def _with_accents(table: dict[str, str]) -> dict[str, str]:
    """The table's letters, alone and under every accent they are composed with."""
    out = dict(table)
    for code in [*range(0xC0, 0x600), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and parts[0] in table:
            out.setdefault(chr(code), unicodedata.normalize("NFC", table[parts[0]] + parts[1:]))
    return out


def _composed(text: str) -> str:
    return text if text.isascii() or unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


class Looks:
    """Which letters of which scripts are drawn alike.

    ``public``: characters and what Unicode's public list of confusable characters (its skeletons) makes of them, as
    ``public_list`` reads it; without it only the letters named in this module are known. Of the list count single
    letters of other scripts drawn like a Latin letter of the same case, and letters of one script drawn like another of
    it (radicals, old forms); its digits, signs and groups of letters differ for a reader, and so do letters of another case.
    """

    def __init__(self, public: dict[str, str] | None = None) -> None:
        tables = {name: dict(table) for name, table in SCRIPTS.items()}
        self.han: dict[str, str] = {}  # by the kana drawn alike
        forms = dict(FORMS)
        for char, like in (public or {}).items():
            if len(like) != 1 or not like.isalpha() or unicodedata.normalize("NFKC", char) != char:
                continue  # other forms of a character are dealt with as such, mathematical ones can be told
            if _in(char, KANA) and _in(like, HAN):
                self.han[char] = like
            elif _in(char, HAN) and _in(like, HAN):
                forms.setdefault(ord(char), like)
            elif like.isascii() and _script(char) != "Latin":
                low, up = like.lower(), like.upper()
                # the list has one letter for both of I and l
                same = {"l": "I"}.get(like, up) if char.isupper() else low if char.islower() else like
                if same == like or like in "lI":
                    tables.setdefault(_script(char), {}).setdefault(char, same)
        self.forms = forms
        #: What each character becomes, by code point; ``_GONE`` for nothing.
        self.lut = np.arange(0x110000, dtype=np.uint32)
        self.lut[list(forms)] = [_GONE if f is None else ord(f) for f in forms.values()]
        self.order = list(tables)
        to_latin = {s: _with_accents(t) for s, t in tables.items()}
        self.prototype = {a: b for t in to_latin.values() for a, b in t.items()}
        self.from_latin: dict[str, dict[str, str]] = {}
        for script, table in to_latin.items():
            self.from_latin[script] = {}
            for a, b in table.items():
                self.from_latin[script].setdefault(b, a)
        self.kana = {b: a for a, b in self.han.items()}
        letters = "".join(f"{chr(a)}-{chr(b - 1)}" for r in RANGES.values() for a, b in r if a < 0x10000)
        self.foreign, self.foreign_far = re.compile(f"[{letters}]"), re.compile("[\U00010400-\U000104ff\U00011fb0-\U00011fbf]")
        # two classes: one that lies in the basic plane as a whole is compiled to a bit map, a mixed one is not
        self.formed = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(forms) if c < 0x10000) + "]+")
        self.far = re.compile("[" + "".join(re.escape(chr(c)) for c in sorted(forms) if c >= 0x10000) + "]+")
        self.word = re.compile(rf"(?:[A-Za-zÀ-ɏḀ-ỿ{letters}̀-ͯ]|[\U00010400-\U000104ff\U00011fb0-\U00011fbf])+")
        either = "".join(sorted({*self.han, *self.kana}))
        self.either = re.compile(f"[{either}]") if either else None
        self.east = re.compile(r"[\u3041-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff]+")
        self.resolve = lru_cache(maxsize=200_000)(self._resolve)
        self.shape = lru_cache(maxsize=200_000)(lambda token: "".join(self.prototype.get(c, c) for c in token))
        self.spell = lru_cache(maxsize=200_000)(lambda shape, script: shape if script == "Latin" else "".join(self.from_latin[script].get(c, c) for c in shape))

    def _resolve(self, shape: str) -> tuple[str, ...]:
        """The scripts in which the whole token can be spelled; ``shape``: its prototypes."""
        left = set(self.order)
        for c in shape:
            if unicodedata.combining(c):
                continue
            own = _script(c)
            left &= {own} | ({s for s in self.order if c in self.from_latin[s]} if own == "Latin" else set())
            if not left:
                break
        return tuple(s for s in self.order if s in left)

    def plain_form(self, text: str) -> str:
        """Width, radicals, accents, invisible characters and spaces in one form; scripts untouched."""
        if text.isascii():
            return text
        text = self.formed.sub(lambda m: m[0].translate(self.forms), unicodedata.normalize("NFC", text))
        if _FAR.search(text):
            text = self.far.sub(lambda m: m[0].translate(self.forms), text)
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)

    def plain_forms(self, texts: list[str]) -> list[str]:
        """The same for many texts at once."""
        joined = "\0".join([_composed(t) for t in texts])
        if joined.isascii():
            return list(texts)
        if joined.count("\0") != len(texts) - 1:
            return [self.plain_form(t) for t in texts]
        codes = self.lut[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return [_composed(t) for t in codes[codes != _GONE].tobytes().decode("utf-32-le", "surrogatepass").split("\0")]

    def one_form(self, text: str) -> str:
        """The form in which texts that look the same are equal. The empty text stays empty; length is unbounded."""
        return self._spelled(self.plain_form(text))

    def one_forms(self, texts: list[str]) -> list[str]:
        """The same for many texts at once."""
        return [self._spelled(t) for t in self.plain_forms(texts)] if texts else []

    def _spelled(self, text: str) -> str:
        """Each token of a plain form in its consistent script."""
        if text.isascii():
            return text
        if self.either is not None and self.either.search(text):
            text = self.east.sub(lambda m: self._eastern(m[0]), text)
        if not self.foreign.search(text) and not (_FAR.search(text) and self.foreign_far.search(text)):
            return text
        words = self.word.findall(text)
        shapes = [self.shape(w) for w in words]
        ways = [self.resolve(s) for s in shapes]
        chosen: list[str] = []
        last = next((w[0] for w in ways if len(w) == 1), "Latin")
        for w in ways:
            if len(w) == 1:
                last = w[0]
            chosen.append(w[0] if len(w) == 1 else last if last in w else w[0] if w else "Latin")
        spelled = iter([self.spell(s, c) if w else s for s, c, w in zip(shapes, chosen, ways, strict=True)])
        return unicodedata.normalize("NFC", self.word.sub(lambda _: next(spelled), text))

    def _eastern(self, run: str) -> str:
        """Characters that are kana or ideographs by their look: kana among such only, ideographs else."""
        if not self.either.search(run):
            return run
        certain = [c for c in run if c not in self.han and c not in self.kana]
        kana = bool(certain) and all(_in(c, KANA) or c == "ー" for c in certain)
        return "".join((self.kana if kana else self.han).get(c, c) for c in run)


KNOWN = Looks()


def public_list(spark: SparkSession) -> dict[str, str]:
    """Letters and their skeletons in the Unicode library that Spark brings; empty where it is not there."""
    letters = [chr(c) for a, b in ((0x80, 0xD800), (0xF900, 0xFFFE), (0x10000, 0x1F000), (0x20000, 0x2FA20)) for c in range(a, b)]
    letters = [c for c in letters if c.isalpha()]
    try:
        builder = getattr(spark.sparkContext._jvm.com.ibm.icu.text, "SpoofChecker$Builder")
        skeletons = builder().build().getSkeleton("\n".join(letters)).split("\n")
    except Exception:  # noqa: BLE001
        return {}
    if len(skeletons) != len(letters):
        return {}
    return {c: s for c, s in zip(letters, skeletons, strict=True) if c != s}


_USED: list[tuple[int, Looks]] = []


def looks_of(public: dict[str, str]) -> Looks:
    """What a task works with; made once in a process."""
    key = hash(tuple(sorted(public.items())))
    if not _USED or _USED[0][0] != key:
        _USED[:] = [(key, Looks(public))]
    return _USED[0][1]


def one_form(text: str) -> str:
    """The one form by the letters named in this module."""
    return KNOWN.one_form(text)


def one_forms(texts: list[str]) -> list[str]:
    """The same for many texts at once."""
    return KNOWN.one_forms(texts)


def normalize_column(df: DataFrame, column: str, out: str) -> DataFrame:
    """Add ``out``: ``column`` in its one form. Null stays null, empty stays empty; other columns are kept as they are,
    but for one that is named ``out``, which is replaced. Texts are handled in slices of bounded size."""
    rows = df.drop(out) if out != column else df
    schema = StructType([*[f for f in rows.schema.fields if f.name != out], StructField(out, StringType())])

    sent = df.sparkSession.sparkContext.broadcast(public_list(df.sparkSession))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(column).to_pylist()
        known = iter(looks_of(sent.value).one_forms([t for t in texts if t is not None]))
        forms = pa.array([None if t is None else next(known) for t in texts], pa.string())
        kept = [n for n in batch.schema.names if n != out]
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], forms], names=[*kept, out])

    return map_text(rows, column, lambda: work, schema)


def _keys(looks: Looks) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        digest = lambda t: xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass"))
        ids, values, forms = batch.column("key"), [digest(t) for t in texts], [digest(t) for t in looks.one_forms(texts)]
        return pa.record_batch([ids, pa.array(forms, pa.binary()), pa.array(values, pa.binary())], names=["key", "look", "value"])

    return work


def lookalike_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, look, value``: 128-bit hashes of each text's one form and of its stored form, one row per key and value.

    Null keys and texts are left out; repeated rows count once; an empty table gives none. Only hashes are shuffled.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    sent = df.sparkSession.sparkContext.broadcast(public_list(df.sparkSession))
    return map_text(rows, "text", lambda: _keys(looks_of(sent.value)), "key bigint, look binary, value binary").distinct()


def _spellings(keys: DataFrame) -> DataFrame:
    """``look, value, n, rep``: each spelling of a look that has several, its copies and the smallest key of them."""
    each = keys.groupBy("look", "value").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("rep"))
    several = each.groupBy("look").agg(F.count(F.lit(1)).alias("v")).where("v > 1").select("look")
    return each.join(several, "look", "left_semi")


def lookalike_pairs(df: DataFrame, key: str, text: str, expand: int | None = EXPAND) -> DataFrame:
    """``key_a, key_b``: pairs of rows with different stored texts that look the same; ``key_a < key_b``.

    Equal stored texts are no pair, so a group of copies is only joined with the other spellings of its look. Of more than
    ``expand`` copies of a spelling the representative (the smallest key) is paired for all; ``lookalike_groups`` has the
    others. ``None`` lists every pair, whatever their number.
    """
    keys = lookalike_keys(df, key, text)
    shown = keys.join(_spellings(keys), ["look", "value"])
    if expand is not None:
        shown = shown.where((F.col("n") <= expand) | (F.col("key") == F.col("rep")))
    a, b = shown.select("look", "value", "key").alias("a"), shown.select("look", "value", "key").alias("b")
    on = (F.col("a.look") == F.col("b.look")) & (F.col("a.value") < F.col("b.value")) & (F.col("a.key") != F.col("b.key"))
    return a.join(b, on).select(F.least("a.key", "b.key").alias("key_a"), F.greatest("a.key", "b.key").alias("key_b")).distinct()


def lookalike_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class_id, spelling_id, spellings``: every row whose text has other spellings that look the same.

    ``class_id`` and ``spelling_id``: the smallest key of those that look the same, and of those with the same text.
    """
    keys = lookalike_keys(df, key, text)
    each = _spellings(keys)
    classes = each.groupBy("look").agg(F.min("rep").alias("class_id"), F.count(F.lit(1)).alias("spellings"))
    named = each.select("look", "value", F.col("rep").alias("spelling_id")).join(classes, "look")
    return keys.join(named, ["look", "value"]).select("key", "class_id", "spelling_id", "spellings")
