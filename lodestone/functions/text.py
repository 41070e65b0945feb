"""Text as columns: white space, terms, names, snippets, failure classes, display forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.sources.extraction import FORMATS

# Unicode's white space, the CJK ranges, the failure rules and the snippet window.
WHITE = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CJK = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"
FAILURES = [
    ("encrypted", ["encrypt", "password", "加密"]),
    ("permission", ["permission denied", "access is denied", "权限"]),
    ("offline", ["no such file", "not found", "断线", "offline"]),
    ("corrupt", ["invalid", "corrupt", "无效", "解析失败"]),
    ("timeout", ["超时", "timeout"]),
]
SNIPPET, SNIPPET_LEAD = 260, 70
#: The analyser of the inverted index drops pieces of this many bytes and more.
LONGEST_PIECE = 40


def normalize_text(text: Column) -> Column:
    """Each line with its white space as single spaces, trimmed; empty lines dropped. Null stays null."""
    lines = F.split(text, "\r?\n")
    clean = F.transform(lines, lambda line: F.regexp_replace(F.regexp_replace(line, f"^{WHITE}+|{WHITE}+$", ""), f"{WHITE}+", " "))
    return F.array_join(F.filter(clean, lambda line: line != ""), "\n")


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z only, the collation of names in pages."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def extension_of(path: Column) -> Column:
    """The lower-case extension of the last path component, or the empty string."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))


def is_supported(path: Column) -> Column:
    return ascii_lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1)).isin(FORMATS)


def stable_id(path: Column) -> Column:
    """Sixteen hex digits that identify a path."""
    return F.left(F.md5(path), F.lit(16))


def terms(text: Column) -> Column:
    """The set of lexical terms: ASCII words of two characters and more, CJK characters and adjacent CJK pairs."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), F.lit(0))
    single = F.regexp_extract_all(low, F.lit(CJK), F.lit(0))
    pairs = F.regexp_extract_all(low, F.lit(f"(?=({CJK}{{2}}))"), F.lit(1))
    return F.array_distinct(F.concat(words, single, pairs))


def has_terms(text: Column) -> Column:
    return F.lower(text).rlike(f"[a-z0-9_]{{2,}}|{CJK}")


def sorted_terms(text: Column) -> Column:
    return F.array_sort(terms(text))


def lexical_text(text: Column) -> Column:
    return F.array_join(sorted_terms(text), " ")


def index_pieces(text: Column) -> Column:
    """What the inverted index stores of a text's terms: split once more at underscores, over-long pieces dropped."""
    pieces = F.flatten(F.transform(terms(text), lambda t: F.split(t, "_")))
    return F.filter(pieces, lambda p: (p != "") & (F.octet_length(p) < LONGEST_PIECE))


def asked_terms(query: Column) -> Column:
    """The terms of a query that its coverage counts: words and pairs, of two characters and more."""
    return F.filter(terms(query), lambda t: F.char_length(t) >= 2)


def coverage_of(asked: Column, text: Column) -> Column:
    """The share of ``asked`` (terms of two characters and more) that the text has; 0 if nothing is asked.

    Nothing is cut out of the text: a pair is looked for as it is, a word between the ends of words.
    """
    low = F.lower(text)
    words = F.concat(F.lit(" "), F.regexp_replace(low, "[^a-z0-9_]+", " "), F.lit(" "))
    held = F.transform(  # once for the row, not for every term
        F.array(F.struct(low.alias("low"), words.alias("words"))),
        lambda x: F.size(F.filter(asked, lambda t: F.when(F.rlike(t, F.lit("^[a-z0-9_]")), F.contains(x["words"], F.concat(F.lit(" "), t, F.lit(" ")))).otherwise(F.contains(x["low"], t)))),
    )
    return F.when(F.size(asked) > 0, F.get(held, F.lit(0)) / F.size(asked).cast("double")).otherwise(F.lit(0.0))


def coverage(query: Column, text: Column) -> Column:
    """The share of the query's terms (of two characters and more) that the text has; 0 for a query without any."""
    return coverage_of(asked_terms(query), text)


def contains(name: Column, query: Column) -> Column:
    """Whether the name has the query in it, without case; nothing in the query is a wildcard."""
    return F.instr(F.lower(name), F.lower(query)) > 0


def snippet(text: Column, query: Column) -> Column:
    """At most ``SNIPPET`` characters around the query's first occurrence, dots on the sides that are cut."""
    at = F.greatest(F.instr(F.lower(text), F.lower(query)) - 1, F.lit(0))
    n = F.char_length(text)
    start = F.least(F.greatest(at - SNIPPET_LEAD, F.lit(0)), n)
    end = F.least(start + SNIPPET, n)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < n, "...").otherwise(""))
    return F.when(n <= SNIPPET, text).otherwise(cut)


def classify_failure(reason: Column) -> Column:
    """The failure's category; the first rule that fits counts."""
    low = F.lower(reason)
    out = F.lit("parse")
    for category, signs in reversed(FAILURES):
        hit = F.lit(False)
        for sign in signs:
            hit |= F.contains(low, F.lit(sign))
        out = F.when(hit, category).otherwise(out)
    return out


def failure(path: Column, reason: Column) -> Column:
    return F.struct(path.alias("path"), classify_failure(reason).alias("category"), reason.alias("reason"))


def basename(path: Column) -> Column:
    """The last component that is not empty, for either kind of slash."""
    parts = F.filter(F.split(path, r"[\\/]"), lambda p: p != "")
    return F.coalesce(F.try_element_at(parts, F.lit(-1)), path)


def format_bytes(size: Column) -> Column:
    kb, mb = F.lit(1024), F.lit(1024 * 1024)
    return F.when(size < kb, F.concat(size.cast("string"), F.lit(" B"))).when(size < mb, F.format_string("%.1f KB", size / kb)).otherwise(F.format_string("%.1f MB", size / mb))


def format_duration(ms: Column) -> Column:
    """Milliseconds; seconds with one decimal under ten and none under sixty; else minutes and seconds.

    A half is rounded up, as the double that the seconds are has it: 1 150 ms are a little less than 1.15 s.
    """
    seconds = ms / F.lit(1000.0)
    high = seconds.cast("float").cast("double")
    short = (ms - high * 1000) - (seconds - high) * 1000  # exact: by how much the double is less than the true value
    tenths, rest = F.floor(ms / 100), ms % 100
    up = F.when((rest > 50) | ((rest == 50) & (short <= 0)), 1).otherwise(0)
    return (
        F.when(ms < 1000, F.concat(F.round(ms).cast("bigint").cast("string"), F.lit(" ms")))
        .when(ms < 10_000, F.format_string("%.1f s", (tenths + up) / F.lit(10.0)))
        .when(ms < 60_000, F.concat(F.floor((ms + 500) / 1000).cast("string"), F.lit(" s")))
        .otherwise(F.concat((ms / 60_000).cast("bigint").cast("string"), F.lit("m "), ((ms % 60_000) / 1000).cast("bigint").cast("string"), F.lit("s")))
    )


def format_date(ms: Column) -> Column:
    """The day of a time in milliseconds, of medium length."""
    return F.date_format(F.timestamp_millis(ms), "MMM d, yyyy")


def highlight(text: Column, query: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """The query's first occurrence between marks."""
    at, n = F.instr(F.lower(text), F.lower(query)), F.char_length(query)
    marked = F.concat(F.substring(text, F.lit(1), at - 1), F.lit(before), F.substring(text, at, n), F.lit(after), F.substring(text, at + n, F.char_length(text)))
    return F.when((n > 0) & (at > 0), marked).otherwise(text)
