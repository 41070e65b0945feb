"""Vectors as columns: products, lengths, means, hashed features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import has_terms, terms

#: Fixed value: buckets of the hashed embedding.
BUCKETS = 768


def dot(a: Column, b: Column) -> Column:
    """The product of two vectors; 0 if their lengths differ. It is the cosine only of vectors of length 1."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def normalized(v: Column) -> Column:
    """The vector with length 1; a zero vector stays as it is."""
    wide = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def clamp(similarity: Column) -> Column:
    return F.greatest(similarity, F.lit(0.0))


def lacks_vector(v: Column, dimensions: int) -> Column:
    """Null or of another length."""
    return v.isNull() | (F.size(v) != dimensions)


def term_bucket(term: Column) -> Column:
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint") % BUCKETS


def sparse_features(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys, buckets, weights``: the text's terms hashed into buckets, even ones counted up and odd ones down, length 1.

    The sparse form of a hashed bag-of-terms embedding, one row a text: buckets in their order, those without terms left
    out; a text without terms has no row. Everything is counted inside the row, so nothing is shuffled.
    """
    some = df.where(has_terms(text))  # a filter on the arrays themselves would be computed once more below them
    sorted_ = some.select(*keys, F.sort_array(F.transform(terms(text), lambda t: term_bucket(t).cast("int"))).alias("__b"))
    at = F.filter(F.sequence(F.lit(0), F.size("__b") - 1), lambda i: (i == 0) | (F.get("__b", i) != F.get("__b", i - 1)))
    runs = sorted_.select(*keys, "__b", at.alias("__at"))
    ends = F.concat(F.slice("__at", F.lit(2), F.size("__at")), F.array(F.size("__b")))
    counted = runs.select(*keys, F.transform("__at", lambda i: F.get("__b", i)).alias("buckets"), F.zip_with("__at", ends, lambda a, b: (b - a).cast("double")).alias("__c"))
    norm = F.sqrt(F.aggregate("__c", F.lit(0.0), lambda s, x: s + x * x))
    # the length is an element of its own, so that it is found once for the row and not for every bucket
    weights = F.transform(F.array(norm), lambda n: F.zip_with("buckets", "__c", lambda b, c: F.when(b % 2 == 0, c).otherwise(-c) / n))
    return counted.select(*keys, "buckets", F.get(weights, F.lit(0)).alias("weights"))


def hashed_features(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys, bucket, v``: the same with a row for every bucket."""
    rows = sparse_features(df, keys, text)
    return rows.select(*keys, F.explode(F.arrays_zip("buckets", "weights")).alias("__e")).select(*keys, F.col("__e.buckets").alias("bucket"), F.col("__e.weights").alias("v"))


def mean_vectors(df: DataFrame, by: str, vector: str, dimensions: int) -> DataFrame:
    """``by, vector``: the mean of each group's vectors with length 1; vectors of another length are passed over.

    Sums are kept per group and place and combined before the shuffle, whatever the size of a group.
    """
    rows = df.where(~lacks_vector(F.col(vector), dimensions)).select(by, F.posexplode(F.col(vector)).alias("__p", "__x"))
    means = rows.groupBy(by, "__p").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    lists = means.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("__p", "__m"))).alias("__l"))
    return lists.select(by, normalized(F.transform("__l", lambda s: s["__m"])).alias("vector"))
