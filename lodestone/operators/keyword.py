"""The inverted index and BM25."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.blocks import Blocks
from lodestone.operators.rowterms import keyword_rows

# The weight of the file name against the body, and BM25's constants.
NAME_WEIGHT, BODY_WEIGHT = 3, 1
K1, B = 1.2, 0.75
MOST_HITS = 2000
#: Up to so many different terms a search names them to the scan; more are joined.
MOST_TERMS = 2_000


@dataclass(frozen=True)
class Postings:
    """``terms``: ``term, chunk_id, document_id, tf, dl``; ``lengths``: ``chunk_id, document_id, dl``."""

    terms: DataFrame
    lengths: DataFrame

    def by_term(self) -> Postings:
        """The same with the terms in their order, so that a search reads only the parts that hold its terms."""
        return Postings(self.terms.repartitionByRange("term", "chunk_id").sortWithinPartitions("term"), self.lengths)

    def cached(self) -> Postings:
        ordered = self.by_term()
        return Postings(ordered.terms.cache(), ordered.lengths.cache())


def build_postings(chunks: DataFrame, documents: DataFrame) -> Postings:
    """One index entry for every chunk: its terms and, ``NAME_WEIGHT`` times, those of its file's name.

    ``chunks``: ``chunk_id, document_id, text``; ``documents``: ``id, name``. Repeated chunk ids count once, null texts
    have no terms but those of the name, a chunk without document has an empty name.
    """
    once = chunks.where(F.col("chunk_id").isNotNull()).select("chunk_id", "document_id", "text").dropDuplicates(["chunk_id"])
    names = documents.select(F.col("id").alias("document_id"), "name").dropDuplicates(["document_id"])
    return named_postings(once.join(names, "document_id", "left"))


def named_postings(named: DataFrame) -> Postings:
    """The same from chunks that have their file's ``name`` and no id twice."""
    both = named.select("chunk_id", "document_id", T.index_pieces(F.coalesce("name", F.lit(""))).alias("n"), T.index_pieces(F.coalesce("text", F.lit(""))).alias("b"))
    sized = both.withColumn("dl", F.size("n") * NAME_WEIGHT + F.size("b") * BODY_WEIGHT)
    rows = sized.select("chunk_id", "document_id", "dl", F.explode(_frequencies(F.col("n"), F.col("b"))).alias("e"))
    return Postings(rows.select("e.term", "chunk_id", "document_id", "e.tf", "dl"), sized.select("chunk_id", "document_id", "dl"))


def _frequencies(name: Column, body: Column) -> Column:
    """The pieces of an entry with their weighted numbers, counted inside its row: an index is built without a shuffle.

    Name and body hold a piece once unless a longer term was split into it; only then pieces are counted one by one.
    """

    def entries(pieces: Column, tf: int) -> Column:
        return F.transform(pieces, lambda t: F.struct(t.alias("term"), F.lit(tf).alias("tf")))

    once = F.concat(
        entries(F.array_intersect(name, body), NAME_WEIGHT + BODY_WEIGHT),
        entries(F.array_except(name, body), NAME_WEIGHT),
        entries(F.array_except(body, name), BODY_WEIGHT),
    )
    counted = F.transform(
        F.array_distinct(F.concat(name, body)),
        lambda t: F.struct(t.alias("term"), (F.size(F.filter(name, lambda x: x == t)) * NAME_WEIGHT + F.size(F.filter(body, lambda x: x == t)) * BODY_WEIGHT).alias("tf")),
    )
    repeats = (F.size(F.array_distinct(name)) < F.size(name)) | (F.size(F.array_distinct(body)) < F.size(body))
    return F.when(repeats, counted).otherwise(once)


def replace_postings(old: Postings, chunks: DataFrame, documents: DataFrame) -> Postings:
    """The index after the documents of ``chunks`` were written anew."""
    new = build_postings(chunks, documents)
    gone = delete_postings(old, documents.select(F.col("id").alias("document_id")))
    return Postings(gone.terms.unionByName(new.terms), gone.lengths.unionByName(new.lengths))


def delete_postings(old: Postings, ids: DataFrame) -> Postings:
    """The index without the documents ``document_id``."""
    return Postings(old.terms.join(ids, "document_id", "left_anti"), old.lengths.join(ids, "document_id", "left_anti"))


def needs_rebuild(postings: Postings, chunks: DataFrame) -> bool:
    """Whether the index and the table hold different numbers of chunks."""
    return postings.lengths.count() != chunks.where("chunk_id is not null").select("chunk_id").distinct().count()


def statistics(postings: Postings) -> DataFrame:
    """One row: number of chunks and their mean length."""
    return postings.lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("dl").cast("double")), F.lit(0.0)).alias("avgdl"))


def search_terms(requests: DataFrame) -> DataFrame:
    """``query_id, term`` from ``query_id, query``."""
    return requests.select("query_id", F.explode(F.array_distinct(T.index_pieces(F.col("query")))).alias("term"))


def bm25(requests: DataFrame, postings: Postings) -> DataFrame:
    """``query_id, chunk_id, document_id, score``: every chunk with a term of the query; 4 decimals.

    The asked terms are a filter of the scan, which passes over what does not hold them where postings are ordered by
    term; very many are joined instead. A chunk's parts of the score are summed before they are shuffled.
    """
    asked = search_terms(requests)
    known = [r[0] for r in asked.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(known) <= MOST_TERMS:
        wanted = postings.terms.where(F.col("term").isin(known))
    else:
        wanted = postings.terms.join(asked.select("term").distinct(), "term", "left_semi")
    frequency = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = asked.join(wanted, "term").join(frequency, "term").join(F.broadcast(statistics(postings)))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (K1 + 1) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy("query_id", "chunk_id", "document_id").agg(F.round(F.sum(part), 4).alias("score"))


def best_hits(requests: DataFrame, postings: Postings, named: DataFrame | None = None) -> DataFrame:
    """``query_id, id, owner, score, top, place``: the ``budget`` best chunks of many requests by BM25, block by block.

    ``named``: the chunks with their names, if they are at hand; their pieces are then cut from them.
    """
    spark = requests.sparkSession
    asked = requests.select("query_id", F.lit(None).cast("string").alias("ext"), "budget", F.array_distinct(T.index_pieces(F.col("query"))).alias("terms"))
    known = sorted(r[0] for r in asked.select(F.explode("terms")).distinct().collect())
    if named is not None:
        rows = keyword_rows(named, known, NAME_WEIGHT, BODY_WEIGHT)
    else:
        names = F.broadcast(spark.createDataFrame([(t,) for t in known], "term string"))
        lists = postings.terms.join(names, "term", "left_semi").groupBy("chunk_id").agg(F.collect_list(F.struct("term", "tf")).alias("entries"))
        packed = postings.lengths.join(lists, "chunk_id", "left")
        rows = packed.select(F.col("chunk_id").alias("id"), F.col("document_id").alias("owner"), F.lit(None).cast("string").alias("ext"), F.col("dl").cast("double").alias("size"), F.col("entries.term").alias("terms"), F.col("entries.tf").cast("array<double>").alias("weights"))
    index = Blocks(rows, known)
    df, n, mean = index.frequencies(), index.rows, index.size / max(index.rows, 1)
    worth = np.log(1 + (n - df + 0.5) / (df + 0.5)) * (K1 + 1)
    return index.best(asked, 4, worth=worth, weigh=lambda tf, dl: tf / (tf + K1 * (1 - B + B * dl / mean)))


def top_hits(scored: DataFrame, most: int = MOST_HITS, order: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The best ``most`` rows of each query with their ``place``; partitions send on no more than that each."""
    w = Window.partitionBy("query_id").orderBy(F.col(order).desc(), F.col(tie))
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
