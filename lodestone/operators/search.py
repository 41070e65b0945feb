"""Ranked search: keyword, semantic and hybrid, for any number of requests at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.vectors import BUCKETS, sparse_features
from lodestone.operators import keyword
from lodestone.operators import vectors as exact
from lodestone.operators.blocks import Blocks
from lodestone.operators.chunking import embedding_text, sample_chunks
from lodestone.operators.ranking import grouped_rank
from lodestone.operators.rowterms import vector_rows
from lodestone.runtime import scratch_path

# Floors, thresholds and weights of the ranking.
SEMANTIC_FLOOR, DOCUMENT_FLOOR = 0.24, 0.05
THRESHOLDS = {"keyword": 0.01, "semantic": 0.36, "hybrid": 0.06}
SEMANTIC_SHARE, LEXICAL_SHARE = 0.72, 0.28
KEYWORD_BONUS, KEYWORD_SHARE, CALIBRATED_SHARE, NAME_BOOST = 0.18, 0.62, 0.38, 0.20
LEAST_NORM = 1.1920929e-07
FEWEST, MOST, TIMES, MOST_RESULTS, DEFAULT_RESULTS = 200, 1000, 20, 100, 20
#: Up to so many requests are compared with each name in one scan; more meet the names over sequences of ``GRAM`` characters.
FEW_REQUESTS, GRAM = 32, 4
#: Up to so many requests are held by the driver, so that joins with them are broadcast; more stay a distributed table.
LOCAL = 10_000
#: More requests than so many read the index block by block (``blocks``), fewer meet it in joins.
MANY = 1_000


@dataclass(frozen=True)
class Index:
    """What searches read. ``vectors``: ``chunk_id, document_id, extension, buckets, weights``; ``document_vectors`` the
    same without ``chunk_id``; both sparse and of length 1. ``named``, of ``write_index``: chunks with ``name, extension``
    and whether they are ``sampled`` and their document is ``known``."""

    documents: DataFrame
    chunks: DataFrame
    postings: keyword.Postings
    vectors: DataFrame
    document_vectors: DataFrame | None = None
    named: DataFrame | None = None

    def cached(self) -> Index:
        documents, chunks, vectors = self.documents.cache(), self.chunks.cache(), self.vectors.cache()
        return Index(documents, chunks, self.postings.cached(), vectors, self.document_vectors)


def clean_documents(documents: DataFrame) -> DataFrame:
    """One row an id, the extension in lower case (empty for null)."""
    cols = ["id", "path", "name", "modified_ms", "size"]
    return documents.where("id is not null").select(*cols, F.lower(F.coalesce("extension", F.lit(""))).alias("extension")).dropDuplicates(["id"])


def clean_chunks(chunks: DataFrame) -> DataFrame:
    """``chunk_id, document_id, position, text``: one row an id, null texts left out."""
    return chunks.where("id is not null and text is not null").select(F.col("id").alias("chunk_id"), "document_id", "position", "text").dropDuplicates(["chunk_id"])


def sampled(chunks: DataFrame) -> DataFrame:
    """The sampled chunks of every document, by their order in it."""
    return sampled_ids(chunks).join(chunks, "chunk_id")


def sampled_ids(chunks: DataFrame) -> DataFrame:
    ranked = grouped_rank(chunks.select("chunk_id", "document_id", "position"), ["document_id"], [("position", "asc"), ("chunk_id", "asc")], "place", ties=False)
    chosen = sample_chunks(ranked.select("chunk_id", "document_id", (F.col("place") - 1).cast("int").alias("position")), "document_id")
    return chosen.select("chunk_id")


def hashed_chunk_vectors(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hashed vectors of the sampled chunks of every document."""
    named = sampled(chunks).join(documents.select(F.col("id").alias("document_id"), "name", "extension"), "document_id")
    return sparse_features(named, ["chunk_id", "document_id", "extension"], embedding_text(F.col("name"), F.col("text")))


def build_index(documents: DataFrame, chunks: DataFrame) -> Index:
    docs, parts = clean_documents(documents), clean_chunks(chunks)
    return Index(docs, parts, keyword.build_postings(parts, docs), hashed_chunk_vectors(parts, docs))


def write_index(documents: DataFrame, chunks: DataFrame) -> Index:
    """The same for many searches of it: chunks are written once with their names, in files that go with the program."""
    spark, docs, parts = documents.sparkSession, clean_documents(documents), clean_chunks(chunks)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "chunks"))
    names = docs.select(F.col("id").alias("document_id"), "name", "extension", F.lit(True).alias("known"))
    marked = parts.join(sampled_ids(parts).withColumn("sampled", F.lit(True)), "chunk_id", "left")
    marked.join(names, "document_id", "left").write.option("compression", "zstd").parquet(path.toString())
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    named = spark.read.parquet(path.toString())
    vectors = sparse_features(named.where("sampled and known"), ["chunk_id", "document_id", "extension"], embedding_text(F.col("name"), F.col("text")))
    return Index(docs, named.select("chunk_id", "document_id", "position", "text"), keyword.named_postings(named), vectors, named=named)


def clean_requests(requests: DataFrame) -> DataFrame:
    """``query_id, query, mode, ext, most, budget``; blank queries are left out, an unknown mode is hybrid."""
    mode = F.lower(F.trim("search_mode"))
    most = F.greatest(F.lit(1), F.least(F.lit(MOST_RESULTS), F.coalesce("max_results", F.lit(DEFAULT_RESULTS))))
    return requests.where(F.col("query_id").isNotNull() & (F.regexp_replace("query", f"^{T.WHITE}+", "") != "")).select(
        "query_id",
        "query",
        F.when(mode.isin("keyword", "semantic"), mode).otherwise("hybrid").alias("mode"),
        F.nullif(F.col("extension"), F.lit("")).alias("ext"),
        most.alias("most"),
        F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), most * TIMES)).alias("budget"),
        T.asked_terms(F.col("query")).alias("asked"),
    )


def _held(requests: DataFrame) -> tuple[DataFrame, set[str], bool, bool]:
    """The cleaned requests (by the driver if they are not too many), the modes they have, whether any has an extension,
    and whether there are many."""
    first = requests.limit(LOCAL + 1).toArrow()
    if first.num_rows > LOCAL:
        return requests, {"keyword", "semantic", "hybrid"}, True, True
    local = requests.sparkSession.createDataFrame(first) if first.num_rows else requests.limit(0)
    return local, set(first.column("mode").to_pylist()), first.column("ext").null_count < first.num_rows, first.num_rows > MANY


def keyword_candidates(requests: DataFrame, index: Index, filtered: bool = True) -> DataFrame:
    """``query_id, document_id, k, kw_chunk``: each document's best chunk among the best hits of the whole index.

    Scores are set against the best hit before the extension filter is applied (``filtered``: any request has one).
    """
    hits = keyword.top_hits(keyword.bm25(requests, index.postings), MOST).join(requests.select("query_id", "budget", "ext"), "query_id").where("place <= budget")
    best = F.greatest(F.max("score").over(Window.partitionBy("query_id")), F.lit(LEAST_NORM))
    normed = hits.select("query_id", "chunk_id", "document_id", "ext", "place", F.least(F.col("score") / best, F.lit(1.0)).alias("k"))
    kept = normed
    if filtered:
        kept = normed.join(index.documents.select(F.col("id").alias("document_id"), "extension"), "document_id").where("ext is null or extension = ext")
    top = F.max(F.struct("k", (-F.col("place")).alias("p"), "chunk_id")).alias("b")
    return kept.groupBy("query_id", "document_id").agg(top).select("query_id", "document_id", F.col("b.k").alias("k"), F.col("b.chunk_id").alias("kw_chunk"))


def many_keyword_candidates(requests: DataFrame, index: Index) -> DataFrame:
    """``keyword_candidates`` of many requests, whose extension is still to be compared with the documents'."""
    hits = keyword.best_hits(requests, index.postings, index.named)
    k = F.least(F.col("score") / F.greatest("top", F.lit(LEAST_NORM)), F.lit(1.0))
    top = F.max(F.struct(k.alias("k"), (-F.col("place")).alias("p"), "id")).alias("b")
    return hits.groupBy("query_id", F.col("owner").alias("document_id")).agg(top).select("query_id", "document_id", F.col("b.k").alias("k"), F.col("b.id").alias("kw_chunk"))


def many_semantic_candidates(requests: DataFrame, index: Index, query: DataFrame) -> DataFrame:
    """``query_id, document_id, sim, vec_chunk, share`` of many requests: ``share`` of their terms in name and chunk."""
    asked = query.join(requests.select("query_id", "asked"), "query_id").withColumnRenamed("buckets", "terms")
    shares = sorted(r[0] for r in asked.select(F.explode("asked")).distinct().collect())
    if index.named is not None:
        rows = vector_rows(index.named.where("sampled and known"), shares)
    else:
        names = index.documents.select(F.col("id").alias("document_id"), "name")
        texts = index.chunks.select("chunk_id", "text")
        both = index.vectors.join(names, "document_id", "left").join(texts, "chunk_id", "left")
        held = T.asked_terms(F.concat_ws(" ", "name", "text")).alias("held")
        rows = both.select(F.col("chunk_id").alias("id"), F.col("document_id").alias("owner"), F.col("extension").alias("ext"), F.lit(1.0).alias("size"), F.col("buckets").alias("terms"), "weights", held)
    hits = Blocks(rows, None, shares).best(asked, 6, SEMANTIC_FLOOR)
    top = F.max(F.struct("score", (-F.col("place")).alias("p"), "id", "share")).alias("b")
    return hits.groupBy("query_id", F.col("owner").alias("document_id")).agg(top).select("query_id", "document_id", F.col("b.score").alias("sim"), F.col("b.id").alias("vec_chunk"), F.col("b.share").alias("share"))


def semantic_candidates(requests: DataFrame, index: Index, filtered: bool = True, many: bool = False) -> DataFrame:
    """``query_id, document_id, sim, vec_chunk`` (and ``share`` of ``many``): each document's most similar chunk.

    The extension is filtered before the best are taken. Only for requests whose extension has no chunk vector at all
    the documents' own vectors are used, without a chunk.
    """
    asked = requests.where("mode <> 'keyword'")
    query = sparse_features(asked.select("query_id", "query", "ext", "budget"), ["query_id", "ext", "budget"], F.col("query"))
    if many:
        found = many_semantic_candidates(asked, index, query)
    else:
        sims = exact.sparse_top_k(query, index.vectors.withColumnRenamed("chunk_id", "id"), "document_id", BUCKETS, SEMANTIC_FLOOR)
        hits = keyword.top_hits(sims, MOST, "sim", "id").where("place <= budget")
        top = F.max(F.struct("sim", (-F.col("place")).alias("p"), "id")).alias("b")
        found = hits.groupBy("query_id", "document_id").agg(top).select("query_id", "document_id", F.col("b.sim").alias("sim"), F.col("b.id").alias("vec_chunk"))
    if index.document_vectors is None or not filtered:
        return found
    present = index.vectors.select("extension").distinct()
    without = query.where("ext is not null").join(present, F.col("ext") == F.col("extension"), "left_anti")
    own = index.document_vectors.withColumn("id", F.col("document_id"))
    sims = exact.sparse_top_k(without, own, "document_id", BUCKETS, max(DOCUMENT_FLOOR, SEMANTIC_FLOOR))
    more = keyword.top_hits(sims, MOST, "sim", "document_id").where("place <= budget")
    return found.unionByName(more.select("query_id", "document_id", "sim", F.lit(None).cast("bigint").alias("vec_chunk")), allowMissingColumns=True)


def _grams(text: Column) -> Column:
    low = F.lower(text)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length(low) - (GRAM - 1)), lambda i: F.substring(low, i, F.lit(GRAM))))


def name_matches(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """``query_id, document_id``: the stated queries against all names.

    A few requests are looked for in every name during one scan. Many are joined with the names over their rarest
    sequence of ``GRAM`` characters and then compared; requests shorter than that are looked for in every name.
    """
    rows = requests.select("query_id", "query", "ext")
    names = documents.select(F.col("id").alias("document_id"), "name", "extension")
    hit = T.contains(F.col("name"), F.col("query")) & (F.col("ext").isNull() | (F.col("extension") == F.col("ext")))
    short = F.char_length(F.lower("query")) < GRAM
    total, shorts = rows.agg(F.count(F.lit(1)), F.count_if(short)).first()
    if total <= FEW_REQUESTS:
        return names.join(F.broadcast(rows), hit).select("query_id", "document_id")
    named = names.where(F.char_length(F.lower("name")) >= GRAM).select("*", F.explode(_grams(F.col("name"))).alias("gram"))
    asked = rows.where(~short).select("*", F.explode(_grams(F.col("query"))).alias("gram"))
    sizes = named.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rare = F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")
    chosen = asked.join(sizes, "gram", "left").groupBy("query_id", "query", "ext").agg(rare)
    found = named.join(F.broadcast(chosen), "gram").where(hit).select("query_id", "document_id")
    if shorts:
        found = found.unionByName(names.join(rows.where(short), hit).select("query_id", "document_id"))
    return found


def name_coverages(requests: DataFrame, names: DataFrame, query: str = "query", name: str = "name") -> DataFrame:
    """Each row of ``names`` with each of ``requests`` that it covers a part of, and the ``share`` covered.

    Only pairs with a term in common meet: requests go to every task by their terms, a pair is kept where its first
    common term is met and counted there, so nothing is shuffled. Repeated rows on either side stay repeated.
    """
    asked = requests.withColumn("__asked", T.asked_terms(F.col(query))).drop(query).select("*", F.explode("__asked").alias("__term"))
    held = names.withColumn("__held", T.asked_terms(F.col(name))).drop(name).select("*", F.explode("__held").alias("__term"))
    met = held.join(F.broadcast(asked), "__term").withColumn("__both", F.array_intersect("__asked", "__held"))
    share = F.size("__both") / F.size("__asked").cast("double")
    return met.where(F.get("__both", F.lit(0)) == F.col("__term")).withColumn("share", share).drop("__term", "__asked", "__held", "__both")


def search(requests: DataFrame, index: Index) -> DataFrame:
    """``query_id, rank, document_id, name, path, extension, modified_ms, size, snippet, score``.

    ``requests``: ``query_id, query, search_mode, extension, max_results``. The three kinds of candidates are brought
    together by one aggregation; scores have 6 decimals before they are compared and ordered, ties go by document.
    """
    asked, modes, filtered, many = _held(clean_requests(requests))
    none = {"share": F.lit(None).cast("double"), "k": F.lit(None).cast("double"), "kw_chunk": F.lit(None).cast("bigint"), "sim": F.lit(None).cast("double"), "vec_chunk": F.lit(None).cast("bigint")}
    cols = ["query_id", "document_id", *none]
    parts = [many_keyword_candidates(asked, index) if many else keyword_candidates(asked, index, filtered)]
    if modes - {"keyword"}:
        parts += [semantic_candidates(asked, index, filtered, many), name_matches(asked.where("mode <> 'keyword'"), index.documents)]
    every = None
    for p in parts:
        p = p.select(*[c if c in p.columns else none[c].alias(c) for c in cols])
        every = p if every is None else every.unionByName(p)
    if many:
        every = every.repartition("document_id")  # for the groups and the join with the documents
    one = every.groupBy("query_id", "document_id").agg(*[F.max(c).alias(c) for c in cols[2:]])
    docs = index.documents.withColumnRenamed("id", "document_id")
    texts = index.chunks.select(F.col("chunk_id").alias("vec_chunk"), F.col("text").alias("vec_text"))
    if many:  # what is shown of a document is joined to the winners only
        narrow = asked.select("query_id", "query", "mode", "ext", "most", "asked")
        rows = one.join(docs.select("document_id", "name", "extension"), "document_id").join(narrow, "query_id").where("ext is null or extension = ext or sim is not null")
    else:
        rows = one.join(asked, "query_id").join(docs, "document_id").join(texts, "vec_chunk", "left")
    k, sim = F.coalesce("k", F.lit(0.0)), F.coalesce("sim", F.lit(0.0))
    if many:
        lexical = F.when(F.col("mode") == "keyword", F.lit(0.0)).otherwise(F.coalesce("share", T.coverage_of(F.col("asked"), F.concat_ws(" ", "name"))))
    else:
        lexical = T.coverage_of(F.col("asked"), F.concat_ws(" ", "name", F.coalesce("vec_text", "name")))
    calibrated = SEMANTIC_SHARE * sim + LEXICAL_SHARE * lexical
    boost = F.when(T.contains(F.col("name"), F.col("query")), NAME_BOOST).otherwise(0.0)
    mode = F.col("mode")
    base = F.when(mode == "keyword", k).when(mode == "semantic", calibrated + KEYWORD_BONUS * k).otherwise(KEYWORD_SHARE * k + CALIBRATED_SHARE * calibrated)
    floor = F.when(mode == "keyword", THRESHOLDS["keyword"]).when(mode == "semantic", THRESHOLDS["semantic"]).otherwise(THRESHOLDS["hybrid"])
    hybrid = F.when(sim > k, F.coalesce("vec_chunk", "kw_chunk")).otherwise(F.coalesce("kw_chunk", "vec_chunk"))
    wanted = F.when(mode == "keyword", F.col("kw_chunk")).when(mode == "semantic", F.coalesce("vec_chunk", "kw_chunk")).otherwise(hybrid)
    scored = rows.withColumn("raw", F.round(base + boost, 6)).where(F.col("raw") >= floor).withColumn("wanted", F.coalesce(wanted, F.col("kw_chunk")))
    order = Window.partitionBy("query_id").orderBy(F.col("raw").desc(), "document_id")
    cols = ["query_id", "rank", "document_id", "name", "path", "extension", "modified_ms", "size"]
    if many:
        scored = scored.select("query_id", "document_id", "raw", "wanted", "most")
    kept = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MOST_RESULTS).where("rank <= most")
    if many:
        kept = kept.join(docs, "document_id").join(asked.select("query_id", "query"), "query_id")
    kept = kept.select(*cols, "query", "raw", "wanted")
    # the chosen chunk's text, or the first of a document that has none: read for the winners only
    held = index.chunks.select(F.col("document_id").alias("owner"), "chunk_id", "position", "text")
    own = (F.col("document_id") == F.col("owner")) & (F.col("wanted").isNull() | (F.col("wanted") == F.col("chunk_id")))
    first = F.min_by("text", F.struct("position", "chunk_id")).alias("text")
    shown = kept.join(held, own, "left").groupBy(*kept.columns).agg(first)
    snippet = T.snippet(F.coalesce("text", F.lit("")), F.col("query")).alias("snippet")
    return shown.select(*cols, snippet, F.round(F.least(F.greatest("raw", F.lit(0.0)), F.lit(1.0)), 2).alias("score"))
