"""Queries over the document tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import catalog, chunking, embedding, keyword, search, sync
from lodestone.operators import vectors as exact
from lodestone.runtime import table
from lodestone.streaming import changes

QUERY = "Wartungsbuch 维护日志 spare_parts order"

# -- pieces of SQL ---------------------------------------------------------------------------------------------------

WS = r"[\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CJK = r"[\x{3400}-\x{9fff}\x{f900}-\x{faff}]"


def sql_terms(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '{CJK}+')"
    return (
        f"list_distinct(list_concat(list_concat(regexp_extract_all(lower({x}), '[a-z0-9_]{{2,}}'), regexp_extract_all(lower({x}), '{CJK}')), "
        f"flatten(list_transform({runs}, lambda r: list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))"
    )


def sql_pieces(x: str) -> str:
    return f"list_filter(flatten(list_transform({sql_terms(x)}, lambda t: string_split(t, '_'))), lambda p: p <> '' AND strlen(p) < 40)"


def sql_coverage(q: str, t: str) -> str:
    asked = f"list_filter({sql_terms(q)}, lambda t: length(t) >= 2)"
    held = f"list_filter({sql_terms(t)}, lambda t: length(t) >= 2)"
    return f"CASE WHEN len({asked}) > 0 THEN len(list_intersect({asked}, {held}))::DOUBLE / len({asked}) ELSE 0.0 END"


def sql_snippet(t: str, q: str) -> str:
    start = f"least(greatest(greatest(instr(lower({t}), lower({q})) - 1, 0) - 70, 0), length({t}))"
    return (
        f"CASE WHEN length({t}) <= 260 THEN {t} ELSE (CASE WHEN {start} > 0 THEN '...' ELSE '' END) || substr({t}, {start} + 1, 260) || "
        f"(CASE WHEN {start} + 260 < length({t}) THEN '...' ELSE '' END) END"
    )


def sql_ascii_lower(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


SQL_DOCS = "d AS (SELECT id, any_value(path) AS path, any_value(name) AS name, any_value(modified_ms) AS modified_ms, any_value(size) AS size, any_value(lower(coalesce(extension, ''))) AS extension FROM documents WHERE id IS NOT NULL GROUP BY id)"
SQL_CHUNKS = "c AS (SELECT id AS chunk_id, any_value(document_id) AS document_id, any_value(position) AS position, any_value(text) AS text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id)"
SQL_POSTINGS = f"""
{SQL_DOCS}, {SQL_CHUNKS},
pieces AS (SELECT chunk_id, document_id, {sql_pieces("coalesce(d.name, '')")} AS n, {sql_pieces("coalesce(c.text, '')")} AS b FROM c LEFT JOIN d ON c.document_id = d.id),
lengths AS (SELECT chunk_id, document_id, len(n) * 3 + len(b) AS dl FROM pieces),
raw AS (SELECT chunk_id, unnest(n) AS term, 3 AS w FROM pieces UNION ALL SELECT chunk_id, unnest(b), 1 FROM pieces),
postings AS (SELECT term, chunk_id, sum(w)::INTEGER AS tf FROM raw GROUP BY term, chunk_id),
stat AS (SELECT count(*) AS n, avg(dl::DOUBLE) AS avgdl FROM lengths)"""


def sql_bm25(requests: str) -> str:
    return f"""
asked AS (SELECT DISTINCT query_id, unnest({sql_pieces("query")}) AS term FROM {requests}),
freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
scored AS (
  SELECT a.query_id, p.chunk_id, l.document_id,
         round(sum(ln(1 + (s.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE)) * 2.2::DOUBLE * p.tf / (p.tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.dl / s.avgdl))), 4) AS score
  FROM asked a JOIN postings p USING (term) JOIN freq f USING (term) JOIN lengths l ON l.chunk_id = p.chunk_id CROSS JOIN stat s
  GROUP BY a.query_id, p.chunk_id, l.document_id)"""


SQL_SAMPLED = """
placed AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY position, chunk_id) - 1 AS place, count(*) OVER (PARTITION BY document_id) AS cnt FROM c),
sampled AS (
  SELECT chunk_id, document_id, position, text, place, cnt FROM placed
  WHERE list_contains(list_transform(range(0, least(cnt, 4)), lambda i: floor(i * (cnt - 1) / greatest(least(cnt, 4) - 1, 1)::DOUBLE)::BIGINT), place))"""
SQL_EMBED_TEXT = "CASE WHEN length(text) <= 480 THEN name || chr(10) || text ELSE name || chr(10) || left(text, 240) || chr(10) || right(text, 240) END"


def sql_hashed(source: str, keys: str, text: str, out: str) -> str:
    bucket = "(('0x' || substr(md5(t), 1, 8))::BIGINT) % 768"
    return f"""
{out}_terms AS (SELECT {keys}, unnest({sql_terms(text)}) AS t FROM {source}),
{out}_counts AS (SELECT {keys}, ({bucket})::INTEGER AS bucket, count(*)::DOUBLE AS n FROM {out}_terms GROUP BY ALL),
{out} AS (SELECT {keys}, bucket, (CASE WHEN bucket % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE * n / sqrt(sum(n * n) OVER (PARTITION BY {keys})) AS v FROM {out}_counts)"""


def sql_search(requests: str) -> str:
    """The whole ranking for a relation of requests."""
    most = "greatest(1, least(100, coalesce(max_results, 20)))"
    mode = "CASE WHEN lower(trim(search_mode)) IN ('keyword', 'semantic') THEN lower(trim(search_mode)) ELSE 'hybrid' END"
    lex = sql_coverage("query", "concat_ws(' ', name, coalesce(vec_text, name))")
    named = "instr(lower(name), lower(query)) > 0"
    return f"""
WITH req AS (
  SELECT query_id, query, {mode} AS mode, nullif(extension, '') AS ext, {most} AS most, greatest(200, least(1000, {most} * 20)) AS budget
  FROM {requests} WHERE query_id IS NOT NULL AND regexp_replace(query, '^{WS}+', '') <> ''),
{SQL_POSTINGS}, {sql_bm25("req")},
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM scored),
kept AS (SELECT h.*, r.ext FROM hits h JOIN req r USING (query_id) WHERE place <= budget),
normed AS (SELECT query_id, chunk_id, document_id, ext, place, least(score / greatest(max(score) OVER (PARTITION BY query_id), 1.1920929e-07), 1.0) AS k FROM kept),
kw AS (SELECT query_id, n.document_id, k, text AS kw_text, row_number() OVER (PARTITION BY query_id, n.document_id ORDER BY k DESC, place) AS rn
       FROM normed n JOIN c USING (chunk_id) JOIN d ON d.id = c.document_id WHERE ext IS NULL OR d.extension = ext),
{SQL_SAMPLED},
named AS (SELECT s.chunk_id, s.document_id, d.extension, {SQL_EMBED_TEXT} AS etext FROM sampled s JOIN d ON d.id = s.document_id),
{sql_hashed("named", "chunk_id, document_id, extension", "etext", "vec")},
{sql_hashed("(SELECT * FROM req WHERE mode <> 'keyword')", "query_id, ext, budget", "query", "qvec")},
sims AS (SELECT q.query_id, q.budget, v.chunk_id, v.document_id, round(greatest(sum(q.v * v.v), 0), 6) AS sim
         FROM qvec q JOIN vec v USING (bucket) WHERE q.ext IS NULL OR v.extension = q.ext GROUP BY ALL),
vhits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS place FROM sims),
vec_doc AS (SELECT query_id, v.document_id, sim, text AS vec_text, row_number() OVER (PARTITION BY query_id, v.document_id ORDER BY sim DESC, place) AS rn
            FROM vhits v JOIN c USING (chunk_id) WHERE place <= budget AND sim >= 0.24),
fname AS (SELECT query_id, d.id AS document_id FROM req JOIN d ON instr(lower(d.name), lower(query)) > 0 AND (ext IS NULL OR d.extension = ext) WHERE mode <> 'keyword'),
every AS (
  SELECT query_id, document_id, k, kw_text, NULL::DOUBLE AS sim, NULL AS vec_text FROM kw WHERE rn = 1
  UNION ALL SELECT query_id, document_id, NULL, NULL, sim, vec_text FROM vec_doc WHERE rn = 1
  UNION ALL SELECT query_id, document_id, NULL, NULL, NULL, NULL FROM fname),
one AS (SELECT query_id, document_id, max(k) AS k0, max(kw_text) AS kw_text, max(sim) AS sim0, max(vec_text) AS vec_text FROM every GROUP BY ALL),
parts AS (SELECT one.*, r.query, r.mode, r.most, d.name, d.path, d.extension, d.modified_ms, d.size, coalesce(k0, 0.0) AS k, coalesce(sim0, 0.0) AS sim,
          {lex} AS lex, CASE WHEN {named} THEN 0.20 ELSE 0.0 END::DOUBLE AS boost
          FROM one JOIN req r USING (query_id) JOIN d ON d.id = one.document_id),
raws AS (SELECT *, round(CASE mode WHEN 'keyword' THEN k WHEN 'semantic' THEN 0.72::DOUBLE * sim + 0.28::DOUBLE * lex + 0.18::DOUBLE * k
         ELSE 0.62::DOUBLE * k + 0.38::DOUBLE * (0.72::DOUBLE * sim + 0.28::DOUBLE * lex) END + boost, 6) AS raw FROM parts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, document_id) AS rank FROM raws
           WHERE raw >= CASE mode WHEN 'keyword' THEN 0.01 WHEN 'semantic' THEN 0.36 ELSE 0.06 END::DOUBLE),
firsts AS (SELECT document_id, arg_min(text, (position, chunk_id)) AS first_text FROM c GROUP BY document_id),
shown AS (SELECT ranked.*, coalesce(CASE mode WHEN 'keyword' THEN kw_text WHEN 'semantic' THEN coalesce(vec_text, kw_text)
          ELSE CASE WHEN sim > k THEN coalesce(vec_text, kw_text) ELSE coalesce(kw_text, vec_text) END END, kw_text, first_text, '') AS final
          FROM ranked LEFT JOIN firsts USING (document_id) WHERE rank <= most)
SELECT query_id, rank::INTEGER AS rank, document_id, name, path, extension, modified_ms, size, {sql_snippet("final", "query")} AS snippet, round(least(greatest(raw, 0.0), 1.0), 2) AS score FROM shown
"""


# -- queries ---------------------------------------------------------------------------------------------------------

Q: dict = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):  # noqa: ANN202
    def add(make):  # noqa: ANN001, ANN202
        Q[name] = make
        if sql is not None:
            SQL[name] = sql
        return make

    return add


@_register(
    "q_normalize",
    rf"""SELECT doc_id, md5(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\r?\n'),
    lambda l: regexp_replace(regexp_replace(l, '^{WS}+|{WS}+$', '', 'g'), '{WS}+', ' ', 'g')), lambda l: l <> ''), chr(10))) AS digest FROM documents WHERE text IS NOT NULL""",
)
def q_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(T.normalize_text(F.col("text"))).alias("digest"))


@_register(
    "q_chunk",
    """SELECT doc_id, i::INTEGER AS position, length(substr(text, i * 700 + 1, 800)) AS n, md5(substr(text, i * 700 + 1, 800)) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, 1 + ceil(greatest(length(text) - 800, 0) / 700.0)::BIGINT)) AS i FROM documents WHERE text IS NOT NULL)""",
)
def q_chunk(spark: SparkSession, sf: str) -> DataFrame:
    parts = chunking.chunk(table(spark, sf, "documents"), "doc_id", "text")
    return parts.select("doc_id", "position", F.char_length("text").cast("bigint").alias("n"), F.md5("text").alias("digest"))


@_register("q_sampled_chunks", f"WITH {SQL_DOCS}, {SQL_CHUNKS}, {SQL_SAMPLED} SELECT s.chunk_id, s.document_id, md5({SQL_EMBED_TEXT}) AS digest FROM sampled s JOIN d ON d.id = s.document_id")
def q_sampled_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs, parts = search.clean_documents(table(spark, sf, "documents")), search.clean_chunks(table(spark, sf, "chunks"))
    named = search.sampled(parts).join(docs.select(F.col("id").alias("document_id"), "name"), "document_id")
    return named.select("chunk_id", "document_id", F.md5(chunking.embedding_text(F.col("name"), F.col("text"))).alias("digest"))


@_register("q_terms", f"SELECT doc_id, len(x)::INTEGER AS n, md5(array_to_string(list_sort(x), ' ')) AS digest FROM (SELECT doc_id, {sql_terms('text')} AS x FROM documents WHERE text IS NOT NULL)")
def q_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", T.sorted_terms(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", " ")).alias("digest"))


@_register(
    "q_postings_stats",
    f"WITH {SQL_POSTINGS} SELECT (SELECT n FROM stat) AS chunks, round((SELECT avgdl FROM stat), 6) AS avgdl, count(*) AS postings, count(DISTINCT term) AS terms, sum(tf)::BIGINT AS total FROM postings",
)
def q_postings_stats(spark: SparkSession, sf: str) -> DataFrame:
    p = keyword.build_postings(search.clean_chunks(table(spark, sf, "chunks")), search.clean_documents(table(spark, sf, "documents")))
    sums = p.terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf")).agg(F.sum("n").alias("postings"), F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("total"))
    return keyword.statistics(p).select(F.col("n").alias("chunks"), F.round("avgdl", 6).alias("avgdl")).join(F.broadcast(sums))


def _one(spark: SparkSession, query: str, mode: str, ext: str | None = None, limit: int = 20) -> DataFrame:
    return spark.range(1).select(F.lit(0).cast("bigint").alias("query_id"), F.lit(query).alias("query"), F.lit(mode).alias("search_mode"), F.lit(ext).cast("string").alias("extension"), F.lit(limit).alias("max_results"))


def _sql_one(query: str, mode: str, ext: str | None = None, limit: int = 20) -> str:
    e = "NULL" if ext is None else f"'{ext}'"
    return f"(SELECT 0::BIGINT AS query_id, '{query}' AS query, '{mode}' AS search_mode, {e} AS extension, {limit} AS max_results)"


def _index(spark: SparkSession, sf: str) -> search.Index:
    return search.build_index(table(spark, sf, "documents"), table(spark, sf, "chunks"))


@_register("q_bm25_topn", f"WITH {SQL_POSTINGS}, {sql_bm25(_sql_one(QUERY, 'keyword'))} SELECT chunk_id, document_id, score, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM scored) WHERE place <= 400")
def q_bm25_topn(spark: SparkSession, sf: str) -> DataFrame:
    p = keyword.build_postings(search.clean_chunks(table(spark, sf, "chunks")), search.clean_documents(table(spark, sf, "documents")))
    return keyword.top_hits(keyword.bm25(_one(spark, QUERY, "keyword"), p), 400).select("chunk_id", "document_id", "score", "place")


SEARCHES = {
    "q_search_keyword": (QUERY, "keyword", None, 20),
    "q_search_keyword_ext": ("设备巡检 验收报告", "keyword", "pdf", 20),
    "q_search_semantic": ("the customer complaint near loading bay four", "semantic", None, 50),
    "q_search_hybrid": ("Budget", "hybrid", None, 20),
    "q_search_hybrid_ext": ("培训计划", "hybrid", "docx", 100),
}


def _search(args: tuple):  # noqa: ANN202
    return lambda spark, sf: search.search(_one(spark, *args), _index(spark, sf))


for _name, _args in SEARCHES.items():
    _register(_name, sql_search(_sql_one(*_args)))(_search(_args))


@_register("q_search_batch", sql_search("search_requests"))
def q_search_batch(spark: SparkSession, sf: str) -> DataFrame:
    requests = table(spark, sf, "search_requests")
    few = requests.limit(search.MANY + 1).count() <= search.MANY
    index = _index(spark, sf) if few else search.write_index(table(spark, sf, "documents"), table(spark, sf, "chunks"))
    return search.search(requests, index)


@_register("q_hashed_embed", "WITH " + sql_hashed("(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)", "doc_id", "text", "vec") + " SELECT doc_id, bucket, round(v, 6) AS v FROM vec")
def q_hashed_embed(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("text is not null")
    return V.hashed_features(rows, ["doc_id"], F.col("text")).select("doc_id", "bucket", F.round("v", 6).alias("v"))


_DOT = "round(greatest(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 0), 6)"
_TOPK = f"""SELECT query_id, id, sim, place::INTEGER AS place FROM (
  SELECT q.vec_id AS query_id, r.vec_id AS id, {_DOT} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT} DESC, r.vec_id) AS place
  FROM embeddings q CROSS JOIN embeddings r WHERE q.vec_id % 20 = 0)"""


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "embeddings")
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@_register("q_vec_topk", _TOPK + " WHERE place <= 10")
def q_vec_topk(spark: SparkSession, sf: str) -> DataFrame:
    queries, rows = _vectors(spark, sf)
    return exact.top_k(queries, rows, 10).select("query_id", "id", "sim", F.col("place"))


@_register("q_vec_topk_floor", _TOPK + " WHERE place <= 200 AND sim >= 0.24")
def q_vec_topk_floor(spark: SparkSession, sf: str) -> DataFrame:
    queries, rows = _vectors(spark, sf)
    return exact.top_k(queries, rows, 200).where("sim >= 0.24D").select("query_id", "id", "sim", "place")


@_register(
    "q_mean_vector",
    """WITH m AS (SELECT label, i, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM embeddings WHERE len(embedding) = 64) GROUP BY ALL)
    SELECT label, i::INTEGER AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS value FROM m""",
)
def q_mean_vector(spark: SparkSession, sf: str) -> DataFrame:
    means = V.mean_vectors(table(spark, sf, "embeddings"), "label", "embedding", 64)
    return means.select("label", F.posexplode("vector").alias("place", "value")).select("label", "place", F.round("value", 6).alias("value"))


@_register("q_mean_document_vector", """WITH one AS (SELECT chunk_id, any_value(document_id) AS document_id, any_value(embedding) AS embedding FROM chunk_embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY chunk_id),
    m AS (SELECT document_id, i, avg(x::DOUBLE) AS x FROM (SELECT document_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS i FROM one) GROUP BY ALL)
    SELECT document_id, round(sum(x), 5) AS total, count(*) AS n FROM (SELECT document_id, x / nullif(sqrt(sum(x * x) OVER (PARTITION BY document_id)), 0) AS x FROM m) WHERE x IS NOT NULL GROUP BY document_id""")
def q_mean_document_vector(spark: SparkSession, sf: str) -> DataFrame:
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table(spark, sf, "chunk_embeddings").where(finite).dropDuplicates(["chunk_id"])
    means = V.mean_vectors(rows, "document_id", "embedding", 64)
    sums = means.select("document_id", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x).alias("total"), F.size("vector").cast("bigint").alias("n"), F.exists("vector", lambda x: x != 0).alias("some"))
    return sums.where("some").select("document_id", F.round("total", 5).alias("total"), "n")


@_register("q_lexical_relevance", f"SELECT r.query_id, d.doc_id, round({sql_coverage('r.query', 'd.name')}, 6) AS share FROM (SELECT * FROM search_requests WHERE query_id % 20 = 0) r CROSS JOIN documents d WHERE {sql_coverage('r.query', 'd.name')} > 0")
def q_lexical_relevance(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "search_requests").where("query_id % 20 = 0").select("query_id", "query")
    found = search.name_coverages(asked, table(spark, sf, "documents").select("doc_id", "name"))
    return found.select("query_id", "doc_id", F.round("share", 6).alias("share"))


@_register("q_filename_match", "SELECT query_id, d.id AS document_id FROM search_requests r JOIN documents d ON instr(lower(d.name), lower(r.query)) > 0 AND (nullif(r.extension, '') IS NULL OR lower(coalesce(d.extension, '')) = r.extension)")
def q_filename_match(spark: SparkSession, sf: str) -> DataFrame:
    return search.name_matches(search.clean_requests(table(spark, sf, "search_requests")), search.clean_documents(table(spark, sf, "documents")))


@_register("q_snippet", f"SELECT doc_id, md5({sql_snippet('text', chr(39) + 'the' + chr(39))}) AS digest FROM documents WHERE text IS NOT NULL")
def q_snippet(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.md5(T.snippet(F.col("text"), F.lit("the"))).alias("digest"))


@_register("q_page_documents", f"SELECT doc_id, name, path FROM documents ORDER BY {sql_ascii_lower('name')} NULLS FIRST, path NULLS FIRST, id LIMIT 50 OFFSET 100")
def q_page_documents(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.document_page(table(spark, sf, "documents").select("id", "doc_id", "name", "path"), 100, 50).select("doc_id", "name", "path")


@_register("q_page_chunks", f"SELECT c.id AS chunk_id, d.name, c.position FROM (SELECT DISTINCT id, document_id, position FROM chunks) c JOIN documents d ON d.id = c.document_id ORDER BY {sql_ascii_lower('d.name')} NULLS FIRST, d.path NULLS FIRST, c.position, c.id LIMIT 50 OFFSET 200")
def q_page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.chunk_page(table(spark, sf, "chunks"), table(spark, sf, "documents"), 200, 50).select("chunk_id", "name", "position")


@_register("q_page_failures", "SELECT path, category, updated_at FROM failures ORDER BY updated_at DESC NULLS LAST, path NULLS FIRST, category, reason LIMIT 20 OFFSET 10")
def q_page_failures(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.failure_page(table(spark, sf, "failures"), 10, 20).select("path", "category", "updated_at")


@_register("q_stats", "SELECT (SELECT count(*) FROM documents) AS document_count, (SELECT count(*) FROM chunks) AS chunk_count, (SELECT count(*) FROM failures) AS failed_count, (SELECT count(*) FROM documents WHERE embedding IS NULL OR len(embedding) <> 64) AS missing")
def q_stats(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return catalog.counts(docs, table(spark, sf, "chunks"), table(spark, sf, "failures")).join(F.broadcast(catalog.missing_vectors(docs, 64)))


@_register("q_extensions", "SELECT DISTINCT extension FROM documents WHERE extension <> ''")
def q_extensions(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.extensions(table(spark, sf, "documents"))


@_register("q_directories", "SELECT DISTINCT path FROM directories")
def q_directories(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.directory_list(table(spark, sf, "directories"))


@_register("q_document_chunks", "SELECT d.id AS document_id, c.id AS chunk_id, c.position FROM (SELECT min(document_id) AS id FROM chunks) d JOIN (SELECT DISTINCT id, document_id, position FROM chunks) c ON c.document_id = d.id")
def q_document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").select("id", "document_id", "position")
    document = chunks.agg(F.min("document_id")).first()[0]
    return catalog.chunks_of(chunks, document or "").select("document_id", F.col("id").alias("chunk_id"), "position")


# files of the last run as the scan, the documents as the state before it
SQL_SCAN = """
scan AS (SELECT path, arg_max(root, (seen_at, modified_ms, size)) AS root, arg_max(modified_ms, (seen_at, modified_ms, size)) AS modified_ms, arg_max(size, (seen_at, modified_ms, size)) AS size
         FROM scanned_files WHERE run_id = (SELECT max(run_id) FROM scanned_files) AND modified_ms IS NOT NULL AND size IS NOT NULL AND path IS NOT NULL GROUP BY path)"""


def _scan(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "scanned_files")
    last = files.agg(F.max("run_id").alias("run_id"))
    rows = files.where("modified_ms is not null and size is not null and path is not null").join(F.broadcast(last), "run_id")
    top = F.max(F.struct("seen_at", "modified_ms", "size", "root")).alias("s")
    return rows.groupBy("path").agg(top).select("path", F.col("s.root").alias("root"), F.col("s.modified_ms").alias("modified_ms"), F.col("s.size").alias("size"))


@_register(
    "q_sync_diff",
    f"""WITH {SQL_SCAN}, kept AS (SELECT * FROM documents WHERE root IN (SELECT path FROM directories)),
    full_roots AS (SELECT root FROM scan GROUP BY root HAVING count(*) > 3)
    SELECT s.path, 'parse' AS action FROM scan s LEFT JOIN kept k USING (path) WHERE NOT coalesce(k.embedding IS NOT NULL AND k.modified_ms = s.modified_ms AND k.size = s.size, false)
    UNION ALL SELECT path, 'delete' FROM (SELECT path FROM documents WHERE root NOT IN (SELECT path FROM directories) OR root IS NULL
      UNION SELECT path FROM kept WHERE root IN (SELECT root FROM full_roots) AND path NOT IN (SELECT path FROM scan))""",
)
def q_sync_diff(spark: SparkSession, sf: str) -> DataFrame:
    scan = _scan(spark, sf)
    complete = scan.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 3").select("root")
    return sync.sync_plan(scan, table(spark, sf, "documents"), table(spark, sf, "directories"), complete)


@_register(
    "q_longest_root",
    f"""WITH {SQL_SCAN}, roots AS (SELECT path AS root FROM directories UNION SELECT regexp_replace(path, '/[^/]+$', '') FROM directories)
    SELECT path, root FROM (SELECT s.path, r.root, row_number() OVER (PARTITION BY s.path ORDER BY length(r.root) DESC) AS n FROM scan s JOIN roots r ON s.path = r.root OR starts_with(s.path, r.root || '/')) WHERE n = 1""",
)
def q_longest_root(spark: SparkSession, sf: str) -> DataFrame:
    folders = table(spark, sf, "directories").select("path")
    roots = folders.unionByName(folders.select(F.regexp_replace("path", "/[^/]+$", "").alias("path"))).distinct()
    return sync.longest_root(_scan(spark, sf), roots)


@_register("q_deleted_below", "SELECT d.doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM directories f WHERE ends_with(f.path, '7') AND (d.path = f.path OR starts_with(d.path, f.path || '/')))")
def q_deleted_below(spark: SparkSession, sf: str) -> DataFrame:
    return sync.below_any(table(spark, sf, "documents").select("doc_id", "path"), table(spark, sf, "directories").where(F.endswith("path", F.lit("7")))).select("doc_id")


_NEW = "SELECT id, path, name, size + 1 AS size FROM documents WHERE size > 3000 UNION ALL SELECT 'x' || id, path, name, size FROM documents WHERE size < 900"


@_register("q_upsert", f"WITH new AS ({_NEW}) SELECT id, path, size FROM documents WHERE id NOT IN (SELECT id FROM new) AND path NOT IN (SELECT path FROM new) UNION ALL SELECT id, path, size FROM new")
def q_upsert(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("id", "path", "name", "size")
    new = docs.where("size > 3000").withColumn("size", F.col("size") + 1).unionByName(docs.where("size < 900").withColumn("id", F.concat(F.lit("x"), "id")))
    return sync.upsert_documents(docs, new).select("id", "path", "size")


@_register(
    "q_upsert_vectors",
    """WITH new AS (SELECT chunk_id, any_value(embedding) AS embedding FROM chunk_embeddings WHERE chunk_id % 3 = 0 GROUP BY chunk_id),
    own AS (SELECT DISTINCT n.chunk_id, c.document_id, d.extension FROM new n JOIN chunks c ON c.id = n.chunk_id JOIN documents d ON d.id = c.document_id),
    old AS (SELECT DISTINCT chunk_id, document_id, extension FROM chunk_embeddings)
    SELECT * FROM own UNION ALL SELECT * FROM old WHERE chunk_id NOT IN (SELECT chunk_id FROM own)""",
)
def q_upsert_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "chunk_embeddings")
    old = vectors.dropDuplicates(["chunk_id", "document_id", "extension"])
    out = sync.upsert_vectors(old, vectors.where("chunk_id % 3 = 0"), table(spark, sf, "chunks"), table(spark, sf, "documents"))
    return out.select("chunk_id", "document_id", "extension")


@_register("q_cascade", "WITH gone AS (SELECT id FROM documents WHERE extension = 'pdf') SELECT (SELECT count(*) FROM documents WHERE id NOT IN (SELECT id FROM gone)) AS documents, (SELECT count(*) FROM chunks WHERE document_id NOT IN (SELECT id FROM gone)) AS chunks, (SELECT count(*) FROM chunk_embeddings WHERE document_id NOT IN (SELECT id FROM gone)) AS vectors")
def q_cascade(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    three = sync.cascade(docs.where("extension = 'pdf'"), docs, table(spark, sf, "chunks"), table(spark, sf, "chunk_embeddings"))
    a, b, c = (t.agg(F.count(F.lit(1)).alias(n)) for t, n in zip(three, ("documents", "chunks", "vectors"), strict=True))
    return a.join(F.broadcast(b)).join(F.broadcast(c))


@_register("q_vector_owners", "SELECT DISTINCT e.chunk_id, d.id AS document_id, lower(coalesce(d.extension, '')) AS extension FROM chunk_embeddings e JOIN documents d ON d.id = e.document_id WHERE e.embedding IS NOT NULL")
def q_vector_owners(spark: SparkSession, sf: str) -> DataFrame:
    docs = search.clean_documents(table(spark, sf, "documents")).select(F.col("id").alias("document_id"), "extension")
    return table(spark, sf, "chunk_embeddings").where("embedding is not null").select("chunk_id", "document_id").join(docs, "document_id").select("chunk_id", "document_id", "extension").distinct()


@_register("q_failures_latest", "SELECT path, category, reason, updated_at FROM (SELECT path, lower(coalesce(category, 'parse')) AS category, reason, updated_at, row_number() OVER (PARTITION BY path ORDER BY updated_at DESC NULLS LAST, lower(coalesce(category, 'parse')) DESC, reason DESC) AS n FROM failures WHERE path IS NOT NULL) WHERE n = 1")
def q_failures_latest(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "failures")
    return sync.record_failures(old, old.limit(0))


_RULES = " ".join("WHEN " + " OR ".join(f"contains(lower(reason), '{s}')" for s in signs) + f" THEN '{c}'" for c, signs in T.FAILURES)


@_register("q_classify_failure", f"SELECT reason, CASE {_RULES} ELSE 'parse' END AS category, count(*) AS n FROM failures GROUP BY ALL")
def q_classify_failure(spark: SparkSession, sf: str) -> DataFrame:
    return sync.failures_of(table(spark, sf, "failures")).groupBy("reason", "category").agg(F.count(F.lit(1)).alias("n"))


@_register(
    "q_debounce",
    """WITH e AS (SELECT ts, user_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts) < 600000000 THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL),
    b AS (SELECT *, sum(fresh) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING) AS burst FROM e)
    SELECT burst::BIGINT AS burst, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events, count(DISTINCT user_id) AS paths FROM b GROUP BY burst""",
)
def q_debounce(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("ts", F.col("user_id").cast("string").alias("path"))
    out = changes.debounce(events, gap_us=600_000_000)
    return out.select(F.col("burst").cast("bigint").alias("burst"), F.col("begin").alias("first_ts"), F.col("last").alias("last_ts"), "events", "paths")


@_register(
    "q_root_health",
    """WITH p AS (SELECT user_id, ts, event_id, value >= 50 AS up, lag(value >= 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM (SELECT user_id, ts, max(value) AS value, 0 AS event_id FROM events GROUP BY user_id, ts))
    SELECT user_id AS root, ts, CASE WHEN up THEN 'recovered' ELSE 'offline' END AS change FROM p WHERE was IS NOT NULL AND was <> up""",
)
def q_root_health(spark: SparkSession, sf: str) -> DataFrame:
    probes = table(spark, sf, "events").groupBy(F.col("user_id").alias("root"), "ts").agg((F.max("value") >= 50).alias("online"))
    return changes.root_health(probes)


@_register("q_display", r"SELECT doc_id, list_last(list_filter(regexp_split_to_array(path, '[\\/]'), lambda p: p <> '')) AS base, CASE WHEN size < 1024 THEN size || ' B' WHEN size < 1048576 THEN printf('%.1f KB', size / 1024.0::DOUBLE) ELSE printf('%.1f MB', size / 1048576.0::DOUBLE) END AS bytes FROM documents WHERE size IS NOT NULL")
def q_display(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("size is not null").select("doc_id", T.basename(F.col("path")).alias("base"), T.format_bytes(F.col("size")).alias("bytes"))


@_register("q_supported", r"SELECT path, left(md5(path), 16) AS id FROM (SELECT DISTINCT path FROM scanned_files) WHERE translate(regexp_extract(path, '[^/\\]\.([^./\\]+)$', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ('txt','md','csv','json','log','rst','pdf','docx','xlsx','pptx')")
def q_supported(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "scanned_files").select("path").distinct().where(T.is_supported(F.col("path"))).select("path", T.stable_id(F.col("path")).alias("id"))


# -- parts of the engine ------------------------------------------------------------------------------------------------


@_register("q_ordered_chunks", "SELECT DISTINCT id, document_id, position FROM chunks WHERE id IS NOT NULL")
def q_ordered_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.ordered_chunks(table(spark, sf, "chunks").select("id", "document_id", "position"))


@_register("q_lookup_paths", "SELECT doc_id, path FROM documents WHERE path IN (SELECT path FROM failures)")
def q_lookup_paths(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.lookup(table(spark, sf, "documents").select("doc_id", "path"), "path", table(spark, sf, "failures").select("path"))


@_register("q_lookup_chunks", "SELECT DISTINCT id, document_id FROM chunks WHERE id IN (SELECT chunk_id FROM chunk_embeddings)")
def q_lookup_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.lookup(table(spark, sf, "chunks").select("id", "document_id"), "id", table(spark, sf, "chunk_embeddings").select("chunk_id")).distinct()


@_register("q_first_chunks", "SELECT document_id, id, position, place FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY position NULLS LAST, id) AS place FROM (SELECT DISTINCT id, document_id, position FROM chunks WHERE id IS NOT NULL)) WHERE place <= 2")
def q_first_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.first_chunks(table(spark, sf, "chunks"), 2)


@_register("q_file_totals", f"WITH {SQL_SCAN} SELECT root, count(*) AS files FROM scan GROUP BY root")
def q_file_totals(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.file_totals(_scan(spark, sf))


@_register("q_largest", "SELECT extension, doc_id, n FROM (SELECT extension, doc_id, coalesce(length(text), 0) AS n, row_number() OVER (PARTITION BY extension ORDER BY coalesce(length(text), 0) DESC, doc_id) AS p FROM documents) WHERE p = 1")
def q_largest(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.largest(table(spark, sf, "documents"), "extension", "doc_id", "text")


_SETTINGS = "SELECT CAST(run_id AS VARCHAR) AS key, status AS value FROM index_runs"


@_register("q_put_settings", f"WITH old AS ({_SETTINGS}), new AS (SELECT key, 'late' AS value FROM old WHERE value <> 'ok' UNION ALL SELECT 'extra', 'x') SELECT * FROM old WHERE key NOT IN (SELECT key FROM new) UNION ALL SELECT * FROM new")
def q_put_settings(spark: SparkSession, sf: str) -> DataFrame:
    old = table(spark, sf, "index_runs").select(F.col("run_id").cast("string").alias("key"), F.col("status").alias("value"))
    new = old.where("value <> 'ok'").select("key", F.lit("late").alias("value")).unionByName(spark.range(1).select(F.lit("extra").alias("key"), F.lit("x").alias("value")))
    return sync.put_settings(old, new)


@_register("q_clear_vectors", "SELECT count(*) AS documents, 0::BIGINT AS with_vector, 0::BIGINT AS vectors FROM documents")
def q_clear_vectors(spark: SparkSession, sf: str) -> DataFrame:
    docs, vectors = sync.clear_vectors(table(spark, sf, "documents"), table(spark, sf, "chunk_embeddings"))
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count("embedding").alias("with_vector")).join(F.broadcast(vectors.agg(F.count(F.lit(1)).alias("vectors"))))


_POSTINGS_SUM = "count(*) AS postings, count(DISTINCT term) AS terms, sum(tf)::BIGINT AS total"


def _postings(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, keyword.Postings]:
    chunks, docs = search.clean_chunks(table(spark, sf, "chunks")), search.clean_documents(table(spark, sf, "documents"))
    return chunks, docs, keyword.build_postings(chunks, docs)


def _summed(p: keyword.Postings) -> DataFrame:
    each = p.terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.count(F.lit(1)).alias("terms"), F.sum("tf").alias("total"))


@_register("q_postings_delete", f"WITH {SQL_POSTINGS} SELECT {_POSTINGS_SUM} FROM postings WHERE chunk_id NOT IN (SELECT chunk_id FROM c JOIN d ON d.id = c.document_id WHERE d.extension = 'pdf')")
def q_postings_delete(spark: SparkSession, sf: str) -> DataFrame:
    _, docs, p = _postings(spark, sf)
    return _summed(keyword.delete_postings(p, docs.where("extension = 'pdf'").select(F.col("id").alias("document_id"))))


@_register("q_postings_replace", f"WITH {SQL_POSTINGS}, own AS (SELECT chunk_id, position FROM c JOIN d ON d.id = c.document_id WHERE d.extension = 'docx') SELECT {_POSTINGS_SUM} FROM postings WHERE chunk_id NOT IN (SELECT chunk_id FROM own WHERE position <> 0)")
def q_postings_replace(spark: SparkSession, sf: str) -> DataFrame:
    chunks, docs, p = _postings(spark, sf)
    written = docs.where("extension = 'docx'")
    anew = chunks.where("position = 0").join(written.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return _summed(keyword.replace_postings(p, anew, written))


@_register("q_upsert_chunks", """WITH d AS (SELECT id, text FROM documents WHERE text IS NOT NULL AND size > 3000)
    SELECT document_id, position, md5(text) AS digest FROM chunks WHERE document_id IN (SELECT id FROM documents) AND document_id NOT IN (SELECT id FROM d)
    UNION ALL SELECT id, i::INTEGER, md5(substr(text, i * 700 + 1, 800)) FROM (SELECT id, text, unnest(range(0, 1 + ceil(greatest(length(text) - 800, 0) / 700.0)::BIGINT)) AS i FROM d)""")
def q_upsert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("id", "text", "size")
    prepared = docs.where("text is not null and size > 3000").select("id", chunking.windows(F.col("text")).alias("chunks"))
    return sync.upsert_chunks(table(spark, sf, "chunks"), docs, prepared).select("document_id", "position", F.md5("text").alias("digest"))


@_register("q_below", "SELECT doc_id, path = root OR starts_with(path, regexp_replace(root, '/+$', '') || '/') AS inside FROM documents WHERE root IS NOT NULL AND path IS NOT NULL")
def q_below(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("root is not null and path is not null").select("doc_id", sync.below(F.col("path"), F.col("root")).alias("inside"))


@_register("q_dot", "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 6) AS product FROM embeddings")
def q_dot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", F.round(V.dot(F.col("embedding"), F.reverse("embedding")), 6).alias("product"))


@_register("q_failure_record", f"SELECT path, CASE {_RULES} ELSE 'parse' END AS category, reason FROM failures")
def q_failure_record(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "failures").select(T.failure(F.col("path"), F.col("reason")).alias("f")).select("f.*")


@_register("q_format", """SELECT doc_id, strftime(make_timestamp(modified_ms * 1000), '%b %-d, %Y') AS day,
    CASE WHEN instr(lower(name), 'report') > 0 THEN substr(name, 1, instr(lower(name), 'report') - 1) || '<mark>' || substr(name, instr(lower(name), 'report'), 6) || '</mark>' || substr(name, instr(lower(name), 'report') + 6) ELSE name END AS marked,
    CASE WHEN size < 1000 THEN size || ' ms' WHEN size < 10000 THEN printf('%.1f s', (CASE WHEN size % 100 = 50 AND size % 250 = 0 THEN size + 50 ELSE size END) / 1000.0::DOUBLE) WHEN size < 60000 THEN ((size + 500) // 1000) || ' s' ELSE (size // 60000) || 'm ' || ((size % 60000) // 1000) || 's' END AS took
    FROM documents WHERE modified_ms IS NOT NULL AND size IS NOT NULL""")
def q_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("modified_ms is not null and size is not null")
    return rows.select("doc_id", T.format_date(F.col("modified_ms")).alias("day"), T.highlight(F.col("name"), F.lit("report")).alias("marked"), T.format_duration(F.col("size")).alias("took"))


@_register(
    "q_requests",
    f"""SELECT query_id, CASE WHEN lower(trim(search_mode)) IN ('keyword', 'semantic') THEN lower(trim(search_mode)) ELSE 'hybrid' END AS mode, nullif(extension, '') AS ext,
    greatest(1, least(100, coalesce(max_results, 20))) AS most, greatest(200, least(1000, 20 * greatest(1, least(100, coalesce(max_results, 20))))) AS budget
    FROM search_requests WHERE query_id IS NOT NULL AND regexp_replace(query, '^{WS}+', '') <> ''""",
)
def q_requests(spark: SparkSession, sf: str) -> DataFrame:
    return search.clean_requests(table(spark, sf, "search_requests")).select("query_id", "mode", "ext", "most", "budget")


@_register(
    "q_document_floor",
    f"""WITH {sql_hashed("(SELECT id, lower(coalesce(extension, '')) AS extension, name FROM documents WHERE id IS NOT NULL)", "id, extension", "name", "vec")},
    {sql_hashed("(SELECT query_id, nullif(extension, '') AS ext, query FROM search_requests WHERE regexp_replace(query, '^" + WS + "+', '') <> '')", "query_id, ext", "query", "qvec")},
    sims AS (SELECT q.query_id, v.id, round(greatest(sum(q.v * v.v), 0), 6) AS sim FROM qvec q JOIN vec v USING (bucket) WHERE q.ext IS NULL OR v.extension = q.ext GROUP BY ALL)
    SELECT query_id, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS place FROM sims WHERE sim > 0.05) WHERE place <= 50""",
)
def q_document_floor(spark: SparkSession, sf: str) -> DataFrame:
    docs = search.clean_documents(table(spark, sf, "documents"))
    own = V.sparse_features(docs, ["id", "extension"], F.col("name")).withColumn("document_id", F.col("id"))
    asked = search.clean_requests(table(spark, sf, "search_requests")).withColumn("budget", F.lit(50))
    query = V.sparse_features(asked, ["query_id", "ext", "budget"], F.col("query"))
    sims = exact.sparse_top_k(query, own, "document_id", V.BUCKETS, search.DOCUMENT_FLOOR, strict=True)
    return keyword.top_hits(sims, 50, "sim", "id").select("query_id", "id", "sim")


@_register("q_padded_tokens")
def q_padded_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "chunks").where("text is not null").select("id", F.char_length("text").alias("n"))
    return embedding.padded_tokens(embedding.token_batches(rows, "id", "n"))


@_register("q_vector_bytes", "SELECT vec_id, 256::INTEGER AS size, true AS same FROM embeddings")
def q_vector_bytes(spark: SparkSession, sf: str) -> DataFrame:
    rows = embedding.to_bytes(table(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    back = embedding.from_bytes(rows, "bytes", "again")
    return back.select("vec_id", F.octet_length("bytes").alias("size"), (F.col("embedding") == F.col("again")).alias("same"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
