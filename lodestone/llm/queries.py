"""Queries of this package over the test tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import encoding, fusion, languages, leaks, lookalikes, nearcopies, neighbours, splitting, tokens
from lodestone.runtime import table


def _both(make, chunks: DataFrame, documents: DataFrame) -> DataFrame:  # noqa: ANN001
    """The same operator on chunk texts and on document names."""
    a = make(chunks, "id", "text").withColumn("kind", F.lit("chunk"))
    b = make(documents, "doc_id", "name").withColumn("kind", F.lit("name"))
    return a.unionByName(b).select("kind", "key_a", "key_b")


def _near(spark: SparkSession, sf_dir: str) -> dict[str, nearcopies.NearCopies]:
    return {
        "chunk": nearcopies.NearCopies(table(spark, sf_dir, "chunks"), "id", "text", n=8, at_least=0.7, least_chars=200),
        "name": nearcopies.NearCopies(table(spark, sf_dir, "documents"), "doc_id", "name", n=3, at_least=0.7, short=True),
    }


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (v.pairs().select(F.lit(k).alias("kind"), "key_a", "key_b") for k, v in _near(spark, sf_dir).items())
    return a.unionByName(b)


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (v.groups().select(F.lit(k).alias("kind"), "key", "class_id", "class_size") for k, v in _near(spark, sf_dir).items())
    return a.unionByName(b)


_P1_KIND = """
{kind}_m AS (SELECT DISTINCT {key} AS key, {text} AS text, md5({text}) AS h FROM {table} WHERE {key} IS NOT NULL AND {text} IS NOT NULL AND length({text}) >= {least}),
{kind}_g AS (SELECT DISTINCT h, substr(text, i, {n}) AS g FROM (SELECT h, text, unnest(range(1, length(text) - {n} + 2)) AS i FROM (SELECT DISTINCT h, text FROM {kind}_m))),
{kind}_n AS (SELECT h, count(*) AS n FROM {kind}_g GROUP BY h),
{kind}_l AS (SELECT a.h AS ha, b.h AS hb, count(*) AS c FROM {kind}_g a JOIN {kind}_g b ON a.g = b.g AND a.h < b.h GROUP BY ALL),
{kind}_p AS (
  SELECT a.key AS x, b.key AS y FROM {kind}_l JOIN {kind}_n p ON p.h = ha JOIN {kind}_n q ON q.h = hb JOIN {kind}_m a ON a.h = ha JOIN {kind}_m b ON b.h = hb WHERE 10 * c >= 7 * (p.n + q.n - c)
  UNION ALL SELECT a.key, b.key FROM {kind}_m a JOIN {kind}_m b ON a.h = b.h)"""
_P1_PARTS = [("chunk", "id", "text", "chunks", 8, 200), ("name", "doc_id", "name", "documents", 3, 0)]
P1_FOUND = (
    "WITH " + ",".join(_P1_KIND.format(kind=k, key=c, text=x, table=t, n=n, least=m) for k, c, x, t, n, m in _P1_PARTS)
    + " UNION ALL ".join(f" SELECT DISTINCT '{k}' AS kind, least(x, y) AS key_a, greatest(x, y) AS key_b FROM {k}_p WHERE x <> y" for k, *_ in _P1_PARTS)
)


P1_GROUPS = (
    "WITH RECURSIVE " + ",".join(_P1_KIND.format(kind=k, key=c, text=x, table=t, n=n, least=m) for k, c, x, t, n, m in _P1_PARTS)
    + "".join(
        f""", {k}_s AS (SELECT DISTINCT x, y FROM {k}_p WHERE x <> y UNION SELECT DISTINCT y, x FROM {k}_p WHERE x <> y),
        {k}_r AS (SELECT DISTINCT key, key AS other FROM {k}_m UNION SELECT r.key, s.y FROM {k}_r r JOIN {k}_s s ON r.other = s.x),
        {k}_c AS (SELECT key, min(other) AS class_id FROM {k}_r GROUP BY key)"""
        for k, *_ in _P1_PARTS
    )
    + " UNION ALL ".join(f" SELECT '{k}' AS kind, key, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM {k}_c" for k, *_ in _P1_PARTS)
)


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.garbled_rows(table(spark, sf_dir, "chunks")).withColumnRenamed("key", "chunk_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_repaired(spark, sf_dir).select("chunk_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(lookalikes.lookalike_pairs, table(spark, sf_dir, "chunks"), table(spark, sf_dir, "documents"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = lookalikes.lookalike_groups(table(spark, sf_dir, "chunks"), "id", "text").withColumn("kind", F.lit("chunk"))
    b = lookalikes.lookalike_groups(table(spark, sf_dir, "documents"), "doc_id", "name").withColumn("kind", F.lit("name"))
    return a.unionByName(b).select("kind", "key", "class_id", "spelling_id", "spellings")


def p3_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.normalize_column(table(spark, sf_dir, "documents").select("doc_id", "name"), "name", "one_form")


def p3_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.normalize_column(table(spark, sf_dir, "chunks").select("id", "text"), "text", "one_form")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.first_of_each(fusion.fuse(table(spark, sf_dir, "candidates"), ["keyword", "semantic"]))


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(table(spark, sf_dir, "candidates"), ["keyword", "semantic"])


P4_PLACES = """
WITH best AS (
  SELECT query_id, document_id, max(CASE WHEN NOT isnan(keyword) THEN keyword END) AS keyword,
         max(CASE WHEN NOT isnan(semantic) THEN semantic END) AS semantic
  FROM candidates WHERE query_id IS NOT NULL AND document_id IS NOT NULL GROUP BY query_id, document_id),
places AS (
  SELECT query_id, document_id,
         rank() OVER (PARTITION BY query_id ORDER BY keyword DESC NULLS LAST) AS place_keyword,
         rank() OVER (PARTITION BY query_id ORDER BY semantic DESC NULLS LAST) AS place_semantic
  FROM best),
fused AS (
  SELECT *, place_keyword + place_semantic AS place_sum,
         round(1.0::DOUBLE / (60 + place_keyword) + 1.0::DOUBLE / (60 + place_semantic), 12) AS rrf FROM places)
"""
P4_FOUND = P4_PLACES + """
SELECT query_id, document_id FROM (
  SELECT query_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY place_sum, rrf DESC, document_id) AS n FROM fused)
WHERE n = 1
"""
P4_RANKING = P4_PLACES + """
SELECT query_id, document_id, place_keyword, place_semantic, place_sum, rrf,
       row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, place_sum, document_id) AS rank FROM fused
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_rows(table(spark, sf_dir, "chunks")).select("chunk_id").distinct()


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.resplit(table(spark, sf_dir, "chunks"))


def p5_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of every long chunk must fulfil: none too long, the whole text in order, no gap, numbers without one."""
    chunks = table(spark, sf_dir, "chunks")
    pieces = splitting.split_rows(chunks)
    order = Window.partitionBy("chunk_id").orderBy("piece")
    each = pieces.withColumn("before", F.lag("end").over(order)).withColumn("place", F.row_number().over(order))
    sizes = chunks.where("id is not null").groupBy(F.col("id").alias("chunk_id")).agg(F.max(F.char_length("text")).alias("n"))
    sums = each.groupBy("chunk_id").agg(
        F.bool_and((F.col("end") - F.col("begin") <= splitting.LIMIT) & (F.col("end") > F.col("begin"))).alias("short"),
        F.bool_and((F.col("place") == F.col("piece") + 1) & F.coalesce((F.col("begin") <= F.col("before")) & (F.col("end") > F.col("before")), F.col("begin") == 0)).alias("whole"),
        F.max("end").alias("last"),
    )
    return sums.join(sizes, "chunk_id").select("chunk_id", "short", "whole", (F.col("last") == F.col("n")).alias("ends"))


P5_COVERED = "SELECT DISTINCT id AS chunk_id, true AS short, true AS whole, true AS ends FROM chunks WHERE length(text) > 800 AND id IS NOT NULL"
P5_FOUND = "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(text) > 800 AND id IS NOT NULL"


def _vectors(spark: SparkSession, sf_dir: str) -> dict[str, neighbours.Neighbours]:
    return {
        "chunk": neighbours.Neighbours(table(spark, sf_dir, "chunk_embeddings"), "chunk_id"),
        "document": neighbours.Neighbours(table(spark, sf_dir, "documents"), "doc_id"),
    }


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (v.pairs(0.90).select(F.lit(k).alias("kind"), "key_a", "key_b") for k, v in _vectors(spark, sf_dir).items())
    return a.unionByName(b)


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (v.neighbours().select(F.lit(k).alias("kind"), "key", "neighbour", "cosine", "place") for k, v in _vectors(spark, sf_dir).items())
    return a.unionByName(b)


_P6_KIND = """
{kind}_v AS (
  SELECT key, min(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))) AS v FROM (
    SELECT DISTINCT {key} AS key, embedding::DOUBLE[] AS e FROM {table}
    WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0) GROUP BY key),
{kind}_near AS (
  SELECT a.key AS a, b.key AS b, list_dot_product(a.v, b.v) AS cosine,
         row_number() OVER (PARTITION BY a.key ORDER BY list_dot_product(a.v, b.v) DESC, b.key) AS place
  FROM {kind}_v a JOIN {kind}_v b ON a.key <> b.key)"""
_P6_PARTS = [("chunk", "chunk_id", "chunk_embeddings"), ("document", "doc_id", "documents")]
P6_FOUND = (
    "WITH " + ",".join(_P6_KIND.format(kind=k, key=c, table=t) for k, c, t in _P6_PARTS)
    + " UNION ALL ".join(f" SELECT DISTINCT '{k}' AS kind, least(a, b) AS key_a, greatest(a, b) AS key_b FROM {k}_near WHERE place <= 5 AND round(cosine, 6) >= 0.90" for k, _, _ in _P6_PARTS)
)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), p9_leaks(spark, sf_dir))


_P9 = r"""
WITH d AS (SELECT DISTINCT doc_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT DISTINCT item_id, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS t FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT DISTINCT item_id, substr(t, n, 40) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 38)) AS n FROM i)),
found AS (SELECT DISTINCT v.doc_id, w.item_id FROM (SELECT doc_id, substr(t, n, 40) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 38)) AS n FROM d)) v JOIN w USING (g))
"""
P9_FOUND = _P9 + "SELECT doc_id, item_id FROM found"
P9_LEAKS = _P9 + """, hits AS (
  SELECT v.doc_id, w.item_id, v.n AS p, v.n - w.n AS diagonal FROM (SELECT doc_id, n, substr(t, n, 40) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 38)) AS n FROM d)) v
  JOIN (SELECT item_id, n, substr(t, n, 40) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 38)) AS n FROM i)) w USING (g)),
runs AS (SELECT doc_id, item_id, min(p) - 1 AS start, count(*) + 39 AS length FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY p) AS island FROM hits) GROUP BY doc_id, item_id, diagonal, island)
SELECT doc_id, item_id, start, length FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY length DESC, start) AS n FROM runs) WHERE n = 1"""
P9_CLEAN = _P9 + "SELECT doc_id, text FROM documents WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM found)"


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_samples"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[:1] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_FOUND,
        "p1_groups": P1_GROUPS,
        "p4_found": P4_FOUND,
        "p4_ranking": P4_RANKING,
        "p5_found": P5_FOUND,
        "p5_covered": P5_COVERED,
        "p6_found": P6_FOUND,
        "p9_found": P9_FOUND,
        "p9_leaks": P9_LEAKS,
        "p9_clean": P9_CLEAN,
    }
