import math
import random

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import text as T
from lodestone.functions import vectors as V
from lodestone.operators import blocks, catalog, chunking, embedding, keyword, search, sync
from lodestone.operators import vectors as exact
from lodestone.operators.ranking import grouped_rank
from lodestone.streaming import changes


def test_chunks_and_samples(spark):
    df = spark.createDataFrame([(1, "本" * 1700), (2, "x" * 800), (3, ""), (4, None)], "id bigint, text string")
    got = {(r[0], r[1]): len(r[2]) for r in chunking.chunk(df, "id", "text").collect()}
    assert got == {(1, 0): 800, (1, 1): 800, (1, 2): 300, (2, 0): 800, (3, 0): 0}
    many = spark.range(20).select(F.lit("d").alias("d"), F.col("id").cast("int").alias("position"))
    assert sorted(r.position for r in chunking.sample_chunks(many, "d").collect()) == [0, 6, 12, 19]
    text = "开头" + "中" * 800 + "结尾"
    got = spark.createDataFrame([("测试.txt", text)], "n string, t string").select(chunking.embedding_text(F.col("n"), F.col("t"))).first()[0]
    assert got.startswith("测试.txt\n开头") and got.endswith("结尾") and len(got) == 6 + 2 + 480


def test_grouped_rank_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([None, 1.0, 2.0, 3.5, rng.random()]), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, s double, i int").repartition(7)
    got = {r.i: r.p for r in grouped_rank(df, ["g"], [("s", "desc")], "p").collect()}
    value = lambda s: -math.inf if s is None else s
    assert got == {i: 1 + sum(value(t) > value(s) for h, t, _ in rows if h == g) for g, s, i in rows}
    got = {r.i: r.p for r in grouped_rank(df, ["g"], [("s", "asc"), ("i", "asc")], "p", ties=False).collect()}
    key = lambda s, i: (s is None, s or 0, i)
    assert got == {i: 1 + sum(key(t, j) < key(s, i) for h, t, j in rows if h == g) for g, s, i in rows}
    assert grouped_rank(df.limit(0), ["g"], [("s", "asc")], "p").count() == 0


def test_bm25_prefers_the_name(spark):
    chunks = spark.createDataFrame([(1, "doc-1", "支持本地语义检索和关键词查询"), (2, "doc-2", "季度餐饮费用报表"), (2, "doc-2", "季度餐饮费用报表"), (3, "gone", None)], "chunk_id bigint, document_id string, text string")
    docs = spark.createDataFrame([("doc-1", "Windows 本地文档搜索需求"), ("doc-2", "费用")], "id string, name string")
    p = keyword.build_postings(chunks, docs)
    req = spark.createDataFrame([(0, "本地搜索")], "query_id int, query string")
    hits = keyword.top_hits(keyword.bm25(req, p), 10).collect()
    assert [h.chunk_id for h in hits] == [1]
    tf = {r.term: r.tf for r in p.terms.where("chunk_id = 1").collect()}
    assert tf["本地"] == 4 and tf["windows"] == 3 and tf["语义"] == 1
    gone = keyword.delete_postings(p, spark.createDataFrame([("doc-1",)], "document_id string"))
    assert keyword.bm25(req, gone).count() == 0
    assert keyword.bm25(req, keyword.replace_postings(p, chunks.where("chunk_id = 1"), docs.where("id = 'doc-1'"))).count() == 1
    assert not keyword.needs_rebuild(p, chunks) and keyword.needs_rebuild(gone, chunks)


def test_vectors(spark):
    df = spark.createDataFrame([("a", [1.0] * 8), ("a", [1.0] * 8), ("a", [1.0, 2.0]), ("b", [-1.0] * 8), ("c", None)], "g string, v array<double>")
    got = {r.g: r.vector for r in V.mean_vectors(df, "g", "v", 8).collect()}
    assert set(got) == {"a", "b"} and all(abs(x - 8**-0.5) < 1e-12 for x in got["a"]) and all(x < 0 for x in got["b"])
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0])], "a array<double>, z array<double>, s array<double>")
    assert r.select(V.normalized(F.col("a")), V.normalized(F.col("z")), V.dot(F.col("a"), F.col("s"))).first() == ([0.6, 0.8], [0.0, 0.0], 0.0)
    texts = spark.createDataFrame([(1, "本地文档搜索"), (2, "Windows 本地文档智能搜索工具"), (3, "季度餐饮费用报表"), (4, "")], "id int, t string")
    v = V.hashed_features(texts, ["id"], F.col("t"))
    q, r = v.where("id = 1").select("bucket", F.col("v").alias("q")), v.where("id > 1")
    sims = {x.id: x.s for x in q.join(r, "bucket").groupBy("id").agg(F.sum(F.col("q") * F.col("v")).alias("s")).collect()}
    assert sims[2] > sims.get(3, 0) and 4 not in sims
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8]), (4, None)], "id bigint, vector array<double>")
    asked = rows.where("id = 1").withColumnRenamed("id", "query_id")
    assert [(x.id, x.sim) for x in exact.top_k(asked, rows, 2).orderBy("place").collect()] == [(1, 1.0), (3, 0.6)]


def test_top_k_with_vectors_of_several_lengths(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.0, 0.0]) for i in range(10, 16)] + [(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [])], "id bigint, vector array<double>").coalesce(1)
    asked = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0, 0.0]), (3, [1.0])], "query_id bigint, vector array<double>")
    got = [(x.query_id, x.id, x.sim) for x in exact.top_k(asked, rows, 2).orderBy("query_id", "place").collect()]
    assert got == [(0, 1, 1.0), (0, 2, 0.6), (1, 2, 0.8), (1, 1, 0.0), (2, 10, 1.0), (2, 11, 1.0)]


def test_names_by_sequences_equal_the_scan(spark, monkeypatch):
    docs = spark.createDataFrame([("1", "Budget 2024 final", "txt"), ("2", "budgets", "pdf"), ("3", None, "txt"), ("4", "预算报告终稿", "txt"), ("5", "ab", "txt"), ("6", "", "txt")], "id string, name string, extension string")
    req = spark.createDataFrame([(1, "BUDGET", None), (2, "预算报告", None), (3, "b", None), (4, "budget", "pdf"), (5, "get 2024", "txt"), (6, "nothing", None)], "query_id int, query string, ext string")
    want = {(1, "1"), (1, "2"), (2, "4"), (3, "1"), (3, "2"), (3, "5"), (4, "2"), (5, "1")}
    assert {tuple(r) for r in search.name_matches(req, docs).collect()} == want
    monkeypatch.setattr(search, "FEW_REQUESTS", 0)
    assert {tuple(r) for r in search.name_matches(req, docs).collect()} == want


def test_names_meet_requests_over_common_terms_only(spark, tmp_path):
    names = ["预算报告 final_plan", "预算报告 final_plan", "报告 a", "", None, "BUDGET plan", "x"]
    asked = ["预算报告", "plan Budget", "plan Budget", "报", "", None, "报告 final_plan plan"]
    docs = spark.createDataFrame(list(enumerate([*names, names[0]])), "doc_id bigint, name string")
    docs.unionByName(docs.where("doc_id = 2")).write.parquet(f"{tmp_path}/documents.parquet")
    req = spark.createDataFrame([(20 * i, q) for i, q in enumerate(asked)] + [(20, "报告"), (7, "预算报告")], "query_id bigint, query string")
    req.write.parquet(f"{tmp_path}/search_requests.parquet")
    got = entry.queries()["q_lexical_relevance"](spark, str(tmp_path))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    pairs = spark.read.parquet(f"{tmp_path}/documents.parquet").crossJoin(req.where("query_id % 20 = 0")).withColumn("share", F.round(T.coverage(F.col("query"), F.col("name")), 6))
    want = pairs.where("share > 0").select("query_id", "doc_id", "share").collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 15


def test_many_requests_read_blocks_and_rank_the_same(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = ["budget", "plan", "foo_bar", "bar", "预算报告", "维护日志", "巡检", "depot", "Sensor_", "x" * 45]
    text = lambda n: rng.choice([" ", "_", "-"]).join(rng.choices(words, k=n))
    docs = [(f"d{i:02}", f"/p/{i}", rng.choice([text(3), text(3), None]), 1, 1, rng.choice(["PDF", "txt", None])) for i in range(60)]
    chunks = [(i, f"d{rng.randrange(65):02}", i % 7, rng.choice([text(30), text(200), text(5), "", None])) for i in range(400)]
    req = [(i, rng.choice([text(2), text(1).upper(), " "]), rng.choice([None, "keyword", "semantic", "hybrid"]), rng.choice([None, "", "pdf", "txt", "odt"]), rng.choice([None, 1, 5, 100])) for i in range(60)]
    spark.createDataFrame(docs, "id string, path string, name string, modified_ms bigint, size bigint, extension string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(chunks + chunks[-9:], "id bigint, document_id string, position int, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame(req, "query_id bigint, query string, search_mode string, extension string, max_results int").write.parquet(f"{tmp_path}/search_requests.parquet")
    batch = lambda: sorted(map(str, entry.queries()["q_search_batch"](spark, str(tmp_path)).collect()))
    want = batch()
    monkeypatch.setattr(search, "MANY", 0)
    monkeypatch.setattr(blocks, "BLOCK", 50)
    monkeypatch.setattr(keyword, "bm25", None)  # lists every pair of a request and a chunk
    assert batch() == want and len(want) > 300
    stored = search.build_index(*[spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "chunks")])
    by_term = search.Index(stored.documents, stored.chunks, stored.postings.by_term(), stored.vectors)
    assert sorted(map(str, search.search(spark.read.parquet(f"{tmp_path}/search_requests.parquet"), by_term).collect())) == want


def test_roots_and_prefixes(spark):
    paths = spark.createDataFrame([("/a/b/c.txt",), ("/a/bc/d.txt",), ("/x",), ("/a/b",)], "path string")
    roots = spark.createDataFrame([("/a",), ("/a/b",), ("/a/b/",)], "path string")
    assert {r.path: r.root.rstrip("/") for r in sync.longest_root(paths, roots).collect()} == {"/a/b/c.txt": "/a/b", "/a/bc/d.txt": "/a", "/a/b": "/a/b"}
    assert {r.path for r in sync.below_any(paths, spark.createDataFrame([("/a/b",)], "path string")).collect()} == {"/a/b/c.txt", "/a/b"}
    assert sync.normalize_roots(["/b", "/a", "/b"]) == ["/b", "/a"]


def test_sync_keeps_incomplete_roots(spark):
    cols = "path string, root string, modified_ms bigint, size bigint, embedding array<double>, id string"
    old = spark.createDataFrame([("/a/1", "/a", 1, 1, [1.0], "1"), ("/a/2", "/a", 1, 1, [1.0], "2"), ("/b/1", "/b", 1, 1, [1.0], "3"), ("/c/1", "/c", 1, 1, [1.0], "4"), ("/a/4", "/a", 1, 1, None, "5")], cols)
    scan = spark.createDataFrame([("/a/1", "/a", 1, 1), ("/a/3", "/a", 1, 1), ("/a/4", "/a", 1, 1)], "path string, root string, modified_ms bigint, size bigint")
    roots = spark.createDataFrame([("/a",), ("/b",)], "path string")
    complete = spark.createDataFrame([("/a",)], "root string")
    plan = {tuple(r) for r in sync.sync_plan(scan, old, roots, complete).collect()}
    assert plan == {("/a/3", "parse"), ("/a/4", "parse"), ("/a/2", "delete"), ("/c/1", "delete")}


def test_failures_and_settings(spark):
    rows = spark.createDataFrame([("p", "CORRUPT", "a", 1), ("p", None, "b", 2), (None, "x", "c", 3)], "path string, category string, reason string, updated_at int")
    assert [tuple(r) for r in sync.record_failures(rows, rows.limit(0)).collect()] == [("p", "parse", "b", 2)]
    s = spark.createDataFrame([("k", "1"), ("l", "2")], "key string, value string")
    assert {tuple(r) for r in sync.put_settings(s, spark.createDataFrame([("k", "3")], "key string, value string")).collect()} == {("k", "3"), ("l", "2")}


def test_document_vectors_only_without_any_chunk_vector(spark):
    docs = spark.createDataFrame([("d1", "/p", "one", 1, 1, "txt"), ("d2", "/q", "two", 1, 1, "pdf")], "id string, path string, name string, modified_ms bigint, size bigint, extension string")
    chunks = spark.createDataFrame([(1, "d1", 0, "alpha beta")], "chunk_id bigint, document_id string, position int, text string")
    vec = V.sparse_features(spark.createDataFrame([(1, "d1", "txt", "gamma")], "chunk_id bigint, document_id string, extension string, t string"), ["chunk_id", "document_id", "extension"], F.col("t"))
    own = V.sparse_features(spark.createDataFrame([("d1", "txt", "delta"), ("d2", "pdf", "delta")], "document_id string, extension string, t string"), ["document_id", "extension"], F.col("t"))
    index = search.Index(docs, chunks, keyword.build_postings(chunks, docs), vec, own)
    req = spark.createDataFrame([(1, "delta", "semantic", "pdf", 5), (2, "delta", "semantic", "txt", 5), (3, "  ", "hybrid", None, 5)], "query_id bigint, query string, search_mode string, extension string, max_results int")
    got = search.search(req, index).collect()
    assert [(r.query_id, r.document_id, r.snippet) for r in got] == [(1, "d2", "")]


def test_bursts_split_at_exactly_the_gap(spark):
    ms = [0, 100, 999, 1899, 5000]
    rows = spark.createDataFrame([(m, f"p{m % 2}") for m in ms], "ms bigint, path string").select(F.timestamp_millis("ms").alias("ts"), "path")
    got = [r.events for r in changes.debounce(rows.repartition(3)).orderBy("burst").collect()]
    assert got == [3, 1, 1]


def test_bursts_and_edges_of_hot_keys(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.randrange(60_000), f"p{rng.randrange(5)}") for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, ms bigint, path string").withColumn("ts", F.timestamp_millis("ms")).repartition(5)
    want = []
    for k in ("hot", "b", None):
        own = sorted(m for x, m, _ in rows if x == k)
        n = 1
        for a, b in zip(own, own[1:], strict=False):
            if b - a >= 900:
                want.append((k, n))
                n = 1
            else:
                n += 1
        want.append((k, n))
    got = [(r.k, r.events) for r in changes.debounce(df, key="k").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    probes = df.dropDuplicates(["k", "ms"]).select(F.col("k").alias("root"), "ts", "ms", (F.col("ms") % 3 == 0).alias("online")).where("root is not null")
    ups = {}
    for r in probes.collect():
        ups.setdefault(r.root, []).append((r.ms, r.online))
    edges = sum(a[1] != b[1] for x in ups.values() for a, b in zip(sorted(x), sorted(x)[1:], strict=False))
    assert changes.root_health(probes.select("root", "ts", "online")).count() == edges


def test_root_health(spark):
    rows = spark.createDataFrame([("r", 1, True), ("r", 2, False), ("r", 3, False), ("r", 4, True)], "root string, ts int, online boolean")
    assert [(r.ts, r.change) for r in changes.root_health(rows).orderBy("ts").collect()] == [(2, "offline"), (4, "recovered")]


def test_page_bounds_and_collation(spark):
    assert catalog.page_bounds(-3, 1000) == (0, 100) and catalog.page_bounds(5, 0) == (5, 1)
    docs = spark.createDataFrame([("1", "b", "/1"), ("2", "A", "/2"), ("3", "É", "/3"), ("4", None, "/4")], "id string, name string, path string")
    assert [r.id for r in catalog.document_page(docs).collect()] == ["4", "2", "1", "3"]


def test_lookups(spark):
    docs = spark.createDataFrame([("1", "/a"), ("2", "/b")], "id string, path string")
    assert catalog.document_by_path(docs, "/b").first().id == "2"
    chunks = spark.createDataFrame([(1, "1", 0), (1, "1", 0), (2, "1", 1)], "id bigint, document_id string, position int")
    assert catalog.chunk_by_id(chunks, 1).count() == 1 and [r.id for r in catalog.ordered_chunks(chunks).collect()] == [1, 2]
    settings = spark.createDataFrame([("k", "v")], "key string, value string")
    assert catalog.setting(settings, "k") == "v" and catalog.setting(settings, "x") is None


def test_tokens_and_batches(spark):
    pieces = {b"a": 1, b"b": 2, b"ab": 3, b"abc": 4, b"c": 5}
    df = spark.createDataFrame([(1, "abcabb"), (2, None), (3, "")], "id int, t string")
    assert {r.id: r.tokens for r in embedding.token_ids(df, "t", pieces).collect()} == {1: [4, 3, 2], 2: None, 3: []}
    rows = spark.createDataFrame(list(enumerate([3000, 100, 120, 140, 160])), "id int, n int").coalesce(1)
    plan = embedding.token_batches(rows, "id", "n")
    by = {}
    for r in plan.collect():
        by.setdefault(r.batch, []).append(r.length)
    assert sorted(map(sorted, by.values())) == [[100, 120, 140, 160], [3000]]
    assert tuple(embedding.padded_tokens(plan).first()) == (3520, 3640)


def test_recurrence_equals_the_definition():
    rng = np.random.default_rng(1)
    r, w, k, v, a, b = (rng.normal(size=(2, 5, 6)).astype(np.float32) * 0.5 for _ in range(6))
    got = embedding.recurrence(r, w, k, v, a, b, heads=2)
    for n in range(2):
        for h in range(2):
            c, state = slice(3 * h, 3 * h + 3), np.zeros((3, 3))
            for t in range(5):
                x = [z[n, t, c].astype(float) for z in (r, w, k, v, a, b)]
                state = state @ np.diag(np.exp(-np.exp(x[1]))) + np.outer(state @ x[4], x[5]) + np.outer(x[3], x[2])
                assert np.allclose(got[n, t, c], state @ x[0], atol=1e-5)


def test_embedder_falls_back_for_good(spark):
    calls = []

    def load():
        def model(ids):
            calls.append(ids.tolist())
            if len(calls) > 1:
                raise RuntimeError("out of memory")
            return np.ones((len(ids), 768)) * ids[:, -1:]

        return (lambda t: [len(t)]), model

    e = embedding.Embedder(load)
    assert e.state == "uninitialised"
    first = e.embed(["ab", "abc"])
    assert e.state == "ready" and calls[0] == [[2, embedding.END], [3, embedding.END]] and np.allclose(np.linalg.norm(first, axis=1), 1)
    assert np.allclose(e.embed(["word"]), embedding.hashed_vector("word")) and e.state == "fallback"
    assert embedding.Embedder(lambda: 1 / 0).embed(["x y"]).shape == (1, 768)
    df = spark.createDataFrame([(1, "支持本地 search"), (2, None), (3, "")], "id int, t string")
    got = {r.id: r for r in embedding.embed_texts(df, ["id"], "t", lambda: embedding.Embedder(None)).collect()}
    sparse = {r.bucket: r.v for r in V.hashed_features(df, ["id"], F.col("t")).collect()}
    assert set(got) == {1, 3} and got[1].backend == "fallback" and not any(got[3].vector)
    assert all(abs(x - sparse.get(i, 0.0)) < 1e-6 for i, x in enumerate(got[1].vector))
