from pyspark.sql import functions as F

from lodestone.functions import text as T


def one(spark, value, *make):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(*[m(F.col("x")).alias(f"c{i}") for i, m in enumerate(make)]).first()


def test_terms_split_words_and_cjk_pairs(spark):
    got = one(spark, "本地搜索 Rust a foo_bar Élan", T.terms)[0]
    assert set(got) == {"本", "地", "搜", "索", "本地", "地搜", "搜索", "rust", "foo_bar", "lan"}


def test_index_pieces_split_underscores_and_drop_long(spark):
    assert set(one(spark, "foo_bar " + "x" * 40 + " " + "y" * 39, T.index_pieces)[0]) == {"foo", "bar", "y" * 39}


def test_normalize_text(spark):
    assert one(spark, "  a 　 b\r\n\n\t\n c d ", T.normalize_text)[0] == "a b\nc d"
    assert one(spark, None, T.normalize_text, T.terms) == (None, None)
    assert one(spark, "", T.normalize_text)[0] == ""


def test_coverage(spark):
    df = spark.createDataFrame([("软件需求规格说明书", "项目软件需求规格说明书模板"), ("软件需求规格说明书", "新能源功率预测模型"), ("x", "x")], "q string, t string")
    a, b, c = (r[0] for r in df.select(T.coverage(F.col("q"), F.col("t"))).collect())
    assert a > 0.9 and b == 0 and c == 0


def test_snippet_surrounds_the_query(spark):
    text = "前" * 400 + "目标词" + "后" * 400
    got = one(spark, text, lambda c: T.snippet(c, F.lit("目标词")))[0]
    assert len(got) == 266 and "目标词" in got and got.startswith("...") and got.endswith("...")
    assert one(spark, "short", lambda c: T.snippet(c, F.lit("zz")))[0] == "short"
    assert one(spark, "a" * 300, lambda c: T.snippet(c, F.lit("zz")))[0] == "a" * 260 + "..."


def test_failure_classes_in_order(spark):
    cases = {
        "document is encrypted": "encrypted",
        "Permission denied": "permission",
        "network share offline": "offline",
        "invalid zip archive": "corrupt",
        "文档解析超时（180 秒）": "timeout",
        "else": "parse",
        "password file not found": "encrypted",
    }
    df = spark.createDataFrame(list(cases.items()), "reason string, want string")
    assert df.where(T.classify_failure(F.col("reason")) != F.col("want")).count() == 0


def test_names_and_display(spark):
    r = one(spark, "/a/b.C/Report.PDF", T.extension_of, T.is_supported, T.basename, T.stable_id)
    assert r[:3] == ("pdf", True, "Report.PDF") and len(r[3]) == 16
    assert one(spark, "/a/noext", T.extension_of, T.is_supported)[:2] == ("", False)
    df = spark.createDataFrame([(500,), (2048,), (3 << 20,)], "n bigint")
    assert [x[0] for x in df.select(T.format_bytes(F.col("n"))).collect()] == ["500 B", "2.0 KB", "3.0 MB"]
    df = spark.createDataFrame([(500,), (2500,), (45_000,), (125_000,)], "n bigint")
    assert [x[0] for x in df.select(T.format_duration(F.col("n"))).collect()] == ["500 ms", "2.5 s", "45 s", "2m 5s"]
    assert one(spark, "Hello World", lambda c: T.highlight(c, F.lit("world")))[0] == "Hello <mark>World</mark>"


def test_durations_round_as_doubles_do(spark):
    from decimal import ROUND_HALF_UP, Decimal

    rows = spark.range(1000, 10_000).select("id", T.format_duration(F.col("id")).alias("d")).collect()
    assert all(r.d == f"{Decimal(r.id / 1000).quantize(Decimal('0.1'), ROUND_HALF_UP)} s" for r in rows)
