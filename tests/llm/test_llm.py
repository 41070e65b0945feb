import glob
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import encoding, fusion, graphs, languages, leaks, lookalikes, nearcopies, neighbours, splitting, tokens
from lodestone.runtime import shared_dir

RNG = random.Random(11)
WORDS = ["pump", "report", "ledger", "harbour", "meeting", "invoice", "sensor", "drawing", "archive", "paint", "storm", "copper", "violet", "signal", "window", "garden"]


def prose(n, rng=RNG):
    return " ".join(f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(n))


def shingles(t, n):
    return {t[i : i + n] for i in range(len(t) - n + 1)}


# -- near copies -------------------------------------------------------------------------------------------------------


def brute_pairs(rows, n, least=0):
    rows = {k: t for k, t in rows if t is not None and len(t) >= least}
    out = set()
    for (a, s), (b, t) in itertools.combinations(sorted(rows.items()), 2):
        x, y = shingles(s, n), shingles(t, n)
        if s == t or (x | y and 10 * len(x & y) >= 7 * len(x | y)):
            out.add((a, b))
    return out


def corpus():
    base = [prose(60) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base[:12]):
        w = t.split()
        rows.append((100 + i, t))
        rows.append((200 + i, " ".join(w[: i + 1] + ["inserted", "words"] + w[i + 1 :])))
        rows.append((300 + i, " ".join(w[30:] + w[:30])))
        rows.append((400 + i, " ".join(w[: 60 - 2 * i])))
    return [*rows, (500, None), (501, ""), (502, ""), (503, "short"), (1, base[1]), (None, base[2])]


@pytest.mark.parametrize(("n", "short", "least"), [(8, False, 200), (3, True, 0)])
def test_near_copies_equal_brute_force(spark, n, short, least):
    rows = corpus()
    df = spark.createDataFrame([(t, k, "x", 0) for k, t in rows], "body string, no bigint, key string, h int")
    near = nearcopies.NearCopies(df, "no", "body", n, 0.7, least, short)
    want = brute_pairs([(k, t) for k, t in rows if k is not None], n, least)
    assert {(r.key_a, r.key_b) for r in near.pairs().collect()} == want
    parent = {}
    for a, b in sorted(want):
        parent[b] = min(parent.get(b, b), parent.get(a, a))
    changed = True
    while changed:
        changed = False
        for a, b in want:
            m = min(parent.get(a, a), parent.get(b, b))
            for x in (a, b):
                if parent.get(x, x) != m:
                    parent[x], changed = m, True
    groups = {r.key: r.class_id for r in near.groups().collect()}
    assert groups == {k: parent.get(k, k) for k, t in rows if k is not None and t is not None and len(t) >= least}


def test_near_copies_of_few_tokens(spark):
    # 17 and 24 distinct sequences: the two texts of a pair share 17 of 24
    rows, rng = [], random.Random(4)
    for i in range(400):
        a = "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(17))
        b = "".join(chr(0x4E00 + rng.randrange(20000)) for _ in range(7))
        rows += [(2 * i, a * 12), (2 * i + 1, a * 12 + b)]
    want = brute_pairs(rows, 8)
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {(r.key_a, r.key_b) for r in nearcopies.NearCopies(df, "id", "text", 8).pairs().collect()}
    print("found", len(got & want), "of", len(want))
    assert got == want and len(want) == 400


def test_many_copies_are_linked_to_one(spark):
    t, u = prose(60), None
    u = t + " end"
    df = spark.createDataFrame([(i, t) for i in range(nearcopies.EXPAND + 10)] + [(1000, u)], "id bigint, text string")
    got = {tuple(r) for r in nearcopies.NearCopies(df, "id", "text", 8).pairs().select("key_a", "key_b").collect()}
    assert got == {(0, i) for i in range(1, nearcopies.EXPAND + 10)} | {(0, 1000)}


def test_every_pair_can_be_listed(spark):
    t = prose(60)
    n = nearcopies.EXPAND + 10
    df = spark.createDataFrame([(i, t) for i in range(n)] + [(1000, t + " end")], "id bigint, text string")
    near = nearcopies.NearCopies(df, "id", "text", 8)
    assert {tuple(r) for r in near.pairs(None).collect()} == {(a, b, True) for a, b in itertools.combinations([*range(n), 1000], 2)}
    assert not any(r.listed for r in near.pairs().collect())


def test_copies_are_one_row_and_hot_filters_go_in_blocks(spark):
    t, other = prose(60), prose(60)
    texts = spark.createDataFrame([(i, t if i % 2 else t + " end") for i in range(64)] + [(99, other)], "id bigint, text string").repartition(16)
    plan = nearcopies.candidates(texts.where("id < 99"), 8, False)
    assert plan.count() == 1
    rng = random.Random(2)
    near = [(i, t + f" {rng.randrange(10**6)}") for i in range(60)]
    df = spark.createDataFrame(near, "id bigint, text string")
    whole, cut = (nearcopies.candidates(df, 8, False, b) for b in (2000, 7))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in cut.collect()} and whole.count() == 60 * 59 // 2


def test_a_key_with_two_texts_is_linked_by_the_right_one(spark):
    t, u = prose(60), prose(60)
    df = spark.createDataFrame([(1, t), (1, u), (2, u + " end"), (3, t + " end")], "id bigint, text string")
    assert {(r.key_a, r.key_b) for r in nearcopies.NearCopies(df, "id", "text", 8).pairs().collect()} == {(1, 2), (1, 3)}


def test_near_copies_of_nothing(spark):
    df = spark.createDataFrame([], "id bigint, text string")
    near = nearcopies.NearCopies(df, "id", "text", 8)
    assert near.pairs().count() == 0 and near.groups().count() == 0
    with pytest.raises(ValueError):
        nearcopies.NearCopies(df, "id", "text", 8, at_least=0.5)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a bigint, b bigint")
    assert {tuple(r) for r in nearcopies.components(links).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100)}


# -- encodings ---------------------------------------------------------------------------------------------------------

GERMAN = "Das Prüfbüro überarbeitete die Pläne für Köln; der größte Schaden lässt sich später beheben. Die Straße wäre schön. "
CHINESE = "采购小组按约定日期批准了会议纪要，这样每周可以节省一小时。仓储主管希望假期当中完成送货单，并通知现场工程师。"
RUSSIAN = "Проектный офис утверждает итоги совещания, хотя об этом никто не просил. Ночная смена дополняет товарную накладную. "


def test_garbled_text_is_found_and_restored(spark):
    clean = [GERMAN * 2, CHINESE * 2, RUSSIAN * 2, "Plain ASCII only. " * 5] * 1500
    bad = {
        1: (GERMAN.encode().decode("cp1252"), GERMAN),
        2: (CHINESE.encode("gb18030").decode("latin-1"), CHINESE),
        3: (RUSSIAN.encode().decode("cp1251", "ignore"), None),
        4: (GERMAN[:40] + GERMAN[40:].encode().decode("mac_roman"), GERMAN),
        5: (GERMAN.encode().decode("cp1252").encode().decode("cp1252"), GERMAN),
        6: (GERMAN.encode("cp1252").decode("utf-8", "replace"), None),
        7: (RUSSIAN.encode("cp1251").decode("latin-1"), RUSSIAN),
    }
    rows = [(k, t) for k, (t, _) in bad.items()] + [(1000 + i, t) for i, t in enumerate(clean)] + [(2000, None), (2001, ""), (None, "Ã¼"), (1, bad[1][0])]
    df = spark.createDataFrame([(k, t, "z") for k, t in rows], "id bigint, text string, repaired string")
    got = {r.key: r for r in encoding.garbled_rows(df).collect()}
    assert set(got) == set(bad)
    for k, (_, want) in bad.items():
        if want is not None:
            assert got[k].repaired == want
    assert not got[6].complete
    assert encoding.garbled_rows(df.limit(0)).count() == 0


@pytest.mark.parametrize("text, wrong", [(GERMAN, "latin-1"), (GERMAN, "mac_roman"), (CHINESE, "latin-1"), (GERMAN, None)])
def test_a_source_read_wrongly_is_found_however_large(spark, text, wrong):
    bad = text.encode().decode(wrong) if wrong else text.encode("cp1252").decode("utf-8", "replace")
    rows = [(i, bad if i % 10 < 4 else (GERMAN, CHINESE, RUSSIAN)[i % 3]) for i in range(3000)]
    got = {r.key: r.repaired for r in encoding.garbled_rows(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert set(got) == {i for i in range(3000) if i % 10 < 4}
    assert set(got.values()) == {text if wrong else bad}


def test_improbable_segments_equal_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(60):
        s = rng.integers(-4, 5, 30).astype(float)
        got = encoding.improbable_segments(s)
        best = max((s[a:b].sum() for a in range(30) for b in range(a + 1, 31)), default=0)
        if best > 0:
            assert max(s[a:b].sum() for a, b in got) == best
        assert all(b <= c for (_, b), (c, _) in itertools.pairwise(got))
        assert {i for i in range(30) if s[i] > 0} <= {i for a, b in got for i in range(a, b)}


# -- look-alikes -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("a", "b"),
    [("ＩＮＦＯ １", "INFO 1"), ("café", "café"), ("a​b­c﻿", "abc"), ("x y　z ", "x y z "), ("⼈口", "人口"), ("Рasannоn", "Pasannon"), ("раѕѕ", "pass"), ("ёлка", "ёлка"), ("пoчтa", "почта"), ("ο", "o"), ("ｶﾞ", "ガ")],
)
def test_equal_looks(a, b):
    assert a != b and lookalikes.one_form(a) == lookalikes.one_form(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("O", "0"), ("", " "), ("почта", "пачта")])
def test_visible_differences_stay(a, b):
    assert lookalikes.one_form(a) != lookalikes.one_form(b)


def test_consistent_script_spelling():
    assert lookalikes.one_form("офиc") == "офис" and lookalikes.one_form("оffice") == "office"
    known = lookalikes.KNOWN
    assert known.resolve("pac") == ("Latin", "Cyrillic", "Greek") and known.resolve("paж") == ("Cyrillic",) and known.resolve("fж") == ()


@pytest.mark.parametrize(
    ("a", "b"),
    [("口コミ", "ロコミ"), ("二月", "ニ月"), ("ニュース", "二ュース"), ("ꓚꓳꓟꓰ", "COME"), ("Ⲟⲣen", "Open"), ("ᏚᏢᎪ", "SPA"), ("力学", "カ学"), ("ＩＮＦＯ", "INFO"), ("раѕѕ", "pass"), ("ІВМ", "IBM")],
)
def test_equal_looks_of_the_public_list(spark, a, b):
    looks = lookalikes.looks_of(lookalikes.public_list(spark))
    assert a != b and looks.one_form(a) == looks.one_form(b)


@pytest.mark.parametrize("text", ["カタカナ", "ニュース", "二月八日", "工業力", "Ελλάδα", "Россия", "Հայաստան", "naïve café", "Il1 O0 rn m", "ß ı ø ð þ", "①②x²", "한국어", "日本語ー一ノ"])
def test_plain_text_stays_as_it_is(spark, text):
    looks = lookalikes.looks_of(lookalikes.public_list(spark))
    assert looks.one_form(text) == lookalikes.one_form(text)


def test_forms_of_many_texts_are_the_same():
    texts = ["", "abc", "ＩＮＦＯ１", "a\u200bb\u00adc", "cafe\u0301 \u212b", "⼈口", "Рasannоn ёлка", "\U000e0041x", "é", "ｶﾞ", "数，据。"]
    want = [lookalikes.one_form(t) for t in texts]
    assert lookalikes.one_forms(texts) == want and lookalikes.one_forms([*texts, "x\0y"]) == [*want, "x\0y"] and lookalikes.one_forms([]) == []


def test_lookalike_pairs(spark):
    rows = [(1, "Pass"), (2, "Рass"), (3, "Pass"), (4, None), (None, "Ρass"), (5, ""), (6, "​"), (2, "Рass"), (7, "x" * 50_000), (8, "х" * 50_000)]
    df = spark.createDataFrame([(t, k, 1) for k, t in rows], "name string, doc_id bigint, look int")
    assert {tuple(r) for r in lookalikes.lookalike_pairs(df, "doc_id", "name").collect()} == {(1, 2), (2, 3), (5, 6), (7, 8)}
    assert lookalikes.lookalike_pairs(df.limit(0), "doc_id", "name").count() == 0
    assert [r.o for r in lookalikes.normalize_column(df, "name", "o").where("doc_id is null or doc_id in (2, 4)").orderBy("doc_id").collect()] == ["Pass", "Pass", "Pass", None]


def test_lookalike_groups_and_many_copies(spark):
    n = lookalikes.EXPAND + 5
    rows = [(i, "Pass") for i in range(n)] + [(100, "Рass"), (101, "Рass"), (102, "alone")]
    df = spark.createDataFrame(rows, "doc_id bigint, name string")
    assert {tuple(r) for r in lookalikes.lookalike_pairs(df, "doc_id", "name").collect()} == {(0, 100), (0, 101)}
    assert lookalikes.lookalike_pairs(df, "doc_id", "name", None).count() == 2 * n
    got = {tuple(r) for r in lookalikes.lookalike_groups(df, "doc_id", "name").collect()}
    assert got == {(i, 0, 0, 2) for i in range(n)} | {(i, 0, 100, 2) for i in (100, 101)}


# -- fusion ------------------------------------------------------------------------------------------------------------


def test_fusion_equals_brute_force(spark):
    rows = [(q, f"d{RNG.randrange(12)}", RNG.choice([None, 0.0, 1.0, RNG.random() * 1e9, float("nan")]), RNG.choice([None, RNG.random()])) for q in (1, 1, 1, 1, 2) for _ in range(30)]
    df = spark.createDataFrame([*[(*r, "s") for r in rows], (None, "d", 1.0, 1.0, ""), (3, None, 1.0, 1.0, "")], "query_id bigint, document_id string, keyword double, semantic double, rank string")
    best = {}
    for q, d, k, s in rows:
        v = best.setdefault((q, d), [-np.inf, -np.inf])
        v[0], v[1] = max(v[0], -np.inf if k is None or k != k else k), max(v[1], -np.inf if s is None else s)
    want = {}
    for (q, d), v in best.items():
        p = [1 + sum(w[i] > v[i] for (r, _), w in best.items() if r == q) for i in (0, 1)]
        want[q, d] = (*p, round(1 / (60 + p[0]) + 1 / (60 + p[1]), 12))
    got = fusion.fuse(df, ["keyword", "semantic"]).collect()
    assert {(r.query_id, r.document_id): (r.place_keyword, r.place_semantic, r.rrf) for r in got} == want
    for q in (1, 2):
        ranks = sorted((r.rank, r.rrf) for r in got if r.query_id == q)
        assert [r for r, _ in ranks] == list(range(1, len(ranks) + 1)) and all(a >= b for (_, a), (_, b) in itertools.pairwise(ranks))
    first = {r.query_id: r.document_id for r in fusion.first_of_each(fusion.fuse(df, ["keyword", "semantic"])).collect()}
    assert all(want[q, d][2] == max(v[2] for (r, _), v in want.items() if r == q) for q, d in first.items())
    assert fusion.fuse(df.limit(0), ["keyword", "semantic"]).count() == 0


# -- splitting ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("text", ["a" * 2000, prose(400), ". ".join(prose(9) for _ in range(60)), CHINESE * 40, "x\n" * 900, "字" * 801, "𠮷" * 900])
def test_pieces_cover_the_text(text):
    cuts = splitting.cut_points(text)
    assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(b - a <= 800 for a, b in cuts)
    assert all(0 < a2 <= b1 < b2 and 50 <= b1 - a2 <= 150 for (_, b1), (a2, b2) in itertools.pairwise(cuts))


def test_hard_text_shares_exactly_the_overlap():
    assert splitting.cut_points("a" * 1600) == [(0, 800), (700, 1500), (1400, 1600)]
    assert splitting.cut_points("a" * 800) == [(0, 800)] and splitting.cut_points("") == [(0, 0)]


def test_cut_at_the_change_of_topic():
    one = " ".join(f"The copper pump needs {w} pressure and copper valves." for w in ("more", "less", "some", "high", "low", "safe", "full", "good", "slow", "fast"))
    two = " ".join(f"Garden flowers want {w} water and garden sunshine." for w in ("more", "less", "some", "warm", "cold", "soft", "full", "good", "slow", "fast"))
    (_, cut), *_ = splitting.cut_points(f"{one} {two} {one}", limit=800)
    assert cut == len(one) + 1


@pytest.mark.parametrize("after", ["b" * 500, "b, " * 170, "b " * 250])
def test_cut_at_the_only_sentence_end_of_the_window(after):
    text = "A" * 388 + ". " + after + "c" * 400
    cuts = splitting.cut_points(text)
    assert cuts[0] == (0, 390) and cuts[-1][1] == len(text)
    assert all(a1 < a2 <= b1 < b2 for (a1, b1), (a2, b2) in itertools.pairwise(cuts)) and all(b - a <= 800 for a, b in cuts)


def test_valleys_do_not_depend_on_the_slices(monkeypatch):
    text = ". ".join(prose(9) for _ in range(80))
    ends = np.array([i + 2 for i in range(len(text)) if text[i : i + 2] == ". "])
    whole = splitting.valleys(text, ends)
    monkeypatch.setattr(splitting, "SENTENCES", 7)
    assert np.allclose(whole, splitting.valleys(text, ends))


def test_early_sentence_ends_move_on():
    for seed in range(200):
        rng = random.Random(seed)
        text = "".join(rng.choice(["x" * rng.randrange(1, 900), "y. " * rng.randrange(1, 9), "z, ", "w "]) for _ in range(40))
        cuts = splitting.cut_points(text)
        assert cuts[0][0] == 0 and cuts[-1][1] == len(text) and all(b - a <= 800 for a, b in cuts)
        assert all(a1 < a2 <= b1 < b2 for (a1, b1), (a2, b2) in itertools.pairwise(cuts))


def test_resplit_numbers_anew(spark):
    rows = [(1, "d", 5, "a" * 900), (2, "d", 9, "b"), (2, "d", 9, "b"), (3, None, 0, None), (4, "e", None, ""), (None, "e", 1, "z" * 900)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id bigint, document_id string, position int, text string, piece int")
    got = sorted((r.document_id or "", r.position, r.chunk_id, r.piece, len(r.text or "")) for r in splitting.resplit(df).collect())
    assert got == [("", 0, 3, 0, 0), ("d", 0, 1, 0, 800), ("d", 1, 1, 1, 200), ("d", 2, 2, 0, 1), ("e", 0, 4, 0, 0)]
    assert splitting.split_rows(df.limit(0)).count() == 0


# -- vectors -----------------------------------------------------------------------------------------------------------


def test_neighbours_reach_the_recall(spark, monkeypatch):
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(30, 64))
    x = middle[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 64))
    x[2000:2100] = x[:100] + rng.normal(size=(100, 64)) * 0.05
    x[2500:2510] = x[2500]
    rows = [(i, [float(v) for v in r], "s") for i, r in enumerate(x)]
    rows += [(9000, [0.0] * 64, ""), (9001, [1.0] * 63, ""), (9002, [float("nan")] * 64, ""), (9003, None, ""), (None, [1.0] * 64, ""), rows[0]]
    df = spark.createDataFrame(rows, "chunk_id bigint, embedding array<double>, key string")
    monkeypatch.setattr(neighbours, "SHARD", 600)
    got = neighbours.Neighbours(df, "chunk_id").neighbours().collect()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1, kind="stable")[:, :5]
    found = {(r.key, r.neighbour) for r in got}
    kth = np.take_along_axis(s, best[:, 4:5], 1)[:, 0]
    assert sum(s[a, b] >= kth[a] - 1e-6 for a, b in found) >= 0.9 * 15000 and {a for a, _ in found} == set(range(3000))
    pairs = {tuple(sorted(p)) for p in neighbours.Neighbours(df, "chunk_id").pairs(0.9).select("key_a", "key_b").collect()}
    assert {(i, 2000 + i) for i in range(100)} <= pairs and {(2500, i) for i in range(2501, 2506)} <= pairs
    assert neighbours.Neighbours(df.limit(0), "chunk_id").neighbours().count() == 0


@pytest.mark.parametrize(("piece", "flat"), [(100_000, 1024), (150, 1024), (100_000, 16)])
def test_neighbours_reach_the_recall_over_hundreds_of_shards(spark, monkeypatch, piece, flat):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(6000, 12)) @ rng.normal(size=(12, 64)) + rng.normal(size=(6000, 64)) * 0.1
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "chunk_id bigint, embedding array<double>")
    monkeypatch.setattr(neighbours, "SHARD", 20)
    monkeypatch.setattr(neighbours, "LARGE", 1)
    monkeypatch.setattr(neighbours, "SLICE", piece)
    monkeypatch.setattr(neighbours, "FLAT", flat)
    found = {(r.key, r.neighbour) for r in neighbours.Neighbours(df, "chunk_id").neighbours().collect()}
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :5]
    recall = sum((a, int(b)) in found for a in range(6000) for b in best[a]) / 30_000
    print("recall", recall)
    assert recall >= 0.9


def _shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    none = sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(sc._jvm.java.util.ArrayList(), False, False, none, sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_neighbours_shuffle_no_copy_for_each_cell_searched(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(8000, 10)) @ rng.normal(size=(10, 64)) + rng.normal(size=(8000, 64)) * 0.1
    x[:500] = x[0] + rng.normal(size=(500, 64)) * 0.01  # a dense cell, cut into parts
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id bigint, embedding array<double>")
    monkeypatch.setattr(neighbours, "SHARD", 20)
    monkeypatch.setattr(neighbours, "LARGE", 1)
    monkeypatch.setattr(neighbours, "SLICE", 400)
    search = neighbours.Neighbours(df, "id")
    assert neighbours.probes(400) > 16
    before = _shuffled(spark)
    found = {(r.key, r.neighbour) for r in search.between_points().collect()}
    assert _shuffled(spark) - before < 4 * x.size * 4
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = y @ y.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :5]
    assert len(found) == 40_000 and sum((a, int(b)) in found for a in range(8000) for b in best[a]) >= 0.95 * 40_000
    assert not glob.glob(f"{shared_dir(spark).removeprefix('file://')}/cells-*")


def test_graph_is_exact_on_few_points():
    x = np.random.default_rng(2).normal(size=(20, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = graphs.beam_search(x, graphs.build(x), x, 8)
    assert (ids == np.argsort(-(x @ x.T), axis=1)[:, :8]).mean() > 0.99


# -- tokens ------------------------------------------------------------------------------------------------------------


def test_ids_equal_the_library(spark):
    import tiktoken

    path, pattern = tokens.default_vocabulary(), tokens.default_pattern()
    bpe = tokens.encoder(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.ranks, special_tokens={})
    letters = "aeiou stn'\n\t 　的电éßя0²½😀\x1c<|endoftext|>"
    texts = [None, "", " ", "\n\n  x", GERMAN, CHINESE, RUSSIAN, "a" * 5000, "<|endoftext|>", *["".join(RNG.choice(letters) for _ in range(RNG.randrange(40))) for _ in range(400)]]
    df = spark.createDataFrame([(t, i, 0) for i, t in enumerate(texts)], "text string, doc_id bigint, ids int")
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    assert got == {i: library.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_own_merging_equals_the_library():
    bpe = tokens.encoder(tokens.default_vocabulary(), tokens.default_pattern())
    rng = random.Random(8)
    words = ["a" * 3000, "ab" * 500, "电" * 40, *["".join(rng.choice("aeinrst电éß") for _ in range(rng.randrange(1, 30))) for _ in range(500)]]
    for w in words:
        assert [bpe.ranks[p] for p in bpe._merge(w.encode())] == bpe.exact(w.encode())


# -- leaks -------------------------------------------------------------------------------------------------------------


def test_leaks_equal_brute_force(spark):
    items = [(i, prose(20, random.Random(i))) for i in range(12)] + [(50, CHINESE), (51, None), (52, "short"), (None, "x" * 60)]
    docs = []
    for i in range(60):
        t = prose(40, random.Random(1000 + i))
        item = items[i % 13][1]
        a, n = RNG.randrange(20), 30 + i
        docs.append((i, t[:50] + (item[a : a + n].upper().replace(" ", " -- ") if i % 2 else "") + t[50:]))
    docs += [(100, None), (101, ""), (102, items[0][1] * 30), (None, items[1][1])]
    a = spark.createDataFrame([(t, k, 1) for k, t in docs], "text string, doc_id bigint, key int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    norm = lambda t: "".join(c.lower() for c in t if c.isalnum())
    want = set()
    for k, t in docs:
        for j, s in items:
            if None not in (k, t, j, s):
                x, y = norm(t), norm(s)
                if any(y[i : i + 40] in x for i in range(len(y) - 39)):
                    want.add((k, j))
    got = leaks.leaks(a, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    by = dict(docs)
    for r in got:
        assert norm(by[r.doc_id])[r.start : r.start + r.length] in norm(dict(items)[r.item_id])
    assert leaks.without_leaks(a, leaks.leaks(a, b)).count() == len(docs) - len({k for k, _ in want})
    assert leaks.leaks(a.limit(0), b).count() == 0 and leaks.leaks(a, b.limit(0)).count() == 0


def test_suffixes_are_sorted():
    rng = random.Random(9)
    for text in ["ab" * 300, "a" * 500, "".join(rng.choice("ab") for _ in range(800)), prose(100, rng), ""]:
        chars, edges = leaks.reduce_text([text])
        array = leaks.SuffixArray(chars, edges, 200)
        whole = "".join(map(chr, chars))
        suffixes = [whole[i : i + 200].ljust(200, "\0") for i in array.at.tolist()]
        assert suffixes == sorted(suffixes) and sorted(array.at.tolist()) == list(range(0, len(whole), leaks.STEP))


def test_longest_match_is_found():
    rng = random.Random(5)
    for _ in range(30):
        a, b = ("".join(rng.choice("abc") for _ in range(300)) for _ in range(2))
        shared = "".join(rng.choice("xyz") for _ in range(rng.randrange(40, 90)))
        a, b = a[:100] + shared + a[100:], b[:7] + shared + b[7:]
        codes = [np.array([ord(c) for c in t], np.uint32) for t in (a, b)]
        start, length = leaks.longest_common(*codes, 40)
        assert a[start : start + length] in b and length >= len(shared)
        assert not any(a[i : i + length + 1] in b for i in range(len(a) - length))


def test_repeats_do_not_multiply():
    import tracemalloc

    items = leaks.Items([1], ["ab" * 2000], 40)
    tracemalloc.start()
    chars, edges = leaks.reduce_text(["ab" * 320_000, "zz"])
    doc, item, start, length = items.matches(leaks.SuffixArray(chars, edges, items.depth))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (doc.tolist(), item.tolist(), start.tolist(), length.tolist()) == ([0], [0], [0], [4000]) and most < 200e6


# -- languages ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def samples(spark):
    return spark.read.parquet("/root/testdata/sf0.001/lang_samples.parquet")


def test_held_out_accuracy(samples):
    rows = [(r.lang, r.text) for r in samples.select("lang", "text").collect()]
    random.Random(4).shuffle(rows)
    model = languages.Model(rows[:200])
    got = languages.Spans(model).label([t for _, t in rows[200:]])
    assert sum(model.languages[m] == lang for (m, _, _), (lang, _) in zip(got, rows[200:], strict=True)) >= 0.98 * len(got)


@pytest.mark.parametrize(
    "text",
    [
        "오늘 회의에서 다음 분기의 예산과 일정에 대해 논의했습니다. 모든 부서가 자료를 제출했습니다.",
        "今日の会議では来期の予算について話し合いました。すべての部署が資料を提出しました。",
        "Сьогодні ми їдемо до міста, бо її сім'я живе біля річки. Це був найкращий день у цій країні, і всі її діти сміялися.",
        "ناقشنا اليوم في الاجتماع ميزانية الربع القادم والجدول الزمني وقدمت جميع الأقسام وثائقها.",
        "Σήμερα συζητήσαμε τον προϋπολογισμό του επόμενου τριμήνου και όλα τα τμήματα υπέβαλαν έγγραφα.",
    ],
)
def test_languages_without_samples_are_another(samples, text):
    model = languages.Model([(r.lang, r.text) for r in samples.select("lang", "text").collect()])
    ((main, sure, _),) = languages.Spans(model).label([text])
    assert model.languages[main] == languages.OTHER and sure > 0.5


def test_languages_are_those_of_the_samples(spark):
    rows = [("el", "Σήμερα συζητήσαμε τον προϋπολογισμό"), ("en", "Today we talked about the budget of the next quarter"), ("ko", "오늘 회의에서 예산을 논의했습니다"), (None, "x"), ("en", None)]
    fitted = languages.fit(spark.createDataFrame(rows, "lang string, text string"))
    model = languages.Model(fitted)
    assert model.languages == ["el", "en", "ko", "other"]
    assert [model.languages[m] for m, _, _ in languages.Spans(model).label(["Σήμερα τον", "회의에서", "the budget", "это не то"])] == ["el", "ko", "en", "other"]


def test_frequent_words_are_counted_by_themselves(spark, samples, monkeypatch):
    text = {}
    for r in samples.select("lang", "text").orderBy("sample_id").collect():
        text.setdefault(r.lang, []).append(r.text)
    rows = [(" ".join(text[x][:8]) + f" Quorbel{i} Zantrip",) for i in range(20) for x in ("en", "de")]
    words, sums = languages.corpus_words(spark.createDataFrame(rows, "text string"), languages.fit(samples))
    names = sorted(text)
    assert words["zantrip"][[names.index("en"), names.index("de")]].tolist() == [20, 20] and "quorbel1" not in words
    monkeypatch.setattr(languages, "FREQUENT", 1.0)
    assert all(v.sum() >= 40 for v in languages.corpus_words(spark.createDataFrame(rows, "text string"), languages.fit(samples))[0].values())


def test_labels_and_mixed_documents(spark, samples):
    text = {}
    for r in samples.select("lang", "text").orderBy("sample_id").collect():
        text.setdefault(r.lang, []).append(r.text)
    join = lambda lang, n: " ".join(text[lang][:n])
    rows = [(1, "EN-us", join("en", 8)), (2, None, join("de", 8)), (3, "zho", join("fr", 8)), (4, "en", join("en", 8) + " " + "".join(text["zh"][:4]) + " " + join("en", 4))]
    rows += [(5, "es", None), (6, "es", " \n"), (7, "pt", "12345 -- 99"), (8, "rus", join("ru", 6)), (8, "rus", join("ru", 6)), (9, "und", join("es", 8)), (None, "x", "y")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id bigint, lang string, text string, begin int")
    got = {tuple(r) for r in languages.findings(df, samples).collect()}
    assert got == {(2, "label", "de"), (3, "label", "fr"), (4, "mixed", "en"), (4, "mixed", "zh"), (9, "label", "es")}
    assert all(0 < r.confidence <= 1 and 0 < r.span_confidence <= 1 for r in languages.spans(df, samples).collect())
    assert languages.findings(df.limit(0), samples).count() == 0


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        s = rng.normal(size=(6, 3)) * 4
        value = lambda p, s=s: sum(s[i, k] for i, k in enumerate(p)) - 5 * sum(a != b for a, b in itertools.pairwise(p))
        assert value(languages.viterbi(s, 5).tolist()) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=6)))


def test_labels_are_compared_by_language(spark):
    df = spark.createDataFrame([(x,) for x in ("ZH_Hans", "zh-CN", "deu", " ", None, "unknown", "nl", "pt-BR")], "l string")
    assert [r[0] for r in df.select(languages.normal_label(F.col("l"))).collect()] == ["zh", "zh", "de", None, None, None, "nl", "pt"]
