import math

from pyspark.sql import functions as F

from talkloom.functions import text as tx
from talkloom.operators import topics as tp
from talkloom.operators.components import components


def one(rows, column, value):
    return rows("v string", [(value,)]).select(column(F.col("v")).alias("r")).first().r


def test_titles(rows):
    assert one(rows, tx.normalize_topic_title, "ETH Layer 2 Fees") == "ethlayer2fees"
    assert one(rows, tx.normalize_topic_title, "Bitcoin Price Update") == "bitcoinprice"
    assert one(rows, tx.normalize_topic_title, "BTC") == "btc"
    assert one(rows, tx.normalize_topic_title, "news") == "news"
    assert one(rows, tx.titlecase, " DeFi  and nfts ") == "DeFi And Nfts"
    assert one(rows, tx.title_norm, "  Bitcoin   ETF\tNews ") == "bitcoin etf news"
    assert one(rows, tx.title_norm, "１２ a") == "12 a"
    assert one(rows, tx.normalize_topic_title, None) is None


def test_words(rows):
    df = rows("a string, b string", [("the bitcoin price rally", "bitcoin price"), ("ethereum fees", "solana fees drop now"), ("", "x y")])
    got = [r[0] for r in df.select(tx.overlap(tx.significant_words(F.col("a")), tx.significant_words(F.col("b")))).collect()]
    assert got == [1.0, 0.5, 0.0]


def test_texts(rows):
    assert one(rows, lambda c: tx.shorten(c, 3), "abcdef") == "abc"
    assert one(rows, lambda c: tx.shorten(c, 6, "middle"), "abcdefghi") == "a...hi"
    assert one(rows, tx.mrz_check_digit, "520727") == 3
    assert one(rows, tx.mrz_check_digit, "5a") is None
    assert one(rows, tx.other_layout, "ЕУЫЕ") == "test"
    assert one(rows, tx.extract_emoji, "a 👩‍💻b ❤️") == ["👩‍💻", "❤️"]
    assert one(rows, tx.only_emoji, "👍 🔥") and not one(rows, tx.only_emoji, "👍 x")
    assert one(rows, tx.nfc_char_count, "é") == 1
    assert one(rows, lambda c: tx.fuzzy_prefix_hits(c, "logistic"), "the logistics of log") == ["logistics"]
    h = lambda *p: rows("x int", [(1,)]).select(F.hex(tx.evidence_hash(*map(F.lit, p)))).first()[0]
    assert h(1, 2, 3) == h(1, 2, 3) != h(12, 3, 3) and len(h(1, 2, 3)) == 32


def test_trending_is_monotone(rows):
    def score(count, last, day, week, channels, total, now):
        return rows("x int", [(1,)]).select(tp.trending_score(*map(F.lit, (count, last, day, week, channels, total, now)))).first()[0]

    assert score(0, 0, 5, 5, 1, 1, 10) == 0
    assert score(5, 1000, 5, 7, 1, 2, 1000) > score(5, 0, 5, 7, 1, 2, 1000)
    assert score(5, 0, 6, 7, 1, 2, 1000) > score(5, 0, 5, 7, 1, 2, 1000)
    assert score(5, 0, 5, 7, 2, 2, 1000) > score(5, 0, 5, 7, 1, 2, 1000)
    assert math.isclose(score(7, 3600, 7, 7, 1, 1, 3600), 7 * 3)


def test_majority_needs_more_than_ten_and_sixty_percent(rows):
    data = [(1, "a")] * 7 + [(1, "b")] * 4 + [(2, "a")] * 10 + [(3, None)] * 9 + [(3, "a")] * 5 + [(4, "b")] * 6 + [(4, "a")] * 6
    got = tp.majority_category(rows("topic_id long, assigned_category string", data)).collect()
    assert [(r.topic_id, r.category, r.votes, r.message_count) for r in got] == [(1, "a", 7, 11)]


def test_categories(rows):
    known = rows("category_id long, name string", [(1, "Token Markets"), (2, "Other"), (3, None)])
    raw = rows("raw string, category_id_x int", [("token markets ", 1), ("markets", 2), ("the token markets today", 3), ("", 4), (None, 5), ("zzz", 6), ("zzz", 6), ("coins", 7)])
    synonyms = rows("alias string, name string", [("coins", "Token Markets")])
    got = tp.resolve_category(raw, "raw", known, synonyms)
    assert sorted((r.category_id_x, r.category_id) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, None), (6, None), (7, 1)]
    assert [(r.category_id, r.name) for r in tp.new_categories(got, "raw", known).collect()] == [(4, "Zzz")]


def test_categories_beyond_any_cap(rows, spark):
    from pyspark.sql import functions as F

    n = 20_000
    known = spark.range(n).select(F.col("id").alias("category_id"), F.concat(F.lit("Kind "), F.col("id").cast("string"), F.lit("x")).alias("name"))
    raw = rows("raw string", [("kind 19999x",), ("about kind 15000x here",), ("d 12345x",), ("nothing",), ("x",)])
    got = {r.raw: r.category_id for r in tp.resolve_category(raw, "raw", known).collect()}
    assert got == {"kind 19999x": 19999, "about kind 15000x here": 15000, "d 12345x": 12345, "nothing": None, "x": 0}
    assert [(r.category_id, r.name) for r in tp.new_categories(tp.resolve_category(raw, "raw", known), "raw", known).collect()] == [(n, "Nothing")]


def test_components(rows):
    import random

    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, i) for i in range(2000, 2200)] + [(9, 9), (8888, 8888), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(rows("a long, b long", edges)).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(rows("a long, b long")).collect() == []


def test_components_that_are_not_done(rows):
    import pytest

    from talkloom.operators.components import components

    path = rows("a long, b long", [(i, i + 1) for i in range(300)])
    with pytest.raises(RuntimeError):
        components(path, rounds=1)
    assert {tuple(r) for r in components(path).collect()} == {(i, 0) for i in range(301)}
