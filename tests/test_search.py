import math
import sqlite3

import pytest

from talkloom.functions.hangul import decompose_jamo, jamo
from talkloom.operators import search

M = "chat_id long, message_id long, timestamp long, text string"
KOREAN = [(1, 1, 1000, "삼성전자 주가가 상승했다"), (1, 2, 1001, "삼성 전자 실적 발표"), (1, 3, 1002, "대한민국 만세"), (1, 4, 1003, "오늘 날씨가 좋다"), (1, 5, 1004, "Apple Galaxy 비교")]


def find(rows, data, q):
    plan = search.plan_query(q)
    df = search.bm25(rows(M, data), q) if plan.ranked else search.contains_all(rows(M, data), q)
    return {r.message_id for r in df.collect()}


@pytest.mark.parametrize(("q", "want"), [("삼성", {1, 2}), ("삼성전자", {1, 2}), ("ㅅㅏㅁ", {1, 2}), ("ㅅㅏ", {1, 2}), ("apple", {5}), ("", set()), ("  ", set())])
def test_korean(rows, q, want):
    assert find(rows, KOREAN, q) == want


def test_plan():
    assert not search.plan_query("a").ranked and not search.plan_query("ㅅ").ranked
    assert search.plan_query("ab bitcoin").variants[0] == ("bitcoin",)


def test_jamo(rows):
    want = {"삼": "ㅅㅏㅁ", "가": "ㄱㅏ", "닭": "ㄷㅏㄺ", "삼성전자": "ㅅㅏㅁㅅㅓㅇㅈㅓㄴㅈㅏ", "a😀": "a😀", "": "", None: None}
    from pyspark.sql import functions as F

    got = rows("t string", [(t,) for t in want]).select("t", decompose_jamo(F.col("t")).alias("j")).collect()
    assert {r.t: r.j for r in got} == want
    assert all(jamo(t) == j for t, j in want.items() if t)


def test_order_of_near_equal_and_of_stronger_rows(rows):
    page = lambda data, q: [r.timestamp for r in search.page(search.bm25(rows(M, data), q)).orderBy("position").collect()]
    assert page([(1, 1, 1000, "test old"), (1, 2, 2000, "test new"), (1, 3, 1500, "test mid")], "test") == [2000, 1500, 1000]
    assert page([(1, 1, 1000, "bitcoin etf bitcoin etf bitcoin etf"), (1, 2, 2000, "bitcoin and something else about an etf for a while")], "bitcoin etf")[0] == 1000


def test_pages(rows):
    hits = search.bm25(rows(M, [(1, i, 100 + i, f"test message {i}") for i in range(5)]), "test")
    sizes, cursor = [], None
    for _ in range(3):
        got = search.page(hits, 2, cursor).orderBy("position").collect()
        sizes.append((len(got), got[0].has_more))
        cursor = [got[-1][c] for c, _ in search.ORDER]
    assert sizes == [(2, True), (2, True), (1, False)]


def test_highlights():
    assert search.highlights("Hello", ["Hello"]) == [(0, 5)]
    assert search.highlights("abcabc", ["abc", "bca"]) == [(0, 6)]
    assert search.highlights("삼성전자 주가", ["삼성"]) == [(0, 6)]
    assert search.highlights("", ["x"]) == [] and search.highlights("x", [""]) == []


def test_bm25_equals_sqlite(rows):
    """The same three columns in SQLite's own full-text index."""
    texts = ["bitcoin etf today", "the bitcoin", "nothing here", "etf etf etf bitcoin", "삼성 bitcoin", "aaaa aaa bitcoin aaa"]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(content, jamo, nospace, tokenize='trigram')")
    for t in texts:
        db.execute("insert into f values (?, ?, ?)", (t, jamo(t), t.replace(" ", "")))
    for q, match in (("bitcoin", '"bitcoin"'), ("aaa", '"aaa"')):
        want = {r: s for r, s in db.execute(f"select rowid, bm25(f) from f where f match '{match}'")}
        got = {r.message_id: r.rank for r in search.bm25(rows(M, [(1, i + 1, i, t) for i, t in enumerate(texts)]), q).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[k], want[k], abs_tol=2e-6) for k in want), (got, want)


def test_nulls_empty_and_repeats(rows):
    assert search.bm25(rows(M), "test").collect() == []
    got = search.bm25(rows(M, [(1, 1, 5, "test"), (1, 1, 3, "test"), (1, 2, 1, None), (1, 3, 1, ""), (1, 4, 1, "x" * 100_000 + "test")]), "test").collect()
    assert sorted((r.message_id, r.timestamp) for r in got) == [(1, 3), (4, 1)]


def test_index_gives_what_the_scan_gives(rows, tmp_path):
    from talkloom.operators.search_index import SearchIndex

    data = [(1, i, 100 + i, t) for i, t in enumerate(["bitcoin etf today", "the bitcoin", None, "", "etf etf bitcoin", "삼성전자 주가", "삼성 전자 실적", "a\u00a0b c d e f", "AAAA aaa", "x" * 5000 + "bitcoin", "ㅅㅏㅁ"])]
    data += [(1, 0, 50, "bitcoin etf today"), (2, 0, 1, "𝒜𝒜𝒜 bit coin")]
    index = SearchIndex.build(rows(M, data), f"file://{tmp_path}/i", 3, 2)
    order = ["chat_id", "message_id"]
    for q in ("bitcoin", "bitcoin etf", "삼성전자", "aaa", "nowhere bitcoin", "nowhere", "bitcoin\tETF today", "𝒜𝒜𝒜", "bitc oin"):
        assert index.bm25(q).orderBy(order).collect() == search.bm25(rows(M, data), q).orderBy(order).collect(), q
    for q in ("ㅅㅏ", "ㅅㅏㅁ", "삼성", "", "b c", "bitcoin et", "nowhere", "삼성 전자"):
        assert index.contains_all(q).orderBy(order).collect() == search.contains_all(rows(M, data), q).orderBy(order).collect(), q
    empty = SearchIndex.build(rows(M), f"file://{tmp_path}/e")
    assert empty.bm25("bitcoin").collect() == empty.contains_all("bitcoin").collect() == []
