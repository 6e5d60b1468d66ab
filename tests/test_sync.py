import datetime as dt

from pyspark.sql import functions as F

from talkloom.operators import merge, sync


def test_events_in_any_order_with_repeats_nulls_and_deletes(rows):
    s = "u long, seq long, kind string, v long"
    data = [(1, 1, "set", 5), (1, 3, "set", 7), (1, 3, "set", 7), (1, 2, "gone", None), (2, 1, "set", 1), (2, 2, "gone", None), (3, 1, "other", 9), (None, 1, "set", 1), (4, None, "set", 1), (5, 1, "gone", None), (5, 2, "set", None)]
    run = lambda d: sorted(tuple(r) for r in sync.apply_events(rows(s, d), "u", "seq", "kind", {"a": (("set",), F.col("v")), "b": (("other",), F.col("v"))}, ("gone",)).collect())
    assert run(data) == run(data[::-1]) == [(1, 7, None, 3), (3, None, 9, 1), (5, None, None, 2)] and run([]) == []


def test_soft_deletes(rows):
    day = lambda n: dt.datetime(2025, 1, n)
    t = rows("k long, version long, deleted_at timestamp", [(1, 5, None), (2, 5, day(1)), (3, 9, day(1)), (4, 1, day(20))])
    assert [r.k for r in sync.live(t).collect()] == [1]
    got = sync.compactable(t, F.lit(day(31)), "version", F.lit(7)).collect()
    assert [r.k for r in got] == [2]


def test_evidence_caches_and_purge(rows):
    e = rows("g long, t long, r double", [(1, 1, 0.5), (1, 2, None), (1, 3, 0.9), (1, 9, 0.1), (2, 8, None), (None, 1, 1.0)])
    parts = sorted((r.g or 0, r.t, r.part) for r in sync.rewrite_evidence(e, "g", "t", F.lit(5), [F.desc_nulls_last("r")], 2).collect())
    assert parts == [(0, 1, "rest"), (1, 1, "rest"), (1, 3, "rest"), (1, 9, "delta"), (2, 8, "delta")]
    assert sorted((r.g or 0, r.t) for r in sync.sweep(e, rows("g long, bound long", [(1, 3)]), "g", "t").collect()) == [(0, 1), (1, 9), (2, 8)]
    s = "w string, mark long, x long"
    cache, new = rows(s, [("a", 5, 1), ("a", 5, 2), ("b", 5, 3)]), rows(s, [("a", 6, 4), ("b", 5, 9), ("c", 1, 7)])
    assert sorted(tuple(r) for r in sync.replace_if_newer(cache, new, "w", "mark").collect()) == [("a", 6, 4), ("b", 5, 3), ("c", 1, 7)]
    links = rows("topic_id long, chat_id long", [(1, 1), (1, 2), (2, 1)])
    left = sync.purge_cascade(rows("chat_id long", [(1,), (2,)]), links, rows("topic_id long", [(1,), (2,), (3,)]), rows("chat_id long", [(1,), (1,)]))
    assert [sorted(tuple(r) for r in x.collect()) for x in left] == [[(2,)], [(2, 1)], [(1,), (3,)]]
    texts = rows("g long, t long, id long, x string", [(1, 2, 7, "a"), (1, 1, 8, "a"), (1, 5, 9, None), (1, 6, 3, ""), (2, 1, 1, "a")])
    assert sorted(tuple(r) for r in sync.freeze_citations(texts, "g", "x", ["t"], ["id"], 4).collect()) == [(1, 8, 4), (1, 9, 4), (2, 1, 4)]


def test_moves(rows):
    s = "k string, p int, q int"
    old = rows(s, [("a", 1, 3), ("b", 2, 2), ("c", 3, 1), ("d", 4, 0)])
    new = rows(s, [("a", 1, 3), ("b", 2, 2), ("c", 3, 1), ("e", 5, 9)])
    got = merge.diff(old, new, ["k"], ["p"], 4, ["q"])
    assert {(r.k, r.op, r.old_index, r.new_index) for r in got.collect()} == {("d", "D", 3, None), ("e", "I", None, 3), ("a", "M", 0, 2), ("c", "M", 2, 0)}
    assert merge.diff(old, old, ["k"], ["p"], 4).collect() == [] == merge.diff(old.limit(0), old.limit(0), ["k"], ["p"], 4, ["q"]).collect()
