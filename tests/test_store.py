import json

import pytest
from pyspark.sql import functions as F

from talkloom.operators import lists, merge
from talkloom.sources import store
from talkloom.streaming import changelog, rollup


def test_upsert_counts_and_delete(rows):
    s = "chat_id long, message_id long, text string"
    empty, first, second = rows(s), rows(s, [(1, 1, "a")]), rows(s, [(1, 1, "b")])
    count = lambda old, new: tuple(merge.upsert_counts(old, new, ["chat_id", "message_id"], ["text"]).first())
    assert count(empty, first) == (1, 0, 0) and count(first, second) == (0, 1, 0) and count(first, first) == (0, 0, 1)
    now = merge.upsert(first, second, ["chat_id", "message_id"])
    assert [tuple(r) for r in now.collect()] == [(1, 1, "b")]
    assert merge.delete_refs(now, first, ["chat_id", "message_id"]).collect() == []


def test_kept_and_filled_columns(rows):
    s = "k long, title string, o string"
    old, new = rows(s, [(1, "a", "x"), (2, "b", None)]), rows(s, [(1, None, "y"), (3, "c", "z")])
    got = {tuple(r) for r in merge.upsert(old, new, ["k"], keep=["o"], fill=["title"]).collect()}
    assert got == {(1, "a", "x"), (2, "b", None), (3, "c", "z")}
    assert {tuple(r) for r in merge.partial_update(old, rows("k long, o string", [(2, "q"), (9, "q")]), ["k"]).collect()} == {(1, "a", "x"), (2, "b", "q")}
    assert {tuple(r) for r in merge.insert_if_absent(old, rows(s, [(1, "n", "n"), (4, "n", "n"), (4, "m", "n")]), ["k"]).collect()} == {(1, "a", "x"), (2, "b", None), (4, "m", "n")}


def test_ids_and_diff(rows):
    got = merge.next_ids(rows("v string", [(c,) for c in "edcba"]), "id", 10, ["v"], 3)
    assert sorted((r.id, r.v) for r in got.collect()) == [(11, "a"), (12, "b"), (13, "c"), (14, "d"), (15, "e")]
    s = "k string, v int"
    d = merge.diff(rows(s, [("a", 1), ("b", 2), ("c", 3)]), rows(s, [("a", 1), ("c", 4), ("d", 5)]), ["k"], ["k"])
    assert {tuple(r) for r in d.collect()} == {("b", "D", 1, None), ("c", "U", 2, 1), ("d", "I", None, 2)}


def test_ingest(spark, tmp_path):
    lines = [{"chat_id": 1, "message_id": 1, "sender_id": None, "timestamp": 5, "text": "삼성 전자"}, {"chat_id": 1, "message_id": 2, "sender_id": 4, "timestamp": 6, "text": ""}]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, lines)))
    got = {r.message_id: (r.sender_id, r.text_stripped, r.op) for r in store.read_batch(spark, f"file://{tmp_path}").collect()}
    assert got == {1: (0, "삼성전자", "U"), 2: (4, "", "D")}


def test_ops_with_bad_lines(spark, tmp_path):
    (tmp_path / "ops.txt").write_text('{"op": "put", "seq": 3, "payload": {"k": 1}}\nnot json\n\n{"op": "del"}\n')
    got = [(r.op, r.status) for r in store.read_ops(spark, f"file://{tmp_path}/ops.txt", "k: long").collect()]
    assert sorted(got, key=str) == [("del", "error"), ("put", "ok"), (None, "error")]


def test_settings_and_sealed_values(rows):
    df = rows("v string", [("5",), ("x",), (None,)])
    assert [r[0] for r in df.select(store.setting(F.col("v"), 9)).collect()] == [5, 9, 9]
    key = F.lit(b"0123456789abcdef0123456789abcdef")
    sealed = df.where("v = '5'").select(store.seal(F.col("v").cast("binary"), key).alias("s"))
    assert sealed.select(F.length("s")).first()[0] == 12 + 1 + 16
    assert bytes(sealed.select(store.unseal(F.col("s"), key)).first()[0]) == b"5"
    assert rows("s binary", [(b"short",)]).select(store.unseal(F.col("s"), key)).first()[0] is None


def test_versions_are_whole_and_batches_count_once(spark, rows, tmp_path):
    t = store.VersionedTable(spark, f"file://{tmp_path}/t", "k long, n long")
    assert t.version() == 0 and t.read().collect() == []
    assert t.commit(rows("k long, n long", [(1, 1)]), 0) == 1
    assert t.commit(rows("k long, n long", [(2, 2)]), 0) == 1
    assert t.commit(t.read().unionByName(rows("k long, n long", [(2, 2)])), 1) == 2
    assert t.read().count() == 2 and t.read(1).count() == 1
    t.truncate()
    assert t.read().count() == 0


def test_only_touched_parts_are_written(spark, rows, tmp_path):
    s = "k long, n long"
    t = store.VersionedTable(spark, f"file://{tmp_path}/b", s, ["k"], 8)
    t.commit(rows(s, [(i, 0) for i in range(40)]))
    before = t.parts()
    change = rows(s, [(3, 9), (77, 9)])
    touched = set(t.parts_of(change))
    t.merge(change, lambda old, new: old.join(new.select("k"), "k", "left_anti").unionByName(new), 5)
    now = t.parts()
    assert {p for p in now if now[p] != before.get(p)} == touched and len(touched) <= 2
    assert {tuple(r) for r in t.read().collect()} == {(i, 0) for i in range(40) if i != 3} | {(3, 9), (77, 9)}
    assert t.merge(change, lambda old, new: new, 5) == 2  # a batch that came before
    with pytest.raises(ValueError):
        t.commit(rows(s, [(i, 1) for i in range(40)]), only=["0"])
    assert t.version() == 2
    t.merge(rows(s, [(3, 1)]), lambda old, new: old.where("k <> 3"))
    assert t.read().where("k = 3").count() == 0
    assert t.vacuum() == 0 or t.read().count() == 40
    assert t.read().count() == 40


def test_a_fault_of_the_file_system_is_no_empty_table(spark, rows, tmp_path):
    t = store.VersionedTable(spark, f"file://{tmp_path}/f", "k long")
    t.commit(rows("k long", [(1,)]))

    class Broken:
        def __init__(self, fs):
            self.fs = fs

        def listStatus(self, path):
            raise OSError("away")

        def __getattr__(self, name):
            return getattr(self.fs, name)

    fs, t._fs = t._fs, Broken(t._fs)
    with pytest.raises(OSError):
        t.commit(rows("k long", [(2,)]))
    t._fs = fs
    assert t.version() == 1 and [r.k for r in t.read().collect()] == [1]


def test_replay_and_gaps(rows):
    s = "k long, version long, text string"
    state = rows(s, [(1, 2, "a"), (2, 5, "b"), (3, 1, "c")])
    changes = rows(s + ", op string", [(1, 3, "a3", "U"), (1, 3, "a3", "U"), (2, 4, "old", "U"), (3, 2, None, "D"), (4, 1, "n", "U"), (4, 0, "o", "U")])
    once = changelog.replay(state, changes, ["k"])
    assert {tuple(r) for r in once.collect()} == {(1, 3, "a3"), (2, 5, "b"), (4, 1, "n")}
    assert changelog.needs_snapshot(4, 6) and not changelog.needs_snapshot(5, 6)
    assert [tuple(r) for r in changelog.gaps(rows("c int, n long", [(1, 1), (1, 5), (1, 6)]), ["c"], "n", 4).collect()] == [(1, 2, 4)]
    left = changelog.purge({"m": rows("chat_id long", [(1,), (2,)]), "x": rows("k long", [(1,)])}, rows("chat_id long", [(1,)]))
    assert left["m"].count() == 1 and left["x"].count() == 1


def test_streams(spark, rows, tmp_path):
    schema = "k long, version long, text string, op string"
    rows(schema, [(1, 1, "a", "U"), (2, 1, "b", "U"), (1, 2, "a2", "U")]).write.json(f"{tmp_path}/in")
    target = store.VersionedTable(spark, f"file://{tmp_path}/out", "k long, version long, text string", ["k"], 4)
    run = lambda: changelog.apply_stream(spark, spark.readStream.schema(schema).json(f"{tmp_path}/in"), target, ["k"], f"{tmp_path}/cp").awaitTermination()
    run()
    rows(schema, [(2, 3, None, "D"), (1, 1, "stale", "U")]).write.mode("append").json(f"{tmp_path}/in")
    run()
    assert {tuple(r) for r in target.read().collect()} == {(1, 2, "a2")}
    rows("chat_id long, timestamp long", [(1, 10), (1, 20), (1, 86500), (2, 5)]).write.json(f"{tmp_path}/ev")
    counts = store.VersionedTable(spark, f"file://{tmp_path}/counts", "chat_id long, day date, n long", by="day")
    stream = lambda: rollup.keep_latest(rollup.daily_counts(spark.readStream.schema("chat_id long, timestamp long").json(f"{tmp_path}/ev"), "chat_id", "timestamp"), counts, f"{tmp_path}/cp2").awaitTermination()
    stream()
    rows("chat_id long, timestamp long", [(1, 30)]).write.mode("append").json(f"{tmp_path}/ev")
    stream()
    assert {(r.chat_id, str(r.day), r.n) for r in counts.read().collect()} == {(1, "1970-01-01", 3), (1, "1970-01-02", 1), (2, "1970-01-01", 1)}


def test_lists(rows):
    s = "g int, k int, v long"
    df = rows(s, [(1, 1, 5), (1, 2, 5), (1, 3, 5), (2, 1, 50)])
    assert [(r.g, r.k) for r in lists.take_budget(df, ["g"], [F.col("k")], F.col("v"), 11, 9).collect()] == [(1, 1), (1, 2)]
    assert lists.top_and_more(df, [F.desc("v"), F.col("g"), F.col("k")], 2).first().more == 2
    slices = {r.k: r.drawn for r in lists.raise_small(rows("k int, n long", [(1, 90), (2, 9), (3, 1), (4, 0)]), "n", 0.05).collect()}
    assert slices == {1: 89, 2: 8, 3: 4, 4: 0}
    assert [r.k for r in lists.changes_only(rows(s, [(1, 1, 5), (1, 2, 5), (1, 3, None), (1, 4, None), (1, 5, 5)]), ["g"], ["k"], "v", F.floor(F.col("k") / 2)).orderBy("k").collect()] == [1, 3, 5]
    assert [r.k for r in lists.around(df.where("g = 1"), "v", "k", (5, 2), 1, 5).orderBy("k").collect()] == [1, 2, 3]
    times = rows("g int, t long", [(1, 0), (1, 5), (1, 9), (1, 10), (1, 21), (2, 9), (1, None)])
    assert sorted((r.g, -1 if r.t is None else r.t, r.recent) for r in lists.sliding_count(times, ["g"], "t", 5).collect()) == [(1, -1, 0), (1, 0, 1), (1, 5, 2), (1, 9, 2), (1, 10, 3), (1, 21, 1), (2, 9, 1)]
    order = rows("t string", [("a10",), ("a9",), ("b1",)]).orderBy(lists.natural_key(F.col("t"))).collect()
    assert [r.t for r in order] == ["a9", "a10", "b1"]


@pytest.mark.parametrize("name", ["search_bm25", "daily_rollup", "snapshot_diff", "budget_prefix", "p1_dedup", "p7_rolling"])
def test_queries_equal_their_sql(spark, name):
    import compare

    folder = "/root/testdata/sf0.001"
    assert compare.same(spark, compare.connect(folder), name, folder).startswith("ok")


def test_every_query_runs_on_empty_tables(spark, tmp_path):
    from talkloom.plans import core_p, core_queries
    from talkloom.sources.tables import SCHEMAS

    for n, s in SCHEMAS.items():
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/{n}.parquet")
    for name, f in {**core_p.QUERIES, **core_queries.QUERIES}.items():
        try:
            f(spark, f"file://{tmp_path}").limit(3).collect()
        except Exception as e:
            raise AssertionError(name) from e


def test_push_changes_of_every_chat(spark, tmp_path):
    from talkloom.plans.store_queries import push_changes
    from talkloom.sources.tables import SCHEMAS

    data = [(1, -5, "a"), (1, 7, "b"), (2, 7, ""), (3, 7, None), (1, 7, "b"), (1, 0, "c")]
    spark.createDataFrame([(m, c, 1, t, None, None, None, 1, None) for m, c, t in data], SCHEMAS["messages"]).write.parquet(f"{tmp_path}/messages.parquet")
    got = sorted(tuple(r) for r in push_changes(spark, f"file://{tmp_path}").collect())
    assert got == [(-5, 1, "U"), (0, 1, "U"), (7, 1, "U"), (7, 2, "D"), (7, 3, "D")]
