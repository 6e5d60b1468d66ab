import collections
import random

import pytest

from talkloom.operators.deliveries import deduplicate, redelivered

SCHEMA = "chat_id long, message_id long, timestamp long, text string, part string, __row string"
KEY, ORDER = ["chat_id", "message_id"], ["timestamp"]


def write(spark, path, data, files=3):
    spark.createDataFrame(data, SCHEMA).repartition(files).write.mode("overwrite").parquet(str(path))
    return f"file://{path}"


def test_one_row_per_key_hot_key_nulls_and_ties(spark, tmp_path):
    rng = random.Random(1)
    data = [(rng.randrange(5), rng.randrange(400), rng.randrange(9), "x" * rng.randrange(9), "p", None) for _ in range(3000)]
    data += [(7, 7, 5, "hot", None, None)] * 1500 + [(None, 1, 1, "n", None, "r")] * 3 + [(1, None, None, None, None, None)] * 2 + [(9, 9, None, "late", None, None), (9, 9, 3, "early", None, None)]
    path = write(spark, tmp_path / "m", data)
    got = deduplicate(spark, path, SCHEMA, KEY, ORDER).collect()
    best = {}
    for c, m, t, *_ in data:
        if c is not None and m is not None:
            k = (c, m)
            best[k] = min(best.get(k, (True, 0)), (t is None, t or 0))
    full = [r for r in got if r.chat_id is not None and r.message_id is not None]
    assert len(full) == len(best)
    assert {(r.chat_id, r.message_id): (r.timestamp is None, r.timestamp or 0) for r in full} == best
    assert len(got) - len(full) == 5  # rows without a full key all stay
    assert next(r.text for r in full if r.chat_id == 9) == "early"
    counts = collections.Counter((c, m) for c, m, *_ in data if c is not None and m is not None)
    again = redelivered(spark, path, SCHEMA, KEY, ORDER).collect()
    assert sorted((r.chat_id, r.message_id) for r in again) == sorted(k for k, n in counts.items() if n > 1)


def test_vectors_over_many_chunks_and_row_groups(spark, tmp_path):
    n = 70_000
    spark.range(n).selectExpr("id div 2 as chat_id", "1L as message_id", "id as timestamp", "cast(id as string) as text", "'' as part", "'' as __row").coalesce(1).write.option("parquet.block.size", 65536).parquet(str(tmp_path / "big"))
    got = deduplicate(spark, f"file://{tmp_path}/big", SCHEMA, KEY, ORDER, ["timestamp"]).selectExpr("count(*)", "sum(timestamp % 2)").first()
    assert tuple(got) == (n // 2, 0)


def test_one_file_is_several_tasks(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = 40_000
    t = pa.table({"chat_id": pa.array([i // 2 for i in range(n)]), "message_id": pa.array([1] * n), "timestamp": pa.array(range(n)), "text": ["x"] * n, "part": ["p"] * n, "__row": ["r"] * n})
    (tmp_path / "one").mkdir()
    pq.write_table(t, tmp_path / "one" / "a b%.parquet", row_group_size=5000)
    got = deduplicate(spark, f"file://{tmp_path}/one", SCHEMA, KEY, ORDER, ["timestamp"])
    assert got.count() == n // 2
    from pyspark.sql import functions as F

    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_empty_table(spark, tmp_path):
    path = write(spark, tmp_path / "e", [], 1)
    assert deduplicate(spark, path, SCHEMA, KEY, ORDER).collect() == []
    assert redelivered(spark, path, SCHEMA, KEY, ORDER).collect() == []


def test_cluster_without_shared_folder_is_an_error(spark):
    from talkloom import session

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://x"})

    with pytest.raises(ValueError):
        session.scratch_base(Fake)
