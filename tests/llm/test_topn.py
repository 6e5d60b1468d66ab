import random

from pyspark.sql import functions as F

from talkloom.llm.topn import top_n

S = "g long, score double, id long, part string"


def brute(data, n):
    out = []
    for g in {r[0] for r in data}:
        out += sorted((r for r in data if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))[:n]
    return sorted(out, key=str)


def test_hot_group_ties_nulls_and_repeats(rows):
    rng = random.Random(1)
    data = [(rng.choice([1, 1, 1, 2, 3, None, rng.randrange(500)]), rng.choice([None, 0.5, 0.5, rng.random()]), i, "x") for i in range(4000)]
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    got = sorted((tuple(r) for r in top_n(rows(S, data).repartition(5), ["g"], order, 4).collect()), key=str)
    assert got == brute(data, 4)
    twice = top_n(rows(S, data + data), ["g"], order, 2).where("g = 1").collect()
    assert len(twice) == 2 and twice[0].id == twice[1].id


def test_small(rows):
    order = [F.col("id").asc()]
    assert top_n(rows(S), ["g"], order, 3).collect() == []
    assert top_n(rows(S, [(1, 1.0, 1, "a")]), ["g"], order, 3).count() == 1
    assert top_n(rows(S, [(1, 1.0, 1, "a")]), ["g"], order, 0).count() == 0
