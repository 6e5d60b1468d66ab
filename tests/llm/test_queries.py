import pytest


def test_every_query_runs_on_empty_tables(spark, tmp_path):
    from talkloom.llm import queries
    from talkloom.sources.tables import SCHEMAS

    for n, s in SCHEMAS.items():
        spark.createDataFrame([], s).write.parquet(f"{tmp_path}/{n}.parquet")
    for name, f in queries.QUERIES.items():
        try:
            assert f(spark, f"file://{tmp_path}").limit(3).collect() == []
        except Exception as e:
            raise AssertionError(name) from e


@pytest.mark.parametrize("name", ["p2_found", "p8_found", "p10_found", "p10_shared_share"])
def test_queries_equal_their_sql(spark, name):
    import compare

    folder = "/root/testdata/sf0.001"
    assert compare.same(spark, compare.connect(folder), name, folder).startswith("ok")
