from marlstone.operators.joins import against_all, salted


def test_every_row_meets_every_row_once(spark):
    few = spark.createDataFrame([("a",), ("b",), ("b",)], "q string")
    many = spark.range(50).withColumnRenamed("id", "item")
    got = against_all(few, many, block=7)
    assert got.count() == 150 and got.distinct().count() == 100 and got.columns == ["q", "item"]


def test_nothing_meets_nothing(spark):
    few = spark.createDataFrame([], "q string")
    assert against_all(few, spark.range(5)).count() == 0
    assert against_all(spark.range(5).withColumnRenamed("id", "q"), spark.range(0)).count() == 0


def test_salted_join_equals_a_plain_one(spark):
    large = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", None if i % 7 == 0 else 1) for i in range(300)], "id bigint, key string, _n int")
    small = spark.createDataFrame([("hot", "x"), ("k3", "y"), ("gone", "z")], "key string, v string")
    for how in ("inner", "left", "left_anti", "left_semi"):
        a, b = salted(large, small, ["key"], ["id"], how), large.join(small, ["key"], how)
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
