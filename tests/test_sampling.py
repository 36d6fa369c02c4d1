import numpy as np
import pytest
from pyspark.sql import functions as F

from feedback_signals.operators import caches, lookup, sampling as M
from feedback_signals.operators.quantiles import exact_quantiles
from feedback_signals.operators.ranking import dense_ids
from feedback_signals.operators import ranking
from feedback_signals.plans import training as TR


@pytest.fixture(scope="module")
def rows(spark):
    # One class holds 60 % of the rows, and one has a single row.
    label = F.when(F.col("id") % 10 < 6, "big").when(F.col("id") == 7, "one").otherwise(F.concat(F.lit("c"), F.col("id") % 3))
    return spark.range(5000).select(F.col("id").alias("row_id"), label.alias("label"))


def ids(df):
    return sorted(r.row_id for r in df.collect())


@pytest.mark.parametrize("op", [
    lambda df: M.stratified_cap(df, "label", 50),
    lambda df: M.undersample(df, ratio=2),
    lambda df: M.stratified_split(df).filter("is_test"),
    lambda df: M.random_split(df).filter("is_test"),
    lambda df: M.sample_n(df, 123),
])
def test_independent_of_partitioning(rows, op):
    assert ids(op(rows.repartition(1))) == ids(op(rows.repartition(8)))


def test_sizes(rows, monkeypatch):
    size = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    capped = {r.label: r["count"] for r in M.stratified_cap(rows, "label", 50).groupBy("label").count().collect()}
    assert capped == {k: min(v, 50) for k, v in size.items()}
    split = {r.label: r.n for r in M.stratified_split(rows).groupBy("label").agg(F.sum(F.col("is_test").cast("int")).alias("n")).collect()}
    assert split == {k: int(0.2 * v + 0.5) for k, v in size.items()}
    top_k = ids(M.sample_n(rows, 777))
    monkeypatch.setattr(M, "_TOP_K", 10)  # the way of large samples
    assert ids(M.sample_n(rows, 777)) == top_k and len(top_k) == 777
    assert M.sample_n(rows, 10_000).count() == 5000


def test_undersample_cuts_only_the_largest(rows):
    size = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    second = sorted(size.values())[-2]
    cut = {r.label: r["count"] for r in M.undersample(rows, ratio=2).groupBy("label").count().collect()}
    assert cut == {**size, "big": second * 2}
    alone = rows.filter("label = 'big'")
    assert M.undersample(alone).count() == alone.count()


def test_prepare_training(spark, rows):
    df = rows.withColumn("text", F.concat(F.lit("  some text number "), "row_id"))
    outside = spark.createDataFrame([(1, "known label text", "big"), (2, "unknown", "nope")], "row_id long, text string, label string")
    ready = TR.prepare_training(df, "label", outside)
    assert {r.label_id for r in ready.encoding.collect()} == set(range(5))
    assert [r.label for r in ready.validation.collect()] == ["big"]
    weights = {r.label: r for r in ready.weights.collect()}
    assert not weights["big"].boosted and weights["c0"].boosted
    with pytest.raises(ValueError):
        TR.prepare_training(df.filter("label = 'big'"), "label")


def test_quantiles(spark):
    rng = np.random.default_rng(0)
    for values in (rng.normal(size=3000), np.repeat([1.0, 2.0, 2.0, 7.5], 500), np.array([3.0]), rng.integers(0, 5, 999) / 7):
        df = spark.createDataFrame([(float(v), 1) for v in values], "x double, w long").repartition(5)
        got = exact_quantiles(df, "x", (0.0, 0.08, 0.33, 0.66, 1.0))
        assert np.allclose(got, np.quantile(values, (0.0, 0.08, 0.33, 0.66, 1.0)), rtol=0, atol=1e-15)
        small = df.groupBy("x").agg(F.count("*").alias("w"))
        assert np.allclose(exact_quantiles(small, "x", (0.33,), "w"), np.quantile(values, 0.33), atol=1e-15)


def test_attach_both_ways(spark, monkeypatch):
    left = spark.range(3000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    right = left.filter("k <> 'k7'").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, lookup.attach(left, right, "k", how).collect())) == plain
        assert sorted(map(str, lookup.salted_join(left, right, "k", how, rows_per_salt=100).collect())) == plain
        # Two keys may be salted, more have over 50 rows: only the fuller ones are.
        few = lookup.salted_join(left, right, "k", how, rows_per_salt=10, max_heavy=2)
        assert sorted(map(str, few.collect())) == plain
    assert lookup.bounded_copy(left, 10) is None


def test_dense_ids(spark, monkeypatch):
    keys = spark.range(0, 9000, 3).select(F.col("id").alias("k"))
    few = sorted(map(tuple, dense_ids(keys, "k", "n").collect()))
    monkeypatch.setattr(ranking, "bounded_copy", lambda df: None)
    assert sorted(map(tuple, dense_ids(keys, "k", "n").collect())) == few == [(3 * i, i) for i in range(3000)]


def test_a_key_of_two_writers_multiplies_no_row(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "new")], "row_id long, text string")
    keyed = caches.with_key(df).drop("row_id", "text").distinct()
    path, target = str(tmp_path / "cache"), str(tmp_path / "compact")
    for value, batch in (("late", 2), ("first", 1), ("second", 1)):  # the order of writing does not matter
        keyed.limit(2).withColumn("v", F.lit(value)).withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(path)
    cache = spark.read.parquet(path)
    got = caches.apply_cache(df, cache, "v").collect()
    assert len(got) == 4 and {r.v for r in got} == {"first", None}
    assert caches.not_cached(df, cache).count() == sum(r.v is None for r in got)
    caches.append_cache(path, keyed.withColumn("v", F.lit("third")), "v")
    assert spark.read.parquet(path).filter("v = 'third'").select("batch").distinct().first().batch == 3
    caches.compact_cache(path, target, "v", spark)
    assert spark.read.parquet(target).count() == 3 == spark.read.parquet(target).select("text_hash").distinct().count()
    old = cache.drop("batch").distinct()  # a table of earlier runs, without batches
    assert caches.apply_cache(df, old, "v").count() == 4


def test_cache_round_trip(spark, tmp_path):
    path = str(tmp_path / "c")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "row_id long, text string")
    seen = []

    def score(texts):
        seen.append(texts.count())
        return texts.withColumn("v", F.concat("text", F.lit("!")))

    got = caches.score_distinct(df, "v", score, path)
    assert {r.row_id: r.v for r in got.collect()} == {1: "a!", 2: "b!", 3: "a!"}
    caches.score_distinct(df, "v", score, path).collect()
    assert seen == [2, 0]
    assert caches.not_cached(df, spark.read.parquet(path)).count() == 0
