import pytest
from pyspark.sql import functions as F

from connlens.functions.lookup import frequent_keys, lookup_join, salted
from logs import as_set


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows: half of one key, a tenth without a key, the rest of 8,000 keys."""
    key = (
        F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 10 == 1, None).otherwise(F.concat(F.lit("k"), F.col("id") % 8000))
    )
    rows = spark.range(20_000).select(key.alias("IP"), F.col("id").alias("N"), (F.col("id") / 7).alias("D"))
    keyed = spark.range(9000).select(
        F.when(F.col("id") == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("IP"), F.col("id").alias("INFO")
    )
    return rows.repartition(8, "N").cache(), keyed


def test_frequent_keys_are_found(spark, skewed):
    rows, _ = skewed
    hashed = {r["IP"]: r["h"] for r in rows.select("IP", F.xxhash64("IP").alias("h")).distinct().collect()}
    assert set(frequent_keys(rows, ["IP"])) == {hashed["hot"], hashed[None]}
    assert frequent_keys(rows.limit(0), ["IP"]) == []
    # As many as there can be: each key with more than a hundredth of the rows.
    even = spark.range(5000).select((F.col("id") % 60).alias("K"))
    assert len(frequent_keys(even, ["K"], 100)) == 60


@pytest.mark.parametrize("how", ["left", "left_semi"])
def test_salted_and_broadcast_joins_are_equal(skewed, how):
    rows, keyed = skewed
    large = lookup_join(rows, keyed, ["IP"], how, broadcast_bytes=0)
    small = lookup_join(rows, keyed, ["IP"], how)
    assert "_salt" in large._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in small._jdf.queryExecution().optimizedPlan().toString()
    assert large.columns == small.columns == ["IP", "N", "D", *(["INFO"] if how == "left" else [])]
    assert as_set(large) == as_set(small)
    if how == "left":
        assert large.count() == 20_000


def test_a_hot_key_spreads_and_others_are_not_copied(skewed):
    rows, keyed = skewed
    hot = frequent_keys(rows, ["IP"])
    left, right = salted(rows, keyed, ["IP"], hot, 16)
    spread = {r["_salt"]: r["count"] for r in left.where("IP = 'hot'").groupBy("_salt").count().collect()}
    assert len(spread) == 16 and max(spread.values()) < 2 * 10_000 / 16
    assert left.where("IP IS NULL").select("_salt").distinct().count() == 16
    assert left.where("IP <> 'hot'").select("_salt").distinct().collect()[0]["_salt"] == 0
    # The copies: 15 of the one hot key that is in the table.
    assert right.count() == keyed.count() + 15


def test_without_hot_keys_nothing_is_copied(spark):
    rows = spark.range(3000).select((F.col("id") % 1500).alias("K"), F.col("id").alias("N"))
    keyed = spark.range(1000).select(F.col("id").alias("K"), F.col("id").alias("V"))
    joined = lookup_join(rows, keyed, ["K"], "left", broadcast_bytes=0)
    assert "_salt" not in joined._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count() == 3000 and joined.where("V IS NOT NULL").count() == 2000


def test_the_keyed_side_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    keyed = spark.range(100).withColumnRenamed("id", "K").mapInPandas(count, "K bigint")
    rows = spark.range(500).select((F.col("id") % 50).alias("K"), F.col("id").alias("N"))
    for limit in (0, 1 << 20):
        seen.value = 0
        assert lookup_join(rows, keyed, ["K"], "left_semi", broadcast_bytes=limit).count() == 500
        assert seen.value == 100
