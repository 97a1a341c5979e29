import pytest
from pyspark.sql import functions as F

from millrace.llm import sharding


@pytest.mark.parametrize("limit", [1_000, 20_000, 1 << 30])
def test_shards_fit_and_are_as_shallow_as_can_be(odd, limit):
    rows = sharding.assign_shards(odd, limit).collect()
    assert len(rows) == odd.count()
    assert sorted(r["n_bytes"] for r in rows) == sorted(len((r["text"] or "").encode()) for r in odd.collect())
    sums, buckets = {}, {}
    for r in rows:
        key = (r["depth"], r["bucket"], r["page"])
        sums[key] = sums.get(key, 0) + r["n_bytes"]
        buckets[r["depth"], r["bucket"]] = buckets.get((r["depth"], r["bucket"]), 0) + r["n_bytes"]
    for r in rows:
        key = (r["depth"], r["bucket"], r["page"])
        assert sums[key] == r["shard_bytes"]
        assert (sums[key] > limit) == r["oversized"]
        if r["oversized"]:
            assert r["n_bytes"] == r["shard_bytes"]
    for d, b in buckets:  # no bucket lies above another, and every split was of a bucket that was too large
        assert not any(e < d and b >> (d - e) == c for e, c in buckets)
        if d:
            parent = sum(n for (e, c), n in buckets.items() if e >= d - 1 and c >> (e - d + 1) == b >> 1)
            assert parent > limit


def test_one_key_with_most_rows_is_paged(spark):
    df = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    rows = sharding.assign_shards(df, 500).collect()
    assert len(rows) == 3_000 and max(r["shard_bytes"] for r in rows) <= 500 and not any(r["oversized"] for r in rows)


def test_empty_and_written(spark, none, tmp_path):
    assert sharding.assign_shards(none, 100).collect() == []
    df = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"))
    assert sharding.write_shards(df, str(tmp_path / "s"), 1_000) == "shard"
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 200 and back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).filter("n > 1000").count() == 0


def test_every_row_is_written_as_it_is(spark, odd, tmp_path):
    df = odd.withColumn("shard", F.lit("own")).withColumn("kept", F.lit(1)).withColumn("h", F.lit(2)).withColumn("depth", F.lit("d"))
    df = df.unionByName(df.limit(3))
    for limit in (1_000, 1 << 30):
        out = str(tmp_path / str(limit))
        assert sharding.write_shards(df, out, limit) == "_shard"
        back = spark.read.parquet(out)
        assert back.select(df.columns).exceptAll(df).count() == 0 and back.count() == df.count()


def test_a_very_long_text_is_a_shard_alone(spark):
    df = spark.range(20).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.repeat(F.lit("long "), 2_000_000)).otherwise(F.lit("short")).alias("text"))
    rows = sharding.assign_shards(df, 1_000).collect()
    assert [(r["doc_id"], r["shard_bytes"]) for r in rows if r["oversized"]] == [(7, 10_000_000)] and len(rows) == 20


def test_frequent_keys_are_joined_without_a_shuffle(spark, monkeypatch):
    from millrace.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 4)
    rows = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 1_000).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most")).filter("k <> 3").cache()
    got = common.join_by_key(rows, keyed, "k", "n")
    assert got.count() == rows.filter("k <> 3").count() and sorted(got.columns) == ["id", "k", "most", "n"]
    assert got.select("k", "id", "n", "most").exceptAll(rows.join(keyed, "k").select("k", "id", "n", "most")).count() == 0
