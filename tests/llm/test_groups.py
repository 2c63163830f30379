from pyspark.sql import functions as F

from pairwright.llm import groups
from pairwright.scratch import stored


def test_rows_among_keys_by_broadcast_filter_and_shuffle(spark, monkeypatch):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 10 != 0, F.col("id") % 500).alias("key"), F.col("id").alias("_word")
    )
    for kind in ("long", "string"):
        typed = rows.withColumn("key", F.col("key").cast(kind))
        keys = stored(typed.select("key").where("key is not null and cast(key as int) % 7 = 0").distinct())
        expected = {r._word for r in rows.where("key % 7 = 0").collect()}
        for most, words in ((10**6, 1 << 21), (3, 1 << 21), (3, 1)):
            monkeypatch.setattr(groups, "BROADCAST_KEYS", most)
            monkeypatch.setattr(groups, "FILTER_WORDS", words)
            got = groups.among(typed, keys, "key")
            assert sorted(got.columns) == sorted(typed.columns)
            assert sorted(r._word for r in got.collect()) == sorted(expected)
        assert groups.among(typed, stored(keys.limit(0)), "key").count() == 0
