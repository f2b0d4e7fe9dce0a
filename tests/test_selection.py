"""Places and quantiles in a total order: against numpy, with ties, nulls and one hot group; and how the plans are spread."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import report, selection, vectorize


@pytest.mark.parametrize("approximate", [False, True])
def test_quantiles_equal_numpy(spark, approximate):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.exponential(5, 3000), 1)] + [("few", 1.0), ("few", 4.0), (None, 7.5), ("none", None)]
    df = spark.createDataFrame(rows, "group string, v double")
    if approximate:
        assert report.distribution(df, ["v"], ["group"], approximate=True).count() == 4
        return
    wanted = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.9, "q99": 0.99, "q100": 1.0}
    found = {r["group"]: r for r in selection.quantiles(df, ["group"], "v", wanted).collect()}
    assert set(found) == {"hot", "few", None}
    for group, row in found.items():
        values = [v for g, v in rows if g == group and v is not None]
        assert row["n"] == len(values)
        for name, q in wanted.items():
            assert row[name] == pytest.approx(np.quantile(values, q), abs=1e-12)
    whole = selection.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert whole[0]["m"] == pytest.approx(np.median([v for _, v in rows if v is not None]))
    assert selection.quantiles(df.where("false"), ["group"], "v", {"m": 0.5}).count() == 0


def test_distribution_keeps_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, None), (None, 2.0, 5.0)], "g string, x double, feature_like double")
    found = {(r["g"], r["feature"]): r for r in report.distribution(df, ["x", "feature_like"], ["g"]).collect()}
    assert len(found) == 4 and found["a", "feature_like"]["median"] is None and found[None, "x"]["p95"] == 2.0 and found["a", "x"]["median"] == 2.0


def test_ranks_of_many_ties_stay_spread(spark):
    counts = spark.range(4000).select(F.lit(3).alias("n"), F.format_string("k%05d", (F.col("id") * 7919) % 4000).alias("key")).unionByName(
        spark.createDataFrame([(9, "top"), (1, "last")], "n int, key string")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables come in one file else
    try:
        made = report.ranked(counts, "n", "key")
        rows = made.orderBy("position").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["position"] for r in rows] == list(range(1, 4003))
    assert [r["key"] for r in rows] == ["top", *[f"k{i:05d}" for i in range(4000)], "last"]
    sizes = [r["count"] for r in spark.read.parquet(*made.inputFiles()).groupBy("_metadata.file_name").count().collect()]
    assert sum(sizes) == 4002 and max(sizes) < 3000  # the tie group of 4,000 rows lies in several files


def test_running_sums_of_weights(spark):
    df = spark.createDataFrame([(i % 5, i, float(i)) for i in range(100)], "k int, id int, w double")
    rows = sorted(selection.running(df, [F.col("k")], "w").collect(), key=lambda r: (r["k"], r["id"]))
    total = 0.0
    for r in rows:
        assert r["before_"] == total
        total += r["w"]


def test_token_profile_of_lengths(spark):
    lengths = [0, 1, 5, 126, 127, 127, 300, 511, 2000]
    rows = {r["variant"]: r for r in vectorize.token_profile(spark.createDataFrame([(n,) for n in lengths], "n_tokens long"), {"short": 128, "long": 512}).collect()}
    for name, room in (("short", 126), ("long", 510)):
        r = rows[name]
        assert r["records"] == 9 and r["max"] == 2000 and r["truncated"] == sum(n > room for n in lengths)
        for p, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)):
            assert r[p] == pytest.approx(np.quantile(lengths, q))
        assert r["mean"] == pytest.approx(np.mean(lengths)) and r["retained_mean"] == pytest.approx(np.mean([min(n, room) for n in lengths]))
        assert r["discarded_mean"] == pytest.approx(np.mean([max(n - room, 0) for n in lengths])) and r["over_128"] == pytest.approx(3 / 9)
