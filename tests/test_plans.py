"""What a plan must not do, whatever the size of the small side: shuffle the facts twice, or read columns it doesn't need."""

import re

import pytest
from pyspark.sql import functions as F

from tests.compare import SMALL
from tidewheel import catalog, session
from tidewheel.operators import chunks, sampling, segments, stats
from tidewheel.session import attach, partitions, size_of, table


@pytest.fixture
def no_broadcast(spark):
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbering_shuffles_rows_once(spark, no_broadcast):
    text = plan(segments.event_frames(table(spark, SMALL, "events")))
    # the rows by (ep, bucket); the bucket counts by (ep, bucket), by ep, and back
    assert len(re.findall(r"Exchange hashpartitioning\(ep#\d+L?, _b#\d+L?", text)) <= 3
    assert len([x for x in text.splitlines() if "Exchange" in x]) <= 4


def test_scans_are_pruned(spark):
    text = plan(catalog.queries()["scan_project"](spark, SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,purchase)]" in text
    assert "props" not in text.split("ReadSchema")[1]
    text = plan(catalog.queries()["dense_index"](spark, SMALL))
    assert re.search(r"ReadSchema: struct<frame_index:bigint,episode_index:bigint>", text)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_cross_join_of_tables(spark, name):
    """Nested-loop joins only against broadcast rows of bounded number."""
    text = plan(catalog.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in text


def test_norm_stats_in_two_passes(spark):
    """Moments and ends are taken together: the values are computed for the summary and for the bins, not a third time."""
    values = table(spark, SMALL, "events").select(F.lit(0).alias("dim"), F.col("value").alias("x"))
    assert plan(stats.norm_stats(values, "dim")).count("Scan parquet") == 2


def test_dimensions_by_bytes(spark):
    """A dimension is broadcast for its measured bytes, whatever its number of rows."""
    fact = spark.range(100).select((F.col("id") % 10).alias("k"))
    wide = spark.range(10).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 10_000).alias("v"))
    assert "BroadcastHashJoin" in plan(attach(fact, wide, "k", max_bytes=1 << 20))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" not in plan(attach(fact, wide, "k", max_bytes=1 << 16))
        assert attach(fact, wide, "k", max_bytes=1 << 16).count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitions_follow_the_input(spark):
    frames = table(spark, "/root/testdata/sf0.1", "frames")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert partitions(frames) == max(least, -(-size_of(frames) // session.PARTITION_BYTES))
    old, session.PARTITION_BYTES = session.PARTITION_BYTES, 1 << 18
    try:
        n = partitions(frames)
        assert n > 16 and f"hashpartitioning(episode_index#" in plan(chunks.frame_chunks(frames, ["timestamp"], 100)) and f", {n}), REPARTITION_BY_NUM" in plan(chunks.frame_chunks(frames, ["timestamp"], 100))
    finally:
        session.PARTITION_BYTES = old
    assert partitions(spark.createDataFrame([(1,)], "a int")) == least  # of unknown size


def test_draws_are_spread(spark):
    """No row is unfolded to all draws of its source."""
    rows = table(spark, SMALL, "events").select("event_id", "event_type")
    text = plan(sampling.resample(rows, "event_type", "event_id", {"click": 0.5, "view": 0.5}))
    assert str(sampling.DRAWS) in text and text.count("Generate explode") == 2


def test_percentiles_sort_no_group(spark):
    """Exact percentiles hold no buffer of all values of a group."""
    values = table(spark, SMALL, "events").select("user_id", "value")
    assert "percentile" not in plan(stats.exact_percentiles(values, ["user_id"], "value", [0.5]))
