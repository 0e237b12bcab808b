"""Problem 8: sources mixed to target shares of all tokens, along a time-varying curriculum."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.llm.tokens import VOCABULARY, clean, encoding, ship
from tidewheel.session import cut, exact

#: Largest table of targets.
MOST_SOURCES = 10_000
#: Strength of the curriculum: the weight of a source tilts by up to this share between the start and the end of training.
TILT = 0.5


def _count(vocabulary: str):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(clean(t))) if (t := x.as_py()) else 0 for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return work


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, tokens) of every document, counted once and kept; null texts have 0 tokens."""
    ship(documents.sparkSession, vocabulary)
    rows = exact(documents, "doc_id", "source", "text").select(F.col("doc_id").cast("long"), "source", "text")
    return cut(rows.mapInArrow(_count(vocabulary), "doc_id long, source string, tokens long"))


def demand(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Per row of targets: source, target_share, max_repeats, source_tokens, source_docs, wanted, capacity, used, passes, rest, mean_tokens.

    wanted is the share of all tokens of all documents, those of null or unlisted sources included; capacity is max_repeats times the
    source's tokens; used is the smaller; it is met by whole passes over the source and a rest. A source without documents has none;
    null max_repeats counts as 1, a null or negative share as 0. Of repeated targets of one source the first in order of share is kept.
    """
    targets = exact(targets, "source", "target_share", "max_repeats")
    if targets.limit(MOST_SOURCES + 1).count() > MOST_SOURCES:
        raise ValueError(f"targets has more than {MOST_SOURCES} rows")
    one = targets.where("source is not null").groupBy("source").agg(F.min_by("target_share", F.struct("target_share", "max_repeats")).alias("target_share"), F.min_by("max_repeats", F.struct("target_share", "max_repeats")).alias("max_repeats"))
    by = counts.groupBy("source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.when(F.col("tokens") > 0, 1)).alias("source_docs"))
    total = counts.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    zero = F.lit(0).cast("long")
    rows = one.join(by, "source", "left").crossJoin(F.broadcast(total))  # one row
    rows = rows.select(
        "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).cast("int").alias("max_repeats"),
        F.coalesce("source_tokens", zero).alias("source_tokens"), F.coalesce("source_docs", zero).alias("source_docs"), "all_tokens",
    )
    rows = rows.withColumn("wanted", F.col("target_share") * F.col("all_tokens")).withColumn("capacity", F.col("max_repeats") * F.col("source_tokens"))
    rows = rows.withColumn("used", F.least("wanted", F.col("capacity").cast("double")))
    passes = F.when(F.col("source_tokens") > 0, F.floor(F.col("used") / F.col("source_tokens"))).otherwise(zero).cast("int")
    rows = rows.withColumn("passes", passes).withColumn("rest", F.col("used") - F.col("passes") * F.col("source_tokens"))
    return rows.withColumn("mean_tokens", F.coalesce(F.try_divide("source_tokens", "source_docs"), F.lit(0.0)))


def curriculum(wanted: DataFrame, tilt: float = TILT) -> DataFrame:
    """A tilt a per source: its weight at time t of training (0 to 1) is proportional to used * (1 - a + 2 a t).

    Sources of short documents come earlier, of long ones later; the tilts are centred so that the weights add up to the same at any time.
    """
    order = Window.orderBy("mean_tokens", "source")  # at most MOST_SOURCES rows
    every = Window.partitionBy()
    raw = wanted.withColumn("_r", F.percent_rank().over(order) * 2 - 1)
    mean = F.coalesce(F.try_divide(F.sum(F.col("_r") * F.col("used")).over(every), F.sum("used").over(every)), F.lit(0.0))
    return raw.withColumn("a", (F.col("_r") - mean) * (tilt / 2)).drop("_r")


def mix(counts: DataFrame, targets: DataFrame, tilt: float = TILT, seed: int = 7) -> DataFrame:
    """One row per use of a document, in training order: doc_id, source, repeat (from 0), tokens, position (0 to 1).

    Within a source documents lie in the order of a hash, one pass after another; a use takes place where the integral of the source's
    weight schedule has demanded as many tokens as lie before its middle, found by inverting the integral; the uses are then
    range-sorted by position. No document is used more than max_repeats times; a source ends with the document whose middle lies nearest
    before its demand, so it is at most half a document off; sources that cannot reach their demand are used max_repeats times throughout.
    The running sum of a source is taken over 1,024 ranges of the hash and then within each, so a source with a third of all rows is
    spread. Documents of null or unlisted sources and those without tokens are not used; copies of a text are documents of their own.
    """
    plan = F.broadcast(curriculum(demand(counts, targets), tilt).select("source", "source_tokens", "used", "passes", "rest", "max_repeats", "a"))  # at most MOST_SOURCES rows
    h = F.xxhash64("doc_id", "source", F.lit(seed))
    rows = counts.where("tokens > 0").join(plan, "source").withColumn("h", h).withColumn("range", F.shiftrightunsigned("h", 54))
    ranges = rows.groupBy("source", "range").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 1,024 rows of each source
    ranges = ranges.select("source", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "range").orderBy("h", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("tokens").over(inner)).join(ranges, ["source", "range"])
    middle = F.col("base") + F.col("upto") - F.col("tokens") / 2
    uses = F.least(F.col("passes") + F.when(middle <= F.col("rest"), 1).otherwise(0), F.col("max_repeats"))
    copies = placed.withColumn("middle", middle).withColumn("uses", uses).where("uses > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)))
    x = F.least(F.lit(1.0), (F.col("repeat") * F.col("source_tokens") + F.col("middle")) / F.col("used"))
    b = 1 - F.col("a")
    position = 2 * x / (b + F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * F.col("a") * x)))  # of a t^2 + (1 - a) t = x
    return copies.select("doc_id", "source", "repeat", "tokens", position.alias("position")).orderBy("position", "doc_id", "repeat")


def reached_shares(counts: DataFrame, targets: DataFrame, mixed: DataFrame) -> DataFrame:
    """What a mix came to, one row per source of the targets, also those without a document.

    Columns: source, target_share, actual_share (of the mix's tokens), share_of_all (of all documents' tokens), max_repeats,
    source_tokens, mixed_tokens, missing_tokens (of target_share of all documents' tokens), uses, most_uses (of one document), short. A
    source is short if the mix uses all its tokens max_repeats times and still holds less than the source's share.
    """
    got = mixed.groupBy("source").agg(F.sum("tokens").alias("mixed_tokens"), F.count("*").alias("uses"), (F.max("repeat") + 1).alias("most_uses"))
    rows = demand(counts, targets).join(got, "source", "left").fillna(0, ["mixed_tokens", "uses", "most_uses"])
    share = lambda total: F.coalesce(F.try_divide(F.col("mixed_tokens"), total), F.lit(0.0))
    short = (F.col("mixed_tokens") >= F.col("max_repeats") * F.col("source_tokens")) & (F.col("mixed_tokens") < F.col("wanted"))
    return rows.select(
        "source", "target_share", share(F.sum("mixed_tokens").over(Window.partitionBy())).alias("actual_share"), share(F.col("all_tokens")).alias("share_of_all"), "max_repeats",  # at most MOST_SOURCES rows
        "source_tokens", "mixed_tokens", F.greatest(F.lit(0.0), F.col("wanted") - F.col("mixed_tokens")).alias("missing_tokens"), "uses", "most_uses", short.alias("short"),
    )


def short_sources(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """The sources that the mix leaves short, though it uses each of their documents max_repeats times."""
    return reached_shares(counts, targets, mix(counts, targets)).where("short").select("source")
