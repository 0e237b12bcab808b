"""Problem 2: splits that keep related records together, over components found by breadth-first search from many seeds."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.session import attach, cut, exact

#: Links of the graph of seed labels up to which one task merges them; a larger one is searched in the same way again, with the same result.
SMALL_LINKS = 500_000
#: Binary digits of the hash by which the members of a key are parted at each level: 2 ** FAN_BITS nodes are linked to one of the level above.
FAN_BITS = 6
#: Hash orders of the groups that a split chooses from.
ORDERS = 16


def member_links(members: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """Links (a, b) that join all members v of each key; nulls are left out. members: key, v.

    A tree over the digits of the members' hash: at each level the nodes that share key and prefix are linked to the smallest of them,
    which goes on to the level above. So no node has more than about 2 ** fan_bits links per level, however hot a key is, and no task
    sees more of a key than that at once.
    """
    m = members.where("key is not null and v is not null").select("key", "v").distinct().withColumn("h", F.xxhash64("v"))
    most = m.groupBy("key").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    links, level = [], max(1, math.ceil(math.log2(most) / fan_bits))
    for k in reversed(range(level)):
        prefix = F.shiftrightunsigned("h", 64 - k * fan_bits) if k else F.lit(0)
        tied = cut(m.withColumn("prefix", prefix).withColumn("mid", F.min("v").over(Window.partitionBy("key", "prefix"))))
        links.append(tied.where("v <> mid").select(F.col("v").alias("a"), F.col("mid").alias("b")))
        m = tied.where("v = mid").select("key", "v", "h")
    return functools.reduce(DataFrame.unionByName, links).distinct()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each label's root, by hooking the larger of two linked roots to the smaller and shortening the paths, all links at once."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    pairs = pa.Table.from_batches(held)
    labels, at = np.unique(np.concatenate([pairs.column(0).to_numpy(), pairs.column(1).to_numpy()]), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(labels))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_pydict({"label": labels, "root": labels[root]})


def components(links: DataFrame, small_links: int = SMALL_LINKS) -> DataFrame:
    """(v, root) for each vertex of the undirected links (a, b): root is one vertex of its component, the same for all of it.

    Frontier breadth-first search: the lists of neighbours are hash-partitioned once, one row per neighbour; seeds are the vertices whose
    hash is smallest among their neighbours, so each component has one; all frontiers are expanded at once, a vertex takes the smallest
    label that reaches it first, and where two labels meet they are noted. A round writes only what it labelled. The noted pairs are a
    smaller graph over the seeds, merged in one task if it has at most small_links links, else by the same search. No links: no row.
    """
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    near = cut(both.select(F.col("a").alias("v"), F.col("b").alias("next")))
    least = near.groupBy("v").agg(F.min(F.struct(F.xxhash64("next").alias("h"), F.col("next").alias("x"))).alias("least"))
    frontier = cut(least.where(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("x")) < F.col("least")).select("v", F.col("v").alias("label")))
    done, met = [frontier], []
    while not frontier.isEmpty():
        reached = frontier.join(near, "v").select(F.col("next").alias("v"), "label").distinct()
        known = functools.reduce(DataFrame.unionByName, done).withColumnRenamed("label", "had")
        step = cut(reached.join(known, "v", "left"))
        frontier = cut(step.where("had is null").groupBy("v").agg(F.min("label").alias("label")))
        done.append(frontier)
        again = step.where("had is null").select("v", "label").join(frontier.withColumnRenamed("label", "had"), "v").select("had", "label")
        pairs = step.where("had is not null").select("had", "label").unionByName(again).where("had <> label")
        met.append(pairs.select(F.least("had", "label").alias("a"), F.greatest("had", "label").alias("b")).distinct())
    labels = functools.reduce(DataFrame.unionByName, done)
    pairs = cut(functools.reduce(DataFrame.unionByName, met).distinct()) if met else None
    n = pairs.count() if pairs is not None else 0
    if n == 0:
        return labels.withColumnRenamed("label", "root")
    if n <= small_links:
        merged = pairs.coalesce(1).mapInArrow(_merge, "label long, root long")
    else:
        merged = components(pairs, small_links).withColumnRenamed("v", "label")
    return attach(labels, merged, "label", "left").select("v", F.coalesce("root", "label").alias("root"))


def related_episodes(episodes: DataFrame) -> DataFrame:
    """(episode_index, group_id, n_episodes) for groups of two or more rows of episodes that belong together.

    Linked are episodes of one session (letter case and outer blanks ignored, null is none), an episode and its source, and episodes
    that name the same source, also one that is gone. group_id is the group's smallest episode_index among the rows of episodes.
    Repeated rows and null episode_index change nothing; an empty table gives no row.
    """
    e = exact(episodes, "episode_index", "session_id", "source_episode_index").where("episode_index is not null")
    session = F.lower(F.regexp_replace("session_id", r"(?U)^\s+|\s+$", ""))
    of_session = e.select(F.concat(F.lit("session "), session).alias("key"), F.col("episode_index").alias("v"))
    origin = F.concat(F.lit("source "), F.col("source_episode_index").cast("string")).alias("key")
    of_source = e.select(origin, F.explode(F.array("episode_index", "source_episode_index")).alias("v"))
    root = components(member_links(of_session.unionByName(of_source)))
    known = e.select(F.col("episode_index").alias("v")).distinct()
    rows = cut(root.join(known, "v"))
    groups = rows.groupBy("root").agg(F.min("v").alias("group_id"), F.count("*").alias("n_episodes")).where("n_episodes > 1")
    return attach(rows, groups, "root").select(F.col("v").alias("episode_index"), "group_id", "n_episodes")


def _sizes(episodes: DataFrame, frames: DataFrame) -> DataFrame:
    """(episode_index, n_frames) of every episode of either table; a frame delivered twice counts once."""
    episodes, frames = exact(episodes, "episode_index"), exact(frames, "episode_index", "frame_index")
    fine = frames.where("episode_index is not null and frame_index is not null")
    counted = fine.groupBy("episode_index", "frame_index").agg(F.lit(1).alias("one")).groupBy("episode_index").agg(F.count("*").alias("n_frames"))
    rest = episodes.where("episode_index is not null").select("episode_index", F.lit(0).cast("long").alias("n_frames"))
    return counted.unionByName(rest).groupBy("episode_index").agg(F.max("n_frames").alias("n_frames"))


def _laid_out(groups: DataFrame, bounds: list[tuple[str, float]], orders: list[int]) -> DataFrame:
    """(order, group_id, size, split): the groups laid end to end in each of the hash orders, and the line cut at the bounds.

    The running sum is taken over 1,024 ranges of the hash and then within each, never in one task.
    """
    rows = groups.withColumn("order", F.explode(F.array(*map(F.lit, orders)))).withColumn("h", F.xxhash64("group_id", "order")).withColumn("range", F.shiftrightunsigned("h", 54))
    w = Window.partitionBy("order").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # 1,024 rows of each
    ranges = rows.groupBy("order", "range").agg(F.sum("size").alias("n")).select("order", "range", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    inner = Window.partitionBy("order", "range").orderBy("h", "group_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(F.broadcast(ranges), ["order", "range"]).withColumn("middle", F.col("base") + F.sum("size").over(inner) - F.col("size") / 2)
    split = F.lit(bounds[-1][0] if bounds else None).cast("string")
    for s, top in reversed(bounds[:-1]):
        split = F.when(F.col("middle") < top, F.lit(s)).otherwise(split)
    return placed.select("order", "group_id", "size", split.alias("split"))


def split_related(episodes: DataFrame, frames: DataFrame, targets: DataFrame, orders: int = ORDERS) -> DataFrame:
    """(episode_index, group_id, n_frames, split): every episode of either table in one split, related ones together.

    Groups are laid end to end in the order of a hash and the line of all frames is cut at the target shares; a group lies where its
    middle does, whatever its size. Of `orders` such orders the one is taken whose shares come nearest to the targets (the first of
    equals), so that a group with a third of all frames doesn't spoil them. Episodes without relations are groups of their own, those
    without frames included. targets: split, target_share; at most 1,000 rows; none gives split null.
    """
    names = [r for r in exact(targets, "split", "target_share").where("split is not null and target_share > 0").orderBy("split").limit(1_001).collect()]
    if len(names) > 1_000:
        raise ValueError("targets has more than 1,000 rows")
    related = related_episodes(episodes).select("episode_index", F.col("group_id").alias("g"))
    rows = cut(attach(_sizes(episodes, frames), related, "episode_index", "left").select("episode_index", F.coalesce("g", "episode_index").alias("group_id"), "n_frames"))
    groups = cut(rows.groupBy("group_id").agg(F.sum("n_frames").alias("size")))
    total = groups.agg(F.sum("size")).first()[0] or 0
    shares = {r["split"]: r["target_share"] for r in names}
    whole = sum(shares.values())
    edges = np.cumsum([shares[s] / whole * total for s in sorted(shares)])
    bounds = list(zip(sorted(shares), map(float, edges), strict=True))
    best = 0
    if bounds and total:
        got: dict[int, dict[str, int]] = {}
        for r in _laid_out(groups, bounds, list(range(orders))).groupBy("order", "split").agg(F.sum("size").alias("size")).collect():  # orders x splits rows
            got.setdefault(r["order"], {})[r["split"]] = r["size"]
        best = min(got, key=lambda k: (max(abs(got[k].get(s, 0) / total - x / whole) for s, x in shares.items()), k))
    put = _laid_out(groups, bounds, [best]).select("group_id", "split")
    return attach(rows, put, "group_id").select("episode_index", "group_id", "n_frames", "split")


def split_shares(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, target_share, n_episodes, n_frames, actual_share) of what split_related gives."""
    got = rows.groupBy("split").agg(F.count("*").alias("n_episodes"), F.sum("n_frames").alias("n_frames"))
    all_frames = F.sum("n_frames").over(Window.partitionBy())  # one row per split
    got = got.withColumn("actual_share", F.col("n_frames") / all_frames)
    zero = F.lit(0).cast("long")
    return targets.select("split", "target_share").join(got, "split", "left").select(
        "split", "target_share", F.coalesce("n_episodes", zero).alias("n_episodes"), F.coalesce("n_frames", zero).alias("n_frames"), F.coalesce("actual_share", F.lit(0.0)).alias("actual_share")
    )
