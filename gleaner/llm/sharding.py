"""Shards of even size that keep linked documents together.

Balanced label propagation. Documents are linked through groups (here: equal
texts), so a group of n costs n rows, never n * n links. Every document starts
in the shard its hash gives. In each round a group counts its members per
shard, its members ask to move to the shard where most of them are, and a shard
admits whole groups, in an order drawn anew each round, up to its quota. A
group larger than the quota fills shard after shard. A last step makes the
shards exactly even: what a shard has too much, documents without links first,
fills the places that others lack.

Law ``rows``: the sizes differ by one document at most. Ranks within a shard
are taken in buckets of bounded size and lifted by sums over the buckets, so no
task sees a whole shard or group. Only one row per shard reaches the driver.

A null text counts no bytes and is linked to nothing; empty texts are equal
texts. Rows with equal or null ids are rows of their own. An empty table gives
an empty result. Further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.common import stored

SHARDS = 40
ROUNDS = 6
VOTED_ROUNDS = 3
BUCKET_ROWS = 20_000
DRAWS = 1024


def _fraction(*columns) -> Column:
    """A number from 0 to 1, fixed by the columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _ranked(rows: DataFrame, bucket: Column, order: list[str], into: str) -> DataFrame:
    """``into``: the place from 0 of every row within its shard, in the order of
    ``bucket`` and then ``order``."""
    rows = rows.withColumn("_bucket", bucket)
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(within) - 1).join(start, ["shard", "_bucket"])
    return ranked.withColumn(into, F.col("_start") + F.col("_rank")).drop("_bucket", "_rank", "_start")


def _round(state: DataFrame, shards: int, quota: int, turn: int) -> DataFrame:
    """One round of moves: groups ask for shards, shards admit up to their quota."""
    votes = state.filter("parts > 0").groupBy("hub", "shard", "members", "parts").agg(F.count("*").alias("votes"))
    liked = Window.partitionBy("hub").orderBy(F.desc("votes"), F.xxhash64("hub", "shard", F.lit(turn)), "shard")
    # A small group that its own shards have refused asks a drawn one.
    places = F.count("*").over(Window.partitionBy("hub"))
    refused = F.lit(turn >= VOTED_ROUNDS) & (F.col("parts") == 1) & (F.col("places") > 1)
    drawn = F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(shards)).cast("int")
    asked = (
        votes.withColumns({"part": F.row_number().over(liked), "places": places})
        .filter("part <= parts")
        .select("hub", "part", F.when(refused, drawn).otherwise(F.col("shard")).alias("target"), F.ceil(F.col("members") / F.col("parts")).alias("room"))
    )
    # Large groups first, then in a drawn order; sums over buckets of that order.
    size_class = -F.floor(F.col("room") * 8 / F.lit(quota))
    asked = asked.withColumn("bucket", size_class * DRAWS + F.floor(_fraction("hub", F.lit(turn)) * DRAWS))
    up_to = Window.partitionBy("target").orderBy("bucket")
    filled = asked.groupBy("target", "bucket").agg(F.sum("room").alias("sum"))
    filled = filled.select("target", "bucket", F.sum("sum").over(up_to).alias("filled")).filter(F.col("filled") <= quota)
    admitted = asked.join(filled, ["target", "bucket"]).select("hub", "part", "target")
    moved = state.withColumn("part", F.when(F.col("parts") > 0, F.pmod(F.xxhash64("row"), "parts") + 1))
    return moved.join(admitted, ["hub", "part"], "left").select(
        *[F.coalesce("target", "shard").alias("shard") if c == "shard" else F.col(c) for c in state.columns]
    )


def _balanced(state: DataFrame, shards: int, total: int) -> DataFrame:
    """Exactly even shards; documents without links give way first."""
    have = {r["shard"]: r["count"] for r in state.groupBy("shard").count().collect()}  # one row per shard
    have = [have.get(s, 0) for s in range(shards)]
    # Fuller shards keep the larger share, so that fewer documents move.
    want = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-have[s], s))[: total % shards]:
        want[s] += 1
    starts, spare = [], 0
    for s in range(shards):
        starts.append(spare)
        spare += max(0, have[s] - want[s])
    target, upto = F.lit(None).cast("int"), 0
    bounds = []
    for s in range(shards):
        if have[s] < want[s]:
            upto += want[s] - have[s]
            bounds.append((upto, s))
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("shard") + 1)
    buckets = max(1, math.ceil(total / shards / BUCKET_ROWS))
    # Within a shard, groups that are whole come first, then the parts of groups
    # that no shard could hold, then documents without links: the last give way.
    spread = F.floor(_fraction("row") * buckets)
    bucket = (
        F.when(F.col("parts") == 0, spread + 2 * buckets)
        .when(F.col("parts") > 1, spread + buckets)
        .otherwise(F.floor(_fraction("hub") * buckets))
    )
    ranked = _ranked(state, bucket, ["hub", "row"], "_place")
    index = of(starts) + F.col("_place") - of(want)
    for upto, s in reversed(bounds):
        target = F.when(index < upto, F.lit(s)).otherwise(target)
    moved = F.when(F.col("_place") >= of(want), target).otherwise(F.col("shard"))
    return ranked.withColumn("shard", moved).drop("_place")


def propagate(rows: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``rows(row, hub, ...)`` with ``shard`` and ``slot``, the place in it.

    ``row`` is a number of its own for every row, ``hub`` its group; rows of a
    group are linked, those with a null hub are not. ``rows`` is read several
    times, so pass a stored table."""
    total = rows.count()
    quota = max(1, math.ceil(total / shards))
    groups = rows.filter("hub is not null").groupBy("hub").agg(F.count("*").alias("members")).filter("members > 1")
    members = F.coalesce("members", F.lit(0))
    state = rows.join(groups, "hub", "left").select(
        *rows.columns,
        members.alias("members"),
        F.ceil(members / F.lit(quota)).cast("long").alias("parts"),
        F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"),
    )
    state = stored(state, "shards")
    for turn in range(rounds if total else 0):
        state = stored(_round(state, shards, quota, turn), "shards")
    state = stored(_balanced(state, shards, total), "shards")
    buckets = max(1, math.ceil(total / shards / BUCKET_ROWS))
    slotted = _ranked(state, F.floor(_fraction("row") * buckets), ["row"], "slot")
    return slotted.select(*rows.columns, "shard", "slot")


def shard_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` per document; size
    is the bytes of the text and 16, groups are equal texts."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(content) + 16).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(F.col(text), 256)).alias("hub"),
        F.monotonically_increasing_id().alias("row"),
    )
    placed = propagate(stored(rows, "shard-rows"), shards)
    return placed.select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
