"""Sharding by balanced label propagation.

Documents linked through a hub (here: an equal text) vote with their present
shards; each then moves towards the shard that most of its neighbours are in,
as far as quotas allow. Links are rows (row, hub), never pairs, and votes are
eight sums per hub, so a hub with a third of all rows costs no more than that.
Unlinked documents cost no cut edge anywhere; they fill up the shards, and the
law ``rows`` holds exactly: counts are at most one apart.

Cases: a null text is an empty one, and equal to it. Ids may be null or
repeated: rows are told apart by a number of their own. With fewer rows than
shards the last shards stay empty. An empty table gives no rows.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.functions.staging import stage
from tillscope.llm.common import documents, rank_within

SHARDS = 8
ROUNDS = 8
#: Rows of one shard that meet in a task when they are numbered, about.
SLOT_ROWS = 4_000
_DEALS = 256


def propagate(links: DataFrame, quota: list[int], rounds: int = ROUNDS) -> DataFrame:
    """(row, label): move rows towards the labels of their hubs while no label gets more rows than its quota.

    ``links``: (row, hub), hubs with two rows at least, staged. Each round
    collects only demand per (label, target, one of 256 hub hashes).
    """
    k = len(quota)
    state = stage(links.select("row").distinct().withColumn("label", F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")), "labels")
    for turn in range(rounds):
        loads = dict(state.groupBy("label").count().collect())
        free = [quota[i] - loads.get(i, 0) for i in range(k)]
        votes = links.join(state.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row")).groupBy("hub").agg(
            *(F.sum((F.col("label") == i).cast("long")).alias(f"v{i}") for i in range(k)))
        # a label that is full may keep its rows but draws a hub only if most of the hub is there already
        best = F.greatest(*(F.struct((F.col(f"v{i}") if free[i] > 0 else F.col(f"v{i}") / 2).cast("double").alias("votes"),
                                     F.xxhash64("hub", F.lit(i)).alias("tie"), F.lit(i).alias("target")) for i in range(k)))
        choice = stage(votes.select(F.col("hub").alias("_hub"), best.alias("best")), "choice")
        pulls = links.join(choice, F.col("hub") == F.col("_hub")).groupBy("row").agg(F.max(F.struct("best.votes", "hub", "best.target")).alias("pull"))
        wish = state.join(pulls.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row")).select(
            "row", "label", F.col("pull.target").alias("target"), F.pmod(F.xxhash64(F.col("pull.hub"), F.lit(turn)), F.lit(_DEALS)).cast("int").alias("deal"))
        wish = stage(wish, "wishes")
        demand = wish.where("label <> target").groupBy("label", "target", "deal").count().collect()
        if not demand:
            break
        leave = [sum(r["count"] for r in demand if r["label"] == i) for i in range(k)]
        admit = F.lit(False)
        moved = False
        for i in range(k):
            room = max(0, free[i]) + (9 * leave[i] // 10 if free[i] > 0 else leave[i] // 2)
            wants = [0] * _DEALS
            for r in demand:
                if r["target"] == i:
                    wants[r["deal"]] += r["count"]
            deal, at = 0, 0
            while deal < _DEALS and at + wants[deal] <= room:
                at += wants[deal]
                deal += 1
            part = (room - at) / wants[deal] if deal < _DEALS else 0.0
            moved |= at > 0 or part > 0
            some = (F.col("deal") == deal) & (F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(1 << 20)) < int(part * (1 << 20)))
            admit = admit | ((F.col("target") == i) & ((F.col("deal") < deal) | some))
        state = stage(wish.select("row", F.when(admit, F.col("target")).otherwise(F.col("label")).alias("label")), "labels")
        if not moved:
            break
    return state


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document, equal texts together where quotas allow."""
    text = F.coalesce("text", F.lit(""))
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                             F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("hub")), "rows")
    n = rows.count()
    quota = [n // shards + (i < n % shards) for i in range(shards)]
    hubs = stage(rows.groupBy("hub").count().where("count > 1").select(F.col("hub").alias("_hub")), "hubs")
    links = stage(rows.join(hubs, F.col("hub") == F.col("_hub")).select("row", "hub"), "linked")
    state = propagate(links, quota)
    full = stage(rows.join(state.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left").drop("_row"), "labelled")
    loads = dict(full.where("label is not null").groupBy("label").count().collect())
    buckets = max(1, -(-n // SLOT_ROWS))
    side = math.isqrt(buckets - 1) + 1  # rows of a hub stay near each other, but a hub of any size is spread
    spread = F.pmod(F.xxhash64("hub"), F.lit(side)) * side + F.pmod(F.xxhash64("row"), F.lit(side))
    if any(loads.get(i, 0) > quota[i] for i in range(shards)):
        # give back what is above a quota, by hubs as far as possible
        held = rank_within(full.where("label is not null"), ["label"], spread, ["hub", "row"], "place")
        over = F.array(*(F.lit(q) for q in quota))[F.col("label")]
        held = held.withColumn("label", F.when(F.col("place") < over, F.col("label"))).drop("place")
        full = stage(held.select(*full.columns).union(full.where("label is null").select(*full.columns)), "labelled")
        loads = {i: min(loads.get(i, 0), quota[i]) for i in range(shards)}
    # rows without a label fill what is left of the quotas, one shard after another
    loose = rank_within(full.where("label is null").withColumn("one", F.lit(0)), ["one"], spread, ["hub", "row"], "place")
    fill, upto = F.when(F.lit(False), 0), 0
    for i in range(shards):
        upto += quota[i] - loads.get(i, 0)
        fill = fill.when(F.col("place") < upto, i)
    columns = ["row", "doc_id", "size", "text_crc32", "hub"]
    placed = stage(full.where("label is not null").select(*columns, F.col("label").alias("shard"))
                   .union(loose.select(*columns, fill.cast("int").alias("shard"))), "placed")
    return rank_within(placed, ["shard"], F.pmod(F.xxhash64("row"), F.lit(buckets)), ["row"], "slot").drop("hub", "row")


def op1_label_propagation(spark, folder: str) -> DataFrame:
    out = shard_rows(documents(spark, folder))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
