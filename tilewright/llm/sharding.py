"""Sharding by balanced label propagation, with DataFrame functions only.

Documents with equal texts are linked; the aim is to keep them in one shard while every shard gets as many rows as any
other, at most one apart (law `rows`).

Linked documents that start in the same shard move alike, so they are contracted to cells: the rows of a group that share
their first shard and one of SUBS hash parts. A group has at most shards * SUBS cells, however many rows it has. In each
round every cell learns how many rows of its group each shard holds and asks to move to the fullest one that has room, if
that holds more than its own. A shard's room is its quota less the rows that want to stay, and requests are admitted in
hash order up to it. Rounds work on cells and their small sums only, and each is written to the shared folder.

At last the sizes are made exact: a shard's rows are ranked (linked rows that want to stay, linked rows that do not, rows
without links), and those beyond its quota fill the gaps of the others.

Defined cases: a null text has no bytes and counts as equal to the empty one; null and repeated doc_ids are rows like any
other; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import lookup, staged

SHARDS, ROUNDS, SUBS, SEED = 8, 10, 64, 42
QUEUE, BUCKET_ROWS, NEARLY_FULL = 256, 50_000, 8
GROUP = ["size", "text_crc32", "g"]
CELL = [*GROUP, "s0", "sub"]


def rows_of(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, the group key and the cell of each row."""
    data = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(data) + 1).cast("bigint").alias("size"),
        F.crc32(data.cast("binary")).alias("text_crc32"),
        F.xxhash64(data).alias("g"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id)), F.lit(shards)).cast("int").alias("s0"),
        F.pmod(F.xxhash64(F.lit(seed + 1), F.col(doc_id)), F.lit(SUBS)).cast("int").alias("sub"),
    )


def linked_cells(rows: DataFrame) -> DataFrame:
    """Cells (n rows each) of groups of two rows or more, with their first label."""
    cells = rows.groupBy(*CELL).agg(F.count("*").alias("n"))
    return cells.withColumn("all", F.sum("n").over(W.partitionBy(*GROUP))).where("all > 1").drop("all").withColumn("label", F.col("s0"))


def _asked(cells: DataFrame, room: list[int], least: int, turn: int) -> DataFrame:
    """Cells with the shard they ask for in `to`, null if they want to stay; shards with no more room than `least` are as
    full ones, lest many rows ask for the last places over and over."""
    free = F.array(*[F.lit(int(x)).cast("bigint") for x in room])
    here = F.sum("n").over(W.partitionBy(*GROUP, "label"))
    seen = cells.withColumn("here", here).withColumn("draw", F.xxhash64(*GROUP, "label"))
    best = F.max(F.when(F.element_at(free, F.col("label") + 1) > least, F.struct("here", "draw", "label"))).over(W.partitionBy(*GROUP))
    gains = (F.col("best.label") != F.col("label")) & (F.struct("best.here", "best.draw") > F.struct("here", "draw"))
    queue = F.pmod(F.xxhash64(F.lit(turn), *CELL), F.lit(QUEUE)).cast("int")
    return seen.withColumn("best", best).select(*CELL, "n", "label", F.when(gains, F.col("best.label")).alias("to"), queue.alias("queue"))


def _admitted(asked: DataFrame, room: list[int]) -> DataFrame:
    """to, queue of the requests that fit: at most shards * QUEUE rows."""
    free = F.array(*[F.lit(int(x)).cast("bigint") for x in room])
    flows = asked.where("`to` is not null").groupBy("to", "queue").agg(F.sum("n").alias("n"))
    run = F.sum("n").over(W.partitionBy("to").orderBy("queue"))
    return flows.withColumn("run", run).where(F.col("run") <= F.element_at(free, F.col("to") + 1)).select("to", "queue", F.lit(True).alias("admitted"))


def propagate(cells: DataFrame, capacity: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Cells with labels after some rounds, and settled: whether they want to stay there."""
    now, room = staged(cells, "cells"), [capacity] * shards
    for turn in range(rounds + 1):
        asked = staged(_asked(now, room, capacity // NEARLY_FULL, turn), "cells")
        load = {r["label"]: r["n"] for r in asked.where("`to` is null").groupBy("label").agg(F.sum("n").alias("n")).collect()}  # at most `shards` rows
        room = [max(0, capacity - load.get(s, 0)) for s in range(shards)]
        admitted = staged(_admitted(asked, room), "admitted")
        if turn == rounds or admitted.isEmpty():
            break
        moved = asked.join(F.broadcast(admitted), ["to", "queue"], "left")  # at most shards * QUEUE rows
        now = staged(moved.select(*CELL, "n", F.when(F.col("admitted"), F.col("to")).otherwise(F.col("label")).alias("label")), "cells")
    return asked.select(*CELL, "n", "label", F.col("to").isNull().alias("settled"))


def _at(values: list[int], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)).cast("bigint") for v in values]), (k + 1).cast("int"))


def even(rows: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows with label and class (what has to move goes by it, the highest first) as shard and slot, shards being at most one
    row apart."""
    counted = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # at most `shards` rows
    have = [counted.get(s, 0) for s in range(shards)]
    total = sum(have)
    larger = sorted(range(shards), key=lambda s: (-have[s], s))[: total % shards]  # the fullest keep the odd rows
    quota = [total // shards + (s in larger) for s in range(shards)]
    excess = [max(0, h - q) for h, q in zip(have, quota, strict=True)]
    gaps = [max(0, q - h) for h, q in zip(have, quota, strict=True)]
    first_excess, first_gap = [0, *accumulate(excess)], [0, *accumulate(gaps)]
    buckets = max(16, total // BUCKET_ROWS)
    cell = F.xxhash64(*CELL)
    placed = rows.withColumn("cell", cell).withColumn("bucket", F.pmod("cell", F.lit(buckets)))
    sums = placed.groupBy("label", "class", "bucket").agg(F.count("*").alias("n"))
    order = W.partitionBy("label").orderBy("class", "bucket")
    offsets = sums.select("label", "class", "bucket", (F.sum("n").over(order) - F.col("n")).alias("offset"))
    placed = lookup(placed, offsets, ["label", "class", "bucket"], rows=3 * shards * buckets)
    rank = F.col("offset") + F.row_number().over(W.partitionBy("label", "class", "bucket").orderBy("cell", "doc_id", "size")) - 1
    placed = placed.withColumn("rank", rank).withColumn("over", F.col("rank") - _at(quota, F.col("label")) + _at(first_excess, F.col("label")))
    stays = F.col("rank") < _at(quota, F.col("label"))
    to = sum((F.when(F.col("over") >= x, 1).otherwise(0) for x in first_gap[1:-1]), F.lit(0))
    placed = placed.withColumn("shard", F.when(stays, F.col("label")).otherwise(to).cast("int"))
    slot = F.when(stays, F.col("rank")).otherwise(_at(have, F.col("shard")) + F.col("over") - _at(first_gap, F.col("shard")))
    return placed.withColumn("slot", slot.cast("bigint"))


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    rows = staged(rows_of(docs, shards, doc_id, text), "shard-rows")
    total = rows.count()
    cells = propagate(linked_cells(rows), total // shards, shards, rounds)
    labelled = rows.join(cells.select(*CELL, "label", "settled"), CELL, "left")
    rank = F.when(F.col("label").isNull(), 2).when(F.col("settled"), 0).otherwise(1)
    labelled = staged(labelled.select(*rows.columns, rank.alias("class"), F.coalesce("label", "s0").alias("label")), "shard-labels")
    return even(labelled, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def cut_links(result: DataFrame) -> DataFrame:
    """How much of the links a result cuts: rows beside their group's fullest shard."""
    parts = result.groupBy("size", "text_crc32", "shard").agg(F.count("*").alias("n")).groupBy("size", "text_crc32").agg(F.sum("n").alias("rows"), F.max("n").alias("kept"))
    return parts.agg(F.sum(F.col("rows") - F.col("kept")).alias("cut_rows"), F.sum(F.when(F.col("rows") > 1, F.col("rows"))).alias("linked_rows"))
