"""Mixing sources to target weights, with DataFrame functions only.

1. Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share `share` times all sizes; a target
   stops at `most` times its source's size and the excess goes to the others by weight (water filling, by one sort).
2. Blocks: each source's rows are dealt by hash into blocks of a bounded number of rows, which a hash permutes. A source's
   quota of words is a number of block draws: some whole passes over its blocks and then a part of the permuted sequence.
3. Splitting tree: the exact numbers of block draws of all sources are halved again and again by multivariate
   hypergeometric draws until each output shard has its own quota of each source.
4. Draws: a shard takes the next so many of the permuted draws that no shard before it took. What is taken of a block is
   what shards draw of it; the last draw of a source ends within its block, at a hash, so the quota is met to the word.
5. Local shuffle: each draw of a row has a seeded hash by shard, pass and row, and a shard's draws are in its order.

The draws depend on seed, source and node only, so reruns agree. The tree's state is one row for each node with a number
for each source, and never a row for each document; one task holds the sources (a name and some numbers each).

Defined cases: null and empty texts have size 0 and nothing of them is taken; rows with a null source form one source;
a null doc_id is dealt like a value; repeated rows are rows of their own, and where a source's last draw ends at some of
them they share what is left evenly (up to a word each is then missing); an empty table gives an empty result. Columns of
docs are passed through, but for those named like a column of the result, which the result's replace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import let, lookup, staged

WEIGHTS, SHARE, MOST, SHARDS, SEED = (3, 1, 2), 1.5, 2, 8, 42
BLOCK_ROWS, LEAST_BLOCKS = 20_000, 16
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def prepared(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED) -> DataFrame:
    """docs with __source, __size (words) and __h (the hash that deals and orders rows)."""
    return docs.withColumns({"__source": F.col(source).cast("string"), "__size": n_words(F.col(text)), "__h": F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text))})


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """__source, source_size, rows, rank, target, quota (whole words) for each source of prepared rows."""
    sums = docs.groupBy("__source").agg(F.sum("__size").alias("source_size"), F.count("*").alias("rows"))
    order = W.orderBy(F.col("__source").asc_nulls_last())  # as many rows as sources
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = sums.withColumn("rank", F.row_number().over(order) - 1).withColumn("w", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    filled = W.orderBy(F.col("cap") / F.col("w"), "rank")
    everything = W.partitionBy()
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    from_here = filled.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(from_here)
    levels = ranked.withColumn("level", level).withColumn("level", F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), F.col("rank"), F.col("level")))).over(everything)["level"])
    target = F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap")), F.col("cap"))
    return levels.select("__source", "source_size", "rows", "rank", target.alias("target"), F.floor(target + 0.5).cast("bigint").alias("quota"))


def hypergeometric(good: Column, total: Column, draws: Column, u: Column) -> Column:
    """The number of good ones among `draws` of `total`, by inverting the distribution from its mode outwards at u in [0, 1)."""
    lo, hi = F.greatest(F.lit(0).cast("bigint"), draws - (total - good)), F.least(draws, good)
    mode = F.least(hi, F.greatest(lo, F.floor((draws + 1) * (good + 1) / (total + 2).cast("double")).cast("bigint")))

    def body(p: Column) -> Column:
        rest = p.total - p.good - p.draws
        nothing = F.array().cast("array<bigint>")
        ups = F.when(p.hi > p.mode, F.sequence(p.mode + 1, p.hi)).otherwise(nothing)
        downs = F.when(p.mode > p.lo, F.sequence(p.mode, p.lo + 1, F.lit(-1).cast("bigint"))).otherwise(nothing)
        grow = lambda x: (p.good - x + 1).cast("double") * (p.draws - x + 1) / (x.cast("double") * (rest + x))  # noqa: E731  weight of x over that of x - 1

        def walk(steps: Column, ratio, value, begin: Column, at: Column) -> Column:
            """Weights along steps; found: the first value where their running sum exceeds `at`."""
            start = F.struct(F.lit(1.0).alias("w"), begin.alias("s"), F.lit(None).cast("bigint").alias("found"))

            def step(a: Column, x: Column) -> Column:
                w = a.w * ratio(x)
                return F.struct(w.alias("w"), (a.s + w).alias("s"), F.when(a.found.isNull() & (a.s + w > at), value(x)).otherwise(a.found).alias("found"))

            return F.aggregate(steps, start, step)

        up = lambda at: walk(ups, grow, lambda x: x, F.lit(1.0), at)
        down = lambda begin, at: walk(downs, lambda x: 1 / grow(x), lambda x: x - 1, begin, at)
        never = F.lit(float("inf"))
        sums = F.struct(up(never).s.alias("up"), down(F.lit(0.0), never).s.alias("down"))

        def pick(z: Column) -> Column:
            at = p.u * (z.up + z.down)
            return F.when(at < 1, p.mode).otherwise(F.coalesce(up(at).found, down(z.up, at).found, p.mode))

        return let(sums, pick)

    return let(F.struct(good.alias("good"), total.alias("total"), draws.alias("draws"), u.alias("u"), lo.alias("lo"), hi.alias("hi"), mode.alias("mode")), body)


def _halved(k: Column, node: Column, seed: int) -> Column:
    """The left half's numbers: a multivariate hypergeometric draw of half of all, source by source."""
    total = F.aggregate(k, F.lit(0).cast("bigint"), lambda a, x: a + x)
    start = F.struct(total.alias("total"), F.floor(total / 2).cast("bigint").alias("draws"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, F.size(a.out)), 11) * F.lit(2.0**-53)
        got = F.when(x == 0, F.lit(0).cast("bigint")).otherwise(hypergeometric(x, a.total, a.draws, u))
        return let(got, lambda n: F.struct((a.total - x).alias("total"), (a.draws - n).alias("draws"), F.concat(a.out, F.array(n)).alias("out")))

    return F.aggregate(k, start, step).out


def split_quotas(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rank, shard, first, stop: each shard's range of every source's draws; quotas: rank (from 0), draws. shards: a power of 2."""
    if shards & (shards - 1):
        raise ValueError("shards must be a power of 2")
    k = F.transform(F.array_sort(F.collect_list(F.struct("rank", "draws"))), lambda x: x.draws)
    nodes = quotas.agg(k.alias("k")).withColumn("node", F.lit(1))
    for _ in range(shards.bit_length() - 1):
        nodes = nodes.withColumn("left", _halved(F.col("k"), F.col("node"), seed))
        right = F.zip_with("k", "left", lambda a, b: a - b)
        nodes = nodes.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("k")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("k")))).alias("x")).select("x.*")
    leaves = nodes.select((F.col("node") - shards).alias("shard"), F.posexplode("k").alias("rank", "n"))
    stop = F.sum("n").over(W.partitionBy("rank").orderBy("shard"))
    return leaves.select("rank", "shard", (stop - F.col("n")).alias("first"), stop.alias("stop"))


def plan(rows: DataFrame, shards: int = SHARDS, seed: int = SEED, **how) -> DataFrame:
    """A row for each source and block of prepared rows: in which shards' draws its rows are, by pass, and up to which hash
    the last one takes them (at_hash, of which rows at_words)."""
    sources = staged(targets(rows, **how).withColumn("blocks", F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("rows") / BLOCK_ROWS))), "mix-sources")
    dealt = lookup(rows.select("__source", "__size", "__h"), sources, ["__source"]).withColumn("__block", _block())
    in_source = W.partitionBy("rank").orderBy(F.xxhash64(F.lit(seed), "__source", "__block"), "__block")
    blocks = dealt.groupBy("__source", "rank", "target", "quota", "source_size", "blocks", "__block").agg(F.sum("__size").alias("words"))
    blocks = blocks.select("*", (F.row_number().over(in_source) - 1).alias("at"), (F.sum("words").over(in_source) - F.col("words")).alias("before"), F.count("*").over(W.partitionBy("rank")).alias("dealt"))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("quota") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("bigint")
    blocks = blocks.withColumn("full", full).withColumn("rest", F.col("quota") - F.col("full") * F.col("source_size"))
    blocks = staged(blocks.withColumn("draws", F.col("full") + F.when(F.col("before") < F.col("rest"), 1).otherwise(0)), "mix-blocks")

    leaves = split_quotas(blocks.groupBy("rank").agg(F.sum("draws").alias("draws")), shards, seed).where("stop > first")
    draws = leaves.select("rank", "shard", F.explode(F.sequence("first", F.col("stop") - 1)).alias("draw"))
    found = draws.join(blocks.groupBy("rank").agg(F.max("dealt").alias("n")), "rank").select("rank", "shard", (F.col("draw") % F.col("n")).alias("at"), F.floor(F.col("draw") / F.col("n")).alias("pass"))
    of_block = found.groupBy("rank", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pass", "shard"))), lambda x: x["shard"]).alias("shards"))  # a block has at most `most` passes
    drawn = blocks.join(of_block, ["rank", "at"], "left").withColumn("shards", F.coalesce("shards", F.array().cast("array<int>")))
    last = F.when(F.size("shards") > F.col("full"), F.least(F.col("words"), F.col("rest") - F.col("before"))).otherwise(0).cast("bigint")
    drawn = staged(drawn.withColumn("last", last), "mix-draws")

    ends = lookup(dealt.select("__source", "__block", "__size", "__h"), drawn.where("last > 0 and last < words").select("__source", "__block", "last"), ["__source", "__block"], "inner")  # one block of each source
    run = W.partitionBy("__source", "__block").orderBy("__h")
    ends = ends.groupBy("__source", "__block", "last", "__h").agg(F.sum("__size").alias("w"), F.count("*").alias("n")).withColumn("before", F.sum("w").over(run) - F.col("w"))
    ends = ends.where("before < last and last <= before + w").select(F.col("__source").alias("__s"), F.col("__block").alias("__b"), F.col("__h").alias("at_hash"), F.floor((F.col("last") - F.col("before")) / F.col("n")).alias("at_words"))
    joined = drawn.join(ends, drawn["__source"].eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")), "left")
    return staged(joined.select("__source", "__block", "blocks", "source_size", "target", "full", "last", "shards", "at_hash", "at_words"), "mix-plan")


def _block() -> Column:
    return F.pmod(F.col("__h"), F.col("blocks"))


def mixed(rows: DataFrame, blocks: DataFrame, seed: int = SEED) -> DataFrame:
    """Prepared rows with source_size, target, taken (words), shards (of each pass that takes of the row) and places (in them)."""
    sources = blocks.select("__source", "blocks").distinct()
    found = lookup(lookup(rows, sources, ["__source"]).withColumn("__block", _block()), blocks.drop("blocks"), ["__source", "__block"])
    within = F.when(F.col("at_hash").isNull() | (F.col("__h") < F.col("at_hash")), F.col("__size")).when(F.col("__h") == F.col("at_hash"), F.col("at_words")).otherwise(0)
    found = found.withColumn("__last", F.when(F.col("last") > 0, within).otherwise(0).cast("bigint"))
    passes = F.when(F.col("__size") == 0, 0).otherwise(F.col("full") + F.when(F.col("__last") > 0, 1).otherwise(0)).cast("int")
    out = found.withColumns({"taken": F.col("full") * F.col("__size") + F.col("__last"), "shards": F.slice("shards", F.lit(1), passes)})
    places = F.transform("shards", lambda shard, i: F.xxhash64(F.lit(seed), shard, i, F.col("__h")))
    return out.withColumn("places", places).drop("__block", "blocks", "full", "last", "__last", "at_hash", "at_words")


RESULT = ("source_size", "target", "taken", "shards", "places")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep: list[str] | None = None, **how) -> DataFrame:
    """docs (or their columns `keep`) with __size, source_size, target, taken, shards and places: what a shard holds is
    ordered by its place. Texts that are not kept are read once, else twice."""
    seed = how.get("seed", SEED)
    columns = {f"__in{i}": c for i, c in enumerate(docs.columns)}  # none of these clashes
    renamed = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])
    at = {c: k for k, c in columns.items()}
    rows = prepared(renamed, at[doc_id], at[source], at[text], seed)
    kept = [(k, c) for k, c in columns.items() if c not in (*RESULT, "__size") and (keep is None or c in keep)]
    if keep is not None and text not in keep:
        rows = narrow = staged(rows.select(*[k for k, _ in kept], "__source", "__size", "__h"), "mix-rows")
    else:
        narrow = staged(rows.select("__source", "__size", "__h"), "mix-rows")
    found = mixed(rows, plan(narrow, **how), seed)
    return found.select(*[F.col(k).alias(c) for k, c in kept], "__size", *RESULT)


def drawn_copies(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows: each row of docs as often as it is taken (a part counts from a half on), columns as they were.

    Partitions are in the order of shards, several to a shard, and rows in that of their places.
    """
    columns = docs.columns
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"__in{i}") for i, c in enumerate(columns)])
    at = {c: f"__in{i}" for i, c in enumerate(columns)}
    found = mix(renamed, at["doc_id"], at["source"], at["text"], **how)
    copies = F.floor((F.col("taken") * 2 + F.col("__size")) / (F.greatest(F.col("__size"), F.lit(1)) * 2)).cast("int")
    out = found.where("__size > 0").withColumn("__copies", copies).where("__copies > 0")
    drawn = F.slice(F.arrays_zip(F.col("shards").alias("shard"), F.col("places").alias("place")), F.lit(1), F.col("__copies"))
    out = out.select(*at.values(), F.explode(drawn).alias("__at")).select(*at.values(), F.col("__at.shard").alias("__shard"), F.col("__at.place").alias("__place"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // how.get("shards", SHARDS))
    part = F.least(F.lit(parts - 1), F.floor((F.col("__place") / F.lit(2.0**64) + 0.5) * parts).cast("int"))
    out = out.repartitionById(parts * how.get("shards", SHARDS), (F.col("__shard") * parts + part).cast("int")).sortWithinPartitions("__shard", "__place")
    return out.select(*[F.col(f"__in{i}").alias(c) for i, c in enumerate(columns)])
