"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into 3 segments. Fingerprints that differ in at most 4 bits differ in at most one bit of some
segment, so they share a variant of that segment with one bit wiped out. All 64 one-wildcard variants of each distinct
fingerprint are joined by equality (rows of a key meet in one sorted run) and verified on the whole fingerprints.

Within a key's run only as many verified links leave as keep its linked fingerprints connected, so a run of n
fingerprints gives less than n rows. Equal fingerprints are one node from the start. Hot keys are cut before the shuffle:
segment values are counted first, and a key that more than LARGE fingerprints may share is dealt by the bits outside its
segment, in DISTANCE + 1 pieces of which linked fingerprints have one in common. Runs that are still too long for comparing
all with all are cut in the same way, again and again, by the bits in which they differ.

Defined cases: null and empty texts have the fingerprint zero and are linked like any other; repeated rows keep one row
each; rows with a null doc_id get their component but never name one, a component of such rows only has a null id; an
empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import BROADCAST_ROWS, lookup, staged, text_batches, utf8
from tilewright.llm.graph import components

SEED, WORDS, BITS, DISTANCE = 42, 4, 64, 4
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Runs up to SMALL rows are compared by offsets, up to LARGE as one matrix, and longer ones are cut first.
SMALL, LARGE = 16, 4096
#: Links that a task remembers in order not to repeat them; beyond that it forgets and repeats.
REMEMBERED = 1 << 20

_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of the shingles of a text, unsigned."""
    found = text.lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    k = min(words, len(found))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=False)], np.uint64)
    octets = h.view(np.uint8).reshape(-1, 8)
    counts = np.stack([np.bincount(octets[:, j], minlength=256) @ _BIT_OF_BYTE for j in range(8)]).ravel()
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(T.LongType())
def fingerprint_of(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(x) for x in utf8(texts)], np.uint64).view(np.int64))


def _segment(fp: Column, first: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))


def variants(fp: Column) -> Column:
    """The 64 one-wildcard keys of a fingerprint: which bit is wiped out, and its segment without it."""
    keys = []
    for first, bits in SEGMENTS:
        segment = _segment(fp, first, bits)
        keys += [segment.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << j))).bitwiseOR(F.lit((first + j) << 32)) for j in range(bits)]
    return F.array(*keys)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _matrix_links(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(fingerprint, root) of each connected set among distinct fingerprints, by growing one set after another."""
    out, rest = [], fps
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for part in np.array_split(front, -(-len(front) * len(rest) // (1 << 22))):
                near |= (_distance(part[:, None], rest[None, :]) <= distance).any(0)
            front, rest = rest[near], rest[~near]
            out += [(int(x), int(root)) for x in front]
    return out


def _pieces(bits: list[int], distance: int) -> list[int]:
    """Masks of distance + 1 pieces of the bits: what differs in at most `distance` of these agrees in one piece."""
    return [sum(1 << int(b) for b in piece) for piece in np.array_split(bits, distance + 1)]


def run_links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that connect what is linked among distinct fingerprints."""
    differing = int(np.bitwise_or.reduce(fps ^ fps[0])) if len(fps) > LARGE else 0
    bits = [b for b in range(BITS) if differing >> b & 1]
    if len(bits) <= distance:  # few rows, or all are linked
        return _matrix_links(fps, distance)
    out = []
    for mask in _pieces(bits, distance):
        masked = fps & np.uint64(mask)
        order = np.argsort(masked, kind="stable")
        key = masked[order]
        for part in np.split(fps[order], np.flatnonzero(key[1:] != key[:-1]) + 1):
            if len(part) > 1:
                out += run_links(part, distance)  # differs in fewer bits than before
    return out


def _links(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of whole runs, sorted by key."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    for k in np.flatnonzero(sizes > SMALL):
        a, n = starts[k], sizes[k]
        yield from run_links(fps[a : a + n])
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    keys, fps = keys[small], fps[small]
    for d in range(1, min(SMALL, len(keys))):
        near = (keys[d:] == keys[:-d]) & (_distance(fps[d:], fps[:-d]) <= DISTANCE)
        yield from zip(fps[d:][near].tolist(), fps[:-d][near].tolist(), strict=True)


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: set[tuple[int, int]] = set()

    def out(rows: list[tuple[int, int]]) -> pa.RecordBatch:
        pair = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.record_batch([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])

    def fresh(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        nonlocal seen
        rows = set(_links(keys, fps)) - seen
        seen |= rows
        if len(seen) > REMEMBERED:
            seen = set()
        return out(sorted(rows))

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        last = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
        if last or held and held[0][0][0] != keys[-1]:
            whole = [*held, (keys[:last], fps[:last])]
            yield fresh(*(np.concatenate(x) for x in zip(*whole, strict=True)))
            held = []
        held.append((keys[last:], fps[last:]))
    if held:
        yield fresh(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _hot_keys(fps: DataFrame, column: str) -> tuple[DataFrame, bool]:
    """fps with __hot: the bits that leave a key which more than LARGE fingerprints may share; whether there are any.

    A key's fingerprints have one of two values of its segment, so one of these has more than half of them.
    """
    at = [F.struct(F.lit(k).alias("segment"), F.lit(bits).alias("bits"), _segment(F.col(column), first, bits).alias("value")) for k, (first, bits) in enumerate(SEGMENTS)]
    values = fps.select(F.explode(F.array(*at)).alias("x")).groupBy("x.segment", "x.bits", "x.value").count().where(F.col("count") > LARGE // 2)
    own = "array(named_struct('value', value, 'wiped', shiftleft(1L, bits) - 1))"
    beside = "transform(sequence(0, bits - 1), j -> named_struct('value', value ^ shiftleft(1L, j), 'wiped', shiftleft(1L, j)))"
    around = values.select("segment", F.expr(f"explode(concat({own}, {beside}))").alias("x"))
    around = staged(around.groupBy("segment", "x.value").agg(F.bit_or("x.wiped").alias("wiped")), "simhash-hot")
    if around.isEmpty():
        return fps, False
    hot = F.lit(0).cast("bigint")
    for k, (first, bits) in enumerate(SEGMENTS):
        of_segment = around.where(F.col("segment") == k).select(F.col("value").alias(f"__value{k}"), F.col("wiped").alias(f"__wiped{k}"))
        fps = lookup(fps.withColumn(f"__value{k}", _segment(F.col(column), first, bits)), of_segment, [f"__value{k}"])
        hot = hot.bitwiseOR(F.shiftleft(F.coalesce(f"__wiped{k}", F.lit(0).cast("bigint")), first))
    return fps.withColumn("__hot", hot), True


def _dealt(key: Column, fp: Column) -> Column:
    """The keys of a hot key's parts. They are hashes: what meets by chance is verified like all else."""
    of_segment = []
    for first, bits in SEGMENTS:
        masks = _pieces([b for b in range(BITS) if not first <= b < first + bits], DISTANCE)
        of_segment.append(F.array(*[F.xxhash64(key, F.lit(i), fp.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for i, m in enumerate(masks)]))
    wiped = F.shiftright(key, 32)
    return F.when(wiped < SEGMENTS[1][0], of_segment[0]).when(wiped < SEGMENTS[2][0], of_segment[1]).otherwise(of_segment[2])


def links(fps: DataFrame, column: str = "fp") -> DataFrame:
    """(a, b) of linked distinct fingerprints, enough of them to keep all that is linked connected."""
    marked, any_hot = _hot_keys(fps.select(column), column)
    keyed = marked.select(F.explode(variants(F.col(column))).alias("key"), F.col(column).alias("fp"), *(["__hot"] if any_hot else []))
    if any_hot:
        is_hot = F.expr("(shiftright(__hot, cast(shiftright(key, 32) AS int)) & 1) = 1")
        keyed = keyed.select(F.explode(F.when(is_hot, _dealt(F.col("key"), F.col("fp"))).otherwise(F.array("key"))).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_scan_runs, "a bigint, b bigint").distinct()


def _rooted(nodes: DataFrame) -> DataFrame:
    """nodes (one row for each fp) with root, which the fingerprints of a component share."""
    roots = components(links(nodes), "a", "b")
    return nodes.join(roots, nodes.fp == roots.node, "left").select(*[nodes[c] for c in nodes.columns], F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (signed) and component_id (the smallest doc_id reachable over links) for every row of docs."""
    text_batches(docs.sparkSession)
    prints = staged(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_of(text).alias("fp")), "simhash")
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    of_node = staged(_rooted(nodes), "simhash-rooted")
    names = of_node.groupBy("root").agg(F.min("least").alias("name"), F.count("*").alias("nodes")).where("nodes > 1")  # others are named by their only node
    names = staged(names.select("root", "name"), "simhash-names")
    named = lookup(of_node, names, ["root"])  # a large component's nodes are salted
    named = staged(named.select("fp", F.coalesce("name", "least").alias("component_id")), "simhash-named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of docs for each component: that with the smallest doc_id; of rows that share it, one by fingerprint and text.

    Rows with a null doc_id have no name in the result of near_duplicates and are all kept.
    """
    text_batches(docs.sparkSession)
    text_hash = F.xxhash64(text)
    named = docs.where(F.col(doc_id).isNotNull())
    prints = staged(named.select(F.col(doc_id).alias("doc_id"), fingerprint_of(text).alias("fp"), text_hash.alias("h")), "simhash")
    # null ids name no row, but what they link is linked
    unnamed = docs.where(F.col(doc_id).isNull()).select(fingerprint_of(text).alias("fp")).distinct().withColumn("first", F.lit(None))
    nodes = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "fp", "h")).alias("first")).unionByName(unnamed)
    nodes = staged(nodes.groupBy("fp").agg(F.min("first").alias("first")), "simhash-nodes")
    first = _rooted(nodes).groupBy("root").agg(F.min("first").alias("first")).where("first is not null")
    keep = staged(first.select(F.col("first.doc_id").alias("__id"), F.col("first.h").alias("__of")), "simhash-kept")
    rows = prints.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__of")).count()
    gone = staged(rows.join(keep, (rows["__id"] == keep["__id"]) & rows["__of"].eqNullSafe(keep["__of"]), "left_anti").select("__id", "__of"), "simhash-gone")
    of_row = (F.col(doc_id) == F.col("__id")) & text_hash.eqNullSafe(F.col("__of"))
    # texts are dealt by id only if too many rows go for these to be broadcast
    kept = named.join(F.broadcast(gone), of_row, "left_anti") if gone.count() <= BROADCAST_ROWS else named.join(keep, of_row, "left_semi")
    # no more rows share an id and a text than are repeated; only those are dealt again
    repeated = rows.where("count > 1").select("__id", "__of")
    ids = staged(repeated.join(keep, ["__id", "__of"], "left_semi"), "simhash-repeated")
    if not ids.isEmpty():
        kept = kept.join(ids, of_row, "left_anti").unionByName(kept.join(ids, of_row, "left_semi").dropDuplicates([doc_id, text]))
    return kept.unionByName(docs.where(F.col(doc_id).isNull()))
