"""Benchmark decontamination by suffix arrays over the training texts.

Documents are cut into shards (runs of rows of an Arrow batch, bounded by words). Each shard gets a suffix array over
its word ids, and every suffix of every benchmark item is binary-searched in it: first down to the window length, which
gives all places of that window, then on to its longest verbatim match with its places. A document lies in one shard
whole, so no shuffle is needed.

Words that no benchmark item has end every match, so runs of benchmark words that are shorter than the shortest window
leave the shard before sorting; that changes no result.

Defined cases: a null or empty text has no words and is never hit; a null item text has no windows; a null item id is
named as the empty string; repeated items count once by id; repeated documents are judged each for itself; an empty
benchmark hits nothing. Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import text_batches, utf8

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Words of a shard, and words of benchmark items that one broadcast holds; more items make more passes.
SHARD_WORDS, BLOCK_WORDS, PAIRS_AT_ONCE = 1 << 20, 1 << 22, 1 << 21

RESULT = "struct<n_words:bigint,spans:array<struct<start:int,stop:int>>,items:array<string>,matches:array<struct<item_id:string,item_word:int,doc_word:int,words:int>>>"


def words_of(text: bytes) -> list[bytes]:
    """Lower-case A-Z and cut into runs of digits, letters and bytes of non-ASCII characters."""
    return WORD.findall(text.lower())


class Block:
    """Benchmark items as word ids: what one broadcast holds."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        seqs, self.names, item, limits, width, starts, at = [], [], [], [], [], [], 0
        for name, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if not ids:
                continue
            w = min(window, len(ids))
            seqs.append(ids)
            item += [len(self.names)] * len(ids)
            self.names.append(name)
            limits += [at + len(ids)] * len(ids)
            width += [w] * len(ids)
            starts += [at] * len(ids)
            at += len(ids)
        self.words = np.array([x for s in seqs for x in s], np.int64)
        self.item = np.array(item, np.int32)
        self.limit, self.width, self.start = (np.array(x, np.int64) for x in (limits, width, starts))
        self.shortest = int(self.width.min()) if seqs else 0
        self.longest = int((self.limit - self.start).max()) if seqs else 0


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of non-zero words, ordered by what follows up to depth words (prefix doubling); zeros end a text."""
    rank, k, n = seq, 1, len(seq)
    kept = np.flatnonzero(seq)
    while k < depth and len(kept):
        follow = np.zeros(n, np.int64)
        follow[: max(0, n - k)] = rank[k:]
        key = rank[kept] * (int(rank.max()) + 1) + follow[kept]
        values, inverse = np.unique(key, return_inverse=True)
        rank = np.zeros(n, np.int64)
        rank[kept] = inverse + 1
        if len(values) == len(kept):
            break
        k *= 2
    return kept[np.argsort(rank[kept], kind="stable")]


def _bounds(seq: np.ndarray, sa: np.ndarray, depth: int, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each interval of the suffix array, the part whose word at depth is the one asked for."""
    found = []
    for upper in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            at = seq[sa[np.minimum(mid, len(sa) - 1)] + depth]
            less = open_ & ((at <= word) if upper else (at < word))
            a = np.where(less, mid + 1, a)
            b = np.where(open_ & ~less, mid, b)
        found.append(a)
    return found[0], found[1]


def search(seq: np.ndarray, sa: np.ndarray, block: Block) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Binary-search every item suffix: (item position, lo, hi) of all that occur down to their window's length."""
    at = np.arange(len(block.words))
    at = at[at + block.width <= block.limit]
    lo, hi, depth = np.zeros(len(at), np.int64), np.full(len(at), len(sa)), 0
    while len(at):
        lo, hi = _bounds(seq, sa, depth, block.words[at + depth], lo, hi)
        depth += 1
        there = lo < hi
        done = there & (block.width[at] == depth)
        if done.any():
            yield at[done], lo[done], hi[done]
        on = there & ~done
        at, lo, hi = at[on], lo[on], hi[on]


def _shard(docs: list[np.ndarray], block: Block) -> list[tuple[list, list, list]]:
    """Spans, items and maximal matches of each document (word ids; 0: no benchmark word) of one shard."""
    out: list[tuple[list, list, list]] = [([], [], []) for _ in docs]
    pad = np.zeros(block.longest + 1, np.int64)
    seq = np.concatenate([x for d in docs for x in (d, pad[:1])] + [pad])
    doc = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
    begins = np.cumsum([0] + [len(d) + 1 for d in docs])
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (seq > 0).astype(np.int8), [0]])))
    runs = edge.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= block.shortest]
    if not len(runs):
        return out
    lengths = runs[:, 1] - runs[:, 0] + 1  # with the zero behind
    ends = np.cumsum(lengths)
    place = np.arange(ends[-1]) + np.repeat(runs[:, 0] - (ends - lengths), lengths)  # of the kept words in seq
    small = np.concatenate([seq[place], pad])
    small[ends - 1] = 0
    sa = suffix_array(small, block.longest)
    hit = np.zeros(len(seq) + 1, np.int64)
    pairs, matches = set(), []
    for at, lo, hi in search(small, sa, block):
        for part in np.array_split(np.arange(len(at)), max(1, int((hi - lo).sum()) // PAIRS_AT_ONCE)):
            n = (hi - lo)[part]
            item = np.repeat(at[part], n)
            pos = sa[np.arange(n.sum()) + np.repeat(lo[part] - (np.cumsum(n) - n), n)]
            where = place[pos]
            np.add.at(hit, where, 1)
            np.add.at(hit, where + block.width[item], -1)
            first = block.start[item]
            owner = doc[where]
            pairs.update(np.unique(owner * len(block.words) + first).tolist())
            left = (item == first) | (pos == 0) | (small[pos - 1] != block.words[np.maximum(item - 1, 0)])
            item, pos, where, owner = item[left], pos[left], where[left], owner[left]
            size = block.width[item].copy()
            open_ = np.arange(len(item))
            while len(open_):
                i, d = item[open_], size[open_]
                open_ = open_[i + d < block.limit[i]]
                i, d = item[open_], size[open_]
                open_ = open_[small[pos[open_] + d] == block.words[i + d]]
                size[open_] += 1
            matches += zip(owner.tolist(), item.tolist(), (where - begins[owner]).tolist(), size.tolist(), strict=True)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(hit) > 0).astype(np.int8)])))
    for a, b in edge.reshape(-1, 2).tolist():
        k = int(doc[a])
        out[k][0].append({"start": a - int(begins[k]), "stop": b - int(begins[k])})
    for x in pairs:
        out[x // len(block.words)][1].append(block.names[block.item[x % len(block.words)]])
    for k, i, w, size in sorted(matches):
        out[k][2].append({"item_id": block.names[block.item[i]], "item_word": i - int(block.start[i]), "doc_word": w, "words": size})
    return out


def scan(texts: list[bytes], block: Block) -> list[dict]:
    """Results for each text, shard by shard."""
    rows, docs, held = [], [], 0

    def flush() -> None:
        nonlocal docs, held
        found = _shard(docs, block) if docs and len(block.words) else [([], [], []) for _ in docs]
        for d, (spans, items, matches) in zip(docs, found, strict=True):
            rows.append({"n_words": len(d), "spans": spans, "items": sorted(set(items)), "matches": matches})
        docs, held = [], 0

    known = block.vocabulary.get
    for text in texts:
        words = words_of(text)
        docs.append(np.fromiter((known(w, 0) for w in words), np.int64, len(words)))
        held += len(words)
        if held >= SHARD_WORDS:
            flush()
    flush()
    return rows


def blocks(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text", most: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in blocks of a bounded number of words; rows come to the driver one partition at a time."""
    held: list[tuple[str, bytes]] = []
    size = 0
    for row in benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t")).where("t is not null").toLocalIterator():
        t = row.t.encode()
        held.append((row.i, t))
        size += len(t) // 2 + 1
        if size >= most:
            yield Block(held, window)
            held, size = [], 0
    yield Block(held, window)


def scanner(spark, block: Block):
    """A column function text -> RESULT for one block of the benchmark."""
    shared = spark.sparkContext.broadcast(block)
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])))])

    @F.arrow_udf(RESULT)
    def matched(texts: pa.Array) -> pa.Array:
        return pa.array(scan(utf8(texts), shared.value), kind)

    return matched


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = 13, text: str = "text", to: str = "overlap") -> DataFrame:
    """docs with the column `to`: words, hit spans (word offsets), items and maximal verbatim matches of each text.

    One narrow pass over docs for each block of the benchmark (one, unless it has more than BLOCK_WORDS words).
    """
    spark = docs.sparkSession
    text_batches(spark)
    for k, block in enumerate(blocks(benchmark, window)):
        found = scanner(spark, block)(F.col(text))
        if k == 0:
            docs = docs.withColumn(to, found)
        else:
            docs = docs.withColumn("__more", found).withColumn(
                to,
                F.struct(
                    F.col(f"{to}.n_words").alias("n_words"),
                    _merged(F.concat(f"{to}.spans", "__more.spans")).alias("spans"),
                    F.array_distinct(F.concat(f"{to}.items", "__more.items")).alias("items"),
                    F.concat(f"{to}.matches", "__more.matches").alias("matches"),
                ),
            ).drop("__more")
    return docs


def _merged(spans: Column) -> Column:
    """Overlapping or touching spans made one."""
    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joins = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)).stop >= x.start)
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last.start.alias("start"), F.greatest(last.stop, x.stop).alias("stop"))))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start:int,stop:int>>"), step)


def n_hit(overlap_col: str = "overlap") -> Column:
    return F.aggregate(f"{overlap_col}.spans", F.lit(0).cast("bigint"), lambda n, x: n + (x.stop - x.start))


def is_contaminated(overlap_col: str = "overlap", share: int = 20) -> Column:
    """At least one hit word, and one hit word in `share` words or more."""
    return (n_hit(overlap_col) > 0) & (share * n_hit(overlap_col) >= F.col(f"{overlap_col}.n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """docs without the contaminated ones; columns as they were."""
    return overlap(docs, benchmark, window, to="__overlap").where(~is_contaminated("__overlap")).drop("__overlap")
