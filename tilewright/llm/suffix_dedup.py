"""Removal of text that repeats across documents, by suffix arrays built with linear grouping.

A byte goes if a string of `length` (50) bytes that covers it also starts in a document with a smaller id.

1. Routing. Of the GRAM-byte grams of each 50-byte string, the one with the smallest hash is its anchor: chosen by content
   alone, so equal strings have equal anchors, and about one position in 14 is one. Anchors are dealt to shards by hash.
   Those that occur in one document only are of no use: a first pass finds the others' hashes (each shard for itself) and
   leaves a filter of bounded size, which may let more pass but never holds one back.
2. Text of a shard: a second pass sends it the text around its anchors (up to 26 bytes on both sides: all 50-byte strings
   that hold the anchor), with the smallest id that has it. Text that is the same on both sides travels and is sorted once.
3. Suffix arrays over a shard's text bring equal strings together, whatever differs around them; each string learns the
   smallest id that has it. A text is what surrounds one anchor and 13 bytes on a side of it, which every string holds on
   the left or on the right; many texts are sorted in lockstep. Where those have the same surroundings everywhere there is
   nothing to sort.
4. Those ids go back to the batch of documents that sent the text, which turns them into spans of its documents; spans meet
   their documents by id.

The suffix array is built in linear time: suffixes are grouped by their Lyndon prefix, from the highest group down; the
previous smaller positions of a group's suffixes move to groups of their own just above their old ones. One walk over
these pointers then emits the order within the groups, with no renaming or recursion.

A passage in a third of all documents sends its text once for each batch; its occurrences stay with their batch, so no
task holds all of them. A text of more than TEXT_STRINGS different surroundings is cut by what else its strings hold,
exactly. Shards and buckets are many, partitions at most MOST_PARTS, one after another in each.

Defined cases: null and empty texts have no bytes; rows with a null id lose nothing and take nothing from others; rows
that repeat an id do not count as smaller than each other; texts shorter than `length` are kept; an empty table gives an
empty result. Only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import staged, text_batches, utf8

LENGTH, GRAM = 50, 24
SIDE = LENGTH - GRAM
#: First and last window of the ranges that an anchor's texts are cut to: halves, whose windows share 37 bytes, and finer
#: ones, each within one before, when there are too many.
RANGES = (((0, 13), (14, SIDE)), ((0, 6), (7, 13), (14, 20), (21, SIDE)), tuple((j, j) for j in range(SIDE + 1)))
#: Bytes of text for each shard, bytes of text for each final bucket, bits of the filter for each hash and at most.
SHARD_BYTES, BUCKET_BYTES, FILTER_BITS, FILTER_MOST = 4 << 20, 12 << 20, 12, 1 << 29
MOST_PARTS = 8192
#: Bytes hashed at once, and strings that are sorted at once (a text stays whole).
SEGMENT, TEXT_STRINGS = 1 << 18, 8192
#: Texts are sorted in lockstep if the steps of the longest are shared by so many symbols, else one by one.
SHARED_STEPS = 64
#: Spans that a task gathers before it deals them to buckets.
SPANS_HELD = 1 << 19
NEVER = np.iinfo(np.int64).max

_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_OF_BYTE = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# The suffix array


def suffix_array(text: list[int], ends: list[int]) -> list[int]:
    """The suffix array of a text of positive numbers; `ends` are the positions that end a string (their numbers do not
    matter: each counts as smaller than all else, the later the larger)."""
    n = len(text)
    prev, done, group = [-1] * n, bytearray(n), [0] * n
    for e in ends:
        group[e] = -1
    values = np.array(text, np.int64)
    if ends:
        values[ends] = 0
    order = np.argsort(values, kind="stable")[len(ends) :]
    first = np.flatnonzero(np.diff(values[order], prepend=-1))
    members: list[list[int]] = [x.tolist() for x in np.split(order, first[1:])] if len(order) else []
    for g, positions in enumerate(members):
        for j in positions:
            group[j] = g
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    top = len(members) - 1
    bottom = 0 if members else -1

    # groups from the highest down
    g = top
    while g >= 0:
        own = [j for j in members[g] if group[j] == g]
        members[g] = own
        for i in own:
            done[i] = 1
        if len(own) == 1:
            i = own[0]
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            prev[i] = j
            moves = ((0, [j]),) if j >= 0 and group[j] >= 0 else ()
        else:
            times: dict[int, int] = {}
            for i in own:  # ascending, so pointers within the group are known when needed
                j = i - 1
                while j >= 0 and done[j]:
                    j = prev[j]
                prev[i] = j
                if j >= 0 and group[j] >= 0:
                    times[j] = times.get(j, 0) + 1
            together: dict[tuple[int, int], list[int]] = {}
            for j, n_times in times.items():
                together.setdefault((-n_times, group[j]), []).append(j)
            moves = [(k[0], together[k]) for k in sorted(together)]
        for _, moved in moves:
            old, new = group[moved[0]], len(members)
            members.append(moved)
            for j in moved:
                group[j] = new
            over = above[old]
            below.append(old)
            above.append(over)
            above[old] = new
            below[over] = new  # over is never -1: g itself lies above old
        g = below[g]

    # the order within groups
    start, at = [0] * len(members), len(ends)
    g = bottom
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = above[g]
    sa = [-1] * n
    placed = bytearray(n)
    for k, e in enumerate(sorted(ends)):
        sa[k] = e
        placed[e] = 1
    for k in range(n):
        j = sa[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            p = start[g]
            sa[p] = j
            start[g] = p + 1
            placed[j] = 1
            j = prev[j]
    return sa


def suffix_arrays(text: np.ndarray, is_end: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix arrays of texts (of so many symbols each) one behind another, as positions in the whole: as suffix_array
    does for each alone, one group of every text at a time."""
    n = len(text)
    stop = np.cumsum(sizes)
    first = stop - sizes
    none = n  # stands for no position
    owner = np.repeat(np.arange(len(sizes)), sizes)
    values = owner * (int(text.max(initial=0)) + 1) + np.where(is_end, 0, text)
    index = np.int32 if n < 1 << 31 else np.int64
    sa = np.argsort(values, kind="stable").astype(index)  # groups are runs of slots, named by their first slot; those of a text ascend
    isa = np.empty(n + 1, index)
    isa[sa] = np.arange(n)
    new = np.diff(values[sa], prepend=-1) != 0
    slot = np.arange(n)
    group = np.empty(n + 1, index)
    group[sa] = np.maximum.accumulate(np.where(new, slot, 0))
    group[np.flatnonzero(is_end)] = -1
    group[n] = -1
    size = np.zeros(n + 1, index)
    starts = np.flatnonzero(new)
    size[starts] = np.diff(np.append(starts, n))
    n_ends = np.bincount(owner[is_end], minlength=len(sizes))
    bottom = first + n_ends
    prev = np.full(n + 1, none, index)
    done, moves, is_first, placed = (np.zeros(n + 1, bool) for _ in range(4))
    is_first[first[sizes > 0]] = True
    first, bottom, top = (x.astype(index) for x in (first, bottom, stop))
    live = np.flatnonzero(top > bottom)
    while len(live):
        # the highest group of each text that is not done yet
        t = top[live]
        g = group[sa[t - 1]]
        m = t - g
        top[live] = g
        k = m.sum()
        if k == len(live):
            i = sa[g]
        else:
            c = np.cumsum(m)
            i = sa[np.arange(k) + np.repeat(g - (c - m), m)]
        done[i] = True
        j = np.where(is_first[i], index(none), i - index(1))
        prev[i] = j
        open_ = np.flatnonzero(done[j])
        while len(open_):
            nxt = prev[j[open_]]
            j[open_] = nxt
            prev[i[open_]] = nxt
            open_ = open_[done[nxt]]
        target = j[group[j] >= 0]
        if len(target):  # these leave their groups for new ones above, the more often met the higher
            target.sort()
            at = np.flatnonzero(np.diff(target, prepend=-1))
            u = target[at]
            times = np.diff(np.append(at, len(target)))
            old = group[u]
            o = np.argsort(old.astype(np.int64) * (int(times.max()) + 1) + times)
            u, times, old = u[o], times[o], old[o]
            other = np.diff(old, prepend=-1) != 0
            at = np.flatnonzero(other)
            per = np.diff(np.append(at, len(u)))
            base = old[at]
            begin_slot = base + size[base] - per
            slots = np.arange(len(u)) + np.repeat(begin_slot - at, per)
            low = np.repeat(begin_slot, per)
            have = isa[u]
            moves[u] = True
            there = sa[slots]
            stay = there[~moves[there]]
            moves[u] = False
            if len(stay):
                vacant = have[have < low]
                sa[vacant], isa[stay] = stay, vacant
            sa[slots], isa[u] = u, slots
            size[base] -= per
            at = np.flatnonzero(other | (np.diff(times, prepend=0) != 0))
            ids = slots[at]
            n_run = np.diff(np.append(at, len(u)))
            size[ids] = n_run
            group[u] = np.repeat(ids, n_run)
        live = live[g > bottom[live]]
    # the order within groups
    out = np.full(n, -1, index)
    ends = np.flatnonzero(is_end)
    eo = owner[ends]
    rank = np.arange(len(ends)) - np.repeat(np.cumsum(n_ends) - n_ends, n_ends)
    out[first[eo] + rank] = ends
    placed[ends] = placed[none] = True
    head = np.arange(n + 1, dtype=index)
    for k in range(int(sizes.max(initial=0))):
        i = out[first[sizes > k] + k]
        j = np.where(is_first[i], index(none), i - index(1))
        j = j[~placed[j]]
        while len(j):
            g = group[j]
            p = head[g]
            out[p] = j
            head[g] = p + 1
            placed[j] = True
            j = prev[j]
            j = j[~placed[j]]
    return out


# Anchors


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    powers, h, size = {1: _OF_BYTE[b]}, _OF_BYTE[b], 1
    while size * 2 <= GRAM:
        h = h[:-size] * _MULTIPLIERS[size.bit_length() % 4] + h[size:]
        size *= 2
        powers[size] = h
    n, at = len(b) - GRAM + 1, 0
    out = np.zeros(n, np.uint64)
    for size in sorted(powers, reverse=True):
        if GRAM & size:
            out = out * _MULTIPLIERS[4] + powers[size][at : at + n]
            at += size
    out ^= out >> np.uint64(29)
    out *= _MULTIPLIERS[0]
    out ^= out >> np.uint64(32)
    return out


def _slid(a: np.ndarray, width: int, f) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def anchors(b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all LENGTH-byte strings within documents that end at `ends`."""
    at, found = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    width = LENGTH - GRAM + 1
    parts = [(at, found)]
    short = np.minimum(np.diff(ends, prepend=0), LENGTH - 1)  # so many last bytes of a document start no string
    whole = np.ones(len(b), bool)
    whole[np.arange(short.sum()) + np.repeat(ends - np.cumsum(short), short)] = False
    for a in range(0, len(b) - LENGTH + 1, SEGMENT):  # by first bytes of strings
        piece = b[a : a + SEGMENT + LENGTH - 1]
        h = _gram_hashes(piece)
        least = _slid(h, width, np.minimum)
        least *= whole[a : a + len(least)]
        none = np.zeros(width - 1, np.uint64)
        chosen = np.flatnonzero((_slid(np.concatenate([none, least, none]), width, np.maximum) == h) & (h > 0))
        parts.append((chosen + a, h[chosen]))
    at, found = (np.concatenate(x) for x in zip(*parts, strict=True))
    at, first = np.unique(at, return_index=True)  # segments share their edges
    return at, found[first]


class _Batch:
    """The documents of a batch as one buffer, with their anchors."""

    def __init__(self, ids: pa.Array, texts: pa.Array):
        raw = [t if known else b"" for t, known in zip(utf8(texts), ids.is_valid().to_pylist(), strict=True)]
        self.ids = ids.fill_null(0).to_numpy().astype(np.int64)
        self.texts, self.raw = raw, b"".join(raw)
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.at, self.hash = anchors(self.bytes, self.ends) if len(self.raw) >= LENGTH else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        self.doc = np.searchsorted(self.ends, self.at, "right")


def _shards_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards by a second hash, as anchors' own hashes are small ones."""
    return ((h * _MULTIPLIERS[3] >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    heads = b"".join(struct.pack("<2sQ", c.dtype.str[1:].encode(), c.size) for c in columns)
    body = b"".join(np.ascontiguousarray(c).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", len(columns)) + heads + body)


def unpack(blob: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", data)[0]
    at, out = 4 + 10 * n, []
    for k in range(n):
        kind, size = struct.unpack_from("<2sQ", data, 4 + 10 * k)
        dtype = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(data, dtype, size, at))
        at += size * dtype.itemsize
    return out


def _split(shard: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """(shard, its slice) of a sorted shard column."""
    edges = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(edges)):
        yield int(s), slice(edges[s], edges[s + 1])


# The first pass: hashes in two documents or more


def _send_hashes(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = _Batch(b.column(0), b.column(1))
        ids, shard, key = x.ids[x.doc], _shards_of(x.hash, shards), _keys(x.hash)
        both = shard.astype(np.uint64) << np.uint64(32) | key
        order = np.argsort(both)
        both, ids = both[order], ids[order]
        first = np.flatnonzero(np.diff(both, prepend=~both[:1]))
        several = (np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)) if len(first) else np.zeros(0, bool)
        shard, key = (both[first] >> np.uint64(32)).astype(np.int64), both[first].astype(np.uint32)
        rows = [(s, pack(key[k], several[k].view(np.uint8))) for s, k in _split(shard, shards)]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "blob"])


def _keys(h: np.ndarray) -> np.ndarray:
    """What the first pass knows a hash by within its shard, which is small: two that it cannot tell apart both pass."""
    return (h * _MULTIPLIERS[2] >> np.uint64(32)).astype(np.uint32)


def _filter_places(key: np.ndarray, size: int | np.ndarray) -> list[np.ndarray]:
    """Two bits of a shard's filter of so many bits."""
    key = key.astype(np.uint64)
    again = (key * np.uint64(0x9E3779B1) + np.uint64(0x7F4A7C15)) & np.uint64(0xFFFFFFFF)
    return [(x * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64) for x in (key, again)]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """(first column, rows of the other columns) of batches sorted by the first column."""
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    stream, ahead = rows(), None
    ahead = next(stream, None)
    while ahead is not None:
        key = ahead[0]

        def members() -> Iterator[tuple]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:  # noqa: B023
                yield ahead[1:]
                ahead = next(stream, None)

        inner = members()
        yield key, inner
        for _ in inner:
            pass


def _repeated(batches: Iterator[pa.RecordBatch], most_bits: int) -> Iterator[pa.RecordBatch]:
    for shard, rows in _grouped(batches):
        parts = [unpack(blob) for (blob,) in rows]
        h, several = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        h, where, counts = np.unique(h, return_inverse=True, return_counts=True)
        flagged = np.zeros(len(h), bool)
        flagged[where[several > 0]] = True
        h = h[(counts > 1) | flagged]
        size = max(64, min(FILTER_BITS * len(h), most_bits)) // 8 * 8
        bits = np.zeros(size, bool)
        for places in _filter_places(h, size):
            bits[places] = True
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["shard", "bits"])


class Filter:
    """A bounded filter of hashes: a piece for each shard; a shard without one passes nothing."""

    def __init__(self, pieces: dict[int, bytes], shards: int):
        self.shards = shards
        self.sizes = np.array([8 * len(pieces.get(s, b"\0" * 8)) for s in range(shards)], np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.bits = np.frombuffer(b"".join(pieces.get(s, b"\0" * 8) for s in range(shards)), np.uint8)

    def passes(self, h: np.ndarray) -> np.ndarray:
        s = _shards_of(h, self.shards)
        out = np.ones(len(h), bool)
        for places in _filter_places(_keys(h), self.sizes[s]):
            at = self.starts[s] + places
            out &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
        return out


# The second pass: contexts and occurrences


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as columns of 8 bytes, filled up with zeros."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return np.ascontiguousarray(wide.view(np.uint64).T)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), np.uint64)
    for word in _words(rows):
        for shift, multiplier in ((31, _MULTIPLIERS[2]), (29, _MULTIPLIERS[3])):
            word = word * multiplier
            word ^= word >> np.uint64(shift)
        out = (out ^ word) * _MULTIPLIERS[0]
        out ^= out >> np.uint64(32)
    return out


def _send_contexts(batches: Iterator[pa.RecordBatch], shared, shards: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    for n, b in enumerate(batches):
        x = _Batch(b.column(0), b.column(1))
        kept = shared.value.passes(x.hash)
        at, h, doc = x.at[kept], x.hash[kept], x.doc[kept]
        left = np.minimum(SIDE, at - (x.ends - x.sizes)[doc])
        right = np.minimum(SIDE, x.ends[doc] - at - GRAM)
        padded = np.concatenate([np.zeros(SIDE, np.uint8), x.bytes, np.zeros(SIDE, np.uint8)])
        steps = np.arange(SIDE)
        around = np.lib.stride_tricks.sliding_window_view(padded, SIDE + LENGTH)[at]
        sized = np.concatenate([around[:, :SIDE], around[:, SIDE + GRAM :], left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], 1)
        near, far = np.flatnonzero(left < SIDE), np.flatnonzero(right < SIDE)
        sized[near, :SIDE] *= steps >= SIDE - left[near, None]
        sized[far, SIDE : 2 * SIDE] *= steps < right[far, None]
        key, ids = _row_hash(sized), x.ids[doc]
        shard = _shards_of(h, shards)
        order = np.argsort(shard.astype(np.uint64) << np.uint64(44) | h >> np.uint64(40) << np.uint64(20) | key >> np.uint64(44))  # equal texts that this parts go twice
        h, key, ids, doc, shard = h[order], key[order], ids[order], doc[order], shard[order]
        at = at[order] - (x.ends - x.sizes)[doc]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])]) if len(h) else np.zeros(0, bool)
        first, context = np.flatnonzero(new), np.cumsum(new) - 1
        least = np.minimum.reduceat(ids, first) if len(first) else ids
        batch = f"{TaskContext.get().partitionId()}/{n}"
        rows = [(s, 0, batch, pack(h[first[k]], least[k], sized[order[first[k]]].ravel())) for s, k in _split(shard[first], shards)]
        docs, local = np.unique(doc, return_inverse=True)
        marks = np.array([xxhash.xxh64_intdigest(x.texts[d]) for d in docs.tolist()], np.uint64)
        if len(at):
            rows.append((-1 - n, 1, batch, pack(context.astype(np.uint32), local.astype(np.uint32), at, x.ids[docs], marks)))
        yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.binary()))], names=["shard", "kind", "batch", "blob"])


def _smallest(keys: list[np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by equal keys (first key first): a row of each set, its smallest id, and the set of each row."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(ids), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    first = np.flatnonzero(new)
    member = np.empty(len(ids), np.int64)
    member[order] = np.cumsum(new) - 1
    return order[first], np.minimum.reduceat(ids[order], first) if len(ids) else ids, member


def _in_pieces(cls: np.ndarray) -> Iterator[np.ndarray]:
    """Rows, sorted by class, in pieces that cut no class, classes of like size together: as few rows as leave SHARED_STEPS
    classes to sort in lockstep, but at most about TEXT_STRINGS."""
    first = np.flatnonzero(np.diff(cls, prepend=-1))
    size = np.diff(np.append(first, len(cls)))
    order = np.argsort(size, kind="stable").tolist()
    held: list[int] = []
    rows = 0
    for k in order:
        held.append(k)
        rows += int(size[k])
        if rows >= min(TEXT_STRINGS, max(TEXT_STRINGS // 4, 2 * SHARED_STEPS * int(size[k]))) or k == order[-1]:
            n = size[held]
            yield np.arange(rows) + np.repeat(first[held] - (np.cumsum(n) - n), n)
            held, rows = [], 0


def _sorted_windows(frame: np.ndarray, there: np.ndarray, fits: np.ndarray, cls: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each row (symbols, where there are any; rows of a class are one text) and each of its first columns that a
    window of as many symbols fits behind: the smallest id of all rows with that window."""
    text = frame[there]
    row, column = np.nonzero(there)
    first = np.flatnonzero(np.diff(cls, prepend=-1))
    sizes = np.add.reduceat(there.sum(1), first)
    is_end = text == 0
    stops = np.cumsum(sizes)
    order = np.argsort(sizes, kind="stable")
    shared = np.flatnonzero(np.cumsum(sizes[order]) >= SHARED_STEPS * sizes[order])
    together = np.isin(np.arange(len(sizes)), order[: shared[-1] + 1]) if len(shared) else np.zeros(len(sizes), bool)
    found = [np.array(suffix_array(text[a:z].tolist(), np.flatnonzero(is_end[a:z]).tolist()), np.int64) + a for a, z in zip((stops - sizes)[~together].tolist(), stops[~together].tolist(), strict=True)]
    if together.any():
        at = np.flatnonzero(np.repeat(together, sizes))
        found.append(at[suffix_arrays(text[at], is_end[at], sizes[together])])
    sa = np.concatenate(found)
    width = fits.shape[1]
    starts = np.zeros(there.shape, bool)
    starts[:, :width] = fits
    sa = sa[starts[there][sa]]
    owner = np.full(fits.shape, NEVER)
    if not len(sa):
        return owner
    windows = text[sa[:, None] + np.arange(width)]
    of = cls[row[sa]]
    new = np.flatnonzero(np.concatenate([[True], (windows[1:] != windows[:-1]).any(1) | (of[1:] != of[:-1])]))
    owner[row[sa], column[sa]] = np.repeat(np.minimum.reduceat(least[row[sa]], new), np.diff(np.append(new, len(sa))))
    return owner


def window_owners(h: np.ndarray, sized: np.ndarray, ids: np.ndarray, depth: int = 0, within: tuple[int, int] = (0, SIDE)) -> np.ndarray:
    """For each different context (hash of its anchor, sides with their sizes, smallest id) and each of its SIDE + 1
    windows: the smallest id of all contexts that have that window, NEVER where the document ends before it.

    The windows of a range share what lies between its first and its last; with the anchor's gram that is one symbol of a
    text, the class of the row. Classes of more than TEXT_STRINGS rows are cut again, into shorter ranges. Only windows
    `within` are looked at.
    """
    owners = np.full((len(h), SIDE + 1), NEVER)
    left, right = sized[:, 2 * SIDE].astype(np.int64), sized[:, 2 * SIDE + 1].astype(np.int64)
    for j0, j1 in RANGES[depth]:
        reach = j1 - j0
        use = np.flatnonzero((left >= SIDE - j1) & (right >= j0)) if within[0] <= j0 and j1 <= within[1] else ()
        if not len(use):
            continue
        before, after = sized[use, j0:j1], sized[use, SIDE + j0 : SIDE + j1]
        core = _row_hash(np.concatenate([sized[use, j1:SIDE], sized[use, SIDE : SIDE + j0]], 1))
        n_before, n_after = np.minimum(reach, left[use] - (SIDE - j1)), np.minimum(reach, right[use] - j0)
        around = np.concatenate([before, after], 1)
        wide = np.pad(around, ((0, 0), (0, -around.shape[1] % 8))).view(np.uint64).T if reach else ()
        rows, least, member = _smallest([h[use], core, *wide, n_before, n_after], ids[use])
        h_of, core_of = h[use][rows], core[rows]
        cls = np.cumsum(np.concatenate([[True], (h_of[1:] != h_of[:-1]) | (core_of[1:] != core_of[:-1])])) - 1
        n = np.bincount(cls)[cls]
        many = (n > TEXT_STRINGS) & (depth + 1 < len(RANGES))
        frame = np.zeros((len(rows), 2 * reach + 2), np.int16)  # before, core, after, end
        frame[:, :reach], frame[:, reach], frame[:, reach + 1 : -1] = before[rows].astype(np.int16) + 1, 257, after[rows].astype(np.int16) + 1
        there = np.ones(frame.shape, bool)
        there[:, :reach] = np.arange(reach) >= reach - n_before[rows][:, None]
        there[:, reach + 1 : -1] = np.arange(reach) < n_after[rows][:, None]
        fits = there[:, : reach + 1] & np.stack([there[:, o + reach] for o in range(reach + 1)], 1)
        owner = np.where(fits, least[:, None], NEVER)  # a class of one row has nothing to sort
        one = np.flatnonzero(~many & (n > 1))
        for part in _in_pieces(cls[one]):
            part = one[part]
            owner[part] = _sorted_windows(frame[part], there[part], fits[part], cls[part], least[part])
        if many.any():
            cut = np.flatnonzero(many)
            owner[cut] = window_owners(h_of[cut], sized[use[rows[cut]]], least[cut], depth + 1, (j0, j1))[:, j0 : j1 + 1]
        owners[use, j0 : j1 + 1] = owner[member]
    return owners


def _dealt(found: list[list[np.ndarray]], buckets: int) -> pa.RecordBatch:
    """Spans (ids, marks, starts, stops) as a row for each bucket."""
    ids, marks, start, stop = (np.concatenate(x) for x in zip(*found, strict=True))
    used, doc = np.unique(ids, return_inverse=True)
    bucket = np.array([_signed(xxhash.xxh64_intdigest(struct.pack("<q", d), 42)) % buckets for d in used.tolist()], np.int64)[doc]
    order = np.lexsort((start, ids, bucket))
    ids, marks, start, stop = ids[order], marks[order], start[order], stop[order]
    rows = [(b, pack(ids[k], marks[k], start[k], stop[k])) for b, k in _split(bucket[order], buckets)]
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def _find_owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text that a shard got from its batches -> for each batch: the smallest ids of its strings. Batches' occurrences,
    which have numbers below 0 for a shard, pass."""
    def back(batch: str, kind: int, shard: int, blob: bytes) -> pa.RecordBatch:
        return pa.record_batch([pa.array([batch]), pa.array([kind], pa.int32()), pa.array([shard], pa.int64()), pa.array([blob], pa.binary())], names=["batch", "kind", "shard", "blob"])

    for shard, rows in _grouped(batches):
        if shard < 0:
            for batch, blob in rows:
                yield back(batch, 1, shard, blob)
            continue
        names, parts = [], []
        for batch, blob in rows:
            h, ids, sized = unpack(blob)
            names.append(batch)
            parts.append((h, ids, sized.reshape(len(h), -1)))
        h, ids, sized = (np.concatenate(x) for x in zip(*parts, strict=True))
        edges = np.cumsum([0, *(len(x[0]) for x in parts)]).tolist()
        del parts
        wide = np.pad(sized, ((0, 0), (0, -sized.shape[1] % 8))).view(np.uint64)
        first, least, member = _smallest([h, *wide.T], ids)
        owners = window_owners(h[first], sized[first], least)
        for name, a, z in zip(names, edges, edges[1:], strict=False):
            yield back(name, 0, shard, pack(owners[member[a:z]].ravel()))


def _find_spans(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The smallest ids that a batch got back from shards, in their order, and then its occurrences -> spans."""
    found: list[list[np.ndarray]] = []
    held = 0
    for _, rows in _grouped(batches):
        parts = []
        for kind, _, blob in rows:
            if kind == 0:
                parts.append(unpack(blob)[0].reshape(-1, SIDE + 1))
                continue
            owners = np.concatenate(parts)
            lowest = owners.min(1)
            context, local, at, doc_ids, marks = unpack(blob)
            ids = doc_ids[local]
            hit = np.flatnonzero(lowest[context] < ids)
            hits = owners[context[hit]] < ids[hit][:, None]
            start = at[hit] - SIDE + hits.argmax(1)
            stop = at[hit] - SIDE + (SIDE - hits[:, ::-1].argmax(1)) + LENGTH
            found.append([ids[hit], marks[local[hit]], start, stop])
            held += len(hit)
            if held >= SPANS_HELD:
                yield _dealt(found, buckets)
                found, held = [], 0
    if held:
        yield _dealt(found, buckets)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


# Documents


def merged(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans made one."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order]) if len(stop) else stop
    new = np.concatenate([[True], start[1:] > stop[:-1]]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return start[first], stop[np.append(first[1:], len(start)) - 1] if len(first) else stop


KIND = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept_sha256", pa.string())])
RESULT = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept_sha256 string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket: its spans (packed) first, then its documents."""
    bucket, parts, spans, edges = None, [], None, None
    for b in batches:
        out: list[tuple] = []
        texts = utf8(b.column(3))
        for i, (key, kind, doc_id, known, blob) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).is_valid().to_pylist(), b.column(4).to_pylist(), strict=True)):
            if key != bucket:
                bucket, parts, spans = key, [], None
            if kind == 0:
                parts.append(unpack(blob))
                continue
            if spans is None:
                spans = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
                order = np.argsort(spans[0], kind="stable")
                spans, parts = [x[order] for x in spans], []
            text, found = texts[i] if known else b"", []
            if doc_id is not None and len(text) >= LENGTH:
                a, z = np.searchsorted(spans[0], [doc_id, doc_id + 1]) if doc_id < NEVER else (np.searchsorted(spans[0], doc_id), len(spans[0]))
                if a < z:
                    same = spans[1][a:z] == np.uint64(xxhash.xxh64_intdigest(text))
                    start, stop = merged(spans[2][a:z][same], spans[3][a:z][same])
                    found = list(zip(start.tolist(), stop.tolist(), strict=True))
            edges = [0, *(x for s in found for x in s), len(text)]
            kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
            out.append((doc_id, len(text), [{"start": x, "stop": y} for x, y in found], hashlib.sha256(kept).hexdigest()))
        yield pa.record_batch([pa.array([r[i] for r in out], f.type) for i, f in enumerate(KIND)], schema=KIND)


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges, maximal) and kept_sha256 of every row of docs."""
    spark = docs.sparkSession
    text_batches(spark)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets = max(16, total // SHARD_BYTES), max(16, total // BUCKET_BYTES)

    sent = rows.mapInArrow(lambda it: _send_hashes(it, shards), "shard bigint, blob binary")
    pieces = staged(sent.repartition(min(shards, MOST_PARTS), "shard").sortWithinPartitions("shard").mapInArrow(lambda it: _repeated(it, max(64, FILTER_MOST // shards)), "shard bigint, bits binary"), "repeats-filter")
    shared = spark.sparkContext.broadcast(Filter({r.shard: r.bits for r in pieces.toLocalIterator()}, shards))  # at most FILTER_MOST bits

    parts = min(shards, MOST_PARTS)
    sent = rows.mapInArrow(lambda it: _send_contexts(it, shared, shards), "shard bigint, kind int, batch string, blob binary")
    sent = sent.repartition(parts, F.when(F.col("kind") == 0, F.col("shard")).otherwise(F.xxhash64("batch"))).select("shard", "batch", "blob").sortWithinPartitions("shard")
    back = sent.mapInArrow(_find_owners, "batch string, kind int, shard bigint, blob binary")
    spans = back.repartition(parts, "batch").sortWithinPartitions("batch", "kind", "shard").mapInArrow(lambda it: _find_spans(it, buckets), "bucket bigint, blob binary")
    spans = staged(spans, "repeats-spans")

    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    whole = rows.select(F.pmod(own, F.lit(buckets)).cast("bigint").alias("bucket"), F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("blob"))
    marks = spans.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), "blob")
    return whole.union(marks).repartition(min(buckets, MOST_PARTS), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_cut, RESULT)
