"""Benchmark search, near duplicates, repeated text and nearest vectors against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tilewright.llm import ann, decontaminate, graph, simhash, suffix_dedup
from tests.llm.conftest import prose

# Decontamination


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_overlap(text, items, window):
    w, hit, named = words(text), set(), set()
    for name, t in items:
        v = words(t)
        n = min(window, len(v))
        wins = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1 if v else 0):
            if tuple(w[i : i + n]) in wins:
                hit |= set(range(i, i + n))
                named.add(name)
    return len(w), len(hit), sorted(named)


def bench_items(texts):
    rng = random.Random(2)
    return [(1, " ".join(words(texts[0])[:40])), (20, texts[5]), (3, "nothing like this occurs anywhere at all"), (4, None), (5, ""), (6, "a"), (7, " ".join(words(texts[67])[500:560])), (7, " ".join(words(texts[67])[500:560])), (None, texts[9]), (8, prose(rng, 30)), (9, "été 日本語")]


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 30])
def test_overlap_equals_brute_force(spark, docs, texts, block_words, monkeypatch):
    monkeypatch.setattr(decontaminate, "blocks", lambda b, w, f=decontaminate.blocks: f(b, w, most=block_words))
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 500)
    items = bench_items(texts)
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("overlap", F.lit(1))
    found = decontaminate.overlap(docs, bench, 13, to="found").select("doc_id", "text", "found.n_words", decontaminate.n_hit("found").alias("hit"), F.array_sort("found.items").alias("names"), decontaminate.is_contaminated("found").alias("bad"), "found.matches").collect()
    named = [("" if n is None else str(n), t) for n, t in items]
    for r in found:
        n, hit, names = brute_overlap(r.text, named, 13)
        assert (r.n_words, r.hit, r.names, r.bad) == (n, hit, names, hit > 0 and 20 * hit >= n)
        for m in r.matches:  # matches are verbatim and cannot be longer
            w = words(r.text)[m.doc_word : m.doc_word + m.words]
            assert any(words(t)[m.item_word : m.item_word + m.words] == w for k, t in named if k == m.item_id and t)
    assert len(found) == docs.count()


def test_decontaminated_keeps_clean_rows_and_columns(spark, docs, texts, none):
    bench = spark.createDataFrame(bench_items(texts), "item_id bigint, text string")
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert decontaminate.decontaminated(docs, bench.where("false")).count() == docs.count()
    assert decontaminate.decontaminated(none, bench).count() == 0


def test_suffix_array_of_words():
    rng = random.Random(1)
    for _ in range(200):
        seq = np.array([rng.randint(0, 4) for _ in range(rng.randint(1, 40))] + [0] * 64)
        sa = decontaminate.suffix_array(seq, 64).tolist()
        assert sorted(sa) == np.flatnonzero(seq).tolist()
        key = lambda p: seq[p : p + int((seq[p:] == 0).argmax())].tolist()
        cut = [key(p) for p in sa]
        assert all(a[: len(b)] <= b[: len(a)] for a, b in zip(cut, cut[1:]))  # noqa: B905


# SimHash


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


def test_near_duplicates_equal_brute_force(spark, docs, none):
    found = simhash.near_duplicates(docs).collect()
    inputs = sorted((r.doc_id is None, r.doc_id or 0, brute_fingerprint(r.text)) for r in docs.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64)) for r in found) == inputs
    rows = [(r.doc_id, r.fp % (1 << 64)) for r in found]
    assert [r.component_id for r in found] == brute_components(rows)
    assert simhash.near_duplicates(none).count() == 0


def test_planted_fingerprints(spark):
    rng = random.Random(4)
    rows, base = [], [rng.getrandbits(64) for _ in range(40)]
    for b in base:
        for _ in range(6):
            x = b
            for bit in rng.sample(range(64), rng.randint(0, 7)):
                x ^= 1 << bit
            rows.append(x)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in set(rows)], "fp bigint")
    pairs = simhash.links(frame)
    roots = {r.node % (1 << 64): r.root for r in graph.components(pairs, "a", "b").collect()}
    rows = sorted(set(rows))
    wanted = brute_components(list(enumerate(rows)))
    same = {}
    for x, c in zip(rows, wanted, strict=True):
        same.setdefault(c, set()).add(roots.get(x, x - (1 << 64) if x >> 63 else x))  # a root has no row
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_long_runs_are_cut_exactly(monkeypatch):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    fps = np.array(sorted({base ^ sum(1 << b for b in rng.sample(range(22, 64), rng.randint(0, 6))) for _ in range(300)}), np.uint64)
    whole = simhash.run_links(fps)
    monkeypatch.setattr(simhash, "LARGE", 10)
    cut = simhash.run_links(fps)

    def groups(links):
        ids = {int(x): i for i, x in enumerate(fps)}
        root = list(range(len(fps)))
        for _ in fps:
            for a, b in links:
                m = min(root[ids[a]], root[ids[b]])
                root[ids[a]] = root[ids[b]] = m
        return root

    assert groups(whole) == groups(cut)


def test_hot_keys_are_dealt_exactly(spark, monkeypatch):
    """Many fingerprints that share their segments, and some that share none: the same links however keys are cut."""
    rng = random.Random(9)
    rows = {rng.getrandbits(64) for _ in range(40)}
    for base in [rng.getrandbits(64) for _ in range(3)]:
        for _ in range(150):
            rows.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))))
    rows = sorted(rows)
    frame = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in rows], "fp bigint")
    wanted = brute_components(list(enumerate(rows)))
    monkeypatch.setattr(simhash, "LARGE", 12)
    marked, any_hot = simhash._hot_keys(frame, "fp")
    hot = {r.fp % (1 << 64): r["__hot"] % (1 << 64) for r in marked.collect()}
    assert any_hot and len(hot) == len(rows) and any(hot.values())
    runs = {}
    for x in rows:
        for first, bits in simhash.SEGMENTS:
            for j in range(first, first + bits):
                runs.setdefault((j, x >> first & ((1 << bits) - 1) & ~(1 << j - first)), []).append(x)
    for (j, _), run in runs.items():  # a key is hot for all its rows or for none, and never missed
        assert len({hot[x] >> j & 1 for x in run}) == 1 and (len(run) <= 12 or hot[run[0]] >> j & 1)
    pairs = simhash.links(frame).collect()
    root = {x: i for i, x in enumerate(rows)}
    for _ in rows:
        for r in pairs:
            a, b = r.a % (1 << 64), r.b % (1 << 64)
            root[a] = root[b] = min(root[a], root[b])
    assert [root[x] for x in rows] == wanted


def test_representatives(spark, docs):
    kept = simhash.representatives(docs)
    named = {r.component_id for r in simhash.near_duplicates(docs).collect()} - {None}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted(named) and ids.count(None) == 2 and kept.columns == docs.columns


def test_representatives_of_repeated_ids(spark):
    rng = random.Random(21)
    one, other, third = (prose(rng, 60) for _ in range(3))
    rows = [(1, one), (1, other), (2, other), (3, one), (1, one), (4, third), (4, third), (None, third)]
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", one), ("1", other), ("4", third), ("None", third)])


# Repeated text


def test_suffix_array_by_linear_grouping():
    rng = random.Random(1)
    for _ in range(400):
        text, ends = [], []
        for _ in range(rng.randint(1, 4)):
            text += [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 14))]
            ends.append(len(text))
            text.append(0)
        ranked = {e: k - len(text) for k, e in enumerate(ends)}
        full = [ranked.get(i, x) for i, x in enumerate(text)]
        assert suffix_dedup.suffix_array(text, ends) == sorted(range(len(full)), key=lambda i: full[i:])
    assert suffix_dedup.suffix_array([], []) == []


def test_suffix_arrays_in_lockstep():
    rng = random.Random(2)
    for _ in range(150):
        flat, ends, sizes, wanted = [], [], [], []
        for _ in range(rng.randint(0, 6)):
            text, own = [], []
            for _ in range(rng.randint(1, 4)):
                text += [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 14))]
                own.append(len(text))
                text.append(0)
            wanted += [len(flat) + k for k in suffix_dedup.suffix_array(text, own)]
            ends += [len(flat) + e for e in own]
            flat += text
            sizes.append(len(text))
        is_end = np.zeros(len(flat), bool)
        is_end[ends] = True
        assert suffix_dedup.suffix_arrays(np.array(flat, np.int16), is_end, np.array(sizes, np.int64)).tolist() == wanted


@pytest.mark.parametrize("shared", [0, 1 << 40])
def test_window_owners_equal_brute_force(shared, monkeypatch):
    """Many surroundings of one anchor, cut again and again, sorted in lockstep or one by one."""
    monkeypatch.setattr(suffix_dedup, "SHARED_STEPS", shared)
    side, rng = suffix_dedup.SIDE, np.random.default_rng(5)
    sides = rng.integers(97, 99, (300, 2 * side)).astype(np.uint8)
    sides[:, :20] = sides[rng.integers(0, 3, 300), :20]
    sides[:, 30:] = sides[rng.integers(0, 4, 300), 30:]
    left, right = (rng.choice([side, side, 20, 3, 0], 300) for _ in range(2))
    sides[:, :side][np.arange(side) < side - left[:, None]] = 0
    sides[:, side:][np.arange(side) >= right[:, None]] = 0
    sized = np.unique(np.concatenate([sides, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], 1), axis=0)
    h, ids = rng.integers(1, 3, len(sized)).astype(np.uint64), rng.permutation(len(sized))
    owners = {}
    for k, x in enumerate(sized.tolist()):
        for j in range(side + 1):
            if x[-2] >= side - j and x[-1] >= j:
                owners.setdefault((int(h[k]), j, tuple(x[j : j + side])), []).append(k)
    wanted = np.full((len(sized), side + 1), suffix_dedup.NEVER)
    for (_, j, _), rows in owners.items():
        wanted[rows, j] = ids[rows].min()
    order = np.argsort(h, kind="stable")
    for strings in (4096, 40, 2):
        monkeypatch.setattr(suffix_dedup, "TEXT_STRINGS", strings)
        assert (suffix_dedup.window_owners(h[order], sized[order], ids[order]) == wanted[order]).all()


def test_only_surroundings_that_can_hold_a_repeat_are_sorted(monkeypatch):
    """Of many surroundings of one anchor, those that share 13 bytes beside it on a side go into suffix arrays, others not."""
    met = []
    for name in ("suffix_array", "suffix_arrays"):
        monkeypatch.setattr(suffix_dedup, name, lambda text, *rest, f=getattr(suffix_dedup, name): (met.append(len(text)), f(text, *rest))[1])
    side, rng = suffix_dedup.SIDE, np.random.default_rng(6)
    sized = np.concatenate([rng.integers(97, 123, (300, 2 * side)), np.full((300, 2), side)], 1).astype(np.uint8)
    h, ids = np.ones(300, np.uint64), np.arange(300)
    assert (suffix_dedup.window_owners(h, sized, ids) == ids[:, None]).all() and not met
    sized[9, 10 : side + 10] = sized[4, 10 : side + 10]  # ten bytes from the right of it and sixteen from the left: windows 10 only
    owners = suffix_dedup.window_owners(h, sized, ids)
    assert owners[9, 10] == 4 and (np.delete(owners, 9, 0) == np.delete(ids, 9)[:, None]).all() and (np.delete(owners[9], 10) == 9).all()
    assert 0 < sum(met) <= 2 * (side + 2)


def brute_repeats(rows, n=50):
    own = {}
    for d, t in rows:
        for k in range(len(t) - n + 1 if d is not None else 0):
            w = t[k : k + n]
            own[w] = min(d, own.get(w, d))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - n + 1 if d is not None else 0):
            if own[t[k : k + n]] < d:
                gone[k : k + n] = b"\1" * n
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("strings", [suffix_dedup.TEXT_STRINGS, 3])
def test_repeats_equal_brute_force(spark, docs, none, strings, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TEXT_STRINGS", strings)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1 << 14)
    found = suffix_dedup.repeats(docs).collect()
    got = [(r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), r.kept_sha256) for r in found]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    wanted = brute_repeats([(r.doc_id, (r.text or "").encode()) for r in docs.collect()])
    assert sorted(got, key=key) == sorted(wanted, key=key)
    assert sum(r[2] for r in got) > 1000
    assert suffix_dedup.repeats(none).count() == 0


def test_overlapping_edits_in_many_copies(spark):
    rng = random.Random(9)
    base = prose(rng, 60)
    rows = []
    for i in range(40):
        t = list(base)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i * 7 % 40, "".join(t)[rng.randint(0, 30) :]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (sum(s.stop - s.start for s in r.spans), r.kept_sha256) for r in suffix_dedup.repeats(frame).collect()}
    assert got == {d: (n, sha) for d, _, n, _, sha in brute_repeats([(d, t.encode()) for d, t in rows])}


# Nearest vectors


def test_nearest_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    x = (centres[rng.integers(0, 30, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    x[700:1100] = x[5]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (None, x[0].tolist()), (2005, [None] + [1.0] * 15), (2006, [float("inf")] * 16)]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    found = {}
    for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(found) == set(range(0, 1500, 50))
    y = x.astype(np.float64)
    hits = 0
    for q, got in found.items():
        cosine = (y * y[q]).sum(1) / (np.sqrt((y * y).sum(1)) * np.sqrt((y[q] ** 2).sum()))
        cosine[q] = -2
        best = np.lexsort((np.arange(1500), -cosine))[:5]
        ids = [got[k][0] for k in range(1, 6)]
        hits += len(set(ids) & set(best.tolist()))
        assert [got[k][1] for k in range(1, 6)] == pytest.approx(cosine[ids], abs=1e-12)
        assert ids == sorted(ids, key=lambda i: (-cosine[i], i))
    assert hits >= 0.9 * 5 * len(found)
    assert [v for v, _ in (found[750][k] for k in range(1, 6))] == [5, 700, 701, 702, 703]


def test_nearest_among_many_near_copies():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32))
    hot = rng.permutation(3000)[:1000]
    x[hot] = x[hot[0]] + 0.05 * rng.normal(size=(1000, 32))
    x[hot[:200]] = x[hot[0]]  # more exact copies than the first shortlist holds
    unit = ann._unit(x)
    model = ann.fit(unit)
    q_ids = np.sort(np.concatenate([hot[150:250], np.setdiff1d(np.arange(3000), hot)[:50]]))
    found = list(ann._nearest(np.arange(3000), x, *model.encode(unit), q_ids, x[q_ids], model, 5, ann.SHORTLIST))
    length = np.sqrt((x * x).sum(1))
    for q, (query, ids, scores) in zip(q_ids, found, strict=True):
        cosine = (x * x[q]).sum(1) / (length * length[q])
        cosine[q] = -2
        assert set(query) == {q} and ids.tolist() == np.lexsort((np.arange(3000), -cosine))[:5].tolist()
        assert scores == pytest.approx(cosine[ids], abs=1e-12)


def test_few_or_no_vectors(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (50, [0.0, 1.0])], "vec_id bigint, embedding array<float>")
    rows = sorted(tuple(r) for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).collect())
    assert [r[:3] for r in rows] == [(0, 1, 1), (0, 2, 50), (50, 1, 1), (50, 2, 0)]
    assert ann.nearest(frame.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_several_query_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id bigint, embedding array<double>")
    one = sorted(tuple(r) for r in ann.nearest(frame, F.col("vec_id") % 10 == 0).collect())
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    assert sorted(tuple(r) for r in ann.nearest(frame, F.col("vec_id") % 10 == 0).collect()) == one and len(one) == 150


def test_vectors_of_extreme_length(spark):
    frame = spark.createDataFrame([(0, [1e200, 1e200]), (1, [1.0, 0.0]), (2, [2.0**-660, 0.0]), (2, [0.0, -(2.0**-560)])], "vec_id bigint, embedding array<double>")
    rows = sorted(tuple(r) for r in ann.nearest(frame, F.col("vec_id") % 50 == 0).collect())
    assert [r[:3] for r in rows] == [(0, 1, 1), (0, 2, 2), (0, 3, 2)] and [r[3] for r in rows] == pytest.approx([0.5**0.5, 0.5**0.5, -(0.5**0.5)], abs=1e-15)


def test_blocks_of_many_items():
    block = decontaminate.Block([(str(k), b"w%d v%d" % (k, k % 7)) for k in range(60_000)], 13)
    assert block.start[-1] == 119_998 and block.names[block.item[-1]] == "59999" and block.longest == 2
