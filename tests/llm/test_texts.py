"""Mixing, sharding, WARC, language, tokens, toxicity and the pipeline."""

import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import langid, mixing, sharding, tokencount, toxicity, warc
from tests.llm.conftest import prose

# Mixing


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None] * (None in sizes)
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    cap, left = {k: most * sizes[k] for k in names}, share * sum(sizes.values())
    target, open_ = dict.fromkeys(names, 0.0), set(names)
    while open_ and left > 1e-9:
        part = left / sum(w[k] for k in open_)
        left = 0.0
        for k in list(open_):
            target[k] += part * w[k]
            if target[k] > cap[k]:
                left += target[k] - cap[k]
                target[k] = cap[k]
                open_.remove(k)
    return target


def test_mix(spark, docs, none):
    rows = mixing.mix(docs.drop("size", "taken")).collect()
    assert len(rows) == docs.count()
    size, taken = {}, {}
    for r in rows:
        n = len((r.text or "").encode().split())
        assert r["__size"] == n and 0 <= r.taken <= 2 * n and (r.taken == 0) == (not r.shards)
        size[r.source] = size.get(r.source, 0) + n
        taken[r.source] = taken.get(r.source, 0) + r.taken
    target = brute_targets(size)
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[k] - v) <= 0.5 + 1e-6 for k, v in target.items())
    again = mixing.mix(docs.drop("size", "taken").repartition(5)).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.taken, r.shards)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert mixing.mix(none).count() == 0


def test_taken_is_what_shards_draw(spark, monkeypatch):
    """Brute force: each source's permuted draws, dealt to shards as the tree's leaves say; shards' words add up to taken."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 10)
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(0, 9), ["a", "b", None, "c"][min(3, int(rng.random() ** 2 * 4))]) for i in range(700)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    prepared = mixing.staged(mixing.prepared(frame).select("doc_id", "__source", "__size", "__h"), "t")
    blocks = mixing.plan(prepared)
    got = {r.doc_id: r for r in mixing.mixed(prepared, blocks).collect()}
    sources = {r["__source"]: r for r in mixing.targets(prepared).collect()}
    per_shard = {}
    for name, source in sources.items():
        members = [r for r in got.values() if r["__source"] == name]
        assert abs(sum(r.taken for r in members) - source.target) <= 0.5 + 1e-9
        for r in members:
            full, part = divmod(r.taken, r["__size"]) if r["__size"] else (0, 0)
            assert len(r.shards) == full + (part > 0)
            for k, shard in enumerate(r.shards):
                per_shard[shard] = per_shard.get(shard, 0) + (r["__size"] if k < full else part)
    assert set(per_shard) == set(range(8)) and sum(per_shard.values()) == sum(r.taken for r in got.values())
    # a block's rows are in the same shards, pass by pass, and shards have disjoint draws of nearly the same number
    draws = {}
    for b in blocks.collect():
        for k, shard in enumerate(b.shards):
            draws.setdefault(shard, set()).add((b["__source"], b["__block"], k))
    n = [len(v) for v in draws.values()]
    assert max(n) - min(n) <= 1 and len(set.union(*draws.values())) == sum(n)
    assert len({len(b.shards) for b in blocks.collect()}) > 1


def test_mix_with_clashing_columns(spark):
    names = ("part", "words", "blocks", "target", "full", "shards", "taken", "rank", "at", "last", "__source", "__size", "__block", "places", "source_size")
    frame = spark.createDataFrame([(i, "a b c", f"s{i % 2}") for i in range(30)], "doc_id bigint, text string, source string").withColumns({c: F.lit("x") for c in names})
    found = mixing.mix(frame)
    assert found.columns == ["doc_id", "text", "source", "part", "words", "blocks", "full", "rank", "at", "last", "__source", "__block", "__size", "source_size", "target", "taken", "shards", "places"]
    assert found.count() == 30 and {r.words for r in found.collect()} == {"x"} and found.agg(F.sum("taken")).first()[0] == 135
    assert mixing.drawn_copies(frame).columns == frame.columns


def test_drawn_copies(spark, docs, none):
    out = mixing.drawn_copies(docs)
    assert out.columns == docs.columns
    have = {}
    for r in out.collect():
        have[r.doc_id] = have.get(r.doc_id, 0) + 1
    assert max(n for k, n in have.items() if k not in (None, 3)) <= 2
    assert mixing.drawn_copies(none).count() == 0


def test_copies_are_shuffled_within_shards(spark):
    frame = spark.createDataFrame([(i, f"word{i} " * (i % 5 + 1), f"s{i % 3}") for i in range(900)], "doc_id bigint, text string, source string").coalesce(1)
    rows = mixing.mix(frame).collect()
    assert all(len(r.places) == len(r.shards) for r in rows)
    wanted = []
    for r in rows:
        n = (2 * r.taken + r["__size"]) // (2 * r["__size"])
        wanted += [(shard, place, r.doc_id) for shard, place in zip(r.shards[:n], r.places[:n], strict=True)]
    got = [r.doc_id for r in mixing.drawn_copies(frame).collect()]
    assert got == [i for _, _, i in sorted(wanted)] and len({shard for shard, _, _ in wanted}) == mixing.SHARDS
    assert sum(a == b for a, b in zip(got, got[1:], strict=False)) < 20


def test_splitting_tree_is_exact_and_even(spark):
    draws = [37, 1, 0, 120, 5]
    rows = mixing.split_quotas(spark.createDataFrame(list(enumerate(draws)), "rank int, draws bigint"), 8, 3).collect()
    by = {(r["rank"], r.shard): (r["first"], r["stop"]) for r in rows}
    for k, n in enumerate(draws):
        at = 0
        for s in range(8):
            assert by[k, s][0] == at
            at = by[k, s][1]
        assert at == n
    sizes = [sum(by[k, s][1] - by[k, s][0] for k in range(5)) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1


def test_hypergeometric_distribution(spark):
    """Over all u the frequencies are those of the distribution."""
    K, N, n = 6, 15, 7
    u = spark.range(20_000).select(((F.col("id") + 0.5) / 20_000).alias("u"))
    lit = lambda x: F.lit(x).cast("bigint")
    found = {r.k: r["count"] for r in u.select(mixing.hypergeometric(lit(K), lit(N), lit(n), F.col("u")).alias("k")).groupBy("k").count().collect()}
    for k in range(max(0, n - (N - K)), min(n, K) + 1):
        p = math.comb(K, k) * math.comb(N - K, n - k) / math.comb(N, n)
        assert found.get(k, 0) / 20_000 == pytest.approx(p, abs=2e-4)


# Sharding


def test_shards_are_even_and_keep_groups(spark, docs, none):
    rows = sharding.sharded(docs).collect()
    assert len(rows) == docs.count()
    sizes, slots = {}, {}
    for r in rows:
        sizes[r.shard] = sizes.get(r.shard, 0) + 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    wanted = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == wanted
    assert sharding.sharded(none).count() == 0
    few = sharding.sharded(docs.limit(3)).collect()
    assert len({r.shard for r in few}) == 3 and all(r.slot == 0 for r in few)


def test_links_are_hardly_cut(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for g in range(400):
        for _ in range(rng.choice([1] * 12 + [2, 3, 9])):
            rows.append((n, f"text {g}"))
            n += 1
    rows += [(n + i, "hot") for i in range(n // 2)]  # a third of all rows
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    result = sharding.sharded(frame)
    by = {}
    for r in result.join(frame, "doc_id").collect():
        by.setdefault(r.text, {}).setdefault(r.shard, []).append(1)
    quota = len(rows) / 8
    assert len(by["hot"]) <= math.ceil(len(rows) / 3 / quota) + 2
    cut = sum(len(s) > 1 for t, s in by.items() if t != "hot")
    assert cut <= 10
    first = sum(n for s in by.values() for n in [sum(map(len, s.values())) - max(map(len, s.values()))])
    assert first == sharding.cut_links(result).first().cut_rows


# WARC


@pytest.fixture(scope="module")
def pages(spark):
    html = "<html>" + "p" * 200 + "</html>"
    rows = [(1, "http://a/1", html), (2, "http://a/2 x\r\ny", html), (3, None, html), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "http://é/", "é" * 300), (8, "http://é/", "é" * 300), (None, "n", html), (9, "b", "<p>" + prose(random.Random(1), 60_000))]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).repartition(2)


def test_archives_round_trip(spark, pages, tmp_path):
    folder = f"file://{tmp_path}"
    warc.write_archives(pages, folder).collect()
    back = warc.read_archives(spark, folder, ["record_type", "record_id", "target_uri", "page_id", "refers_to", "refers_to_page_id", "payload_length", "payload_digest", "content_length", "payload"]).collect()
    inputs = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    assert sorted((str(r.page_id), r.payload_length, r.payload_digest) for r in back) == sorted((str(p), len(h), "sha256:" + hashlib.sha256(h).hexdigest()) for p, h in inputs)
    revisits = {(r.page_id, r.refers_to_page_id) for r in back if r.record_type == "revisit"}
    assert revisits == {(2, 1), (3, 1), (None, 1)}
    ids = {r.page_id: r.record_id for r in back}
    for r in back:
        if r.record_type == "revisit":
            assert r.payload is None and r.refers_to == ids[1]
        else:
            assert hashlib.sha256(r.payload).hexdigest() == r.payload_digest[7:] and len(r.payload) == r.payload_length
    assert {r.target_uri for r in back if r.page_id == 2} == {"http://a/2%20x%0D%0Ay"} and {r.target_uri for r in back if r.page_id == 3} == {None}
    # every record is a member of its own for any gzip reader
    for f in tmp_path.glob("*.warc.gz"):
        assert gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") >= 1


def test_predicates_are_pushed_down(spark, pages, tmp_path):
    folder = f"file://{tmp_path}"
    warc.write_archives(pages, folder).collect()
    rows = warc.read_archives(spark, folder, ["record_type", "page_id", "target_uri", "payload"])
    some = rows.where("record_type = 'response' and page_id >= 8 and target_uri like 'http%'")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan warc" in plan and "Filter" not in plan.replace("RuntimeFilters", "")
    assert sorted(r.page_id for r in some.collect()) == [8, 8]
    for condition, ids in (("page_id is null", {None}), ("page_id in (4, 9)", {4, 9}), ("page_id is not null and not (page_id = 9)", {1, 2, 3, 4, 5, 6, 7, 8}), ("target_uri = 'b'", {9})):
        assert {r.page_id for r in rows.where(condition).collect()} == ids


def test_other_archives(spark, tmp_path):
    """Plain files, members without noted lengths, broken and empty folders."""
    one = warc.record(1, "u", b"x" * 5000, "d", None, "t") + warc.record(2, "u", b"y" * 70_000, "d", None, "t")
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(one)
    (tmp_path / "plain" / "b.warc.gz").write_bytes(gzip.compress(warc.record(3, "u", b"z" * 90_000, "d", None, "t")) + gzip.compress(warc.record(4, "u", b"", "d", None, "t")))
    rows = warc.read_archives(spark, f"file://{tmp_path}/plain", ["page_id", "payload"])
    assert sorted((r.page_id, len(r.payload)) for r in rows.collect()) == [(1, 5000), (2, 70_000), (3, 90_000), (4, 0)]
    assert sorted(r.page_id for r in rows.where("page_id > 1").select("page_id").collect()) == [2, 3, 4]
    (tmp_path / "empty").mkdir()
    assert warc.read_archives(spark, f"file://{tmp_path}/empty", ["page_id"]).count() == 0
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "a.warc.gz").write_bytes(warc.gzip_member(warc.record(1, "u", random.Random(1).randbytes(9000), "d", None, "t"))[:-900])
    with pytest.raises(Exception, match="a.warc.gz at 0"):
        warc.read_archives(spark, f"file://{tmp_path}/broken", ["page_id", "payload"]).collect()


# Language


def brute_profile(texts, most):
    import re
    from collections import Counter

    counts = Counter()
    for t in texts:
        for w in re.findall(r"[^\W\d_]+", (t or "").lower()):
            p = f" {w} "
            counts.update([*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))])
    return sorted(counts, key=lambda g: (-counts[g], g))[:most]


def test_languages(spark, docs, none):
    rng = random.Random(2)
    kinds = {"aa": "ka lo mi ne", "bb": "str ung ver sch", "cc": "été oir eau que"}
    rows = [(i, " ".join("".join(rng.choice(kinds[k].split()) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))), k) for i in range(60) for k in kinds]
    taught = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    profiles = langid.learn(taught)
    assert profiles.languages == ["aa", "bb", "cc"]
    by = {k: brute_profile({t for _, t, x in rows if x == k}, langid.PROFILE) for k in kinds}
    odd = [(900, None), (901, ""), (902, "123 --- !!"), (903, "KALO mine"), (904, "Été"), (905, "x" * 30_000)]
    frame = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows[:40])] + odd, "doc_id bigint, text string")
    for r in frame.select("text", langid.identify(frame, profiles).alias("f")).collect():
        grams = brute_profile([r.text], langid.TEXT_PROFILE)
        if not grams:
            assert tuple(r.f) == ("und", 0.0)
            continue
        d = {k: sum(min(abs(i - p.index(g)), langid.PROFILE) if g in p else langid.PROFILE for i, g in enumerate(grams)) for k, p in by.items()}
        best = min(sorted(d), key=d.get)
        assert r.f.lang == best and r.f.score == pytest.approx(1 - d[best] / (langid.PROFILE * len(grams)))
    empty = langid.learn(none)
    assert {tuple(r.f) for r in docs.select(langid.identify(docs, empty).alias("f")).collect()} == {("und", 0.0)}


# Tokens


def test_token_counts(spark, docs, none):
    import tiktoken

    vocabulary = open(tokencount.VOCABULARY, "rb").read()
    encoding, _ = tokencount.tokenizer(vocabulary)
    assert isinstance(encoding, tiktoken.Encoding)
    count = tokencount.counter(spark)
    for r in docs.select("text", tokencount.lines_of(F.col("text")).alias("lines"), count(tokencount.lines_of(F.col("text"))).alias("f")).collect():
        ids = encoding.encode_ordinary(r.text or "")
        assert r.f.n_tokens == len(ids) and sum(r.f.counts) == len(ids) and "".join(r.lines or []) == (r.text or "")
        ends, owners = np.cumsum([len(x.encode()) for x in r.lines or []]), []
        at = 0
        for x in ids:
            size = len(encoding.decode_single_token_bytes(x))
            spread = [int(np.searchsorted(ends, b, "right")) for b in range(at, at + size)]
            owners.append(max(sorted(set(spread)), key=spread.count))
            at += size
        assert r.f.counts == [owners.count(k) for k in range(len(r.lines or []))]
    assert none.select(count(tokencount.lines_of(F.col("text"))).alias("f")).count() == 0


def test_token_allocation_rules():
    ends, parts = np.array([3, 7, 9, 20]), np.array([5, 5, 8, 30])
    assert tokencount.allocate(ends, parts, "most")[0].tolist() == [2, 0, 1, 1]
    assert tokencount.allocate(ends, parts, "first")[0].tolist() == [2, 0, 1, 1]
    shared, crossing = tokencount.allocate(ends, parts, "share")
    assert shared.tolist() == [1.5, 0, 1.0, 1.5] and crossing == 2
    with pytest.raises(ValueError, match="no rule"):
        tokencount.allocate(ends, parts, "other")


# Toxicity


def toxic_corpus(n, seed):
    rng = random.Random(seed)
    bad = ["zzgrub", "quorx", "vilexik", "wombaxx"]
    rows = []
    for i in range(n):
        w, toxic = prose(rng, rng.randint(20, 90)).split(), int(rng.random() < 0.25)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        rows.append((i, " ".join(w), toxic))
    return rows


def test_toxic_texts_are_found(spark, docs, none):
    rows = toxic_corpus(500, 4)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = frame.where("doc_id < 400").select("doc_id", "toxic")
    labels = labels.union(labels.limit(5)).union(spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int"))
    model = toxicity.learn(frame.select("doc_id", "text"), labels)
    score = toxicity.scorer(spark, model)
    held = frame.where("doc_id >= 400").select("toxic", score("text").alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in held)
    assert np.mean([(r.s >= 0.5) == bool(r.toxic) for r in held]) > 0.95
    odd = [r.s for r in docs.where("text is null or length(trim(text)) = 0").select(score("text").alias("s")).collect()]
    assert odd and all(0 <= s < 0.5 for s in odd)
    assert docs.select(score("text").alias("s")).where("s is null").count() == 0
    assert toxicity.learn(frame.select("doc_id", "text"), labels.where("false")).weights == ()
    assert {r.s for r in docs.select(toxicity.scorer(spark, toxicity.Model())("text").alias("s")).collect()} == {0.0}
    assert none.select(score("text")).count() == 0


def test_toxic_texts_of_many_words_are_found():
    """300 toxic words, three in a text: each is rare, and together they are more than 1024 bytes."""
    rng = random.Random(12)
    bad = ["".join(rng.choice("bcdfghjkqtxyz") for _ in range(9)) for _ in range(300)]
    rows = []
    for i in range(2500):
        w, toxic = prose(rng, rng.randint(20, 90)).split(), int(i % 4 == 0)
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((" ".join(w).encode(), toxic))
    rng.shuffle(rows)
    scorer = toxicity.fit(rows[:1900]).scorer()
    found = [(scorer.score(t) >= 0.5, y) for t, y in rows[1900:]]
    assert np.mean([s for s, y in found if y]) > 0.95 and np.mean([not s for s, y in found if not y]) > 0.95


def test_toxicity_without_enough_text_to_train_on():
    model = toxicity.fit([(b"bad grumblex", 1), (b"good day to you", 0)])
    assert 0 <= model.scorer().score(b"grumblex") <= 1


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    rng = random.Random(7)
    rows = toxic_corpus(160, 8)
    items = [(k, prose(rng, 30)) for k in range(4)]
    docs = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, _ in rows]
    docs += [(1000 + i, docs[i][1], "en", "s0", 1) for i in range(10)]
    docs += [(2000 + k, t + " " + prose(rng, 10), "en", "s1", 1) for k, t in items]
    docs += [(None, None, None, None, None), (3000, "", "en", None, 0)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("__score", F.lit(1).cast("int"))
    frame.drop("__score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = now.columns
    for k, (_, stage) in enumerate(p.STAGES):
        now = p.staged(stage(spark, now, str(tmp_path)), "test")
        seen.append(now)
        if k < 4:
            assert now.columns == columns
    toxic = {i for i, _, y in rows if y}
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in seen]
    assert len(set(ids[0]) & toxic) <= 0.1 * len(toxic) and len(set(i for i, _, y in rows if not y) - set(ids[0])) <= 3
    assert not {i for i in ids[1] if i is not None and 1000 <= i < 1010 and i - 1000 in ids[0]}
    assert set(ids[1]) - set(ids[2]) == {2000, 2001, 2002, 2003} & set(ids[1])
    assert sorted(map(str, ids[4])) == sorted(map(str, ids[3])) and max(ids[3].count(i) for i in ids[3]) == 2
    final = p.run(spark, str(tmp_path))
    assert final.columns == seen[4].columns and final.count() == len(ids[4])


def test_queries_and_sql_agree(spark, sf_dir):
    """The registered queries with SQL, on the smallest tables."""
    import duckdb

    from tilewright.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in SQL:
        frame = QUERIES[name](spark, sf_dir)
        columns = sorted(frame.columns)
        wanted = sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()))
        assert sorted(str(tuple(r)) for r in frame.select(*columns).collect()) == wanted


def test_members_of_several_records(spark, tmp_path):
    """Any record of a member is read, and what a stale file of a repeated task holds is not."""
    many = b"".join(warc.record(k, "u", bytes([65 + k]) * n, "d", None, "t") for k, n in enumerate((0, 7, 200_000, 50, 3_000_000, 1)))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(many) + gzip.compress(warc.record(6, "u", b"z", "d", None, "t")) + warc.gzip_member(many))
    rows = warc.read_archives(spark, f"file://{tmp_path}", ["page_id", "payload"])
    wanted = [(0, 0), (1, 7), (2, 200_000), (3, 50), (4, 3_000_000), (5, 1)]
    assert sorted((r.page_id, len(r.payload)) for r in rows.collect()) == sorted(wanted * 2 + [(6, 1)])
    assert sorted(r.page_id for r in rows.where("page_id > 3").select("page_id").collect()) == [4, 4, 5, 5, 6]
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(gzip.compress(many[:-2000]))
    with pytest.raises(Exception, match="a.warc.gz at 0"):
        warc.read_archives(spark, f"file://{tmp_path}/cut", ["page_id"]).collect()


def test_stale_archives_and_empty_pages(spark, pages, tmp_path):
    folder = f"file://{tmp_path}"
    written = warc.write_archives(pages, folder).count()
    (tmp_path / "part-00000-099.warc.gz").write_bytes(gzip.compress(warc.record(99, "u", b"z", "d", None, "t")))
    assert written and warc.read_archives(spark, folder, ["page_id"]).count() == pages.count()
    assert warc.write_archives(pages.where("false")).count() == 0


def test_long_blanks_are_encoded():
    vocabulary = open(tokencount.VOCABULARY, "rb").read()
    encoding, lengths = tokencount.tokenizer(vocabulary)
    for text in ("a" + " " * 200_000 + "bc  d", "a" + "\n" * 150_000 + "\tb", " \n" * 90_000, " " * 100_000 + "x" + "　" * 120_000, "\x1c" * 120_000 + " y"):
        wanted = np.cumsum(lengths[np.array(encoding.encode_ordinary(text))])
        assert tokencount.token_ends(text, vocabulary).tolist() == wanted.tolist()
    assert tokencount.token_ends("a" + " " * 2_000_000 + "b", vocabulary)[-1] == 2_000_002
