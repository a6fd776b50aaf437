"""The registered queries over a small folder of tables: their columns, which rows they learn from and search, odd tables."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tests.llm.test_searches import brute_components, brute_fingerprint
from tests.llm.test_texts import brute_targets, toxic_corpus
from tilewright.llm import langid, toxicity
from tilewright.llm.queries import QUERIES

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
RESULTS = {
    "op1_ann": ["query_id bigint", "rank int", "vec_id bigint", "score double"],
    "op2_toxicity": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
    "op3_decontaminate": ["doc_id bigint", "n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string", "contaminated boolean"],
    "op4_warc": ["page_id bigint", "payload_bytes bigint", "payload_digest string", "record_type string", "refers_to bigint"],
    "op5_simhash": ["doc_id bigint", "fingerprint string", "component_id bigint"],
    "op6_sharding": ["doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int", "slot bigint", "grown_shard int"],
    "op7_mixing": ["doc_id bigint", "size bigint", "source_size bigint", "target double", "taken bigint"],
    "op8_langid": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
    "op10_suffix_dedup": ["doc_id bigint", "n_bytes bigint", "n_removed bigint", "n_spans bigint", "kept_sha256 string"],
}


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(31)
    out = [(i, t, "en" if i % 2 else "de", ["b", "a", None, "c"][i % 4], 1) for i, t, _ in toxic_corpus(200, 4)]
    out += [(500 + i, out[i][1], "en", "a", 1) for i in range(6)]
    return out + [(600, "", None, None, 0), (601, None, "de", "a", None), (602, " !? 12", "en", "b", 6), (3, out[3][1], "de", "c", 1), (603, prose(rng, 4000), "en", "a", 1)]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("tables"), np.random.default_rng(2)
    labels = [(i, y) for i, _, y in toxic_corpus(200, 4)]
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(220, 8)))] + [(350, None), (400, [0.0] * 8)]
    html = prose(random.Random(1), 40)
    pages = [(1, "u", html), (0, "u", html), (2, "u", None), (3, "u", "ü" * 60), (4, "u", "short"), (5, "u", "short")]
    for name, data, schema in (("documents", rows, DOCUMENTS), ("labels", labels, "doc_id bigint, toxic int"), ("embeddings", vectors, "vec_id bigint, embedding array<float>"), ("pages", pages, "page_id bigint, url string, html string"), ("benchmark", [(0, rows[3][1])], "item_id bigint, text string")):
        frame = spark.createDataFrame(data, schema).repartition(3)
        frame.write.parquet(f"{path}/{name}.parquet")
        frame.where("false").write.parquet(f"{path}/none/{name}.parquet")
    return str(path)


def test_columns_of_whole_and_empty_tables(spark, folder):
    for name, columns in RESULTS.items():
        for at in (folder, f"{folder}/none"):
            kinds = dict(QUERIES[name](spark, at).dtypes)
            assert [f"{c.split()[0]} {kinds.get(c.split()[0])}" for c in columns] == columns, name
    for name in QUERIES:
        assert QUERIES[name](spark, f"{folder}/none").count() == 0, name


def test_a_row_for_each_document(spark, folder, rows):
    wanted = sorted(r[0] for r in rows)
    for name in ("op2_toxicity", "op3_decontaminate", "op6_sharding", "op7_mixing", "op8_langid", "op9_tokencount", "op10_suffix_dedup"):
        assert sorted(r.doc_id for r in QUERIES[name](spark, folder).select("doc_id").collect()) == wanted, name


def test_op1_searches_for_every_fiftieth_vector(spark, folder):
    x = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("vec_id < 300").collect()}
    cosine = lambda a, b: (x[a] @ x[b]) / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b]))
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in QUERIES["op1_ann"](spark, folder).collect()}
    assert sorted(found) == [(q, k) for q in range(0, 220, 50) for k in range(1, 6)]
    for q in range(0, 220, 50):
        best = sorted((i for i in x if i != q), key=lambda i: (-cosine(q, i), i))[:5]
        assert [found[q, k][0] for k in range(1, 6)] == best
        assert [found[q, k][1] for k in range(1, 6)] == pytest.approx([cosine(q, i) for i in best], abs=1e-12)


@pytest.mark.parametrize("name, n, held", [("op2_toxicity", 5, 0), ("op8_langid", 3, 1)])
def test_held_out_rows(spark, folder, rows, name, n, held):
    found = QUERIES[name](spark, folder).select("doc_id", "held_out", "score").collect()
    assert all(r.held_out == (remainder(r.doc_id, n) == held) and 0 <= r.score <= 1 for r in found)
    assert 0 < sum(r.held_out for r in found) < len(rows)


def test_op2_learns_from_other_labels_only(spark, folder, monkeypatch):
    seen = []
    learn = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda docs, labels, **how: seen.append((docs.columns, [r.doc_id for r in labels.collect()])) or learn(docs, labels, **how))
    found = QUERIES["op2_toxicity"](spark, folder).collect()
    (columns, ids), = seen
    assert columns == ["doc_id", "text"] and sorted(ids) == [i for i in range(200) if remainder(i, 5)]
    toxic = {i: y for i, _, y in toxic_corpus(200, 4)}
    right = [r.predicted == toxic[r.doc_id] for r in found if r.held_out and r.doc_id in toxic]
    assert np.mean(right) >= 0.9 and all(r.predicted == (r.score >= 0.5) for r in found)


def test_op8_learns_from_other_documents_only(spark, folder, rows, monkeypatch):
    seen = []
    learn = langid.learn
    monkeypatch.setattr(langid, "learn", lambda docs, **how: seen.extend(r.doc_id for r in docs.collect()) or learn(docs, **how))
    found = {r.doc_id: r.lang_pred for r in QUERIES["op8_langid"](spark, folder).collect()}
    assert sorted(set(seen)) == sorted({r[0] for r in rows if remainder(r[0], 3) != 1})
    assert {found[i] for i in (600, 601, 602)} == {"und"} and set(found.values()) <= {"en", "de", "und"}


def test_op5_names_components(spark, folder, rows):
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in rows]
    wanted = sorted((i, f"{fp:016x}", c) for (i, fp), c in zip(prints, brute_components(prints), strict=True))
    assert sorted(tuple(r) for r in QUERIES["op5_simhash"](spark, folder).collect()) == wanted


def test_op6_sizes_and_slots(spark, folder, rows):
    found = QUERIES["op6_sharding"](spark, folder).collect()
    of = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((r.doc_id, r.size, r.text_crc32 or 0) for r in found) == sorted((i, *of(t)) for i, t, *_ in rows)
    held = {}
    for r in found:
        held.setdefault(r.shard, []).append(r.slot)
    assert {r.law for r in found} == {"rows"} and set(held) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in held.values())
    assert max(map(len, held.values())) - min(map(len, held.values())) <= 1


def test_op7_meets_targets(spark, folder, rows):
    found = QUERIES["op7_mixing"](spark, folder).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in found) == sorted((i, size(t)) for i, t, *_ in rows)
    sizes = {}
    for _, t, _, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + size(t)
    named = {r[0]: r[3] for r in rows if r[0] != 3}
    want = brute_targets(sizes)
    for r in found:
        assert r.taken <= 2 * r.size
        if r.doc_id in named:
            assert r.source_size == sizes[named[r.doc_id]] and r.target == pytest.approx(want[named[r.doc_id]])
    by_target = {}
    for r in found:
        by_target[r.target] = by_target.get(r.target, 0) + r.taken
    assert all(abs(taken - target) <= 2 for target, taken in by_target.items())
    assert sorted(map(str, found)) == sorted(map(str, QUERIES["op7_mixing"](spark, folder).collect()))


def test_op4_revisits_the_smallest_page(spark, folder):
    found = {r.page_id: r for r in QUERIES["op4_warc"](spark, folder).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in found.items()} == {0: ("response", None), 1: ("revisit", 0), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None)}
    assert found[2].payload_bytes == 0 and found[3].payload_bytes == 120 and found[0].payload_digest == found[1].payload_digest


def test_op9_sections_add_up(spark, folder):
    found = QUERIES["op9_tokencount"](spark, folder)
    assert found.where(F.aggregate("section_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x) != F.col("n_tokens")).count() == 0
