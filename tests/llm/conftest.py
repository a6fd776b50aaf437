import random

import pytest

SYLLABLES = "ka lo mi ne ru sa to vi wen dor al ep".split()


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with exact and near copies, shared passages, and the odd cases: null, empty, very long, no words."""
    rng = random.Random(5)
    shared = prose(rng, 80)
    out = [prose(rng, rng.randint(1, 120)) for _ in range(60)]
    out += [out[3], out[3], out[5] + " extra", out[7].upper(), shared + " " + prose(rng, 20), prose(rng, 15) + " " + shared, prose(rng, 5) + " " + shared[40:300] + " " + prose(rng, 9)]
    long = prose(rng, 20_000)
    out += [long, long[:3000], None, None, "", "   \n\t ", "!!! ??? ---", "ÀÉ été 日本語 ünï " * 12, "x" * 5000, "a", "ab" * 400]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][i % 3], ["a", "b", None, "c"][i % 4], i) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "a", 0), (None, texts[10], "de", None, 0), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    # columns whose names operators use inside or return
    from pyspark.sql import functions as F

    return frame.withColumns({c: F.lit(1) for c in ("score", "fp", "component_id", "size", "taken", "shard", "slot", "spans", "bucket", "kind", "rank", "label", "overlap")}).repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
