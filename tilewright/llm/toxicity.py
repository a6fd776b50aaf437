"""Toxicity by compression distance: how much shorter is a window with a dictionary of toxic text than of ordinary text?

Zstandard dictionaries hold the same base, trained on ordinary text; the toxic ones have segments of toxic text besides, one
dictionary for each tier of evidence. Windows are a text's words, each between the same two pieces of the base (alone they
would be too short to compress); a window's gains are its compressed length with the ordinary dictionary less that with
each toxic one. A text's score comes from how many of its different windows gain so and so many bytes from which tier.

Which segments are toxic is found by the same distance: the labelled texts are cut in two, and a window of the toxic texts
of one half must be shorter with a dictionary of the other half's toxic text than with one of the ordinary text. All that
recur and are commoner in toxic texts than in ordinary ones have a place, however many they are: the evidence (log-likelihood
ratio of both rates) only names the tier, and calibration weighs the tiers. It does so on texts that the dictionaries were
not made from, by FOLDS-fold cross-fitting. Learning takes at most TOXIC_DOCS and ORDINARY_DOCS labelled rows (those with the smallest hash of id) of at
most SAMPLE_BYTES each; whole texts are scored, whatever their length.

Defined cases: null and empty texts have no windows and the score of a text without gains; without labels of both kinds
every text scores 0; repeated labels count as toxic if one of them is; repeated documents are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.llm.common import text_batches, utf8

TOXIC_DOCS, ORDINARY_DOCS, SAMPLE_BYTES = 1500, 4500, 20_000
BASE_BYTES, PAD = 8192, 120
LEAST_GAIN = 2
GAINS = (2, 3, 4, 5)
#: Least evidence of each tier of segments, strongest first; parts of the sample that calibrate in turn.
TIERS, FOLDS = (40.0, 10.0, 0.0), 5
LONGEST_WINDOW, CACHED = 200, 400_000


def _compressor(content: bytes, size_log: int, depth: int) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=4, window_log=size_log, hash_log=size_log, chain_log=size_log, search_log=depth, target_length=64, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


def windows(text: bytes) -> list[bytes]:
    """Words in lower case (ASCII letters); a run without white space is cut into windows of bounded length."""
    found = text.lower().split()
    if len(text) > LONGEST_WINDOW and any(len(w) > LONGEST_WINDOW for w in found):
        found = [w[i : i + LONGEST_WINDOW] for w in found for i in range(0, len(w), LONGEST_WINDOW)]
    return found


class Distance:
    """Gains of windows: what the toxic dictionary saves over the ordinary one."""

    def __init__(self, ordinary: bytes, toxic: bytes, pad: bytes, depth: int = 6):
        self.before, self.after = pad[: len(pad) // 2] + b" ", b" " + pad[len(pad) // 2 :]
        size_log = max(15, (max(len(ordinary), len(toxic)) + 1024).bit_length())
        self.ordinary, self.toxic = _compressor(ordinary, size_log, depth), _compressor(toxic, size_log, depth)

    def gain(self, window: bytes) -> int:
        data = self.before + window + self.after
        return len(self.ordinary.compress(data)) - len(self.toxic.compress(data))


@dataclass
class Model:
    """What one broadcast holds: the base, the toxic segments of each tier, and the calibration (weights of counts, then the offset)."""

    base: bytes = b""
    segments: tuple[bytes, ...] = ()
    weights: tuple[float, ...] = ()

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        self.model = model
        self.distances = [(k, Distance(model.base, x + model.base, model.base[-PAD:])) for k, x in enumerate(model.segments) if x]
        self.known: dict[bytes, list[int]] = {}

    def reached(self, window: bytes) -> list[int]:
        """Which counts a window adds to: those of each tier and each of GAINS that it gains at least."""
        if not self.distances:
            return []
        data = self.distances[0][1].before + window + self.distances[0][1].after
        plain = len(self.distances[0][1].ordinary.compress(data))
        gains = [(k, plain - len(d.toxic.compress(data))) for k, d in self.distances]
        return [k * len(GAINS) + j for k, g in gains for j, least in enumerate(GAINS) if g >= least]

    def counts(self, text: bytes) -> list[int]:
        """How many different windows gain at least each of GAINS, tier by tier."""
        if len(self.known) > CACHED:
            self.known = {}
        known, out = self.known, [0] * (len(TIERS) * len(GAINS))
        for w in set(windows(text)):
            at = known.get(w)
            if at is None:
                at = known[w] = self.reached(w)
            for j in at:
                out[j] += 1
        return out

    def score(self, text: bytes) -> float:
        if not self.model.weights:
            return 0.0
        return float(_logistic(_features(np.array([self.counts(text)])), np.array(self.model.weights))[0])


def _features(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log1p(counts), np.ones((len(counts), 1))], 1)


def _logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


def _calibrated(counts: np.ndarray, y: np.ndarray, ridge: float = 0.5, turns: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method."""
    x, w = _features(counts), np.zeros(counts.shape[1] + 1)
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-3
    for _ in range(turns):
        p = _logistic(x, w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _base(texts: list[bytes]) -> bytes:
    """A dictionary trained on ordinary text; their text itself if it is too little to train on."""
    pieces = [t[i : i + 400] for t in texts for i in range(0, len(t), 400)]
    try:
        return zstandard.train_dictionary(BASE_BYTES, pieces).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(texts)[-BASE_BYTES:].rjust(PAD)


def _joined(words: list[bytes]) -> bytes:
    return b" " + b"  ".join(words) + b" "


def _evidence(toxic: int, of_toxic: int, ordinary: int, of_ordinary: int) -> float:
    """The log-likelihood ratio of two rates against one."""

    def log_likelihood(n: int, of: int, rate: float) -> float:
        return (n * log(rate) if n else 0.0) + ((of - n) * log(1 - rate) if of > n else 0.0)

    both = (toxic + ordinary) / (of_toxic + of_ordinary)
    own = log_likelihood(toxic, of_toxic, toxic / of_toxic) + log_likelihood(ordinary, of_ordinary, ordinary / of_ordinary)
    return max(0.0, 2 * (own - log_likelihood(toxic, of_toxic, both) - log_likelihood(ordinary, of_ordinary, both)))


def _segments(base: bytes, toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, ...]:
    """The toxic segments of each tier, in each those of most evidence last."""
    pad = base[-PAD:]
    halves = [toxic[::2], toxic[1::2]] if len(toxic) > 1 else [toxic, toxic]
    in_ordinary = Counter(w for t in ordinary for w in set(windows(t)))
    in_halves = [Counter(w for t in half for w in set(windows(t))) for half in halves]
    times, of_toxic = in_halves[0] + in_halves[1], len(halves[0]) + len(halves[1])
    plain = _joined([w for w, n in sorted(in_ordinary.items(), key=lambda x: (x[1], x[0])) if n * of_toxic >= times[w] * len(ordinary)])
    found = {}
    for own, other in ((0, 1), (1, 0)):
        d = Distance(plain + pad, _joined([w for w, n in sorted(in_halves[other].items(), key=lambda x: (x[1], x[0]))]) + pad, pad, 10)
        for w in in_halves[own]:
            if w not in found and times[w] > 1 and in_ordinary[w] * of_toxic < times[w] * len(ordinary) and d.gain(w) >= LEAST_GAIN:
                found[w] = _evidence(times[w], of_toxic, in_ordinary[w], len(ordinary))
    ranked = sorted(found, key=lambda w: (found[w], w))
    tiers = [[w for w in ranked if least <= found[w] < most] for most, least in zip((float("inf"), *TIERS), TIERS, strict=False)]
    return tuple(_joined(x) if x else b"" for x in tiers)


def fit(labelled: list[tuple[bytes, int]]) -> Model:
    """labelled: texts with 1 (toxic) or 0, in an order that does not depend on them."""
    toxic, ordinary = [t for t, y in labelled if y], [t for t, y in labelled if not y]
    if not toxic or not ordinary:
        return Model()
    base = _base(ordinary[: len(ordinary) // 2 + 1])
    counts, y = [], []
    folds = min(FOLDS, len(toxic), len(ordinary))
    for k in range(folds):
        rest = [[t for i, t in enumerate(x) if i % folds != k or folds == 1] for x in (toxic, ordinary)]
        scorer = Model(base, _segments(base, *rest)).scorer()
        for texts, label in ((toxic[k::folds], 1), (ordinary[k::folds], 0)):
            counts += [scorer.counts(t) for t in texts]
            y += [label] * len(texts)
    weights = _calibrated(np.array(counts, float), np.array(y, float))
    return Model(base, _segments(base, toxic, ordinary), tuple(weights.tolist()))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> list[tuple[bytes, int]]:
    """A bounded sample of labelled texts, brought to the driver."""
    known = labels.where(F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(toxic).cast("int").alias("__toxic"))
    picked = []
    for y, most in ((1, TOXIC_DOCS), (0, ORDINARY_DOCS)):
        picked += known.where(F.col("__toxic") == y).orderBy(F.xxhash64("__id"), "__id").limit(most).collect()
    if not picked:
        return []
    spark = docs.sparkSession
    ids = spark.createDataFrame(picked, T.StructType([T.StructField("__id", docs.schema[doc_id].dataType), T.StructField("__toxic", T.IntegerType())]))
    short = docs.where(F.octet_length(text) <= SAMPLE_BYTES).select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"))
    found = short.join(F.broadcast(ids), "__id").groupBy("__id", "__toxic").agg(F.min("__text").alias("__text"))  # at most TOXIC_DOCS + ORDINARY_DOCS rows
    rows = found.orderBy(F.xxhash64("__id"), "__id").collect()
    return [(r["__text"].encode(), r["__toxic"]) for r in rows]


def learn(docs: DataFrame, labels: DataFrame, **columns) -> Model:
    return fit(sample(docs, labels, **columns))


def scorer(spark: SparkSession, model: Model):
    """A column function text -> score in [0, 1]."""
    shared = spark.sparkContext.broadcast(model)
    text_batches(spark)

    @F.arrow_udf(T.DoubleType())
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value.scorer()
        for texts in batches:
            yield pa.array([own.score(t) for t in utf8(texts)], pa.float64())

    return scored
