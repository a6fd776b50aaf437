"""Language identification by rank-order profiles.

A profile is the ranking of the most frequent character n-grams (1 to 3, of words in lower case between blanks). A text
gets the language whose profile is least out of place: for each of the text's most frequent n-grams the difference of its
ranks in text and profile, or the largest possible one if the profile lacks it. Ties in frequency go by code point, ties
in distance by language.

Profiles are counted over at most DOCS_EACH different texts of each language (those with the smallest hash). A word's n-grams are
kept in a bounded table of the worker, as words repeat.

Defined cases: texts that are null or have no letter are `und` with score 0, as all are if nothing was learned; rows with
a null language teach nothing; repeated texts teach once; long texts count whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import text_batches

DOCS_EACH, PROFILE, TEXT_PROFILE, MOST_LANGUAGES = 2000, 400, 300, 4096
WORD = re.compile(r"[^\W\d_]+")
CACHED_WORDS, CACHED_GRAMS = 200_000, 1 << 16


class Grams:
    """Counts n-grams of texts; an n-gram is its code points packed into 21 bits each, so keys sort by code point."""

    def __init__(self) -> None:
        self.words: dict[str, np.ndarray] = {}
        self.ids: dict[int, int] = {}
        self.keys = np.zeros(0, np.int64)

    def _of_word(self, word: str) -> np.ndarray:
        if not any(map(str.isalpha, word)):
            return np.zeros(0, np.int64)
        c = [ord(x) for x in f" {word} "]
        packed = [a << 42 for a in c[1:-1]] + [a << 42 | b << 21 for a, b in zip(c, c[1:])] + [a << 42 | b << 21 | d for a, b, d in zip(c, c[1:], c[2:])]  # noqa: B905
        return np.array([self.ids.setdefault(k, len(self.ids)) for k in packed], np.int64)

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of a text's n-grams."""
        if len(self.words) > CACHED_WORDS or len(self.ids) > CACHED_GRAMS:
            self.__init__()
        words = Counter(WORD.findall(text.lower()))
        rows, times, cache = [], [], self.words
        for word, n in words.items():
            row = cache.get(word)
            if row is None:
                row = cache[word] = self._of_word(word)
            rows.append(row)
            times.append(n)
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(self.keys) != len(self.ids):
            self.keys = np.fromiter(self.ids, np.int64, len(self.ids))
        counts = np.bincount(np.concatenate(rows), np.repeat(times, [len(r) for r in rows]))
        there = np.flatnonzero(counts)
        return self.keys[there], counts[there].astype(np.int64)

    def ranked(self, text: str, most: int) -> np.ndarray:
        """The most frequent n-grams, in order."""
        keys, counts = self.count(text)
        if len(counts) > most:
            kept = counts >= np.partition(counts, len(counts) - most)[len(counts) - most]
            keys, counts = keys[kept], counts[kept]
        return keys[np.lexsort((keys, -counts))][:most]


class Profiles:
    """All languages' rankings, as sorted keys with a rank for each language."""

    def __init__(self, ranked: dict[str, list[int]], most: int = PROFILE):
        self.languages = sorted(ranked)
        self.most = most
        self.keys = np.array(sorted({k for keys in ranked.values() for k in keys}), np.int64)
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int64)
        for j, language in enumerate(self.languages):
            self.ranks[np.searchsorted(self.keys, np.array(ranked[language], np.int64)), j] = np.arange(len(ranked[language]))

    def distances(self, grams: np.ndarray) -> np.ndarray:
        """The out-of-place distance to each language."""
        at = np.searchsorted(self.keys, grams)
        known = np.append(self.keys, -1)[at] == grams
        ranks = self.ranks[np.where(known, at, len(self.keys))]
        return np.where(ranks < 0, self.most, np.minimum(np.abs(ranks - np.arange(len(grams))[:, None]), self.most)).sum(0)

    def identify(self, grams: np.ndarray) -> tuple[str, float]:
        if not len(grams) or not self.languages:
            return "und", 0.0
        d = self.distances(grams)
        best = int(d.argmin())
        return self.languages[best], float(1 - d[best] / (self.most * len(grams)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial n-gram counts of (lang, text) batches."""
    grams = Grams()
    for b in batches:
        sums: dict[str, Counter] = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            keys, counts = grams.count(text)
            have = sums.setdefault(lang, Counter())
            for k, n in zip(keys.tolist(), counts.tolist(), strict=True):
                have[k] += n
        rows = [(lang, k, n) for lang, have in sums.items() for k, n in have.items()]
        yield pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["lang", "gram", "n"])


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", docs_each: int = DOCS_EACH, most: int = PROFILE) -> Profiles:
    """Profiles from labelled rows: at most docs_each texts of each language, `most` n-grams kept of each."""
    text_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    turn = F.row_number().over(W.partitionBy("lang").orderBy("h"))
    limits = rows.select("lang", "h").distinct().withColumn("turn", turn).where(F.col("turn") <= docs_each).groupBy("lang").agg(F.max("h").alias("most"), F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(limits) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not limits:
        return Profiles({}, most)
    bound = docs.sparkSession.createDataFrame([(r.lang, r.most) for r in limits], "lang string, most bigint")
    taught = rows.join(F.broadcast(bound), "lang").where("h <= most").dropDuplicates(["lang", "h"]).select("lang", "text")  # bound: at most MOST_LANGUAGES rows
    counts = taught.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in counts.withColumn("rank", rank).where(F.col("rank") <= most).orderBy("lang", "rank").toLocalIterator():
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranked, most)


def identifier(spark: SparkSession, profiles: Profiles, most: int = TEXT_PROFILE):
    """A column function text -> struct<lang, score>."""
    shared = spark.sparkContext.broadcast(profiles)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("struct<lang:string,score:double>")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        for texts in batches:
            found = [shared.value.identify(grams.ranked(t or "", most)) for t in texts.to_pylist()]
            yield pa.array([{"lang": a, "score": s} for a, s in found], kind)

    text_batches(spark)
    return identified


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> Column:
    return identifier(docs.sparkSession, profiles)(F.col(text))
