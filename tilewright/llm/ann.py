"""Nearest neighbours by additive quantisation.

Codebooks hold full-dimensional vectors; a vector is coded as the sum of one entry of each, found by beam search over the
residuals, and stored with the norm of that sum and of what it leaves. A query's inner products with all entries make a
lookup table, so the score of a coded row is a few table reads over its norm; the best rows of every block of rows are then
scored exactly on the original vectors. A row's cosine is at most its table reads and the norm of what its code leaves: every
row for which that reaches the k-th best exact score is scored exactly too, so the result is that of scoring all rows.

The codebooks are fitted on a sample of at most SAMPLE rows (those with the smallest hash of their id); every row is
coded and searched. Queries go over all rows in blocks of about QUERY_BLOCK, each with its own written result, so
neither the driver nor a broadcast holds more than one block.

Defined cases: vectors that are null, zero, of another length than most of the sample or that hold null or non-finite
components take no part, nor do rows with a null id; ties go to the smaller id; rows that repeat an id are candidates of
all others but not of each other, and as a query such an id has its smallest vector; with fewer candidates than asked,
all are returned; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tilewright.llm.common import scratch, staged

SAMPLE, BOOKS, ENTRIES, BEAM, TURNS = 8192, 8, 256, 4, 6
#: Rows of a block, rows of it that are scored exactly for each query first, queries of a pass and of one lookup table.
ROW_BLOCK, SHORTLIST, QUERY_BLOCK, TABLE_QUERIES = 8192, 64, 4096, 256
#: What rounding may add to a score of single precision and to one of double precision.
SINGLE, DOUBLE = 1e-4, 1e-9


@dataclass
class Model:
    """books: BOOKS x ENTRIES x dimension."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, the norms of the decoded vectors and of what these leave, for rows of unit length."""
        n, dim = x.shape
        rest, codes = x[:, None, :].astype(np.float32), np.zeros((n, 1, 0), np.uint8)
        for book in self.books:
            k = len(book)
            error = (rest * rest).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(1)
            error = error.reshape(n, -1)
            width = min(beam, error.shape[1])
            best = np.argpartition(error, width - 1, axis=1)[:, :width]
            from_, entry = best // k, best % k
            rest = np.take_along_axis(rest, from_[:, :, None], 1) - book[entry]
            codes = np.concatenate([np.take_along_axis(codes, from_[:, :, None], 1), entry[:, :, None].astype(np.uint8)], 2)
        pick = (rest * rest).sum(2).argmin(1)
        codes = codes[np.arange(n), pick]
        left = rest[np.arange(n), pick]
        decoded = x - left
        return codes, np.maximum(np.sqrt((decoded * decoded).sum(1)), 1e-12).astype(np.float32), np.sqrt((left * left).sum(1)).astype(np.float32)


def fit(x: np.ndarray, books: int = BOOKS, entries: int = ENTRIES, turns: int = TURNS, seed: int = 7) -> Model:
    """Codebooks by k-means over the residuals that the books before leave."""
    rng, rest, found = np.random.default_rng(seed), x.astype(np.float32).copy(), []
    k = max(1, min(entries, len(x)))
    for _ in range(books):
        centres = rest[rng.permutation(len(rest))[:k]].copy()
        for _ in range(turns):
            near = ((centres * centres).sum(1) - 2 * rest @ centres.T).argmin(1)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, rest)
            size = np.bincount(near, minlength=k)
            centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        found.append(centres)
        rest = rest - centres[((centres * centres).sum(1) - 2 * rest @ centres.T).argmin(1)]
    return Model(np.stack(found) if found else np.zeros((0, 1, x.shape[1]), np.float32))


def taking_part(vector: Column) -> Column:
    doubles = vector.cast("array<double>")
    odd = F.exists(doubles, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd & F.exists(doubles, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = _scaled(x)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two, which changes no cosine's digits but keeps squares finite and above zero."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def vectors_of(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, int]:
    """vec_id and x of the rows that take part, and their dimension."""
    rows = table.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).where(F.col("vec_id").isNotNull() & taking_part(F.col("x")))
    dims = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = dims.n if dims else 0
    return rows.where(F.size("x") == dim), dim


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of at most ROW_BLOCK rows, however many the session puts in a batch."""
    for b in batches:
        for a in range(0, b.num_rows, ROW_BLOCK):
            yield b.slice(a, ROW_BLOCK)


def index(rows: DataFrame, sample: int = SAMPLE, **how) -> tuple[DataFrame, Model]:
    """Every row with codes, norm and error, written to the shared folder; the model it was coded with."""
    held = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "x").limit(sample).collect()
    model = fit(_unit(np.array([r.x for r in held], np.float64)), **how)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches):
            codes, norms, errors = shared.value.encode(_unit(_matrix(b.column(1))))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms), pa.array(errors)], names=["vec_id", "x", "codes", "norm", "error"])

    return staged(rows.mapInArrow(code, "vec_id bigint, x array<double>, codes binary, norm float, error float"), "ann-index"), model


def _nearest(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, norms: np.ndarray, errors: np.ndarray, q_ids: np.ndarray, q: np.ndarray, model: Model, k: int, shortlist: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one block of rows (by vec_id), each query's k best: query ids, ids, exact cosines."""
    x, q = _scaled(x), _scaled(q)
    length = np.sqrt((x * x).sum(1))
    q_length = np.sqrt((q * q).sum(1))
    units = _unit(x)
    for a in range(0, len(q), TABLE_QUERIES):
        part = _unit(q[a : a + TABLE_QUERIES])
        tables = np.einsum("qd,med->mqe", part.astype(np.float32), model.books, optimize=True)
        scores = np.zeros((len(part), len(ids)), np.float32)
        for m in range(len(tables)):
            scores += np.take(tables[m], codes[:, m], axis=1)
        own = ids == q_ids[a : a + TABLE_QUERIES, None]
        reach = np.where(own, -np.inf, scores + errors + np.float32(SINGLE))
        scores = np.where(own, -np.inf, scores / norms)
        for i in range(len(part)):
            first = np.argpartition(scores[i], len(ids) - shortlist)[len(ids) - shortlist :] if len(ids) > shortlist else np.arange(len(ids))
            sure = units[first[~own[i, first]]] @ part[i]
            if len(sure) >= k:
                reach[i, reach[i] < np.partition(sure, len(sure) - k)[len(sure) - k]] = -np.inf
        reaching = reach > -np.inf
        rows = np.flatnonzero(reaching.any(0))  # one product for all that some query asks for
        close = np.where(reaching[:, rows], part @ units[rows].T, -np.inf)
        for i in range(len(part)):
            s = close[i]
            least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
            near = rows[(s > -np.inf) & (s >= least - DOUBLE)]
            exact = (x[near] * q[a + i]).sum(1) / (length[near] * q_length[a + i])
            best = np.lexsort((ids[near], -exact))[:k]
            yield np.full(len(best), q_ids[a + i]), ids[near][best], exact[best]


def search(coded: DataFrame, model: Model, queries: DataFrame, k: int = 5, shortlist: int = SHORTLIST) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, x) its k nearest of the coded rows by cosine."""
    spark = coded.sparkSession
    queries = staged(queries.groupBy("vec_id").agg(F.min("x").alias("x")), "ann-queries")
    passes = max(1, -(-queries.count() // QUERY_BLOCK))
    folder = scratch(spark, "ann-found")
    for turn in range(passes):
        held = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == turn).orderBy("vec_id").collect()
        shared = spark.sparkContext.broadcast((np.array([r.vec_id for r in held], np.int64), np.array([r.x for r in held], np.float64).reshape(len(held), -1), model))

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q_ids, q, model = shared.value
            for b in _blocks(batches if len(q) else ()):
                order = np.argsort(b.column(0).to_numpy(), kind="stable")
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                hits = list(_nearest(b.column(0).to_numpy()[order], _matrix(b.column(1))[order], codes[order], b.column(3).to_numpy()[order], b.column(4).to_numpy()[order], q_ids, q, model, k, shortlist))
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*hits, strict=True)], names=["query_id", "vec_id", "score"])

        hits = coded.mapInArrow(found, "query_id bigint, vec_id bigint, score double")
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
        shared.unpersist()
    return spark.read.schema("query_id bigint, rank int, vec_id bigint, score double").parquet(folder)


def nearest(table: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k nearest rows of each row of table for which is_query (on vec_id) holds."""
    rows, _ = vectors_of(table, vec_id, embedding)
    if rows.isEmpty():
        return table.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    coded, model = index(rows)
    return search(coded, model, coded.where(is_query).select("vec_id", "x"), k)
