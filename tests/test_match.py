"""k-NN joins by blocks, short neighbour lists and ordered folds over several batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import match, telemetry


@pytest.mark.parametrize("block", [4096, 5])
def test_knn_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(match, "QUERY_BLOCK", block)
    rng = np.random.default_rng(4)
    train, queries = rng.normal(size=(200, 6)), rng.normal(size=(30, 6))
    train[50:90] = train[3]  # ties
    queries[0] = train[3]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(train)] + [(900, None)], "desc_id bigint, desc array<double>").repartition(3)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)] + [(901, None)], "query_idx bigint, desc array<double>")
    found = {(r.query_idx, r["rank"]): (r.desc_id, r.dist) for r in match.knn(q, t).collect()}
    assert len(found) == 60
    for i, v in enumerate(queries):
        d = np.sqrt(((train - v) ** 2).sum(1))
        best = np.lexsort((np.arange(200), d))[:2]
        assert [found[i, k][0] for k in (1, 2)] == best.tolist() and [found[i, k][1] for k in (1, 2)] == pytest.approx(d[best].tolist())
    assert match.knn(q.where("false"), t).count() == 0 and match.knn(q, t.where("false")).count() == 0


def test_short_neighbour_lists_drop_out(spark):
    rows = spark.createDataFrame([(1, 7, 0.1, 1), (2, 8, 0.1, 1), (2, 9, 0.2, 2), (3, 5, 0.31, 1), (3, 6, 0.4, 2)], "query_idx bigint, desc_id bigint, dist double, rank int")
    assert [r.query_idx for r in match.ratio_matches(rows, ["query_idx"]).collect()] == [2]  # 0.31 is not below 0.75 * 0.4


def test_folds_carry_their_state_over_batches(spark):
    rows = spark.range(3000).select((F.col("id") % 2).alias("flight"), F.col("id").alias("msg"), F.timestamp_seconds(F.col("id") * 7 % 2999).alias("ts"))
    whole = sorted(tuple(r) for r in telemetry.throttle(rows, 100).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        assert sorted(tuple(r) for r in telemetry.throttle(rows, 100).collect()) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for flight in (0, 1):
        shots = sorted(r[2].timestamp() for r in whole if r[0] == flight and r[3])
        assert len(shots) > 10 and all(b - a >= 100 for a, b in zip(shots, shots[1:]))  # noqa: B905
