"""Whitening and clustering against plain integer arithmetic."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.llm import clustering, exact, queries, whitening


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-(2**62), 2**62), min_size=3, max_size=3), min_size=1, max_size=9))
def test_sums_and_products_of_any_size(rows):
    import pyarrow as pa

    ((dim, _, x),) = exact.matrices(pa.array(rows, pa.list_(pa.int64())))
    assert exact.column_sums(x).tolist() == [sum(c) for c in zip(*rows)]
    shift = [v // 3 for v in rows[0]]
    y = exact.shifted(x, shift)
    want = [[sum((r[a] - shift[a]) * (r[b] - shift[b]) for r in rows) for b in range(dim)] for a in range(dim)]
    assert exact.cross_products(y).tolist() == want
    flat = [v for w in want for v in w]
    batch = exact.digits([np.zeros(9), np.repeat(range(3), 3), np.tile(range(3), 3)], np.array(flat, dtype=object)).to_pylist()
    got = {}
    for r in batch:
        got[r["a"], r["b"]] = got.get((r["a"], r["b"]), 0) + (r["value"] << (exact.DIGIT * r["digit"]))
    assert [got[a, b] for a in range(3) for b in range(3)] == flat


def test_fixed_point_holds_at_a_longs_ends(spark):
    rows = spark.createDataFrame([([0.99, -0.01, 1e300, -1e300],)], "v array<double>")
    got = rows.select(exact.fixed_point("v", 64.0, 10).alias("x")).first().x
    assert got == [63 + 10, -1 + 10, exact.LONG, -exact.LONG + 20]


def odd_vectors(spark):
    rng = np.random.default_rng(3)
    plain = [[float(v) for v in rng.normal(size=64).astype(np.float32)] for _ in range(60)]
    rows = [(k, v, "x") for k, v in enumerate(plain)]
    rows += [(k, plain[0], "copy") for k in range(100, 140)] + [(0, plain[5], None), (None, plain[6], "no id"), (3, plain[3], "x"), (3, plain[3], "x")]
    rows += [(200, None, "x"), (201, [], "x"), (202, [1.0, None] * 32, "x"), (203, [float("nan")] * 64, "x"), (204, [float("inf")] * 64, "x"), (205, plain[1][:7], "short")]
    return rows, spark.createDataFrame([(i, v, c, 1) for i, v, c in rows], "vec_id long, embedding array<float>, cluster string, n int")


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def check_whitening(rows, got, offset=1_000_000, kept=16):
    """``rows``: (id, vector); ``got``: rows of the query."""
    whole = [(i, [math.floor(64 * float(c)) + offset for c in v]) for i, v in rows if usable(v) and len(v)]
    seen = {}
    for r in got:
        seen.setdefault((r.vec_id, r.deviation), []).append(r)
    total = 0
    for dim in {len(x) for _, x in whole}:
        mine = [(i, x) for i, x in whole if len(x) == dim]
        fit = sorted({tuple(x) for _, x in mine})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        far = np.array([[float(Fraction(n * v - t, n)) for v, t in zip(x, s)] for x in fit])
        cov = far.T @ far / n
        values = np.sort(np.linalg.eigvalsh(cov))[::-1][:kept]
        live = values > 1e-9 * values[0] if len(values) else values
        z = {}
        for i, x in mine:
            d = sum((n * v - t) ** 2 for v, t in zip(x, s))
            found = sorted(seen[i, d], key=lambda r: r.component)
            assert {r.component for r in found} == set(range(1, min(kept, dim) + 1)) and all(r.n == n for r in found)
            total += min(kept, dim)
            z[tuple(x)] = [r.whitened for r in found[:: max(1, len(found) // min(kept, dim))]]
            for r in found:
                assert r.identity_error < 1e-4
                if live[r.component - 1]:
                    assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-6)
                else:
                    assert r.whitened is None and r.explained == 0
        if live.all():
            w = np.array([z[x] for x in fit])
            assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() < 1e-6
            # Each component is a linear map of the vectors, along an eigenvector.
            axes = np.linalg.lstsq(far, w, rcond=None)[0] * np.sqrt(values)
            assert np.abs(cov @ axes - axes * values).max() < 1e-6 * values[0]
    assert total == len(got)


def test_op12_by_fractions(spark, small):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{small}/embeddings.parquet").to_pylist()]
    check_whitening(rows, queries.op12_embedding_whitening(spark, small).collect())


def test_op12_odd_rows(spark, tmp_path):
    rows, table = odd_vectors(spark)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    check_whitening([(i, v) for i, v, _ in rows], queries.op12_embedding_whitening(spark, str(tmp_path)).collect())
    table.limit(0).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert queries.op12_embedding_whitening(spark, f"{tmp_path}/none").count() == 0


def test_far_vectors_lose_nothing(spark):
    """Means 2^50 times the spread: cross-products of plain doubles would be noise."""
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, size=(300, 5))
    rows = [(k, [float(2**50 + v) for v in r]) for k, r in enumerate(x.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    (near,), (far,) = (whitening.fit(t, scale=1.0).values() for t in (table.withColumn("embedding", F.transform("embedding", lambda v: v - float(2**50))), table))
    assert near.explained.tolist() == far.explained.tolist() and np.array_equal(near.axes, far.axes) and far.identity_error < 1e-9


def plain_clusters(rows, k=16, rounds=3):
    whole = [(i, [math.floor(64 * float(c)) for c in v]) for i, v in rows if usable(v) and len(v) == 64]
    name = lambda i: (1, "") if i is None else (0, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centres = [x for _, x in sorted(whole, key=lambda r: (name(r[0]), r[1]))[:k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        owner = [near(x)[1] for _, x in whole]
        for n in range(len(centres)):
            mine = [x for (_, x), o in zip(whole, owner) if o == n]
            if mine:
                centres[n] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *near(x)) for i, x in whole]
    inertia = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), text[n]) for i, d, n in found), key=repr)


def test_op13_by_plain_loops(spark, small, tmp_path):
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{small}/embeddings.parquet").to_pylist()]
    assert sorted(map(tuple, queries.op13_centroid_clustering(spark, small).collect()), key=repr) == plain_clusters(rows)
    rows, table = odd_vectors(spark)
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, queries.op13_centroid_clustering(spark, str(tmp_path)).collect()), key=repr) == plain_clusters([(i, v) for i, v, _ in rows])
    few = clustering.cluster(table.where("vec_id < 5"))
    assert few.select("cluster").distinct().count() <= 8 and few.count() == table.where("vec_id < 5").count()
    assert clustering.cluster(table.limit(0)).count() == 0


def test_op13_against_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    want = con.sql(queries.oracle_sql()["op13_centroid_clustering"])
    assert sorted(map(tuple, queries.op13_centroid_clustering(spark, small).select(want.columns).collect())) == sorted(want.fetchall())


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([3, 60, 2**12, 2**24, 2**26, 2**40, 2**61]), st.integers(1, 9))
def test_intervals_hold_and_ties_go_to_the_smaller_number(seed, scale, k):
    rng = np.random.default_rng(seed)
    x, centres = rng.integers(-scale, scale + 1, size=(20, 8)), rng.integers(-scale, scale + 1, size=(k, 8))
    x[:5], centres[-1] = centres[0] + rng.integers(-1, 2, size=(5, 8)), centres[0]
    low, high = clustering.estimates(x, centres)
    for i, row in enumerate(x.tolist()):
        for j, c in enumerate(centres.tolist()):
            true = sum(b * b for b in c) - 2 * sum(a * b for a, b in zip(row, c))
            assert low[i, j] <= true <= high[i, j]
    best, _ = clustering.nearest(x, centres)
    far = [[sum((a - b) ** 2 for a, b in zip(row, c)) for c in centres.tolist()] for row in x.tolist()]
    assert best.tolist() == [f.index(min(f)) for f in far]


def test_screening_settles_nearly_all(small):
    v = np.array(pq.read_table(f"{small}/embeddings.parquet").column("embedding").to_pylist())
    x = np.floor(64 * v).astype(np.int64)
    _, unsure = clustering.nearest(x, x[:16])
    assert unsure < len(x) // 20
