"""Projected nearest neighbours against brute force."""

import numpy as np
import pytest

from sightline.llm import projected_knn as N


def test_chi_square_quantile():
    assert N.chi_square_quantile(0.95, 8) == pytest.approx(15.507, abs=0.01)
    assert N.chi_square_quantile(0.5, 2) == pytest.approx(1.386, abs=0.01)


def check(spark, vectors, k, least=0.95):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v], "x", 1.0) for i, v in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string, score double")
    got = {}
    for r in N.nearest(df, df["vec_id"] % 10 == 0, k).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    hit = total = 0
    for q, x in [g for g in good if g[0] is not None and g[0] % 10 == 0]:
        want = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:k]
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & {i for _, i in want})
        total += len(want)
    assert set(got) <= {q for q, _ in good}
    assert not total or hit >= least * total


@pytest.mark.parametrize("cell", [8192, 60])
def test_recall(spark, monkeypatch, cell):
    monkeypatch.setattr(N, "CELL", cell)
    monkeypatch.setattr(N, "QUERIES", 16)
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 16))
    rows = list(enumerate(v)) + [(600 + i, v[0]) for i in range(200)] + [(2000, None), (2010, [0.0] * 16), (2020, [float("nan")] * 16), (2030, [None] * 16), (2040, [float("inf")] * 16)]
    check(spark, rows, 10)


def test_widths_and_repeated_queries(spark):
    """Vectors of another width are no candidates; one id with two vectors asks with both and counts once for others."""
    rows = [(i, [float(i), 1.0]) for i in range(1, 40)] + [(100 + i, [float(i), 1.0, 2.0]) for i in range(1, 5)] + [(0, [5.2, 1.0]), (0, [30.3, 1.0]), (100, [1.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = N.nearest(df, df["vec_id"] % 100 == 0, 3, confidence=1 - 1e-9).collect()
    by = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in got)
    assert [x[2:] for x in by if x[0] == 100] == [(101, 0.0), (102, 1.0), (103, 2.0)]
    assert sorted(x[1] for x in by if x[0] == 0) == [1, 1, 2, 2, 3, 3] and {x[2] for x in by if x[0] == 0} == {4, 5, 6, 29, 30, 31}


def test_a_large_cell_is_searched_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 50)
    monkeypatch.setattr(N, "QUERIES", 8)
    monkeypatch.setattr(N, "SAMPLE", 40)
    rng = np.random.default_rng(5)
    check(spark, list(enumerate(rng.normal(size=(900, 6)))), 10)


def test_small_tables(spark):
    check(spark, [], 5)
    check(spark, [(0, None), (10, [0.0, 0.0])], 5)
    check(spark, [(0, [1.0, 2.0])], 5)
    check(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (10, [3.0, 4.0])], 5)


@pytest.mark.parametrize("cell", [8192, 60])
def test_repeated_rows(spark, monkeypatch, cell):
    """A row 20 times beside other ids with its vector, and a query's id with many other vectors, are against brute force over distinct rows."""
    monkeypatch.setattr(N, "CELL", cell)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(200, 4)).round(3)
    rows = [(i + 1, x) for i, x in enumerate(v)]
    rows += [(0, v[0])] * 20 + [(300 + i, v[0]) for i in range(15)] + [(50, v[49] + 1e-3 * i) for i in range(30)] + [(60, v[49]), (60, v[70])]
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in rows], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], round(r["score"], 9), r["vec_id"]) for r in N.nearest(df, df["vec_id"] % 10 == 0, 10, confidence=1 - 1e-9).collect())
    distinct = sorted({(i, tuple(map(float, x))) for i, x in rows})
    want = []
    for q, x in [d for d in distinct if d[0] % 10 == 0]:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for i, y in distinct if i != q)[:10]
        want += [(q, k + 1, round(s, 9), i) for k, (s, i) in enumerate(near)]
    assert got == sorted(want)
