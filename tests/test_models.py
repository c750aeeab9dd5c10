"""Federated ridge models and relations against numpy on the raw rows."""

from itertools import combinations

import numpy as np
import pytest

from duskveil.operators import federated, relations

# Golden values: with one row per group the intercept is the target, all slopes are 0.
ROOMS = [(30, 18856.25, 296.0), (62, 33643.5, 244.0), (76, 27955.0, 489.0), (28, 37909.75, 245.0)]


def test_one_row_groups(spark):
    df = spark.createDataFrame(ROOMS, "age int, bill double, room double")
    models, average = federated.fit_average(df, "bill", "room", ["bill"])
    found = {r.client: (r.intercept, dict(r.coefficients)) for r in models.collect()}
    order = sorted(ROOMS, key=lambda r: r[1])
    assert found == {i + 1: (r[2], {"age": 0.0, "bill": 0.0}) for i, r in enumerate(order)}
    assert average.first().intercept == np.mean([r[2] for r in ROOMS])


def ridge(x, y):
    """Slopes and intercept on standardised features, penalty 1."""
    scale = np.where(x.std(0) > 0, x.std(0), 1)
    z = (x - x.mean(0)) / scale
    slope = np.linalg.solve(z.T @ z + np.eye(x.shape[1]), z.T @ (y - y.mean())) / scale
    return slope, y.mean() - slope @ x.mean(0)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(2)
    g = rng.integers(0, 5, 200)
    x1 = rng.normal(1e6, 3, 200)
    x2 = 2 * x1 + rng.normal(0, 0.5, 200)
    y = x1 - 3 * x2 + g + rng.normal(0, 1, 200)
    return g, x1, x2, np.full(200, 4.0), y


def test_fit_equals_direct_solution(spark, data):
    g, x1, x2, flat, y = data
    gone = np.arange(200) % 17 == 0
    rows = [(int(a), None if m else float(b), float(c), float(d), float(e), i)
            for i, (a, b, c, d, e, m) in enumerate(zip(g, x1, x2, flat, y, gone))]
    df = spark.createDataFrame(rows, "g int, x1 double, x2 double, flat double, y double, i int")
    client, names = federated.client_rows(df, "g", "y", ["i"], 3)
    models = federated.fit_clients(client, names, "y").collect()
    order = list(dict.fromkeys(g))[:3]
    assert names == ["g", "x1", "x2", "flat", "i"]
    for model in models:
        mine = g == order[model.client - 1]
        one = np.where(gone, np.nan, x1)[mine]
        one = np.where(np.isnan(one), np.nanmean(one), one)
        x = np.column_stack([g[mine], one, x2[mine], flat[mine], np.arange(200)[mine]]).astype(float)
        slope, intercept = ridge(x, y[mine])
        got = [model.coefficients[n] for n in names]
        assert np.allclose(got, slope, rtol=1e-6, atol=1e-9)
        assert model.intercept == pytest.approx(intercept, rel=1e-6)


def test_average_matrix_and_prediction(spark):
    rows = [(1, 10.0, {"a": 1.0, "b": 4.0}), (2, 20.0, {"a": 3.0})]
    models = spark.createDataFrame(rows, "client int, intercept double, coefficients map<string,double>")
    average = federated.average_models(models)
    assert average.first().intercept == 15 and average.first().coefficients == {"a": 2.0, "b": 4.0}
    matrix = {r.feature: (r.client_1, r.client_2) for r in federated.coefficient_matrix(models, 2).collect()}
    assert matrix == {"a": (1.0, 3.0), "b": (4.0, None)}
    df = spark.createDataFrame([(1.0, 1.0, 0.0), (2.0, None, 0.0)], "a double, b double, y double")
    assert [r.y for r in federated.apply_model(df, average, "y").orderBy("a").collect()] == [21.0, None]
    assert [r.y for r in federated.apply_model(df.drop("b"), average, "y").orderBy("a").collect()] == [17.0, 19.0]
    other = spark.createDataFrame([(1.0,)], "z double")
    assert federated.apply_model(other, average, "z") is other
    with pytest.raises(ValueError):
        federated.apply_model(df, federated.average_models(models.limit(0)), "y")


def test_regression_modes(spark):
    rows = [(i, i % 3, f"2020-0{i % 6 + 1}-11", float(i), "t") for i in range(12)]
    df = spark.createDataFrame(rows, "i int, g int, d string, y double, s string")
    numeric = federated.federated_regression(df, "numeric", "g", "y", ["i"])
    assert numeric.columns == ["i", "g", "y"]
    dated = federated.federated_regression(df, "date", "g", "y", ["i"])
    assert dated.columns == ["i", "g", "y", "s", "d_year", "d_month", "d_day"]
    with pytest.raises(ValueError):
        federated.federated_regression(df, "other", "g", "y", ["i"])
    with pytest.raises(ValueError):
        federated.federated_regression(df, "numeric", "s", "y", ["i"])


@pytest.fixture(scope="module")
def gapped():
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (150, 5))
    x[:, 1] += x[:, 0]
    x[:, 2] = 1e7 + x[:, 0] * 2 - x[:, 3]
    x[:, 4] = 900.1
    x[rng.random((150, 5)) < 0.08] = np.nan
    x[:, 4] = 900.1
    return x


NAMES = ["a", "b", "c", "d", "flat"]


def frame(spark, x):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in NAMES[: x.shape[1]]))


def r2(x, y):
    """Least squares on standardised columns; c = 2a - d holds up to the rounding
    of c, and a direction that small (1e-5 of the widest) is no predictor."""
    z = x - x.mean(0)
    z = z / np.where(z.std(0) > 1e-9, z.std(0), 1)
    centred = y - y.mean()
    rest = centred - z @ np.linalg.lstsq(z, centred, rcond=1e-5)[0]
    return 1 - (rest @ rest) / (centred @ centred)


def test_correlations_are_pairwise_complete(spark, gapped):
    got = {(r.column_a, r.column_b): r.corr for r in relations.correlation_matrix(frame(spark, gapped)).collect()}
    assert len(got) == 25
    for i, a in enumerate(NAMES):
        for j, b in enumerate(NAMES):
            both = ~np.isnan(gapped[:, i]) & ~np.isnan(gapped[:, j])
            want = 0.0 if "flat" in (a, b) else np.corrcoef(gapped[both, i], gapped[both, j])[0, 1]
            assert got[a, b] == pytest.approx(want, abs=1e-9)


def test_moments_by_present_columns(spark, gapped):
    df = frame(spark, gapped).repartition(5)
    found = {tuple(r.present): r for r in relations.moments(df, NAMES).collect()}
    apart = np.nan_to_num(gapped - np.nanmean(gapped, axis=0))
    patterns = [tuple(np.flatnonzero(~np.isnan(row))) for row in gapped]
    assert set(found) == set(patterns) and len(found) > 3
    for pattern, r in found.items():
        own = apart[[i for i, p in enumerate(patterns) if p == pattern]]
        assert r.n == len(own)
        assert np.allclose(r.sums, own.sum(axis=0), atol=1e-9)
        assert np.allclose(np.array(r.products).reshape(5, 5), own.T @ own, atol=1e-9)


def test_search_uses_complete_rows_per_model(spark, gapped):
    x = gapped[:, :4]
    found = relations.search_relationships(frame(spark, x), predictors=3).collect()
    got = {(r.target, r.predictors): r.value for r in found}
    assert len(got) == 4 * (3 + 3 + 1)
    for t in range(4):
        others = [i for i in range(4) if i != t]
        for size in (2, 3):
            for combo in combinations(others, size):
                use = ~np.isnan(x[:, [t, *combo]]).any(axis=1)
                want = r2(x[use][:, combo], x[use][:, t])
                assert got[NAMES[t], ", ".join(NAMES[i] for i in combo)] == pytest.approx(want, abs=1e-8)
    values = [abs(r.value) for r in found]
    assert values == sorted(values, reverse=True)


def test_r2_on_all_others(spark, gapped):
    assert relations.r2_on_all_others(frame(spark, gapped)).count() == 0
    full = gapped[~np.isnan(gapped).any(axis=1)]
    got = {r.target: r.r2 for r in relations.r2_on_all_others(frame(spark, full)).collect()}
    for t, name in enumerate(NAMES):
        others = [i for i in range(5) if i != t]
        want = 1.0 if name == "flat" else r2(full[:, others], full[:, t])
        assert got[name] == pytest.approx(want, abs=6e-5)
    single = relations.r2_on_all_others(frame(spark, full[:, :1]))
    assert single.count() == 0


def test_top_relationships_skip_models_with_gaps(spark, gapped):
    top = relations.top_relationships(frame(spark, gapped)).collect()
    assert len(top) == 10 and {r.metric for r in top} == {"corr"}
    full = gapped[~np.isnan(gapped).any(axis=1)]
    best = relations.top_relationships(frame(spark, full)).collect()
    assert (best[0].metric, best[0].target, best[0].predictors, best[0].value) == ("R2", "a", "c, d", 1.0)


def test_analyse_bundles(spark, data):
    g, x1, x2, _, y = data
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(g, x1, y)]
    found = relations.analyse(spark.createDataFrame(rows, "g int, x double, y double"), "g", "y", ["x"])
    assert found.predictions.count() == 200 and found.correlations.count() == 9
    assert found.r2.count() == 3 and found.top.count() == 9


def test_best_relationships_equal_the_full_search(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(400, 12))
    base[:, 3] += 2 * base[:, 0] - base[:, 7]
    base[:, 5] += base[:, 3] + 0.5 * base[:, 9]
    base[:, 11] = base[:, 2]  # equal columns: ties
    names = [f"x{i:02d}" for i in range(12)]
    df = spark.createDataFrame([tuple(map(float, row)) for row in base], ", ".join(f"{n} double" for n in names))
    found = relations.best_relationships(df, names, predictors=3, rows=3).collect()
    every = relations.search_relationships(df, names, predictors=3).collect()
    for target in names:
        for size in (1, 2, 3):
            of = lambda rows: [
                r for r in rows if r.target == target and r.predictors.count(",") == size - 1
            ]
            got, want = of(found), sorted((abs(r.value) for r in of(every)), reverse=True)[:3]
            assert [abs(r.value) for r in got] == pytest.approx(want, abs=1e-8)
    values = {(r.target, r.predictors): r.value for r in every}
    assert all(values[r.target, r.predictors] == pytest.approx(r.value, abs=1e-8) for r in found)
    with pytest.raises(ValueError, match="best_relationships"):
        relations.search_relationships(df, names, predictors=3, most_models=100)
    with pytest.raises(ValueError):
        relations.best_relationships(df, names, most_columns=11)
    assert relations.best_relationships(df.limit(0), names).count() == 0


def test_best_relationships_leave_out_branches():
    rng = np.random.default_rng(12)
    base = rng.normal(size=(300, 12))
    base[:, 0] += base[:, 3:6].sum(axis=1)
    corr = np.corrcoef(base.T)
    lattice, solved = relations._Lattice(corr), 0
    inner = lattice.r2

    def counted(*args):
        nonlocal solved
        solved += 1
        return inner(*args)

    lattice.r2 = counted
    floor, nodes = lattice.floor(0, 3, 1), [[]]
    for _ in range(3):
        nodes = [own for chosen in nodes for own, _ in lattice.grown(0, chosen, 3, floor)]
    assert [sorted(lattice.order[0][s] for s in n) for n in nodes] == [[3, 4, 5]]
    assert solved < 165 / 2  # models of three among eleven


def test_many_gaps_are_summed_by_sets(spark, gapped, monkeypatch):
    x = gapped[:, :4]
    once = {tuple(r)[:3]: r.value for r in relations.search_relationships(frame(spark, x)).collect()}
    monkeypatch.setattr(relations, "PATTERNS", 0)
    again = {tuple(r)[:3]: r.value for r in relations.search_relationships(frame(spark, x).repartition(5)).collect()}
    assert set(once) == set(again)
    assert all(again[k] == pytest.approx(v, abs=1e-9) for k, v in once.items())
