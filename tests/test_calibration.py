import numpy as np
import pytest

from faceoff.operators import calibration, models


def plain_isotonic(x, y):
    """Knots of the fit: the largest over starts of the smallest over ends of the mean between them."""
    order = np.argsort(x, kind="stable")
    values = np.unique(x)
    s = np.array([y[x == v].sum() for v in values])
    n = np.array([(x == v).sum() for v in values])
    cs, cn = np.concatenate([[0], np.cumsum(s)]), np.concatenate([[0], np.cumsum(n)])
    fit = [max(min((cs[j + 1] - cs[i]) / (cn[j + 1] - cn[i]) for j in range(k, len(values))) for i in range(k + 1)) for k in range(len(values))]
    assert len(order)
    return values, np.array(fit)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    out = []
    for g, n, bend in (("a", 120, 2.0), ("b", 90, 0.5), ("c", 40, 1.0), ("hot", 60, 0.2)):
        p = np.round(rng.random(n), 3) if g != "hot" else rng.choice([0.2, 0.5, 0.9], n)
        out += [(g, float(v), float(rng.random() < v**bend)) for v in p]
    return out


@pytest.mark.parametrize("chunks", [2, 7, 64])
def test_isotonic_equals_plain_fits_of_all_groups(spark, rows, chunks):
    train = spark.createDataFrame(rows, "g string, p double, label double").repartition(4)
    asked = [(g, v / 40, i) for i, (g, v) in enumerate((g, v) for g in ("a", "b", "c", "hot", "unseen", None) for v in range(41))]
    test = spark.createDataFrame(asked, "g string, p double, id int")
    got = {r["id"]: r["p_cal"] for r in calibration.isotonic(train, test, "g", chunks=chunks).collect()}
    assert len(got) == len(asked)
    for g in ("a", "b", "c", "hot"):
        x, y = (np.array([r[i] for r in rows if r[0] == g]) for i in (1, 2))
        knots = plain_isotonic(x, y)
        for key, p, i in asked:
            if key == g:
                assert got[i] == pytest.approx(np.interp(p, *knots))
    assert all(got[i] is None for g, _, i in asked if g not in ("a", "b", "c", "hot"))


def test_platt_has_no_gradient_in_any_group(spark, rows):
    curves = calibration.platt_curves(spark.createDataFrame(rows, "g string, p double, label double"), "g").collect()
    assert len(curves) == 4
    for r in curves:
        p, y = (np.array([v[i] for v in rows if v[0] == r["group"]]) for i in (1, 2))
        p = np.clip(p, 1e-6, 1 - 1e-6)
        x = np.log(p / (1 - p))
        q = 1 / (1 + np.exp(-(r["slope"] * x + r["offset"])))
        assert abs(((y - q) * x).sum() - r["slope"]) < 1e-4 and abs((y - q).sum()) < 1e-4


def test_more_groups_than_a_driver_loop_would_take(spark):
    train = spark.range(3000 * 4).selectExpr("cast(id % 3000 as string) g", "0.2 + 0.2 * (id div 3000) p", "cast((id div 3000) % 2 as double) label")
    for method in ("platt", "isotonic"):
        out, decisions = models.calibrate_per_group(train, train, method, group="g", min_rows=4)
        assert out.where("p_cal is not null").count() == 12_000 and decisions.where("skipped is null").count() == 3000
