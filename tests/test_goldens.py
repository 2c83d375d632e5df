"""Hand-derived results on the two six-row tables."""

import pytest

from cloakframe import anonymity, utility
from cloakframe.operators.cluster import Clusterer
from cloakframe.operators.generalize import Datafly, NotSatisfiable
from cloakframe.operators.mondrian import Mondrian
from cloakframe.operators.perturb import attained_k, solve_b, solve_p

from .helpers import crime, patient


def value(df):
    return df.first()[0]


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.orderBy("row_id").collect()]


def test_datafly_without_suppression(spark):
    spec = crime(spark)
    got = Datafly(spec, 2).transform()
    assert got.levels == {"marital-status": -1, "age": 1, "zip": 1} and got.suppressed is None
    near, far = ("*", "25~29", "3204*"), ("*", "20~24", "3202*")
    assert rows(got.df, *spec.qids) == [near, far, far, near, near, far]
    q = list(spec.qids)
    assert value(anonymity.k_level(got.df, q)) == 3
    assert value(utility.discernibility(got.df, q)) == 18
    assert value(utility.average_class(got.df, q, 2)) == 1.5
    assert value(utility.discernibility_best(spec.df, 2)) == 12
    assert value(utility.average_class_best(spec.df, 2)) == 1.0
    assert value(utility.ncp_generalization(spec, got.df)) == pytest.approx(13 / 27)


def test_datafly_with_suppression(spark):
    spec = crime(spark)
    got = Datafly(spec, 2, 2).transform()
    assert {r["name"] for r in got.df.collect()} == {"Joe", "Jill", "Abe", "Amy"}
    assert [r["count"] for r in got.suppressed.collect()] == [1, 1]
    assert value(utility.discernibility(got.df, list(spec.qids), 2)) == 20
    assert value(utility.ncp_generalization(spec, got.df)) == pytest.approx(35 / 81)


def test_datafly_cannot_be_satisfied(spark):
    with pytest.raises(NotSatisfiable):
        Datafly(crime(spark), 7).transform()


def test_mondrian_patient(spark):
    spec = patient(spark)
    got = Mondrian(spec, 2).transform()
    assert rows(got.df, "age", "zip") == [("25 ~ 26", "53711 ~ 53712")] * 3 + [("27 ~ 28", "53710 ~ 53712")] * 3
    assert value(utility.ncp_mean_mode(spec, got.groups)) == pytest.approx(0.5416667)
    assert value(utility.ncp_summarization(spec, got.groups)) == pytest.approx(0.5416667)


@pytest.mark.parametrize("local", [20_000, 1])
def test_mondrian_crime(spark, local, monkeypatch):
    monkeypatch.setattr("cloakframe.operators.mondrian.LOCAL", local)
    spec = crime(spark)
    got = Mondrian(spec, 2).transform()
    assert rows(got.groups, "name", "group_id") == [("Joe", 1), ("Jill", 0), ("Sue", 0), ("Abe", 1), ("Bob", 1), ("Amy", 0)]
    assert rows(got.df, *spec.qids)[0] == ("Separated & Widowed", "25 ~ 29", "32042 ~ 32046")
    assert value(utility.ncp_summarization(spec, got.groups)) == pytest.approx(0.437037, abs=1e-6)
    assert value(utility.ncp_mean_mode(spec, got.groups)) == pytest.approx(0.325926, abs=1e-6)


def test_mondrian_other_recoders(spark):
    spec = crime(spark)
    mean = rows(Mondrian(spec, 2, "mean_mode").transform().df, *spec.qids)
    assert mean[0] == ("Separated", pytest.approx(82 / 3), pytest.approx(32044.3333333)) and mean[1] == ("Single", pytest.approx(67 / 3), 32024.0)
    general = rows(Mondrian(spec, 2, "generalization").transform().df, *spec.qids)
    assert general[0] == ("*", "25~29", "3204*") and general[1] == ("*", "20~24", "3202*")


@pytest.mark.parametrize(("method", "groups", "loss"), [("k_member", [{3, 0}, {1, 5}, {4, 2}], 3.5911111), ("oka", [{3, 4}, {5, 2}, {0, 1}], 10.8888889)])
def test_clusterers(spark, method, groups, loss):
    got = Clusterer(crime(spark), 2, method, seed=0).assign().collect()
    assert [{r["key"] for r in got if r["group_id"] == g} for g in range(3)] == groups
    assert got[0]["information_loss"] == pytest.approx(loss)


def test_clusterers_refuse_bad_sizes(spark):
    for k in (1, 7):
        with pytest.raises(ValueError, match="k must|cannot form"):
            Clusterer(crime(spark), k).assign()


def test_perturbation_scalars():
    p = solve_p(2, 6, [3])
    assert p == pytest.approx(0.2917962, abs=1e-6) and attained_k(p, [3], 6) == pytest.approx(2, abs=1e-5)
    assert solve_b(2, 6, 2) == pytest.approx(2.4853397, abs=1e-6)
    for bad in (lambda: solve_p(2, 6, []), lambda: solve_p(6, 6, [3]), lambda: solve_b(1, 6, 1)):
        with pytest.raises(ValueError):
            bad()
