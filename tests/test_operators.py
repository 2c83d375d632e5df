"""Edge cases and invariants of the table operators."""

import json

import pytest
from pyspark.sql import functions as F

from cloakframe import anonymity, mleval, utility
from cloakframe.functions.rules import Bucket, Expression, MapValues, Suppress, Threshold
from cloakframe.hierarchy import Hierarchy, UnknownNode
from cloakframe.operators import facets, sampling
from cloakframe.operators.cluster import Clusterer
from cloakframe.operators.generalize import generalize_column
from cloakframe.operators.perturb import Perturbation
from cloakframe.operators.recode import custom, number_text
from cloakframe.spec import AnonSpec
from cloakframe.streaming.rowwise import generalize_stream

from .helpers import AGE, ZIP, crime


def one(spark, column, value):
    return spark.range(1).select(column.alias("x")).first()["x"] if value is None else spark.createDataFrame([(value,)], "v long" if isinstance(value, int) else "v string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("source", "value", "expected"),
    [
        ("lambda x: f'{(x-1)//5*5}~{(x-1)//5*5+4}'", 25, "20~24"), ("lambda x: f'{(x-1)//5*5}~{(x-1)//5*5+4}'", 26, "25~29"), ("lambda x: f'{x//10}*'", 32042, "3204*"),
        ("lambda x: f'{int(x.split(\"*\")[0])//10}**'", "3204*", "320**"), ("lambda x: 'a' if x in ['p', 'q'] else 'b'", "q", "a"), ("lambda x: '1990s' if x <2000 else '2000s'", 2000, "2000s"),
        ("lambda x: '*'", 5, "*"), ("lambda x: f'{int(x.split(\"~\")[0])//10*10}~{int(x.split(\"~\")[0])//10*10+9}'", "25~29", "20~29"), ("lambda x: '1~3' if x in [1,2,3] else '4~6' if x in [4,5,6] else 'z'", 5, "4~6"),
    ],
)
def test_translated_rules(spark, source, value, expected):
    assert one(spark, Expression(source).column(F.col("v")), value) == expected


@pytest.mark.parametrize("source", ["lambda x: __import__('os')", "lambda x: x.upper()", "lambda x: open(x)", "1", "lambda x, y: x"])
def test_other_syntax_is_refused(spark, source):
    with pytest.raises(ValueError):
        Expression(source).column(F.lit("a"))


def test_rules(spark):
    assert one(spark, Bucket(5).column(F.col("v")), -3) == "-5~-1"
    assert one(spark, MapValues({"a": "A"}).column(F.col("v")), "b") == "b"
    assert one(spark, Threshold(10, "lo", "hi").column(F.col("v")), 10) == "hi"
    assert one(spark, Suppress().column(F.lit(None).cast("string")), None) is None


def test_hierarchy_questions(spark):
    df = crime(spark).df
    assert AGE.contains(df, "*") and AGE.contains(df, "20~24") and not AGE.contains(df, "90~94")
    assert {r[0] for r in AGE.leaves_under(df, "20~24").collect()} == {"20", "23", "24"}
    assert AGE.leaves_under(df, "24").count() == 0 and AGE.leaves_under(df, "*").count() == 6
    assert (AGE.node_height(df, "24"), AGE.node_height(df, "20~24"), AGE.node_height(df, "*")) == (0, 1, 4)
    with pytest.raises(UnknownNode):
        AGE.node_height(df, "nope")
    with pytest.raises(UnknownNode):
        AGE.leaves_under(df, "nope")
    assert df.agg(AGE.lca(F.col("age")), AGE.lca_height(F.col("age"))).first()[:] == ("20~29", 2)


def test_hierarchy_files(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"name": "w", "tree": [{"is_suppressed": False, "values": [{"original": ["a", "b"], "generalized": "AB"}]}, {"is_suppressed": True}]}))
    h = Hierarchy.from_json("w", str(tmp_path / "w.json"))
    df = spark.createDataFrame([("a",), ("c",), (None,)], "w string")
    assert {tuple(r) for r in h.table(df).collect()} == {("a", "AB", "*"), ("c", "c", "*")}
    with pytest.raises(FileNotFoundError):
        Hierarchy.from_json("w", str(tmp_path / "none.json"))
    (tmp_path / "m.csv").write_text("a,AB,*\nb,AB,*\n")
    m = Hierarchy.from_csv(spark, "w", str(tmp_path / "m.csv"))
    assert [r["w"] for r in generalize_column(df.filter("w = 'a' or w is null"), "w", m, 0, 1).orderBy("w").collect()] == [None, "AB"]
    pairs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a")], "g long, w string")
    got = m.levels(pairs, "w", "l").groupBy("g").agg(m.lca(levels=[F.col(f"l{i}") for i in range(3)]).alias("x")).orderBy("g").collect()
    assert [r["x"] for r in got] == ["AB", "a"]
    with pytest.raises(ValueError, match="no rules"):
        m.lca(F.col("w"))
    nodes = spark.createDataFrame([(1, "a"), (1, "AB"), (2, "*"), (2, "a"), (3, "b"), (4, None), (5, "AB")], "group_id long, node string")
    assert {tuple(r) for r in m.lca_nodes(nodes, df).collect()} == {(1, "AB", 1), (2, "*", 2), (3, "b", 0), (5, "AB", 1)}
    with pytest.raises(Exception, match="no node of its hierarchy: z"):
        m.lca_nodes(spark.createDataFrame([(1, "z")], "group_id long, node string"), df).collect()
    with pytest.raises(Exception, match="not in its hierarchy: c"):
        generalize_column(df, "w", m, 0, 1).collect()
    for levels in ((1, 1), (0, 3), (-1, 1)):
        with pytest.raises(ValueError):
            generalize_column(df, "w", m, *levels)


def test_dataset_folder(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b,t\n1,x,p\n2,y,q\n")
    (tmp_path / "props.json").write_text('{"qi_index": [0, 1], "target": "t", "is_category": [false, true]}')
    spec = AnonSpec.from_folder(spark, str(tmp_path), "d")
    assert spec.qids == ("a", "b") and spec.qids_categorical == ["b"] and spec.qids_idx_numerical == [0] and dict(spec.df.dtypes)["a"] == "bigint" and str(spec) == "D"
    assert {r["attribute"]: r["distinct_count"] for r in spec.info().collect()} == {"a": 2, "b": 2, "t": 2}
    with pytest.raises(FileNotFoundError):
        AnonSpec.from_folder(spark, str(tmp_path), "none")
    with pytest.raises(AttributeError):
        spec.hierarchy("a")


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a")], "x long, y string")
    assert [tuple(r) for r in anonymity.equivalence_classes(df).collect()] == [(1, "a", 2)]
    assert anonymity.equivalence_classes(df, nulls="group").count() == 2
    empty = df.limit(0)
    assert anonymity.k_level(empty).first()[0] is None and anonymity.is_k_anonymous(empty).first()[0] is False
    assert utility.average_class(empty, ["x"], 2).first()[0] is None and utility.discernibility(empty, ["x"]).first()[0] == 0
    info = AnonSpec(df, ("x",), {"x": False}).info().collect()
    assert info[0]["distinct_count"] == 2


def test_sampling_rounds_half_to_even(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate("abbbccccc")] + [(99, None)], "k long, t string")
    got = {r["t"]: r["count"] for r in sampling.stratified_sample(df, "t", "k", frac=0.5).groupBy("t").count().collect()}
    assert got == {"b": 2, "c": 2}
    for parts in (1, 7):
        assert sampling.stratified_sample(df.repartition(parts), "t", "k", frac=0.5).count() == 4
    split = sampling.train_test_split(df, "t", "k", 0.4).collect()
    assert len(split) == 9 and sum(r["is_test"] for r in split) == 3
    with pytest.raises(ValueError):
        sampling.stratified_sample(df, "t", "k")


def test_sampled_spec(spark):
    spec = crime(spark)
    half = AnonSpec(spec.df, spec.qids, spec.categorical, "marital-status", "row_id", spec.hierarchies, "c").sample(frac=0.5, seed=2)
    assert half.df.groupBy("`marital-status`").count().collect() and half.df.count() == 3 and str(half) == "C_SAMPLE"


@pytest.mark.parametrize(("value", "text"), [(29.0, "29.0"), (0.0, "0.0"), (-1.5, "-1.5"), (12345678.123, "12345678.123"), (1e15, "1000000000000000.0"), (0.00025, "0.00025")])
def test_numbers_as_text(spark, value, text):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(number_text(F.col("x"), "double")).first()[0] == text == str(value)


def test_perturbation_keeps_bounds_types_and_nulls(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias("c"), F.when(F.col("id") > 0, F.col("id") % 50).alias("x"))
    spec = AnonSpec(df, ("c", "x"), {"c": True, "x": False}, None, "id")
    p = Perturbation(spec, 10, seed=3)
    par, out = p.parameters(), p.transform()
    assert out.schema["x"].dataType == df.schema["x"].dataType and out.filter("x is null").count() == 1
    assert out.agg(F.min("x"), F.max("x")).first()[:] == (0, 49)
    kept = out.join(df.select("id", F.col("c").alias("old")), "id").agg(F.avg((F.col("c") == F.col("old")).cast("double"))).first()[0]
    assert kept == pytest.approx(par["p"] + (1 - par["p"]) / 4, abs=0.05)
    assert sorted(out.collect()) == sorted(Perturbation(spec.with_df(df.repartition(5)), 10, seed=3).transform().collect())


def test_blocked_clusterer_gives_groups_of_k(spark):
    df = spark.range(200).select("id", (F.col("id") * 37 % 101).alias("x"), (F.col("id") % 7).alias("y"))
    spec = AnonSpec(df, ("x", "y"), {"x": False, "y": False}, None, "id")
    for method in ("k_member", "oka"):
        sizes = [r["count"] for r in Clusterer(spec, 4, method, seed=1, block_rows=60).assign().groupBy("group_id").count().collect()]
        assert sum(sizes) == 200 and min(sizes) >= 4


def test_custom_recoder(spark):
    spec = crime(spark)
    groups = spec.df.withColumn("group_id", F.col("row_id") % 2)
    got = custom(groups, spec, lambda pdf: pdf.assign(age=int(pdf["age"].max()))[["row_id", "age"]], "row_id long, age long").orderBy("row_id").collect()
    assert [r["age"] for r in got] == [29, 28, 29, 28, 29, 28]


def test_facets_search_and_pages(spark):
    df = crime(spark).df
    assert {(r["facet"], r["value"], r["count"]) for r in facets.facets(df, ["marital-status"]).collect()} == {("marital-status", x, 2) for x in ("Separated", "Single", "Widowed")}
    assert [r["name"] for r in facets.search(df, {"name": "J", "crime": "thef"}).collect()] == ["Jill"]
    assert [r["row_id"] for r in facets.page(df, ["row_id"], 1, 4).collect()] == [4, 5]


def test_metrics_of_predictions(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, prediction string")
    got = {r["label"]: (r["precision"], r["recall"], r["support"]) for r in mleval.class_metrics(df).collect()}
    assert got == {"a": (1.0, 0.5, 2), "b": (pytest.approx(1 / 3), 1.0, 1), "c": (0.0, 0.0, 1)}
    assert mleval.metrics(df).first()["accuracy"] == 0.5
    assert "precision" in mleval.report(mleval.class_metrics(df))


def test_classifier_on_an_easy_table(spark):
    df = spark.range(120).select("id", (F.col("id") % 2).cast("string").alias("t"), (F.col("id") % 2 * 10 + F.col("id") % 3).cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("c"))
    for model in ("DT", "LOG", "KNN"):
        e = mleval.Evaluation(model, df, ["x", "c"], "t", "id", 0.25)
        assert e.evaluate()["metrics"].first()["accuracy"] == 1.0
    with pytest.raises(ValueError):
        mleval.classifier("none")


def test_streams(spark, tmp_path):
    spark.createDataFrame([(25, 32042)], "age long, zip long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("age long, zip long").parquet(str(tmp_path / "in"))
    run = generalize_stream(stream, {"age": AGE, "zip": ZIP}, {"age": 1, "zip": 2}).writeStream.format("memory").queryName("released").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination()
    assert [tuple(r) for r in spark.table("released").collect()] == [("25~29", "320**")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
