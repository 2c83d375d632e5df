"""Classifier performance on a table: features, stratified split, model, and per-class metrics as plain aggregates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .operators.sampling import train_test_split
from .plans.tables import materialize
from .spec import q

CELLS = 500_000  # numbers of a partition in passes over training rows


@dataclass
class Neighbours:
    """k nearest neighbours by Euclidean distance over a `features` array; ties to the smaller key, then the smaller label."""

    k: int = 5
    key: str = "key"
    rows: int = 4096  # of a block of either side

    def predict(self, train: DataFrame, test: DataFrame) -> DataFrame:
        """test's key, label, prediction. Every block of test rows meets every block of training rows, and sends on k votes a row."""
        parts = []
        for side in (test, train):
            blocks = max(1, -(-side.count() // self.rows))
            parts.append((side.select(F.col(self.key).alias("key"), "label", "features").withColumn("block", F.pmod(F.xxhash64(self.key), F.lit(blocks))), blocks))
        (a, a_blocks), (b, b_blocks) = parts
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        a = a.withColumnRenamed("block", "a_block").withColumn("b_block", every(b_blocks))
        b = b.withColumnRenamed("block", "b_block").withColumn("a_block", every(a_blocks))
        k, kind = self.k, test.schema[self.key].dataType.simpleString()

        def meet(asking: pd.DataFrame, having: pd.DataFrame) -> pd.DataFrame:
            out, having = [], having.sort_values("key", ignore_index=True)
            x = np.stack(having["features"].to_list()) if len(having) else None
            for key, label, f in zip(asking["key"], asking["label"], asking["features"], strict=True):
                if x is None:
                    continue
                far = ((x - np.asarray(f)) ** 2).sum(1)
                best = np.argsort(far, kind="stable")[:k]
                out += [(key, label, having["label"].iat[i], far[i], having["key"].iat[i]) for i in best]
            return pd.DataFrame(out, columns=["a_key", "a_label", "b_label", "d", "b_key"])

        pairs = a.groupBy("a_block", "b_block").cogroup(b.groupBy("a_block", "b_block")).applyInPandas(meet, f"a_key {kind}, a_label string, b_label string, d double, b_key {kind}")
        ranked = pairs.withColumn("r", F.row_number().over(W.Window.partitionBy("a_key").orderBy("d", "b_key"))).filter(F.col("r") <= self.k)
        votes = ranked.groupBy("a_key", "a_label", "b_label").agg(F.count(F.lit(1)).alias("n"))
        return votes.groupBy(F.col("a_key").alias(self.key), F.col("a_label").alias("label")).agg(F.min_by("b_label", F.struct(-F.col("n"), F.col("b_label"))).alias("prediction"))


def classifier(name: str, seed: int | None = None):
    """A new model: RF, LOG, SVM (linear, one against the rest: there is no kernel SVM here), DT or KNN."""
    more = {} if seed is None else {"seed": seed}
    match name:
        case "RF":
            return RandomForestClassifier(numTrees=100, maxDepth=15, **more)
        case "LOG":
            return LogisticRegression(maxIter=1000)
        case "SVM":
            return OneVsRest(classifier=LinearSVC(maxIter=20), parallelism=4)
        case "DT":
            return DecisionTreeClassifier(maxDepth=15, **more)
        case "KNN":
            return Neighbours()
    raise ValueError(f"no such classifier: {name}")


def _gathered(train: DataFrame, width: int) -> DataFrame:
    """train in as few partitions as its size asks for, persisted: each of a line search's many passes is a job, whose tasks cost more than the sums."""
    train = materialize(train, "train")
    parts = max(1, -(-train.count() * width // CELLS))
    return train.repartition(parts, "key").sortWithinPartitions("key").persist()


def confusion(predicted: DataFrame) -> DataFrame:
    """label, prediction, count."""
    return predicted.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("count"))


def class_metrics(predicted: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support for every label or prediction; 0 where a ratio has no denominator."""
    cells = confusion(predicted)
    rows = cells.select(F.col("label").alias("c"), F.col("count").alias("actual"), F.lit(0).cast("long").alias("called"), F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(0).alias("hit"))
    cols = cells.select(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("count").alias("called"), F.lit(0).cast("long").alias("hit"))
    sums = rows.unionByName(cols).groupBy("c").agg(F.sum("actual").alias("actual"), F.sum("called").alias("called"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return sums.select(F.col("c").alias("label"), ratio(F.col("hit"), F.col("called")).alias("precision"), ratio(F.col("hit"), F.col("actual")).alias("recall"), ratio(2 * F.col("hit"), F.col("called") + F.col("actual")).alias("f1"), F.col("actual").alias("support"))


def metrics(predicted: DataFrame) -> DataFrame:
    """accuracy, and precision, recall and f1 averaged over classes alike, in one row."""
    hit = (F.sum("support") * 0 + F.sum(F.col("recall") * F.col("support"))) / F.sum("support")
    return class_metrics(predicted).agg(hit.alias("accuracy"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"))


@dataclass
class Evaluation:
    """Fits a classifier on a stratified part of a table and measures it on the rest, or on another table."""

    model: str
    df: DataFrame
    features: list[str]
    target: str
    key: str
    ratio: float = 0.2
    test_df: DataFrame | None = None
    seed: int = 0
    _done: DataFrame | None = field(default=None, repr=False)

    def _stages(self) -> list:
        kinds = {f.name: f.dataType for f in self.df.schema.fields}
        texts = [c for c in self.features if not isinstance(kinds[c], T.NumericType)]
        nums = [c for c in self.features if c not in texts]
        at = {c: i for i, c in enumerate(self.features)}
        index = [StringIndexer(inputCol=f"f{at[c]}", outputCol=f"i{at[c]}", handleInvalid="keep", stringOrderType="alphabetAsc") for c in texts]
        hot = [OneHotEncoder(inputCols=[f"i{at[c]}" for c in texts], outputCols=[f"h{at[c]}" for c in texts])] if texts else []
        return [*index, *hot, VectorAssembler(inputCols=[*(f"f{at[c]}" for c in nums), *(f"h{at[c]}" for c in texts)], outputCol="features")]

    def _view(self, df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        cols = [F.col(q(c)).cast("string" if kinds[c] in ("string", "boolean") else "double").alias(f"f{i}") for i, c in enumerate(self.features)]
        return df.select(F.col(q(self.key)).alias("key"), F.col(q(self.target)).cast("string").alias("target"), *cols)

    def split(self) -> tuple[DataFrame, DataFrame]:
        if self.test_df is not None:
            return self._view(self.df), self._view(self.test_df)
        parts = train_test_split(self.df, self.target, self.key, self.ratio, self.seed)
        return self._view(parts.filter("not is_test")), self._view(parts.filter("is_test"))

    def predict(self, restart: bool = False) -> DataFrame:
        """key, label, prediction of the test rows, as text. A label that training lacks raises an error."""
        if self._done is not None and not restart:
            return self._done
        train, test = self.split()
        prepared: PipelineModel = Pipeline(stages=self._stages()).fit(train)
        model = classifier(self.model, self.seed)
        if isinstance(model, Neighbours):
            view = lambda d: prepared.transform(d).select("key", F.col("target").alias("label"), vector_to_array("features").alias("features"))
            out = model.predict(view(train), view(test))
        else:
            labels: StringIndexerModel = StringIndexer(inputCol="target", outputCol="label", handleInvalid="error", stringOrderType="alphabetAsc").fit(train)
            ready = labels.transform(prepared.transform(train)).select("key", "features", "label")
            if isinstance(model, OneVsRest):
                ready = _gathered(ready, len(self.features))
            fitted = model.fit(ready)
            ready.unpersist()
            names = F.array(*[F.lit(x) for x in labels.labels])
            out = fitted.transform(labels.transform(prepared.transform(test))).select("key", F.get(names, F.col("label").cast("int")).alias("label"), F.get(names, F.col("prediction").cast("int")).alias("prediction"))
        self._done = out.persist()
        return self._done

    def evaluate(self, restart: bool = False) -> dict[str, DataFrame]:
        predicted = self.predict(restart)
        return {"metrics": metrics(predicted), "classes": class_metrics(predicted), "confusion": confusion(predicted)}


def report(classes: DataFrame) -> str:
    """The per-class metrics as text."""
    rows = classes.orderBy("label").collect()
    lines = [f"{'':>12} precision  recall      f1 support", *(f"{r['label']:>12} {r['precision']:9.2f} {r['recall']:7.2f} {r['f1']:7.2f} {r['support']:7d}" for r in rows)]
    return reduce(lambda a, b: f"{a}\n{b}", lines)
