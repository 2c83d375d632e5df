"""The registered queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .. import anonymity, mleval, utility
from ..functions.rules import Bucket, MapValues, Suppress, Threshold, Widen
from ..hierarchy import Hierarchy, all_nodes
from ..operators import facets as looking
from ..operators import sampling
from ..operators.cluster import Clusterer
from ..operators.generalize import Datafly, generalize_column, levels_table
from ..operators.mondrian import Mondrian
from ..operators.perturb import Perturbation, solve_b, solve_p
from ..operators.recode import GROUP, RECODERS
from ..sources.tables import read_table
from ..spec import AnonSpec
from .tables import shared_dir

K_LINES, K_PART = 200, 5
LINE_QIDS = ["l_quantity", "l_returnflag", "l_linestatus"]
SIZES = Hierarchy("p_size", (Bucket(5), Widen(10), Widen(20), Suppress()))
# Brands are numbered; the next level keeps the first digit.
BRANDS = Hierarchy("p_brand", (MapValues({f"Brand#{i}": f"Brand#{str(i)[0]}x" for i in range(1, 100)}), Suppress()))
TYPES = Hierarchy("p_type", (Suppress(),))
NATIONS = Hierarchy("c_nationkey", (MapValues({str(i): f"zone{i % 5}" for i in range(25)}), Suppress()))
SEGMENTS = Hierarchy("c_mktsegment", (Suppress(),))
SUPPLY = Hierarchy("s_nationkey", NATIONS.rules)
YEARS = Hierarchy("o_year", (Threshold(1998, "early", "late"), Suppress()))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "lineitem").select(*LINE_QIDS)


def part_spec(spark: SparkSession, d: str) -> AnonSpec:
    """Parts with brand, type and size; brands and types by themselves or at all."""
    return AnonSpec(read_table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), ("p_brand", "p_type", "p_size"), {"p_brand": True, "p_type": True, "p_size": False}, None, "p_partkey", {"p_brand": BRANDS, "p_type": TYPES, "p_size": SIZES}, "part")


def price_spec(spark: SparkSession, d: str) -> AnonSpec:
    prices = Hierarchy("p_retailprice", (Suppress(),))
    df = read_table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    return AnonSpec(df, ("p_size", "p_retailprice", "p_brand"), {"p_size": False, "p_retailprice": False, "p_brand": True}, None, "p_partkey", {"p_size": SIZES, "p_retailprice": prices, "p_brand": BRANDS}, "part")


def customer_spec(spark: SparkSession, d: str) -> AnonSpec:
    df = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey", "c_acctbal")
    return AnonSpec(df, ("c_mktsegment", "c_nationkey", "c_acctbal"), {"c_mktsegment": True, "c_nationkey": True, "c_acctbal": False}, "c_mktsegment", "c_custkey", {"c_mktsegment": SEGMENTS, "c_nationkey": NATIONS}, "customer")


def supplier_spec(spark: SparkSession, d: str) -> AnonSpec:
    df = read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    return AnonSpec(df, ("s_nationkey", "s_acctbal"), {"s_nationkey": True, "s_acctbal": False}, None, "s_suppkey", {"s_nationkey": SUPPLY}, "supplier")


def _orders_year(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("long").alias("o_year"))


def _datafly(threshold: int) -> Callable:
    return lambda spark, d: Datafly(part_spec(spark, d), K_PART, threshold).transform()


def _suppressed(spark: SparkSession, d: str) -> DataFrame:
    return _datafly(20)(spark, d).suppressed.select(*[F.col(c).cast("string").alias(c) for c in ("p_brand", "p_type", "p_size")], "count")


def _datafly_table(spark: SparkSession, d: str) -> DataFrame:
    return _datafly(20)(spark, d).df.select("p_partkey", *[F.col(c).cast("string").alias(c) for c in ("p_brand", "p_type", "p_size")])


def _ncp_generalization(spark: SparkSession, d: str) -> DataFrame:
    return utility.ncp_generalization(part_spec(spark, d), _datafly(20)(spark, d).df).select(F.round("ncp", 6).alias("ncp"))


def _mondrian(recoder: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Mondrian(price_spec(spark, d), K_PART, recoder).transform().df

    return run


def _mondrian_groups(spark: SparkSession, d: str) -> DataFrame:
    return Mondrian(price_spec(spark, d), K_PART).groups().select("p_partkey", GROUP)


def _over_groups(metric: Callable) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        spec = price_spec(spark, d)
        return metric(spec, Mondrian(spec, K_PART).transform().groups).select(F.round("ncp", 6).alias("ncp"))

    return run


def _cluster(method: str, block_rows: int | None = None) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Clusterer(supplier_spec(spark, d), 3, method, "summarization", seed=7, block_rows=block_rows).transform().df

    return run


def _perturb_scalars(spark: SparkSession, d: str) -> dict:
    return Perturbation(customer_spec(spark, d), 5, seed=42).parameters()


def _one(spark: SparkSession, name: str, value: float) -> DataFrame:
    return spark.range(1).select(F.round(F.lit(value), 6).alias(name))


def _perturb_p(spark: SparkSession, d: str) -> DataFrame:
    par = _perturb_scalars(spark, d)
    return _one(spark, "p", solve_p(5, par["n"], par["sizes"]))


def _perturb_b(spark: SparkSession, d: str) -> DataFrame:
    return _one(spark, "b", solve_b(5, _perturb_scalars(spark, d)["n"], 1))


def _perturb_table(spark: SparkSession, d: str) -> DataFrame:
    return Perturbation(customer_spec(spark, d), 5, seed=42).transform().withColumn("c_acctbal", F.round("c_acctbal", 4))


def _knn(spark: SparkSession, d: str) -> mleval.Evaluation:
    df = read_table(spark, d, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return mleval.Evaluation("KNN", df, [f"e{i}" for i in range(64)], "label", "vec_id", 0.2, seed=1)


def _knn_predicted(spark: SparkSession, d: str) -> DataFrame:
    return _knn(spark, d).predict()


def _ml(model: str) -> Callable:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = read_table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
        return mleval.Evaluation(model, df, ["c_nationkey", "c_acctbal"], "c_mktsegment", "c_custkey", seed=1).evaluate()["metrics"]

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "eq_classes": lambda s, d: anonymity.equivalence_classes(_lines(s, d)),
    "k_violations": lambda s, d: anonymity.violations(_lines(s, d), K_LINES),
    "k_level": lambda s, d: anonymity.k_level(_lines(s, d)),
    "is_k_anonymous": lambda s, d: anonymity.is_k_anonymous(_lines(s, d), K_LINES),
    "dm": lambda s, d: utility.discernibility(_lines(s, d), LINE_QIDS, 3),
    "dm_from_eqs": lambda s, d: utility.discernibility_of(anonymity.equivalence_classes(_lines(s, d))),
    "dm_best": lambda s, d: utility.discernibility_best(_lines(s, d), K_LINES),
    "cavg": lambda s, d: utility.average_class(_lines(s, d), LINE_QIDS, K_LINES),
    "cavg_from_eqs": lambda s, d: utility.average_class_of(anonymity.equivalence_classes(_lines(s, d)), K_LINES),
    "cavg_best": lambda s, d: utility.average_class_best(_lines(s, d), K_LINES),
    "dataset_info": lambda s, d: customer_spec(s, d).info(),
    "dataset_describe": lambda s, d: customer_spec(s, d).describe(),
    "hierarchy_table_bucket": lambda s, d: SIZES.table(part_spec(s, d).df),
    "hierarchy_table_map": lambda s, d: NATIONS.table(customer_spec(s, d).df),
    "hierarchy_table_threshold": lambda s, d: YEARS.table(_orders_year(s, d)),
    "hierarchy_leaves_under": lambda s, d: SIZES.leaves_under(part_spec(s, d).df, "20~39"),
    "hierarchy_nodes": lambda s, d: SIZES.nodes(part_spec(s, d).df),
    "hierarchy_all": lambda s, d: all_nodes(customer_spec(s, d).df, {"c_nationkey": NATIONS, "c_mktsegment": SEGMENTS}),
    "hierarchy_lca": lambda s, d: part_spec(s, d).df.groupBy("p_brand").agg(SIZES.lca(F.col("p_size")).alias("lca"), SIZES.lca_height(F.col("p_size")).alias("height")),
    "hierarchy_lca_mapping": lambda s, d: _mapped_lca(s, d),
    "hierarchy_lca_nodes": lambda s, d: _nodes_lca(s, d),
    "recode_generalization_mapping": lambda s, d: _mapped_recoding(s, d),
    "hierarchy_csv_file": lambda s, d: _from_file(s, d),
    "generalize_column": lambda s, d: generalize_column(read_table(s, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", Hierarchy("c_nationkey", mapping=_nation_map(s, d)), 0, 1),
    "datafly_levels": lambda s, d: levels_table(_datafly(0)(s, d), part_spec(s, d).df),
    "datafly_table": _datafly_table,
    "datafly_suppressed": _suppressed,
    "mondrian_groups": _mondrian_groups,
    "mondrian_summarization": _mondrian("summarization"),
    "mondrian_mean_mode": lambda s, d: _mondrian("mean_mode")(s, d).withColumn("p_size", F.round("p_size", 6)).withColumn("p_retailprice", F.round("p_retailprice", 6)),
    "mondrian_generalization": _mondrian("generalization"),
    "ncp_generalization": _ncp_generalization,
    "ncp_mean_mode": _over_groups(utility.ncp_mean_mode),
    "ncp_summarization": _over_groups(utility.ncp_summarization),
    "kmember_table": _cluster("k_member"),
    "oka_table": _cluster("oka"),
    "kmember_blocked_table": _cluster("k_member", 500),
    "oka_blocked_table": _cluster("oka", 500),
    "perturb_p": _perturb_p,
    "perturb_b": _perturb_b,
    "perturb_table": _perturb_table,
    "stratified_sample": lambda s, d: sampling.stratified_sample(customer_spec(s, d).df, "c_mktsegment", "c_custkey", frac=0.1, seed=1),
    "train_test_split": lambda s, d: sampling.train_test_split(read_table(s, d, "labels").select("doc_id", "quality"), "quality", "doc_id", 0.2, 1),
    "facets": lambda s, d: looking.facets(read_table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]),
    "table_page": lambda s, d: looking.page(read_table(s, d, "orders").select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 3, 10),
    "table_search": lambda s, d: looking.search(read_table(s, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), {"o_orderpriority": "urgent", "o_orderstatus": "f"}),
    "knn_predictions": lambda s, d: _knn_predicted(s, d),
    "confusion_matrix": lambda s, d: mleval.confusion(_knn_predicted(s, d)),
    "ml_class_metrics": lambda s, d: _rounded(mleval.class_metrics(_knn_predicted(s, d))),
    "ml_metrics": lambda s, d: _rounded(mleval.metrics(_knn_predicted(s, d))),
    "ml_decision_tree": _ml("DT"),
    "ml_random_forest": _ml("RF"),
    "ml_logistic": _ml("LOG"),
    "ml_linear_svm": _ml("SVM"),
}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _mapped_lca(spark: SparkSession, d: str) -> DataFrame:
    h = Hierarchy("c_nationkey", mapping=_nation_map(spark, d))
    rows = h.levels(read_table(spark, d, "customer").select((F.col("c_custkey") % 500).alias("group_id"), "c_nationkey"), "c_nationkey", "n")
    at = [F.col(f"n{i}") for i in range(3)]
    return rows.groupBy("group_id").agg(h.lca(levels=at).alias("lca"), h.lca_height(levels=at).alias("height"))


def _nodes_lca(spark: SparkSession, d: str) -> DataFrame:
    """Of each group of customers: their nations, but the region for even keys."""
    h = Hierarchy("c_nationkey", mapping=_nation_map(spark, d))
    rows = h.levels(read_table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_nationkey", "n")
    nodes = rows.select((F.col("c_custkey") % 500).alias("group_id"), F.when(F.col("c_custkey") % 2 == 0, F.col("n1")).otherwise(F.col("n0")).alias("node"))
    return h.lca_nodes(nodes, rows)


def _mapped_recoding(spark: SparkSession, d: str) -> DataFrame:
    spec = AnonSpec(read_table(spark, d, "customer").select("c_custkey", "c_nationkey"), ("c_nationkey",), {"c_nationkey": True}, None, "c_custkey", {"c_nationkey": Hierarchy("c_nationkey", mapping=_nation_map(spark, d))})
    groups = spec.df.withColumn(GROUP, F.floor(F.col("c_custkey") / 4)).withColumn("n", F.count(F.lit(1)).over(W.Window.partitionBy(GROUP)))
    return RECODERS["generalization"](groups.filter("n > 1").drop("n"), spec)


def _from_file(spark: SparkSession, d: str) -> DataFrame:
    """The mapping written as a CSV file without header, read as a hierarchy again, and its inner nodes counted."""
    path = f"{shared_dir(spark)}/cloakframe-mapping-{uuid.uuid4().hex}"
    _nation_map(spark, d).write.csv(path)
    return Hierarchy.from_csv(spark, "c_nationkey", path).nodes(read_table(spark, d, "customer"))


def _nation_map(spark: SparkSession, d: str) -> DataFrame:
    n, r = read_table(spark, d, "nation"), read_table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").cast("string").alias("l0"), F.col("r_name").alias("l1"), F.lit("*").alias("l2"))


_EQ = "SELECT l_quantity, l_returnflag, l_linestatus, count(*) AS \"count\" FROM lineitem GROUP BY ALL"
_UNIFORM = "(('0x' || substr(md5('{seed}|{tag}|' || {key}), 1, 13))::BIGINT / 2.0**52)"


def _u(seed: int, tag: str, key: str) -> str:
    return _UNIFORM.format(seed=seed, tag=tag, key=key)


_SIZE = [
    "CAST(p_size AS VARCHAR)",
    "(p_size // 5 * 5) || '~' || (p_size // 5 * 5 + 4)",
    "(p_size // 5 * 5 // 10 * 10) || '~' || (p_size // 5 * 5 // 10 * 10 + 9)",
    "(p_size // 20 * 20) || '~' || (p_size // 20 * 20 + 19)",
    "'*'",
]
_BRAND = ["p_brand", "substr(p_brand, 1, 7) || 'x'", "'*'"]
_TYPE = ["p_type", "'*'"]


def _datafly_walk(threshold: int) -> str:
    """The lattice of level vectors with their smallest class, violators and cardinalities, and a walk through it."""
    cells = [f"SELECT {b} AS b, {t} AS t, {z} AS z, {_BRAND[b]} AS vb, {_TYPE[t]} AS vt, {_SIZE[z]} AS vz FROM part" for b in range(3) for t in range(2) for z in range(5)]
    return f"""
    lattice AS ({' UNION ALL '.join(cells)}),
    classes AS (SELECT b, t, z, vb, vt, vz, count(*) AS n FROM lattice GROUP BY ALL),
    stats AS (SELECT b, t, z, min(n) AS least, coalesce(sum(n) FILTER (n < {K_PART}), 0) AS bad, count(DISTINCT vb) AS db, count(DISTINCT vt) AS dt, count(DISTINCT vz) AS dz
              FROM classes GROUP BY ALL),
    walk(b, t, z, step) AS (
      SELECT 0, 0, 0, 0
      UNION ALL
      SELECT w.b + CASE WHEN db >= dt AND db >= dz THEN 1 ELSE 0 END,
             w.t + CASE WHEN dt > db AND dt >= dz THEN 1 ELSE 0 END,
             w.z + CASE WHEN dz > db AND dz > dt THEN 1 ELSE 0 END, w.step + 1
      FROM walk w JOIN stats s ON s.b = w.b AND s.t = w.t AND s.z = w.z WHERE s.bad > {threshold}
    ),
    final AS (SELECT b, t, z FROM walk ORDER BY step DESC LIMIT 1)"""


_MONDRIAN = f"""
WITH RECURSIVE code AS (
  SELECT p_brand, row_number() OVER (ORDER BY min(p_partkey)) - 1.0 AS c FROM part GROUP BY p_brand
), base AS (
  SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(c AS DOUBLE) AS c FROM part JOIN code USING (p_brand)
), span AS (
  SELECT max(a) - min(a) AS sa, max(b) - min(b) AS sb, count(DISTINCT c) AS sc FROM base
), tree(p_partkey, a, b, c, path, live) AS (
  SELECT *, '', TRUE FROM base
  UNION ALL
  SELECT r.p_partkey, r.a, r.b, r.c, r.path || CASE WHEN pick IS NULL THEN '' WHEN (CASE pick WHEN 1 THEN r.a > ma WHEN 2 THEN r.b > mb ELSE r.c > mc END) THEN '1' ELSE '0' END, pick IS NOT NULL
  FROM (SELECT * FROM tree WHERE live) r JOIN (
    SELECT path, ma, mb, mc,
           list_extract(list_transform(list_sort(list_filter([
             {{'w': -wa, 'd': -da, 'i': 1, 'ok': la >= {K_PART} AND n - la >= {K_PART}}},
             {{'w': -wb, 'd': -db, 'i': 2, 'ok': lb >= {K_PART} AND n - lb >= {K_PART}}},
             {{'w': -wc, 'd': -dc, 'i': 3, 'ok': lc >= {K_PART} AND n - lc >= {K_PART}}}], lambda x: x.ok AND n >= {2 * K_PART})), lambda x: x.i), 1) AS pick
    FROM (
      SELECT s.path, s.n, s.ma, s.mb, s.mc, s.wa, s.wb, s.wc, s.da, s.db, s.dc,
             count(*) FILTER (x.a <= ma) AS la, count(*) FILTER (x.b <= mb) AS lb, count(*) FILTER (x.c <= mc) AS lc
      FROM (SELECT * FROM tree WHERE live) x JOIN (
        SELECT path, count(*) AS n, median(a) AS ma, median(b) AS mb, median(c) AS mc, (max(a) - min(a)) / any_value(sa) AS wa, (max(b) - min(b)) / any_value(sb) AS wb,
               count(DISTINCT c) / CAST(any_value(sc) AS DOUBLE) AS wc, count(DISTINCT a) AS da, count(DISTINCT b) AS db, count(DISTINCT c) AS dc
        FROM (SELECT * FROM tree WHERE live), span GROUP BY path) s ON x.path = s.path
      GROUP BY ALL)
  ) g ON r.path = g.path
), done AS (
  SELECT p_partkey, path FROM tree WHERE NOT live
), groups AS (
  SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY path) - 1 AS BIGINT) AS group_id FROM done
), rows AS (SELECT g.group_id, p.* FROM groups g JOIN part p USING (p_partkey))
"""

_NATIONS = "WITH m AS (SELECT c_custkey, c_nationkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_STRATUM = "SELECT *, row_number() OVER (PARTITION BY {t} ORDER BY {u}, {k}) AS r, count(*) OVER (PARTITION BY {t}) AS n FROM {table}"
_KNN = f"""
WITH s AS (
  SELECT vec_id, CAST(label AS VARCHAR) AS label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY {_u(1, 'sample', 'vec_id')}, vec_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings
), test AS (SELECT * FROM s WHERE r <= round_even(0.2 * n, 0)), train AS (SELECT * FROM s WHERE r > round_even(0.2 * n, 0)),
pairs AS (
  SELECT a.vec_id AS key, a.label, b.label AS vote, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), b.vec_id) AS near
  FROM test a, train b
), votes AS (SELECT key, label, vote, count(*) AS n FROM pairs WHERE near <= 5 GROUP BY ALL),
predicted AS (SELECT key, label, arg_min(vote, {{'n': -n, 'v': vote}}) AS prediction FROM votes GROUP BY key, label),
cells AS (SELECT label, prediction, count(*) AS "count" FROM predicted GROUP BY ALL),
sums AS (
  SELECT c AS label, CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(called) AS BIGINT) AS called, CAST(sum(hit) AS BIGINT) AS hit FROM (
    SELECT label AS c, "count" AS actual, 0 AS called, CASE WHEN label = prediction THEN "count" ELSE 0 END AS hit FROM cells
    UNION ALL SELECT prediction, 0, "count", 0 FROM cells) GROUP BY c),
classes AS (
  SELECT label, coalesce(hit / nullif(called, 0), 0.0) AS precision, coalesce(hit / nullif(actual, 0), 0.0) AS recall, coalesce(2 * hit / nullif(called + actual, 0), 0.0) AS f1, actual AS support FROM sums)
"""
_P = """
WITH RECURSIVE d AS (SELECT count(*) AS n, count(DISTINCT c_mktsegment) AS s1, count(DISTINCT c_nationkey) AS s2 FROM customer),
b(lo, hi, i) AS (
  SELECT 0.0::DOUBLE, 1.0::DOUBLE, 0
  UNION ALL
  SELECT CASE WHEN got > 5 THEN p ELSE lo END, CASE WHEN got > 5 THEN hi ELSE p END, i + 1
  FROM (SELECT lo, hi, i, (lo + hi) / 2 AS p, 1 + (n - 1) * pow((1 - (lo + hi) / 2) / (1 + (s1 - 1) * ((lo + hi) / 2)) * (1 - (lo + hi) / 2) / (1 + (s2 - 1) * ((lo + hi) / 2)), 2) AS got FROM b, d)
  WHERE i < 60 AND abs(got - 5) > 1e-6
), solved AS (SELECT (lo + hi) / 2 AS p FROM b ORDER BY i DESC LIMIT 1)
"""

ORACLES: dict[str, str] = {
    "eq_classes": _EQ,
    "k_violations": f"SELECT * FROM ({_EQ}) WHERE \"count\" < {K_LINES}",
    "k_level": f"SELECT min(\"count\") AS k_level FROM ({_EQ})",
    "is_k_anonymous": f"SELECT min(\"count\") >= {K_LINES} AS is_k_anonymous FROM ({_EQ})",
    "dm": f"SELECT CAST(sum(\"count\" * \"count\") + 3 * (sum(\"count\") + 3) AS BIGINT) AS dm FROM ({_EQ})",
    "dm_from_eqs": f"SELECT CAST(sum(\"count\" * \"count\") AS BIGINT) AS dm FROM ({_EQ})",
    "dm_best": f"SELECT CAST((n // {K_LINES} - n % {K_LINES}) * {K_LINES**2} + (n % {K_LINES}) * {(K_LINES + 1) ** 2} AS BIGINT) AS dm_best FROM (SELECT count(*) AS n FROM lineitem)",
    "cavg": f"SELECT CAST(sum(\"count\") / (count(*) * {K_LINES}) AS DOUBLE) AS cavg FROM ({_EQ})",
    "cavg_from_eqs": f"SELECT CAST(sum(\"count\") / (count(*) * {K_LINES}) AS DOUBLE) AS cavg FROM ({_EQ})",
    "cavg_best": f"SELECT CAST(n / (n // {K_LINES} * {K_LINES}) AS DOUBLE) AS cavg_best FROM (SELECT count(*) AS n FROM lineitem)",
    "dataset_info": """
      SELECT 'c_custkey' AS attribute, '' AS qid, '' AS numerical, '' AS categorical, 0::BIGINT AS distinct_count WHERE FALSE
      UNION ALL SELECT 'c_mktsegment', 'o', '', 'o', count(DISTINCT c_mktsegment) FROM customer
      UNION ALL SELECT 'c_nationkey', 'o', '', 'o', count(DISTINCT c_nationkey) FROM customer
      UNION ALL SELECT 'c_acctbal', 'o', 'o', '', count(DISTINCT c_acctbal) FROM customer""",
    "dataset_describe": "SELECT 'CUSTOMER' AS name, count(*) AS n_rows, 3::BIGINT AS n_columns FROM customer",
    "hierarchy_table_bucket": f"SELECT DISTINCT {', '.join(f'{x} AS l{i}' for i, x in enumerate(_SIZE))} FROM part",
    "hierarchy_table_map": "SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS l0, 'zone' || (c_nationkey % 5) AS l1, '*' AS l2 FROM customer",
    "hierarchy_table_threshold": "SELECT DISTINCT CAST(year(o_orderdate) AS VARCHAR) AS l0, CASE WHEN year(o_orderdate) < 1998 THEN 'early' ELSE 'late' END AS l1, '*' AS l2 FROM orders",
    "hierarchy_leaves_under": "SELECT DISTINCT CAST(p_size AS VARCHAR) AS l0 FROM part WHERE p_size BETWEEN 20 AND 39",
    "hierarchy_nodes": f"""
      WITH long AS ({' UNION '.join(f'SELECT p_size AS leaf, {i} AS level, {x} AS node FROM part' for i, x in enumerate(_SIZE))})
      SELECT node, CAST(min(level) AS INTEGER) AS level, count(DISTINCT level) AS levels, CASE WHEN min(level) = 0 THEN 0 ELSE count(DISTINCT leaf) END AS leaf_count FROM long GROUP BY node""",
    "hierarchy_all": """
      WITH c AS (SELECT DISTINCT c_nationkey AS v FROM customer), m AS (SELECT DISTINCT c_mktsegment AS v FROM customer)
      SELECT 'c_nationkey' AS attribute, CAST(v AS VARCHAR) AS leaf, 0 AS level, CAST(v AS VARCHAR) AS node FROM c
      UNION ALL SELECT 'c_nationkey', CAST(v AS VARCHAR), 1, 'zone' || (v % 5) FROM c UNION ALL SELECT 'c_nationkey', CAST(v AS VARCHAR), 2, '*' FROM c
      UNION ALL SELECT 'c_mktsegment', v, 0, v FROM m UNION ALL SELECT 'c_mktsegment', v, 1, '*' FROM m""",
    "hierarchy_lca": f"""
      SELECT p_brand, CASE {' '.join(f'WHEN count(DISTINCT {x}) = 1 THEN min({x})' for x in _SIZE[:4])} ELSE '*' END AS lca,
             CAST(CASE {' '.join(f'WHEN count(DISTINCT {x}) = 1 THEN {i}' for i, x in enumerate(_SIZE[:4]))} ELSE 4 END AS INTEGER) AS height FROM part GROUP BY p_brand""",
    "hierarchy_lca_mapping": f"""{_NATIONS} SELECT c_custkey % 500 AS group_id, CASE WHEN count(DISTINCT c_nationkey) = 1 THEN CAST(min(c_nationkey) AS VARCHAR) WHEN count(DISTINCT r_name) = 1 THEN min(r_name) ELSE '*' END AS lca,
      CAST(CASE WHEN count(DISTINCT c_nationkey) = 1 THEN 0 WHEN count(DISTINCT r_name) = 1 THEN 1 ELSE 2 END AS INTEGER) AS height FROM m GROUP BY 1""",
    "hierarchy_lca_nodes": f"""{_NATIONS} SELECT c_custkey % 500 AS group_id,
      CASE WHEN count(DISTINCT r_name) > 1 THEN '*' WHEN count(DISTINCT c_nationkey) = 1 AND min(c_custkey % 2) = 1 THEN CAST(min(c_nationkey) AS VARCHAR) ELSE min(r_name) END AS lca,
      CAST(CASE WHEN count(DISTINCT r_name) > 1 THEN 2 WHEN count(DISTINCT c_nationkey) = 1 AND min(c_custkey % 2) = 1 THEN 0 ELSE 1 END AS INTEGER) AS height FROM m GROUP BY 1""",
    "recode_generalization_mapping": f"""{_NATIONS}, g AS (SELECT c_custkey // 4 AS group_id, CASE WHEN count(DISTINCT c_nationkey) = 1 THEN CAST(min(c_nationkey) AS VARCHAR) WHEN count(DISTINCT r_name) = 1 THEN min(r_name) ELSE '*' END AS v
      FROM m GROUP BY 1 HAVING count(*) > 1) SELECT c_custkey, v AS c_nationkey, group_id FROM m JOIN g ON c_custkey // 4 = group_id""",
    "hierarchy_csv_file": """WITH m AS (SELECT CAST(n_nationkey AS VARCHAR) AS n, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT n AS node, 0 AS level, 1::BIGINT AS levels, 0::BIGINT AS leaf_count FROM m UNION ALL SELECT r_name, 1, 1, count(*) FROM m GROUP BY r_name UNION ALL SELECT '*', 2, 1, count(*) FROM m""",
    "generalize_column": "SELECT c_custkey, r_name AS c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "datafly_levels": f"WITH RECURSIVE {_datafly_walk(0)} SELECT 'p_brand' AS attribute, CAST(CASE WHEN b = 2 THEN -1 ELSE b END AS INTEGER) AS level FROM final UNION ALL SELECT 'p_type', CAST(CASE WHEN t = 1 THEN -1 ELSE t END AS INTEGER) FROM final UNION ALL SELECT 'p_size', CAST(CASE WHEN z = 4 THEN -1 ELSE z END AS INTEGER) FROM final",
    "datafly_suppressed": f"WITH RECURSIVE {_datafly_walk(20)} SELECT vb AS p_brand, vt AS p_type, vz AS p_size, n AS \"count\" FROM classes JOIN final USING (b, t, z) WHERE n < {K_PART}",
    "datafly_table": f"""WITH RECURSIVE {_datafly_walk(20)}, kept AS (SELECT vb, vt, vz FROM classes JOIN final USING (b, t, z) WHERE n >= {K_PART})
      SELECT p_partkey, x.vb AS p_brand, x.vt AS p_type, x.vz AS p_size FROM (
        SELECT p_partkey, CASE b {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_BRAND))} END AS vb, CASE t {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_TYPE))} END AS vt,
               CASE z {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(_SIZE))} END AS vz FROM part, final) x JOIN kept USING (vb, vt, vz)""",
    "ncp_generalization": f"""WITH RECURSIVE {_datafly_walk(20)}, g AS (SELECT c.*, (SELECT count(*) FROM part) AS total FROM classes c JOIN final USING (b, t, z) WHERE n >= {K_PART}),
      leaf AS (SELECT substr(p_brand, 1, 7) || 'x' AS node, count(DISTINCT p_brand) AS under FROM part GROUP BY 1),
      cost AS (SELECT n, total, CASE WHEN vb = '*' THEN 1.0 WHEN b = 0 THEN 0.0 ELSE under / CAST((SELECT count(DISTINCT p_brand) FROM part) AS DOUBLE) END + CASE WHEN vt = '*' THEN 1.0 ELSE 0.0 END
               + CASE WHEN vz = '*' THEN 1.0 WHEN z = 0 THEN 0.0 ELSE (CAST(split_part(vz, '~', 2) AS DOUBLE) - CAST(split_part(vz, '~', 1) AS DOUBLE)) / (SELECT max(p_size) - min(p_size) FROM part) END AS x
               FROM g LEFT JOIN leaf ON vb = node)
      SELECT round((sum(n * x) + (any_value(total) - sum(n)) * 3) / (3.0 * any_value(total)), 6) AS ncp FROM cost""",
    "mondrian_groups": f"{_MONDRIAN} SELECT p_partkey, group_id FROM groups",
    "mondrian_summarization": f"""{_MONDRIAN}, v AS (
      SELECT group_id, CASE WHEN min(p_size) = max(p_size) THEN CAST(min(p_size) AS VARCHAR) ELSE min(p_size) || ' ~ ' || max(p_size) END AS a,
             CASE WHEN min(p_retailprice) = max(p_retailprice) THEN CAST(min(p_retailprice) AS VARCHAR) ELSE min(p_retailprice) || ' ~ ' || max(p_retailprice) END AS b,
             array_to_string(list_sort(list(DISTINCT p_brand)), ' & ') AS c FROM rows GROUP BY group_id)
      SELECT p_partkey, a AS p_size, b AS p_retailprice, c AS p_brand FROM rows JOIN v USING (group_id)""",
    "mondrian_mean_mode": f"""{_MONDRIAN}, m AS (SELECT group_id, p_brand, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, min(p_partkey)) AS r FROM rows GROUP BY group_id, p_brand),
      v AS (SELECT group_id, round(avg(p_size), 6) AS a, round(avg(p_retailprice), 6) AS b FROM rows GROUP BY group_id)
      SELECT p_partkey, a AS p_size, b AS p_retailprice, m.p_brand FROM rows JOIN v USING (group_id) JOIN m USING (group_id) WHERE r = 1""",
    "mondrian_generalization": f"""{_MONDRIAN}, v AS (
      SELECT group_id, CASE {' '.join(f'WHEN count(DISTINCT {x}) = 1 THEN min({x})' for x in _SIZE[:4])} ELSE '*' END AS a, CASE WHEN count(DISTINCT p_retailprice) = 1 THEN CAST(min(p_retailprice) AS VARCHAR) ELSE '*' END AS b,
             CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) WHEN count(DISTINCT substr(p_brand, 1, 7)) = 1 THEN min(substr(p_brand, 1, 7)) || 'x' ELSE '*' END AS c FROM rows GROUP BY group_id)
      SELECT p_partkey, a AS p_size, b AS p_retailprice, c AS p_brand FROM rows JOIN v USING (group_id)""",
    "ncp_mean_mode": f"""{_MONDRIAN}, top AS (SELECT group_id, max(n) AS most FROM (SELECT group_id, p_brand, count(*) AS n FROM rows GROUP BY ALL) GROUP BY group_id),
      g AS (SELECT group_id, count(*) AS n, (max(p_size) - min(p_size)) / (SELECT CAST(max(p_size) - min(p_size) AS DOUBLE) FROM part) + (max(p_retailprice) - min(p_retailprice)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part) AS x FROM rows GROUP BY group_id)
      SELECT round(sum(n * (x + 1 - most / CAST(n AS DOUBLE))) / (3.0 * (SELECT count(*) FROM part)), 6) AS ncp FROM g JOIN top USING (group_id)""",
    "ncp_summarization": f"""{_MONDRIAN}, g AS (SELECT group_id, count(*) AS n, (max(p_size) - min(p_size)) / (SELECT CAST(max(p_size) - min(p_size) AS DOUBLE) FROM part) + (max(p_retailprice) - min(p_retailprice)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part)
             + count(DISTINCT p_brand) / (SELECT CAST(count(DISTINCT p_brand) AS DOUBLE) FROM part) AS x FROM rows GROUP BY group_id)
      SELECT round(sum(n * x) / (3.0 * (SELECT count(*) FROM part)), 6) AS ncp FROM g""",
    "perturb_p": f"{_P} SELECT round(p, 6) AS p FROM solved",
    "perturb_b": "SELECT round(2 / ln((count(*) - 1) / 4.0), 6) AS b FROM customer",
    "perturb_table": f"""{_P}, par AS (SELECT p, 2 / ln(((SELECT count(*) FROM customer) - 1) / 4.0) AS b, (SELECT list_sort(list(DISTINCT c_mktsegment)) FROM customer) AS d1, (SELECT list_sort(list(DISTINCT c_nationkey)) FROM customer) AS d2,
        (SELECT min(c_acctbal) FROM customer) AS lo, (SELECT max(c_acctbal) FROM customer) AS hi FROM solved),
      u AS (SELECT *, greatest({_u(42, 'noise:c_acctbal', 'c_custkey')}, 2.0**-53) - 0.5 AS w FROM customer, par)
      SELECT c_custkey, CASE WHEN {_u(42, 'keep:c_mktsegment', 'c_custkey')} < p THEN c_mktsegment ELSE d1[CAST(floor({_u(42, 'value:c_mktsegment', 'c_custkey')} * len(d1)) AS INTEGER) + 1] END AS c_mktsegment,
        CASE WHEN {_u(42, 'keep:c_nationkey', 'c_custkey')} < p THEN c_nationkey ELSE d2[CAST(floor({_u(42, 'value:c_nationkey', 'c_custkey')} * len(d2)) AS INTEGER) + 1] END AS c_nationkey,
        round(least(greatest(c_acctbal - sign(w) * ln(1 - 2 * abs(w)) * (b * (hi - lo)), lo), hi), 4) AS c_acctbal FROM u""",
    "stratified_sample": f"SELECT c_custkey, c_mktsegment, c_nationkey, c_acctbal FROM ({_STRATUM.format(t='c_mktsegment', u=_u(1, 'sample', 'c_custkey'), k='c_custkey', table='customer')}) WHERE r <= round_even(0.1 * n, 0)",
    "train_test_split": f"SELECT doc_id, quality, r <= round_even(0.2 * n, 0) AS is_test FROM ({_STRATUM.format(t='quality', u=_u(1, 'sample', 'doc_id'), k='doc_id', table='labels')})",
    "facets": "SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS \"count\" FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL",
    "table_page": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30",
    "table_search": "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND contains(lower(o_orderstatus), 'f')",
    "knn_predictions": f"{_KNN} SELECT key, label, prediction FROM predicted",
    "confusion_matrix": f"{_KNN} SELECT label, prediction, \"count\" FROM cells",
    "ml_class_metrics": f"{_KNN} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM classes",
    "ml_metrics": f"{_KNN} SELECT round(sum(recall * support) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM classes",
}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Greedy generalization of parts for k = 5, with the size of every class."""
    df = _datafly(0)(spark, d).df
    return anonymity.equivalence_classes(df, ["p_brand", "p_type", "p_size"])
