"""Queries of distances, classifiers and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ml
from .registry import query


def _parts(table):
    rows = table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return rows.where("id % 3 = 0"), rows.where("id % 3 <> 0")


def _distance(table, kind):
    e = table("embeddings")
    first = e.where("vec_id = 0").select("embedding").scalar()
    return e.withColumn("first", first).select("vec_id", F.round(ml.distance(kind, F.col("embedding"), F.col("first")), 6).alias("d"))


_FIRST = "(SELECT embedding::DOUBLE[] AS f FROM embeddings WHERE vec_id = 0)"


@query(f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], f), 6) AS d FROM embeddings, {_FIRST}")
def dist_euclid(table):
    return _distance(table, "euclid")


@query(f"SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], f), lambda x: abs(x[1] - x[2]))), 6) AS d FROM embeddings, {_FIRST}")
def dist_manhattan(table):
    return _distance(table, "manhattan")


@query(f"SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], f), 6) AS d FROM embeddings, {_FIRST}")
def dist_dot(table):
    return _distance(table, "dot")


_KNN = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
d AS (SELECT t.vec_id, r.label, row_number() OVER (PARTITION BY t.vec_id ORDER BY round(list_distance(t.v, r.v), 9), r.vec_id) AS k FROM e t, e r WHERE t.vec_id % 3 = 0 AND r.vec_id % 3 <> 0),
n AS (SELECT vec_id, label, count(*) AS c FROM d WHERE k <= 3 GROUP BY ALL),
p AS (SELECT vec_id AS id, label AS predicted FROM n QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label DESC) = 1)"""


@query(f"{_KNN} SELECT id, predicted FROM p")
def knn_predict(table):
    """The majority label of the three nearest."""
    return ml.knn_predict(*_parts(table))


@query(f"{_KNN} SELECT round(avg((predicted = label)::INT), 6) AS accuracy FROM p JOIN embeddings ON id = vec_id")
def knn_accuracy(table):
    test, train = _parts(table)
    return ml.accuracy(ml.knn_predict(test, train).join(test, "id"), "label").select(F.round("accuracy", 6).alias("accuracy"))


@query(_KNN.replace("r.label,", "r.label / 4.0 AS label,").split(",\nn AS")[0] + " SELECT vec_id AS id, round(avg(label), 6) AS predicted FROM d WHERE k <= 3 GROUP BY vec_id")
def knn_mean(table):
    """Regression: the mean of the fractional labels of the three nearest."""
    test, train = _parts(table)
    out = ml.knn_mean(test, train.withColumn("label", F.col("label") / 4.0))
    return out.select("id", F.round("predicted", 6).alias("predicted"))


@query("""WITH s AS (SELECT l_returnflag AS flag, avg(l_quantity) AS m, stddev_pop(l_quantity) AS d FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, round(exp(-((l_quantity - m) ** 2) / (2 * d * d)) / (sqrt(2 * pi()) * d), 9) AS p FROM lineitem JOIN s ON l_returnflag = flag""")
def gauss_density(table):
    """The density of each quantity among those of its flag."""
    rows = table("lineitem")
    stats = rows.groupBy(F.col("l_returnflag").alias("flag")).agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("d"))
    out = rows.join(stats, F.col("l_returnflag") == F.col("flag"))
    return out.select("l_orderkey", "l_linenumber", F.round(ml.density(F.col("l_quantity"), F.col("m"), F.col("d")), 9).alias("p"))


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_NB = (
    "WITH s AS (SELECT l_returnflag AS c, count(*) AS n, "
    + ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in _FEATURES)
    + " FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1), g AS (SELECT rid, l_returnflag, c, ln(n / (SELECT sum(n) FROM s))"
    + "".join(f" - ({f} - m_{f}) ** 2 / (2 * s_{f} ** 2) - ln(s_{f})" for f in _FEATURES)
    + " AS score FROM (SELECT *, row_number() OVER () AS rid FROM lineitem), s WHERE l_orderkey % 3 = 0), p AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, c) = 1)"
)


def _bayes(table):
    rows = table("lineitem")
    return ml.nb_predict(rows.where("l_orderkey % 3 = 0"), rows.where("l_orderkey % 3 <> 0"), "l_returnflag", _FEATURES)


@query(f"{_NB} SELECT c AS predicted, l_returnflag, count(*) AS n FROM p GROUP BY ALL")
def nb_predict(table):
    """Predicted against actual class, counted."""
    return _bayes(table).groupBy("predicted", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_NB} SELECT round(avg((c = l_returnflag)::INT), 6) AS accuracy FROM p")
def nb_accuracy(table):
    return ml.accuracy(_bayes(table), "l_returnflag").select(F.round("accuracy", 6).alias("accuracy"))


@query("""SELECT p_partkey, round((p_size - (SELECT min(p_size) FROM part)) / (SELECT (max(p_size) - min(p_size))::DOUBLE FROM part), 6) AS p_size,
round((p_retailprice - (SELECT min(p_retailprice) FROM part)) / (SELECT max(p_retailprice) - min(p_retailprice) FROM part), 6) AS p_retailprice FROM part""")
def minmax_fit(table):
    """Bounds learnt, then applied."""
    out = ml.min_max_scaled(table("part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return out.select("p_partkey", F.round("p_size", 6).alias("p_size"), F.round("p_retailprice", 6).alias("p_retailprice"))
