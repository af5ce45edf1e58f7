import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from accesswatch.operators import forest, model as M

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    """4000 rows of at most 210 vectors; the label follows a and b, with noise."""
    draw = np.random.default_rng(3)
    x = np.stack([draw.integers(0, 7, 4000), draw.integers(0, 5, 4000), draw.integers(0, 6, 4000)], 1)
    y = (x[:, 0] + 2 * x[:, 1] + draw.normal(scale=2, size=4000) > 8).astype(int)
    data = [(f"id{i}", *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "LogID string, a double, b double, c double, Anomalous int").cache()


def test_a_tree_of_counted_vectors_is_that_of_all_rows(rows):
    """Without draws and with all features: the nodes of Spark's tree over single rows."""
    weights = {0: 1.0, 1: 3.0}
    counted = rows.groupBy(*NAMES, "Anomalous").agg(F.count(F.lit(1)).alias("n"))
    x, counts = forest.vectors(counted, NAMES, "Anomalous", "n")
    assert counts.sum() == 4000 and len(x) <= 210
    by_class = np.array([weights[0], weights[1]])
    cuts = [forest.split_points(x[:, j], counts @ by_class, 31) for j in range(3)]
    bins = np.stack([np.searchsorted(t, x[:, j]) for j, t in enumerate(cuts)], 1)
    tree = forest.grow(bins, max(map(len, cuts)) + 1, counts, by_class, 3, 4, np.random.default_rng(1))
    weighed = rows.withColumn("w", M._weight(weights, "Anomalous"))
    inputs = VectorAssembler(inputCols=NAMES, outputCol="v").transform(weighed)
    spark_tree = DecisionTreeClassifier(featuresCol="v", labelCol="Anomalous", weightCol="w", maxDepth=4).fit(inputs)
    assert len(tree["left"]) == spark_tree.numNodes and tree["raw"][0] == 4000
    found = {tuple(r.v): r.p for r in spark_tree.transform(inputs).select("v", F.col("prediction").alias("p")).distinct().collect()}
    for vector, b in zip(x, bins):
        at = 0
        while tree["left"][at] >= 0:
            at = tree["left"][at] + int(b[tree["feature"][at]] > tree["bin"][at])
        assert found[tuple(vector)] == tree["prediction"][at]


def test_forest_of_counted_rows(rows, tmp_path, monkeypatch):
    """As good as Spark's, the same on any partitions (Spark's draws are not), and saved and loaded as Spark's."""
    single = M.fit_forest(rows, NAMES, trees=30, max_depth=8, scaled=("a",))
    monkeypatch.setattr(M, "ROWS_ONE_BY_ONE", 1000)
    models = [M.fit_forest(rows.repartition(n), NAMES, trees=30, max_depth=8, scaled=("a",)) for n in (3, 7)]
    first, second = [M.importances(m, NAMES).collect() for m in models]
    assert first == second
    assert [r.importance for r in first] == pytest.approx([r.importance for r in M.importances(single, NAMES).collect()], abs=0.05)
    scores = [M.evaluate(M.predict(m, rows)).first() for m in (single, models[0])]
    assert scores[0].accuracy == pytest.approx(scores[1].accuracy, abs=0.02) and scores[0].auc == pytest.approx(scores[1].auc, abs=0.02)
    fitted = models[0].stages[-1]
    assert fitted.getNumTrees == 30 and fitted.numClasses == 2 and fitted.getOrDefault("maxDepth") == 8
    assert 0.6 < fitted.totalNumNodes / single.stages[-1].totalNumNodes < 1.6
    models[0].write().overwrite().save(str(tmp_path / "forest"))
    again = M.load_models({"forest": str(tmp_path / "forest")})["forest"]
    columns = ["LogID", "predicted_anomaly", "anomaly_score"]
    assert M.predict(again, rows).select(columns).exceptAll(M.predict(models[0], rows).select(columns)).count() == 0


def test_logistic_of_counted_rows(rows, monkeypatch):
    single = M.fit_logistic(rows, NAMES, scaled=("c",)).stages[-1]
    monkeypatch.setattr(M, "ROWS_ONE_BY_ONE", 1000)
    counted = M.fit_logistic(rows, NAMES, scaled=("c",)).stages[-1]
    assert np.allclose(single.coefficients.toArray(), counted.coefficients.toArray(), atol=1e-3)
    assert counted.intercept == pytest.approx(single.intercept, abs=1e-3)


def test_rows_left_to_spark(rows, monkeypatch):
    """Too many vectors, and values or labels that Spark refuses, go the way of single rows."""
    counted = rows.groupBy(*NAMES, "Anomalous").agg(F.count(F.lit(1)).alias("n"))
    for other in (counted.withColumn("a", F.lit(None).cast("double")), counted.withColumn("b", F.lit(float("nan"))),
                  counted.withColumn("Anomalous", F.lit(-1)), counted.withColumn("Anomalous", F.lit(0.5)), counted.where("false")):
        assert forest.vectors(other, NAMES, "Anomalous", "n") is None
    monkeypatch.setattr(forest, "MOST_VECTORS", 20)
    assert forest.vectors(counted, NAMES, "Anomalous", "n") is None
    monkeypatch.setattr(M, "ROWS_ONE_BY_ONE", 1000)
    assert M.fit_forest(rows, NAMES, trees=3, max_depth=3, scaled=()).stages[-1].getNumTrees == 3


def test_split_points_by_weight():
    values = np.arange(100.0)
    cuts = forest.split_points(values, np.ones(100), 9)
    assert len(cuts) == 9 and np.allclose(np.diff(cuts), 10)
    assert len(forest.split_points(values[:1], np.ones(1), 9)) == 0


def test_rows_are_scored_once_to_be_evaluated(rows):
    scored = M.predict(M.fit_logistic(rows, NAMES, scaled=()), rows)
    found = M.evaluate(scored)
    assert "UDF" in scored._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.first().n == 4000 and found.first().auc > 0.8
