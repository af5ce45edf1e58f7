import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from accesswatch.operators import model as M
from accesswatch.plans.diagnostics import diagnose
from accesswatch.plans.features import fit_encoders, load_encoders
from accesswatch.plans.scoring import score_batch, score_log
from accesswatch.plans.training import load_trained, train_models
from accesswatch.sources.rules import default_rules
from tests.conftest import log_rows


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(1200, 3))
    y = (x[:, 0] * 1.5 - x[:, 1] + draw.normal(scale=0.8, size=1200) > 0.9).astype(int)
    data = [(f"id{i}", *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "LogID string, a double, b double, c double, Anomalous int").cache()


def test_split_has_exact_shares_and_is_stable(rows):
    train, test = M.stratified_split(rows)
    n, positive = rows.count(), rows.where("Anomalous = 1").count()
    assert test.count() == math.ceil(0.2 * n) and train.count() + test.count() == n
    assert abs(test.where("Anomalous = 1").count() - 0.2 * positive) < 1
    again = M.stratified_split(rows.repartition(7))[1]
    assert test.select("LogID").exceptAll(again.select("LogID")).count() == 0


def test_split_keeps_copies_together(spark):
    copies = spark.range(900).select(
        F.when(F.col("id") < 300, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("LogID"), F.lit(1).alias("Anomalous")
    )
    train, test = M.stratified_split(copies)
    assert train.count() + test.count() == 900
    assert train.select("LogID").intersect(test.select("LogID")).count() == 0


def test_sizes_use_the_largest_remainder():
    assert M._test_sizes({0: 15, 1: 5}, 0.2) == {0: 3, 1: 1}
    assert M._test_sizes({0: 7, 1: 4}, 0.2) == {0: 2, 1: 1}
    assert M._test_sizes({}, 0.2) == {}


def newton_logistic(x, y, w, c):
    """Minimum of |b|^2 / 2 + c * weighted log loss, intercept not penalised."""
    z = np.hstack([x, np.ones((len(x), 1))])
    b, penalty = np.zeros(z.shape[1]), np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        gradient = penalty @ b + c * z.T @ (w * (p - y))
        hessian = penalty + c * (z * (w * p * (1 - p))[:, None]).T @ z
        b = b - np.linalg.solve(hessian, gradient)
    return b


def test_logistic_solves_the_penalised_problem(rows):
    data = rows.orderBy("LogID").toPandas()
    x = data[["a", "b", "c"]].to_numpy()
    x[:, 2] = (x[:, 2] - x[:, 2].mean()) / x[:, 2].std()
    expected = newton_logistic(x, data.Anomalous.to_numpy(), np.where(data.Anomalous == 1, 5.0, 1.0), 1.0)
    fitted = M.fit_logistic(rows, ["a", "b", "c"], scaled=("c",)).stages[-1]
    assert np.allclose([*fitted.coefficients.toArray(), fitted.intercept], expected, atol=1e-3)


def test_forest_and_explanations(rows, tmp_path):
    train, test = M.stratified_split(rows)
    names = ["a", "b", "c"]
    forest = M.fit_forest(train, names, trees=20, max_depth=6, scaled=())
    result = M.evaluate(M.predict(forest, test)).first()
    assert result.auc > 0.85 and result.recall > 0.6 and result.n == 240
    ranked = [r.feature for r in M.top_features(M.importances(forest, names)).collect()]
    assert ranked[0] == "a" and ranked[2] == "c"
    lost = {r.feature: r.importance for r in M.permutation_importance(forest, test, names).collect()}
    assert lost["a"] > lost["c"] and set(lost) == set(names)
    assert M.permutation_importance(forest, test, names, sample=100).count() == 3
    forest.write().overwrite().save(str(tmp_path / "forest"))
    models = M.load_models({"forest": str(tmp_path / "forest"), "boosted": str(tmp_path / "boosted")})
    assert list(models) == ["forest"]
    both = M.predict_with_models({**models, "again": forest}, test, keep=("LogID",))
    assert both.columns == ["LogID", "forest_predicted_anomaly", "again_predicted_anomaly"] and both.count() == 240
    counts = {r.model: r.n_anomalies for r in M.anomalies_per_model(both).collect()}
    assert counts["forest"] == counts["again"] > 0
    # An absent feature counts as 0.
    without = M.predict_with_models({"forest": forest}, test.drop("a"), keep=("LogID",))
    zero = M.predict_with_models({"forest": forest}, test.withColumn("a", F.lit(0.0)), keep=("LogID",))
    assert without.count() == 240 and without.exceptAll(zero).count() == 0


def test_a_model_without_probability(rows):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=["a", "b", "c"], outputCol="_features"),
              LinearSVC(featuresCol="_features", labelCol="Anomalous", maxIter=20)]
    scored = M.predict(Pipeline(stages=stages).fit(rows), rows)
    assert scored.where("(anomaly_score > 0) <> (predicted_anomaly = 1)").count() == 0


def test_top_features_of_two(rows):
    names = ["a", "b", "c"]
    forest = M.fit_forest(rows, names, trees=5, max_depth=4, scaled=())
    assert M.top_feature_union([M.importances(forest, names)] * 2, 2).count() == 2


def test_diagnostics(rows):
    found = diagnose(rows.withColumn("twin", F.col("a") * 2), trees=5, max_depth=4)
    pairs = {(r.feature_1, r.feature_2) for r in found.high_correlations.collect()}
    assert ("a", "twin") in pairs and ("a", "b") not in pairs
    assert found.evaluations["logistic"].first().auc > 0.85
    assert found.top_correlations.count() == found.top_features.count() ** 2


def labelled_log(spark, n=300):
    from datetime import datetime, timedelta

    start, roles = datetime(2024, 3, 4, 9), ["Admin", "Doctor", "Nurse", "Staff"]
    logs = []
    for i in range(n):
        bad = i % 5 == 0
        logs.append((
            f"log{i:04d}", i % 20, str(start + timedelta(seconds=40 * i)), "DELETE" if bad else "GET",
            "/patient/records/1234" if bad else "/lab/tests/7000", "8.8.8.8" if bad else "10.0.0.5", 200, roles[i % 4],
        ))
    return log_rows(spark, logs).withColumn("Anomalous", (F.col("HTTP_Method") == "DELETE").cast("int"))


def test_train_save_score(spark, tmp_path):
    folder, log = str(tmp_path / "models"), labelled_log(spark)
    trained = train_models(log, default_rules(), folder, trees=5, max_depth=4)
    assert M.evaluate(M.predict(trained.models["logistic"], trained.test)).first().f1 == 1.0
    encoders, model = load_trained(spark, folder, "random_forest")
    assert encoders.methods == ["DELETE", "GET"] and abs(encoders.mean_risk - 0.2) < 1e-12
    scored = score_log(log.drop("Anomalous"), default_rules(), encoders, model)
    assert scored.where("predicted_anomaly = 1").count() == 60 and scored.count() == 300
    # An unseen role fails by default and takes the overall risk when allowed.
    other = log.drop("Anomalous").withColumn("Role", F.lit("Visitor"))
    risk = score_log(other, default_rules(), encoders, model, unseen_role="keep").select("role_risk").distinct().collect()
    assert [round(r.role_risk, 12) for r in risk] == [0.2]
    # A repeated batch changes neither store.
    archive, results = str(tmp_path / "archive"), str(tmp_path / "results")
    for _ in range(2):
        score_batch(log, default_rules(), encoders, model, archive, results, "202403040900")
    assert spark.read.parquet(archive).count() == 300 and spark.read.parquet(results).count() == 300
    score_batch(log.limit(0), default_rules(), encoders, model, archive, results, "202403050900")
    assert spark.read.parquet(results).count() == 300


def test_encoders_round_trip(spark, tmp_path):
    log = labelled_log(spark)
    fitted = fit_encoders(log, coded_levels=(1, 2, 3))
    fitted.save(str(tmp_path / "enc"))
    loaded = load_encoders(spark, str(tmp_path / "enc"))
    assert sorted(map(tuple, loaded.levels[3].table.collect())) == [("1234", 0), ("7000", 1)]
    assert sorted(map(tuple, loaded.risk.collect())) == sorted(map(tuple, fitted.risk.collect()))
    assert loaded.roles.n_classes == 4


def test_weights_of_many_classes(spark):
    df = spark.range(3000).select((F.col("id") % 1500).cast("int").alias("Anomalous"))
    weights = M.balanced_weights(df)
    assert len(weights) == 1500 and set(weights.values()) == {1.0}
    weighed = df.select(M._weight({0: 2.0, 1499: 3.0}, "Anomalous").alias("w")).groupBy("w").count().collect()
    assert {r.w: r["count"] for r in weighed} == {1.0: 2996, 2.0: 2, 3.0: 2}
