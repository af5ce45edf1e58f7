"""Splitting, fitting, scoring and explaining classifiers."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from accesswatch.operators import forest
from accesswatch.operators.encoders import Scaler, fit_scaler
from accesswatch.operators.metrics import binary_metrics, roc_auc
from accesswatch.operators.quality import ratio
from accesswatch.session import checkpoint_dir
from accesswatch.sources.schemas import LABEL, MODEL_FEATURES, SCALED_FEATURES, model_input, with_defaults

# Weights and tree counts of the published models.
CLASS_WEIGHTS = {0: 1.0, 1: 5.0}
TREES = 200
DIAGNOSTIC_TREES = 100
SEED = 42
#: Up to so many rows are fitted one by one; of more, equal ones are counted first and fitted by their number.
ROWS_ONE_BY_ONE = 200_000


# --- splitting -----------------------------------------------------------------------


def _spread(event_id: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(event_id).cast("string"), F.lit(f":{seed}")))


def _test_sizes(totals: dict, test_size: float) -> dict:
    """Rows of each class for the test side: proportional, largest remainders first."""
    n = sum(totals.values())
    wanted = math.ceil(test_size * n)
    shares = {c: wanted * k / n for c, k in totals.items()} if n else {}
    sizes = {c: math.floor(s) for c, s in shares.items()}
    order = sorted(shares, key=lambda c: (-(shares[c] - sizes[c]), str(c)))
    for c in order[: wanted - sum(sizes.values())]:
        sizes[c] += 1
    return sizes


def split_cuts(df: DataFrame, label: str = LABEL, test_size: float = 0.2, event_id: str = "LogID", seed: int = SEED) -> dict:
    """Per class the largest hash that still belongs to the test side.

    Found digit by digit: each pass counts the rows per class and next hash
    digits inside the block that holds the cut. A pass shuffles counts, never
    rows, and a few passes settle any number of rows.
    """
    hashed = df.select(F.col(label).alias("c"), _spread(event_id, seed).alias("h")).where("c is not null")
    totals = {r.c: r.n for r in hashed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    left = _test_sizes(totals, test_size)
    prefix = {c: "" for c, k in left.items() if k > 0}
    cuts = {c: "" for c, k in left.items() if k == 0}
    # Blocks per pass that reach the driver: 65 536 for each of a few classes, 256 for each of many.
    digits = 4 if len(prefix) <= 16 else 2
    while prefix:
        inside = F.lit(False)
        for c, p in prefix.items():
            inside = inside | ((F.col("c") == F.lit(c)) & F.col("h").startswith(p))
        depth = len(next(iter(prefix.values()))) + digits
        blocks = hashed.where(inside).groupBy("c", F.substring("h", 1, depth).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        found: dict = {}
        for row in blocks.collect():
            found.setdefault(row.c, []).append((row.b, row.n))
        for c in list(prefix):
            for block, n in sorted(found[c]):
                if n >= left[c]:
                    break
                left[c] -= n
            if n == left[c] or depth >= 32:
                cuts[c] = block + "g"  # after every hash of the block
                del prefix[c]
            else:
                prefix[c] = block
    return cuts


def stratified_split(
    df: DataFrame, label: str = LABEL, test_size: float = 0.2, event_id: str = "LogID", seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with the exact share of each class.

    A row's side depends only on its id and class, so it survives retries; rows
    that repeat an id stay together. Rows without a label are in neither side.
    """
    cuts = split_cuts(df, label, test_size, event_id, seed)
    in_test = F.lit(False)
    for c, cut in cuts.items():
        in_test = in_test | ((F.col(label) == F.lit(c)) & (_spread(event_id, seed) <= F.lit(cut)))
    labelled = df.where(F.col(label).isNotNull())
    return labelled.where(~in_test), labelled.where(in_test)


# --- fitting -------------------------------------------------------------------------


def balanced_weights(df: DataFrame, label: str = LABEL) -> dict[float, float]:
    """n / (classes * n of the class), of every class."""
    return _balanced(_class_counts(df, label))


def _class_counts(df: DataFrame, label: str) -> dict[float, int]:
    return {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}


def _balanced(counts: dict[float, int]) -> dict[float, float]:
    n = sum(counts.values())
    return {c: n / (len(counts) * k) for c, k in counts.items()}


def _weight(weights: dict[int, float], label: str) -> Column:
    """Weight of the row's class; 1 for classes without one."""
    if not weights:
        return F.lit(1.0)
    table = F.map_from_arrays(F.lit([float(c) for c in weights]), F.lit([float(w) for w in weights.values()]))
    return F.coalesce(F.try_element_at(table, F.col(label).cast("double")), F.lit(1.0))


def _scaling_stage(scaler: Scaler) -> SQLTransformer:
    columns = ", ".join(
        f"(CAST(`{n}` AS DOUBLE) - ({float(m)!r}D)) / {float(scaler.std[n])!r}D AS `_scaled_{n}`"
        for n, m in scaler.mean.items()
    )
    return SQLTransformer(statement=f"SELECT *{', ' + columns if columns else ''} FROM __THIS__")


def _fit(classifier, train: DataFrame, features, label: str, weights: dict[int, float], scaled, n_rows: int) -> PipelineModel:
    names = [c for c in scaled if c in features]
    scaler = fit_scaler(train, names) if names else Scaler({}, {})
    inputs = [f"_scaled_{c}" if c in scaler.mean else c for c in features]
    stages = [
        _scaling_stage(scaler),
        VectorAssembler(inputCols=inputs, outputCol="_features"),
        classifier.setFeaturesCol("_features").setLabelCol(label).setWeightCol("_weight"),
    ]
    rows, weight = model_input(train, features, label), _weight(weights, label)
    counted = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("_n")) if n_rows > ROWS_ONE_BY_ONE else None
    if counted is not None and isinstance(classifier, LogisticRegression):
        return Pipeline(stages=stages).fit(counted.withColumn("_weight", weight * F.col("_n")))
    if counted is not None:
        fitted = forest.fit(classifier, stages[0].transform(counted), inputs, label, "_n", weights)
        if fitted is not None:
            return PipelineModel([*stages[:2], fitted])
    return Pipeline(stages=stages).fit(rows.withColumn("_weight", weight))


def fit_logistic(
    train: DataFrame, features=MODEL_FEATURES, label: str = LABEL, weights: dict[int, float] | None = None,
    c: float = 1.0, max_iter: int = 1000, scaled=SCALED_FEATURES,
) -> PipelineModel:
    """L2 logistic regression; ``c`` weighs the summed loss against the penalty."""
    weights = CLASS_WEIGHTS if weights is None else weights
    total, n = train.agg(F.sum(_weight(weights, label)), F.count(F.lit(1))).first()
    model = LogisticRegression(
        regParam=1.0 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=max_iter
    )
    return _fit(model, train, features, label, weights, scaled, n)


def fit_forest(
    train: DataFrame, features=MODEL_FEATURES, label: str = LABEL, trees: int = TREES, max_depth: int = 30,
    seed: int = SEED, scaled=SCALED_FEATURES,
) -> PipelineModel:
    """Random forest with balanced classes and square-root feature subsets."""
    counts = _class_counts(train, label)
    checkpoint_dir(train.sparkSession)  # node assignments of deep trees are checkpointed there
    model = RandomForestClassifier(
        numTrees=trees, maxDepth=max_depth, featureSubsetStrategy="sqrt", seed=seed, cacheNodeIds=True
    )
    return _fit(model, train, features, label, _balanced(counts), scaled, sum(counts.values()))


# --- scoring -------------------------------------------------------------------------


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``predicted_anomaly`` and ``anomaly_score``; the row keeps all its columns.

    The score is the probability of an anomaly, or the decision value of a model without probabilities.
    """
    out = model.transform(df)
    score = "probability" if "probability" in out.columns else "rawPrediction"
    return out.withColumns(
        {"predicted_anomaly": F.col("prediction").cast("int"), "anomaly_score": vector_to_array(F.col(score))[1]}
    ).select(*[c for c in df.columns if c not in ("predicted_anomaly", "anomaly_score")], "predicted_anomaly", "anomaly_score")


def load_models(paths: dict[str, str]) -> dict[str, PipelineModel]:
    """Saved models by name; missing ones are left out."""
    found = {}
    for name, path in paths.items():
        try:
            found[name] = PipelineModel.load(path)
        except Exception as error:  # the loader reports a missing path in several ways
            if not _is_missing(error):
                raise
    return found


def _is_missing(error: Exception) -> bool:
    if isinstance(error, AnalysisException):
        return error.getCondition() == "PATH_NOT_FOUND"
    return "does not exist" in str(error) or "PATH_NOT_FOUND" in str(error)


def predict_with_models(models: dict[str, PipelineModel], df: DataFrame, keep=("LogID", "Timestamp")) -> DataFrame:
    """One prediction column per model beside the kept columns: no join, no index.

    A feature that a model takes and the rows do not have counts as 0.
    """
    names = {}
    for name, model in models.items():
        names[name] = column = f"{name}_predicted_anomaly"
        filled = with_defaults(df, input_names(model))
        df = predict(model, filled).withColumnRenamed("predicted_anomaly", column).drop("anomaly_score")
    return df.select(*keep, *names.values())


def input_names(model: PipelineModel) -> list[str]:
    """Features a fitted pipeline takes, in its order."""
    (assembler,) = [s for s in model.stages if isinstance(s, VectorAssembler)]
    return [c.removeprefix("_scaled_") for c in assembler.getInputCols()]


def anomalies_per_model(predictions: DataFrame) -> DataFrame:
    columns = [c for c in predictions.columns if c.endswith("_predicted_anomaly")]
    row = predictions.agg(*[F.count_if(F.col(c) == 1).alias(c) for c in columns])
    cells = [F.struct(F.lit(c.removesuffix("_predicted_anomaly")).alias("model"), F.col(c).alias("n_anomalies")) for c in columns]
    return row.select(F.explode(F.array(*cells)).alias("m")).select("m.*")


def evaluate(scored: DataFrame, label: str = LABEL) -> DataFrame:
    """Cells, rates and the area under the ROC curve as one row. Rows are scored once, whatever the model costs."""
    checkpoint_dir(scored.sparkSession)
    scored = scored.select(label, "predicted_anomaly", "anomaly_score").checkpoint()
    rates = binary_metrics(scored, label, "predicted_anomaly")
    return rates.withColumn("auc", roc_auc(scored, label, "anomaly_score").scalar())


# --- explaining ----------------------------------------------------------------------


def importances(model: PipelineModel, features=MODEL_FEATURES, signed: bool = False) -> DataFrame:
    """Impurity importance of a forest, absolute coefficient of a logistic model."""
    spark = SparkSession.active()
    fitted = model.stages[-1]
    if hasattr(fitted, "featureImportances"):
        values = fitted.featureImportances.toArray()
    else:
        values = fitted.coefficients.toArray()
    rows = [(n, float(v) if signed else abs(float(v))) for n, v in zip(features, values)]
    return spark.createDataFrame(rows, "feature string, importance double")


def top_features(table: DataFrame, n: int = 15) -> DataFrame:
    return table.orderBy(F.abs("importance").desc(), "feature").limit(n)


def top_feature_union(tables: list[DataFrame], n: int = 10) -> DataFrame:
    """Names among the first n of any table, each once."""
    tops = [top_features(t, n).select("feature") for t in tables]
    out = tops[0]
    for t in tops[1:]:
        out = out.union(t)
    return out.distinct()


def permutation_importance(
    model: PipelineModel, scored_input: DataFrame, features=MODEL_FEATURES, label: str = LABEL,
    event_id: str = "LogID", sample: int | None = None, block_rows: int = 100_000, seed: int = SEED,
) -> DataFrame:
    """Accuracy lost when one feature is exchanged between rows.

    Rows are dealt into blocks by a hash of their id and each takes the features
    of the next row of its block (of about ``block_rows`` rows), which permutes
    every feature over all rows with one shuffle. ``sample`` restricts the explanation to the rows with the
    smallest hashes. Expects unique ids.
    """
    rows = scored_input.select(
        F.col(event_id).alias("_id"), F.col(label).cast("int").alias("_y"), *features
    ).withColumn("_h", F.xxhash64(F.col("_id").cast("string"), F.lit(seed)))
    if sample is not None:
        rows = rows.orderBy("_h", "_id").limit(sample)
    blocks = max(1, (sample or scored_input.count()) // block_rows)
    w = Window.partitionBy("_block").orderBy("_h", "_id")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.struct(*features)
    paired = rows.withColumn("_block", F.pmod("_h", F.lit(blocks))).withColumn(
        "_other", F.coalesce(F.lead(own).over(w), F.first(own).over(whole))
    )
    variants = [F.struct(F.lit(None).cast("string").alias("feature"), *[F.col(f) for f in features])]
    for changed in features:
        values = [F.col(f"_other.{f}").alias(f) if f == changed else F.col(f) for f in features]
        variants.append(F.struct(F.lit(changed).alias("feature"), *values))
    long = paired.select("_y", F.explode(F.array(*variants)).alias("v")).select("_y", "v.*")
    hits = (
        predict(model, long)
        .groupBy("feature")
        .agg(F.count_if(F.col("predicted_anomaly") == F.col("_y")).alias("hits"), F.count(F.lit(1)).alias("n"))
        .select("feature", ratio(F.col("hits"), F.col("n")).alias("accuracy"))
    )
    base = F.max(F.when(F.col("feature").isNull(), F.col("accuracy"))).over(Window.partitionBy())
    return hits.withColumn("importance", base - F.col("accuracy")).where("feature is not null").select("feature", "importance")
