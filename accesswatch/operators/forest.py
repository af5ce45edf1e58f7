"""Random forests over distinct feature vectors: rows collapse before they are drawn, split and counted.

The method, limits and pruning are those of Spark's ``RandomForestClassifier``, and so is the fitted model. Spark draws each
row for each tree and reads all rows again for every level. Here a vector with n rows of a class is drawn Poisson(n) times, which
is what n draws of Poisson(1) add up to; a tree then costs as much as there are distinct vectors, whatever the number of rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accesswatch.session import checkpoint_dir

#: Vectors that a task holds at most; more are left to Spark's own forest.
MOST_VECTORS = 250_000
MOST_CLASSES = 100
#: Nodes whose histograms a task holds at once.
NODES = 4096
#: An impurity this small is that of a pure node, as in Spark.
PURE = 2.0**-52

_SPLIT = "struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>"
NODE = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, "
    f"rawCount: bigint, gain: double, leftChild: int, rightChild: int, split: {_SPLIT}>"
)
_OWN_PARAMS = ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")  # of the forest, not of its trees


def split_points(values: np.ndarray, weights: np.ndarray, most: int) -> np.ndarray:
    """Thresholds of a feature: between all its values, or ``most`` at about equal weights, chosen as Spark does."""
    found, place = np.unique(values, return_inverse=True)
    between = (found[1:] + found[:-1]) / 2
    if len(between) <= most:
        return between
    upto = np.cumsum(np.bincount(place, weights))
    stride = upto[-1] / (most + 1)
    chosen, target = [], stride
    for i in range(1, len(found)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            chosen.append(between[i - 1])
            target += stride
    return np.array(chosen)


def _best_splits(bins, node, weighed, drawn, stats, raws, chosen, n_bins):
    """Gain, feature and last bin on the left of the best split of each node; rows are in the order of their nodes."""
    m, classes = stats.shape
    total = stats.sum(1)
    impurity = 1 - ((stats / total[:, None]) ** 2).sum(1)
    gain, feature, last = np.full(m, -np.inf), np.full(m, -1), np.zeros(m, np.int64)
    rows, nodes = np.arange(len(node)), np.arange(m)
    for j in range(chosen.shape[1]):
        own = chosen[:, j]
        cell = node * n_bins + bins[rows, own[node]]
        left = np.stack([np.bincount(cell, weighed[:, k], m * n_bins) for k in range(classes)], -1)
        left = left.reshape(m, n_bins, classes).cumsum(1)[:, :-1]
        left_raw = np.bincount(cell, drawn, m * n_bins).reshape(m, n_bins).cumsum(1)[:, :-1]
        right = stats[:, None, :] - left
        lw, rw = left.sum(2), right.sum(2)
        with np.errstate(all="ignore"):
            li = 1 - ((left / lw[..., None]) ** 2).sum(2)
            ri = 1 - ((right / rw[..., None]) ** 2).sum(2)
            found = impurity[:, None] - lw / total[:, None] * li - rw / total[:, None] * ri
        found = np.where((left_raw >= 1) & (raws[:, None] - left_raw >= 1), found, -np.inf)
        at = found.argmax(1)
        best = found[nodes, at]
        better = best > gain
        gain, feature, last = np.where(better, best, gain), np.where(better, own, feature), np.where(better, at, last)
    return gain, feature, last


def grow(bins: np.ndarray, n_bins: int, counts: np.ndarray, weights: np.ndarray, subset: int, depth: int, rng) -> dict[str, np.ndarray]:
    """One tree, level by level, as columns of its nodes; ``left`` is -1 at a leaf, and the right child comes after the left."""
    rows = np.flatnonzero(counts.any(1))
    bins, drawn = bins[rows], counts[rows].sum(1).astype(float)
    weighed = counts[rows] * weights
    classes, features = len(weights), bins.shape[1]
    node = np.zeros(len(rows), np.int64)
    stats, raws = weighed.sum(0, keepdims=True), drawn.sum(keepdims=True)
    parts: dict[str, list] = {k: [] for k in ("stats", "raw", "gain", "feature", "bin", "left")}
    known = 1
    for level in range(depth + 1):
        m = len(stats)
        gain, feature, last = np.full(m, -np.inf), np.full(m, -1), np.zeros(m, np.int64)
        if level < depth and len(rows):
            chosen = np.argsort(rng.random((m, features)), 1)[:, :subset]
            for a in range(0, m, NODES):
                b = min(a + NODES, m)
                x, y = np.searchsorted(node, (a, b))
                gain[a:b], feature[a:b], last[a:b] = _best_splits(
                    bins[x:y], node[x:y] - a, weighed[x:y], drawn[x:y], stats[a:b], raws[a:b], chosen[a:b], n_bins
                )
        impure = 1 - ((stats / np.maximum(stats.sum(1), 1e-300)[:, None]) ** 2).sum(1) >= PURE
        split = np.flatnonzero(impure & (gain > 0))
        left = np.full(m, -1)
        left[split] = known + 2 * np.arange(len(split))
        known += 2 * len(split)
        for k, v in zip(parts, (stats, raws, gain, feature, last, left)):
            parts[k].append(v)
        if not len(split):
            break
        rank = np.full(m, -1)
        rank[split] = np.arange(len(split))
        keep = rank[node] >= 0
        node, bins, weighed, drawn = node[keep], bins[keep], weighed[keep], drawn[keep]
        to = 2 * rank[node] + (bins[np.arange(len(node)), feature[node]] > last[node])
        order = np.argsort(to, kind="stable")
        node, bins, weighed, drawn = to[order], bins[order], weighed[order], drawn[order]
        m = 2 * len(split)
        stats = np.stack([np.bincount(node, weighed[:, k], m) for k in range(classes)], 1)
        raws = np.bincount(node, drawn, m)
    return pruned({k: np.concatenate(v) for k, v in parts.items()})


def pruned(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Two leaves with one prediction become one leaf, from the bottom up; what is left is numbered anew."""
    left, prediction = tree["left"].copy(), tree["stats"].argmax(1)
    for i in range(len(left) - 1, -1, -1):  # children come after their parent
        a = left[i]
        if a >= 0 and left[a] < 0 and left[a + 1] < 0 and prediction[a] == prediction[a + 1]:
            prediction[i], left[i] = prediction[a], -1
    live = np.zeros(len(left), bool)
    live[0] = True
    for i in range(len(left)):
        if live[i] and left[i] >= 0:
            live[left[i]] = live[left[i] + 1] = True
    number = np.cumsum(live) - 1
    tree = {k: v[live] for k, v in tree.items()} | {"prediction": prediction[live]}
    kept = left[live]
    tree["left"] = np.where(kept >= 0, number[np.maximum(kept, 0)], -1)
    return tree


def _as_nodes(tree: dict[str, np.ndarray], number: int, thresholds: list[np.ndarray]) -> Iterator[dict]:
    """Rows of Spark's saved form of a tree."""
    total = tree["stats"].sum(1)
    impurity = 1 - ((tree["stats"] / np.maximum(total, 1e-300)[:, None]) ** 2).sum(1)
    for i, left in enumerate(tree["left"].tolist()):
        leaf, f = left < 0, int(tree["feature"][i])
        split = {
            "featureIndex": -1 if leaf else f,
            "leftCategoriesOrThreshold": [] if leaf else [float(thresholds[f][tree["bin"][i]])], "numCategories": -1,
        }
        yield {"treeID": number, "nodeData": {
            "id": i, "prediction": float(tree["prediction"][i]), "impurity": float(impurity[i]),
            "impurityStats": tree["stats"][i].tolist(), "rawCount": int(tree["raw"][i]),
            "gain": -1.0 if leaf else float(tree["gain"][i]), "leftChild": left, "rightChild": -1 if leaf else left + 1, "split": split,
        }}


def _arrow_schema() -> pa.Schema:
    split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
    node = pa.struct([
        ("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
        ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", split),
    ])
    return pa.schema([("treeID", pa.int32()), ("nodeData", node)])


def vectors(counted: DataFrame, inputs: list[str], label: str, number: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Distinct vectors in a fixed order and their rows per class; None if there are too many or Spark would refuse some."""
    row = counted.select(*[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(inputs)], F.col(label).cast("double").alias("y"), F.col(number).alias("n"))
    table = row.limit(2 * MOST_VECTORS + 1).toArrow()
    if not 0 < table.num_rows <= 2 * MOST_VECTORS or any(c.null_count for c in table.columns):
        return None
    x = np.stack([table[f"f{i}"].to_numpy() for i in range(len(inputs))], 1) + 0.0
    y, n = table["y"].to_numpy(), table["n"].to_numpy()
    if not np.isfinite(x).all() or (y != np.floor(y)).any() or y.min() < 0 or y.max() >= MOST_CLASSES:
        return None
    found, place = np.unique(x, axis=0, return_inverse=True)
    if len(found) > MOST_VECTORS:
        return None
    counts = np.zeros((len(found), int(max(y.max(), 1)) + 1), np.int64)
    np.add.at(counts, (place.ravel(), y.astype(np.int64)), n)
    return found, counts


def fit(classifier: RandomForestClassifier, counted: DataFrame, inputs: list[str], label: str, number: str, weights: dict) -> RandomForestClassificationModel | None:
    """The forest of rows given as ``number`` of each vector and label; None where ``vectors`` has nothing for it.

    Vectors are sent to the tasks, each of which grows some of the trees; trees go to files in Spark's own form, so that none
    passes through Python on the driver. A tree depends on the seed, its number and the counts, not on the partitions.
    """
    own = vectors(counted, inputs, label, number)
    if own is None:
        return None
    spark = counted.sparkSession
    x, counts = own
    given = {p.name: v for p, v in classifier.extractParamMap().items()}
    trees, depth, seed = given["numTrees"], given["maxDepth"], given["seed"]
    by_class = np.array([float(weights.get(c, 1.0)) for c in range(counts.shape[1])])
    thresholds = [split_points(x[:, j], counts @ by_class, given["maxBins"] - 1) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(t, x[:, j]) for j, t in enumerate(thresholds)], 1).astype(np.uint8 if given["maxBins"] <= 256 else np.int32)
    n_bins, subset = max(1, *map(len, thresholds)) + 1, int(np.ceil(np.sqrt(x.shape[1])))
    sent = spark.sparkContext.broadcast((bins, counts, by_class, thresholds))

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _arrow_schema()
        for batch in batches:
            for number in batch.column(0).to_pylist():
                bins, counts, by_class, thresholds = sent.value
                rng = np.random.default_rng([seed % 2**63, number])
                tree = grow(bins, n_bins, rng.poisson(counts), by_class, subset, depth, rng)
                yield pa.RecordBatch.from_pylist(list(_as_nodes(tree, number, thresholds)), schema=schema)

    numbers = spark.range(0, trees, 1, min(trees, 4 * spark.sparkContext.defaultParallelism))
    nodes = numbers.mapInArrow(grown, NODE)
    folder = f"{checkpoint_dir(spark)}/forest-{uuid.uuid4().hex}"
    nodes.write.parquet(f"{folder}/data")
    sent.unpersist()
    _write_metadata(spark, classifier, folder, trees, x.shape[1], len(by_class))
    return RandomForestClassificationModel.load(folder)


def _write_metadata(spark: SparkSession, classifier, folder: str, trees: int, n_features: int, n_classes: int) -> None:
    """What Spark saves beside the nodes of a forest."""
    params = {p.name: v for p, v in classifier._paramMap.items()}
    defaults = {p.name: v for p, v in classifier._defaultParamMap.items()}
    base = {"timestamp": 0, "sparkVersion": spark.version}
    kind = "org.apache.spark.ml.classification."
    of_forest = base | {
        "class": f"{kind}RandomForestClassificationModel", "uid": classifier.uid, "paramMap": params, "defaultParamMap": defaults,
        "numFeatures": n_features, "numClasses": n_classes, "numTrees": trees,
    }
    of_tree = base | {
        "class": f"{kind}DecisionTreeClassificationModel", "uid": "", **{
            k: {n: v for n, v in x.items() if n not in _OWN_PARAMS} for k, x in (("paramMap", params), ("defaultParamMap", defaults))
        },
    }
    one = spark.range(1)
    one.select(F.lit(json.dumps(of_forest)).alias("value")).coalesce(1).write.text(f"{folder}/metadata")
    texts = spark.range(0, trees, 1, 1).select(
        F.col("id").cast("int").alias("_1"),
        F.replace(F.lit(json.dumps(of_tree)), F.lit('"uid": ""'), F.concat(F.lit(f'"uid": "dtc_{uuid.uuid4().hex[:8]}'), F.col("id").cast("string"), F.lit('"'))).alias("_2"),
        F.lit(1.0).alias("_3"),
    )
    texts.write.parquet(f"{folder}/treesMetadata")
