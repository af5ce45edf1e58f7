"""Quality classifier by compression: which dictionary, of good or of bad text, shortens a text more."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accesswatch.llm.common import text_or_empty

#: Bytes compressed at a time. A long text would else become its own dictionary.
CHUNK = 2048


@dataclass
class QualityModel:
    """Two dictionaries and the logistic surface over the size differences."""

    good: bytes
    bad: bytes
    slopes: tuple[float, float] = (1.0, 0.0)
    offset: float = 0.0

    def differences(self, texts: list[str]) -> np.ndarray:
        """For each whole text, summed over its chunks: (bad size - good size) / (bad size + good size), at most 0.25 either
        way as copies of a sample would else stand out, and what both
        dictionaries save of its bytes, 0 to 1: text that repeats itself is short under either."""
        sizes = []
        for held in (self.bad, self.good):
            kept = zstandard.ZstdCompressionDict(held, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=3)
            sizes.append(
                zstandard.ZstdCompressor(
                    dict_data=kept, level=3, write_checksum=False, write_content_size=False, write_dict_id=False
                ).compress
            )
        bad, good, out = *sizes, np.zeros((len(texts), 2))
        for row, text in zip(out, texts):
            data = text.encode()
            chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
            if chunks:
                b, g = sum(len(bad(c)) for c in chunks), sum(len(good(c)) for c in chunks)
                row[:] = max(-0.25, min(0.25, (b - g) / (b + g))), max(0.0, 1 - (b + g) / 2 / len(data))
        return out

    def scores(self, texts: list[str]) -> list[float]:
        return [_logistic(float(z)) for z in self.differences(texts) @ np.array(self.slopes) + self.offset]


def _logistic(z: float) -> float:
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def _calibrated(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[tuple[float, float], float]:
    """Slopes and offset of a logistic fit, both classes weighing alike, moved to the prior. Newton's steps."""
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    middle = np.median(x, axis=0)
    design = np.column_stack([(x - middle) / scale, np.ones(len(x))])
    # The fewer rows, the flatter the fit: they say less about the rest.
    beta, ridge = np.zeros(3), np.array([1.0, 1.0, 1e-6]) * (1e-3 + 0.5 / len(y))

    def loss(b: np.ndarray) -> float:
        z = design @ b
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge @ (b * b) / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (p - y)) + ridge * beta
        step = np.linalg.solve(design.T @ (design * (weight * p * (1 - p))[:, None]) + np.diag(ridge), slope)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    slopes = beta[:2] / scale
    return tuple(slopes.tolist()), float(beta[2] - slopes @ middle + math.log(prior / (1 - prior)))



def _dictionary(texts: list[str], size: int) -> bytes:
    """The parts of the texts that repay most, by zstandard's trainer; the texts' ends if it finds too little."""
    samples = [t.encode() for t in texts if t]
    try:
        return zstandard.train_dictionary(size, samples, d=8, k=256, steps=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b"\n"


def fit_quality(
    documents: DataFrame, labels: DataFrame, sample: int = 3000, window: int = 4096, size: int = 524_288
) -> QualityModel | float:
    """A model from labelled rows: ``documents`` (doc_id, text) and ``labels`` (doc_id, label 1 or 0).

    Of each class, the ``sample`` documents of least hashed id are taken, and of each a stretch of up to ``window``
    characters at a hashed place: what reaches the driver is bounded by both parameters. Three quarters of a class make
    its dictionary, the rest the fit (under four documents make both); the share of each class among all labels is the prior. With labels of one class
    only, or none, the result is a constant score. Null labels and ids are left out.
    """
    known = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    total = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = (total.get(1, 0) + 1) / (sum(total.values()) + 2)
    if len(total) < 2:
        return prior
    order = F.xxhash64("doc_id", F.lit("sample"))
    # ``sample`` rows a class at most: small enough to send to every task.
    taken = known.where("label = 1").orderBy(order).limit(sample).unionByName(
        known.where("label = 0").orderBy(order).limit(sample)
    )
    place = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.lit(1), F.length("text") - window + 1))
    rows = (
        documents.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(taken), "doc_id")
        .select("label", F.xxhash64("doc_id", F.lit("use")).alias("use"),
                F.col("text").substr((place + 1).cast("int"), F.lit(window)).alias("text"))
        .collect()
    )
    held, rest = [], []
    for label in (1, 0):
        own = sorted((r for r in rows if r.label == label), key=lambda r: (r.use, r.text))
        few = len(own) < 4
        held.append(_dictionary([r.text for i, r in enumerate(own) if few or i % 4], size))
        rest += [r for i, r in enumerate(own) if few or not i % 4]
    model = QualityModel(*held)
    y = np.array([r.label for r in rest], float)
    if len(set(y)) < 2:
        return prior
    model.slopes, model.offset = _calibrated(model.differences([r.text for r in rest]), y, prior)
    return model


def quality_score(text: Column, model: QualityModel | float, spark) -> Column:
    """Score from 0 to 1 of each whole text, null as empty. An empty text has no differences: the fit at zero."""
    if isinstance(model, float):
        return F.lit(model)
    shared = spark.sparkContext.broadcast(model)

    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(shared.value.scores(part.tolist()), dtype="float64")

    score.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(F.coalesce(text.cast("string"), F.lit("")))
