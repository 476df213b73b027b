"""Small models fitted group by group with NumPy: a sine network, a linear head, principal components, spectra."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sine_forward(x: Column, weights: list[list[list[float]]], biases: list[list[float]], omega: float = 30.0) -> Column:
    """A sine network on an array of inputs: the first layer sin(Wx + b), hidden ones sin(omega(Wx + b)), the last linear."""

    def layer(rows: Column, given: Column) -> Column:
        return F.transform(rows, lambda r: F.aggregate(F.zip_with(r.w, given, lambda p, q: p * q), r.b, lambda s, t: s + t))

    def waves(z: Column, scale: float) -> Column:
        return F.transform(z, lambda t: F.sin(t * scale))

    out = x
    for k, (w, b) in enumerate(zip(weights, biases, strict=True)):
        rows = F.array(*[F.struct(F.array(*map(F.lit, map(float, row))).alias("w"), F.lit(float(c)).alias("b")) for row, c in zip(w, b, strict=True)])
        z = layer(rows, out)
        out = z if k == len(weights) - 1 else waves(z, omega if k else 1.0)
    return out


def _fit_sine(part: pd.DataFrame, hidden: int, steps: int, rate: float, seed: int) -> tuple[np.ndarray, list[float]]:
    """One hidden layer of sines by Adam over all samples; predictions and losses."""
    rng = np.random.default_rng(seed)
    x = part[["y", "x"]].to_numpy()
    v = part["v"].to_numpy()
    w1, b1 = rng.uniform(-3, 3, (hidden, 2)), rng.uniform(-3, 3, hidden)
    w2, b2 = rng.uniform(-1, 1, hidden) / hidden, 0.0
    p = [w1, b1, w2, np.array([b2])]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    losses = []
    for t in range(1, steps + 1):
        z = x @ p[0].T + p[1]
        h = np.sin(z)
        error = h @ p[2] + p[3][0] - v
        losses.append(float((error**2).mean()))
        back = 2 * error[:, None] / len(v) * p[2] * np.cos(z)
        grads = [back.T @ x, back.sum(0), 2 * (h.T @ error) / len(v), np.array([2 * error.mean()])]
        lr = rate * min(1.0, t / max(1, steps // 20)) * 0.5 * (1 + np.cos(np.pi * t / steps))
        for q, g, a, b in zip(p, grads, m, s, strict=True):
            a *= 0.9
            a += 0.1 * g
            b *= 0.999
            b += 0.001 * g * g
            q -= lr * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return np.sin(x @ p[0].T + p[1]) @ p[2] + p[3][0], losses


def sine_fit(df: DataFrame, key: str, hidden: int = 16, steps: int = 200, rate: float = 0.02, seed: int = 7) -> DataFrame:
    """key, first_loss, last_loss, psnr of a sine network fitted to each block (key, y, x, v); a null key is a block too."""

    def each(part: pd.DataFrame) -> pd.DataFrame:
        guess, losses = _fit_sine(part, hidden, steps, rate, seed)
        err = float(((guess - part["v"]) ** 2).mean())
        return pd.DataFrame({key: part[key].iloc[:1], "first_loss": losses[0], "last_loss": losses[-1], "psnr": 10 * np.log10(4 / max(err, 1e-10))})

    return df.groupBy(key).applyInPandas(each, f"{key} {df.schema[key].dataType.simpleString()}, first_loss double, last_loss double, psnr double")


def linear_head(df: DataFrame, features: list[str], target: str) -> np.ndarray:
    """Least-squares coefficients (intercept first) from sums of products: one pass, a result of fixed size."""
    names = ["1.0", *features]
    sums = [F.sum(F.expr(f"({a}) * ({b})")).alias(f"s{i}_{j}") for i, a in enumerate(names) for j, b in enumerate([*names, target])]
    row = df.agg(*sums).first()
    n = len(names)
    table = np.array(row, float).reshape(n, n + 1)
    return np.linalg.lstsq(table[:, :n], table[:, n], rcond=None)[0]


def covariance(vectors: DataFrame, vec_col: str = "embedding") -> tuple[np.ndarray, np.ndarray]:
    """Mean and population covariance of the vectors, from per-batch sums of a fixed size."""

    def each(batches):
        for pdf in batches:
            x = np.stack(pdf[vec_col].to_numpy()).astype(float)
            yield pd.DataFrame({"n": [len(x)], "s": [x.sum(0).tolist()], "q": [(x.T @ x).ravel().tolist()]})

    parts = vectors.select(vec_col).mapInPandas(each, "n long, s array<double>, q array<double>")
    add = lambda c: F.aggregate(F.collect_list(c), F.array_repeat(F.lit(0.0), 0), lambda a, x: F.when(F.size(a) == 0, x).otherwise(F.zip_with(a, x, lambda p, q: p + q)))
    row = parts.agg(F.sum("n"), add("s"), add("q")).first()
    mean = np.array(row[1]) / row[0]
    return mean, np.array(row[2]).reshape(len(mean), -1) / row[0] - np.outer(mean, mean)


def spectrum(vectors: DataFrame, vec_col: str = "embedding") -> DataFrame:
    """k, eigenvalue, share and running share of the principal components, largest first."""
    _, cov = covariance(vectors, vec_col)
    values = np.linalg.eigvalsh(cov)[::-1].clip(0)
    share = values / values.sum()
    rows = [(int(k), float(v), float(s), float(c)) for k, (v, s, c) in enumerate(zip(values, share, np.cumsum(share), strict=True))]
    return vectors.sparkSession.createDataFrame(rows, "k int, eigenvalue double, share double, running double")


def projected(vectors: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, error: the distance of each centred vector to the space of the first k principal components."""
    mean, cov = covariance(vectors, vec_col)
    basis = np.linalg.eigh(cov)[1][:, ::-1][:, :k]

    def each(batches):
        for pdf in batches:
            x = np.stack(pdf[vec_col].to_numpy()).astype(float) - mean
            yield pd.DataFrame({id_col: pdf[id_col], "error": np.sqrt(((x - x @ basis @ basis.T) ** 2).sum(1))})

    return vectors.select(id_col, vec_col).mapInPandas(each, f"{id_col} long, error double")


def kmeans(df: DataFrame, features: list[str], k: int, seed: int = 7) -> DataFrame:
    """``df`` with ``cluster``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    held = VectorAssembler(inputCols=features, outputCol="_features").transform(df)
    return KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(held).transform(held).drop("_features")


def fisher_distance(a: str, b: str, weights: Column) -> Column:
    """sqrt of the quadratic form of the difference of two arrays with a diagonal metric."""
    d = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(F.zip_with(d, weights, lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x))
