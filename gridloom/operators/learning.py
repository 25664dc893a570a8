"""Classifiers, clusters and reductions over feature columns, on pyspark.ml. Unfitted models are an error, never random."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, MinMaxScaler, SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def _assembled(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="__features", handleInvalid="skip")


def cluster(df: DataFrame, columns: list[str], k: int = 5, seed: int = 42) -> DataFrame:
    """df with cluster (null with fewer rows than k): scaled k-means."""
    if df.limit(k).count() < k:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    steps = [_assembled(columns), StandardScaler(inputCol="__features", outputCol="__scaled"), KMeans(k=k, seed=seed, featuresCol="__scaled", predictionCol="cluster")]
    return Pipeline(stages=steps).fit(df).transform(df).drop("__features", "__scaled")


def reduce(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """df with `reduced`, an array of k principal components of the scaled columns."""
    steps = [_assembled(columns), StandardScaler(inputCol="__features", outputCol="__scaled", withMean=True), PCA(k=k, inputCol="__scaled", outputCol="__pca")]
    return Pipeline(stages=steps).fit(df).transform(df).withColumn("reduced", vector_to_array("__pca")).drop("__features", "__scaled", "__pca")


def angles(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with `angles`: the columns scaled to 0..pi."""
    steps = [_assembled(columns), MinMaxScaler(min=0.0, max=float(np.pi), inputCol="__features", outputCol="__scaled")]
    return Pipeline(stages=steps).fit(df).transform(df).withColumn("angles", vector_to_array("__scaled")).drop("__features", "__scaled")


def forest(df: DataFrame, columns: list[str], label: str, trees: int = 100, seed: int = 42) -> PipelineModel:
    return Pipeline(stages=[_assembled(columns), RandomForestClassifier(featuresCol="__features", labelCol=label, numTrees=trees, seed=seed, featureSubsetStrategy="sqrt")]).fit(df)


def boosted(df: DataFrame, columns: list[str], label: str, rounds: int = 20, seed: int = 42) -> PipelineModel:
    return Pipeline(stages=[_assembled(columns), GBTClassifier(featuresCol="__features", labelCol=label, maxIter=rounds, maxDepth=5, stepSize=0.1, subsamplingRate=0.8, seed=seed)]).fit(df)


def probability(model: PipelineModel, df: DataFrame, name: str, index: int = 1) -> DataFrame:
    """df with the model's probability of a class."""
    out = model.transform(df)
    return out.withColumn(name, vector_to_array("probability")[index]).drop("__features", "rawPrediction", "probability", "prediction")


def stacked(df: DataFrame, columns: list[str], label: str, key: str, folds: int = 5, trees: int = 20, rounds: int = 5) -> DataFrame:
    """df with `stacked`: a logistic model over out-of-fold probabilities of a forest and a boosted model; folds by a hash of the key."""
    dealt = df.withColumn("__fold", F.pmod(F.xxhash64(key), F.lit(folds)))
    parts = []
    for i in range(folds):
        train, held = dealt.filter(F.col("__fold") != i), dealt.filter(F.col("__fold") == i)
        held = probability(forest(train, columns, label, trees), held, "__rf")
        parts.append(probability(boosted(train, columns, label, rounds), held, "__gb"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    meta = Pipeline(stages=[_assembled(["__rf", "__gb"]), LogisticRegression(featuresCol="__features", labelCol=label)]).fit(out)
    return probability(meta, out, "stacked").drop("__fold", "__rf", "__gb")


def logistic_growth(years: list[float], shares: list[float], steps: int = 100) -> tuple[float, float, float, float]:
    """capacity, rate, midpoint and R2 of a logistic curve through a few yearly values (Gauss-Newton with damping, on the driver)."""
    x, y = np.asarray(years, float), np.asarray(shares, float)
    p = np.array([max(y.max() * 1.2, 1e-6), 0.1, x.mean()])
    model = lambda p: p[0] / (1 + np.exp(np.clip(-p[1] * (x - p[2]), -60, 60)))
    damp = 1e-2
    for _ in range(steps):
        e = np.exp(np.clip(-p[1] * (x - p[2]), -60, 60))
        jac = np.stack([1 / (1 + e), p[0] * e * (x - p[2]) / (1 + e) ** 2, -p[0] * e * p[1] / (1 + e) ** 2], axis=1)
        miss = y - model(p)
        step = np.linalg.solve(jac.T @ jac + damp * np.diag(np.diag(jac.T @ jac) + 1e-12), jac.T @ miss)
        if ((y - model(p + step)) ** 2).sum() < (miss**2).sum():
            p, damp = p + step, damp / 3
        else:
            damp *= 4
    total = ((y - y.mean()) ** 2).sum()
    return float(p[0]), float(p[1]), float(p[2]), float(1 - ((y - model(p)) ** 2).sum() / total) if total else 0.0


def fidelity_svm(df: DataFrame, amplitudes: list[str], label: str, rounds: int = 50) -> PipelineModel:
    """A support vector machine with the kernel <a, b>**2 of real states.

    The kernel is the product of outer products, so a linear machine over the pairwise products of the
    amplitudes is exact, and needs no kernel matrix and no bound on the training rows.
    """
    pairs = [(i, j) for i in range(len(amplitudes)) for j in range(i, len(amplitudes))]
    products = SQLTransformer(statement="SELECT *, " + ", ".join(f"`{amplitudes[i]}` * `{amplitudes[j]}` * {1.0 if i == j else 2**0.5!r} AS __k{n}" for n, (i, j) in enumerate(pairs)) + " FROM __THIS__")
    return Pipeline(stages=[products, _assembled([f"__k{n}" for n in range(len(pairs))]), LinearSVC(featuresCol="__features", labelCol=label, maxIter=rounds, standardization=False)]).fit(df)


class Circuit:
    """A circuit of n qubits: inputs as rotations, then layers of rotations and a ring of controlled flips; gives the Z expectation of each qubit.

    Rotations and flips are real, so states are real vectors, and many rows are one matrix.
    """

    def __init__(self, qubits: int = 8, layers: int = 3, seed: int = 42):
        self.qubits, self.layers = qubits, layers
        self.theta = np.random.default_rng(seed).uniform(0, 2 * np.pi, (layers, qubits))
        order = np.arange(2**qubits)
        for q in range(qubits):
            order = np.where(order >> q & 1, order ^ (1 << (q + 1) % qubits), order)
        self._flips = order  # where the amplitude of each state goes
        self._signs = 1.0 - 2.0 * (np.arange(2**qubits)[:, None] >> np.arange(qubits) & 1)

    def _rotate(self, states: np.ndarray, qubit: int, angle: np.ndarray | float) -> np.ndarray:
        s = states.reshape(len(states), -1, 2, 2**qubit)
        c, d = np.cos(np.asarray(angle) / 2).reshape(-1, 1, 1), np.sin(np.asarray(angle) / 2).reshape(-1, 1, 1)
        return np.stack([c * s[:, :, 0] - d * s[:, :, 1], d * s[:, :, 0] + c * s[:, :, 1]], axis=2).reshape(len(states), -1)

    def expectations(self, angles: np.ndarray, theta: np.ndarray | None = None) -> np.ndarray:
        """rows x qubits values in [-1, 1] for rows of input angles."""
        theta = self.theta if theta is None else theta
        states = np.zeros((len(angles), 2**self.qubits))
        states[:, 0] = 1
        for q in range(self.qubits):
            states = self._rotate(states, q, angles[:, q])
        for layer in theta:
            for q in range(self.qubits):
                states = self._rotate(states, q, layer[q])
            moved = np.empty_like(states)
            moved[:, self._flips] = states
            states = moved
        return states**2 @ self._signs

    def fit(self, angles: np.ndarray, labels: np.ndarray, steps: int = 30, rate: float = 0.05) -> "Circuit":
        """Train on a bounded sample of labelled rows (0/1): the first qubit's expectation against the label, by shifted parameters and Adam."""
        target, m, v = 1.0 - 2.0 * labels, np.zeros_like(self.theta), np.zeros_like(self.theta)
        for step in range(1, steps + 1):
            miss = self.expectations(angles)[:, 0] - target
            slope = np.empty_like(self.theta)
            for at in np.ndindex(self.theta.shape):
                shift = np.zeros_like(self.theta)
                shift[at] = np.pi / 2
                slope[at] = (miss * (self.expectations(angles, self.theta + shift)[:, 0] - self.expectations(angles, self.theta - shift)[:, 0])).mean()
            m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
            self.theta = self.theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self

    def apply(self, df: DataFrame, column: str, name: str = "expectations") -> DataFrame:
        """df with the expectations of an array column of angles."""

        def run(values: pd.Series) -> pd.Series:
            return pd.Series(list(self.expectations(np.array([np.asarray(x, float)[: self.qubits] for x in values]).reshape(len(values), self.qubits)))) if len(values) else pd.Series([], dtype=object)

        return df.withColumn(name, pandas_udf(run, "array<double>")(F.col(column)))


def noisy_samples(df: DataFrame, key: list[str], column: str, samples: int = 8, sigma: float = 0.02, seed: int = 42) -> DataFrame:
    """df once for each sample, with the column disturbed by normal noise; sample 0 is clean. The noise follows from a hash of the key, so every run gives the same."""
    # The key's text is made once a row, not for each draw of each sample.
    text = F.when(F.coalesce(*[F.col(k).cast("string") for k in key]).isNotNull(), F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    name = lambda part: F.md5(F.concat_ws("|", F.col("__key"), F.col("sample").cast("string"), F.lit(str(seed + part))))
    draw = lambda part: (F.conv(F.substring(name(part), 1, 10), 16, 10).cast("double") + 0.5) / float(1 << 40)
    normal = F.sqrt(-2 * F.log(draw(0))) * F.cos(2 * np.pi * draw(1))
    spread = df.withColumn("__key", text).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return spread.withColumn(column, F.when(F.col("sample") == 0, F.col(column)).otherwise(F.col(column) + sigma * normal)).drop("__key")


class AutoEncoder:
    """A network that narrows its inputs to a code and widens them again; rectified hidden layers, linear code and output."""

    def __init__(self, inputs: int, hidden: int = 16, code: int = 8, seed: int = 42):
        rng = np.random.default_rng(seed)
        shape = [inputs, hidden, code, hidden, inputs]
        self.weights = [rng.normal(0, 0.1, (a, b)) for a, b in zip(shape, shape[1:], strict=False)]
        self.biases = [np.zeros(b) for b in shape[1:]]
        self.seed = seed

    def _layers(self, x: np.ndarray, last: int = 4) -> list[np.ndarray]:
        out = [x]
        for i in range(last):
            y = out[-1] @ self.weights[i] + self.biases[i]
            out.append(np.maximum(y, 0) if i % 2 == 0 else y)
        return out

    def codes(self, x: np.ndarray) -> np.ndarray:
        return self._layers(x, 2)[-1]

    def loss(self, x: np.ndarray) -> float:
        return float(((self._layers(x)[-1] - x) ** 2).mean())

    def fit(self, x: np.ndarray, steps: int = 50, rate: float = 0.001, batch: int = 2048, bound: float = 1.0) -> "AutoEncoder":
        """Gradient descent on the squared error of random batches; each gradient entry is clipped to the bound."""
        rng = np.random.default_rng(self.seed)
        for _ in range(steps):
            rows = x[rng.choice(len(x), min(batch, len(x)), replace=False)]
            layers = self._layers(rows)
            slope = 2.0 / len(rows) * (layers[-1] - rows)
            for i in reversed(range(4)):
                if i % 2 == 0:
                    slope = slope * (layers[i + 1] > 0)
                by_weight, by_bias, slope = layers[i].T @ slope, slope.sum(axis=0), slope @ self.weights[i].T
                self.weights[i] -= rate * np.clip(by_weight, -bound, bound)
                self.biases[i] -= rate * np.clip(by_bias, -bound, bound)
        return self


def encode_spectra(df: DataFrame, columns: list[str], code: int = 8, sample: int = 20_000, steps: int = 50, rate: float = 0.001, seed: int = 42) -> DataFrame:
    """df with `code`, an array: the columns, scaled by their mean and deviation over all rows, through an auto-encoder.

    The encoder learns from at most `sample` rows, the first in order of a hash of their values; rows with a null get a null code.
    """
    whole = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([whole[f"m{i}"] or 0.0 for i in range(len(columns))])
    scale = np.array([whole[f"s{i}"] or 1.0 for i in range(len(columns))])
    rows = df.dropna(subset=columns).select(*[F.col(c).cast("double") for c in columns]).orderBy(F.xxhash64(*columns, F.lit(seed)), *columns).limit(sample).collect()
    model = AutoEncoder(len(columns), code=code, seed=seed)
    if rows:
        model.fit((np.array(rows, float) - mean) / scale, steps, rate)

    @pandas_udf("array<double>")
    def run(*values: pd.Series) -> pd.Series:
        x = np.column_stack([v.to_numpy(float) for v in values])
        codes = model.codes((x - mean) / scale)
        return pd.Series([None if np.isnan(r).any() else c.tolist() for r, c in zip(x, codes, strict=True)])

    return df.withColumn("code", run(*[F.col(c).cast("double") for c in columns]))
