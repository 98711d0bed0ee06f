"""A network that trains until a held-out share of its rows stops gaining."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.base import Estimator
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fitgrain.functions.mixing import with_scramble
from fitgrain.session import spread, written

# Tasks get the functions of this module by value, so workers need not import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The share held out, the loss that counts as a gain, and the weight penalty.
HELD_SHARE = 0.1
TOLERANCE = 1e-4
PENALTY = 1e-4
#: Iterations of a round, after which the held-out loss is taken.
ROUND = 5
#: Rounds without a gain that end the training.
PATIENCE = 3
HELD_SEED = 7
_FLOOR = 1e-15
#: Steps that the quasi-Newton direction remembers, and the relative gain that ends a round.
MEMORY = 10
GAIN = 1e-6
#: A step must gain this share of what the slope promises and flatten the slope to the second share.
_DECREASE, _FLATTER = 1e-4, 0.9
#: Points tried along one direction, and after how many a point that gains enough is taken as it is.
_TRIES, _CONTENT = 12, 4
#: Rows that a task multiplies at once.
_AT_ONCE = 512


def shrunk(weights: np.ndarray, layers: list[int], factor: float) -> np.ndarray:
    """The weights between units times ``factor``; each layer's biases, which follow its weights, stay."""
    out, at = np.array(weights), 0
    for n_in, n_out in zip(layers, layers[1:]):
        out[at : at + n_in * n_out] *= factor
        at += (n_in + 1) * n_out
    return out


def held_marked(rows: DataFrame, features: str, label: str, id_col: str, share: float = HELD_SHARE) -> DataFrame:
    """Features, label and whether the row is held out, chosen by a scramble of its id."""
    if id_col in rows.columns:
        rows = with_scramble(rows.select(id_col, features, label), id_col, HELD_SEED, "__place")
    else:
        rows = rows.select(features, label, F.xxhash64(vector_to_array(features), label).alias("__place"))
    held = F.pmod(F.col("__place"), F.lit(10_000)) < F.lit(round(10_000 * share))
    return rows.select(features, label, held.alias("held"))


def both_parts(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The training rows and the held-out ones, written once; too few rows are both."""
    kept = written(marked, "held-parts")
    train, apart = kept.filter("not held").drop("held"), kept.filter("held").drop("held")
    return (train, apart) if not apart.isEmpty() and not train.isEmpty() else (kept.drop("held"), kept.drop("held"))


def held_parts(rows: DataFrame, features: str, label: str, id_col: str, share: float = HELD_SHARE) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-out ones, chosen by a scramble of their ids, written once; too few rows are both."""
    return both_parts(held_marked(rows, features, label, id_col, share))


def packed(marked: DataFrame, features: str, label: str) -> DataFrame:
    """Marked rows as blocks ``(x, y, held)`` of many rows each, read again without touching rows one by one."""
    rows = marked.select(vector_to_array(features, "float32"), F.col(label).cast("double"), F.coalesce("held", F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, apart = batch.column(0), batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 0), np.float32)
            labels = y.to_numpy(zero_copy_only=False).astype(float)
            if not np.isfinite(flat).all() or not np.isin(labels, (0.0, 1.0)).all():
                raise ValueError("features must be finite and labels 0 or 1")
            for side in (False, True):
                own = apart == side
                if own.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([flat[own].tobytes()], pa.binary()), pa.array([labels[own].astype(np.uint8).tobytes()], pa.binary()), pa.array([side])], ["x", "y", "held"]
                    )

    return spread(rows).mapInArrow(run, "x binary, y binary, held boolean")


def network_loss(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, slope: bool = True) -> tuple[float, np.ndarray]:
    """The summed log loss of rows under sigmoid layers with two softmax outputs, and its gradient.

    Each layer's weights follow one another as (inputs x outputs), then its biases.
    """
    parts, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        parts.append((weights[at : at + n_in * n_out].reshape(n_in, n_out), weights[at + n_in * n_out : at + (n_in + 1) * n_out]))
        at += (n_in + 1) * n_out
    outs = [x]
    for w, b in parts[:-1]:
        z = outs[-1] @ w
        z += b
        np.negative(z, out=z)
        with np.errstate(over="ignore"):  # the sigmoid of a large negative is 0
            np.exp(z, out=z)
        z += 1
        outs.append(np.reciprocal(z, out=z))
    w, b = parts[-1]
    z = outs[-1] @ w + b
    odds = (z[:, 1] - z[:, 0]).astype(np.float64)
    loss = float(np.logaddexp(0.0, np.where(y == 1, -odds, odds)).clip(max=-np.log(_FLOOR) if not slope else None).sum())
    if not slope:
        return loss, np.zeros(0)
    with np.errstate(over="ignore"):
        miss = (1 / (1 + np.exp(-odds)) - y).astype(x.dtype)
    delta, grad = np.stack([-miss, miss], axis=1), []
    for k in range(len(parts) - 1, -1, -1):
        grad[:0] = [(outs[k].T @ delta).ravel(), delta.sum(axis=0, dtype=np.float64)]
        if k:
            delta = delta @ parts[k][0].T
            delta *= outs[k]
            delta *= 1 - outs[k]
    return loss, np.concatenate(grad).astype(np.float64)


def summed_loss(blocks: DataFrame, layers: list[int], weights: np.ndarray, slope: bool = True) -> tuple[float, np.ndarray]:
    """The mean log loss over all blocks and its gradient: each task sums its rows, one row a task comes back."""
    sent, width = weights.astype(np.float32), layers[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, gradient = 0, 0.0, np.zeros(len(sent) if slope else 0)
        for batch in batches:
            for bx, by in zip(batch.column(0), batch.column(1)):
                x = np.frombuffer(bx.as_buffer(), np.float32).reshape(-1, width)
                y = np.frombuffer(by.as_buffer(), np.uint8)
                for start in range(0, len(y), _AT_ONCE):
                    some, own = network_loss(sent, layers, x[start : start + _AT_ONCE], y[start : start + _AT_ONCE], slope)
                    loss += some
                    gradient += own
                n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], ["n", "loss", "gradient"])

    found = blocks.select("x", "y").mapInArrow(run, "n long, loss double, gradient binary").collect()
    n = sum(r["n"] for r in found)
    return sum(r["loss"] for r in found) / n, sum(np.frombuffer(r["gradient"]) for r in found) / n


def _between(low: tuple, high: tuple) -> float:
    """The least point of the cubic through two steps ``(t, loss, slope)``, kept off their ends."""
    (t, a, da), (u, b, db) = low, high
    first = da + db - 3 * (a - b) / (t - u)
    root = max(first * first - da * db, 0.0) ** 0.5
    span = db - da + 2 * root
    at = u - (u - t) * (db + root - first) / span if span else (t + u) / 2
    ends = sorted((t + 0.1 * (u - t), t + 0.9 * (u - t)))
    return min(max(at, ends[0]), ends[1])


Loss = Callable[[np.ndarray], tuple[float, np.ndarray]]


def _step(f: Loss, at: np.ndarray, loss: float, slope: np.ndarray, way: np.ndarray, first: float) -> tuple[np.ndarray, float, np.ndarray] | None:
    """The next point along ``way`` that gains enough and is flat enough; the best one met if none is, None if none gains."""
    down = float(slope @ way)
    low, high, t, best = (0.0, loss, down), None, first, None
    for tried in range(1, _TRIES + 1):
        point = at + t * way
        value, gradient = f(point)
        if not np.isfinite(value):
            t /= 2
            continue
        here = (t, value, float(gradient @ way))
        enough = value <= loss + _DECREASE * t * down
        if enough and (abs(here[2]) <= -_FLATTER * down or tried >= _CONTENT):
            return point, value, gradient
        if value < loss and (best is None or value < best[1]):
            best = point, value, gradient
        if tried >= _CONTENT and best:
            return best
        if not enough or (value >= low[1] and low[0]):
            high = here
        else:
            if high is not None and here[2] * (high[0] - low[0]) >= 0 or high is None and here[2] >= 0:
                high = low
            low = here
        t = t * 1.5 if high is None else _between(low, high) if low[1] <= high[1] else _between(high, low)
    return best


def quasi_newton(f: Loss, at: np.ndarray, steps: int) -> np.ndarray:
    """At most ``steps`` steps of L-BFGS on the driver; only ``f`` runs on the cluster."""
    loss, slope = f(at)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, shares = -slope, []
        for move, turn in reversed(moves):
            share = (move @ way) / (move @ turn)
            shares.append(share)
            way = way - share * turn
        if moves:
            way = way * ((moves[-1][0] @ moves[-1][1]) / (moves[-1][1] @ moves[-1][1]))
        for (move, turn), share in zip(moves, reversed(shares)):
            way = way + (share - (turn @ way) / (move @ turn)) * move
        length = float(np.linalg.norm(way))
        if not length or slope @ way >= 0:
            break
        found = _step(f, at, loss, slope, way, 1.0 if moves else 1.0 / length)
        if found is None:
            break
        point, value, gradient = found
        if (point - at) @ (gradient - slope) > 0:
            moves = [*moves, (point - at, gradient - slope)][-MEMORY:]
        gain, at, loss, slope = loss - value, point, value, gradient
        if gain <= GAIN * max(abs(loss), 1e-12):
            break
    return at


class StoppedNetwork(Estimator):
    """Rounds of a network, each from the last one's weights, until held-out rows stop gaining.

    A tenth of the rows, by a scramble of their ids, is not trained on. After
    each round its log loss is taken; the weights of the least loss are the
    result. Training ends when ``patience`` rounds in a row gain less than
    ``tolerance``, or after ``max_iter`` iterations. Between rounds the weights
    decay by ``penalty`` an iteration. ``curve`` holds
    ``(iterations, held-out loss, whether it was the best so far)`` of each round.

    Every pass reads all rows, packed once into blocks of numbers that tasks
    multiply as matrices.
    """

    def __init__(
        self, layers: list[int], max_iter: int, seed: int, id_col: str = "ID", label: str = "y", features: str = "features",
        held_share: float = HELD_SHARE, tolerance: float = TOLERANCE, penalty: float = PENALTY, round_iter: int = ROUND, patience: int = PATIENCE,
    ) -> None:
        super().__init__()
        self.layers, self.max_iter, self.seed, self.id_col, self.label, self.features = layers, max_iter, seed, id_col, label, features
        self.held_share, self.tolerance, self.penalty, self.round_iter, self.patience = held_share, tolerance, penalty, round_iter, patience
        self.curve: list[tuple[int, float, bool]] = []

    def _model(self, spark: SparkSession, weights: np.ndarray | None = None) -> MultilayerPerceptronClassificationModel:
        """Spark's model with these weights, or with the seed's first ones: a fit of no iterations."""
        network = MultilayerPerceptronClassifier(featuresCol=self.features, labelCol=self.label, layers=self.layers, seed=self.seed, maxIter=0)
        if weights is not None:
            network.setInitialWeights(Vectors.dense(weights))
        return network.fit(_one_row(spark, self.layers[0], self.features, self.label))

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        spark = dataset.sparkSession
        marked = held_marked(dataset, self.features, self.label, self.id_col, self.held_share)
        train, held = both_parts(packed(marked, self.features, self.label))
        curve, best, least, idle, done = [], None, float("inf"), 0, 0
        weights = self._model(spark).weights.toArray()
        while done < self.max_iter and idle < self.patience:
            steps = min(self.round_iter, self.max_iter - done)
            weights = quasi_newton(lambda w: summed_loss(train, self.layers, w), weights, steps)
            done += steps
            loss = summed_loss(held, self.layers, weights, slope=False)[0]
            gained = loss < least - self.tolerance
            idle = 0 if gained else idle + 1
            new_best = best is None or loss < least
            if new_best:
                best, least = weights, loss
            curve.append((done, loss, new_best))
            weights = shrunk(weights, self.layers, 1 / (1 + self.penalty * steps))
        model = self._model(spark, best)
        self.curve = model.curve = curve
        return model


def _one_row(spark: SparkSession, width: int, features: str, label: str) -> DataFrame:
    layout = T.StructType([T.StructField(features, VectorUDT()), T.StructField(label, T.DoubleType())])
    return spark.createDataFrame([(Vectors.dense([0.0] * width), 0.0)], layout)
