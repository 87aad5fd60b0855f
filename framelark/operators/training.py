"""Data-parallel fitting of dense stacks.

The loss is the mean over channels of the RMSE (continuous) or cross-entropy
(binary) over all frames. Partitions sum up their gradients; only sums as long
as the model itself reach the driver.
"""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.operators.models import Dense, DenseModel, matrix

_SLOPES = {
    "identity": lambda y: np.ones_like(y),
    "relu": lambda y: (y > 0).astype(float),
    "sigmoid": lambda y: y * (1 - y),
    "tanh": lambda y: 1 - y * y,
    "softplus": lambda y: 1 - np.exp(-y),
}


def parameters(model: DenseModel) -> np.ndarray:
    layers = [*model.hidden, model.readout]
    if model.binary_readout is not None:
        layers.append(model.binary_readout)
    return np.concatenate([np.r_[d.weights.ravel(), d.bias] for d in layers])


def with_parameters(model: DenseModel, values: np.ndarray) -> DenseModel:
    at = 0

    def take(layer: Dense) -> Dense:
        nonlocal at
        weights = values[at:at + layer.weights.size].reshape(layer.weights.shape)
        at += layer.weights.size
        bias = values[at:at + layer.bias.size]
        at += layer.bias.size
        return Dense(weights, bias, layer.activation)

    hidden = [take(d) for d in model.hidden]
    readout = take(model.readout)
    binary = None if model.binary_readout is None else take(model.binary_readout)
    return replace(model, hidden=hidden, readout=readout, binary_readout=binary)


def _split_targets(model: DenseModel, targets: np.ndarray):
    places = list(model.binary_positions)
    rest = [i for i in range(targets.shape[1]) if i not in places]
    return targets[:, rest], targets[:, places]


def _target_width(model: DenseModel) -> int:
    return model.readout.bias.size + len(model.binary_positions)


def _loss_sums(model: DenseModel, x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Per channel: summed square error (continuous) or cross-entropy (binary)."""
    main, proba = model.predict(x)
    t_main, t_bin = _split_targets(model, t)
    sums = ((main - t_main) ** 2).sum(axis=0)
    if proba is None:
        return sums
    entropy = -(t_bin * np.log(proba + 1e-32) + (1 - t_bin) * np.log(1 - proba + 1e-32))
    return np.r_[sums, entropy.sum(axis=0)]


def _gradient_sums(
    model: DenseModel, x: np.ndarray, t: np.ndarray, scale: np.ndarray, n: int
) -> np.ndarray:
    """Backpropagation; ``scale`` is the derivative of the loss by square error."""
    values = [x]
    for layer in model.hidden:
        values.append(layer(values[-1]))
    t_main, t_bin = _split_targets(model, t)
    d_main = (model.readout(values[-1]) - t_main) * scale
    parts = [np.r_[(values[-1].T @ d_main).ravel(), d_main.sum(axis=0)]]
    back = d_main @ model.readout.weights.T
    if model.binary_readout is not None:
        n_channels = d_main.shape[1] + t_bin.shape[1]
        d_bin = (model.binary_readout(values[-1]) - t_bin) / (n * n_channels)
        parts.append(np.r_[(values[-1].T @ d_bin).ravel(), d_bin.sum(axis=0)])
        back = back + d_bin @ model.binary_readout.weights.T
    for layer, below, above in zip(
        reversed(model.hidden), reversed(values[:-1]), reversed(values)
    ):
        back = back * _SLOPES[layer.activation](above)
        parts.insert(0, np.r_[(below.T @ back).ravel(), back.sum(axis=0)])
        back = back @ layer.weights.T
    return np.concatenate(parts)


def _summed(rows: DataFrame, fn, width: int, target_width: int) -> np.ndarray:
    """Sum ``fn(x, t)`` over all frames: one vector per partition, then per position."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = None
        for batch in batches:
            if batch.num_rows:
                part = fn(matrix(batch["feats"], width), matrix(batch["target"], target_width))
                acc = part if acc is None else acc + part
        if acc is not None:
            ids = pa.array(np.arange(len(acc), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.array(acc)], names=["param", "value"])

    sums = rows.select("feats", "target").mapInArrow(run, "param int, value double")
    total = sums.groupBy("param").agg(F.sum("value").alias("value")).toPandas()
    return total.sort_values("param")["value"].to_numpy()


@dataclass(frozen=True)
class Adam:
    """Moments of past gradients; ``step`` counts the updates made."""

    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    step: int = 0
    first: np.ndarray | None = None
    second: np.ndarray | None = None

    def update(self, values: np.ndarray, gradient: np.ndarray) -> tuple[np.ndarray, "Adam"]:
        step = self.step + 1
        m = (1 - self.beta1) * gradient + self.beta1 * (0 if self.first is None else self.first)
        v = (1 - self.beta2) * gradient**2 + self.beta2 * (0 if self.second is None else self.second)
        m_hat, v_hat = m / (1 - self.beta1**step), v / (1 - self.beta2**step)
        moved = values - self.rate * m_hat / (np.sqrt(v_hat) + 1e-8)
        return moved, replace(self, step=step, first=m, second=v)


def loss(rows: DataFrame, model: DenseModel) -> tuple[np.ndarray, int]:
    """Loss per channel over rows ``(feats, target)``, and their number."""
    def sums(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.r_[_loss_sums(model, x, t), len(x)]

    out = _summed(rows, sums, model.input_width, _target_width(model))
    n = int(out[-1])
    mean = out[:-1] / n
    k = model.readout.bias.size
    return np.r_[np.sqrt(mean[:k]), mean[k:]], n


def gradient(rows: DataFrame, model: DenseModel) -> tuple[np.ndarray, np.ndarray]:
    """Loss per channel and the gradient of its mean."""
    per_channel, n = loss(rows, model)
    k = model.readout.bias.size
    # d rmse / d error = error / (n rmse), averaged over all channels.
    with np.errstate(divide="ignore"):
        scale = np.where(per_channel[:k] > 0, 1 / (n * per_channel[:k] * len(per_channel)), 0.0)

    def sums(x: np.ndarray, t: np.ndarray) -> np.ndarray:
        return _gradient_sums(model, x, t, scale, n)

    return per_channel, _summed(rows, sums, model.input_width, _target_width(model))


def fit_step(
    rows: DataFrame, model: DenseModel, optimizer: Adam
) -> tuple[DenseModel, Adam, np.ndarray]:
    """One update from all rows; returns the loss before it as well.

    A gradient with a non-finite part is not followed.
    """
    per_channel, slope = gradient(rows, model)
    if not np.isfinite(slope).all():
        return model, optimizer, per_channel
    values, optimizer = optimizer.update(parameters(model), slope)
    return with_parameters(model, values), optimizer, per_channel
