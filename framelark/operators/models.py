"""Applying models to frames: dense stacks, mixture readouts, refinement."""

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from framelark.functions.scalars import gaussian_density
from framelark.functions.vectors import of_width, softmax, vector
from framelark.operators.channels import keep_channels
from framelark.operators.frames import context_windows, dynamic_features, lowpass_fir
from framelark.operators.moments import denormalize

NUMPY_ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "identity": lambda x: x,
    "binary": lambda x: (x > 0).astype(float),
    "relu": lambda x: np.maximum(x, 0),
    "sigmoid": lambda x: 1 / (1 + np.exp(-x)),
    "softplus": lambda x: np.logaddexp(0, x),
    "tanh": np.tanh,
    "softmax": lambda x: (e := np.exp(x - x.max(1, keepdims=True))) / e.sum(1, keepdims=True),
}


@dataclass(frozen=True)
class Dense:
    """act(x W + b)."""

    weights: np.ndarray
    bias: np.ndarray
    activation: str = "relu"

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return NUMPY_ACTIVATIONS[self.activation](x @ self.weights + self.bias)


@dataclass(frozen=True)
class DenseModel:
    """Hidden layers, a readout for continuous and one for binary tracks.

    ``binary_positions`` are the places of the binary tracks in the output.
    """

    hidden: Sequence[Dense]
    readout: Dense
    binary_readout: Dense | None = None
    binary_positions: Sequence[int] = field(default_factory=tuple)

    @property
    def input_width(self) -> int:
        first = self.hidden[0] if self.hidden else self.readout
        return first.weights.shape[0]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Continuous outputs and, if any, binary probabilities."""
        for layer in self.hidden:
            x = layer(x)
        proba = None if self.binary_readout is None else self.binary_readout(x)
        return self.readout(x), proba

    def output(self, x: np.ndarray) -> np.ndarray:
        """All tracks in their final places, binary ones rounded."""
        main, proba = self.predict(x)
        if proba is None:
            return main
        n_total = main.shape[1] + proba.shape[1]
        places = list(self.binary_positions)
        out = np.empty((len(x), n_total))
        out[:, places] = np.rint(proba)
        out[:, [i for i in range(n_total) if i not in places]] = main
        return out


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Arrow list column of equal widths -> 2-D array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    if len(values) != len(column) * width:
        raise ValueError(f"expected vectors of width {width}")
    return values.reshape(len(column), width)


def list_column(values: np.ndarray) -> pa.Array:
    values = np.ascontiguousarray(values, dtype=float)
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))


def map_vectors(
    frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], width: int,
) -> DataFrame:
    """Apply a matrix function to ``feats``, one Arrow batch at a time.

    This is where a user's own ``predict`` goes in: rows are frames, and no
    frame needs another one.
    """
    schema = StructType([
        StructField(f.name, ArrayType(DoubleType()), True) if f.name == "feats" else f
        for f in frames.schema.fields
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("feats")
            columns = list(batch.columns)
            columns[at] = list_column(fn(matrix(columns[at], width)))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return frames.mapInArrow(run, schema)


def dense_forward(frames: DataFrame, model: DenseModel) -> DataFrame:
    """``feats`` becomes the model's output; weights travel with the task."""
    return map_vectors(frames, model.output, model.input_width)


def invert(
    frames: DataFrame, model: DenseModel, width: int, context: int = 0,
    channels: Sequence[int] | None = None,
) -> DataFrame:
    """Predict every utterance of a feature table, keeping chosen channels."""
    rows = context_windows(frames, width, context)
    return keep_channels(dense_forward(rows, model), channels)


def refine_signal(
    frames: DataFrame, width: int, norms: Sequence[float] | None = None,
    cutoffs: float | Sequence[float] | None = None, add_dynamic: bool = False,
    sampling_rate: float = 200, filter_window: int = 5,
) -> DataFrame:
    """Scale back, smooth and add dynamic features, each step if asked for."""
    if norms is not None:
        frames = denormalize(frames, F.lit([float(x) for x in norms]), width)
    if cutoffs is not None:
        frames = lowpass_fir(frames, cutoffs, width, sampling_rate, filter_window)
    return dynamic_features(frames, width) if add_dynamic else frames


# --- weights as a table -----------------------------------------------------

WEIGHTS_SCHEMA = "layer int, kind string, activation string, i int, j int, value double"
MAX_WEIGHTS = 50_000_000


def weights_table(spark: SparkSession, model: DenseModel) -> DataFrame:
    """A model as rows ``(layer, kind, activation, i, j, value)``; i = -1 is the bias."""
    layers = [("hidden", d) for d in model.hidden] + [("readout", model.readout)]
    if model.binary_readout is not None:
        layers.append(("binary", model.binary_readout))
    parts = []
    for number, (kind, layer) in enumerate(layers):
        full = np.vstack([layer.weights, layer.bias[None, :]])
        i, j = np.indices(full.shape)
        i[-1] = -1
        parts.append(pa.table({
            "layer": pa.array(np.full(full.size, number, dtype=np.int32)),
            "kind": pa.array([kind] * full.size),
            "activation": pa.array([layer.activation] * full.size),
            "i": pa.array(i.ravel().astype(np.int32)),
            "j": pa.array(j.ravel().astype(np.int32)),
            "value": pa.array(full.ravel()),
        }))
    return spark.createDataFrame(pa.concat_tables(parts), WEIGHTS_SCHEMA)


def model_from_table(table: DataFrame, binary_positions: Sequence[int] = ()) -> DenseModel:
    """Read a model back; its size, not that of any data, is checked first."""
    if table.limit(MAX_WEIGHTS + 1).count() > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights")
    rows = table.toPandas()
    layers = {}
    for (number, kind, activation), part in rows.groupby(["layer", "kind", "activation"]):
        cells = part[part.i >= 0]
        weights = np.zeros((cells.i.max() + 1, cells.j.max() + 1))
        weights[cells.i, cells.j] = cells.value
        bias = np.zeros(weights.shape[1])
        bias[part[part.i < 0].j] = part[part.i < 0].value
        layers[number] = (kind, Dense(weights, bias, activation))
    ordered = [layers[k] for k in sorted(layers)]
    by_kind = {kind: layer for kind, layer in ordered if kind != "hidden"}
    return DenseModel(
        [layer for kind, layer in ordered if kind == "hidden"], by_kind["readout"],
        by_kind.get("binary"), tuple(binary_positions),
    )


# --- mixture density readouts -----------------------------------------------


def mixture_parameters(frames: DataFrame, n_components: int, n_targets: int) -> DataFrame:
    """Split a readout into ``priors[K]``, ``means[K*D]`` and ``stds[K*D]``.

    Component k's value for target d sits at position k*D + d.
    """
    k, size = n_components, n_components * n_targets
    priors = softmax(F.slice("feats", 1, k))
    means = F.slice("feats", k + 1, size)
    stds = F.transform(F.slice("feats", k + size + 1, size), F.exp)
    return frames.withColumns({"priors": priors, "means": means, "stds": stds})


def component_densities(
    point: Column, means: Column, stds: Column, n_components: int, n_targets: int,
    shared_std: bool = False,
) -> Column:
    """Density of each component at a point: the product over targets."""
    targets = F.sequence(F.lit(0), F.lit(n_targets - 1))

    def at(k: Column) -> Column:
        def step(acc: Column, d: Column) -> Column:
            cell = k * n_targets + d
            std = F.get(stds, k if shared_std else cell)
            return acc * gaussian_density(F.get(point, d), F.get(means, cell), std)

        return F.aggregate(targets, F.lit(1.0), step)

    return F.transform(F.sequence(F.lit(0), F.lit(n_components - 1)), at)


def weighted_components(weights: Column, means: Column, n_components: int, n_targets: int) -> Column:
    """Weighted sum of the components' vectors."""
    components = F.sequence(F.lit(0), F.lit(n_components - 1))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_targets - 1)),
        lambda d: F.aggregate(
            components, F.lit(0.0),
            lambda acc, k: acc + F.get(weights, k) * F.get(means, k * n_targets + d),
        ),
    )


def mixture_density(
    rows: DataFrame, targets: str, n_components: int, n_targets: int,
    norms: Sequence[float] | None = None, shared_std: bool = False,
) -> DataFrame:
    """Add ``density``: the mixture's density at the target vector."""
    point = F.col(targets)
    if norms is not None:
        rows = of_width(rows, n_targets, targets)
        point = vector(
            lambda x, s: x / s, point, F.lit([float(s) for s in norms]), width=n_targets
        )
    densities = component_densities(
        point, F.col("means"), F.col("stds"), n_components, n_targets, shared_std
    )
    mixed = F.zip_with("priors", densities, lambda p, d: p * d)
    return rows.withColumn(
        "density", F.aggregate(mixed, F.lit(0.0), lambda acc, x: acc + x)
    )


def mixture_prediction(rows: DataFrame, n_components: int, n_targets: int) -> DataFrame:
    """``feats`` becomes the mean weighted by the occupancy of a first guess.

    The first guess is the prior-weighted mean; occupancies are the components'
    shares of the density there.
    """
    size = (n_components, n_targets)
    first = rows.withColumn("_guess", weighted_components(F.col("priors"), F.col("means"), *size))
    dens = first.withColumn(
        "_dens", component_densities(F.col("_guess"), F.col("means"), F.col("stds"), *size)
    )
    norm = F.aggregate("_dens", F.lit(0.0), lambda acc, x: acc + x) + F.lit(1e-30)
    shares = dens.withColumn("_norm", norm).withColumn(
        "_share", F.transform("_dens", lambda x: x / F.col("_norm"))
    )
    return shares.withColumn(
        "feats", weighted_components(F.col("_share"), F.col("means"), *size)
    ).drop("_guess", "_dens", "_norm", "_share")
