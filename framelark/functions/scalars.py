"""Scalar column expressions: names, times, activations, densities."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVATIONS = {
    "identity": lambda x: x,
    "binary": lambda x: F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0)),
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "softplus": lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x))),
    "tanh": F.tanh,
}


def speaker_of(utt: Column) -> Column:
    """An utterance is named after its speaker up to the first underscore."""
    return F.substring_index(utt, "_", 1)


def parse_feature_name(name: str) -> tuple[str, str]:
    """``mfcc_stds_byspeaker`` -> (``mfcc``, ``stds_byspeaker``)."""
    kind, _, norm = name.partition("_")
    return kind, norm.strip("_")


def start_frame(seconds: Column, sampling_rate: float) -> Column:
    return F.floor(seconds * F.lit(float(sampling_rate))).cast("int")


def end_frame(seconds: Column, sampling_rate: float) -> Column:
    return F.ceil(seconds * F.lit(float(sampling_rate))).cast("int")


def nearest_frame(seconds: Column, sampling_rate: float) -> Column:
    """Half-even rounding of the exact product."""
    return F.rint(seconds * F.lit(float(sampling_rate))).cast("int")


def round_exact(x: Column, digits: int) -> Column:
    """Half-even decimal rounding of the exact binary value.

    Where the scaled product lands on a half, its rounding error, found by
    splitting ``x`` into two short halves, tells the true side.
    """
    scale = F.lit(float(10**digits))
    product = x * scale
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    error = (high * scale - product) + (x - high) * scale
    below = F.floor(product).cast("double")
    half = product - below == 0.5
    whole = (
        F.when(half & (error > 0), below + 1)
        .when(half & (error < 0), below)
        .otherwise(F.rint(product))
    )
    return whole / scale


def unordered_pair(a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.least(a, b), F.greatest(a, b))


def sinc(x: Column) -> Column:
    scaled = x * F.lit(math.pi)
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(scaled) / scaled)


def log_base(x: Column, base: float) -> Column:
    return F.ln(x) / F.lit(math.log(base))


def scaled(x: Column, mean: Column, divisor: Column) -> Column:
    """(x - mean) / divisor, NULL where the divisor is zero."""
    return F.try_divide(x - mean, divisor)


def gaussian_density(x: Column, mean: Column, std: Column) -> Column:
    gap = x - mean
    return F.exp(-(gap * gap) / (2 * std * std)) / (
        F.lit(math.sqrt(2 * math.pi)) * std
    )


def cross_entropy(proba: Column, label: Column) -> Column:
    """Evaluated left to right, so that neither logarithm meets zero."""
    tiny = F.lit(1e-32)
    return -(label * F.ln(proba + tiny) + (1 - label) * F.ln((1 - proba) + tiny))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def natural_key(name: Column) -> Column:
    """Sort key in which runs of digits compare as whole numbers."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def padded(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+(?=[0-9])", "")
        # Length first, then digits: no limit on how long a run may be.
        return F.when(
            run.rlike("^[0-9]+$"),
            F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits),
        ).otherwise(run)

    return F.transform(runs, padded)
