"""Discrete Fourier transforms of series too long for one task.

Series are rows ``(*keys, ix, re, im)``. Their length is a column among the
keys, so series of any number of lengths share one plan. A transform of a
power-of-two length L = R * C is done as R transforms of length C and C of
length R, each in a group of about sqrt(L) rows. Other lengths become a
convolution with a chirp, which such transforms carry out.
"""

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.functions.vectors import vector
from framelark.operators.frames import lengths, salted_join

#: Chirps are written out this many positions at a time.
STRETCH = 65_536


def _power(exponent: Column) -> Column:
    """Two to a whole exponent, as BIGINT."""
    return F.pow(F.lit(2.0), exponent).cast("bigint")


def _short_transforms(
    rows: DataFrame, keys: Sequence[str], size: Column, group: str, position: str, inverse: bool,
) -> DataFrame:
    """Transform each (keys, group) of ``size`` positions; absent ones are zero."""
    schema = rows.select(*keys, group, position, "re", "im").schema
    n_keys = len(keys)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n = key[n_keys + 1].as_py()
        values = np.zeros(n, dtype=complex)
        values[table[position].to_numpy()] = table["re"].to_numpy() + 1j * table["im"].to_numpy()
        out = np.fft.ifft(values) * n if inverse else np.fft.fft(values)
        columns = [pa.repeat(k, n) for k in key[:n_keys + 1]]
        columns += [pa.array(np.arange(n)), pa.array(out.real), pa.array(out.imag)]
        return pa.table(columns, names=[*keys, group, position, "re", "im"])

    return rows.withColumn("_size", size).groupBy(*keys, group, "_size").applyInArrow(run, schema)


def power_of_two_dft(
    rows: DataFrame, keys: Sequence[str], log_size: str, inverse: bool = False
) -> DataFrame:
    """Unscaled transforms of length ``2**log_size``, a column among ``keys``."""
    half = F.floor(F.col(log_size) / 2)
    n_rows, n_cols = _power(half), _power(F.col(log_size) - half)
    ix = F.col("ix")
    split = rows.select(
        *keys, (ix % n_cols).alias("_c"), F.floor(ix / n_cols).alias("_r"), "re", "im"
    )
    first = _short_transforms(split, keys, n_rows, "_c", "_r", inverse)
    sign = 2 if inverse else -2
    turn = F.lit(sign * math.pi) * (F.col("_c") * F.col("_r")) / (n_rows * n_cols).cast("double")
    cos, sin = F.cos(turn), F.sin(turn)
    turned = first.select(
        *keys, "_r", "_c",
        (F.col("re") * cos - F.col("im") * sin).alias("re"),
        (F.col("re") * sin + F.col("im") * cos).alias("im"),
    )
    second = _short_transforms(turned, keys, n_cols, "_r", "_c", inverse)
    return second.select(
        *keys, (F.col("_r") + F.col("_c") * n_rows).alias("ix"), "re", "im"
    )


def _stretched(sizes: DataFrame) -> DataFrame:
    """``(size, lag)`` for the lags from 1 - size to size - 1 of every length."""
    first = F.explode(F.sequence(1 - F.col("size"), F.col("size") - 1, F.lit(STRETCH)))
    last = F.least(F.col("_a") + (STRETCH - 1), F.col("size") - 1)
    # A stated number: by bytes these few rows, each of a stretch, would land in one task.
    n_tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sizes.select("size", first.alias("_a")).repartition(n_tasks, "size", "_a").select(
        "size", F.explode(F.sequence("_a", last)).alias("lag"))


def dft(
    rows: DataFrame, keys: Sequence[str], size: str, sizes: DataFrame, inverse: bool = False
) -> DataFrame:
    """Unscaled transforms of any length through a chirp; ``size`` is one of ``keys``.

    With c_n = exp(i pi n^2 / N), X_k = conj(c_k) * sum_n (x_n conj(c_n)) c_{k-n}.
    Series of one length share the transform of the chirp. ``sizes`` holds the
    lengths that occur in a column ``size``, so that ``rows`` are made once.
    """
    n = F.col(size)
    # The least power of two that holds 2 N - 1 values; exact for BIGINT in doubles.
    log_size = F.greatest(F.lit(1), F.ceil(F.log2(2 * n - 1)).cast("int"))
    log_size = log_size + (_power(log_size) < 2 * n - 1).cast("int")
    sign = 1.0 if inverse else -1.0

    def chirp(at: Column, n: Column) -> tuple[Column, Column]:
        # The square modulo 2N keeps the angle small and exact.
        angle = F.lit(math.pi) * F.pmod(at * at, 2 * n) / n.cast("double")
        return F.cos(angle), F.sin(angle) * F.lit(sign)

    keyed = [*keys, "_log"]
    cos, sin = chirp(F.col("ix"), n)
    a = rows.withColumns({"_log": log_size, "ix": F.col("ix").cast("bigint")}).select(
        *keyed, "ix",
        (F.col("re") * cos - F.col("im") * sin).alias("re"),
        (F.col("re") * sin + F.col("im") * cos).alias("im"),
    )
    # The chirp to convolve with, wrapped around for negative lags.
    lags = _stretched(sizes.select("size").distinct())
    cos, sin = chirp(F.col("lag"), F.col("size"))
    kernel = lags.withColumnRenamed("size", size).withColumn("_log", log_size).withColumnRenamed(
        size, "size").select(
        "size", "_log", F.pmod("lag", _power(F.col("_log"))).alias("ix"),
        cos.alias("re"), (-sin).alias("im"),
    )
    left = power_of_two_dft(a, keyed, "_log")
    right = power_of_two_dft(kernel, ["size", "_log"], "_log").select(
        F.col("size").alias(size), "ix", F.col("re").alias("_re"), F.col("im").alias("_im")
    )
    # Spark sizes the chirp by the few rows it is written out from and would broadcast it.
    both = left.join(right.hint("merge"), [size, "ix"]).select(
        *keyed, "ix",
        (F.col("re") * F.col("_re") - F.col("im") * F.col("_im")).alias("re"),
        (F.col("re") * F.col("_im") + F.col("im") * F.col("_re")).alias("im"),
    )
    out = power_of_two_dft(both, keyed, "_log", inverse=True).where(F.col("ix") < n)
    cos, sin = chirp(F.col("ix"), n)
    padded = _power(F.col("_log")).cast("double")
    return out.select(
        *keys, "ix",
        ((F.col("re") * cos - F.col("im") * sin) / padded).alias("re"),
        ((F.col("re") * sin + F.col("im") * cos) / padded).alias("im"),
    )


def resample_long(frames: DataFrame, ratio: float, width: int) -> DataFrame:
    """Spectral resampling of long utterances of any lengths, in one plan."""
    sizes = lengths(frames).select(
        "utt", F.col("n").cast("bigint").alias("n"),
        F.floor(F.col("n") * F.lit(float(ratio))).cast("bigint").alias("n_out"),
    ).where("n_out > 0")
    keys = ["utt", "channel", "n", "n_out"]
    cells = salted_join(frames.select("utt", "frame_ix", "feats"), sizes, ["utt"]).select(
        "utt", "n", "n_out", F.posexplode("feats").alias("channel", "re"),
        F.col("frame_ix").cast("bigint").alias("ix"), F.lit(0.0).alias("im"),
    )
    spectrum = dft(cells, keys, "n", sizes.select(F.col("n").alias("size")))
    n, n_out, ix = F.col("n"), F.col("n_out"), F.col("ix")
    low = F.least(n, n_out)
    half = F.floor(low / 2)
    # Keep the low bins; the middle bin of an even length is shared by both halves.
    middle = (low % 2 == 0) & (ix == half)
    keep = spectrum.where(ix <= half).withColumns({
        "re": F.when(middle, F.col("re") * F.when(n_out < n, 2.0).otherwise(0.5)).otherwise(F.col("re")),
        "im": F.when(middle, F.col("im") * F.when(n_out <= n, 0.0).otherwise(0.5)).otherwise(F.col("im")),
    })
    twin = F.when((ix > 0) & (ix * 2 != n_out), F.struct(
        (n_out - ix).alias("ix"), F.col("re").alias("re"), (-F.col("im")).alias("im")))
    both = F.explode(F.array_compact(F.array(F.struct("ix", "re", "im"), twin)))
    whole = keep.select(*keys, both.alias("b")).select(*keys, "b.ix", "b.re", "b.im")
    series = dft(whole, keys, "n_out", sizes.select(F.col("n_out").alias("size")), inverse=True)
    rows = series.groupBy("utt", "n", "ix").agg(
        F.array_sort(F.collect_list(F.struct("channel", "re"))).alias("_v")
    )
    return rows.select(
        "utt", F.col("ix").cast("int").alias("frame_ix"),
        vector(lambda v: v["re"] / n, F.col("_v"), width=width).alias("feats"),
    )
