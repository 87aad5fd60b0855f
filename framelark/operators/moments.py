"""Moments per file, speaker and corpus, and normalisation by them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelark.functions.scalars import scaled
from framelark.functions.vectors import of_width, vector
from framelark.operators.frames import long_form, null_safe_join, salted_join

SCOPE_KEYS = {"corpus": [], "speaker": ["speaker"], "file": ["speaker", "utt"]}
DIVISORS = {"stds": "std", "spread": "spread"}


def moments(frames: DataFrame, scope: str) -> DataFrame:
    """n, mean, population std and spread per channel at one scope.

    Partial aggregation runs before the shuffle, so a hot key costs one row per
    task and channel.
    """
    keys = scope_keys(scope)
    return (
        long_form(frames, *keys)
        .groupBy(*keys, "channel")
        .agg(
            F.count("value").alias("n"),
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
        )
        .withColumn("spread", F.col("high") - F.col("low"))
    )


def rolled_up(file_moments: DataFrame, scope: str) -> DataFrame:
    """Moments of a wider scope from the file ones, without reading frames."""
    keys = [*scope_keys(scope), "channel"]
    totals = file_moments.groupBy(*keys).agg(
        F.sum(F.col("n") * F.col("mean")).alias("_s"), F.sum("n").alias("_n")
    ).select(*keys, (F.col("_s") / F.col("_n")).alias("_mean"))
    # Deviations from the wider mean avoid subtracting two large squares.
    off = F.col("mean") - F.col("_mean")
    square = F.col("n") * (F.col("std") * F.col("std") + off * off)
    return (
        null_safe_join(file_moments, totals, keys)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.first("_mean").alias("mean"),
            F.sqrt(F.sum(square) / F.sum("n")).alias("std"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
        .withColumn("spread", F.col("high") - F.col("low"))
    )


#: Bits of ``grouping_id`` over (speaker, utt, channel): a rolled-up column is 1.
GROUPINGS = {"corpus": 0b110, "speaker": 0b010, "file": 0b000}


def all_scopes(frames: DataFrame) -> DataFrame:
    """File, speaker and corpus moments in one table, in one aggregation.

    The grouping sets share one scan; each merges its (n, mean, sum of squared
    deviations) states before and after the shuffle, so nothing is joined back.
    ``grouping_id`` tells a speaker that is NULL from a rolled-up one.
    """
    sets = [[*keys, "channel"] for keys in SCOPE_KEYS.values()]
    rows = long_form(frames, "speaker", "utt").groupingSets(sets, "speaker", "utt", "channel").agg(
        F.grouping_id().alias("_g"),
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        (F.max("value") - F.min("value")).alias("spread"),
    )
    scope = F.coalesce(*[F.when(F.col("_g") == g, name) for name, g in GROUPINGS.items()])
    return rows.select(
        scope.alias("scope"), "speaker", "utt", "channel", "n", "mean", "std", "spread")


def scope_keys(scope: str) -> list[str]:
    if scope not in SCOPE_KEYS:
        raise ValueError(f"scope must be one of {sorted(SCOPE_KEYS)}, not {scope!r}")
    return list(SCOPE_KEYS[scope])


def _packed(table: DataFrame, keys: list[str], divisor: str) -> DataFrame:
    """One row per key with the vectors ``_means`` and ``_divs``."""
    rows = F.array_sort(F.collect_list(F.struct("channel", "mean", divisor)))
    packed = table.groupBy(*keys).agg(rows.alias("_m"))
    return packed.select(
        *keys,
        F.transform("_m", lambda m: m["mean"]).alias("_means"),
        F.transform("_m", lambda m: m[divisor]).alias("_divs"),
    )


def with_moments(
    frames: DataFrame, table: DataFrame, scope: str, divisor: str = "std"
) -> DataFrame:
    """Attach the vectors of means and divisors that apply to each frame.

    At corpus scope that is a single row, read as a scalar subquery.
    """
    keys = scope_keys(scope)
    packed = _packed(table, keys, divisor)
    if not keys:
        single = packed.select(F.struct("_means", "_divs")).scalar()
        return frames.withColumn("_row", single).select(
            *frames.columns, F.col("_row._means").alias("_means"),
            F.col("_row._divs").alias("_divs"),
        )
    return salted_join(frames, packed, keys, null_safe=True)


def _rescaled(frames: DataFrame, fn, width: int) -> DataFrame:
    frames = of_width(frames, width, "feats", "_means", "_divs")
    feats = vector(fn, F.col("feats"), F.col("_means"), F.col("_divs"), width=width)
    return frames.withColumn("feats", feats).drop("_means", "_divs")


def normalize(
    frames: DataFrame, norm_type: str, scope: str, width: int,
    table: DataFrame | None = None,
) -> DataFrame:
    """(x - mean) / std or / spread, by the moments of the chosen scope."""
    if norm_type not in DIVISORS:
        raise KeyError(f"norm_type must be one of {sorted(DIVISORS)}")
    table = moments(frames, scope) if table is None else table
    rows = with_moments(frames, table, scope, DIVISORS[norm_type])
    return _rescaled(rows, scaled, width)


def demean(
    frames: DataFrame, scope: str, width: int, table: DataFrame | None = None
) -> DataFrame:
    table = moments(frames, scope) if table is None else table
    rows = with_moments(frames, table, scope)
    return _rescaled(rows, lambda x, mean, _: x - mean, width)


def denormalize(frames: DataFrame, norms: Column, width: int) -> DataFrame:
    """Multiply every channel by its norm."""
    rows = of_width(frames.withColumn("_norms", norms), width, "feats", "_norms")
    return rows.withColumn(
        "feats", vector(lambda x, k: x * k, F.col("feats"), F.col("_norms"), width=width)
    ).drop("_norms")


def norm_name(norm_type: str, scope: str) -> str:
    """Name of the ``norm`` partition that holds the result."""
    scope_keys(scope)
    return norm_type + {"corpus": "", "speaker": "_byspeaker", "file": "_byfile"}[scope]
