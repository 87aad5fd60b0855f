"""Most likely trajectories under Gaussian parameters of static and dynamic
features (parameter generation after Tokuda et al., 2000).

With W stacking identity, slope and slope of slope, the static trajectory of a
channel solves (W' P W) c = W' P m for means m and precisions P. Every row of
W looks at most ten frames away, so the system falls apart by substructuring:
each segment eliminates its inner frames, the few frames around the segment
borders are solved for along the chain of segments (long chains being condensed
group by group in the same way), and each segment then fills in its inner
frames. That is exact for any length, and no group grows with the utterance.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelark.operators.frames import dynamic_features, segmented
from framelark.operators.models import (
    component_densities, list_column, matrix, weighted_components,
)
from framelark.session import cut_lineage

WINDOW = 5
REACH = 2 * WINDOW
MARGIN = 3 * REACH
SEGMENT = 512
FAN = 64


def _slope(size: int, window: int = WINDOW) -> np.ndarray:
    """The slope operator, indices clamped to the series."""
    out = np.zeros((size, size))
    t = np.arange(size)
    norm = 2 * sum(k * k for k in range(1, window + 1))
    for k in range(1, window + 1):
        np.add.at(out, (t, np.minimum(t + k, size - 1)), k / norm)
        np.add.at(out, (t, np.maximum(t - k, 0)), -k / norm)
    return out


class _Segment:
    """The equations owned by one segment, and who its unknowns belong to."""

    def __init__(self, table: pa.Table, first: int, size: int, n_static: int):
        table = table.sort_by("frame_ix")
        self.ix = table["frame_ix"].to_numpy()
        self.n_static = n_static
        self.own = (self.ix >= first) & (self.ix < first + size)
        self.means = matrix(table["means"], 3 * n_static)
        self.stds = matrix(table["stds"], 3 * n_static)
        last = first + size - 1
        ahead = self.ix[-1] > last
        near_left = (self.ix >= first - REACH) & (self.ix < first + REACH) & (first > 0)
        near_right = (self.ix > last - REACH) & (self.ix <= last + REACH) & ahead
        self.left = np.flatnonzero(near_left)
        self.right = np.flatnonzero(near_right)
        self.inner = np.flatnonzero(self.own & ~near_left & ~near_right)
        slope = _slope(len(self.ix))
        self.rows = [w[self.own] for w in (np.eye(len(self.ix)), slope, slope @ slope)]

    def system(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.zeros((len(self.ix), len(self.ix)))
        r = np.zeros(len(self.ix))
        for order, w in enumerate(self.rows):
            column = order * self.n_static + d
            precision = 1 / (self.stds[self.own, column] ** 2 + 1e-30)
            a += (w.T * precision) @ w
            r += w.T @ (precision * self.means[self.own, column])
        return a, r

    def reduced(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """What the segment says about its border frames alone."""
        a, r = self.system(d)
        border = np.r_[self.left, self.right]
        if not len(self.inner):
            return a[np.ix_(border, border)], r[border]
        coupling = a[np.ix_(self.inner, border)]
        solved = np.linalg.solve(
            a[np.ix_(self.inner, self.inner)], np.column_stack([coupling, r[self.inner]])
        )
        return (
            a[np.ix_(border, border)] - coupling.T @ solved[:, :-1],
            r[border] - coupling.T @ solved[:, -1],
        )

    def solved(self, d: int, border_values: np.ndarray) -> np.ndarray:
        """The segment's own frames, given the border frames."""
        a, r = self.system(d)
        c = np.zeros(len(self.ix))
        border = np.r_[self.left, self.right]
        c[border] = border_values
        if len(self.inner):
            rest = r[self.inner] - a[np.ix_(self.inner, border)] @ border_values
            c[self.inner] = np.linalg.solve(a[np.ix_(self.inner, self.inner)], rest)
        return c[self.own]


class _Chain:
    """Consecutive parts, each a system over its left and right border."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("_seg")
        self.table = table
        systems, self.borders, n = [], [], 0
        for n_left, s, g in zip(
            table["n_left"].to_pylist(), table["s"].to_pylist(), table["g"].to_pylist()
        ):
            systems.append((np.array(s, dtype=float).reshape(len(g), len(g)), np.array(g, dtype=float)))
            for size in ([n_left] if not self.borders else []) + [len(g) - n_left]:
                self.borders.append(np.arange(n, n + size))
                n += size
        self.a, self.r = np.zeros((n, n)), np.zeros(n)
        for k, (s, g) in enumerate(systems):
            at = self.part(k)
            self.a[np.ix_(at, at)] += s
            self.r[at] += g
        self.outer = np.r_[self.borders[0], self.borders[-1]]
        self.inner = np.setdiff1d(np.arange(n), self.outer)

    def part(self, k: int) -> np.ndarray:
        return np.r_[self.borders[k], self.borders[k + 1]]

    def condensed(self) -> tuple[int, np.ndarray, np.ndarray]:
        """The chain as one part over its outer borders."""
        coupling = self.a[np.ix_(self.inner, self.outer)]
        s, g = self.a[np.ix_(self.outer, self.outer)], self.r[self.outer]
        if len(self.inner):
            solved = np.linalg.solve(
                self.a[np.ix_(self.inner, self.inner)],
                np.column_stack([coupling, self.r[self.inner]]),
            )
            s, g = s - coupling.T @ solved[:, :-1], g - coupling.T @ solved[:, -1]
        return len(self.borders[0]), s, g

    def expanded(self, outer_values: np.ndarray) -> list[np.ndarray]:
        """Border values of every part, given those of the outer borders."""
        x = np.zeros(len(self.r))
        x[self.outer] = outer_values
        if len(self.inner):
            rest = self.r[self.inner] - self.a[np.ix_(self.inner, self.outer)] @ outer_values
            x[self.inner] = np.linalg.solve(self.a[np.ix_(self.inner, self.inner)], rest)
        return [x[self.part(k)] for k in range(len(self.borders) - 1)]


def _solved_borders(reduced: DataFrame, utt_type: str, fan: int) -> DataFrame:
    """``(utt, _seg, channel, values)``. A chain of more than ``fan`` parts is
    condensed group by group until it is short, then expanded again."""
    part_schema = (
        f"utt {utt_type}, _seg bigint, channel int, n_left int, s array<double>, g array<double>"
    )
    value_schema = f"utt {utt_type}, _seg bigint, channel int, values array<double>"

    def condense(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        n_left, s, g = _Chain(table).condensed()
        numbers = pa.list_(pa.float64())
        return pa.table({
            "utt": pa.array([key[0].as_py()], table["utt"].type),
            "_seg": pa.array([key[2].as_py()], pa.int64()),
            "channel": pa.array([key[1].as_py()], pa.int32()),
            "n_left": pa.array([n_left], pa.int32()),
            "s": pa.array([s.ravel()], numbers), "g": pa.array([g], numbers),
        })

    def values_of(table: pa.Table, outer: np.ndarray) -> pa.Table:
        chain = _Chain(table)
        return chain.table.select(["utt", "_seg", "channel"]).append_column(
            "values", pa.array(chain.expanded(outer), pa.list_(pa.float64()))
        )

    def solve(table: pa.Table) -> pa.Table:
        return values_of(table, np.array([]))

    def expand(key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table) -> pa.Table:
        return values_of(table, np.array(known["values"][0].as_py(), dtype=float))

    group = F.floor(F.col("_seg") / fan).alias("_group")
    levels = [reduced]
    longest = reduced.agg(F.max("_seg").alias("n")).collect()[0]["n"] or 0
    while longest >= fan:
        upper = levels[-1].groupBy("utt", "channel", group).applyInArrow(condense, part_schema)
        levels.append(upper)
        longest //= fan
    values = levels.pop().groupBy("utt", "channel").applyInArrow(solve, value_schema)
    while levels:
        values = levels.pop().groupBy("utt", "channel", group).cogroup(
            values.groupBy("utt", "channel", "_seg")
        ).applyInArrow(expand, value_schema)
    return values


def trajectory(
    params: DataFrame, n_static: int, segment: int = SEGMENT, fan: int = FAN
) -> DataFrame:
    """``(utt, frame_ix, feats)``: static, delta and delta-delta trajectory of rows
    ``(utt, frame_ix, means, stds)`` holding the same three blocks."""
    if segment < 2 * MARGIN:
        raise ValueError(f"a segment needs at least {2 * MARGIN} frames")
    rows = segmented(params.select("utt", "frame_ix", "means", "stds"), MARGIN, segment=segment)
    utt_type = params.schema["utt"].dataType.simpleString()

    def reduce(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = _Segment(table, key[1].as_py() * segment, segment, n_static)
        found = []
        if part.own.any() and len(part.left) + len(part.right):
            for d in range(n_static):
                s, g = part.reduced(d)
                found.append((d, len(part.left), s.ravel(), g))
        return pa.table({
            "utt": pa.array([key[0].as_py()] * len(found), table["utt"].type),
            "_seg": pa.array([key[1].as_py()] * len(found), pa.int64()),
            "channel": pa.array([f[0] for f in found], pa.int32()),
            "n_left": pa.array([f[1] for f in found], pa.int32()),
            "s": pa.array([f[2] for f in found], pa.list_(pa.float64())),
            "g": pa.array([f[3] for f in found], pa.list_(pa.float64())),
        })

    def fill(
        key: tuple[pa.Scalar, ...], table: pa.Table, known: pa.Table
    ) -> pa.Table:
        names = ["utt", "frame_ix", "feats"]
        part = _Segment(table, key[1].as_py() * segment, segment, n_static) if len(table) else None
        if part is None or not part.own.any():
            kinds = [known["utt"].type, pa.int32(), pa.list_(pa.float64())]
            return pa.table([pa.array([], k) for k in kinds], names=names)
        at = {c: np.array(v) for c, v in zip(known["channel"].to_pylist(), known["values"].to_pylist())}
        static = np.stack(
            [part.solved(d, at.get(d, np.array([]))) for d in range(n_static)], axis=1
        )
        n = int(part.own.sum())
        return pa.table(
            [pa.array([key[0].as_py()] * n, table["utt"].type),
             pa.array(part.ix[part.own], pa.int32()), list_column(static)], names=names,
        )

    reduced = rows.groupBy("utt", "_seg").applyInArrow(
        reduce, f"utt {utt_type}, _seg bigint, channel int, n_left int, "
                "s array<double>, g array<double>"
    )
    solved = _solved_borders(cut_lineage(reduced), utt_type, fan)
    static = rows.groupBy("utt", "_seg").cogroup(solved.groupBy("utt", "_seg")).applyInArrow(
        fill, f"utt {utt_type}, frame_ix int, feats array<double>"
    )
    return dynamic_features(static, n_static)


def _judged(rows: DataFrame, n_components: int, n_targets: int) -> DataFrame:
    """Add the component densities (times priors) and their sum's logarithm."""
    densities = component_densities(
        F.col("feats"), F.col("means_k"), F.col("stds_k"), n_components, n_targets
    )
    rows = rows.withColumn("dens", F.zip_with("priors", densities, lambda p, d: p * d))
    total = F.aggregate("dens", F.lit(0.0), lambda acc, x: acc + x)
    return rows.withColumn("total", total)


def mixture_trajectory(
    mixture: DataFrame, n_components: int, n_static: int, n_steps: int = 10,
    segment: int = SEGMENT,
) -> DataFrame:
    """Trajectory of frames with ``priors``, ``means`` and ``stds`` of a mixture.

    It starts from the prior-weighted parameters. Each step weighs them by the
    components' occupancy instead; an utterance takes the step while its
    log-likelihood rises and keeps its trajectory otherwise.
    """
    n_targets = 3 * n_static
    size = (n_components, n_targets)
    base = cut_lineage(mixture.select(
        "utt", "frame_ix", "priors", F.col("means").alias("means_k"), F.col("stds").alias("stds_k")
    ))

    def follow(rows: DataFrame, weights: str) -> tuple[DataFrame, DataFrame]:
        params = rows.select(
            "utt", "frame_ix",
            weighted_components(F.col(weights), F.col("means_k"), *size).alias("means"),
            weighted_components(F.col(weights), F.col("stds_k"), *size).alias("stds"),
        )
        path = trajectory(params, n_static, segment)
        keep = rows.select("utt", "frame_ix", "priors", "means_k", "stds_k")
        state = cut_lineage(_judged(keep.join(path, ["utt", "frame_ix"]), *size))
        scores = state.groupBy("utt").agg(
            F.sum(F.ln(F.col("total") + F.lit(1e-30))).alias("score")
        )
        return state, cut_lineage(scores)

    state, scores = follow(base, "priors")
    done = None
    for _ in range(n_steps):
        shares = state.withColumn(
            "share", F.transform("dens", lambda x: x / (F.col("total") + F.lit(1e-30)))
        )
        new_state, new_scores = follow(shares, "share")
        better = cut_lineage(
            new_scores.join(scores.withColumnRenamed("score", "old"), "utt")
            .where(F.col("score") > F.col("old")).select("utt", "score")
        )
        kept = state.join(better, "utt", "left_anti").select("utt", "frame_ix", "feats")
        done = kept if done is None else done.unionByName(kept)
        if better.limit(1).count() == 0:
            return done
        state = new_state.join(better, "utt", "left_semi")
        scores = better
    return done.unionByName(state.select("utt", "frame_ix", "feats"))
