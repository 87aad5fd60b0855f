"""Column expressions over feature vectors (``ARRAY<DOUBLE>``)."""

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNROLL_LIMIT = 16


def vector(fn: Callable[..., Column], *arrays: Column, width: int) -> Column:
    """Apply ``fn(a_i, b_i, ...)`` to every position of same-width arrays.

    Narrow vectors are written out position by position, which keeps the
    arithmetic in generated code; wide ones use one ``transform``. A NULL array
    reads as NULL everywhere. Widths are checked once, where vectors enter an
    operator (``of_width``): a condition around the result would keep what
    follows from reading its positions without the array.
    """
    if width <= UNROLL_LIMIT:
        return F.array(
            *[fn(*[F.get(a, F.lit(i)) for a in arrays]) for i in range(width)]
        )
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: fn(*[F.get(a, i) for a in arrays]),
    )


def of_width(rows: DataFrame, width: int, *columns: str) -> DataFrame:
    """All rows; a vector that is not NULL and has another width fails the job."""
    fits = [F.col(c).isNull() | (F.size(c) == width) for c in columns or ("feats",)]
    message = F.lit(f"a vector has another width than {width}")
    return rows.where(F.when(reduce(and_, fits), True).otherwise(F.raise_error(message)))


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def pick(feats: Column, indices: Sequence[int]) -> Column:
    """Channels at the given positions, in the asked order."""
    return F.array(*[F.get(feats, F.lit(int(i))) for i in indices])


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def product(array: Column) -> Column:
    return F.aggregate(array, F.lit(1.0), lambda acc, x: acc * x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b); NULL when either vector is all zero."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def interlaced(
    main: Column, n_main: int, binary: Column, positions: Sequence[int]
) -> Column:
    """Place binary channels at ``positions`` of the final layout."""
    n_total = n_main + len(positions)
    if sorted(set(positions)) != list(positions) or not all(
        0 <= p < n_total for p in positions
    ):
        raise ValueError("positions must increase and lie in the final layout")
    place = {p: i for i, p in enumerate(positions)}
    rest = iter(range(n_main))
    return F.array(
        *[
            F.get(binary, F.lit(place[p])) if p in place
            else F.get(main, F.lit(next(rest)))
            for p in range(n_total)
        ]
    )


def softmax(array: Column) -> Column:
    top = F.array_max(array)
    exps = F.transform(array, lambda x: F.exp(x - top))
    return F.transform(exps, lambda x: x / total(exps))
