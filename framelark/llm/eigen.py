"""Leading eigenpairs of a small symmetric matrix, as needed on the driver.

Householder reflections bring the matrix to tridiagonal form, bisection on
Sturm counts finds the leading eigenvalues, inverse iteration their vectors.
Vectors of eigenvalues that lie close together are made orthogonal again in
every step.
"""

import numpy as np

EPS = np.finfo(float).eps
#: Eigenvalues nearer than this share of the matrix norm form a cluster.
CLUSTER = 1e-3
STEPS = 5


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray | None]]:
    """Diagonal, off-diagonal and the unit vectors of the reflections."""
    a = np.array(matrix, float)
    reflections: list[np.ndarray | None] = []
    for k in range(len(a) - 2):
        column = a[k + 1:, k].copy()
        if not column[1:].any():
            reflections.append(None)
            continue
        scale = np.abs(column).max()
        size = scale * np.linalg.norm(column / scale)
        image = -np.copysign(size, column[0])
        v = column / scale
        v[0] -= image / scale
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = p - (v @ p) * v
        rest -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1:, k] = a[k, k + 1:] = 0
        a[k + 1, k] = a[k, k + 1] = image
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def sturm_count(diagonal: np.ndarray, off: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """The number of eigenvalues below each shift."""
    tiny = np.finfo(float).tiny / EPS
    square = np.append(0.0, off * off)
    count = np.zeros(len(shifts), np.int64)
    q = np.ones(len(shifts))
    for d, s in zip(diagonal, square):
        q = d - shifts - s / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        count += q < 0
    return count


def leading_values(diagonal: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, to the last bits."""
    around = np.abs(np.append(off, 0.0)) + np.abs(np.append(0.0, off))
    n = len(diagonal)
    low = np.full(k, (diagonal - around).min())
    high = np.full(k, (diagonal + around).max())
    room = 2 * EPS * max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - room, high + room
    wanted = n - np.arange(k)  # counts above which the shift is beyond the value
    while True:
        middle = low + (high - low) / 2
        if ((middle <= low) | (middle >= high)).all():
            return middle
        above = sturm_count(diagonal, off, middle) >= wanted
        high, low = np.where(above, middle, high), np.where(above, low, middle)


def _solve(diagonal: np.ndarray, off: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Tridiagonal elimination with row exchanges; a pivot of 0 becomes ``least``."""
    n = len(diagonal)
    p, q, r = np.zeros(n), np.zeros(n), np.zeros(n)  # rows of the upper factor
    y = b.copy()
    head, side = diagonal[0], off[0] if n > 1 else 0.0
    for i in range(n - 1):
        below, after = off[i], off[i + 1] if i + 2 < n else 0.0
        if abs(head) >= abs(below):
            pivot = head if abs(head) > least else np.copysign(least, head)
            factor = below / pivot
            p[i], q[i], r[i] = pivot, side, 0.0
            head, side = diagonal[i + 1] - factor * side, after
            y[i + 1] -= factor * y[i]
        else:
            factor = head / below
            p[i], q[i], r[i] = below, diagonal[i + 1], after
            head, side = side - factor * diagonal[i + 1], -factor * after
            y[i], y[i + 1] = y[i + 1], y[i] - factor * y[i + 1]
    p[n - 1] = head if abs(head) > least else np.copysign(least, head)
    for i in range(n - 1, -1, -1):
        later = q[i] * y[i + 1] if i + 1 < n else 0.0
        later += r[i] * y[i + 2] if i + 2 < n else 0.0
        y[i] = (y[i] - later) / p[i]
        if abs(y[i]) > 1e200:
            y /= abs(y[i])
    return y


def leading_pairs(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as columns.

    A vector's entry of largest size is positive, so reruns agree.
    """
    n = len(matrix)
    k = min(k, n)
    size = np.abs(matrix).max()
    if size == 0:
        return np.zeros(k), np.eye(n)[:, :k]
    scale = 2.0 ** np.floor(np.log2(size))
    diagonal, off, reflections = tridiagonal(matrix / scale)
    values = leading_values(diagonal, off, k)
    norm = max(np.abs(diagonal).max(), np.abs(off).max() if n > 1 else 0.0, np.finfo(float).tiny)
    least = EPS * norm
    draw = np.random.Generator(np.random.PCG64(7))
    vectors = np.zeros((n, k))
    cluster = 0
    shift = np.inf
    for j, value in enumerate(values):
        if j and values[j - 1] - value > CLUSTER * norm:
            cluster = j
        # Equal values are told apart by a shift of a few last bits.
        shift = min(value, shift - 4 * least) if j > cluster else value
        y = draw.standard_normal(n)
        for _ in range(STEPS):
            y = _solve(diagonal - shift, off, y, least)
            y /= np.linalg.norm(y)
            for _ in range(2):
                y -= vectors[:, cluster:j] @ (vectors[:, cluster:j].T @ y)
            y /= np.linalg.norm(y)
        vectors[:, j] = y
    for i in range(len(reflections) - 1, -1, -1):
        v = reflections[i]
        if v is not None:
            vectors[i + 1:] -= 2 * np.outer(v, v @ vectors[i + 1:])
    vectors /= np.linalg.norm(vectors, axis=0)
    largest = vectors[np.abs(vectors).argmax(axis=0), np.arange(k)]
    return values * scale, vectors * np.where(largest < 0, -1, 1)
