"""Small numpy helpers for tasks: each works on one bounded batch or segment."""

from functools import lru_cache

import numpy as np

# --- splines ----------------------------------------------------------------


def spline_second_derivatives(
    x: np.ndarray, y: np.ndarray, free_left: bool, free_right: bool
) -> np.ndarray:
    """Second derivatives of the interpolating cubic spline at its knots.

    A free end is the true end of a series and gets the not-a-knot condition;
    the other ends lie in a margin, where any condition (here: zero) fades.
    """
    h = np.diff(x)
    slope = np.diff(y) / h
    low, high = h[:-1] / (h[:-1] + h[1:]), h[1:] / (h[:-1] + h[1:])
    diag = np.full(len(h) - 1, 2.0)
    rhs = 6 * np.diff(slope) / (h[:-1] + h[1:])
    if free_left:
        ratio = h[0] / h[1]
        diag[0] += low[0] * (1 + ratio)
        high[0] -= low[0] * ratio
    if free_right:
        ratio = h[-1] / h[-2]
        diag[-1] += high[-1] * (1 + ratio)
        low[-1] -= high[-1] * ratio
    inner = _tridiagonal(low, diag, high, rhs)
    m = np.zeros(len(x))
    m[1:-1] = inner
    if free_left:
        m[0] = m[1] + (h[0] / h[1]) * (m[1] - m[2])
    if free_right:
        m[-1] = m[-2] + (h[-1] / h[-2]) * (m[-2] - m[-3])
    return m


def _tridiagonal(low, diag, high, rhs):
    """Solve rows low*m[j-1] + diag*m[j] + high*m[j+1] = rhs by elimination."""
    n = len(rhs)
    up, out = np.empty(n), np.empty(n)
    up_j = out_j = 0.0
    for j, (lo, d, hi, r) in enumerate(
        zip(low.tolist(), diag.tolist(), high.tolist(), rhs.tolist())
    ):
        pivot = d - lo * up_j if j else d
        up_j = hi / pivot
        out_j = (r - lo * out_j) / pivot if j else r / pivot
        up[j], out[j] = up_j, out_j
    for j in range(n - 2, -1, -1):
        out[j] -= up[j] * out[j + 1]
    return out


# --- Butterworth low-pass ---------------------------------------------------


def butterworth(order: int, cutoff: float, sampling_rate: float):
    """Digital low-pass as (zeros, poles, gain), by the bilinear transform."""
    wn = 2 * cutoff / sampling_rate
    if not 0 < wn < 1:
        raise ValueError("the cutoff must lie below half the sampling rate")
    warped = 4 * np.tan(np.pi * wn / 2)
    angles = np.pi * (2 * np.arange(order) + 1 + order) / (2 * order)
    analog = warped * np.exp(1j * angles)
    poles = (4 + analog) / (4 - analog)
    zeros = -np.ones(order)
    gain = float(np.real(warped**order / np.prod(4 - analog)))
    return zeros, poles, gain


def fade_length(poles: np.ndarray, rest: float = 1e-18) -> int:
    """Samples after which the filter's memory has fallen below ``rest``."""
    return int(np.ceil(np.log(rest) / np.log(np.abs(poles).max()))) + len(poles) * 16


def zero_phase_lowpass(
    x: np.ndarray, order: int, cutoff: float, sampling_rate: float,
    true_start: bool, true_end: bool,
) -> np.ndarray:
    """Filter columns forward and backward.

    At a true end the series is first extended by its odd mirror image. Each
    pass starts from rest at the level of its first value, that is, as if this
    value had gone on for ever; a constant run of fading length stands for it.
    """
    zeros, poles, gain = butterworth(order, cutoff, sampling_rate)
    fade = fade_length(poles)
    mirror = 3 * (order + 1)
    if (true_start or true_end) and len(x) <= mirror:
        raise ValueError(f"a series of {len(x)} frames is too short to filter")
    parts = [x]
    if true_start:
        parts.insert(0, 2 * x[0] - x[mirror:0:-1])
    if true_end:
        parts.append(2 * x[-1] - x[-2:-mirror - 2:-1])
    ext = np.concatenate(parts)
    size = 1 << int(np.ceil(np.log2(len(ext) + 2 * fade)))
    unit = np.exp(-2j * np.pi * np.arange(size // 2 + 1) / size)
    response = np.full(len(unit), gain, dtype=complex)
    for z, p in zip(zeros, poles):
        response *= (1 - z * unit) / (1 - p * unit)

    def one_pass(signal: np.ndarray) -> np.ndarray:
        run = np.concatenate([np.repeat(signal[:1], fade, axis=0), signal])
        spectrum = np.fft.rfft(run - signal[:1], size, axis=0) * response[:, None]
        filtered = np.fft.irfft(spectrum, size, axis=0)[fade:fade + len(signal)]
        return filtered + signal[:1]

    smooth = one_pass(one_pass(ext)[::-1])[::-1]
    start = mirror if true_start else 0
    return smooth[start:start + len(x)]


# --- resampling -------------------------------------------------------------


def fft_resample(x: np.ndarray, n_out: int) -> np.ndarray:
    """Resample columns to ``n_out`` rows through their spectrum."""
    n = len(x)
    if n_out == n:
        return x
    low = min(n, n_out)
    spectrum = np.fft.rfft(x, axis=0)[: low // 2 + 1]
    if low % 2 == 0:
        # The middle bin stands for two frequencies of the longer series.
        spectrum[low // 2] *= 2 if n_out < n else 0.5
    return np.fft.irfft(spectrum, n_out, axis=0) * (n_out / n)


# --- linear prediction ------------------------------------------------------


def linear_prediction(frames: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients per frame and the RMS of the prediction error.

    Levinson's recursion over all frames of the batch at once. A silent frame
    has no solution and gives NaN.
    """
    n = frames.shape[1]
    order = min(order, n - 1)
    r = np.stack(
        [np.einsum("fi,fi->f", frames[:, : n - k], frames[:, k:]) for k in range(order + 1)],
        axis=1,
    )
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.zeros((len(frames), order))
        power = r[:, 0].copy()
        for m in range(order):
            gap = r[:, m + 1] - np.einsum("fi,fi->f", a[:, :m], r[:, m:0:-1])
            k = gap / power
            if m:
                a[:, :m] = a[:, :m] - k[:, None] * a[:, m - 1::-1][:, :m]
            a[:, m] = k
            power = power * (1 - k * k)
    predicted = np.zeros((len(frames), n - order))
    for m in range(order):
        predicted += a[:, m:m + 1] * frames[:, order - 1 - m:n - 1 - m]
    error = frames[:, order:] - predicted
    return a, np.sqrt(np.mean(error * error, axis=1))


def _divided(poly: np.ndarray, step: int, sign: float) -> np.ndarray:
    """Divide polynomials by 1 + sign * z^step, dropping the remainder."""
    out = poly[:, :-step].copy()
    for i in range(step, out.shape[1]):
        out[:, i] -= sign * out[:, i - step]
    return out


def _roots(poly: np.ndarray) -> np.ndarray:
    degree = poly.shape[1] - 1
    companion = np.zeros((len(poly), degree, degree))
    companion[:, np.arange(1, degree), np.arange(degree - 1)] = 1
    companion[:, 0, :] = -poly[:, 1:] / poly[:, :1]
    return np.linalg.eigvals(companion)


def line_spectrum(lpc: np.ndarray) -> np.ndarray:
    """Line spectral frequencies in [0, pi]; frames without any give zeros."""
    with np.errstate(divide="ignore", invalid="ignore"):
        lead = lpc / lpc[:, :1]
    good = np.isfinite(lead).all(axis=1)
    poly = np.concatenate([lead[good], np.zeros((good.sum(), 1))], axis=1)
    diff, summ = poly - poly[:, ::-1], poly + poly[:, ::-1]
    if poly.shape[1] % 2:
        diff = _divided(diff, 2, -1.0)
    else:
        diff, summ = _divided(diff, 1, -1.0), _divided(summ, 1, 1.0)
    out = np.zeros((len(lpc), lpc.shape[1] - 1))
    if good.any():
        angles = [np.abs(np.angle(_roots(p)[:, ::2])) for p in (diff, summ)]
        out[good] = np.sort(np.concatenate(angles, axis=1), axis=1)
    return out


def _times(poly: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Multiply polynomials row by row."""
    out = np.zeros((len(poly), poly.shape[1] + factor.shape[1] - 1))
    for i in range(factor.shape[1]):
        out[:, i:i + poly.shape[1]] += factor[:, i:i + 1] * poly
    return out


def prediction_from_lines(lsf: np.ndarray) -> np.ndarray:
    """Coefficients, the first one 1, whose line spectrum is given."""
    def from_angles(angles: np.ndarray) -> np.ndarray:
        poly = np.ones((len(lsf), 1))
        for column in angles.T:
            ones = np.ones_like(column)
            poly = _times(poly, np.stack([ones, -2 * np.cos(column), ones], axis=1))
        return poly

    def fixed(*values: float) -> np.ndarray:
        return np.tile(np.array(values, dtype=float), (len(lsf), 1))

    diff, summ = from_angles(lsf[:, 1::2]), from_angles(lsf[:, ::2])
    if lsf.shape[1] % 2:
        diff = _times(diff, fixed(1, 0, -1))
    else:
        diff, summ = _times(diff, fixed(1, -1)), _times(summ, fixed(1, 1))
    return ((diff + summ) / 2)[:, :-1]


# --- cepstra ----------------------------------------------------------------


def _mel(hz: np.ndarray) -> np.ndarray:
    """Mel scale that is linear below 1 kHz and logarithmic above."""
    hz = np.asarray(hz, dtype=float)
    above = 15 + 27 * np.log(np.maximum(hz, 1000.0) / 1000) / np.log(6.4)
    return np.where(hz < 1000, hz * 3 / 200, above)


def _hertz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * 6.4 ** ((mel - 15) / 27))


def mel_bank(sampling_rate: float, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters of unit area, ``(n_mels, n_fft // 2 + 1)``."""
    bins = np.linspace(0, sampling_rate / 2, n_fft // 2 + 1)
    edges = _hertz(np.linspace(0, _mel(sampling_rate / 2), n_mels + 2))
    rise = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    fall = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(rise, fall)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def mel_decibels(frames: np.ndarray, bank: np.ndarray) -> np.ndarray:
    """Mel band power of Hann-windowed frames, in dB."""
    n = frames.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft(frames * hann, axis=1)) ** 2
    return 10 * np.log10(np.maximum(power @ bank.T, 1e-10))


def cosine_basis(n_coeff: int, n_bands: int) -> np.ndarray:
    """Orthonormal type-II cosine basis, ``(n_coeff, n_bands)``."""
    k, j = np.arange(n_coeff)[:, None], np.arange(n_bands)[None, :]
    basis = np.cos(np.pi * k * (j + 0.5) / n_bands) * np.sqrt(2 / n_bands)
    basis[0] /= np.sqrt(2)
    return basis


# --- token sequences --------------------------------------------------------

HASH_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int, base: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))


def _powers_to(n: int, base: int = HASH_BASE) -> np.ndarray:
    """Powers 0 to n of the base, modulo 2**64; those of common sizes are kept."""
    common = 4 << 20
    return _powers(common, base)[:n + 1] if n <= common else _powers.__wrapped__(n, base)


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Polynomial hash, modulo 2**64, of each text ``data[offsets[i]:offsets[i + 1]]``."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _powers_to(n)[:n], out=total[1:])
    shift = _powers_to(n, pow(HASH_BASE, -1, 2**64))
    return (total[offsets[1:]] - total[offsets[:-1]]) * shift[offsets[:-1]]


def trigram_hashes(data: np.ndarray, offsets: np.ndarray, joiner: str) -> np.ndarray:
    """64-bit hashes of every three consecutive tokens joined; equal strings, equal hashes."""
    if len(offsets) < 4:
        return np.zeros(0, np.uint64)
    glue = np.frombuffer(joiner.encode(), np.uint8)
    between = text_hashes(glue, np.array([0, len(glue)]))[0]
    h, size = text_hashes(data, offsets), np.diff(offsets)
    after = _powers_to(int(size.max()) + len(glue))
    out = h[2:]
    for at in (1, 0):
        out = h[at:at + len(out)] + after[size[at:at + len(out)]] * (between + after[len(glue)] * out)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))
