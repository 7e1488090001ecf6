"""The signal kernels over whole sessions at once, as plain loops: what the block kernels are held against."""

import numpy as np

from ridgeline.operators.signal import butterworth_sos, savgol_params


def _fill(y: np.ndarray) -> np.ndarray:
    known = np.isfinite(y)
    return np.interp(np.arange(len(y)), np.flatnonzero(known), y[known]) if known.any() else y


def savgol(y: np.ndarray, dt: float, deriv: int, window: int = 11, order: int = 3) -> np.ndarray:
    """Savitzky-Golay derivative; the edges are the derivatives of polynomials through the outer windows.

    Missing samples are interpolated first. Fewer than three samples fall back
    to differences.
    """
    y = _fill(np.asarray(y, float))
    if not np.isfinite(y).all():
        return np.full(len(y), np.nan)
    fit = savgol_params(len(y), window, order)
    if fit is None:
        for _ in range(deriv):
            y = np.gradient(y, dt) if len(y) > 1 else np.full(len(y), np.nan)
        return y
    window, order = fit
    half = window // 2
    x = np.arange(-half, half + 1)
    solve = np.linalg.pinv(np.vander(x, order + 1, increasing=True))
    scale = np.prod(np.arange(1, deriv + 1)) / dt**deriv
    if deriv > order:
        return np.zeros(len(y))
    out = np.empty(len(y))
    out[half : len(y) - half] = np.lib.stride_tricks.sliding_window_view(y, window) @ solve[deriv] * scale
    for part, rows in ((y[:window], range(half)), (y[-window:], range(half + 1, window))):
        poly = np.polynomial.Polynomial(solve @ part)
        edge = poly.deriv(deriv)(x[list(rows)]) / dt**deriv
        if rows.start == 0:
            out[:half] = edge
        else:
            out[len(y) - half :] = edge
    return out


def _run_sos(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One pass through all sections, each begun in the steady state of its first input."""
    for b0, b1, b2, _, a1, a2 in sos:
        gain = (b0 + b1 + b2) / (1 + a1 + a2)
        first = x[0]
        s2 = b2 * first - a2 * gain * first
        s1 = b1 * first - a1 * gain * first + s2
        out = np.empty_like(x)
        for i, v in enumerate(x.tolist()):
            y = b0 * v + s1
            s1 = b1 * v - a1 * y + s2
            s2 = b2 * v - a2 * y
            out[i] = y
        x = out
    return x


def lowpass(y: np.ndarray, rate_hz: float, cutoff_hz: float, order: int = 4) -> np.ndarray | None:
    """Zero-phase low-pass: forward and backward over an odd extension; missing samples stay missing.

    None where there are fewer than three known samples or no more than the padding.
    """
    y = np.asarray(y, float)
    known = np.isfinite(y)
    if known.sum() < 3:
        return None
    sos = butterworth_sos(order, cutoff_hz, rate_hz)
    pad = 3 * (2 * len(sos) + 1 - min((sos[:, 2] == 0).sum(), (sos[:, 5] == 0).sum()))
    if len(y) <= pad:
        return None
    x = _fill(y)
    x = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    x = _run_sos(sos, _run_sos(sos, x)[::-1])[::-1][pad:-pad]
    return np.where(known, x, np.nan)


def find_peaks(y: np.ndarray, distance: int = 1, prominence: float | None = None) -> np.ndarray:
    """Indices of peaks (middle of plateaus), thinned by distance, highest first, then by prominence."""
    y = np.asarray(y, float)
    if len(y) < 3:
        return np.zeros(0, int)
    change = np.flatnonzero(np.diff(y) != 0)
    starts, ends = np.concatenate([[0], change + 1]), np.concatenate([change, [len(y) - 1]])
    level = y[starts]
    inner = np.arange(1, len(level) - 1)
    top = inner[(level[inner] > level[inner - 1]) & (level[inner] > level[inner + 1])]
    peaks = (starts[top] + ends[top]) // 2
    if distance > 1 and len(peaks):
        keep = np.ones(len(peaks), bool)
        for i in np.argsort(y[peaks], kind="stable")[::-1]:
            if keep[i]:
                near = np.abs(peaks - peaks[i]) < distance
                near[i] = False
                keep[near] = False
        peaks = peaks[keep]
    if prominence is not None:
        left = [y[p] - y[(np.flatnonzero(y[:p] > y[p])[-1:].tolist() or [-1])[0] + 1 : p + 1].min() for p in peaks]
        right = [y[p] - y[p : p + (np.flatnonzero(y[p + 1 :] > y[p])[:1].tolist() or [len(y)])[0] + 1].min() for p in peaks]
        peaks = peaks[np.minimum(left, right) >= prominence] if len(peaks) else peaks
    return peaks


def phased_crossings(y: np.ndarray, low: float, high: float, dwell: tuple[int, int, int] = (1, 1, 1), smooth: int = 1, direction: str = "rising") -> np.ndarray:
    """First index of the last phase of runs below low, between, above high in that order, each of its least length.

    Falling swaps the phases. The scan is greedy and goes on after the last run
    of a match; either merges both directions by index.
    """
    if direction == "either":
        return np.union1d(phased_crossings(y, low, high, dwell, smooth, "rising"), phased_crossings(y, low, high, dwell, smooth, "falling"))
    y = np.asarray(y, float)
    if smooth > 1 and len(y):
        y = np.convolve(y, np.ones(smooth) / smooth, "same")
    phase = np.where(y < low, -1, np.where(y > high, 1, 0))
    phase = np.where(np.isfinite(y), phase if direction == "rising" else -phase, 9)
    if not len(y):
        return np.zeros(0, int)
    first = np.concatenate([[0], np.flatnonzero(np.diff(phase)) + 1])
    length = np.diff(np.append(first, len(y)))
    out, i = [], 0
    while i + 2 < len(first):
        if all(phase[first[i + k]] == want and length[i + k] >= dwell[k] for k, want in enumerate((-1, 0, 1))):
            out.append(first[i + 2])
            i += 3
        else:
            i += 1
    return np.array(out, int)
