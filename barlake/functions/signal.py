"""Signal primitives on numpy, for grouped maps: what a window expression cannot do.

Zero-phase filters run backwards in time, and peak prominence looks arbitrarily far, so neither is a window.
"""

from __future__ import annotations

import numpy as np

from .columns import TIE


def cumulative_area(y: np.ndarray, t: np.ndarray) -> np.ndarray:
    out = np.zeros(len(y))
    np.cumsum(np.diff(t) * (y[1:] + y[:-1]) / 2, out=out[1:])
    return out


def butterworth2(hz: float, fs: float, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Second-order Butterworth section (numerator, denominator), by the bilinear transform; cutoff at most 0.99 Nyquist."""
    w = np.tan(np.pi * min(0.99, hz / (fs / 2)) / 2)
    scale = 1 / (1 + np.sqrt(2) * w + w * w)
    den = np.array([1.0, 2 * (w * w - 1) * scale, (1 - np.sqrt(2) * w + w * w) * scale])
    num = np.array([1.0, -2.0, 1.0]) * scale if kind == "high" else np.array([1.0, 2.0, 1.0]) * (w * w * scale)
    return num, den


def _section(num: np.ndarray, den: np.ndarray, x: np.ndarray) -> np.ndarray:
    """One pass, begun in the steady state of the first sample (transposed direct form)."""
    b0, b1, b2 = map(float, num)
    _, a1, a2 = map(float, den)
    rest = (b0 + b1 + b2) / (1 + a1 + a2)
    s2 = (b2 - a2 * rest) * x[0]
    s1 = (b1 - a1 * rest) * x[0] + s2
    out = np.empty(len(x))
    for k, v in enumerate(x.tolist()):
        y = b0 * v + s1
        s1 = b1 * v - a1 * y + s2
        s2 = b2 * v - a2 * y
        out[k] = y
    return out


def zero_phase(x: np.ndarray, hz: float, fs: float, kind: str, pad: int = 9) -> np.ndarray:
    """Filters forwards and backwards over an odd extension of pad samples; a shorter series is padded by what it has."""
    x = np.asarray(x, float)
    pad = min(pad, len(x) - 1)
    if pad < 1:
        return x.copy()
    num, den = butterworth2(hz, fs, kind)
    longer = np.concatenate((2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]))
    there = _section(num, den, longer)
    return _section(num, den, there[::-1])[::-1][pad:-pad]


def tops(x: np.ndarray) -> np.ndarray:
    """Local maxima, the middle of a flat one; neither end is one."""
    change = np.flatnonzero(np.diff(x) != 0)
    starts, ends = np.concatenate(([0], change + 1)), np.concatenate((change, [len(x) - 1]))
    level = x[starts]
    top = np.flatnonzero((level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])) + 1 if len(level) > 2 else np.zeros(0, int)
    return (starts[top] + ends[top]) // 2


def peaks(x: np.ndarray, distance: int = 1, prominence: float = 0.0) -> np.ndarray:
    """Local maxima, thinned by distance with the highest first (of equal ones the last), then by prominence, reached to within TIE."""
    x = np.asarray(x, float)
    found = tops(x) if len(x) else np.zeros(0, int)
    kept = found[~suppressed(found, x[found], distance)]
    return kept[prominences(x, kept) >= prominence - TIE] if len(kept) else kept


def suppressed(at: np.ndarray, height: np.ndarray, distance: int) -> np.ndarray:
    """Which of the peaks lie within a distance of a higher one that stays; each looks only at its neighbours."""
    gone, places = np.zeros(len(at), bool), at.tolist()
    for k in np.argsort(height, kind="stable")[::-1].tolist():
        if gone[k]:
            continue
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(places) and abs(places[j] - places[k]) < distance:
                gone[j] = True
                j += step
    return gone


def prominences(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Height of each of these local maxima over the higher of the two lowest points on the way to anything higher.

    Between two maxima next to each other only the lowest point counts, so a stack of ever lower maxima needs one pass from
    either side; the ends count as maxima.
    """
    if not len(at):
        return np.zeros(0)
    every = np.unique(np.concatenate(([0], tops(x), [len(x) - 1])))

    def bases(y: np.ndarray, p: np.ndarray) -> np.ndarray:
        """The lowest point back to anything higher, for each maximum."""
        low, out = np.minimum.reduceat(y, np.concatenate(([0], p[:-1] + 1))).tolist(), []
        stack: list[tuple[float, float]] = []  # height, and the lowest since what is higher
        for h, base in zip(y[p].tolist(), low):
            while stack and stack[-1][0] <= h:
                base = min(base, stack.pop()[1])
            out.append(base)
            stack.append((h, base))
        return np.array(out)

    base = np.maximum(bases(x, every), bases(x[::-1], len(x) - 1 - every[::-1])[::-1])
    return x[at] - base[np.searchsorted(every, at)]


def prominence_of(x: np.ndarray, p: int) -> float:
    """Prominence of one sample, by looking both ways for anything higher."""
    left, right = np.flatnonzero(x[:p] > x[p]), np.flatnonzero(x[p + 1 :] > x[p])
    a = left[-1] + 1 if len(left) else 0
    b = p + 1 + right[0] if len(right) else len(x)
    return float(x[p] - max(x[a : p + 1].min(), x[p:b].min()))


def smooth(x: np.ndarray, width: int, degree: int = 2, derivative: int = 0, dt: float = 1.0) -> np.ndarray:
    """Least-squares polynomial over a moving odd window; the ends take the first and last window's polynomial."""
    x, half = np.asarray(x, float), width // 2
    at = np.arange(-half, half + 1.0)
    fit = np.linalg.pinv(np.vander(at, degree + 1, increasing=True))
    out = np.empty(len(x))
    kernel = fit[derivative] * (1 if derivative == 0 else 1 / dt)
    out[half : len(x) - half] = np.convolve(x, kernel[::-1], "valid")
    for part, where in ((x[:width], slice(0, half)), (x[-width:], slice(len(x) - half, len(x)))):
        coef = fit @ part
        place = at[:half] if where.start == 0 else at[-half:]
        if derivative == 0:
            out[where] = np.vander(place, degree + 1, increasing=True) @ coef
        else:
            out[where] = sum(n * coef[n] * place ** (n - 1) for n in range(1, degree + 1)) / dt
    return out


def odd_window(seconds: float, fs: float, n: int, rounded: bool = False) -> int:
    """An odd width of about that many seconds, at least 5 and at most what n samples allow."""
    width = max(5, (round(fs * seconds) if rounded else int(fs * seconds)) | 1)
    return min(width, (n // 2) * 2 - 1) if n > 7 else 5


def median_filter(x: np.ndarray, width: int) -> np.ndarray:
    """Rolling median with zeros beyond the ends."""
    half = width // 2
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(x, float), half), width), axis=1)


def turns(x: np.ndarray) -> np.ndarray:
    """Samples before a change of sign; zero counts as positive."""
    s = np.where(x < 0, -1, 1)
    return np.flatnonzero(s[1:] != s[:-1])


def spread(x: np.ndarray) -> float:
    """From the 5th to the 95th percentile; 0 for nothing."""
    return float(np.subtract(*np.percentile(x, [95, 5]))) if len(x) else 0.0


def anchored_velocity(t: np.ndarray, a: np.ndarray, anchors) -> np.ndarray:
    """Integral of a, brought to 0 at the ends and each anchor by a drift linear in the sample number."""
    area = cumulative_area(a, t)
    bounds = np.unique([0, *anchors, len(t) - 1])
    return area - np.interp(np.arange(len(t)), bounds, area[bounds])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products of a and b at all shifts, the last of b against the first of a first; by Fourier transform."""
    n = len(a) + len(b) - 1
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b[::-1], size), size)[:n]


def correlate_lags(x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """Greatest cross-correlation of the standardised series by size, over their length, and its lag."""
    a, b = (x - x.mean()) / (x.std() + 1e-9), (y - y.mean()) / (y.std() + 1e-9)
    c = products(a, b) / min(len(a), len(b))
    k = int(np.argmax(np.abs(c)))
    return float(c[k]), k - (len(b) - 1)


def periodicity(y: np.ndarray, least: int = 3) -> tuple[float, int]:
    """Greatest autocorrelation of the detrended series at lags from `least` to half its length, and that lag."""
    y, n = np.asarray(y, float), len(y)
    if n < 2 * least + 2:
        return 0.0, 0
    x = np.arange(n) - (n - 1) / 2
    y = y - y.mean() - x * (x @ y) / (x @ x)
    power = float(y @ y)
    if power <= 1e-12:
        return 0.0, 0
    r = products(y, y)[n - 1 :] / power
    k = least + int(np.argmax(r[least : max(least + 1, n // 2 + 1)]))
    return max(0.0, float(r[k])), k
