"""Signal operators in numpy, for grouped pandas functions: smoothing spline, time warping, baseline, smoothing, peaks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def solve_five(main: np.ndarray, near: np.ndarray, far: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solution of a positive definite symmetric system with diagonals ``main``, ``near`` (n - 1) and ``far`` (n - 2)."""
    n = len(main)
    d, one, two, z = ([0.0] * (n + 2) for _ in range(4))
    a, b, c, r = main.tolist(), [*near.tolist(), 0.0, 0.0][:n], [*far.tolist(), 0.0, 0.0, 0.0][:n], right.tolist()
    for i in range(n):  # index -1 and -2 are the two zeros at the end
        d[i] = a[i] - d[i - 1] * one[i - 1] ** 2 - d[i - 2] * two[i - 2] ** 2
        one[i] = (b[i] - d[i - 1] * one[i - 1] * two[i - 1]) / d[i]
        two[i] = c[i] / d[i]
        z[i] = r[i] - one[i - 1] * z[i - 1] - two[i - 2] * z[i - 2]
    x = [0.0] * (n + 2)
    for i in range(n - 1, -1, -1):
        x[i] = z[i] / d[i] - one[i] * x[i + 1] - two[i] * x[i + 2]
    return np.array(x[:n])


def smoothing_spline(x: np.ndarray, y: np.ndarray, lam: float, at: np.ndarray) -> np.ndarray:
    """Natural cubic smoothing spline (Reinsch 1967) at ``at``; linear outside the knots. x strictly increasing."""
    n = len(x)
    if n < 3:
        return np.interp(at, x, y)
    h = np.diff(x)
    u = 1 / h
    v = -(u[:-1] + u[1:])
    # R + lambda Q'Q is symmetric with five diagonals.
    main = (h[:-1] + h[1:]) / 3 + lam * (u[:-1] ** 2 + v**2 + u[1:] ** 2)
    gamma = solve_five(main, h[1:-1] / 6 + lam * u[1:-1] * (v[:-1] + v[1:]), lam * u[1:-2] * u[2:-1], np.diff(np.diff(y) * u))
    m = np.concatenate([[0.0], gamma, [0.0]])
    g = np.array(y, float)
    g[:-2] -= lam * u[:-1] * gamma
    g[1:-1] -= lam * v * gamma
    g[2:] -= lam * u[1:] * gamma
    k = np.clip(np.searchsorted(x, at, side="right") - 1, 0, n - 2)
    a, b = (x[k + 1] - at) / h[k], (at - x[k]) / h[k]
    inside = a * g[k] + b * g[k + 1] + ((a**3 - a) * m[k] + (b**3 - b) * m[k + 1]) * h[k] ** 2 / 6
    left = (g[1] - g[0]) / h[0] - h[0] * m[1] / 6
    right = (g[-1] - g[-2]) / h[-1] + h[-1] * m[-2] / 6
    return np.where(at < x[0], g[0] + left * (at - x[0]), np.where(at > x[-1], g[-1] + right * (at - x[-1]), inside))


def best_spline(x, y, xt, yt, lams) -> tuple[float, float]:
    """(lambda, R squared) of the spline that predicts a held-out part best."""
    spread = ((yt - yt.mean()) ** 2).sum()
    scored = [(1 - ((yt - smoothing_spline(x, y, lam, xt)) ** 2).sum() / spread if spread > 0 else 0.0, -lam) for lam in lams]
    r2, lam = max(scored)
    return -lam, r2


def dtw_distance(a: np.ndarray, b: np.ndarray, window: int | None = None) -> float:
    """Dynamic time warping distance (Sakoe and Chiba 1978), squared steps, root of the sum; a band if given.

    Cells of one anti-diagonal depend on the two before it only, so each is one numpy step.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float("nan")
    w = max(window if window is not None else max(n, m), abs(n - m))
    d = (np.asarray(a, float)[:, None] - np.asarray(b, float)[None, :]) ** 2
    # Indexed by the row: cells (i, k - i) of diagonals k - 2, k - 1 and k; row 0 and column 0 are the border.
    two, one = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    two[0] = 0.0
    for k in range(2, n + m + 1):
        new = np.full(n + 1, np.inf)
        i = np.arange(max(1, k - m), min(n, k - 1) + 1)
        i = i[np.abs(2 * i - k) <= w]
        new[i] = d[i - 1, k - i - 1] + np.minimum(np.minimum(one[i - 1], one[i]), two[i - 1])
        two, one = one, new
    return float(np.sqrt(one[n]))


def als_baseline(y: np.ndarray, lam: float = 1e4, p: float = 0.01, rounds: int = 10) -> np.ndarray:
    """Baseline by asymmetric least squares (Eilers and Boelens 2005)."""
    n = len(y)
    if n < 3:
        return np.zeros(n)
    main, near = np.zeros(n), np.zeros(n - 1)
    for i, c in enumerate((1.0, 4.0, 1.0)):
        main[i : n - 2 + i] += c
    near[:-1] -= 2
    near[1:] -= 2
    w, z = np.ones(n), y
    for _ in range(rounds):
        z = solve_five(w + lam * main, lam * near, np.full(n - 2, lam), w * y)
        w = np.where(y > z, p, 1 - p)
    return z


def savitzky_golay(y: np.ndarray, width: int, order: int = 2, deriv: int = 0) -> np.ndarray:
    """Local polynomial smoothing over an odd window; borders are extended by their own value."""
    half = width // 2
    x = np.arange(-half, half + 1)
    c = np.linalg.pinv(np.vander(x, order + 1, increasing=True))[deriv] * (1 if deriv < 2 else 2)
    return np.convolve(np.pad(y, half, mode="edge"), c[::-1], mode="valid")


def pick_peaks(x: np.ndarray, y: np.ndarray, width: int = 5) -> list[tuple[float, float]]:
    """(position, height) of the maxima of the smoothed trace whose second derivative is negative."""
    if len(y) < width:
        return []
    s, d2 = savitzky_golay(y, width), savitzky_golay(y, width, 2, 2)
    at = np.flatnonzero((s[1:-1] > s[:-2]) & (s[1:-1] >= s[2:]) & (d2[1:-1] < 0)) + 1
    return [(float(x[i]), float(y[i])) for i in at]


def gaussian_area(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    """(amplitude, mean, sd, area) by a weighted parabola through the logarithm of positive intensities."""
    keep = y > 0
    if keep.sum() < 3:
        return (float("nan"),) * 4
    c = np.polyfit(x[keep], np.log(y[keep]), 2, w=y[keep])
    if c[0] >= 0:
        return (float("nan"),) * 4
    sd, mean = np.sqrt(-1 / (2 * c[0])), -c[1] / (2 * c[0])
    if c[2] - c[1] ** 2 / (4 * c[0]) > 700:  # a peak far outside the trace, higher than numbers go
        return (float("nan"),) * 4
    top = np.exp(c[2] - c[1] ** 2 / (4 * c[0]))
    return float(top), float(mean), float(sd), float(top * sd * np.sqrt(2 * np.pi))


def ricker(width: float, reach: int) -> np.ndarray:
    """Ricker wavelet of a width in samples, at -reach..reach, of unit energy."""
    t = np.arange(-reach, reach + 1) / width
    return 2 / (np.sqrt(3 * width) * np.pi**0.25) * (1 - t**2) * np.exp(-(t**2) / 2)


def refined_sd(y: np.ndarray, at: int, sd: float) -> float:
    """sd of the Gaussian through the trace within 1.5 sd of ``at``, unless it is less than half or over twice ``sd``."""
    reach = max(1, int(np.ceil(1.5 * sd)))
    a = max(0, at - reach)
    part = np.asarray(y[a : at + reach + 1], float)
    got = gaussian_area(np.arange(len(part), dtype=float) + a - at, part)[2]
    return got if sd / 2 <= got <= 2 * sd else sd


#: Up to so many overlapping shapes every subset is tried (Akaike's criterion); of more, shapes are taken up one by one.
EXHAUSTIVE = 15


def best_subset(shapes: np.ndarray, y: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(columns of ``shapes``, their heights) whose least-squares fit to ``y`` has the least criterion n log(rss / n) + 6 k."""
    gram, right, whole, n, k = shapes.T @ shapes, shapes.T @ y, float(y @ y), len(y), shapes.shape[1]

    def fit(cols: list[int]) -> tuple[float, list[int], np.ndarray]:
        h = np.linalg.lstsq(gram[np.ix_(cols, cols)], right[cols], rcond=None)[0]
        rss = max(whole - 2 * float(h @ right[cols]) + float(h @ gram[np.ix_(cols, cols)] @ h), 1e-12)
        return n * np.log(rss / n) + 6 * len(cols), cols, h

    if k <= EXHAUSTIVE:
        return min((fit([j for j in range(k) if bits >> j & 1]) for bits in range(1, 1 << k)), key=lambda f: f[:2])[1:]
    best = (np.inf, [], np.empty(0))
    while len(best[1]) < k:
        new = min((fit([*best[1], j]) for j in range(k) if j not in best[1]), key=lambda f: f[:2])
        if new[0] >= best[0]:
            break
        best = new
    return best[1:]


def wavelet_peaks(x: np.ndarray, y: np.ndarray, scales=(1.5, 2, 3, 4, 6, 8, 12, 16, 24), min_fit: float = 0.5) -> list[tuple[float, float, float]]:
    """(position, height, sd) of the peaks of an evenly spaced trace, by continuous wavelet transform.

    Maxima over position and scale, strongest first, become peaks unless one accepted before lies within two sd; a
    Gaussian answers most strongly at a scale of sqrt(5) sd, and a parabola through its logarithm refines the sd. Peaks
    whose ranges of two sd overlap are fitted together, as many as they are: that subset of Gaussians is taken for which Akaike's
    criterion is least. What correlates with the trace by ``min_fit`` or less is no peak.
    """
    n = len(y)
    if n < 3 or not np.any(y > 0):
        return []
    rows = []
    for s in scales:
        reach = int(np.ceil(5 * s))
        rows.append(np.convolve(np.pad(y, reach, mode="reflect" if reach < n else "edge"), ricker(s, reach), mode="valid"))
    c = np.array(rows)
    wide = np.pad(c, 1, constant_values=-np.inf)
    top = (c > 0) & (c > wide[1:-1, :-2]) & (c >= wide[1:-1, 2:]) & (c >= wide[:-2, 1:-1]) & (c >= wide[2:, 1:-1])
    taken: list[tuple[int, float]] = []
    for k, i in sorted(zip(*np.nonzero(top), strict=True), key=lambda q: -c[q]):
        sd = scales[k] / np.sqrt(5)
        if all(abs(i - j) > 2 * max(sd, s) for j, s in taken):
            taken.append((int(i), float(sd)))
    taken = sorted((i, refined_sd(y, i, sd)) for i, sd in taken)
    groups: list[list[tuple[int, float]]] = []
    for i, s in taken:
        if groups and i - 2 * s <= max(j + 2 * r for j, r in groups[-1]):
            groups[-1].append((i, s))
        else:
            groups.append([(i, s)])
    step, out = float(x[1] - x[0]), []
    for group in groups:
        a, z = max(0, int(min(i - 3 * s for i, s in group))), min(n, int(max(i + 3 * s for i, s in group)) + 1)
        t, part = np.arange(a, z), np.asarray(y[a:z], float)
        shapes = [np.exp(-((t - i) ** 2) / (2 * s * s)) for i, s in group]
        used, heights = best_subset(np.array(shapes).T, part)
        for j, h in sorted(zip(used, heights, strict=True)):
            i, s = group[j]
            near = slice(max(0, i - int(np.ceil(2 * s))), i + int(np.ceil(2 * s)) + 1)
            own = np.exp(-((np.arange(n)[near] - i) ** 2) / (2 * s * s))
            if h > 0 and np.ptp(y[near]) > 0 and np.corrcoef(own, y[near])[0, 1] > min_fit:
                out.append((float(x[i]), float(h), s * step))
    return out


def logistic_fit(x: np.ndarray, y: np.ndarray, slopes=range(1, 31), slack: float = 0.1, rounds: int = 60) -> tuple[float, float, float]:
    """(top, slope, middle) of top / (1 + exp(slope * (x - middle))) with the least squared error, over several first slopes.

    Damped Gauss-Newton steps; each parameter stays within ``slack`` of its start, which is the greatest y, the slope
    and the x where y is nearest to the middle of its range.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    middle = float(x[np.abs(y - (y.max() - np.ptp(y) / 2)).argmin()])
    best, found = np.inf, (float("nan"),) * 3
    for k in slopes:
        start = np.array([y.max(), float(k), middle])
        room = slack * np.maximum(np.abs(start), 1e-9)
        p, damp, cost = start.copy(), 1e-2, np.inf
        for _ in range(rounds):
            e = np.exp(np.clip(p[1] * (x - p[2]), -60, 60))
            f = 1 / (1 + e)
            r = y - p[0] * f
            cost = float(r @ r)
            j = np.array([f, -p[0] * f * (1 - f) * (x - p[2]), p[0] * f * (1 - f) * p[1]]).T
            h = j.T @ j
            new = np.clip(p + np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ r), start - room, start + room)
            after = float(((y - new[0] / (1 + np.exp(np.clip(new[1] * (x - new[2]), -60, 60)))) ** 2).sum())
            if after < cost:
                done = cost - after < 1e-12 * max(cost, 1e-12)
                p, damp, cost = new, damp / 3, after
                if done:
                    break
            else:
                damp *= 4
                if damp > 1e9:
                    break
        if cost < best:
            best, found = cost, tuple(map(float, p))
    return found


def align_runs(df: DataFrame, keys: str, schema: str, lams=tuple(range(1, 201))) -> DataFrame:
    """Per group of (x, y): the best spline's lambda and R squared on every fifth point. Groups are single runs."""

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.groupby("x", as_index=False)["y"].mean().sort_values("x")
        x, y = part["x"].to_numpy(float), part["y"].to_numpy(float)
        test = np.arange(len(x)) % 5 == 2
        lam, r2 = best_spline(x[~test], y[~test], x[test], y[test], lams) if test.sum() > 1 and (~test).sum() > 3 else (float("nan"),) * 2
        return pd.DataFrame([(*key, lam, r2, len(x))], columns=[c.split()[0] for c in schema.split(", ")])

    return df.groupBy(keys).applyInPandas(fit, schema)
