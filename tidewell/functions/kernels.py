"""Numerical helpers that have no relational form, over sorted arrays of one series or one fit.

Each takes and gives plain arrays; operators.peaks, operators.local_fit and
operators.models run them in Spark groups.
"""

from __future__ import annotations

import numpy as np


def ricker(sigma: float, radius: int) -> np.ndarray:
    """Second-derivative Gaussian wavelet with zero mean."""
    t = np.arange(-radius, radius + 1) / sigma
    w = 2 / (np.sqrt(3 * sigma) * np.pi**0.25) * (1 - t * t) * np.exp(-t * t / 2)
    return w - w.mean()


def half_maximum_width(y: np.ndarray) -> float:
    """Width in points at half of the largest value, by linear interpolation; 0 without both crossings."""
    top = int(np.argmax(y))
    half = y[top] / 2
    if half <= 0:
        return 0.0
    left = np.flatnonzero(y[:top] < half)
    right = np.flatnonzero(y[top:] < half)
    if not len(left) or not len(right):
        return 0.0
    i, j = left[-1], top + right[0]
    return float((j - (half - y[j]) / (y[j - 1] - y[j])) - (i + (half - y[i]) / (y[i + 1] - y[i])))


def consensus_peaks(series: np.ndarray, least: float) -> list[tuple[int, int, int]]:
    """(apex, start, end) of peaks that most rows of ``series`` show, highest consensus first.

    Every row is filtered with a wavelet as wide as the median row's peak; the pointwise
    median of the filtered rows is the consensus. A peak is a strict maximum of it above
    ``least``. It reaches as far as the consensus is positive, and up to as far again on
    the summed signal while that falls; a rise of over 5 % of its apex ends it at the lowest
    point before. The apex is the largest summed value within; three points at least.
    """
    n = series.shape[1] if series.ndim == 2 else 0
    if len(series) < 2 or n < 5 or not series.any():
        return []
    widths = [w for w in map(half_maximum_width, series) if w > 1]
    sigma = float(np.clip(np.median(widths) / 2.355, 2, 20)) if widths else 4.0
    kernel = ricker(sigma, min(int(np.ceil(5 * sigma)), n // 2))
    pad = len(kernel) // 2
    consensus = np.median([np.convolve(row, kernel)[pad : pad + n] for row in series], axis=0)
    edge = np.concatenate(([-np.inf], consensus, [-np.inf]))
    tops = [i for i in range(n) if consensus[i] > least and edge[i] < consensus[i] and edge[i + 2] < consensus[i]]
    total, found = series.sum(axis=0), []
    for top in sorted(tops, key=lambda i: -consensus[i]):
        ends = []
        for step in (-1, 1):
            at = top
            while 0 <= at + step < n and consensus[at + step] > 0:
                at += step
            reach = max(2, abs(at - top))
            low = at
            for k in range(1, reach + 1):
                here = at + k * step
                if not 0 <= here < n:
                    break
                if total[here] > total[low] + 0.05 * total[top]:
                    break
                if total[here] < total[low]:
                    low = here
            ends.append(low)
        start, end = ends
        if end - start + 1 >= 3:
            found.append((start + int(np.argmax(total[start : end + 1])), start, end))
    return found


def local_lines(x: np.ndarray, y: np.ndarray, counts: np.ndarray, weights: np.ndarray, bandwidth: float) -> np.ndarray:
    """Locally weighted lines: fitted values at the sorted ``x``, where a value stands for ``counts`` points of ``weights`` in all.

    The nearest share ``bandwidth`` of the points (three at least, and three places) counts, with tricube weights.
    """
    n, fitted = len(x), np.zeros(len(x))
    need, upto = max(np.ceil(bandwidth * counts.sum()), 3), np.concatenate(([0], np.cumsum(counts)))
    low = high = 0
    for i in range(n):
        low, high = i, i + 1
        while (upto[high] - upto[low] < need or high - low < 3) and high - low < n:
            if high == n or (low > 0 and x[i] - x[low - 1] < x[high] - x[i]):
                low -= 1
            else:
                high += 1
        xs, ys = x[low:high], y[low:high]
        far = max(x[i] - xs[0], xs[-1] - x[i])
        w = weights[low:high] * ((1 - np.clip(np.abs(xs - x[i]) / far, 0, 1) ** 3) ** 3 if far > 0 else 1.0)
        total = w.sum()
        if total <= 0:
            fitted[i] = ys.mean()
            continue
        mx, my = (w @ xs) / total, (w @ ys) / total
        spread = w @ (xs - mx) ** 2
        slope = (w @ ((xs - mx) * (ys - my))) / spread if spread > 1e-12 else 0.0
        fitted[i] = my + slope * (x[i] - mx)
    return fitted


def median_polish(y: np.ndarray, rounds: int = 10, tolerance: float = 0.01) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(overall, row effects, column effects, residuals) of the logarithms of positive values; others are missing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(y > 0, np.log(y), np.nan)
    overall, rows, cols = 0.0, np.zeros(y.shape[0]), np.zeros(y.shape[1])

    def middle(a, axis):
        with np.testing.suppress_warnings() as quiet:
            quiet.filter(RuntimeWarning)
            return np.nan_to_num(np.nanmedian(a, axis=axis))

    for _ in range(rounds):
        before = r
        m = middle(r, 1)
        r, rows = r - m[:, None], rows + m
        shift = float(np.median(cols))
        cols, overall = cols - shift, overall + shift
        m = middle(r, 0)
        r, cols = r - m[None, :], cols + m
        shift = float(np.median(rows))
        rows, overall = rows - shift, overall + shift
        if not np.nanmax(np.abs(r - before), initial=0.0) > tolerance:
            break
    return overall, rows, cols, r


def polish_features(y: np.ndarray, fitted: tuple[float, np.ndarray, np.ndarray, np.ndarray], expected: np.ndarray) -> dict[str, float]:
    """How well a median polish describes a matrix of intensities (a row per fragment, a column per scan; 0: no signal).

    cosine: of the roots of the rows' levels and of ``expected``, 0 for rows without signal. r2 and least_r2: explained share
    of the roots' spread, over all cells and of the worst row, over its cells with signal. residual_ratio: absolute errors by
    intensities, a cell without signal counting as 0.0001. residual_correlation: mean over pairs of rows, where both have three
    common cells at least.
    """
    overall, rows, cols, rest = fitted
    shown = np.isfinite(rest)
    model = np.exp(overall + rows[:, None] + cols[None, :])
    level = np.sqrt(np.where(shown.any(axis=1), np.exp(overall + rows), 0.0))
    ideal = np.sqrt(np.maximum(expected, 0.0))
    size = np.linalg.norm(level) * np.linalg.norm(ideal)
    seen, said = np.sqrt(np.where(shown, y, 0.0)), np.sqrt(model)
    spread = ((seen - seen.mean()) ** 2).sum()
    filled = np.where(shown, y, 1e-4)

    def explained(i: int) -> float:
        on = shown[i]
        own = ((seen[i, on] - seen[i, on].mean()) ** 2).sum() if on.sum() >= 3 else 0.0
        return max(0.0, 1 - ((seen[i, on] - said[i, on]) ** 2).sum() / own) if own >= 1e-30 else 0.0

    together = []
    for i in range(len(rest)):
        for j in range(i + 1, len(rest)):
            on = shown[i] & shown[j]
            if on.sum() >= 3:
                a, b = rest[i, on] - rest[i, on].mean(), rest[j, on] - rest[j, on].mean()
                norm = np.sqrt((a @ a) * (b @ b))
                together.append(a @ b / norm if norm > 1e-30 else 0.0)
    return {
        "cosine": float(level @ ideal / size) if size > 0 else 0.0,
        "r2": float(np.clip(1 - ((seen - said) ** 2).sum() / spread, 0, 1)) if spread >= 1e-30 else 0.0,
        "residual_ratio": float(np.abs(filled - model).sum() / filled.sum()),
        "least_r2": min(explained(i) for i in range(len(rest))),
        "residual_correlation": float(np.mean(together)) if together else 0.0,
    }


def linear_machine(x: np.ndarray, sign: np.ndarray, cost: float, seed: int, epochs: int = 200, precision: float = 0.01) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by dual coordinate descent."""
    x = np.hstack([x, np.ones((len(x), 1))])
    size = (x * x).sum(axis=1) + 0.5 / cost
    alpha, w, order, first = np.zeros(len(x)), np.zeros(x.shape[1]), np.random.default_rng(seed), None
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(x)):
            slope = sign[i] * (x[i] @ w) - 1 + alpha[i] * 0.5 / cost
            worst = max(worst, abs(slope) if alpha[i] > 0 else max(-slope, 0.0))
            now = max(alpha[i] - slope / size[i], 0.0)
            w += (now - alpha[i]) * sign[i] * x[i]
            alpha[i] = now
        first = worst if first is None else first
        if worst < precision * first:
            break
    return w


def discriminant(x: np.ndarray, positive: np.ndarray) -> np.ndarray | None:
    """Fisher's direction, of length one, towards the positive class; None without both classes."""
    if positive.all() or not positive.any():
        return None
    a, b = x[positive], x[~positive]
    within = (a - a.mean(0)).T @ (a - a.mean(0)) + (b - b.mean(0)).T @ (b - b.mean(0))
    w = np.linalg.solve(within + 1e-6 * np.trace(within) / len(within) * np.eye(len(within)) + 1e-12 * np.eye(len(within)), a.mean(0) - b.mean(0))
    norm = np.linalg.norm(w)
    return w / norm if norm > 0 else w


def density(grid: np.ndarray, values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Gaussian density of weighted values at the places of ``grid``, as wide as their spread and number ask (Silverman)."""
    n = weights.sum()
    spread = np.sqrt(weights @ (values - (weights @ values) / n) ** 2 / (n - 1)) if n > 1 else 0.0
    width = max(spread * (4 / (3 * n)) ** 0.2, 1e-6)
    held_rows, edges = np.histogram(values, bins=int(min(4096, max(64, n))), weights=weights)
    centers = (edges[1:] + edges[:-1]) / 2
    held = held_rows > 0
    z = (grid[:, None] - centers[held][None, :]) / width
    return (np.exp(-z * z / 2) @ held_rows[held]) / (n * width * np.sqrt(2 * np.pi))


def calibration_chances(grid: np.ndarray, scores: np.ndarray, decoy: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """As ``error_chances``, with the decoys' share of all rows as the prior and the largest chance of any higher score; 1 if a class is missing."""
    rows = np.ones(len(scores)) if counts is None else counts.astype(float)
    if decoy.all() or not decoy.any():
        return np.ones(len(grid))
    wrong = rows[decoy].sum() / rows.sum()
    bad, good = density(grid, scores[decoy], rows[decoy]) * wrong, density(grid, scores[~decoy], rows[~decoy]) * (1 - wrong)
    raw = np.divide(bad, bad + good, out=np.ones(len(grid)), where=bad + good > 0)
    return np.maximum.accumulate(raw[::-1])[::-1]


def error_chances(grid: np.ndarray, scores: np.ndarray, decoy: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Chance of an error at each score of ``grid``: from Gaussian densities of both classes, never rising with the score.

    ``counts`` says how many rows each score stands for; one each by default. 1 everywhere
    if a class is missing.
    """
    rows = np.ones(len(scores)) if counts is None else counts.astype(float)

    if decoy.all() or not decoy.any():  # nothing to compare with: no row can be called right
        return np.ones(len(grid))
    wrong = float(np.clip(rows[decoy].sum() / max(rows[~decoy].sum(), 1), 0.01, 0.99))
    bad, good = density(grid, scores[decoy], rows[decoy]) * wrong, density(grid, scores[~decoy], rows[~decoy]) * (1 - wrong)
    return falling(np.divide(bad, bad + good, out=np.ones(len(grid)), where=bad + good > 0))


def falling(y: np.ndarray) -> np.ndarray:
    """The closest sequence that never rises, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for v in y:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
            (a, m), (b, n) = blocks[-2], blocks.pop()
            blocks[-1] = [(a * m + b * n) / (m + n), m + n]
    return np.concatenate([np.full(int(n), v) for v, n in blocks]) if blocks else y


def binned_correlation_spectrum(mz: np.ndarray, intensity: np.ndarray, width: float = 1.0005079, offset: float = 0.4, top: float = 2000.0) -> np.ndarray:
    """Single-precision spectrum for fast cross-correlation: roots in bins, ten windows scaled to 50, local mean of 75 bins each side taken off."""
    n = int(top / width + 1 - offset) + 1
    inside = (mz >= 0) & (mz < top)
    bins = (mz[inside] / width + 1 - offset).astype(int)
    y = np.bincount(bins, weights=np.sqrt(intensity[inside]), minlength=n)[:n].astype(np.float32)
    largest, span = float(y.max(initial=0)), n // 10 + 1
    for k in range(0, n, span):
        part = y[k : k + span]
        if part.max() > 0:
            y[k : k + span] = np.where(part > 0.05 * largest, part * np.float32(50 / part.max()), 0)
    run = np.concatenate(([0], np.cumsum(y, dtype=np.float32)))
    i = np.arange(n)
    around = run[np.minimum(i + 76, n)] - run[np.maximum(i - 75, 0)] - y
    return (y - around / np.float32(150)).astype(np.float32)


def cross_correlation(prepared: np.ndarray, places: np.ndarray, width: float = 1.0005079, offset: float = 0.4) -> float:
    """Sum of the prepared spectrum over the distinct bins of ``places``, by 200."""
    bins = np.unique((places / width + 1 - offset).astype(int))
    return float(prepared[bins[(bins >= 0) & (bins < len(prepared))]].sum() * 0.005)
