"""Tailing peaks (exponentially modified Gaussians) in NumPy: fits of many series at once, and limits of their shares.

Arrays have a row for each series; a mask says which points a series has.
"""

from __future__ import annotations

import numpy as np

#: Coefficients of a Chebyshev fit of exp(z * z) * erfc(z), z >= 0, to 1.2e-7 of the value.
SCALED = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Rounds of a fit; the least gain of a round and the largest damping that go on.
ROUNDS, LEAST_GAIN, MOST_DAMPING = 200, 1e-12, 1e10
#: Logarithms of widths, in standard deviations of the series, stay between these.
LEAST_LOG, MOST_LOG = -9.0, 4.0


def scaled_erfc(z: np.ndarray) -> np.ndarray:
    """exp(z * z) * erfc(z) for z >= 0."""
    t = 1 / (1 + z / 2)
    return t * np.exp(np.polynomial.polynomial.polyval(t, SCALED))


def density(x: np.ndarray, mu, sigma, tau) -> np.ndarray:
    """Density of the sum of a Gaussian (mu, sigma) and an exponential variable of mean tau; of area one."""
    u = (x - mu) / sigma
    z = (sigma / tau - u) / np.sqrt(2)
    early = np.exp(-u * u / 2) * scaled_erfc(np.maximum(z, 0))
    down = np.minimum(z, 0)
    late = np.exp(np.minimum((sigma / tau) ** 2 / 2 - u * sigma / tau, 0)) * (2 - scaled_erfc(-down) * np.exp(-down * down))
    return np.where(z >= 0, early, late) / (2 * tau)


def share_before(x: np.ndarray, mu, sigma, tau) -> np.ndarray:
    """Share of the area up to x."""
    u = (x - mu) / sigma / np.sqrt(2)
    tail = scaled_erfc(np.abs(u)) * np.exp(-u * u) / 2
    return np.where(u >= 0, 1 - tail, tail) - tau * density(x, mu, sigma, tau)


def moments(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, standard deviation and third central moment of the places, weighed by positive heights."""
    w = np.where(mask, np.maximum(y, 0), 0)
    total = np.maximum(w.sum(axis=1), 1e-300)
    mean = (w * x).sum(axis=1) / total
    off = x - mean[:, None]
    return mean, np.sqrt((w * off**2).sum(axis=1) / total), (w * off**3).sum(axis=1) / total


def fit(x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(mu, sigma, tau, area, r_squared) of each series, by damped least squares from the moments; all series advance together.

    Places are taken in standard deviations of the series and heights in its largest one, widths by their logarithms, so
    one damping serves all four. A series without spread or positive heights has no fit (NaN).
    """
    mean, sd, third = moments(x, y, mask)
    top = np.where(mask, y, 0).max(axis=1, initial=0)
    good = (sd > 0) & (top > 0)
    mean, sd, top = np.where(good, mean, 0), np.where(good, sd, 1), np.where(good, top, 1)
    at, height = (x - mean[:, None]) / sd[:, None], np.where(mask, y / top[:, None], 0)
    tau = np.clip(np.cbrt(np.maximum(third / sd**3, 0) / 2), 0.1, 0.95)
    spacing = np.abs(np.diff(np.where(mask, at, np.nan), axis=1))
    area = (height[:, 1:] + height[:, :-1]) / 2 * np.nan_to_num(spacing)
    theta = np.stack([-tau, np.log(np.sqrt(1 - tau**2)), np.log(tau), np.maximum(area.sum(axis=1), 1e-6)], axis=1)

    def off(theta: np.ndarray, rows: np.ndarray) -> np.ndarray:
        mu, log_sigma, log_tau, whole = (theta[:, i, None] for i in range(4))
        return np.where(mask[rows], whole * density(at[rows], mu, np.exp(log_sigma), np.exp(log_tau)) - height[rows], 0)

    on, damping, step = np.flatnonzero(good), np.full(len(x), 1e-3), 1e-6
    missed = np.full(len(x), np.inf)
    missed[on] = (off(theta[on], on) ** 2).sum(axis=1)
    for _ in range(ROUNDS):
        if not len(on):
            break
        here = off(theta[on], on)
        slopes = np.stack([(off(theta[on] + step * np.eye(4)[i], on) - off(theta[on] - step * np.eye(4)[i], on)) / (2 * step) for i in range(4)], axis=2)
        square, toward = np.einsum("bni,bnj->bij", slopes, slopes), np.einsum("bni,bn->bi", slopes, here)
        lifted = square + (damping[on, None] * np.einsum("bii->bi", square) + 1e-12)[:, :, None] * np.eye(4)
        trial = theta[on] - np.linalg.solve(lifted, toward[:, :, None])[:, :, 0]
        trial[:, 1:3] = np.clip(trial[:, 1:3], LEAST_LOG, MOST_LOG)
        trial[:, 3] = np.maximum(trial[:, 3], 0)
        now = (off(trial, on) ** 2).sum(axis=1)
        better = now < missed[on]
        gain = np.where(better, (missed[on] - now) / np.maximum(missed[on], 1e-300), 1.0)
        theta[on[better]], missed[on[better]] = trial[better], now[better]
        damping[on] = np.where(better, np.maximum(damping[on] / 10, 1e-10), damping[on] * 10)
        on = on[(gain > LEAST_GAIN) & (missed[on] > 1e-18) & (damping[on] < MOST_DAMPING)]
    n = np.maximum(mask.sum(axis=1), 1)
    spread = (np.where(mask, height - (height.sum(axis=1) / n)[:, None], 0) ** 2).sum(axis=1)
    r_squared = np.where(spread > 1e-30, 1 - missed / np.maximum(spread, 1e-30), 0.0)
    found = np.stack([theta[:, 0] * sd + mean, np.exp(theta[:, 1]) * sd, np.exp(theta[:, 2]) * sd, theta[:, 3] * top * sd, r_squared], axis=1)
    found[~good] = np.nan
    return found


def limits(mu: np.ndarray, sigma: np.ndarray, tau: np.ndarray, coverage: float) -> tuple[np.ndarray, np.ndarray]:
    """Places that leave half of the rest of ``coverage`` of the area on either side, by halving between ten standard deviations."""
    middle, reach, out = mu + tau, 10 * np.hypot(sigma, tau), []
    for share in ((1 - coverage) / 2, (1 + coverage) / 2):
        low, high = middle - reach, middle + reach
        for _ in range(80):
            half = (low + high) / 2
            below = share_before(half, mu, sigma, tau) < share
            low, high = np.where(below, half, low), np.where(below, high, half)
        out.append((low + high) / 2)
    return out[0], out[1]
