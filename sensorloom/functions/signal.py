"""Zero-phase Butterworth filters and peaks in NumPy, for grouped kernels.

A stable filter's response to an impulse dies away, so filtering is a convolution with as much of it as doubles can tell
from nothing.  For windows of one length the whole zero-phase filter is a matrix, made once.
"""

from __future__ import annotations

from functools import cache

import numpy as np


def butter(order: int, cutoff: float, rate: float, high: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of a Butterworth filter of order 1 or 2, by the bilinear transform."""
    k = np.tan(np.pi * cutoff / rate)
    if order == 1:
        b = np.array([1.0, -1.0]) if high else np.array([k, k])
        return b / (1 + k), np.array([1.0, (k - 1) / (1 + k)])
    q = np.sqrt(2.0) * k
    n = 1 + q + k * k
    b = np.array([1.0, -2.0, 1.0]) if high else k * k * np.array([1.0, 2.0, 1.0])
    return b / n, np.array([1.0, 2 * (k * k - 1) / n, (1 - q + k * k) / n])


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """State in which a constant input of 1 gives a constant output."""
    n = len(a) - 1
    m = np.eye(n) - np.vstack([-a[1:], np.eye(n - 1, n)]).T
    return np.linalg.solve(m, b[1:] - a[1:] * b[0])


def recursion(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Output for input ``x`` from ``state``, sample by sample."""
    z, y = list(state), np.empty(len(x))
    for i, v in enumerate(x):
        y[i] = o = b[0] * v + z[0]
        for k in range(len(z)):
            z[k] = b[k + 1] * v - a[k + 1] * o + (z[k + 1] if k + 1 < len(z) else 0.0)
    return y


@cache
def responses(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray]:
    """What an impulse leaves, and what the steady state of an input of 1 leaves, until both are below 1e-17."""
    b, a = np.array(b), np.array(a)
    n = int(np.ceil(np.log(1e-17) / np.log(np.abs(np.roots(a)).max()))) + 8
    return recursion(b, a, np.eye(1, n)[0], np.zeros(len(a) - 1)), recursion(b, a, np.zeros(n), _steady(b, a))


def run(b: np.ndarray, a: np.ndarray, x: np.ndarray, level: float) -> np.ndarray:
    """Output for input ``x`` behind a constant input of ``level``."""
    impulse, rest = responses(tuple(b), tuple(a))
    y = np.convolve(x, impulse[: len(x)])[: len(x)]
    n = min(len(x), len(rest))
    y[:n] += level * rest[:n]
    return y


def zero_phase(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with odd extension at the ends; too short signals come back as they are."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        return np.array(x, float)
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = run(b, a, e, e[0])[::-1]
    return run(b, a, y, y[0])[::-1][pad:-pad]


class Carried:
    """A zero-phase filter over a signal in consecutive parts of any lengths, each seen by itself.

    What a part does to the filter's state is an affine map, forwards and backwards; maps are summaries of a few numbers, so
    a scan over them gives the state at each part's two ends, and each part is then filtered from there.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray):
        self.impulse, _ = responses(tuple(b), tuple(a))
        self.steady, self.pad, k = _steady(b, a), 3 * max(len(a), len(b)), len(a) - 1
        self.step = np.eye(k, k, 1)
        self.step[:, 0] -= a[1:]
        enter, leave = [b[1:] - a[1:] * b[0]], [np.eye(k)[0]]
        for _ in range(len(self.impulse) - 1):
            enter.append(self.step @ enter[-1])
            leave.append(leave[-1] @ self.step)
        #: What a sample of 1 leaves in the state, and what the state leaves in the output, by the steps between them.
        self.enter, self.leave = np.array(enter), np.array(leave)

    def _after(self, n: int, state: np.ndarray, own: np.ndarray) -> np.ndarray:
        return own if n >= len(self.impulse) else np.linalg.matrix_power(self.step, n) @ state + own

    def _left(self, x: np.ndarray) -> np.ndarray:
        """The state that ``x`` leaves behind one of zeros."""
        m = min(len(x), len(self.impulse))
        return x[len(x) - m :][::-1] @ self.enter[:m]

    def _out(self, x: np.ndarray, state: np.ndarray) -> np.ndarray:
        y, m = np.convolve(x, self.impulse[: len(x)])[: len(x)], min(len(x), len(self.impulse))
        y[:m] += self.leave[:m] @ state
        return y

    def summary(self, x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A part's length, the states that it leaves forwards and backwards, and its first and last samples."""
        near = x[: len(self.impulse)]
        back = np.convolve(near, self.impulse[: len(near)])[: len(near)] @ self.enter[: len(near)]
        return len(x), self._left(x), back, x[: self.pad + 1], x[-self.pad - 1 :]

    def scan(self, parts: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """For each part, by summaries in order, the state before its first and behind its last sample; None where the signal is too short to filter."""
        if sum(p[0] for p in parts) <= self.pad:
            return None
        first, last, k = np.zeros(0), np.zeros(0), self.pad + 1
        for p in parts:
            first = np.concatenate([first, p[3]])[:k]
            if len(first) == k:
                break
        for p in reversed(parts):
            last = np.concatenate([p[4], last])[-k:]
            if len(last) == k:
                break
        start, end = 2 * first[0] - first[:0:-1], 2 * last[-1] - last[-2::-1]
        state, before = self._after(self.pad, self.steady * start[0], self._left(start)), []
        for n, own, *_ in parts:
            before.append(state)
            state = self._after(n, state, own)
        y = self._out(end, state)[::-1]
        state, behind = self._after(self.pad, self.steady * y[0], self._left(y)), []
        for (n, _, own, *_), z in zip(reversed(parts), reversed(before), strict=True):
            behind.append(state)
            m = min(n, len(self.impulse))
            state = self._after(n, state, own + self.enter[:m].T @ (self.leave[:m] @ z))
        return list(zip(before, reversed(behind), strict=True))

    def part(self, x: np.ndarray, before: np.ndarray, behind: np.ndarray) -> np.ndarray:
        """The filtered part, from the states at its ends."""
        return self._out(self._out(x, before)[::-1], behind)[::-1]


@cache
def phasic_matrix(n: int, rate: float) -> np.ndarray:
    """The matrix that takes a window of ``n`` samples to its phasic part."""
    b, a = butter(1, 0.05, rate, high=True)
    return np.array([zero_phase(b, a, e) for e in np.eye(n)]).T


def peaks(x: np.ndarray, height: float, distance: int) -> np.ndarray:
    """Places of local maxima (the middle of a plateau) of ``height`` or more; of those nearer than ``distance`` the higher stays."""
    first = np.flatnonzero(np.diff(x, prepend=np.nan) != 0)  # of each run of equal values
    v, last = x[first], np.append(first[1:], len(x)) - 1
    top = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] > v[2:]) & (v[1:-1] >= height)) + 1
    at = (first[top] + last[top]) // 2
    keep = np.ones(len(at), bool)
    for k in np.argsort(x[at], kind="stable")[::-1]:
        if keep[k]:  # neighbours only, so a whole recording takes no longer by the peak than a window
            keep[np.searchsorted(at, at[k] - distance, "right") : k] = False
            keep[k + 1 : np.searchsorted(at, at[k] + distance)] = False
    return at[keep]


def phasic_features(windows: list[np.ndarray], rate: float = 4.0) -> np.ndarray:
    """A row for each window: mean, deviation and slope of the tonic part; mean, deviation, largest value and area above 0
    of the phasic part; number, mean and largest height of its peaks (0 without one)."""
    out = np.zeros((len(windows), 10))
    sizes = np.array([len(w) for w in windows])
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        x = np.stack([windows[i] for i in at]).astype(float)
        phasic = x @ phasic_matrix(int(n), rate).T if n <= 2_000 else np.array([zero_phase(*butter(1, 0.05, rate, high=True), w) for w in x])
        tonic, up, t = x - phasic, np.maximum(phasic, 0), (np.arange(n) - (n - 1) / 2) / rate
        rows = np.zeros((len(at), 10))
        rows[:, 0], rows[:, 1], rows[:, 2] = tonic.mean(axis=1), tonic.std(axis=1), tonic @ t / max((t * t).sum(), 1e-300)
        rows[:, 3], rows[:, 4], rows[:, 5] = phasic.mean(axis=1), phasic.std(axis=1), phasic.max(axis=1)
        rows[:, 6] = (up[:, 1:] + up[:, :-1]).sum(axis=1) / 2 / rate
        for row, p in zip(rows, phasic, strict=True):
            heights = p[peaks(p, 0.01, 4)]
            if len(heights):
                row[7:] = len(heights), heights.mean(), heights.max()
        out[at] = rows
    return out
