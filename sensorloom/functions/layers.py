"""Layers of small networks in NumPy: one-dimensional convolutions, pooling, dropout and dense layers, with their gradients.

Signals are (rows, time, channels).  A network has an encoder for each of its inputs; what they make is joined side by
side for one head.  Parameters are named arrays, ``<part>.<layer>.w`` and ``.b``, so parts can be kept, loaded and frozen.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np

Shape = tuple[int, ...]
Arrays = dict[str, np.ndarray]


@dataclass(frozen=True)
class Conv:
    """``filters`` filters over ``width`` steps; same keeps the length (the shorter padding in front), valid takes whole places only."""

    filters: int
    width: int
    same: bool = True

    def shapes(self, s: Shape) -> tuple[dict[str, Shape], Shape]:
        return {"w": (self.width, s[1], self.filters), "b": (self.filters,)}, (s[0] if self.same else s[0] - self.width + 1, self.filters)

    def forward(self, p: Arrays, x: np.ndarray, _: Uniform | None):
        before = (self.width - 1) // 2 if self.same else 0
        padded = np.pad(x, ((0, 0), (before, self.width - 1 - before), (0, 0))) if self.same else x
        seen = np.lib.stride_tricks.sliding_window_view(padded, self.width, axis=1).transpose(0, 1, 3, 2)
        flat = seen.reshape(-1, self.width * x.shape[2])
        y = flat @ p["w"].reshape(-1, self.filters) + p["b"]
        return y.reshape(len(x), -1, self.filters), (flat, padded.shape, before, x.shape[1])

    def backward(self, p: Arrays, dy: np.ndarray, kept):
        flat, shape, before, n = kept
        d = dy.reshape(-1, self.filters)
        grads = {"w": (flat.T @ d).reshape(p["w"].shape), "b": d.sum(axis=0)}
        each = (d @ p["w"].reshape(-1, self.filters).T).reshape(len(dy), dy.shape[1], self.width, shape[2])
        dx = np.zeros(shape)
        for k in range(self.width):
            dx[:, k : k + dy.shape[1]] += each[:, :, k]
        return dx[:, before : before + n], grads


@dataclass(frozen=True)
class Dense:
    units: int

    def shapes(self, s: Shape):
        return {"w": (s[0], self.units), "b": (self.units,)}, (self.units,)

    def forward(self, p, x, _):
        return x @ p["w"] + p["b"], x

    def backward(self, p, dy, x):
        return dy @ p["w"].T, {"w": x.T @ dy, "b": dy.sum(axis=0)}


@dataclass(frozen=True)
class Leaky:
    """The value where it is above 0, else ``slope`` times it; a slope of 0 cuts it off."""

    slope: float = 0.3

    def shapes(self, s: Shape):
        return {}, s

    def forward(self, p, x, _):
        gain = np.where(x > 0, 1.0, self.slope)
        return x * gain, gain

    def backward(self, p, dy, gain):
        return dy * gain, {}


class Flatten:
    def shapes(self, s: Shape):
        return {}, (int(np.prod(s)),)

    def forward(self, p, x, _):
        return x.reshape(len(x), -1), x.shape

    def backward(self, p, dy, shape):
        return dy.reshape(shape), {}


class GlobalMax:
    """The largest value of each channel over time; of equal ones the first."""

    def shapes(self, s: Shape):
        return {}, (s[1],)

    def forward(self, p, x, _):
        return x.max(axis=1), (x.argmax(axis=1), x.shape)

    def backward(self, p, dy, kept):
        at, shape = kept
        dx = np.zeros(shape)
        np.put_along_axis(dx, at[:, None, :], dy[:, None, :], axis=1)
        return dx, {}


@dataclass(frozen=True)
class Dropout:
    """In training a share of the values is 0, the others are that much larger; else nothing happens."""

    rate: float

    def shapes(self, s: Shape):
        return {}, s

    def forward(self, p, x, draw):
        if draw is None:
            return x, None
        keep = (draw(int(np.prod(x.shape[1:]))).reshape(x.shape) >= self.rate) / (1 - self.rate)
        return x * keep, keep

    def backward(self, p, dy, keep):
        return (dy if keep is None else dy * keep), {}


class Uniform:
    """Numbers in [0, 1) that depend on seed, row and place alone, so not on how rows are dealt out."""

    def __init__(self, seed: int, rows: np.ndarray):
        self.rows, self.seed = rows.astype(np.int64).view(np.uint64), seed

    def __call__(self, n: int) -> np.ndarray:
        self.seed += 1
        with np.errstate(over="ignore"):
            h = self.rows[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(n, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(self.seed % 2**63) * np.uint64(0x8CB92BA72F3D8DD7)
            for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ (h >> np.uint64(shift))) * np.uint64(odd)
        return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / 2.0**53


def losses(kind: str, out: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The loss of each row and its derivative by ``out``: mse (mean over outputs), bce (of a logit), softmax (y: the class)."""
    if kind == "mse":
        return ((out - y) ** 2).mean(axis=1), 2 * (out - y) / out.shape[1]
    if kind == "bce":
        z, t = out[:, 0], y[:, 0]
        return np.logaddexp(0, z) - t * z, (1 / (1 + np.exp(-np.clip(z, -500, 500))) - t)[:, None]
    p = np.exp(out - out.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    at = y[:, 0].astype(int)
    each = np.arange(len(out))
    d = p.copy()
    d[each, at] -= 1
    return -np.log(np.maximum(p[each, at], 1e-300)), d


@dataclass
class Network:
    """Encoders by name, each with the shape (time, channels) of its input, and a head over what they make."""

    encoders: dict[str, list]
    head: list
    inputs: dict[str, Shape]
    loss: str = "mse"
    shapes: dict[str, Shape] = field(init=False)

    def __post_init__(self):
        if self.loss not in ("mse", "bce", "softmax"):
            raise ValueError("loss must be mse, bce or softmax")
        self.shapes, wide = {}, 0
        for name, layers in self.encoders.items():
            wide += int(np.prod(self._sized(name, layers, self.inputs[name])))
        self.outputs = self._sized("head", self.head, (wide,))[0]
        self.size = sum(int(np.prod(s)) for s in self.shapes.values())

    def _sized(self, part: str, layers: list, s: Shape) -> Shape:
        for i, layer in enumerate(layers):
            own, s = layer.shapes(s)
            self.shapes |= {f"{part}.{i}.{n}": v for n, v in own.items()}
        return s

    def start(self, seed: int) -> Arrays:
        """Weights evenly spread by the number of their inputs and outputs, biases of 0; each array has a seed of its own."""
        out = {}
        for name, s in self.shapes.items():
            limit = np.sqrt(6 / (np.prod(s[:-1]) + s[-1] * (s[0] if len(s) == 3 else 1))) if len(s) > 1 else 0.0
            out[name] = np.random.default_rng([seed, crc32(name.encode())]).uniform(-limit, limit, s) if limit else np.zeros(s)
        return out

    def flat(self, p: Arrays) -> np.ndarray:
        return np.concatenate([np.asarray(p[n], float).ravel() for n in self.shapes]) if self.shapes else np.zeros(0)

    def named(self, v: np.ndarray) -> Arrays:
        out, at = {}, 0
        for name, s in self.shapes.items():
            n = int(np.prod(s))
            out[name], at = v[at : at + n].reshape(s), at + n
        return out

    def _through(self, part: str, layers: list, p: Arrays, x: np.ndarray, draw):
        kept = []
        for i, layer in enumerate(layers):
            own = {n: p[f"{part}.{i}.{n}"] for n in ("w", "b") if f"{part}.{i}.{n}" in p}
            x, k = layer.forward(own, x, draw)
            kept.append((layer, own, k, f"{part}.{i}."))
        return x, kept

    def forward(self, p: Arrays, xs: dict[str, np.ndarray], draw: Uniform | None = None):
        made = {name: self._through(name, layers, p, xs[name].reshape(-1, *self.inputs[name]), draw) for name, layers in self.encoders.items()}
        sides = {name: y.reshape(len(y), -1) for name, (y, _) in made.items()}
        out, kept = self._through("head", self.head, p, np.concatenate(list(sides.values()), axis=1), draw)
        return out, (made, sides, kept)

    def gradient(self, p: Arrays, xs: dict[str, np.ndarray], y: np.ndarray, weight: np.ndarray, draw: Uniform | None = None, frozen: Callable[[str], bool] = lambda _: False) -> tuple[float, Arrays]:
        """Sum over rows of weighted losses, and its derivative by every parameter; 0 for frozen ones, whose parts are not gone back through."""
        out, (made, sides, kept) = self.forward(p, xs, draw)
        loss, d = losses(self.loss, out, y)
        grads = {n: np.zeros(s) for n, s in self.shapes.items()}
        d = self._back(kept, d * weight[:, None], grads)
        at = 0
        for name, side in sides.items():
            own = d[:, at : at + side.shape[1]]
            at += side.shape[1]
            if not all(frozen(n) for n in self.shapes if n.startswith(f"{name}.")):
                self._back(made[name][1], own.reshape(made[name][0].shape), grads)
        return float((loss * weight).sum()), {n: np.zeros_like(g) if frozen(n) else g for n, g in grads.items()}

    @staticmethod
    def _back(kept: list, d: np.ndarray, grads: Arrays) -> np.ndarray:
        for layer, own, k, name in reversed(kept):
            d, g = layer.backward(own, d, k)
            for n, v in g.items():
                grads[name + n] += v
        return d


class Adam:
    """Adam with its usual constants; frozen places never move."""

    def __init__(self, size: int, rate: float, moves: np.ndarray):
        self.m, self.v, self.t, self.rate, self.moves = np.zeros(size), np.zeros(size), 0, rate, moves

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        way = self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-7)
        return np.where(self.moves, w - way, w)


def encoder(widths: tuple[int, ...], filters: tuple[int, ...] = (4, 2, 4, 2)) -> list:
    """Convolutions of the given widths, each with a leaky unit behind it."""
    return [layer for f, k in zip(filters, widths, strict=True) for layer in (Conv(f, k), Leaky())]


def dense_head(units: tuple[int, ...], outputs: int) -> list:
    return [layer for n in units for layer in (Dense(n), Leaky())] + [Dense(outputs)]


def pooled_network(length: int, filters: tuple[int, int] = (250, 100), units: tuple[int, ...] = (256, 128, 64), same: bool = False) -> Network:
    """Two convolutions of width 5, the largest value over time, dense layers with dropout between them, two classes."""
    body = [Conv(filters[0], 5, same), Leaky(0.0), Conv(filters[1], 5, same), Leaky(0.0), GlobalMax()]
    head = [layer for n in units[:-1] for layer in (Dense(n), Leaky(0.0), Dropout(0.1))] + [Dense(units[-1]), Leaky(0.0), Dense(2)]
    return Network({"x": body}, head, {"x": (length, 1)}, "softmax")
