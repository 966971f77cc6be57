"""Gradients of a row's computation: a short tape of NumPy operations, used inside tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Var:
    """An array and how its gradient goes back to what it was made of."""

    __array_ufunc__ = None  # so that an array on the left leaves the operation to this class

    def __init__(self, value, back: tuple[tuple[Var, Callable], ...] = ()):
        self.value, self.back, self.grad = np.asarray(value, float), back, None

    def __add__(self, other):
        other = var(other)
        return Var(self.value + other.value, ((self, lambda g: g), (other, lambda g: g)))

    def __mul__(self, other):
        other = var(other)
        return Var(self.value * other.value, ((self, lambda g: g * other.value), (other, lambda g: g * self.value)))

    def __matmul__(self, other):
        return Var(self.value @ other.value, ((self, lambda g: g @ other.value.T), (other, lambda g: self.value.T @ g)))

    def __getitem__(self, at):
        def back(g):
            out = np.zeros_like(self.value)
            out[at] = g
            return out

        return Var(self.value[at], ((self, back),))

    def __neg__(self):
        return self * -1.0

    def __sub__(self, other):
        return self + -var(other)

    def __rsub__(self, other):
        return var(other) - self

    __radd__, __rmul__ = __add__, __mul__

    def power(self, p: float):
        return Var(self.value**p, ((self, lambda g: g * p * self.value ** (p - 1)),))

    def __truediv__(self, other):
        return self * var(other).power(-1.0)


def var(x) -> Var:
    return x if isinstance(x, Var) else Var(x)


def _apply(x: Var, value: np.ndarray, slope: np.ndarray) -> Var:
    return Var(value, ((x, lambda g: g * slope),))


def exp(x: Var) -> Var:
    e = np.exp(x.value)
    return _apply(x, e, e)


def log(x: Var) -> Var:
    return _apply(x, np.log(x.value), 1 / x.value)


def tanh(x: Var) -> Var:
    t = np.tanh(x.value)
    return _apply(x, t, 1 - t * t)


def sigmoid(x: Var) -> Var:
    s = 1 / (1 + np.exp(-x.value))
    return _apply(x, s, s * (1 - s))


def elu(x: Var) -> Var:
    e = np.exp(np.minimum(x.value, 0))
    return _apply(x, np.where(x.value > 0, x.value, e - 1), np.where(x.value > 0, 1.0, e))


def relu(x: Var) -> Var:
    return _apply(x, np.maximum(x.value, 0), (x.value > 0).astype(float))


def clamp(x: Var, low: float, high: float) -> Var:
    return _apply(x, np.clip(x.value, low, high), ((x.value >= low) & (x.value <= high)).astype(float))


def softplus(x: Var) -> Var:
    """log(1 + exp(x)), without overflow."""
    return _apply(x, np.maximum(x.value, 0) + np.log1p(np.exp(-np.abs(x.value))), 1 / (1 + np.exp(-x.value)))


def total(x: Var, axis=None) -> Var:
    """The sum, with the axis kept."""
    return Var(x.value.sum(axis=axis, keepdims=axis is not None), ((x, lambda g: np.broadcast_to(g, x.value.shape)),))


def concat(parts: list[Var]) -> Var:
    ends = np.cumsum([0, *(p.value.shape[1] for p in parts)])
    return Var(np.concatenate([p.value for p in parts], axis=1), tuple((p, lambda g, a=a, b=b: g[:, a:b]) for p, a, b in zip(parts, ends[:-1], ends[1:], strict=True)))


def where(flag: np.ndarray, a: Var, b: Var) -> Var:
    """Rows of ``a`` where the flag holds, else of ``b``."""
    f = flag.reshape(-1, 1).astype(float)
    return a * f + b * (1 - f)


def softmax(x: Var) -> Var:
    e = exp(x - x.value.max(axis=1, keepdims=True))
    return e / total(e, 1)


def unit(x: Var) -> Var:
    """Rows of length 1."""
    return x / (total(x * x, 1) + 1e-24).power(0.5)


def layer_norm(x: Var, scale: Var, shift: Var) -> Var:
    n = x.value.shape[1]
    centred = x - total(x, 1) * (1 / n)
    return centred / (total(centred * centred, 1) * (1 / n) + 1e-5).power(0.5) * scale + shift


def backward(outputs: list[tuple[Var, np.ndarray]]) -> None:
    """Set ``grad`` of all that the outputs were made of, from the outputs' gradients."""
    order, seen = [], set()

    def visit(v: Var) -> None:
        todo = [(v, False)]
        while todo:
            x, done = todo.pop()
            if done:
                order.append(x)
            elif id(x) not in seen:
                seen.add(id(x))
                todo.append((x, True))
                todo.extend((p, False) for p, _ in x.back)

    for v, g in outputs:
        visit(v)
        v.grad = np.broadcast_to(g, v.value.shape) + (0 if v.grad is None else v.grad)
    for x in reversed(order):
        if x.grad is None:
            continue
        for parent, back in x.back:
            g = np.asarray(back(x.grad))
            while g.ndim > parent.value.ndim:
                g = g.sum(axis=0)
            for axis, (have, want) in enumerate(zip(g.shape, parent.value.shape, strict=True)):
                if want == 1 and have != 1:
                    g = g.sum(axis=axis, keepdims=True)
            parent.grad = g if parent.grad is None else parent.grad + g
