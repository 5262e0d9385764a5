"""Reverse-mode gradients for the few array operations the model needs."""

from __future__ import annotations

import numpy as np


class Var:
    """An array with a gradient; ``back`` adds to the gradients of what it was made from."""

    def __init__(self, data, parents=(), back=None, name=None):
        self.data = np.asarray(data, dtype=np.float64)
        self.grad: np.ndarray | None = None
        self.parents, self.back, self.name = parents, back, name

    @property
    def shape(self):
        return self.data.shape

    def add_grad(self, g: np.ndarray) -> None:
        extra = g.ndim - self.data.ndim
        if extra > 0:
            g = g.sum(axis=tuple(range(extra)))
        axes = tuple(i for i, n in enumerate(self.data.shape) if n == 1 and g.shape[i] != 1)
        if axes:
            g = g.sum(axis=axes, keepdims=True)
        self.grad = g.copy() if self.grad is None else self.grad + g

    def backward(self) -> None:
        order, seen = [], set()
        stack = [(self, False)]
        while stack:
            v, done = stack.pop()
            if done:
                order.append(v)
            elif id(v) not in seen:
                seen.add(id(v))
                stack.append((v, True))
                stack += [(p, False) for p in v.parents]
        self.grad = np.ones_like(self.data)
        for v in reversed(order):
            if v.back is not None and v.grad is not None:
                v.back(v.grad)

    def __add__(self, o):
        o = o if isinstance(o, Var) else Var(o)
        return Var(self.data + o.data, (self, o), lambda g: (self.add_grad(g), o.add_grad(g)))

    def __mul__(self, o):
        o = o if isinstance(o, Var) else Var(o)
        return Var(self.data * o.data, (self, o), lambda g: (self.add_grad(g * o.data), o.add_grad(g * self.data)))

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + (-o if isinstance(o, Var) else -np.asarray(o))

    def __matmul__(self, o):
        def back(g):
            self.add_grad(g @ np.swapaxes(o.data, -1, -2))
            o.add_grad(np.swapaxes(self.data, -1, -2) @ g)

        return Var(self.data @ o.data, (self, o), back)

    def reshape(self, *shape):
        return Var(self.data.reshape(*shape), (self,), lambda g: self.add_grad(g.reshape(self.data.shape)))

    def swap(self, a, b):
        return Var(np.swapaxes(self.data, a, b), (self,), lambda g: self.add_grad(np.swapaxes(g, a, b)))

    def sum(self, axis=None, keepdims=False):
        def back(g):
            if axis is not None and not keepdims:
                g = np.expand_dims(g, axis)
            self.add_grad(np.broadcast_to(g, self.data.shape))

        return Var(self.data.sum(axis=axis, keepdims=keepdims), (self,), back)

    def take(self, index):
        def back(g):
            full = np.zeros_like(self.data)
            np.add.at(full, index, g)
            self.add_grad(full)

        return Var(self.data[index], (self,), back)


def softmax(x: Var) -> Var:
    e = np.exp(x.data - x.data.max(axis=-1, keepdims=True))
    y = e / e.sum(axis=-1, keepdims=True)
    return Var(y, (x,), lambda g: x.add_grad(y * (g - (g * y).sum(axis=-1, keepdims=True))))


def log_softmax(x: Var) -> Var:
    z = x.data - x.data.max(axis=-1, keepdims=True)
    y = z - np.log(np.exp(z).sum(axis=-1, keepdims=True))
    return Var(y, (x,), lambda g: x.add_grad(g - np.exp(y) * g.sum(axis=-1, keepdims=True)))


def log_sigmoid(x: Var) -> Var:
    y = -np.logaddexp(0.0, -x.data)
    return Var(y, (x,), lambda g: x.add_grad(g * (1 - np.exp(y))))


def gelu(x: Var) -> Var:
    c = np.sqrt(2 / np.pi)
    t = np.tanh(c * (x.data + 0.044715 * x.data**3))
    slope = 0.5 * (1 + t) + 0.5 * x.data * (1 - t**2) * c * (1 + 3 * 0.044715 * x.data**2)
    return Var(0.5 * x.data * (1 + t), (x,), lambda g: x.add_grad(g * slope))


def layer_norm(x: Var, scale: Var, shift: Var, eps: float = 1e-5) -> Var:
    mean = x.data.mean(axis=-1, keepdims=True)
    inv = 1 / np.sqrt(x.data.var(axis=-1, keepdims=True) + eps)
    h = (x.data - mean) * inv

    def back(g):
        scale.add_grad(g * h)
        shift.add_grad(g)
        d = g * scale.data
        x.add_grad(inv * (d - d.mean(axis=-1, keepdims=True) - h * (d * h).mean(axis=-1, keepdims=True)))

    return Var(h * scale.data + shift.data, (x, scale, shift), back)


def unit_rows(x: Var, floor: float = 1e-9) -> Var:
    n = np.maximum(np.linalg.norm(x.data, axis=-1, keepdims=True), floor)
    y = x.data / n
    return Var(y, (x,), lambda g: x.add_grad((g - y * (g * y).sum(axis=-1, keepdims=True)) / n))
