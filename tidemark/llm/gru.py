"""A gated recurrent layer in numpy, forward and by backpropagation through time. Arrays are (time, features, batch)."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def initial(rng: np.random.Generator, hidden: int) -> np.ndarray:
    """Recurrent weights, (3 hidden, hidden): of the update gate, the reset gate and the candidate."""
    return (rng.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32)


def forward(inputs: np.ndarray, u: np.ndarray, valid: np.ndarray | None = None, back: bool = False, keep: list | None = None) -> np.ndarray:
    """States (time, hidden, batch) from projected inputs (time, 3 hidden, batch). valid (time, batch): states are 0 where it is. keep: gets what backward needs."""
    steps, _, batch = inputs.shape
    hidden = u.shape[1]
    gates, cand = np.ascontiguousarray(u[: 2 * hidden]), np.ascontiguousarray(u[2 * hidden :])
    out = np.empty((steps, hidden, batch), np.float32)
    h = np.zeros((hidden, batch), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        zr = gates @ h
        zr += inputs[t, : 2 * hidden]
        sigmoid(zr)
        un = cand @ h
        n = zr[hidden:] * un
        n += inputs[t, 2 * hidden :]
        np.tanh(n, out=n)
        new = h - n
        new *= zr[:hidden]
        new += n
        if valid is not None:
            new *= valid[t]
        if keep is not None:
            keep.append((t, h, zr, un, n))
        h = out[t] = new
    return out


def backward(grad: np.ndarray, u: np.ndarray, kept: list, valid: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of u, from those of the states."""
    steps, hidden, batch = grad.shape
    gates, cand = u[: 2 * hidden], u[2 * hidden :]
    d_in, d_u = np.empty((steps, 3 * hidden, batch), np.float32), np.zeros_like(u)
    carry = np.zeros((hidden, batch), np.float32)
    for t, before, zr, un, n in reversed(kept):
        dh = grad[t] + carry
        if valid is not None:
            dh *= valid[t]
        z, r = zr[:hidden], zr[hidden:]
        d_n = dh * (1 - z) * (1 - n * n)
        d_in[t, :hidden] = dh * (before - n) * z * (1 - z)
        d_in[t, hidden : 2 * hidden] = d_n * un * r * (1 - r)
        d_in[t, 2 * hidden :] = d_n
        d_un = d_n * r
        both = d_in[t, : 2 * hidden]
        d_u[: 2 * hidden] += both @ before.T
        d_u[2 * hidden :] += d_un @ before.T
        carry = dh * z + gates.T @ both + cand.T @ d_un
    return d_in, d_u


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.params, self.rate, self.step = params, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in params.items()}
        self.square = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], most: float = 5.0) -> None:
        self.step += 1
        norm = float(np.sqrt(sum((g.astype(np.float64) ** 2).sum() for g in grads.values())))
        scale = min(1.0, most / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.01 * (g * g - self.square[k])
            a, b = 1 - 0.9**self.step, 1 - 0.99**self.step
            self.params[k] -= (self.rate * (self.mean[k] / a) / (np.sqrt(self.square[k] / b) + 1e-8)).astype(np.float32)
