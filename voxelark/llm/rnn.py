"""Gated recurrent units in numpy: forward over time, truncated backpropagation, Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def gru_init(rng: np.random.Generator, n_in: int, n: int) -> dict[str, np.ndarray]:
    """Weights of a unit: input to gates, state to gates (update, reset, new), bias."""
    f = np.float32
    return {"W": rng.normal(0, 1 / np.sqrt(n_in), (n_in, 3 * n)).astype(f), "U": rng.normal(0, 1 / np.sqrt(n), (n, 3 * n)).astype(f), "b": np.zeros(3 * n, dtype=f)}


def gru_step(x: np.ndarray, h: np.ndarray, U: np.ndarray) -> np.ndarray:
    """Next state from the projected input ``x`` (rows of 3n) and the state ``h`` (rows of n)."""
    n = h.shape[1]
    a = h @ U
    gates = sigmoid(x[:, : 2 * n] + a[:, : 2 * n])
    new = np.tanh(x[:, 2 * n :] + gates[:, n:] * a[:, 2 * n :])
    return new + gates[:, :n] * (h - new)


def gru_run(x: np.ndarray, h: np.ndarray, U: np.ndarray, mask: np.ndarray | None = None, fresh: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """States after each step of ``x`` (time, rows, 3n), and what backpropagation needs.

    ``mask`` (time, rows): 0 keeps the state. ``fresh`` (time, rows): the step starts from a state of zeros.
    """
    steps, rows, n = len(x), len(h), h.shape[1]
    H = np.empty((steps + 1, rows, n), dtype=np.float32)
    G = np.empty((steps, rows, 2 * n), dtype=np.float32)
    N, A = np.empty((steps, rows, n), dtype=np.float32), np.empty((steps, rows, n), dtype=np.float32)
    H[0] = h
    before = []  # the states that the steps start from
    for t in range(steps):
        h = H[t]
        if fresh is not None and fresh[t].any():
            h = h * ~fresh[t][:, None]
        before.append(h)
        a = h @ U
        G[t] = sigmoid(x[t, :, : 2 * n] + a[:, : 2 * n])
        A[t] = a[:, 2 * n :]
        N[t] = np.tanh(x[t, :, 2 * n :] + G[t, :, n:] * A[t])
        H[t + 1] = N[t] + G[t, :, :n] * (h - N[t])
        if mask is not None:
            m = mask[t][:, None]
            H[t + 1] = m * H[t + 1] + (1 - m) * h
    return H[1:], (before, G, N, A, mask, fresh)


def gru_back(dH: np.ndarray, held: tuple, U: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of U, given those of the states; none flows in from later windows."""
    H, G, N, A, mask, fresh = held
    steps, rows, n = dH.shape
    dx = np.empty((steps, rows, 3 * n), dtype=np.float32)
    dU = np.zeros_like(U)
    dh = np.zeros((rows, n), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        d = dh + dH[t]
        keep = 0.0
        if mask is not None:
            m = mask[t][:, None]
            keep, d = (1 - m) * d, m * d
        z, r = G[t, :, :n], G[t, :, n:]
        dn = d * (1 - z) * (1 - N[t] ** 2)
        dz = d * (H[t] - N[t]) * z * (1 - z)
        dr = dn * A[t] * r * (1 - r)
        dx[t, :, :n], dx[t, :, n : 2 * n], dx[t, :, 2 * n :] = dz, dr, dn
        da = np.concatenate([dz, dr, dn * r], axis=1)
        dU += H[t].T @ da
        dh = d * z + da @ U.T + keep
        if fresh is not None and fresh[t].any():
            dh *= ~fresh[t][:, None]
    return dx, dU


def wide_step(x: np.ndarray, h: np.ndarray, U: np.ndarray) -> np.ndarray:
    """``gru_step`` with rows as columns, ``x`` (3n, rows) and ``h`` (n, rows): gates lie in long runs, which numpy is fast at. ``x`` is overwritten."""
    n = len(h)
    a = U.T @ h
    _wide(x, a[: 2 * n], a[2 * n :])
    out = h - x[2 * n :]
    out *= x[:n]
    out += x[2 * n :]
    return out


def _wide(x: np.ndarray, a: np.ndarray, new: np.ndarray) -> None:
    """Turns ``x`` into the gates and new values; ``a`` and ``new`` are the projected states. By exp, which numpy does faster than tanh."""
    two = len(a)
    g, v = x[:two], x[two:]
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is the limit
        g += a
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += np.float32(1)
        np.reciprocal(g, out=g)
        v += g[two // 2 :] * new
        v *= np.float32(-2)
        np.exp(v, out=v)
        v += np.float32(1)
        np.divide(np.float32(2), v, out=v)
        v -= np.float32(1)


def wide_run(x: np.ndarray, h: np.ndarray, U: np.ndarray, fresh: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """``gru_run`` with rows as columns: ``x`` (time, 3n, rows), overwritten, ``h`` (n, rows), ``fresh`` (time, rows).

    The states are in ``room`` (3, time, n, rows), if given.
    """
    steps, n, rows = len(x), *h.shape
    H, B, A = np.empty((3, steps, n, rows), dtype=np.float32) if room is None else room[:, :steps]  # states after and before steps, projected states
    keep = [k.astype(np.float32) if not k.all() else None for k in ~fresh]
    V = np.ascontiguousarray(U.T)
    for t in range(steps):
        b = B[t]
        if keep[t] is None:
            b[...] = h
        else:
            np.multiply(h, keep[t], out=b)
        a = V @ b
        A[t] = a[2 * n :]
        _wide(x[t], a[: 2 * n], A[t])
        h = H[t]
        np.subtract(b, x[t, 2 * n :], out=h)
        h *= x[t, :n]
        h += x[t, 2 * n :]
    return H, (B, x, A, keep)


def wide_back(dH: np.ndarray, held: tuple, U: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``gru_back`` with rows as columns, ``dH`` (time, n, rows), overwritten; the inputs' gradients are in ``room``, if given."""
    B, G, A, keep = held
    steps, n, rows = dH.shape
    dx = np.empty((steps, 3 * n, rows), dtype=np.float32) if room is None else room[:steps]
    dU = np.zeros_like(U)
    dh = np.zeros((n, rows), dtype=np.float32)
    a, stay, v = np.empty((3 * n, rows), dtype=np.float32), np.empty_like(dh), np.empty_like(dh)
    for t in range(steps - 1, -1, -1):
        d, g, new = dH[t], G[t], G[t, 2 * n :]
        z, r = g[:n], g[n : 2 * n]
        dz, dr, dn = dx[t, :n], dx[t, n : 2 * n], dx[t, 2 * n :]
        d += dh
        np.subtract(1, z, out=stay)
        stay *= d
        np.multiply(new, new, out=v)
        np.subtract(1, v, out=v)
        np.multiply(v, stay, out=dn)
        np.subtract(B[t], new, out=dz)
        dz *= z
        dz *= stay
        np.subtract(1, r, out=dr)
        dr *= r
        dr *= A[t]
        dr *= dn
        a[: 2 * n] = dx[t, : 2 * n]
        np.multiply(dn, r, out=a[2 * n :])
        dU += B[t] @ a.T
        dh = U @ a
        d *= z
        dh += d
        if keep[t] is not None:
            dh *= keep[t]
    return dx, dU


class Adam:
    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.w, self.rate, self.t = weights, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in weights.items()}
        self.v = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray], most: float = 5.0) -> None:
        self.t += 1
        size = np.sqrt(sum(float((g.astype(np.float64) ** 2).sum()) for g in grads.values()))
        scale = min(1.0, most / (size + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * np.float32(scale)
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.001) * (g * g - self.v[k])
            self.w[k] -= np.float32(rate) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-8))
