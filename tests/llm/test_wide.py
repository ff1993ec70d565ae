"""The language model's gates with rows as columns, and its output layer in one array."""

import math

import numpy as np
import pytest

from voxelark.llm import language_model as lm
from voxelark.llm import rnn


def test_rows_as_columns_give_the_same_gates():
    rng = np.random.default_rng(4)
    w = rnn.gru_init(rng, 3, 4)
    x, h, d = (rng.normal(size=s).astype(np.float32) for s in ((6, 5, 12), (5, 4), (6, 5, 4)))
    x[0, 0, 0], x[1, 2, 5], x[2, 3, 9] = 300, -300, -300  # beyond a float's range as powers of e
    fresh = rng.random((6, 5)) < 0.3
    wide = lambda a: np.ascontiguousarray(np.swapaxes(a, -1, -2))
    H, held = rnn.gru_run(x, h, w["U"], fresh=fresh)
    dx, dU = rnn.gru_back(d, held, w["U"])
    got, kept = rnn.wide_run(wide(x), h.T, w["U"], fresh)
    back, back_U = rnn.wide_back(wide(d), kept, w["U"])
    assert np.allclose(wide(H), got, atol=1e-5) and np.allclose(wide(dx), back, atol=1e-5) and np.allclose(dU, back_U, atol=1e-4)
    assert np.allclose(rnn.gru_step(x[0], h, w["U"]), rnn.wide_step(wide(x[0]), h.T, w["U"]).T, atol=1e-5)


@pytest.mark.parametrize("far", [1, 100])
def test_gradients_of_the_outputs(far):
    """As differences of log_probs; with ``far``, rows whose logits are beyond a float's range as powers of e."""
    rng = np.random.default_rng(6)
    m = lm.Model(np.array([50] + [10] * 99), 30, n=8)
    H, ids = rng.normal(size=(40, 8)).astype(np.float32), rng.integers(0, 101, 40)
    m.w["o"][20:60:3] *= far
    dH, g = m._loss(H, ids)
    for a, gradient in ((H, dH), *((m.w[k], g[k]) for k in "CcOo")):
        for at in [tuple(rng.integers(0, s) for s in a.shape) for _ in range(8)]:
            old, loss = a[at], []
            for step in (1e-2, -1e-2):
                a[at] = old + step
                loss.append(-m.log_probs(H, ids).astype(np.float64).mean())
            a[at] = old
            assert math.isclose((loss[0] - loss[1]) / 2e-2, gradient[at], rel_tol=5e-2, abs_tol=2e-3)
