"""A character-level bidirectional LSTM with CRF transitions, in numpy: training, and Viterbi decoding in batches."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: 0 outside; 1 + 2k begins a span of kind k, 2 + 2k goes on in it.
TAGS = 1 + 2 * len(KINDS)
#: ASCII characters, then letters beyond ASCII, then everything else.
SYMBOLS = 130
HIDDEN = 12


def _allowed() -> np.ndarray:
    """0 where a tag may follow another, a large negative number where it may not."""
    ok = np.zeros((TAGS, TAGS), dtype=np.float32)
    for inside in range(2, TAGS, 2):
        ok[:, inside] = -1e4
        ok[inside - 1, inside] = ok[inside, inside] = 0
    return ok


ALLOWED = _allowed()


def symbols(text: str) -> np.ndarray:
    """A small number for each code point of ``text``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(codes < 128, codes, np.where((codes < 0x2000) | (codes > 0x2E7F), 128, 129)).astype(np.int16)


def fresh(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    p = {"out": rng.normal(0, 0.3, (2 * h, TAGS)), "bias": np.zeros(TAGS), "step": np.zeros((TAGS, TAGS))}
    for way in "fb":
        p["x" + way] = rng.normal(0, 0.3, (SYMBOLS, 4 * h))
        p["x" + way][:, h : 2 * h] += 1
        p["u" + way] = rng.normal(0, 0.3, (h, 4 * h))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lstm(x: np.ndarray, u: np.ndarray, keep: bool = False):
    """Hidden states (time, batch, HIDDEN) for inputs (time, batch, 4 HIDDEN); with ``keep`` also what training needs."""
    t, b, h = x.shape[0], x.shape[1], HIDDEN
    state, cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    out, kept = np.empty((t, b, h), np.float32), []
    for i in range(t):
        z = x[i] + state @ u
        gates = _sigmoid(z[:, : 3 * h])
        new = np.tanh(z[:, 3 * h :])
        before, cell_before = state, cell
        cell = gates[:, h : 2 * h] * cell + gates[:, :h] * new
        squashed = np.tanh(cell)
        state = gates[:, 2 * h :] * squashed
        out[i] = state
        if keep:
            kept.append((gates, new, before, cell_before, squashed))
    return (out, kept) if keep else out


def _lstm_back(grad: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of the recurrent weights."""
    t, b, h = grad.shape
    to_x, to_u = np.empty((t, b, 4 * h), np.float32), np.zeros_like(u)
    d_state, d_cell = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    for i in range(t - 1, -1, -1):
        gates, new, before, cell_before, squashed = kept[i]
        d = grad[i] + d_state
        d_cell = d_cell + d * gates[:, 2 * h :] * (1 - squashed**2)
        raw = np.concatenate([d_cell * new, d_cell * cell_before, d * squashed], axis=1)
        dz = to_x[i]
        dz[:, : 3 * h] = raw * gates * (1 - gates)
        dz[:, 3 * h :] = d_cell * gates[:, :h] * (1 - new**2)
        to_u += before.T @ dz
        d_state = dz @ u.T
        d_cell = d_cell * gates[:, h : 2 * h]
    return to_x, to_u


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _crf(scores: np.ndarray, steps: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the negative log likelihood of ``tags`` (time, batch) for emissions and transitions."""
    t, b, k = scores.shape
    forward, backward = np.empty_like(scores), np.zeros_like(scores)
    forward[0] = scores[0] + ALLOWED[0]
    for i in range(1, t):
        forward[i] = scores[i] + _lse(forward[i - 1][:, :, None] + steps, 1)
    for i in range(t - 2, -1, -1):
        backward[i] = _lse(steps + (scores[i + 1] + backward[i + 1])[:, None, :], 2)
    total = _lse(forward[-1], 1)
    d_scores = np.exp(forward + backward - total[:, None])
    d_steps = np.zeros((k, k), np.float32)
    for i in range(1, t):
        pair = forward[i - 1][:, :, None] + steps + (scores[i] + backward[i])[:, None, :] - total[:, None, None]
        d_steps += np.exp(pair).sum(axis=0)
    rows = np.arange(b)
    for i in range(t):
        d_scores[i, rows, tags[i]] -= 1
        if i:
            np.add.at(d_steps, (tags[i - 1], tags[i]), -1)
    return d_scores / b, d_steps / b


def train(windows: np.ndarray, tags: np.ndarray, batch: int = 48, rounds: int = 400, seed: int = 7, rate: float = 0.02) -> dict[str, np.ndarray]:
    """Weights from symbol windows (n, time) and their tags (n, time), by Adam."""
    p, rng = fresh(seed), np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for i in range(1, rounds + 1):
        pick = rng.integers(0, len(windows), batch)
        x, y = windows[pick].T, tags[pick].T
        ahead, kept_f = _lstm(p["xf"][x], p["uf"], True)
        back, kept_b = _lstm(p["xb"][x[::-1]], p["ub"], True)
        both = np.concatenate([ahead, back[::-1]], axis=2)
        d_scores, d_steps = _crf(both @ p["out"] + p["bias"], p["step"] + ALLOWED, y)
        grads = {"out": np.einsum("tbh,tbk->hk", both, d_scores), "bias": d_scores.sum((0, 1)), "step": d_steps}
        d_both = d_scores @ p["out"].T
        for way, d, kept, seen in (("f", d_both[:, :, :HIDDEN], kept_f, x), ("b", d_both[::-1, :, HIDDEN:], kept_b, x[::-1])):
            to_x, grads["u" + way] = _lstm_back(d, kept, p["u" + way])
            grads["x" + way] = np.zeros_like(p["x" + way])
            np.add.at(grads["x" + way], seen.ravel(), to_x.reshape(-1, 4 * HIDDEN))
        slow = rate * min(1.0, 2 * (1 - i / (rounds + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            p[k] = (p[k] - slow * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return p


def decode(p: dict[str, np.ndarray], windows: np.ndarray) -> np.ndarray:
    """The best tags (n, time) of symbol windows (n, time)."""
    x = windows.T
    both = np.concatenate([_lstm(p["xf"][x], p["uf"]), _lstm(p["xb"][x[::-1]], p["ub"])[::-1]], axis=2)
    scores, steps = both @ p["out"] + p["bias"], p["step"] + ALLOWED
    t, b, k = scores.shape
    best, came = scores[0] + ALLOWED[0], np.zeros((t, b, k), np.int8)
    for i in range(1, t):
        through = best[:, :, None] + steps
        came[i] = through.argmax(axis=1)
        best = scores[i] + np.take_along_axis(through, came[i][:, None, :].astype(np.intp), 1)[:, 0, :]
    out, rows = np.empty((t, b), np.int8), np.arange(b)
    out[-1] = best.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        out[i - 1] = came[i, rows, out[i]]
    return out.T
