"""A character-level bidirectional LSTM with CRF transitions in numpy: training by back-propagation, batched Viterbi decoding."""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def new_params(symbols: int, tags: int, embed: int, hidden: int, seed: int) -> Params:
    rng = np.random.default_rng(seed)
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    out = {"E": draw(symbols, embed), "O": draw(2 * hidden, tags), "o": np.zeros(tags, np.float32), "A": np.zeros((tags, tags), np.float32)}
    for d in "fb":
        out |= {f"W{d}": draw(embed, 4 * hidden), f"U{d}": draw(hidden, 4 * hidden), f"c{d}": np.zeros(4 * hidden, np.float32)}
        out[f"c{d}"][hidden : 2 * hidden] = 1  # forget gates begin open
    return out


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, list]:
    """x: time, batch, inputs -> hidden states, and what the way back needs."""
    steps, batch, h = len(x), x.shape[1], u.shape[0]
    pre, state, cell = x @ w + b, np.zeros((batch, h), np.float32), np.zeros((batch, h), np.float32)
    out, kept = np.empty((steps, batch, h), np.float32), []
    for t in range(steps):
        z = pre[t] + state @ u
        gates, g = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
        i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
        last_state, last_cell = state, cell
        cell = f * cell + i * g
        squashed = np.tanh(cell)
        state = o * squashed
        out[t] = state
        kept.append((i, f, o, g, squashed, last_state, last_cell))
    return out, kept


def lstm_back(x: np.ndarray, w: np.ndarray, u: np.ndarray, kept: list, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of inputs, w, u, b."""
    ds, dc, dz = np.zeros_like(up[0]), np.zeros_like(up[0]), np.empty((*x.shape[:2], w.shape[1]), np.float32)
    du = np.zeros_like(u)
    for t in range(len(x) - 1, -1, -1):
        i, f, o, g, squashed, last_state, last_cell = kept[t]
        ds = ds + up[t]
        dc = dc + ds * o * (1 - squashed**2)
        dz[t] = np.concatenate([dc * g * i * (1 - i), dc * last_cell * f * (1 - f), ds * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        du += last_state.T @ dz[t]
        ds, dc = dz[t] @ u.T, dc * f
    flat = dz.reshape(-1, dz.shape[2])
    return dz @ w.T, x.reshape(-1, x.shape[2]).T @ flat, du, flat.sum(0)


def emissions(p: Params, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
    """codes: batch, time -> scores: time, batch, tags."""
    x = p["E"][codes.T]
    forward, kept_f = lstm(x, p["Wf"], p["Uf"], p["cf"])
    backward, kept_b = lstm(x[::-1], p["Wb"], p["Ub"], p["cb"])
    both = np.concatenate([forward, backward[::-1]], axis=2)
    return both @ p["O"] + p["o"], (x, both, kept_f, kept_b)


def crf(scores: np.ndarray, links: np.ndarray, gold: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood of gold (batch, time), gradients of scores and links: forward and backward sums, scaled at each step."""
    steps, batch, tags = scores.shape
    top = scores.max(2, keepdims=True).astype(np.float64)
    weight, across = np.exp(scores - top), np.exp(links.astype(np.float64))
    alpha, beta, scale = np.empty_like(weight), np.ones_like(weight), np.empty((steps, batch, 1))
    for t in range(steps):
        alpha[t] = weight[t] if t == 0 else (alpha[t - 1] @ across) * weight[t]
        scale[t] = alpha[t].sum(1, keepdims=True)
        alpha[t] /= scale[t]
    pairs = np.zeros((tags, tags))
    for t in range(steps - 2, -1, -1):
        ahead = weight[t + 1] * beta[t + 1] / scale[t + 1]
        beta[t] = ahead @ across.T
        pairs += alpha[t].T @ ahead
    pairs, grad, norm = pairs * across, alpha * beta, (np.log(scale) + top).sum()
    at = (np.arange(steps)[:, None], np.arange(batch)[None, :], gold.T)
    path = scores[at].sum() + links[gold.T[:-1], gold.T[1:]].sum()
    grad[at] -= 1
    np.subtract.at(pairs, (gold.T[:-1].ravel(), gold.T[1:].ravel()), 1)
    return float(norm - path) / batch, (grad / batch).astype(np.float32), (pairs / batch).astype(np.float32)


def loss_and_gradients(p: Params, codes: np.ndarray, gold: np.ndarray) -> tuple[float, Params]:
    scores, (x, both, kept_f, kept_b) = emissions(p, codes)
    loss, ds, da = crf(scores, p["A"], gold)
    flat, h = ds.reshape(-1, ds.shape[2]), p["Uf"].shape[0]
    g = {"A": da, "O": both.reshape(-1, both.shape[2]).T @ flat, "o": flat.sum(0)}
    up = ds @ p["O"].T
    dx, g["Wf"], g["Uf"], g["cf"] = lstm_back(x, p["Wf"], p["Uf"], kept_f, up[:, :, :h])
    dx_b, g["Wb"], g["Ub"], g["cb"] = lstm_back(x[::-1], p["Wb"], p["Ub"], kept_b, up[::-1, :, h:])
    g["E"] = np.zeros_like(p["E"])
    np.add.at(g["E"], codes.T.ravel(), (dx + dx_b[::-1]).reshape(-1, dx.shape[2]))
    return loss, g


def fit(codes: np.ndarray, gold: np.ndarray, symbols: int, tags: int, embed: int = 8, hidden: int = 16, steps: int = 400, batch: int = 48, rate: float = 0.02, seed: int = 0) -> Params:
    """Adam over shuffled mini-batches, the rate falling to a tenth; gradients are clipped to norm 5."""
    p, rng = new_params(symbols, tags, embed, hidden, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in p.items()}
    second = {k: np.zeros_like(v) for k, v in p.items()}
    order = np.zeros(0, np.int64)
    for t in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(codes))])
        pick, order = order[:batch], order[batch:]
        _, g = loss_and_gradients(p, codes[pick], gold[pick])
        clip = min(1.0, 5.0 / (1e-9 + float(np.sqrt(sum((v.astype(np.float64) ** 2).sum() for v in g.values())))))
        speed = rate * (1 - 0.9 * t / steps)
        for k in p:
            v = g[k] * clip
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.999 * second[k] + 0.001 * v * v
            p[k] = p[k] - speed * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    return p


def viterbi(scores: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Best tag sequence of each row: batch, time."""
    steps, batch, tags = scores.shape
    best, back = scores[0].copy(), np.empty((steps, batch, tags), np.int8)
    for t in range(1, steps):
        total = best[:, :, None] + links
        back[t] = total.argmax(1)
        best = total.max(1) + scores[t]
    out = np.empty((batch, steps), np.int64)
    out[:, -1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(batch), out[:, t]]
    return out


def decode(p: Params, codes: np.ndarray, links: np.ndarray, batch: int = 64) -> np.ndarray:
    parts = [viterbi(emissions(p, codes[at : at + batch])[0], p["A"] + links) for at in range(0, len(codes), batch)]
    return np.concatenate(parts) if parts else np.zeros((0, codes.shape[1]), np.int64)
