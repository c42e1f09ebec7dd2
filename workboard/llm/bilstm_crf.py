"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Training maximises the CRF likelihood of whole label sequences with hand-written
gradients; decoding is Viterbi over batches of equally long windows.
"""

from __future__ import annotations

import numpy as np

#: ASCII with digits taken as "0" and letters lower-cased; other letters; everything else; padding.
CHARS = 131
PAD = 130


def char_codes(text: str, width: int) -> np.ndarray:
    """Codes of a text, padded to ``width``."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    code = np.where(raw < 128, raw, 129)
    for i in np.flatnonzero(raw >= 128):
        code[i] = 128 if text[i].isalpha() else 129
    code[(code >= 65) & (code <= 90)] += 32
    code[(code >= 49) & (code <= 57)] = 48
    out = np.full(width, PAD, np.int64)
    out[: len(code)] = code[:width]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def start(tags: int, emb: int = 12, hid: int = 16, seed: int = 7) -> dict[str, np.ndarray]:
    g = np.random.default_rng(seed)
    p = {"emb": g.normal(0, 0.5, (CHARS, emb)), "wx": g.normal(0, emb ** -0.5, (2, emb, 4 * hid)),
         "wh": g.normal(0, hid ** -0.5, (2, hid, 4 * hid)), "b": np.zeros((2, 1, 4 * hid)),
         "wo": g.normal(0, (2 * hid) ** -0.5, (2 * hid, tags)), "bo": np.zeros(tags),
         "tr": np.zeros((tags, tags)), "first": np.zeros(tags)}
    p["b"][:, :, hid: 2 * hid] = 1.0  # remember at first
    return p


def _run(p, codes):
    """Hidden states of both directions (each in its own time order) and what backprop needs."""
    n, width = codes.shape
    hid = p["wh"].shape[1]
    x = p["emb"][np.stack([codes, codes[:, ::-1]])]  # direction, batch, time, emb
    z = np.matmul(x, p["wx"][:, None]) + p["b"][:, None]
    h, c = np.zeros((2, n, hid)), np.zeros((2, n, hid))
    hs, cs, gates = np.zeros((2, n, width + 1, hid)), np.zeros((2, n, width + 1, hid)), np.zeros((2, n, width, 4 * hid))
    for t in range(width):
        a = z[:, :, t] + np.matmul(h, p["wh"])
        g = _sigmoid(a)
        g[..., 3 * hid:] = np.tanh(a[..., 3 * hid:])
        c = g[..., hid: 2 * hid] * c + g[..., :hid] * g[..., 3 * hid:]
        h = g[..., 2 * hid: 3 * hid] * np.tanh(c)
        hs[:, :, t + 1], cs[:, :, t + 1], gates[:, :, t] = h, c, g
    return x, hs, cs, gates


def emissions(p, codes):
    _, hs, _, _ = _run(p, codes)
    both = np.concatenate([hs[0, :, 1:], hs[1, :, :0:-1]], axis=2)
    return both @ p["wo"] + p["bo"]


def _lse(x, axis):
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_grads(p, codes, tags):
    """Mean negative log-likelihood of the label sequences, and its gradients."""
    n, width = codes.shape
    hid = p["wh"].shape[1]
    x, hs, cs, gates = _run(p, codes)
    both = np.concatenate([hs[0, :, 1:], hs[1, :, :0:-1]], axis=2)
    e = both @ p["wo"] + p["bo"]
    k = e.shape[2]
    rows = np.arange(n)
    # CRF: forward and backward sums, marginals.
    al, be = np.zeros((n, width, k)), np.zeros((n, width, k))
    al[:, 0] = p["first"] + e[:, 0]
    for t in range(1, width):
        al[:, t] = e[:, t] + _lse(al[:, t - 1][:, :, None] + p["tr"], 1)
    for t in range(width - 2, -1, -1):
        be[:, t] = _lse(p["tr"] + (e[:, t + 1] + be[:, t + 1])[:, None, :], 2)
    log_z = _lse(al[:, -1], 1)
    gold = p["first"][tags[:, 0]] + e[rows[:, None], np.arange(width), tags].sum(axis=1)
    gold += p["tr"][tags[:, :-1], tags[:, 1:]].sum(axis=1)
    ge = np.exp(al + be - log_z[:, None, None])
    pair = np.exp(al[:, :-1, :, None] + p["tr"] + (e[:, 1:] + be[:, 1:])[:, :, None, :] - log_z[:, None, None, None])
    g = {"tr": pair.sum(axis=(0, 1)), "first": ge[:, 0].sum(axis=0)}
    np.subtract.at(g["tr"], (tags[:, :-1], tags[:, 1:]), 1.0)
    np.subtract.at(g["first"], tags[:, 0], 1.0)
    ge[rows[:, None], np.arange(width), tags] -= 1.0
    g["wo"], g["bo"] = np.einsum("nth,ntk->hk", both, ge), ge.sum(axis=(0, 1))
    gb = ge @ p["wo"].T
    gh = np.stack([gb[:, :, :hid], gb[:, ::-1, hid:]])
    # LSTM, backwards in each direction's own time.
    dh, dc, dz = np.zeros((2, n, hid)), np.zeros((2, n, hid)), np.zeros((2, n, width, 4 * hid))
    wh_t = p["wh"].transpose(0, 2, 1)
    for t in range(width - 1, -1, -1):
        i, f, o, u = np.split(gates[:, :, t], 4, axis=-1)
        tc = np.tanh(cs[:, :, t + 1])
        dh = dh + gh[:, :, t]
        dc = dc + dh * o * (1 - tc * tc)
        da = np.concatenate([dc * u * i * (1 - i), dc * cs[:, :, t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - u * u)], axis=-1)
        dz[:, :, t], dh, dc = da, np.matmul(da, wh_t), dc * f
    g["wh"] = np.einsum("dnth,dntk->dhk", hs[:, :, :-1], dz)
    g["wx"] = np.einsum("dnte,dntk->dek", x, dz)
    g["b"] = dz.sum(axis=(1, 2))[:, None, :]
    dx = np.matmul(dz, p["wx"].transpose(0, 2, 1)[:, None])
    g["emb"] = np.zeros_like(p["emb"])
    np.add.at(g["emb"], codes, dx[0] + dx[1, :, ::-1])
    return (log_z - gold).mean(), {name: v / n for name, v in g.items()}


def train(codes: np.ndarray, tags: np.ndarray, n_tags: int, steps: int = 320, batch: int = 64, rate: float = 0.025,
          seed: int = 7) -> dict[str, np.ndarray]:
    """Adam with gradient clipping over random batches (a fixed seed)."""
    g = np.random.default_rng(seed)
    p = start(n_tags, seed=seed)
    m, v = ({name: np.zeros_like(x) for name, x in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        some = g.integers(0, len(codes), batch)
        _, grads = loss_and_grads(p, codes[some], tags[some])
        size = np.sqrt(sum((x * x).sum() for x in grads.values()))
        now = rate * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for name, x in grads.items():
            x = x * min(1.0, 5.0 / (size + 1e-9))
            m[name] = 0.9 * m[name] + 0.1 * x
            v[name] = 0.99 * v[name] + 0.01 * x * x
            p[name] = p[name] - now * (m[name] / (1 - 0.9 ** step)) / (np.sqrt(v[name] / (1 - 0.99 ** step)) + 1e-8)
    return p


def decode(p, codes: np.ndarray) -> np.ndarray:
    """The best label sequence of each window (Viterbi)."""
    e = emissions(p, codes)
    n, width, k = e.shape
    score, back = p["first"] + e[:, 0], np.zeros((n, width, k), np.int8)
    for t in range(1, width):
        way = score[:, :, None] + p["tr"]
        back[:, t] = way.argmax(axis=1)
        score = way.max(axis=1) + e[:, t]
    out = np.zeros((n, width), np.int8)
    out[:, -1] = score.argmax(axis=1)
    for t in range(width - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out
