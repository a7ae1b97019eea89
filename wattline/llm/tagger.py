"""A character-level bidirectional LSTM with a CRF on top, in numpy."""

from __future__ import annotations

import unicodedata

import numpy as np

#: ASCII as it is, other characters by class: letter, digit, space, other.
ALPHABET = 128 + 4


def codes(text: str) -> list[int]:
    out = []
    for c in text:
        n = ord(c)
        if n >= 128:
            kind = unicodedata.category(c)[0]
            n = 128 + {"L": 0, "N": 1, "Z": 2}.get(kind, 3)
        out.append(n)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """``fit`` on texts and their label sequences, then ``tag`` texts."""

    def __init__(self, n_tags: int, embed: int = 12, hidden: int = 16, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.n_tags, self.hidden, self.rng = n_tags, hidden, rng
        small = lambda *shape: (rng.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(np.float32)
        self.p = {"emb": small(ALPHABET, embed) * 3, "out": small(2 * hidden, n_tags), "out_b": np.zeros(n_tags, np.float32), "trans": np.zeros((n_tags, n_tags), np.float32), "start": np.zeros(n_tags, np.float32)}
        for d in "fb":
            self.p |= {f"{d}_x": small(embed, 4 * hidden), f"{d}_h": small(hidden, 4 * hidden), f"{d}_b": np.zeros(4 * hidden, np.float32)}
            self.p[f"{d}_b"][hidden : 2 * hidden] = 1

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        width = max(map(len, texts))
        x, mask = np.zeros((len(texts), width), np.int64), np.zeros((len(texts), width), bool)
        for i, t in enumerate(texts):
            x[i, : len(t)] = codes(t)
            mask[i, : len(t)] = True
        return x, mask

    def _run(self, d: str, e: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction, (batch, time, hidden); padding leaves the state as it was."""
        h_n, (batch, time, _) = self.hidden, e.shape
        pre = e @ self.p[f"{d}_x"] + self.p[f"{d}_b"]
        h = c = np.zeros((batch, h_n), np.float32)
        out = np.zeros((batch, time, h_n), np.float32)
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            z = pre[:, t] + h @ self.p[f"{d}_h"]
            s = _sigmoid(z[:, : 3 * h_n])
            i, f, o, g = s[:, :h_n], s[:, h_n : 2 * h_n], s[:, 2 * h_n :], np.tanh(z[:, 3 * h_n :])
            m = mask[:, t : t + 1]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep is not None:
                keep.append((t, h, c, i, f, o, g, tc, m))
            c, h = np.where(m, c_new, c), np.where(m, o * tc, h)
            out[:, t] = h
        return out

    def _back(self, d: str, e: np.ndarray, keep: list, d_out: np.ndarray, grads: dict, d_e: np.ndarray) -> None:
        h_n = self.hidden
        dh = dc = np.zeros(d_out[:, 0].shape, np.float32)
        dz_all = np.zeros((*e.shape[:2], 4 * h_n), np.float32)
        for t, h, c, i, f, o, g, tc, m in reversed(keep):
            dh = dh + d_out[:, t]
            here, past_h, past_c = np.where(m, dh, 0), np.where(m, 0, dh), np.where(m, 0, dc)
            dc_t = np.where(m, dc, 0) + here * o * (1 - tc * tc)
            dz = np.concatenate([dc_t * g * i * (1 - i), dc_t * c * f * (1 - f), here * tc * o * (1 - o), dc_t * i * (1 - g * g)], 1)
            grads[f"{d}_h"] += h.T @ dz
            dz_all[:, t] = dz
            dh, dc = past_h + dz @ self.p[f"{d}_h"].T, past_c + dc_t * f
        flat = dz_all.reshape(-1, 4 * h_n)
        grads[f"{d}_x"] += e.reshape(-1, e.shape[2]).T @ flat
        grads[f"{d}_b"] += flat.sum(0)
        d_e += dz_all @ self.p[f"{d}_x"].T

    def _loss(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood a character, and its gradients."""
        p, n = self.p, mask.sum()
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        e = p["emb"][x]
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate([self._run(d, e, mask, kept[d]) for d in "fb"], 2)
        u = states @ p["out"] + p["out_b"]
        batch, time, k = u.shape
        rows = np.arange(batch)
        alpha = np.zeros_like(u)
        alpha[:, 0] = p["start"] + u[:, 0]
        for t in range(1, time):
            new = _logsumexp(alpha[:, t - 1, :, None] + p["trans"], 1) + u[:, t]
            alpha[:, t] = np.where(mask[:, t : t + 1], new, alpha[:, t - 1])
        log_z = _logsumexp(alpha[:, -1], 1)
        beta = np.zeros_like(u)
        gold = p["start"][y[:, 0]] + u[rows, 0, y[:, 0]]
        d_u = np.zeros_like(u)
        for t in range(time - 1, -1, -1):
            if t + 1 < time:
                m = mask[:, t + 1]
                step = p["trans"] + (u[:, t + 1] + beta[:, t + 1])[:, None, :]
                beta[:, t] = np.where(m[:, None], _logsumexp(step, 2), beta[:, t + 1])
                both = np.exp(alpha[:, t, :, None] + step - log_z[:, None, None]) * m[:, None, None]
                grads["trans"] += both.sum(0)
                grads["trans"] -= np.bincount(y[m, t] * k + y[m, t + 1], minlength=k * k).reshape(k, k)
                gold = gold + m * (p["trans"][y[:, t], y[:, t + 1]] + u[rows, t + 1, y[:, t + 1]])
            d_u[:, t] = np.exp(alpha[:, t] + beta[:, t] - log_z[:, None]) * mask[:, t : t + 1]
            d_u[rows, t, y[:, t]] -= mask[:, t]
        grads["start"] += d_u[:, 0].sum(0)
        flat = d_u.reshape(-1, k)
        grads["out"] += states.reshape(-1, states.shape[2]).T @ flat
        grads["out_b"] += flat.sum(0)
        d_states, d_e = d_u @ p["out"].T, np.zeros_like(e)
        for i, d in enumerate("fb"):
            self._back(d, e, kept[d], d_states[:, :, i * self.hidden : (i + 1) * self.hidden], grads, d_e)
        flat_e = (d_e * mask[:, :, None]).reshape(-1, d_e.shape[2])
        for j in range(flat_e.shape[1]):
            grads["emb"][:, j] = np.bincount(x.ravel(), flat_e[:, j], ALPHABET)
        return float((log_z - gold).sum() / n), {g: v / n for g, v in grads.items()}

    def fit(self, texts: list[str], tags: list[np.ndarray], epochs: int = 6, batch: int = 32, rate: float = 0.02) -> Tagger:
        texts, tags = zip(*[(t, y) for t, y in zip(texts, tags, strict=True) if t], strict=True)
        m1, m2, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(epochs):
            order = self.rng.permutation(len(texts))
            for lo in range(0, len(order), batch):
                some = order[lo : lo + batch]
                x, mask = self._batch([texts[i] for i in some])
                y = np.zeros_like(x)
                for j, i in enumerate(some):
                    y[j, : len(tags[i])] = tags[i]
                _, grads = self._loss(x, mask, y)
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in grads.items():
                    g = np.clip(g, -1, 1)
                    m1[k] = 0.9 * m1[k] + 0.1 * g
                    m2[k] = 0.999 * m2[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - now * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def tag(self, texts: list[str], batch: int = 512) -> list[np.ndarray]:
        """Most likely labels (Viterbi); a span's inside may follow only its own start or inside."""
        allowed = np.zeros((self.n_tags, self.n_tags), np.float32)
        for j in range(2, self.n_tags, 2):
            allowed[:, j] = -1e4
            allowed[[j - 1, j], j] = 0
        trans = self.p["trans"] + allowed
        start = self.p["start"] + np.array([-1e4 if j and j % 2 == 0 else 0 for j in range(self.n_tags)], np.float32)
        out: list[np.ndarray] = []
        for lo in range(0, len(texts), batch):
            some = texts[lo : lo + batch]
            x, mask = self._batch(some)
            e = self.p["emb"][x]
            u = np.concatenate([self._run(d, e, mask, None) for d in "fb"], 2) @ self.p["out"] + self.p["out_b"]
            score, back = start + u[:, 0], np.zeros(u.shape, np.int64)
            ends = mask.sum(1)
            for t in range(1, u.shape[1]):
                step = score[:, :, None] + trans
                back[:, t] = step.argmax(1)
                score = np.where(mask[:, t : t + 1], step.max(1) + u[:, t], score)
            at = score.argmax(1)
            tags = np.zeros(x.shape, np.int64)
            rows = np.arange(len(some))
            for t in range(u.shape[1] - 1, -1, -1):
                live = t < ends
                tags[live, t] = at[live]
                at = np.where(live, back[rows, t, at], at)
            out += [tags[i, :n].astype(np.int8) for i, n in enumerate(ends)]
        return out
