"""A linear-chain conditional random field whose scores are sums of table rows, trained and decoded in numpy batches.

A token has a few slots (the word, the chunk it stands in, the gap before it). A slot holds the id of a type; a type has
features; each slot is looked at from several offsets, and an offset has its own weights. As scores are summed over
slots and offsets, the score table of each (slot, offset) is made once per type, and a token costs a few row lookups.
"""

from __future__ import annotations

import numpy as np

Slots = dict[str, np.ndarray]


def emissions(tables: dict[str, dict[int, np.ndarray]], slots: Slots, bounds: np.ndarray) -> np.ndarray:
    """Label scores of all tokens; bounds: the sequence number of each token. Row 0 of a table stands for "outside"."""
    n = len(bounds)
    labels = next(iter(next(iter(tables.values())).values())).shape[1]
    out = np.zeros((n, labels), np.float32)
    for slot, by in tables.items():
        ids = slots[slot]
        for o, table in by.items():
            out += table[shifted(ids, bounds, o)]
    return out


def shifted(ids: np.ndarray, bounds: np.ndarray, o: int) -> np.ndarray:
    """The ids o places on, 0 beyond the sequence."""
    if o == 0:
        return ids
    out = np.zeros_like(ids)
    if len(ids) > abs(o):
        if o > 0:
            out[:-o] = np.where(bounds[:-o] == bounds[o:], ids[o:], 0)
        else:
            out[-o:] = np.where(bounds[-o:] == bounds[:o], ids[:o], 0)
    return out


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best labels of all tokens. Sequences go side by side, longest first, so each step works on all that still run."""
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    labels = trans.shape[0]
    best = np.zeros(len(scores), np.int8)
    back = np.zeros((len(scores), labels), np.int8)
    alive = len(lengths)
    v = scores[starts] + first
    score = v
    steps = int(lengths[0]) if alive else 0
    last = np.zeros(len(lengths), np.int64)
    ended = np.searchsorted(-lengths, -np.arange(steps + 1), side="left")  # sequences longer than t
    for t in range(1, steps + 1):
        now = int(ended[t])
        if now < alive:
            last[now:alive] = np.argmax(score[now:alive], axis=1)
            alive = now
        if not alive:
            break
        m = score[:alive, :, None] + trans
        b = np.argmax(m, axis=1)
        at = starts[:alive] + t
        back[at] = b
        score = np.take_along_axis(m, b[:, None, :], axis=1)[:, 0, :] + scores[at]
    lab = last.copy()
    for t in range(steps - 1, -1, -1):
        now = int(ended[t])
        at = starts[:now] + t
        best[at] = lab[:now]
        if t:
            lab[:now] = back[at, lab[:now]]
    return best


class _Batch:
    """Sequences trained on together: their places, the ids seen at each offset, and what the labels count."""

    def __init__(self, slots: Slots, bounds: np.ndarray, gold: np.ndarray, offsets: dict[str, list[int]], labels: int, pads: dict[str, np.ndarray]):
        self.n = n = len(bounds)
        starts = np.flatnonzero(np.append(True, bounds[1:] != bounds[:-1]))
        lengths = np.diff(np.append(starts, n))
        starts = starts[np.argsort(-lengths, kind="stable")]
        lengths = np.sort(lengths)[::-1]
        self.seqs, self.steps = len(starts), int(lengths[0])
        self.alive = [int((lengths > t).sum()) for t in range(self.steps)]
        # Tokens step by step, so that a step is a slice.
        order = np.concatenate([starts[:a] + t for t, a in enumerate(self.alive)])
        self.at = np.concatenate(([0], np.cumsum(self.alive)))
        self.onehot = np.zeros((n, labels), np.float32)
        self.onehot[np.arange(n), gold[order]] = 1
        self.pairs = np.zeros((labels, labels), np.float32)
        inner = bounds[1:] == bounds[:-1]
        np.add.at(self.pairs, (gold[:-1][inner], gold[1:][inner]), 1)
        # Per slot and offset: the types met, where each token's is, and their features; a step works on these alone.
        self.seen = {}
        for slot, offs in offsets.items():
            for o in offs:
                ids = shifted(slots[slot], bounds, o)[order]
                types, where = np.unique(ids, return_inverse=True)
                by = np.argsort(where, kind="stable")
                begin = np.searchsorted(where[by], np.arange(len(types)))
                pad = pads[slot][types]
                owner = np.argsort(pad.ravel(), kind="stable")
                met, at = np.unique(pad.ravel()[owner], return_index=True)
                self.seen[slot, o] = (where, by, begin, pad, owner // pad.shape[1], met, at)


def train(
    slots: Slots, bounds: np.ndarray, gold: np.ndarray, features: dict[str, list[list[int]]], n_features: dict[str, int],
    offsets: dict[str, list[int]], labels: int, forbidden: np.ndarray, epochs: int = 13, batches: int = 48, rate: float = 0.06, l2: float = 3e-5,
) -> tuple[dict[str, dict[int, np.ndarray]], np.ndarray, np.ndarray]:
    """Weights of large penalised likelihood, by Adam on batches: feature weights, transitions, first scores.

    features[slot][type] are the features of a type. forbidden is added to the transitions (very low where not allowed).
    """
    f32 = np.float32
    weights = {(s, o): np.zeros((n_features[s] + 1, labels), f32) for s in offsets for o in offsets[s]}
    trans, first = np.zeros((labels, labels), f32), np.zeros(labels, f32)
    pads = {s: np.array([f + [-1] * (max(map(len, fs)) - len(f)) for f in fs]) for s, fs in features.items()}
    n_seq = int(bounds.max()) + 1
    group = np.arange(n_seq) % batches
    made = []
    for b in range(batches):
        m = group[bounds] == b
        if m.any():
            made.append(_Batch({k: v[m] for k, v in slots.items()}, bounds[m], gold[m], offsets, labels, pads))
    params = [*weights.values(), trans, first]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    start_bar = forbidden_first(forbidden).astype(f32)
    bar = forbidden.astype(f32)
    step, total = 0, epochs * len(made)
    sums = [np.zeros_like(p) for p in params]
    held = 0
    for _ in range(epochs):
        for x in made:
            step += 1
            e = np.zeros((x.n, labels), f32)
            for key, (where, _, _, pad, _, _, _) in x.seen.items():
                e += weights[key][pad].sum(1)[where]
            pe = np.exp(e - e.max(1, keepdims=True))
            m = np.exp(trans + bar)
            alpha, beta, scale = np.empty_like(pe), np.empty_like(pe), np.empty((x.n, 1), f32)
            a = pe[: x.seqs] * np.exp(first + start_bar)
            for t in range(x.steps):
                i, j = x.at[t], x.at[t + 1]
                if t:
                    a = (a[: j - i] @ m) * pe[i:j]
                z = a.sum(1, keepdims=True)
                a = a / z
                alpha[i:j], scale[i:j] = a, z
            pair = np.zeros((labels, labels), f32)
            b, after = None, 0
            for t in range(x.steps - 1, -1, -1):
                i, j = x.at[t], x.at[t + 1]
                now = np.ones((j - i, labels), f32)
                if b is not None:
                    w = pe[j : j + after] * b / scale[j : j + after]
                    now[:after] = w @ m.T
                    pair += (alpha[i : i + after].T @ w) * m
                beta[i:j] = b = now
                after = j - i
            post = alpha * beta
            post /= post.sum(1, keepdims=True)
            resid = (x.onehot - post) / x.seqs
            grads = []
            for key, w in weights.items():
                _, by, begin, _, owner, met, at = x.seen[key]
                by_type = np.add.reduceat(resid[by], begin, axis=0)
                g = np.zeros_like(w)
                g[met] = np.add.reduceat(by_type[owner], at, axis=0)
                g[-1] = 0
                grads.append(g - l2 * w)
            grads.append((x.pairs - pair) / x.seqs - l2 * trans)
            grads.append(resid[: x.seqs].sum(0) - l2 * first)
            r = rate * (1 - 0.8 * step / total)
            for p, g, (m1, m2) in zip(params, grads, moments):
                m1 *= 0.9
                m1 += 0.1 * g
                m2 *= 0.99
                m2 += 0.01 * g * g
                p += r * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
            if step * 2 > total:  # the mean over the second half of the steps errs less than where they end
                held += 1
                for a, p in zip(sums, params):
                    a += p
    for a, p in zip(sums, params):
        p[...] = a / max(1, held)
    by_slot: dict[str, dict[int, np.ndarray]] = {s: {} for s in offsets}
    for (s, o), w in weights.items():
        by_slot[s][o] = w[:-1]
    return by_slot, trans + bar, first + start_bar


def forbidden_first(forbidden: np.ndarray) -> np.ndarray:
    """What may not follow the outside label (0) may not come first either."""
    return forbidden[0]
