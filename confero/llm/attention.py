"""A small causal self-attention model over words' subword ids, trained and run in numpy.

A word enters as the mean of its ids' embeddings.  From the words before it in a window, one attention layer with
relative position biases gives the class of the first id of the next word, or the text's end.  A class is a group of
frequent ids that keep the same company, such as a language's, or a band of the rest by frequency.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW, OVERLAP, WIDTH = 24, 6, 8
TOP, GROUPS, BANDS = 1024, 27, 4
#: Groups, bands, and the text's end.
CLASSES = GROUPS + BANDS + 1
#: What an id is embedded as: itself if it is frequent, else its band; the last is the text's start.
COLUMNS = TOP + BANDS + 1
#: Ids whose company tells groups of frequent ids apart: the most frequent ones.
COMPANY = 64


@dataclass
class Lexicon:
    """What the corpus counts say about ids."""

    column: np.ndarray  # for each id its place among the most frequent, or TOP and its band
    klass: np.ndarray
    inside: np.ndarray  # log share of the id in its band; 0 for frequent ids


def ranks(counts: np.ndarray) -> np.ndarray:
    """Each id's place by its count, the most frequent first."""
    rank = np.empty(len(counts), np.int64)
    rank[np.lexsort((np.arange(len(counts)), -counts))] = np.arange(len(counts))
    return rank


def groups(company: np.ndarray, rounds: int = 25, seed: int = 5) -> np.ndarray:
    """Groups frequent ids by what stands in the same texts: k-means on log-ratios to the expected company."""
    total = company.sum(axis=0) + 1
    share = total / total.sum()
    ratio = np.log((company + 20 * share) / (company.sum(axis=1, keepdims=True) + 20) / share) * np.sqrt(share)
    weight = np.sqrt(company.sum(axis=1) + 1)
    rng = np.random.default_rng(seed)
    far, centres = np.full(len(ratio), np.inf), []
    for _ in range(GROUPS):
        odds = weight * np.minimum(far, 1e9)
        centres.append(ratio[rng.choice(len(ratio), p=odds / odds.sum())] if odds.sum() > 0 else ratio[0])
        far = np.minimum(far, ((ratio - centres[-1]) ** 2).sum(axis=1))
    centre = np.array(centres)
    for _ in range(rounds):
        own = ((ratio**2).sum(axis=1, keepdims=True) - 2 * ratio @ centre.T + (centre**2).sum(axis=1)).argmin(axis=1)
        mass = np.bincount(own, weight, GROUPS)
        for g in np.flatnonzero(mass):
            centre[g] = weight[own == g] @ ratio[own == g] / mass[g]
    return own


def lexicon(counts: np.ndarray, begun: np.ndarray, grouped: np.ndarray) -> Lexicon:
    """From the ids' counts, their counts as words' first ids, and the groups of the TOP most frequent first ids."""

    def bands(rank: np.ndarray) -> np.ndarray:
        return np.clip(np.log2(np.maximum(rank - TOP, 0) / TOP + 1), 0, BANDS - 0.01).astype(np.int64)

    rank, place = ranks(counts), ranks(begun)
    rare, band = rank >= TOP, bands(rank)
    column = np.where(rare, TOP + band, rank).astype(np.int32)
    klass = np.where(place >= TOP, GROUPS + bands(place), grouped[np.minimum(place, TOP - 1)]).astype(np.int32)
    mass = np.where(rare, counts + 0.1, 0.0)
    inside = np.zeros(len(counts))
    inside[rare] = np.log(mass[rare] / np.bincount(band, mass, BANDS)[band[rare]])
    return Lexicon(column, klass, inside)


def initial(share: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights before training: without attention, classes come by their shares."""
    rng, d = np.random.default_rng(seed), WIDTH
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    return {
        "E": (0.3 * rng.standard_normal((COLUMNS, d))).astype(np.float32), "Wq": draw(d, d), "Wk": draw(d, d), "Wv": draw(d, d), "Wr": draw(d, d),
        "rel": (-0.05 * np.arange(WINDOW)).astype(np.float32), "U": (0.1 * rng.standard_normal((d, CLASSES))).astype(np.float32), "b": np.log(share).astype(np.float32),
    }


_LAG = np.arange(WINDOW)[:, None] - np.arange(WINDOW)[None, :]
_LATER = np.where(_LAG >= 0, np.float32(0), np.float32(-1e9))


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (window, WINDOW) in the stream of all texts' inputs, one after another, and which of them are asked for
    what comes next: each input once, with at least OVERLAP inputs of its text before it, or all there are."""
    stride = WINDOW - OVERLAP
    first = np.cumsum(lengths) - lengths
    many = 1 + np.maximum(lengths - WINDOW + stride - 1, 0) // stride
    text = np.repeat(np.arange(len(lengths)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin, stop = first[text] + nth * stride, (first + lengths)[text]
    offsets = np.arange(WINDOW)
    at = begin[:, None] + offsets
    asked = (at < stop[:, None]) & ((offsets >= OVERLAP) | (nth[:, None] == 0))
    return np.minimum(at, stop[:, None] - 1), asked


_ROOM: dict[tuple, np.ndarray] = {}


def _room(name: str, kind: np.dtype, rows: int, *shape: int) -> np.ndarray:
    """An array to write into, kept from step to step: fresh memory costs more than what is done with it."""
    held = _ROOM.get((name, kind, shape))
    if held is None or len(held) < rows:
        held = _ROOM[name, kind, shape] = np.empty((rows, *shape), kind)
    return held[:rows]


def gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, asked: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Cross-entropy of the classes y that follow the inputs x (batch, window, width), where asked for; its gradient, by
    weights and by x."""
    scale = np.float32(1 / np.sqrt(WIDTH))
    n, w, d = x.shape
    flat = x.reshape(-1, d)
    q, k, v = ((flat @ p[m]).reshape(n, w, d) for m in ("Wq", "Wk", "Wv"))
    a = np.matmul(q, k.transpose(0, 2, 1), out=_room("a", x.dtype, n, w, w))
    a *= scale
    np.clip(a, -30, 30, out=a)
    a += p["rel"][np.maximum(_LAG, 0)] + _LATER
    np.exp(a, out=a)
    a /= a @ np.ones((w, 1), a.dtype)
    mixed = np.matmul(a, v, out=_room("mixed", x.dtype, n, w, d))
    g = np.matmul(flat, p["Wr"], out=_room("g", x.dtype, n * w, d))
    g += mixed.reshape(-1, d)
    use = np.flatnonzero(asked.ravel())
    gu, target, rows = g[use], y.ravel()[use], np.arange(len(use))
    z = np.matmul(gu, p["U"], out=_room("z", x.dtype, len(use), CLASSES))
    z += p["b"]
    np.clip(z, -60, 60, out=z)
    np.exp(z, out=z)
    z /= z @ np.ones((CLASSES, 1), z.dtype)
    total = max(len(use), 1)
    loss = float(-np.log(z[rows, target] + 1e-30).sum() / total)
    z[rows, target] -= 1
    z /= np.float32(total)
    out = {"U": gu.T @ z, "b": z.sum(axis=0)}
    dg = _room("dg", x.dtype, n * w, d)
    dg[:] = 0
    dg[use] = z @ p["U"].T
    dg3 = dg.reshape(n, w, d)
    ds = np.matmul(dg3, v.transpose(0, 2, 1), out=_room("ds", x.dtype, n, w, w))
    dv = (a.transpose(0, 2, 1) @ dg3).reshape(-1, d)
    ds -= (dg3 * mixed).sum(axis=2, keepdims=True)
    ds *= a
    out["rel"] = np.bincount(np.maximum(_LAG, 0).ravel(), (ds.sum(axis=0) * (_LAG >= 0)).ravel(), WINDOW).astype(np.float32)
    ds *= scale
    dq, dk = (ds @ k).reshape(-1, d), (ds.transpose(0, 2, 1) @ q).reshape(-1, d)
    dx = np.zeros_like(flat)
    for m, g in (("Wq", dq), ("Wk", dk), ("Wv", dv), ("Wr", dg)):
        out[m] = flat.T @ g
        dx += g @ p[m].T
    return loss, out, dx.reshape(n, w, d)


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, d in g.items():
            self.m[k] += np.float32(0.1) * (d - self.m[k])
            self.v[k] += np.float32(0.01) * (d * d - self.v[k])
            self.p[k] -= np.float32(self.rate / (1 - 0.9**self.t)) * self.m[k] / (np.sqrt(self.v[k] * np.float32(1 / (1 - 0.99**self.t))) + np.float32(1e-8))


def pooled(p: dict[str, np.ndarray], columns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Words as the means of their ids' embeddings; columns: those of all words, one after another."""
    run, stop = np.zeros((len(columns) + 1, WIDTH)), np.cumsum(lengths)
    np.cumsum(p["E"][columns], axis=0, out=run[1:])
    return ((run[stop] - run[stop - lengths]) / lengths[:, None]).astype(np.float32)


def train(p: dict[str, np.ndarray], adam: Adam, columns: np.ndarray, counts: np.ndarray, target: np.ndarray, lengths: np.ndarray, size: int = 96) -> None:
    """Steps over all windows of some texts, whose inputs stand one after another: the columns of their ids, how many
    ids each has, and the class after each."""
    at, asked = windows(lengths)
    stop = np.cumsum(counts)
    for i in range(0, len(at), size):
        place = at[i : i + size]
        low, high = int(place[0, 0]), int(place[-1].max()) + 1
        n, own = counts[low:high], columns[stop[low] - counts[low] : stop[high - 1]]
        place = place - low
        _, g, dx = gradient(p, pooled(p, own, n)[place], target[low:high][place], asked[i : i + size])
        flat, place = dx.reshape(-1, WIDTH), place.ravel()
        by_word = np.stack([np.bincount(place, flat[:, j], len(n)) for j in range(WIDTH)], axis=1) / n[:, None]
        by_id = np.repeat(by_word, n, axis=0)
        g["E"] = np.stack([np.bincount(own, by_id[:, j], COLUMNS) for j in range(WIDTH)], axis=1).astype(np.float32)
        adam.step(g)


class Scorer:
    """Log-probabilities of the classes that follow the inputs; each input is asked in one window."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p
        self.bias = np.where(_LAG >= 0, np.exp(np.minimum(p["rel"][np.maximum(_LAG, 0)], 30)), 0).astype(np.float32)
        self.maps = np.concatenate([p["Wq"] / np.float32(np.sqrt(WIDTH)), p["Wk"], p["Wv"], p["Wr"]], axis=1)

    def score(self, x: np.ndarray, target: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The natural log-probability of the class after each input; x: the means of the inputs of all texts."""
        at, asked = windows(lengths)
        maps = x @ self.maps  # queries, keys, values and direct parts, side by side
        out, d = np.empty(len(maps)), WIDTH
        for i in range(0, len(at), 256):
            place, use = at[i : i + 256], np.flatnonzero(asked[i : i + 256].ravel())
            m = maps[place]
            s = m[:, :, :d] @ m[:, :, d : 2 * d].transpose(0, 2, 1)
            np.clip(s, -30, 30, out=s)
            np.exp(s, out=s)
            s *= self.bias
            g = s @ m[:, :, 2 * d : 3 * d]
            g /= s @ np.ones((WINDOW, 1), s.dtype)
            g += m[:, :, 3 * d :]
            z = g.reshape(-1, d)[use] @ self.p["U"] + self.p["b"]
            own = place.ravel()[use]
            np.clip(z, -60, 60, out=z)
            out[own] = z[np.arange(len(use)), target[own]] - np.log(np.exp(z) @ np.ones(CLASSES, z.dtype))
        return out
