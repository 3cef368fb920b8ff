"""A small gated recurrent language model in numpy, with a class-factored output.

The probability of a token is that of its class given the state, times that
of the token within its class: a softmax over up to ``WORDS`` words for the
classes of frequent words, a fixed distribution (given by the caller) for
the others. State and update gates follow the usual GRU; the product of the
state with the candidate's matrix is gated after it is made.
"""

from __future__ import annotations

import heapq

import numpy as np

H, WORDS = 24, 32


def new_params(n_inputs: int, class_prior: np.ndarray, word_prior: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Random weights; the biases start at the log of the priors, which is the unigram model.

    ``word_prior``: classes x WORDS, zero for places without a word.
    """
    rng = np.random.default_rng(seed)
    r = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
    with np.errstate(divide="ignore"):
        words = np.where(word_prior > 0, np.log(word_prior), -1e9).astype(np.float32)
    return {"x": r(n_inputs, 3 * H), "u": r(H, 3 * H), "b": np.zeros(H, np.float32),
            "wc": r(H, len(class_prior)) * 0, "bc": np.log(class_prior).astype(np.float32),
            "ww": r(len(word_prior), H, WORDS) * 0, "bw": words}


def _sigmoid(x):
    x = np.tanh(x * 0.5)
    x *= 0.5
    x += 0.5
    return x


def step(b: np.ndarray, ut: np.ndarray, x: np.ndarray, h: np.ndarray):
    """One step of all lanes; lanes are columns here, so that each gate is one block of memory."""
    hu = ut @ h
    zr = _sigmoid(x[:2 * H] + hu[:2 * H])
    hn = hu[2 * H:] + b[:, None]
    n = zr[H:] * hn
    n += x[2 * H:]
    np.tanh(n, out=n)
    return n + zr[:H] * (h - n), zr, n, hn


def _read(x: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Rows of a matrix as columns."""
    return np.ascontiguousarray(x.take(ids, axis=0, mode="clip").T)


def _softmax(z: np.ndarray, target: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Natural log of each column's target probability; ``z`` becomes the probabilities."""
    top = z.max(axis=0)
    out = z[target, columns] - top
    z -= top
    np.exp(z, out=z)
    total = z.sum(axis=0)
    out -= np.log(total)
    z *= 1 / total
    return out


def output(p: dict, h: np.ndarray, cls: np.ndarray, word: np.ndarray, grads: dict | None = None):
    """Natural log of each target's probability (class, and word where ``word >= 0``).

    With ``grads`` given, also adds the gradients of the summed loss and
    returns that of the states. Works by columns: fastest where ``h`` is the
    transpose of an array in order.
    """
    ht, columns = h.T, np.arange(len(h))
    z = p["wc"].T @ ht
    z += p["bc"][:, None]
    out = _softmax(z, cls, columns).astype(np.float64)
    dh = None
    if grads is not None:
        z[cls, columns] -= 1
        grads["wc"] += ht @ z.T
        grads["bc"] += z.sum(axis=1)
        dh = p["wc"] @ z
    at = np.flatnonzero(word >= 0)
    at = at[np.argsort(cls[at].astype(np.int16), kind="stable")]
    starts = np.searchsorted(cls[at], np.arange(len(p["bw"]) + 1))
    mine, target, columns = ht.take(at, axis=1), word[at], np.arange(len(at))
    logs, dmine = np.empty(len(at)), np.empty_like(mine)
    for k in np.flatnonzero(np.diff(starts)):
        i = slice(starts[k], starts[k + 1])
        one, t, c = mine[:, i], target[i], columns[:starts[k + 1] - starts[k]]
        z = p["ww"][k].T @ one
        z += p["bw"][k][:, None]
        logs[i] = _softmax(z, t, c)
        if grads is not None:
            z[t, c] -= 1
            grads["ww"][k] += one @ z.T
            grads["bw"][k] += z.sum(axis=1)
            dmine[:, i] = p["ww"][k] @ z
    out[at] += logs
    if grads is not None:
        place = np.full(len(h), len(at))                      # the last column: nothing to add
        place[at] = columns
        dh += np.concatenate([dmine, np.zeros((H, 1), dmine.dtype)], axis=1).take(place, axis=1)
        dh = dh.T
    return out, dh


class Lanes:
    """Documents dealt to parallel lanes, longest lane first; each lane reads its documents in turn."""

    def __init__(self, lengths: list[int], n_lanes: int):
        n = max(1, min(n_lanes, len(lengths)))
        heap, lanes = [(0, i) for i in range(n)], [[] for _ in range(n)]
        for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
            size, i = heapq.heappop(heap)
            lanes[i].append(d)
            heapq.heappush(heap, (size + lengths[d], i))
        total = lambda ds: sum(lengths[d] for d in ds)
        lanes.sort(key=lambda ds: -total(ds))
        self.size = np.array([total(ds) for ds in lanes])
        self.steps = int(self.size[0]) if lanes and lengths else 0
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        # the token that lane i reads at step t, -1 after its end; and whether a document begins there
        self.token = np.full((self.steps, n), -1, np.int64)
        self.begins = np.zeros((self.steps, n), bool)
        for i, ds in enumerate(lanes):
            t = 0
            for d in ds:
                m = lengths[d]
                self.token[t:t + m, i] = np.arange(offsets[d], offsets[d] + m)
                if m:
                    self.begins[t, i] = True
                t += m

    def active(self, t: int) -> int:
        return int((self.size > t).sum())


def score(p: dict, inputs: np.ndarray, cls: np.ndarray, word: np.ndarray, lengths: list[int],
          n_lanes: int = 256, window: int = 64) -> np.ndarray:
    """Natural log-probability of each token of some documents laid end to end.

    ``inputs``: what the model reads before each token. The state is carried
    through a whole document, from window to window, and starts anew with
    the next one.
    """
    lanes = Lanes(lengths, n_lanes)
    out = np.zeros(len(inputs))
    ut = np.ascontiguousarray(p["u"].T)
    h = np.zeros((H, lanes.token.shape[1]), np.float32)
    for t0 in range(0, lanes.steps, window):
        states, tokens = [], []
        for t in range(t0, min(t0 + window, lanes.steps)):
            n = lanes.active(t)
            if n < h.shape[1]:
                h = np.ascontiguousarray(h[:, :n])
            if lanes.begins[t, :n].any():
                h = np.where(lanes.begins[t, :n], np.float32(0), h)
            at = lanes.token[t, :n]
            h = step(p["b"], ut, _read(p["x"], inputs[at]), h)[0]
            states.append(h)
            tokens.append(at)
        at = np.concatenate(tokens)
        out[at] = output(p, np.concatenate(states, axis=1).T, cls[at], word[at])[0]
    return out


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def update(self, g: dict) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 1.0 / max(size, 1e-12))
        a = self.rate * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, x in g.items():
            x = x * np.float32(clip)
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (x - m)
            x *= x
            x -= v
            x *= np.float32(0.001)
            v += x
            np.sqrt(v, out=x)
            x += np.float32(1e-8)
            np.divide(m, x, out=x)
            x *= np.float32(a)
            self.p[k] -= x


def gradients(p: dict, xs: list[np.ndarray], cls: np.ndarray, word: np.ndarray, keep: list[np.ndarray],
              h: np.ndarray, live: np.ndarray | None = None) -> tuple[float, dict, np.ndarray]:
    """Loss, gradients of the mean loss, and the last state, over one window.

    ``live``: which targets count (None: all).

    ``xs[t]``: inputs of the lanes at step t; ``keep[t]``: 0 where a document
    begins; ``h``: the state that comes in (no gradient flows into it).
    """
    lanes, steps = len(h), len(xs)
    ut, u = np.ascontiguousarray(p["u"].T), p["u"]
    h = np.ascontiguousarray(h.T)
    trace, states = [], np.empty((H, steps, lanes), u.dtype)
    for t, (x, k) in enumerate(zip(xs, keep)):
        before = h * k
        h, zr, n, hn = step(p["b"], ut, _read(p["x"], x), before)
        trace.append((before, zr, n, hn))
        states[:, t] = h
    g = {k: np.zeros_like(v) for k, v in p.items()}
    states = states.reshape(H, -1)
    if live is None:
        logp, dhs = output(p, states.T, cls, word, g)
        dhs = dhs.T.reshape(H, steps, lanes)
    else:
        dhs = np.zeros_like(states)
        at = np.flatnonzero(live)
        logp, found = output(p, states.take(at, axis=1).T, cls[at], word[at], g)
        dhs[:, at] = found.T
        dhs = dhs.reshape(H, steps, lanes)
    dh = np.zeros_like(h)
    dx = np.empty((3 * H, steps, lanes), u.dtype)
    du = np.empty((3 * H, lanes), u.dtype)
    for t in range(steps - 1, -1, -1):
        before, zr, n, hn = trace[t]
        z, r = zr[:H], zr[H:]
        dh += dhs[:, t]
        dn = (1 - n * n) * (dh * (1 - z))
        slopes = zr * (1 - zr)
        np.multiply(dh * (before - n), slopes[:H], out=du[:H])
        np.multiply(dn * hn, slopes[H:], out=du[H:2 * H])
        dhn = np.multiply(dn, r, out=du[2 * H:])
        g["u"] += before @ du.T
        g["b"] += dhn.sum(axis=1)
        dx[:2 * H, t] = du[:2 * H]
        dx[2 * H:, t] = dn
        dh *= z
        dh += u @ du
        dh *= keep[t]
    read = np.concatenate(xs)
    for i, row in enumerate(dx.reshape(3 * H, -1)):
        g["x"][:, i] = np.bincount(read, row, len(p["x"]))
    count = len(logp)
    return float(-logp.mean()), {k: v / count for k, v in g.items()}, np.ascontiguousarray(h.T)


class Trainer:
    """Truncated backpropagation through time over documents laid end to end, a part of them at a time.

    Every token of a part is learnt from once; the state is carried from
    window to window through a whole document. Where a lane ends inside a
    window, the rest of it is read but its loss does not count.
    """

    def __init__(self, p: dict, n_lanes: int = 256, window: int = 32, rate: float = 0.01):
        self.p, self.n_lanes, self.window, self.adam = p, n_lanes, window, Adam(p, rate)

    def part(self, inputs: np.ndarray, cls: np.ndarray, word: np.ndarray, lengths: list[int]) -> None:
        lanes = Lanes(lengths, self.n_lanes)
        h = np.zeros((lanes.token.shape[1], H), np.float32)
        for t0 in range(0, lanes.steps, self.window):
            stop = min(t0 + self.window, lanes.steps)
            n = lanes.active(t0)
            at = lanes.token[t0:stop, :n]
            live = (at >= 0).ravel()
            at = np.maximum(at, 0)
            flat = at.ravel()
            keep = 1 - lanes.begins[t0:stop, :n].astype(np.float32)
            _, g, h = gradients(self.p, list(inputs[at]), cls[flat], word[flat], list(keep), h[:n], None if live.all() else live)
            self.adam.update(g)
