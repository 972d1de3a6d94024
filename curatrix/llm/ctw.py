"""Context-tree weighting over bytes, trained in batch and then frozen.

A byte is eight binary decisions (a walk down a 255-node binary tree).  Each of
the 255 nodes owns a context tree over the preceding bytes, up to ``depth`` of
them.  At a context s with zero/one counts (a, b) the Krichevsky-Trofimov block
probability is ``P_e(s)``; the weighted probability is ``P_e(s)`` at a leaf and
``(P_e(s) + prod P_w(children)) / 2`` above.  The frozen predictor mixes every
depth of the context path: ``p(s) = w * KT(s) + (1 - w) * p(child)`` with
``w = P_e(s) / (2 P_w(s))``.

``sums_above``, ``mix_above`` and ``gram_logs`` fit the whole tree, in parts of the
grams that share their newest context bytes; only nodes on the path of a gram are
held.  ``ContextTree`` states the same model in one place over any closed set of
contexts (tests compare the two); there, what an inner context's kept children
don't cover is one more child, a leaf.

A text is coded as its UTF-8 bytes and one END byte (0xFF never occurs in
UTF-8), behind a context of END bytes, so scores are proper probabilities of
whole texts.
"""

from __future__ import annotations

import math

import numpy as np

END = 0xFF
LOG_HALF = math.log(0.5)
#: States fitted at once.
FIT_ROWS = 1024


def lgamma(x: np.ndarray) -> np.ndarray:
    """Log gamma for positive arrays: recurrence up to 8, then Stirling's series."""
    y = np.array(x, dtype=np.float64)
    shift = np.zeros_like(y)
    for _ in range(8):
        low = y < 8
        if not low.any():
            break
        shift[low] += np.log(y[low])
        y[low] += 1
    inv = 1 / y
    inv2 = inv * inv
    series = inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680)))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Log of the KT block probability of a zeros and b ones."""
    return lgamma(a + 0.5) + lgamma(b + 0.5) - math.log(math.pi) - lgamma(a + b + 1)


def coded(texts: list[str | None], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, positions to predict, first of these of each text) of texts, each behind ``depth`` END bytes."""
    pad = bytes([END]) * depth
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(x for p in parts for x in (pad, p, b"\xff")), np.uint8)
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    firsts = np.cumsum(sizes) - sizes
    shift = np.repeat(depth * np.arange(1, len(parts) + 1), sizes)
    return codes, np.arange(sizes.sum()) + shift, firsts


def gram_keys(codes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``context * 256 + byte`` at the positions; the byte just before is the context's lowest."""
    key = codes.astype(np.int64)
    whole = key.copy()
    for d in range(1, depth + 1):
        whole[d:] |= key[: key.size - d] << (8 * d)
    return whole[at]


def _node_counts(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows[n, 256] symbol counts -> zeros[n, 255], ones[n, 255] of binary nodes (heap order)."""
    n = rows.shape[0]
    zeros, ones = np.empty((n, 255)), np.empty((n, 255))
    level = rows
    for bits in range(7, -1, -1):
        pairs = level.reshape(n, -1, 2)
        lo, hi = 2**bits - 1, 2 ** (bits + 1) - 1
        zeros[:, lo:hi], ones[:, lo:hi] = pairs[:, :, 0], pairs[:, :, 1]
        level = pairs.sum(axis=2)
    return zeros, ones


def _symbol_logs(p_one: np.ndarray) -> np.ndarray:
    """Bit predictions [n, 255] -> log10 probability of each byte [n, 256]."""
    n = p_one.shape[0]
    logs = np.zeros((n, 1))
    for bits in range(8):
        p = p_one[:, 2**bits - 1 : 2 ** (bits + 1) - 1]
        logs = (logs[:, :, None] + np.stack([np.log10(1 - p), np.log10(p)], axis=2)).reshape(n, -1)
    return logs


_SMALL = np.arange(65536, dtype=np.float64)
_HALVES, _WHOLES = lgamma(_SMALL + 0.5), lgamma(_SMALL + 1)


def _log_kt_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``log_kt`` of whole numbers, small ones from a table."""
    n = a + b
    small = n < _SMALL.size
    i, j = (np.where(small, x, 0).astype(np.int64) for x in (a, b))
    out = _HALVES[i] + _HALVES[j] - math.log(math.pi) - _WHOLES[i + j]
    if not small.all():
        out[~small] = log_kt(a[~small], b[~small])
    return out


def _nodes(g: np.ndarray, n: np.ndarray, depth: int, bit: int) -> tuple:
    """(node keys ``context * 256 + node``, each gram's node, each gram's bit, zeros, ones) at full depth."""
    symbol = g & 255
    node, one = (1 << bit) | (symbol >> (8 - bit)), (symbol >> (7 - bit)) & 1
    keys, of = np.unique((g >> 8) * 256 + node, return_inverse=True)
    return keys, of, one, np.bincount(of, n * (1 - one), keys.size), np.bincount(of, n * one, keys.size)


def _shorter(keys: np.ndarray, depth: int) -> np.ndarray:
    """Node keys cut to the newest ``depth`` context bytes."""
    return keys & ((1 << (8 * depth + 8)) - 1)


def _raise(keys, zeros, ones, split, depth: int, to: int) -> tuple:
    """Log weighted probabilities of nodes at ``depth`` up to ``to``: (keys, zeros, ones, log_w, [(parents, weight, kt)]).

    split: the summed log_w of the children; None at the tree's leaves.
    """
    steps = []
    for d in range(depth, to - 1, -1):
        log_e = _log_kt_counts(zeros, ones)
        if split is None:
            log_w, weight = log_e, np.ones_like(log_e)
        else:
            log_w = LOG_HALF + np.logaddexp(log_e, split)
            weight = np.exp(LOG_HALF + log_e - log_w)
        step = [None, weight, (ones + 0.5) / (zeros + ones + 1)]
        steps.append(step)
        if d == to:
            break
        keys, step[0] = np.unique(_shorter(keys, d - 1), return_inverse=True)
        zeros, ones, split = (np.bincount(step[0], x, keys.size) for x in (zeros, ones, log_w))
    return keys, zeros, ones, log_w, steps


def _descend(steps: list) -> tuple[np.ndarray, np.ndarray]:
    """(own, rest) of the deepest nodes: the prediction is ``own + rest * p`` with p from below them."""
    own, rest, at = np.zeros(steps[0][1].size), np.ones(steps[0][1].size), np.arange(steps[0][1].size)
    for parents, weight, kt in steps:
        own, rest = weight[at] * kt[at] + (1 - weight[at]) * own, (1 - weight[at]) * rest
        at = parents[at] if parents is not None else at
    return own, rest


def sums_above(g: np.ndarray, n: np.ndarray, depth: int, low: int):
    """For each bit: (node keys at ``low - 1`` bytes, zeros, ones, summed log_w of these grams' contexts of ``low`` bytes)."""
    for bit in range(8 if g.size else 0):
        keys, _, _, zeros, ones = _nodes(g, n, depth, bit)
        keys, zeros, ones, log_w, _ = _raise(keys, zeros, ones, None, depth, low)
        above, of = np.unique(_shorter(keys, low - 1), return_inverse=True)
        yield (above, *(np.bincount(of, x, above.size) for x in (zeros, ones, log_w)))


def mix_above(keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, split: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node keys, own, rest) of all contexts of ``low - 1`` bytes, from the summed ``sums_above``."""
    if not keys.size:
        return keys, np.empty(0), np.empty(0)
    by = np.argsort(keys)
    steps = _raise(keys[by], zeros[by], ones[by], split[by], low - 1, 0)[4]
    return (keys[by], *_descend(steps))


def gram_logs(g: np.ndarray, n: np.ndarray, depth: int, low: int, above: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Log10 probability of each gram's last byte; all grams that share ``low`` context bytes are there."""
    out = np.zeros(g.size)
    for bit in range(8):
        keys, of, one, zeros, ones = _nodes(g, n, depth, bit)
        own, _ = _descend(_raise(keys, zeros, ones, None, depth, low)[4])
        if low:
            at = np.searchsorted(above[0], _shorter(keys, low - 1))
            own = above[1][at] + above[2][at] * own
        out += np.log10(np.where(one == 1, own[of], 1 - own[of]))
    return out


class ContextTree:
    """States are the kept contexts, the root first; ``table[state]`` has log10 of the 256 bytes' probabilities.

    depths, contexts: the kept contexts, closed under dropping the oldest byte.
    rows: (state, byte, count) of the training bytes seen in each context.
    """

    def __init__(self, depths: np.ndarray, contexts: np.ndarray, rows: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.depth = int(depths.max(initial=0))
        order = np.lexsort((contexts, depths))
        place = np.empty(order.size, np.int64)
        place[order] = np.arange(order.size)
        depths, contexts = depths[order], contexts[order]
        starts = np.searchsorted(depths, np.arange(self.depth + 2))
        parent = np.zeros(order.size, np.int64)
        for d in range(1, self.depth + 1):
            mine = slice(starts[d], starts[d + 1])
            parent[mine] = starts[d - 1] + np.searchsorted(contexts[starts[d - 1] : starts[d]], contexts[mine] & ((1 << (8 * (d - 1))) - 1))
        oldest = np.zeros(order.size, np.int64)
        inner = depths > 0
        oldest[inner] = contexts[inner] >> (8 * (depths[inner] - 1))
        #: Keys ``state * 256 + older byte`` and the state they lead to.
        self.edges = (parent[inner] * 256 + oldest[inner], np.flatnonzero(inner))
        self.n = max(1, order.size)
        self.table = np.empty((self.n, 256), np.float32)
        states, symbols, counts = rows
        self._fit(starts, parent, place[states] if order.size else states, symbols, counts)

    def _fit(self, starts, parent, states, symbols, counts) -> None:
        """Bottom up for the weights, then every state's row down its path; ``FIT_ROWS`` states at a time."""
        if not len(starts) or starts[-1] == 0:
            self.table[:] = math.log10(1 / 256)
            return
        by = np.argsort(states, kind="stable")
        states, symbols, counts = states[by], symbols[by], counts[by].astype(np.float64)
        inner = np.unique(parent[int(starts[1]) :])  # only these are ever above another state
        kt, weight = (np.empty((inner.size, 255), np.float32) for _ in range(2))
        split = covered = kids = None
        for d in range(self.depth, -1, -1):
            above = inner[(inner >= starts[d - 1]) & (inner < starts[d])] if d else inner[:0]
            next_split, next_covered = np.zeros((above.size, 255)), np.zeros((above.size, 256))
            for lo in range(int(starts[d]), int(starts[d + 1]), FIT_ROWS):
                hi = min(lo + FIT_ROWS, int(starts[d + 1]))
                a, b = np.searchsorted(states, [lo, hi])
                dense = np.zeros((hi - lo, 256))
                np.add.at(dense, (states[a:b] - lo, symbols[a:b]), counts[a:b])
                zeros, ones = _node_counts(dense)
                log_w = log_kt(zeros, ones)
                p = (ones + 0.5) / (zeros + ones + 1)
                if kids is not None and kids.size:
                    i, j = np.searchsorted(kids, [lo, hi])
                    if i < j:
                        mine, at = kids[i:j] - lo, np.searchsorted(inner, kids[i:j])
                        z, o = _node_counts(np.maximum(dense[mine] - covered[i:j], 0))
                        log_e = log_w[mine]
                        log_w[mine] = LOG_HALF + np.logaddexp(log_e, split[i:j] + log_kt(z, o))
                        w = np.exp(LOG_HALF + log_e - log_w[mine])
                        kt[at], weight[at] = p[mine], w
                        p[mine] = w * p[mine] + (1 - w) * (o + 0.5) / (z + o + 1)
                self.table[lo:hi, :255] = p
                if d:
                    up = np.searchsorted(above, parent[lo:hi])
                    np.add.at(next_split, up, log_w)
                    np.add.at(next_covered, up, dense)
            split, covered, kids = next_split, next_covered, above
        for d in range(self.depth + 1):
            for lo in range(int(starts[d]), int(starts[d + 1]), FIT_ROWS):
                part = np.arange(lo, min(lo + FIT_ROWS, int(starts[d + 1])))
                p, up = self.table[part, :255].astype(np.float64), part
                for _ in range(d):
                    up = parent[up]
                    k = np.searchsorted(inner, up)
                    p = weight[k] * kt[k] + (1 - weight[k]) * p
                self.table[part] = _symbol_logs(p)


class Scorer:
    """Log10 probabilities of texts under a tree's table and edges."""

    def __init__(self, depth: int, edges: tuple[np.ndarray, np.ndarray], table: np.ndarray):
        self.depth, self.table = depth, table
        self.child = np.full(len(table) * 256, -1, np.int32)
        self.child[edges[0]] = edges[1]

    def score(self, texts: list[str | None]) -> np.ndarray:
        codes, at, firsts = coded(texts, self.depth)
        state = np.zeros(at.size, np.int32)
        alive, where, now = None, at, state
        for d in range(1, self.depth + 1):
            step = self.child[now.astype(np.int64) * 256 + codes[where - d]]
            good = step >= 0
            alive = np.flatnonzero(good) if alive is None else alive[good]
            where, now = where[good], step[good]
            state[alive] = now
        logs = self.table[state, codes[at]].astype(np.float64)
        return np.add.reduceat(logs, firsts) if firsts.size else np.empty(0)
