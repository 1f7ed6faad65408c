"""Small numpy kernels for one batch of per-draw matrices, shape (draws, n, n).

``g[b, i, j]`` is the edge j -> i of draw b. Each kernel works on the whole batch at once.
"""

from __future__ import annotations

import heapq

import numpy as np


def centrality(w: np.ndarray, max_iter: int = 200, damping: float = 0.85, tol: float = 1e-10) -> np.ndarray:
    """Damped in-centrality; mass at nodes without outgoing edges is lost, empty graphs are uniform."""
    b, n, _ = w.shape
    out = w.sum(axis=1, keepdims=True)
    step = w / np.where(out == 0, 1.0, out)
    x = np.full((b, n), 1.0 / n)
    live = w.reshape(b, -1).sum(axis=1) != 0
    for _ in range(max_iter):
        if not live.any():
            break
        nxt = damping * np.einsum("bij,bj->bi", step[live], x[live]) + (1.0 - damping) / n
        moved = np.linalg.norm(nxt - x[live], axis=1) >= tol
        x[live] = nxt
        live[np.flatnonzero(live)[~moved]] = False
    return x


def betweenness(g: np.ndarray) -> np.ndarray:
    """Share of shortest paths through each node, level by level for all sources of all draws.

    Normalised by (n-1)(n-2); NaN for a draw without edges.
    """
    b, n, _ = g.shape
    a = np.swapaxes(g, 1, 2) != 0
    a[:, np.arange(n), np.arange(n)] = False
    step = a.astype(float)
    eye = np.broadcast_to(np.eye(n, dtype=bool), a.shape)
    seen, paths, levels = eye.copy(), eye.astype(float), [eye]
    while True:
        reach = (paths * levels[-1]) @ step
        new = (reach > 0) & ~seen
        if not new.any():
            break
        paths = np.where(new, reach, paths)
        seen |= new
        levels.append(new)
    share = np.zeros(a.shape)
    safe = np.where(paths > 0, paths, 1.0)
    for depth in range(len(levels) - 1, 0, -1):
        carried = np.where(levels[depth], (1.0 + share) / safe, 0.0) @ np.swapaxes(step, 1, 2)
        share = np.where(levels[depth - 1], share + paths * carried, share)
    share[eye] = 0.0
    score = share.sum(axis=1) / max((n - 1) * (n - 2), 1)
    score[~(g.reshape(b, -1) != 0).any(axis=1)] = np.nan
    return score


def weighted_betweenness(w: np.ndarray) -> np.ndarray:
    """Betweenness of one weight matrix with edge length 1 / weight; self-loops are ignored."""
    n = len(w)
    ahead = [[(i, 1.0 / w[i, j]) for i in range(n) if i != j and w[i, j] > 0] for j in range(n)]
    if not any(ahead):
        return np.full(n, np.nan)
    score = np.zeros(n)
    for source in range(n):
        best = np.full(n, np.inf)
        best[source] = 0.0
        count = np.zeros(n)
        count[source] = 1.0
        before: list[list[int]] = [[] for _ in range(n)]
        settled: list[int] = []
        done = np.zeros(n, dtype=bool)
        queue = [(0.0, source)]
        while queue:
            d, v = heapq.heappop(queue)
            if done[v]:
                continue
            done[v] = True
            settled.append(v)
            for t, length in ahead[v]:
                if done[t]:
                    continue
                if d + length < best[t]:
                    best[t], count[t], before[t] = d + length, count[v], [v]
                    heapq.heappush(queue, (best[t], t))
                elif d + length == best[t]:
                    count[t] += count[v]
                    before[t].append(v)
        load = np.zeros(n)
        for v in reversed(settled):
            for u in before[v]:
                load[u] += count[u] / count[v] * (1.0 + load[v])
            if v != source:
                score[v] += load[v]
    return score / max((n - 1) * (n - 2), 1)


def closure(g: np.ndarray) -> np.ndarray:
    """Pairs joined by a path of at least one edge (repeated squaring)."""
    r = g != 0
    for _ in range(max(1, int(np.ceil(np.log2(max(g.shape[1], 2)))) + 1)):
        f = r.astype(np.float32)
        r = r | ((f @ f) > 0)
    return r


def strong_components(g: np.ndarray) -> np.ndarray:
    """Number of strongly connected components: nodes that are the first of their component."""
    r = closure(g)
    n = g.shape[1]
    mutual = (r & np.swapaxes(r, 1, 2)) | np.eye(n, dtype=bool)
    return (mutual.argmax(axis=2) == np.arange(n)).sum(axis=1)


def acyclic(g: np.ndarray) -> np.ndarray:
    r = closure(g)
    return ~np.einsum("bii->bi", r).any(axis=1)


def transitivity(g: np.ndarray) -> np.ndarray:
    """Closed out-neighbour pairs (v->w, v->x, w->x) over d(d-1); NaN without edges, 0 without pairs."""
    a = (np.swapaxes(g, 1, 2) != 0).astype(float)
    any_edge = a.any(axis=(1, 2))
    a[:, np.arange(a.shape[1]), np.arange(a.shape[1])] = 0.0
    closed = np.einsum("bvw,bwx,bvx->b", a, a, a)
    d = a.sum(axis=2)
    pairs = (d * (d - 1)).sum(axis=1)
    out = np.divide(closed, pairs, out=np.zeros(len(a)), where=(pairs > 0) & (closed > 0))
    return np.where(any_edge, out, np.nan)


#: The norm of a power 2^26 is that of its largest eigenvalue but for some 1e-7 of it.
SQUARINGS = 26


def spectral_radius(phi: np.ndarray) -> np.ndarray:
    """Largest eigenvalue modulus of the companion matrix; phi is (draws, lags, n, n).

    By Gelfand's formula: the norm of the 2^k-th power, which ``SQUARINGS`` squarings give, to the power 2^-k. Every square is
    scaled to norm 1 and the logarithms of the scales are added up; a nilpotent matrix has radius 0.
    """
    b, p, n, _ = phi.shape
    power = np.zeros((b, n * p, n * p))
    power[:, :n, :] = np.swapaxes(phi, 1, 2).reshape(b, n, p * n)
    power[:, n:, : n * (p - 1)] = np.eye(n * (p - 1))
    logs, weight = np.zeros(b), 1.0
    for k in range(SQUARINGS + 1):
        norm = np.sqrt(np.einsum("bij,bij->b", power, power))
        with np.errstate(divide="ignore"):
            logs += weight * np.log(norm)
        power = power / np.where(norm > 0, norm, 1.0)[:, None, None]
        power, weight = power @ power, weight / 2
    return np.exp(logs)


def structural(sigma: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Regression of each node on its parents implied by a covariance: coefficients and residual
    variances per draw.

    All nodes of all draws are solved at once: rows and columns of non-parents become those of the unit
    matrix, so their coefficients are 0.
    """
    n = sigma.shape[1]
    parents = (g != 0) & ~np.eye(n, dtype=bool)
    both = parents[:, :, :, None] & parents[:, :, None, :]
    system = np.where(both, sigma[:, None, :, :], np.eye(n))
    right = np.where(parents, sigma, 0.0)
    b0 = np.linalg.solve(system, right[..., None])[..., 0]
    return b0, np.einsum("bii->bi", sigma) - np.einsum("bij,bij->bi", b0, right)
