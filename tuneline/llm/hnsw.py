"""A hierarchical navigable small-world graph in flat neighbour arrays (numpy).

Points go in by batches: each batch searches the graph so far side by side, and its points
also look at each other. The graph links unit vectors, and a search walks it by inner products with
the points themselves. Where vectors point all ways, the unit vectors are their directions, and norms in one graph
should lie close together; where they share a direction, so that the longest ones are near to every query, one more
coordinate makes their norms equal and products of such vectors are what links.
"""

from __future__ import annotations

import numpy as np

#: Neighbours on upper layers (twice as many on the lowest), beam while building, beam while searching.
LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 64, 384
#: Beam of a search on upper layers, and how many of what it finds start the next layer.
UPPER_BEAM, STARTS = 48, 16
_BATCH = 384
#: Numbers of points that are copied at once.
COPIED = 1 << 24


def directions(x: np.ndarray) -> np.ndarray:
    """Unit vectors in single precision; scaled by the largest component first, so that no square overflows."""
    x = x / np.maximum(np.abs(x).max(1, initial=0), np.finfo(float).tiny)[:, None]
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


#: Mean cosine of a graph's vectors from which on they are linked by products.
SHARED = 0.2
#: Beams that are tried until a sample's recall reaches ENOUGH, and points of the sample.
BEAMS, ENOUGH, SAMPLE = (SEARCH_BEAM, 2 * SEARCH_BEAM, 4 * SEARCH_BEAM, 8 * SEARCH_BEAM), 0.98, 128


def linked(x: np.ndarray) -> np.ndarray:
    """The unit vectors by which points are linked: directions, or, where they share one, the points with a coordinate that makes norms equal."""
    d = directions(x)
    if np.square(d.mean(0, dtype=float)).sum() < SHARED:
        return d
    x = x / np.abs(x).max()
    squares = (x * x).sum(1)
    most = squares.max()
    return np.concatenate([x / np.sqrt(most), np.sqrt(np.maximum(0, 1 - squares / most))[:, None]], 1).astype(np.float32)


def beam_for(x: np.ndarray, graph: dict[str, np.ndarray], k: int) -> int:
    """The least of BEAMS with which a sample of the points finds ENOUGH of its k nearest, which are known from comparing it with all points."""
    own = np.unique(np.linspace(0, len(x) - 1, SAMPLE).astype(int))
    asked, points = directions(x[own]), (x / np.abs(x).max()).astype(np.float32)
    k = min(k, len(x))
    want = np.argpartition(-(asked @ points.T), k - 1, axis=1)[:, :k]
    for beam in BEAMS:
        found = search(points, graph, asked, k, beam)[0]
        if np.mean([len(np.intersect1d(a, b)) / k for a, b in zip(found, want, strict=True)]) >= ENOUGH:
            break
    return beam


def _products(points: np.ndarray, ids: np.ndarray, with_: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Products of ``points[ids]`` with ``with_[own]``, so many at once that the copies stay small, however wide the points are."""
    out, step = np.empty(len(ids), np.float32), max(1, COPIED // points.shape[1])
    for i in range(0, len(ids), step):
        out[i : i + step] = np.einsum("ed,ed->e", points[ids[i : i + step]], with_[own[i : i + step]])
    return out


def beam_search(points: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes found for each query (-1 where fewer) and their products, best first.

    Queries walk side by side, each from its own ``start`` nodes (a row of different ids, -1 for none, the first one real).
    """
    q, wide = len(queries), 4
    ids, near = np.full((q, beam), -1, np.int32), np.full((q, beam), -np.inf, np.float32)
    opened = np.ones((q, beam), bool)
    seen = np.zeros((q, len(points)), bool)
    rows = np.arange(q)
    r, c = np.nonzero(start >= 0)
    n = start.shape[1]
    ids[:, :n] = start
    near[r, c] = _products(points, start[r, c], queries, r)
    opened[:, :n] = start < 0
    seen[r, start[r, c]] = True
    best = np.argsort(-near[:, :n], axis=1, kind="stable")
    for x in (ids, near, opened):
        x[:, :n] = np.take_along_axis(x[:, :n], best, 1)
    while len(rows):
        # The best nodes not yet opened, a few at once.
        order = np.argsort(opened[rows], axis=1, kind="stable")[:, :wide]
        fresh = ~np.take_along_axis(opened[rows], order, 1)
        at = np.take_along_axis(ids[rows], order, 1)
        opened[rows[:, None], order] = True
        new = np.where((fresh & (at >= 0))[:, :, None], links[at], -1).reshape(len(rows), -1)
        ok = (new >= 0) & ~seen[rows[:, None], new]
        new = np.where(ok, new, -1)
        # The same node may come from two of those opened.
        new = -np.sort(-new, axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        r, c = np.nonzero(new >= 0)
        seen[rows[r], new[r, c]] = True
        found = np.full(new.shape, -np.inf, np.float32)
        found[r, c] = _products(points, new[r, c], queries, rows[r])
        all_near, all_ids = np.concatenate([near[rows], found], 1), np.concatenate([ids[rows], new], 1)
        all_open = np.concatenate([opened[rows], new < 0], 1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        near[rows], ids[rows], opened[rows] = (np.take_along_axis(x, best, 1) for x in (all_near, all_ids, all_open))
        rows = rows[~opened[rows].all(1)]
    return ids, near


def _spread(points: np.ndarray, ids: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates, best first, those nearer to the row's point than to any taken before; filled up with the best others."""
    step = max(1, COPIED // max(1, ids.shape[1] * points.shape[1]))
    if len(ids) > step:
        return np.concatenate([_spread(points, ids[i : i + step], near[i : i + step], most) for i in range(0, len(ids), step)])
    own = points[np.maximum(ids, 0)]
    among = np.einsum("qid,qjd->qij", own, own)
    taken = np.zeros(ids.shape, bool)
    for j in range(ids.shape[1]):
        closest = np.where(taken, among[:, j], -np.inf).max(1)
        taken[:, j] = (ids[:, j] >= 0) & (near[:, j] > closest) & (taken.sum(1) < most)
    rank = np.where(ids < 0, 2, np.where(taken, 0, 1))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(ids, order, 1)


def _connect(points: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Link ``new`` to ``chosen`` and back; a full list keeps a spread choice of the nearest, so that links out of tight groups stay."""
    most = links.shape[1]
    links[new, : chosen.shape[1]] = chosen
    r, c = np.nonzero(chosen >= 0)
    to, back = chosen[r, c], new[r]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, first, count = np.unique(to, return_index=True, return_counts=True)
    extra = np.full((len(nodes), int(count.max(initial=0))), -1, np.int32)
    extra[np.repeat(np.arange(len(nodes)), count), np.arange(len(to)) - np.repeat(first, count)] = back
    all_ids = np.concatenate([links[nodes], extra], 1)
    near = np.full(all_ids.shape, -np.inf, np.float32)
    r, c = np.nonzero(all_ids >= 0)
    near[r, c] = _products(points, all_ids[r, c], points, nodes[r])
    order = np.argsort(-near, axis=1, kind="stable")[:, : 2 * most]
    ids, near = np.take_along_axis(all_ids, order, 1), np.take_along_axis(near, order, 1)
    full = (ids >= 0).sum(1) > most
    links[nodes[~full]] = ids[~full, :most]
    for rows in np.array_split(np.flatnonzero(full), -(-int(full.sum()) // 512) or 1):
        links[nodes[rows]] = _spread(points, ids[rows], near[rows], most)


def build(points: np.ndarray, seed: int = 6) -> dict[str, np.ndarray]:
    """The graph of ``points`` (directions): links of each layer, lowest first, and the entry node."""
    n = len(points)
    rng = np.random.default_rng(seed)
    height = np.minimum((-np.log(rng.random(n)) / np.log(LINKS)).astype(int), 6)
    height[0] = max(height.max(initial=0), 0)
    layers = [np.full((n, LINKS * (2 if k == 0 else 1)), -1, np.int32) for k in range(int(height.max(initial=0)) + 1)]
    done = 1
    while done < n:
        new = np.arange(done, min(n, done + min(_BATCH, done)))
        start = np.zeros((len(new), 1), np.int64)
        for k in range(len(layers) - 1, -1, -1):
            here = height[new] >= k
            beam = BUILD_BEAM if k == 0 else UPPER_BEAM
            ids, near = beam_search(points, layers[k], points[new], start, beam)
            start = ids[:, :STARTS].astype(np.int64)
            if not here.any():
                continue
            own, rows = new[here], points[new[here]]
            among = rows @ rows.T
            np.fill_diagonal(among, -np.inf)
            k_own = min(LINKS, len(own))
            top = np.argpartition(-among, k_own - 1, axis=1)[:, :k_own]
            ids = np.concatenate([ids[here], np.where(np.take_along_axis(among, top, 1) > -np.inf, own[top], -1).astype(np.int32)], 1)
            near = np.concatenate([near[here], np.take_along_axis(among, top, 1)], 1)
            order = np.argsort(-near, axis=1, kind="stable")[:, : beam // 2 + 8]
            ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
            _connect(points, layers[k], own, _spread(points, ids, near, LINKS))
        done = int(new[-1]) + 1
    return {"entry": np.array([0], np.int32)} | {f"layer{k}": x for k, x in enumerate(layers)}


def search(points: np.ndarray, graph: dict[str, np.ndarray], queries: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nodes of largest inner product with each query, best first (-1 where fewer), and products in single precision."""
    out_ids, out_near = [], []
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        start = np.full((len(part), 1), graph["entry"][0], np.int64)
        for layer in range(len(graph) - 2, 0, -1):
            start = beam_search(points, graph[f"layer{layer}"], part, start, UPPER_BEAM)[0][:, :STARTS].astype(np.int64)
        ids, near = beam_search(points, graph["layer0"], part, start, max(beam, k))
        out_ids.append(ids[:, :k])
        out_near.append(near[:, :k])
    if not out_ids:
        return np.zeros((0, k), np.int32), np.zeros((0, k), np.float32)
    return np.concatenate(out_ids), np.concatenate(out_near)
