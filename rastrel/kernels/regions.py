"""Connected components and absorption of specks on one label grid."""

from __future__ import annotations

from collections import defaultdict

import numpy as np


def _roots(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hook the larger root on the smaller for all edges at once, then jump, until each edge agrees."""
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        np.minimum.at(up, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
        while True:
            new = up[up]
            if (new == up).all():
                break
            up = new


#: Grids of at most so many pixels are walked in plain Python, which takes less than a few array calls.
FEW = 1024


def _flooded(grid: np.ndarray) -> np.ndarray:
    """components() of a small grid, region after region."""
    (h, w), label = grid.shape, grid.ravel().tolist()
    found, n = [-1] * len(label), 0
    for first in range(len(label)):
        if found[first] < 0:
            found[first], own, waiting = n, label[first], [first]
            while waiting:
                i = waiting.pop()
                x = i % w
                for j, there in ((i - w, i >= w), (i + w, i + w < h * w), (i - 1, x > 0), (i + 1, x < w - 1)):
                    if there and found[j] < 0 and label[j] == own:
                        found[j] = n
                        waiting.append(j)
            n += 1
    return np.array(found, np.int32).reshape(grid.shape)


def components(grid: np.ndarray) -> np.ndarray:
    """Region numbers of 4-connected equal labels, in the raster order of first pixels."""
    if grid.size <= FEW:
        return _flooded(grid)
    n = np.arange(grid.size).reshape(grid.shape)
    right, below = grid[:, :-1] == grid[:, 1:], grid[:-1] == grid[1:]
    a = np.concatenate([n[:, :-1][right], n[:-1][below]])
    b = np.concatenate([n[:, 1:][right], n[1:][below]])
    up = _roots(np.arange(grid.size), a, b)
    return np.unique(up, return_inverse=True)[1].reshape(grid.shape).astype(np.int32)


def components_of_many(values: np.ndarray, sizes: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """components() of several grids that lie one after the other: those of one width are numbered as one tall grid, then each from 0."""
    out, ends = np.empty(len(values), np.int32), np.cumsum(sizes)
    for width in np.unique(widths):
        own = np.flatnonzero(widths == width)
        at = np.arange(sizes[own].sum()) + np.repeat(ends[own] - np.cumsum(sizes[own]), sizes[own])
        label = values[at].astype(np.int64)
        image = np.repeat(np.arange(len(own)), sizes[own])
        label = (label - label.min()) + image * (label.max() - label.min() + 1)  # no two images share one
        regions = components(label.reshape(-1, width)).ravel()
        firsts = regions[np.cumsum(sizes[own]) - sizes[own]]
        out[at] = regions - np.repeat(firsts, sizes[own])
    return out


def borders(regions: np.ndarray) -> dict[int, dict[int, int]]:
    """Unit edges between regions, in both directions."""
    if regions.size <= FEW:
        near: dict[int, dict[int, int]] = defaultdict(dict)
        rows = regions.tolist()
        for here, there in ((r, r[1:]) for r in rows):
            for a, b in zip(here, there):
                if a != b:
                    near[a][b] = near[b][a] = near[a].get(b, 0) + 1
        for here, there in zip(rows, rows[1:]):
            for a, b in zip(here, there):
                if a != b:
                    near[a][b] = near[b][a] = near[a].get(b, 0) + 1
        return near
    p = np.concatenate([regions[:, :-1].ravel(), regions[:-1].ravel()])
    q = np.concatenate([regions[:, 1:].ravel(), regions[1:].ravel()])
    apart = p != q
    pairs, counts = np.unique(np.stack([np.minimum(p, q)[apart], np.maximum(p, q)[apart]]), axis=1, return_counts=True)
    out: dict[int, dict[int, int]] = defaultdict(dict)
    for a, b, c in zip(*pairs.tolist(), counts.tolist()):
        out[a][b] = out[b][a] = c
    return out


def _despeckled_once(grid: np.ndarray, min_area: int) -> np.ndarray | None:
    """A round of despeckle() on a small grid; None if it changes nothing."""
    regions = components(grid)
    flat, cells = regions.ravel().tolist(), grid.ravel().tolist()
    areas, label = [0] * (max(flat) + 1), {}
    for r, own in zip(flat, cells):
        areas[r] += 1
        label[r] = own
    small = sorted((n, r) for r, n in enumerate(areas) if n < min_area)
    if not small:
        return None
    before, near = dict(label), borders(regions)
    for _, r in small:
        if near[r]:
            label[r] = label[min(near[r], key=lambda q: (-near[r][q], -areas[q], q))]  # noqa: B023
    if label == before:
        return None
    return np.array([label[r] for r in flat], grid.dtype).reshape(grid.shape)


def despeckle(grid: np.ndarray, min_area: int, rounds: int = 3) -> np.ndarray:
    """In each round, small regions take their best neighbour's label as it then is: longest border, largest area, first."""
    for _ in range(rounds if min_area > 0 else 0):
        if grid.size <= FEW:
            new = _despeckled_once(grid, min_area)
            if new is None:
                break
            grid = new
            continue
        regions = components(grid)
        flat = regions.ravel()
        areas = np.bincount(flat)
        label = grid.ravel()[np.unique(flat, return_index=True)[1]].copy()
        before, near = label.copy(), borders(regions)
        for r in sorted(np.flatnonzero(areas < min_area).tolist(), key=lambda r: (areas[r], r)):
            if near[r]:
                label[r] = label[min(near[r], key=lambda q: (-near[r][q], -areas[q], q))]
        if (label == before).all():
            break
        grid = label[regions]
    return grid
