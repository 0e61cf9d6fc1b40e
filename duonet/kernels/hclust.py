"""Complete-linkage clustering cut at a height."""

from __future__ import annotations

import numpy as np


def complete_linkage(dist: np.ndarray, height: float) -> np.ndarray:
    """Labels 0.. in order of first appearance; clusters merge while their largest distance is at most height."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    members: list[list[int]] = [[i] for i in range(n)]
    alive = np.ones(n, bool)
    while alive.sum() > 1:
        k = int(np.argmin(d))
        i, j = sorted(divmod(k, n))
        if not d[i, j] <= height:
            break
        members[i] += members[j]
        row = np.maximum(d[i], d[j])
        row[i] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
    labels = np.empty(n, int)
    for k, group in enumerate(sorted((m for m, a in zip(members, alive, strict=True) if a), key=min)):
        labels[group] = k
    return labels
