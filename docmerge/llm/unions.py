"""Union-find over arrays, for the groups inside one task."""

from __future__ import annotations

import numpy as np


def find(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    roots = parent[nodes]
    while True:
        up = parent[roots]
        if np.array_equal(up, roots):
            return roots
        roots = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of every pair; the root of a set is its smallest place."""
    while len(a):
        a, b = find(parent, a), find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
