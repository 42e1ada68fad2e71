"""Trees of indices, joined by arrays of links."""

from __future__ import annotations

import numpy as np


class Forest:
    """``root`` has the least index of the tree of each index."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        """Joins the trees of ``x[i]`` and ``y[i]`` for every i.  Links inside one tree cost a comparison each."""
        root = self.root
        while True:
            a, b = root[x], root[y]
            apart = a != b
            if not apart.any():
                return
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root[:] = root[root]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each index that is not the least of its tree, and the least one."""
        at = np.flatnonzero(self.root != np.arange(len(self.root)))
        return at, self.root[at]
