"""Vectorised union of labels, for component work inside one task."""

from __future__ import annotations

import numpy as np


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (a smallest member each) after linking members ``a[k]`` and ``b[k]``.

    ``labels`` is changed in place.
    """
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
