"""Component labels of a few nodes held in arrays."""

from __future__ import annotations

import numpy as np


def labels_of(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Component labels (smallest index) of ``n`` local nodes after adding links ``i - j``."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if (new[i] == new[j]).all():
            return new
        label = new
