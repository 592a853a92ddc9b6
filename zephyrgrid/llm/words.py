"""Words of many texts as numbers, in flat arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa


def flat_words(split: list[list[bytes]]) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """The distinct words, the place of each word among them, and where the words of each text begin and end."""
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in split], dtype=np.int64)])
    coded = pa.array([w for words in split for w in words], pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), bounds


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key as its place among the distinct keys, and these."""
    return pd.factorize(keys)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of each word."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
