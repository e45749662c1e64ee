"""Terms of many texts at once, as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from sparktext.llm.words import LOWER, word_hashes

# Bytes of text whose terms are hashed together.
TOGETHER = 1 << 20


def term_bytes() -> np.ndarray:
    """Digits, letters and every byte of a character beyond ASCII."""
    inside = np.zeros(256, bool)
    for low, high in ((48, 58), (65, 91), (97, 123), (128, 256)):
        inside[low:high] = True
    return inside


INSIDE = term_bytes()


def batch_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms in order of text and place, number of terms before each text and in all).

    A term is a longest run of digits, letters and characters beyond ASCII, A-Z lower-cased. The texts
    lie side by side in one buffer; a term ends where its text does. A NULL text has none.
    """
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2] if len(texts) else None
    raw = LOWER[np.frombuffer(data, np.uint8)[at[0] : at[-1]]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = INSIDE[raw]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < len(raw))]  # between two texts
    begins[edge] |= inside[edge]
    stops[edge - 1] |= inside[edge - 1]
    starts = np.flatnonzero(begins)
    return word_hashes(raw, starts, np.flatnonzero(stops) + 1), np.searchsorted(starts, at)
