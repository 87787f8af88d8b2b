"""Hashed character n-grams of whole texts, as presence rows."""

from __future__ import annotations

import numpy as np

ODD = np.uint64(0x9E3779B97F4A7C15)  # fixed value: 2**64 over the golden ratio
BLANK = ord(" ")


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def letter_table() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def letters_only(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-case letters, each run of anything else as one blank; blank at both ends."""
    points = code_points(text.lower())
    points = np.where(letters[points], points, BLANK)
    points = np.concatenate(([BLANK], points, [BLANK]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != BLANK) | (points[:-1] != BLANK)
    return points[keep].astype(np.uint64)


def grams(points: np.ndarray, sizes: range, bits: int) -> list[np.ndarray]:
    """Slots of all n-grams of the given sizes, one array per size."""
    out, code = [], np.zeros(len(points) + 1, np.uint64)
    for n in range(1, sizes.stop):
        if len(points) < n:
            break
        code = code[: len(points) - n + 1] * ODD + points[n - 1 :] + np.uint64(n)
        if n in sizes:
            mixed = (code ^ (code >> np.uint64(29))) * ODD
            out.append((mixed >> np.uint64(64 - bits)).astype(np.int64))
    return out


def presence(points: np.ndarray, sizes: range, bits: int) -> np.ndarray:
    """One boolean per slot: whether any n-gram falls into it."""
    row = np.zeros(1 << bits, bool)
    for slots in grams(points, sizes, bits):
        row[slots] = True
    return row
