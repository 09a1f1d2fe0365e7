"""Word hashes and word n-grams of many texts at once, in numpy.

Words are runs of bytes other than ASCII white space, which are the runs ``[^\\x20\\x09-\\x0D]+`` of
the text's characters. Texts are handled in pieces of about ``PIECE`` bytes, so the memory of a
task does not depend on its number of rows; a very long text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1 << 12)


def pieces(texts: Iterable[str | None], size: int = PIECE) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as bytes, each with the number of its first text; null texts are empty."""
    first, run, held = 0, [], 0
    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
        if run and held + len(data) > size:
            yield first, run
            first, run, held = i, [], 0
        run.append(data)
        held += len(data)
    if run:
        yield first, run


def word_hashes(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a run of texts, and where each text's words begin (one more entry than texts)."""
    global _POWERS
    data = np.frombuffer(b" ".join([b"", *run, b""]), dtype=np.uint8)
    space = SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    at = np.cumsum([1] + [len(x) + 1 for x in run])
    offsets = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), offsets
    lengths = ends - starts
    if lengths.max() >= len(_POWERS):
        _POWERS = _powers(int(lengths.max()) + 1)
    inside = ~space
    inner = np.arange(len(data))[inside] - np.repeat(starts, lengths)
    terms = (data[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[inner]
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), offsets


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each position on; the last ``n`` - 1 positions have none."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    out = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        out = mix(out) + words[k : len(words) - n + 1 + k]
    return mix(out)


def text_grams(words: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The n-gram hashes of each text of a run, in order; a text of fewer words has one, of all its words."""
    grams = gram_hashes(words, n)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield grams[a : b - n + 1] if b - a >= n else gram_hashes(words[a:b], b - a) if b > a else grams[:0]
