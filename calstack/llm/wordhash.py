"""Word boundaries and hashes of many texts at once, with numpy.

Words are runs of bytes other than space and 0x09-0x0D, as bytes.split() has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text hashed at a time; a longer text is one chunk of its own.
CHUNK = 1 << 19
#: Bytes of a word that are hashed as one part; a longer word is hashed from its parts.
REACH = 1 << 12

U = np.uint64


STEP = U(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finish)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * STEP)
WITHIN = powers(0xD1342543DE82EF95, REACH)
#: Odd bases of the two sequence hashes and their inverses modulo 2**64.
BASES = (0xF1357AEA2E62A9C5, 0xAF251AF3B0F025B5)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def boundaries(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and stop of each word in a buffer of bytes."""
    word = np.empty(len(buf) + 2, bool)
    word[0] = word[-1] = False
    np.logical_not((buf == 32) | ((buf >= 9) & (buf <= 13)), out=word[1:-1])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = stops - starts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    inside = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    value = BYTES[buf[np.repeat(starts, lengths) + inside]] * WITHIN[inside % REACH]
    if int(lengths.max()) > REACH:
        part = np.flatnonzero(inside % REACH == 0)
        number = inside[part] // REACH
        value = np.add.reduceat(value, part)
        # the first part as it is, later ones by their own hash and place
        value = np.where(number == 0, value, mix(value + STEP) * powers(BASES[1], int(number.max()) + 1)[number])
        first = np.flatnonzero(number == 0)
    return mix(np.add.reduceat(value, first) + lengths.astype(np.uint64) * STEP)


class Sequences:
    """Hashes of any run of consecutive words, from prefix sums."""

    def __init__(self, hashes: np.ndarray, which: int = 0) -> None:
        n = len(hashes)
        own = hashes if which == 0 else mix(hashes + U(0x632BE59BD9B4E019))
        self.inverse = powers(INVERSES[which], n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(own * powers(BASES[which], n), out=self.sums[1:])

    def runs(self, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        value = (self.sums[starts + lengths] - self.sums[starts]) * self.inverse[starts]
        return mix(value + np.asarray(lengths).astype(np.uint64) * STEP)


def chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts) of about CHUNK bytes each."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text)
        if held >= CHUNK:
            yield first, texts[first : i + 1]
            first, held = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of each text and the end) of a chunk."""
    buf = np.frombuffer(b"\n".join(texts), np.uint8)
    starts, stops = boundaries(buf)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return word_hashes(buf, starts, stops), np.searchsorted(starts, offsets)
