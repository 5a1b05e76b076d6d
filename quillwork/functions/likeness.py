"""Whether two texts are alike by difflib's ratio, decided as difflib would, in far less time on long or unlike texts: by bounds first, and
where they do not decide, by the same blocks, found with hashes."""

from __future__ import annotations

import difflib
from collections import Counter

import numpy as np

#: Pairs of places up to which difflib finds a piece's blocks sooner than hashes.
SMALL = 40_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_DIGIT = 30


def common_subsequence(a: str, b: str) -> int:
    """Letters of the longest common subsequence, all places of one text at once in the bits of a number."""
    places: dict[str, int] = {}
    for letter in set(a):
        places[letter] = 0
    bits = {letter: bytearray(len(a) // 8 + 1) for letter in places} if len(a) > 2000 else None
    if bits is None:
        for i, letter in enumerate(a):
            places[letter] |= 1 << i
    else:
        for i, letter in enumerate(a):
            bits[letter][i >> 3] |= 1 << (i & 7)
        places = {letter: int.from_bytes(x, "little") for letter, x in bits.items()}
    whole = (1 << len(a)) - 1
    left, held = whole, places.get
    for start in range(0, len(b), _DIGIT):
        for letter in b[start : start + _DIGIT]:
            m = held(letter)
            if m is not None:
                u = left & m
                left = (left + u) | (left - u)
        left &= whole
    return len(a) - left.bit_count()


def longest_block(a: str, b: str) -> tuple[int, int, int] | None:
    """(place in a, place in b, length) of the longest common block, the earliest in a and then in b, as difflib's find_longest_match without
    junk. None if hashes met by chance."""
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) for s in (a, b))
    power, inverse = (np.cumprod(np.full(max(len(a), len(b)) + 1, base, np.uint64)) for base in (_BASE, _INVERSE))
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum((z + np.uint64(1)) * power[: len(z)])]) for z in (x, y)]

    def shared(k: int) -> np.ndarray:
        """Places of a whose k letters stand in b, by hash."""
        p, q = ((s[k:] - s[:-k]) * inverse[: len(s) - k] for s in sums)
        return np.flatnonzero(np.isin(p, q))

    low, high, best = 0, min(len(a), len(b)), np.zeros(0, np.int64)
    while low < high:
        k = (low + high + 1) // 2
        found = shared(k)
        if found.size:
            low, best = k, found
        else:
            high = k - 1
    for i in best.tolist():
        j = b.find(a[i : i + low])
        if j >= 0:
            return i, j, low
    return (0, 0, 0) if low == 0 else None


def alike(a: str, b: str, least: float) -> bool:
    """SequenceMatcher(None, a, b, autojunk=False).ratio() >= least."""
    size = len(a) + len(b)
    enough = lambda n: (2.0 * n / size if size else 1.0) >= least
    short = min(len(a), len(b))
    if not enough(short):
        return False
    if a in b or b in a:
        return True  # the shorter is the one block
    # blocks are a common subsequence, whose letters both texts hold
    if not enough(sum((Counter(a) & Counter(b)).values())) or not enough(common_subsequence(a, b)):
        return False
    done, open_, pieces = 0, short, [(a, b)]
    while pieces:
        if enough(done):
            return True
        if not enough(done + open_):
            return False
        p, q = pieces.pop()
        open_ -= min(len(p), len(q))
        if p in q or q in p:
            done += min(len(p), len(q))
            continue
        block = longest_block(p, q) if len(p) * len(q) > SMALL else None
        if block is None:
            done += sum(m.size for m in difflib.SequenceMatcher(None, p, q, autojunk=False).get_matching_blocks())
        elif block[2]:
            i, j, k = block
            done += k
            for piece in ((p[:i], q[:j]), (p[i + k :], q[j + k :])):
                if piece[0] and piece[1]:
                    pieces.append(piece)
                    open_ += min(map(len, piece))
    return enough(done)
