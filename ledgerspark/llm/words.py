"""Hashes of words of many texts at once, on their UTF-8 bytes."""

from __future__ import annotations

#: Fixed value: odd multiplier of word hashes.
MULTIPLIER = 0x9E3779B97F4A7C15


def mixed(x):
    """Bijective mixing of uint64 arrays."""
    import numpy as np

    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _constants():
    import numpy as np

    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    lower = np.arange(256, dtype=np.uint64)
    lower[65:91] += 32
    return space, mixed(lower + np.uint64(1))


def word_hashes(texts):
    """(hashes of all words in order, the text of each, number of words of each text).

    Words are parted by ASCII white space; A-Z count as a-z. All texts' bytes are
    worked on together: a word's hash is a sum of its bytes' codes times powers of
    an odd number (Horner's rule over places from the word's start), found from
    prefix sums."""
    import numpy as np

    space, codes = _constants()
    raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    text_end = np.cumsum([len(r) + 1 for r in raw])
    with np.errstate(over="ignore"):
        gap = space[data]
        inside = ~gap
        start = np.flatnonzero(inside & np.r_[True, gap[:-1]])
        end = np.flatnonzero(gap & np.r_[False, inside[:-1]])
        owner = np.searchsorted(text_end, start, side="right")
        place = np.zeros(len(data), np.int64)
        if len(start):
            place[start[0] :] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.r_[start, len(data)]))
        longest = int((end - start).max()) if len(start) else 0
        power = np.cumprod(np.r_[np.uint64(1), np.full(longest, MULTIPLIER, np.uint64)], dtype=np.uint64)
        value = codes[data]
        value[gap] = 0
        value *= power[np.minimum(place, longest)]
        sums = np.r_[np.uint64(0), np.cumsum(value, dtype=np.uint64)]
        word = mixed((sums[end] - sums[start]) ^ (end - start).astype(np.uint64))
    return word, owner, np.bincount(owner, minlength=len(raw))
