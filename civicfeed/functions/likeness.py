"""Likeness of short texts (K29), 0 to 100, from the insertions and deletions that lead from one to the other.

Small helpers for Arrow functions: what a pair of words gives is kept, since words recur in all queries.
"""

from __future__ import annotations

from functools import lru_cache


@lru_cache(maxsize=20_000)
def _places(a: str) -> dict[str, int]:
    """For each character of a text, a bit for each place of it."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    return places


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for each character of ``a``."""
    get = _places(a).get
    whole = row = (1 << len(a)) - 1
    for c in b:
        p = get(c)
        if p is not None:
            u = row & p
            row = (row + u) | (row - u)
    return (~row & whole).bit_count()


def indel_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    return 200.0 * common_length(a, b) / (len(a) + len(b))


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter text to a window of its length in the longer one; windows may stick out at the ends.

    A best of no more than ``least`` is given as ``least``. Letters in common, whatever their order, bound a window's ratio;
    they are counted along the windows, and only windows whose bound is above the best so far are compared.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return max(least, 100.0 if not b else 0.0)
    if a in b:
        return 100.0
    n, best = len(a), least
    spare: dict[str, int] = {}
    for c in a:
        spare[c] = spare.get(c, 0) + 1
    common = 0
    for end in range(1, len(b) + n):
        if end <= len(b):
            c = b[end - 1]
            k = spare.get(c)
            if k is not None:
                spare[c] = k - 1
                common += k > 0
        begin = end - n
        if begin > 0:
            c = b[begin - 1]
            k = spare.get(c)
            if k is not None:
                spare[c] = k + 1
                common -= k >= 0
        size = n + min(end, len(b)) - max(begin, 0)
        if 200.0 * common > best * size:
            best = max(best, indel_ratio(a, b[max(0, begin) : end]))
    return best


def _sorted(words: set[str] | list[str]) -> str:
    return " ".join(sorted(words))


def token_set_ratio(a: str, b: str) -> float:
    """Likeness by sets of words: the words in common against either text's, and the rests against each other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = x & y, _sorted(x - y), _sorted(y - x)
    if both and (not only_a or not only_b):
        return 100.0
    shared = len(_sorted(both))
    gap = int(bool(shared))
    with_a, with_b = shared + gap + len(only_a), shared + gap + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * common_length(only_a, only_b)
    best = 100.0 * (1 - apart / (with_a + with_b))
    if both:
        best = max(best, *(100.0 * (1 - (gap + len(only)) / (shared + whole)) for only, whole in ((only_a, with_a), (only_b, with_b))))
    return best


def partial_token_ratio(a: str, b: str, least: float = 0.0) -> float:
    """100 for a word in common; else the best partial ratio of the sorted words, repeated ones counted or not."""
    x, y = a.split(), b.split()
    if set(x) & set(y):
        return 100.0
    best = partial_ratio(_sorted(x), _sorted(y), least)
    return best if len(set(x)) == len(x) and len(set(y)) == len(y) else partial_ratio(_sorted(set(x)), _sorted(set(y)), best)


def weighted_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best of several ratios; those by words count a little less, and partial ones where lengths differ much.

    A best of no more than ``least`` is given as ``least``; ratios that cannot be above the best so far are not worked out.
    """
    if not a or not b:
        return max(least, 0.0)
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = max(least, indel_ratio(a, b))
    if longer < 1.5:
        return max(best, 0.95 * indel_ratio(_sorted(a.split()), _sorted(b.split())), 0.95 * token_set_ratio(a, b))
    scale = 0.9 if longer <= 8 else 0.6
    if best < 95 * scale:
        by_words = partial_token_ratio(a, b, best / (0.95 * scale))
        best = max(best, 0.95 * scale * by_words) if by_words > best / (0.95 * scale) else best
    if best < 100 * scale:
        part = partial_ratio(a, b, best / scale)
        best = max(best, scale * part) if part > best / scale else best
    return best
