"""Brute-force answers that several tests share."""

import re


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def near_components(rows, k, percent):
    """Smallest id of each document's group of linked documents."""
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(t))
        sets.append((i, {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i in root}


def window_hits(text, items, size):
    """Whether a window of an item occurs in the text."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(t))
    w = cut(text)
    for item in items:
        v = cut(item)
        n = min(len(v), size)
        own = {tuple(v[i:i + n]) for i in range(len(v) - n + 1)} if v else set()
        if any(tuple(w[i:i + n]) in own for i in range(len(w) - n + 1)):
            return True
    return False
