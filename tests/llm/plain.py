"""Plain Python versions of the operators, for comparison on small tables."""

from __future__ import annotations

from hashlib import sha256


def ordered(docs):
    return sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))


def repeated(symbols_of, docs, window):
    """Per (id, text): which symbols lie in a window that also starts at an earlier place; equal ids are one place."""
    first = {}
    for i, t in ordered(docs):
        s = symbols_of(t)
        for k in range(len(s) - window + 1):
            w = tuple(s[k : k + window])
            place = (i is not None, i or 0, k)
            first[w] = min(first.get(w, place), place)
    out = []
    for i, t in docs:
        s = symbols_of(t)
        gone = [False] * len(s)
        for k in range(len(s) - window + 1):
            if first[tuple(s[k : k + window])] < (i is not None, i or 0, k):
                gone[k : k + window] = [True] * window
        out.append((i, s, gone))
    return out


def words(t):
    return (t or "").encode().split()


def words_digest(docs, window=20):
    return [
        (i, len(s), sum(g), sha256(b" ".join(x for x, y in zip(s, g) if not y)).hexdigest()) for i, s, g in repeated(words, docs, window)
    ]


def bytes_digest(docs, window=100):
    out = []
    for i, s, g in repeated(lambda t: (t or "").encode(), docs, window):
        spans = sum(y and not (k and g[k - 1]) for k, y in enumerate(g))
        out.append((i, len(s), sum(g), spans, sha256(bytes(x for x, y in zip(s, g) if not y)).hexdigest()))
    return out


def shingles(t, width):
    w = words((t or ""))
    w = [x.lower() for x in w]
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)])


def groups(docs, width, percent):
    """(id, set size, smallest id reachable); ids are unique."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}
