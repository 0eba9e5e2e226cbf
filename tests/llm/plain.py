"""Plain versions of line dedup and near-dedup."""

from __future__ import annotations


def stretches(lines, least):
    """(start, end) of the shortest stretches of ``least`` words from each line on, and up to it."""
    full = [(i, len(x.split())) for i, x in enumerate(lines) if x.split()]
    out = set()
    for a in range(len(full)):
        for step in (1, -1):
            total, b = 0, a
            while 0 <= b < len(full):
                total += full[b][1]
                if total >= least:
                    out.add((full[min(a, b)][0], full[max(a, b)][0]))
                    break
                b += step
    return out


def brute_lines(texts, least):
    seen, out = {}, []
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        for a, b in stretches(lines, least):
            key = tuple(x for x in lines[a : b + 1] if x.split())
            seen[key] = min(seen.get(key, (i, a)), (i, a))
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        gone = {k for a, b in stretches(lines, least) if seen[tuple(x for x in lines[a : b + 1] if x.split())] < (i, a) for k in range(a, b + 1)}
        out.append(None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def brute_groups(texts, words, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts.items():
        w = (t or "").translate(lower).encode().split()
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    up = {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in texts if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in texts}
