"""Plain loops that several tests compare with."""


def brute_tiles(text, item, least):
    """Greedy tiling by its definition: the longest common run of free words, the earliest of equals, again and again."""
    free_t, free_i, at, out = [x >= 0 for x in text], [x >= 0 for x in item], {}, []
    for p, x in enumerate(text):
        at.setdefault(x, []).append(p)
    while True:
        best = None
        for q, x in enumerate(item):
            for p in at.get(x, ()):
                n = 0
                while p + n < len(text) and q + n < len(item) and free_t[p + n] and free_i[q + n] and text[p + n] == item[q + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (p, q, n)
        if best is None:
            return out
        p, q, n = best
        free_t[p : p + n], free_i[q : q + n] = [False] * n, [False] * n
        out.append(best)


def brute_links(texts, threshold=0.8, words=5):
    """The group of each text, where all pairs at or above the threshold are linked."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + words]) for k in range(max(len(w) - words + 1, 1))})
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    return group
