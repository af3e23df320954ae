"""Plain Python versions of what the operators return."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words(lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def near_duplicate_components(docs, k, percent):
    """docs: (id, text). Returns id -> (size, component)."""
    sets = [shingles(t, k) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, own in enumerate(sets):
        counts = {}
        for s in own:
            for j in index.setdefault(s, []):
                counts[j] = counts.get(j, 0) + 1
            index[s].append(i)
        for j, both in counts.items():
            if 100 * both >= percent * (len(own) + len(sets[j]) - both):
                root[find(i)] = find(j)
    names = {}
    for i, (d, _) in enumerate(docs):
        names[find(i)] = min(d, names.get(find(i), d))
    return {d: (len(sets[i]), names[find(i)]) for i, (d, _) in enumerate(docs)}
