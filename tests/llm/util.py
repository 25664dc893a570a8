"""Small corpora and brute-force versions for the tests of the corpus operators."""

import random
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 1, size: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages, nulls, empty and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() + rng.choice(["", "", "", ".\n", ","]) for _ in range(n))
    passage, lines = text(40), "shared line one\nshared line two\nshared line three\nshared line four"
    rows: list[tuple] = []
    for i in range(size):
        kind = i % 6
        t = text(rng.randint(1, 90))
        if kind == 1 and rows:
            t = rng.choice(rows)[1]
        elif kind == 2:
            t = t + " " + passage + " " + text(10)
        elif kind == 3 and rows and rng.choice(rows)[1]:
            words = (rows[0][1] or "x").split(" ")
            words[rng.randrange(len(words))] = "edited"
            t = " ".join(words)
        elif kind == 4:
            t = t + "\n" + lines + "\n" + text(20)
        rows.append((i, t, "en", f"src{i % 4}", len(t or "")))
    odd = ["", None, " ", "\n\n\n", "a", "a a a a a a a a a a a a a a a a a a", "é日本 \x00 ✂ x" * 9, "word " * 3000, passage]
    return rows + [(100 + i, t, None if i % 2 else "xx", None, None) for i, t in enumerate(odd)]


def words(text):
    return (text or "").encode().split()


def covered(starts, size, length):
    flags = [False] * length
    for s in starts:
        for i in range(s, s + size):
            flags[i] = True
    return flags


def jaccard_classes(rows, n=5, threshold=0.8):
    """doc_id -> (class, links) by all pairs."""
    sets = {}
    for d, t, *_ in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent, links = {d: d for d in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (find(d), links[d]) for d in ids}
