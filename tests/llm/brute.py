"""Brute-force versions of what the operators find, as plain Python."""

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(seed, count, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(count))


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def classes(texts, n=5, threshold=0.8):
    """Per text: the index of the first text of its class, and how many others are similar to it."""
    sets = [shingles(t, n) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    parent, links = list(range(len(texts))), [0] * len(texts)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j > i:
                    shared[j] += 1
        for j, k in shared.items():
            if k / (len(s) + len(sets[j]) - k) >= threshold - 1e-12:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))], links


def hits(text, items, window=13):
    """(item, first word, length) of every occurrence of an item's window."""
    w, found = words(text), []
    for item, item_text in items:
        v = words(item_text)
        size = min(window, len(v))
        wanted = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        found += [(item, i, size) for i in range(len(w) - size + 1) if size and tuple(w[i : i + size]) in wanted]
    return sorted(found, key=repr)
