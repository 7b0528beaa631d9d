"""Plain versions of the operators for small inputs."""

import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(rows, k):
    """(doc_id, n_words, n_removed, kept_sha256) of rows (doc_id, text)."""
    first = {}
    for i, text in rows:
        words = SPACED.findall(text or "")
        for a in range(len(words) - k + 1) if i is not None else ():
            w = tuple(words[a : a + k])
            first[w] = min(first.get(w, i), i)
    out = []
    for i, text in rows:
        words = SPACED.findall(text or "")
        gone = set()
        for a in range(len(words) - k + 1) if i is not None else ():
            if first[tuple(words[a : a + k])] < i:
                gone.update(range(a, a + k))
        kept = [w for n, w in enumerate(words) if n not in gone]
        out.append((i, len(words), len(gone), sha(" ".join(kept))))
    return sorted(out, key=repr)


def shingles(text, size=5):
    words = SPACED.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[a : a + size]) for a in range(max(1, len(words) - size + 1)))


def near_duplicates(rows):
    """(doc_id, n_shingles, component_id) of rows (doc_id, text)."""
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, (a, x) in enumerate(sets):
        for b, y in sets[:n]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((top(a), top(b)))
                parent[high] = low
    return sorted(((i, len(s), None if i is None else top(i)) for i, s in sets), key=repr)


def contamination(rows, items, k=10):
    """(doc_id, n_words, n_hit, item ids) of rows (doc_id, text)."""
    windows = {}
    for i, text in items:
        words = ALNUM.findall((text or "").translate(LOWER))
        for a in range(max(1, len(words) - k + 1)) if words else ():
            windows.setdefault(tuple(words[a : a + k]), set()).add(i)
    out = []
    for i, text in rows:
        words = ALNUM.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(w) for w in windows}:
            for a in range(len(words) - size + 1):
                if (w := tuple(words[a : a + size])) in windows:
                    hit.update(range(a, a + size))
                    found |= windows[w]
        out.append((i, len(words), len(hit), tuple(sorted(str(x) for x in found if x is not None))))
    return sorted(out, key=repr)
