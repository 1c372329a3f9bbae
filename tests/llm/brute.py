"""Plain versions of the operators for small tables."""

import re
from collections import Counter, defaultdict

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def near(rows, percent=75, n=5):
    """Of rows (id, text): set size of each row and least id reachable by links; ids are nodes."""
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = {i: i for i, _ in rows if i is not None}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    index = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            index[x].append(k)
    for k, s in enumerate(sets):
        for j, common in Counter(j for x in s for j in index[x] if j > k).items():
            a, b = rows[k][0], rows[j][0]
            if None not in (a, b) and 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = sorted((find(a), find(b)))
                up[b] = a
    return [(i, len(s), None if i is None else find(i)) for (i, _), s in zip(rows, sets, strict=True)]


def cut(texts, n=35):
    """Of each text: its words, and which of them are covered by a window that also starts elsewhere."""
    split = [words(t) for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                gone.update(range(i, i + n))
        out.append((w, gone))
    return out


CASES = [
    (1, "one two three"),
    (1, "one two three"),
    (2, None),
    (None, "one two three"),
    (None, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (5, "ONE two\x0bthree"),
    (6, "alone"),
    (7, " ".join(f"w{i}" for i in range(100))),
    (8, " ".join(f"w{i}" for i in range(100)) + " tail"),
    (9, "W0 " + " ".join(f"w{i}" for i in range(1, 97))),
    (10, "x " * 4000 + "é\xa0é"),
    (11, " ".join(f"long{i % 977}" for i in range(20000))),
    (12, "the same id"),
    (12, " ".join(f"w{i}" for i in range(100))),
    (13, "\x1c sep \x85 arators　wide"),
]
