"""Brute-force versions that more than one test uses."""

import math
import re

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def brute_components(rows, percent=85):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = GAP.findall((t or "").translate(low))
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = {i: i for i in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    items = [(i, s) for i, ss in sets.items() if i is not None for s in ss if s]
    for k, (i, a) in enumerate(items):
        for j, b in items[k + 1 :]:
            if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                continue
            c = len(a & b)
            if 100 * c >= percent * (len(a) + len(b) - c):
                p, q = sorted((find(i), find(j)))
                up[q] = p
    return {i: (find(i) if i is not None else None) for i in sets}, sets


def brute_line_texts(docs):
    """Texts after the removal of later three-line windows; emptied ones go."""
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        lines = t.split("\n")
        at = [k for k, x in enumerate(lines) if GAP.search(x)]
        gone = set()
        for k in range(len(at) - 2):
            s = tuple(lines[j] for j in at[k : k + 3])
            if s in seen:
                gone.update(at[k : k + 3])
            seen.add(s)
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or GAP.search(text):
            out[i] = text
    return out


def brute_cut(docs, length):
    """Texts after the removal of words that later copies of windows cover; emptied ones go."""
    first = {}
    for i, t in docs.items():
        w = GAP.findall(t)
        for k in range(len(w) - length + 1):
            s = tuple(w[k : k + length])
            first[s] = min(first.get(s, math.inf), i)
    out = {}
    for i, t in docs.items():
        w = GAP.findall(t)
        gone = set()
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < i:
                gone.update(range(k, k + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        if not gone:
            out[i] = t
        elif kept:
            out[i] = " ".join(kept)
    return out
