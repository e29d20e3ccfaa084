"""Plain Python versions of what the operators compute."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SP = r"[^\x20\x09-\x0D]+"


def words(t):
    return re.findall(SP, t or "")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    for k, (kind, p, n) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(p, t) if len(m[0]) >= n]
    out.sort()
    n = Counter(x[2] for x in out)
    listed = ",".join(f"{kind}:{s}:{e}" for s, _, kind, e in out)
    return n["assign"], n["access"], n["hex"], hashlib.sha256(listed.encode()).hexdigest(), listed


def base_scores(rows):
    """rows: (id, text) -> {id: (n_tokens, n_known, N, base)}"""
    c = Counter()
    for i, t in rows:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(words(low(t)) + ["\n"])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in rows:
        w = words(low(t)) + ["\n"]
        out[i] = len(w), sum(x in c for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
    return out


def shingles(t, width=5):
    w = words(low(t))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if w else set()


def jaccard_components(rows, percent=75):
    """rows: (id, text) -> {id: (n_shingles, component)}"""
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        met = Counter(o for g in s for o in where[g])
        for o, both in met.items():
            if 100 * both >= percent * (len(s) + len(sets[o][1]) - both):
                up[top(k)] = top(o)
        for g in s:
            where[g].append(k)
    least = {}
    for k, (i, _) in enumerate(sets):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return {i: (len(s), least.get(top(k)) if s else i) for k, (i, s) in enumerate(sets)}


def quality(t):
    t = t or ""
    w = words(t)
    lines = [x for x in t.split("\n") if re.search(SP, x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    hit = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit), failed


def licenses(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))
