"""Plain Python versions of the operators' definitions, for small inputs."""

import hashlib
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def low(t):
    return (t or "").translate(UPPER)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def repeats(texts, n=35):
    """op4: (n_words, n_removed, sha) of each text."""
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        out.append((len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def contamination(texts, items, n=13):
    """op5: (n_words, n_hit, n_items, sha, contaminated) of each text. items: (id, text)."""
    windows = {}
    for i, t in items:
        w = ALNUM.findall(low(t))
        k = min(len(w), n)
        for a in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + k]), set()).add(i)
    out = []
    for t in texts:
        w = ALNUM.findall(low(t))
        hit, ids = set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    ids |= windows[tuple(w[a : a + k])]
        own = sorted(str(i) for i in ids if i is not None)
        out.append((len(w), len(hit), len(own), sha(",".join(own)), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def shingles(t, k):
    w = WORD.findall(low(t))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near(rows, k):
    """op10: doc_id -> (n_shingles, component, kept), for rows (doc_id, text) with unique ids."""
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def judged(t, stop_words):
    """op3: whether the production rules keep a text."""
    t = t or ""
    w = WORD.findall(t)
    n = len(w)
    wins = Counter(tuple(w[j : j + 8]) for j in range(n - 7))
    rep = len({j + k for j in range(n - 7) if wins[tuple(w[j : j + 8])] > 1 for k in range(8)})
    lines = [x for x in t.split("\n") if WORD.search(x)]
    if n < 20 or 100 * rep > 30 * n:
        return False
    return (
        2 <= sum(map(len, w)) / n <= 15
        and len(re.findall(r"[#*$%&|<>]", t)) / n <= 0.1
        and (n < 50 or sum(x in stop_words for x in w) / n >= 0.01)
        and (len(lines) - len(set(lines))) / len(lines) <= 0.5
        and t.count("!!") / n <= 0.2
    )


def mixed(rows):
    """op7: how often each row, (doc_id, text, source), is taken."""
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    whole = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in sources}
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sources)}
    target, open_, left = {}, set(sources), 1.5 * sum(sizes)
    while open_:  # the excess of full sources is shared again until none is above
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2.0 * whole[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * whole[s] for s in full}
        left -= sum(2.0 * whole[s] for s in full)
        open_ -= full
    out = [0] * len(rows)
    for s in sources:
        epochs = math.floor(target[s] / whole[s]) if whole[s] else 0
        budget = target[s] - epochs * whole[s]
        keyed = []
        for i, (doc_id, t, source) in enumerate(rows):
            if source == s:
                n = sizes[i]
                digest = hashlib.md5(f"{'' if doc_id is None else doc_id}:{source or ''}:{n}".encode()).hexdigest()
                u = (int(digest[:12], 16) + 0.5) / 2**48
                good = min(1 - 10 * len(re.findall(r"[#*$%&|<>]", t)) / n, len(re.sub(r"[\x20\x09-\x0D]", "", t)) / n - 2, (15 - len(re.sub(r"[\x20\x09-\x0D]", "", t)) / n) / 5, 1.0) if n else 0
                keyed.append((-math.log(u) / max(0.25, good), doc_id, n, i))
        before = 0
        for _, _, n, i in sorted(keyed, key=lambda k: k[:1] + (k[1] is not None, k[1] or 0) + k[2:]):
            out[i] = (epochs + (before + n / 2 <= budget)) if n else 0
            before += n
    return out, target
