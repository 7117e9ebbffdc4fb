"""Plain-Python versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall


def shingle_set(text, k):
    w = WORDS((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, percent=80):
    """Component by row number, from all pairs."""
    sets = [shingle_set(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = defaultdict(lambda: None)
    for i, (d, _) in enumerate(rows):
        low[root(i)] = d if low[root(i)] is None else low[root(i)] if d is None else min(low[root(i)], d)
    return [(d, len(sets[i]), low[root(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)]


def exact(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[(t or "").translate(LOWER)].append(d)
    return sorted((d, max(g), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)


def uses(rows, weights=(3, 1, 2)):
    """Times that the mix uses each row (doc_id, source, text), by row number."""
    size = [len(WORDS(t or "")) for _, _, t in rows]
    names = sorted({s for _, s, _ in rows if s is not None}) + ([None] if any(s is None for _, s, _ in rows) else [])
    own = {s: sum(n for n, r in zip(size, rows) if r[1] == s) for s in names}
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(size), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = budget - sum(capped.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > 2 * own[s]]
        if not over:
            break
        capped |= {s: 2.0 * own[s] for s in over}
    target = share | capped
    out = [0] * len(rows)
    for s in names:
        order = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (hashlib.md5(str(rows[i][0]).encode()).hexdigest()[:15], rows[i][0], size[i]))
        before = 0
        for i in order:
            passes = int(target[s] // own[s]) if own[s] else 0
            last = max(0, min(size[i], int(target[s]) - passes * own[s] - before))
            out[i] = (passes + (last > 0)) if size[i] else 0
            before += size[i]
    return out, target


def use_positions(rows, slopes):
    """(training position, doc_id, row number) of every use, by bisecting each source's cumulative demand."""
    times, target = uses(rows)
    size = [len(WORDS(t or "")) for _, _, t in rows]
    names = sorted(s for s in target if s is not None) + [s for s in target if s is None]
    out = []
    for place, s in enumerate(names):
        slope, before = slopes[place % 3], 0
        order = sorted((i for i, r in enumerate(rows) if r[1] == s), key=lambda i: (hashlib.md5(str(rows[i][0]).encode()).hexdigest()[:15], rows[i][0], size[i]))
        own = sum(size[j] for j in order)
        for i in order:
            for use in range(times[i]):
                words, lo, hi = before + use * own, 0.0, 1.0
                for _ in range(60):
                    mid = (lo + hi) / 2
                    lo, hi = (lo, mid) if target[s] * ((1 - slope) * mid + slope * mid * mid) > words else (mid, hi)
                out.append((hi, rows[i][0], i))
            before += size[i]
    return sorted(out)


def toxic_chain(texts, labels, most_features, least_z, folds, ridge):
    """Probabilities of ``texts`` by a chain of logistic regressions; ``labels`` has a row of 0/1 for each of the first texts.

    Features are strings, all matrices are dense, and folds go by the order of ``texts``.
    """

    def features(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        return {w[:k] + "*" for w in words for k in range(3, 7) if len(w) >= k} | words

    own = [features(t) for t in texts]

    def fitted(rows, earlier, y):
        counts = [Counter(f for i in rows for f in own[i] if y[i] == c) for c in (0, 1)]
        n = [sum(y[i] == c for i in rows) for c in (0, 1)]
        told = []
        for f in counts[0].keys() | counts[1].keys():
            b, a = counts[0][f], counts[1][f]
            if a + b >= 3:
                share = (a + b + 1) / (len(rows) + 2)
                told.append((-abs(a / n[1] - b / n[0]) / (share * (1 - share) * (1 / n[1] + 1 / n[0])) ** 0.5, f))
        names = [f for z, f in sorted(told)[:most_features] if -z >= least_z]

        def x(i, before):
            return [float(f in own[i]) for f in names] + before + [1.0]

        m, t = np.array([x(i, earlier[i]) for i in rows]), np.array([float(y[i]) for i in rows])
        w, penalty = np.zeros(m.shape[1]), np.full(m.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(60):
            p = 1 / (1 + np.exp(-m @ w))
            w = w - np.linalg.solve(m.T @ np.diag(p * (1 - p)) @ m + np.diag(penalty), m.T @ (p - t) + penalty * w)
        return lambda i, before: float(1 / (1 + np.exp(-np.dot(x(i, before), w))))

    n = len(labels)
    trained, scored = [[] for _ in labels], [[] for _ in texts]  # earlier probabilities: out-of-fold, and of the whole models
    for k in range(len(labels[0])):
        y = [r[k] for r in labels]
        whole = fitted(range(n), trained, y)
        parts = [fitted([i for i in range(n) if i % folds != f], trained, y) for f in range(folds)]
        trained = [before + [parts[i % folds](i, before)] for i, before in enumerate(trained)]
        scored = [before + [whole(i, before)] for i, before in enumerate(scored)]
    return [p if f else [0.0] * len(p) for p, f in zip(scored, own)]


def repeat_words(words):
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(three)
    return len({i + j for i, t in enumerate(three) if n[t] > 1 for j in range(3)})
