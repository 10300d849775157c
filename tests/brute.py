"""Row-by-row reference results for small inputs, in plain Python."""

from __future__ import annotations

import math
from collections import Counter


def mutual_information(rows, a, y):
    n = len(rows)
    av, yv, both = Counter(r[a] for r in rows), Counter(r[y] for r in rows), Counter((r[a], r[y]) for r in rows)
    return sum(c / n * math.log2(c * n / (av[v] * yv[k])) for (v, k), c in both.items())


def conditional_mutual_information(rows, a, b, y):
    n = len(rows)
    yc = Counter(r[y] for r in rows)
    ay, by = Counter((r[a], r[y]) for r in rows), Counter((r[b], r[y]) for r in rows)
    aby = Counter((r[a], r[b], r[y]) for r in rows)
    return sum(c / n * math.log2(c * yc[k] / (ay[v, k] * by[w, k])) for (v, w, k), c in aby.items())


def structure(rows, attrs, y, k):
    """{attr: [parents]} in rank order, ties to the earlier attribute."""
    mi = {a: round(mutual_information(rows, a, y), 12) for a in attrs}
    order = sorted(attrs, key=lambda a: (-mi[a], attrs.index(a)))
    out = {}
    for rank, a in enumerate(order):
        cmi = {b: round(conditional_mutual_information(rows, a, b, y), 12) for b in order[:rank]}
        out[a] = sorted(cmi, key=lambda b: (-cmi[b], order.index(b)))[:k]
    return out


def _match(r, q, names):
    return all(r[n] == q[n] for n in names)


def probabilities(rows, parents, y, q, include_prior=True, backoff="pair"):
    classes = sorted({r[y] for r in rows})
    score = dict.fromkeys(classes, 0.0)
    for a, ps in parents.items():
        domain = {r[a] for r in rows}
        if q.get(a) not in domain:
            continue
        bound = next((i for i, p in enumerate(ps) if q.get(p) is None), len(ps))
        for level in range(bound, -1, -1):
            path = [r for r in rows if _match(r, q, ps[:level])]
            if backoff == "path" and path or any(r[a] == q[a] for r in path):
                break
        for c in classes:
            n = sum(r[y] == c and r[a] == q[a] for r in path)
            total = sum(r[y] == c for r in path)
            score[c] += math.log(max((n + 1 / len(domain)) / (total + 1), 1e-75))
    if include_prior:
        for c in classes:
            score[c] += math.log((sum(r[y] == c for r in rows) + 1 / len(classes)) / (len(rows) + 1))
    peak = max(score.values())
    mass = sum(math.exp(s - peak) for s in score.values())
    return {c: math.exp(s - peak) / mass for c, s in score.items()}


def loocv(rows, parents, y, k, joint=False):
    """{(row number, k, class): log score}, walking each row's parent path."""
    classes = sorted({r[y] for r in rows})
    out = {}
    for i, q in enumerate(rows):
        for depth in range(k + 1):
            for c in classes:
                own = q[y] == c
                n_c = sum(r[y] == c for r in rows)
                score = math.log((n_c - own + 1 / len(classes)) / len(rows))
                for a, ps in parents.items():
                    nv = len({r[a] for r in rows})
                    level = 0
                    while level < min(depth, len(ps)):
                        deeper = [r for r in rows if _match(r, q, ps[: level + 1])]
                        if sum(r[a] == q[a] for r in deeper) < 2:
                            break
                        level += 1
                    path = [r for r in rows if _match(r, q, ps[:level])]
                    n = sum(r[y] == c and r[a] == q[a] for r in path) - own
                    total = (n_c if joint else sum(r[y] == c for r in path)) - own
                    score += math.log((n + 1 / nv) / (total + 1))
                out[i, depth, c] = score
    return out
