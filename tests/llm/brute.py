"""Plain versions of the operators."""

import collections
import decimal
import hashlib
import math
import re
import zlib

import xxhash

WORD = re.compile("[^\x20\x09-\x0D]+")


def rules(text):
    t = text or ""
    w = WORD.findall(t)
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    n = len(w)
    return n, sum(map(len, w)), sum(t.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(t)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, most=2):
    """Class numbers of a list of fingerprints."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def smallest(ids):
    known = [i for i in ids if i is not None]
    return min(known) if known else None


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(x for x in sizes if x is not None) + [x for x in sizes if x is None]
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    budget, capped = share * sum(sizes.values()), set()
    while True:
        left, total = budget - sum(most * sizes[n] for n in capped), sum(w[n] for n in names if n not in capped)
        new = {n for n in names if n not in capped and left * w[n] / total > most * sizes[n]}
        if not new:
            return {n: float(most * sizes[n]) if n in capped else left * w[n] / total for n in names}
        capped |= new


def mix_key(doc_id, text):
    t = text or ""
    odd = sum(t.count(c) for c in "0123456789#*$%&|<>{}[]_=+~^\\")
    u = (int(hashlib.md5(f"mix|{'' if doc_id is None else doc_id}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    return -math.log(u) / (0.5 + 0.5 * (1 - odd / max(len(t), 1)))


def mix(rows):
    """(doc_id, text, source) rows to their taken words."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = collections.Counter()
    for (_, _, s), n in zip(rows, size):
        total[s] += n
    goal, taken = targets(dict(total)), [0] * len(rows)
    for s in total:
        if not total[s]:
            continue
        epochs, groups = int(goal[s] // total[s]), collections.defaultdict(list)
        need = math.floor(goal[s]) - epochs * total[s]
        for i, (d, t, src) in enumerate(rows):
            if src == s:
                taken[i] = epochs * size[i]
                if size[i]:
                    groups[mix_key(d, t)].append(i)
        for k in sorted(groups):
            tied = sum(size[i] for i in groups[k])
            for i in groups[k]:
                taken[i] += size[i] if tied <= need else size[i] * need // tied
            need = max(0, need - tied)
    return size, total, goal, taken


def crc(ids):
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def toxic_tokens(text):
    return re.findall(r"[^\W\d_]+", (text or "").lower())


def toxic_scorer(learnt, prior=4.0):
    """A function of a token: its log-odds in (text, toxic) pairs, shrunk to that of its prefixes."""
    toxic = sum(y for _, y in learnt)
    scale = toxic / (len(learnt) - toxic)
    held = [({*(u := set(toxic_tokens(t))), *((n, w[:n]) for w in u for n in (4, 5, 6) if len(w) >= n)}, y) for t, y in learnt]
    counts = collections.defaultdict(lambda: [0, 0])
    for units, y in held:
        for u in units:
            counts[u][y] += 1

    def share(unit):
        """None for units that no document holds."""
        stem, below = (unit, 7) if isinstance(unit, str) else (unit[1], unit[0])
        if unit not in counts:
            return None
        above = next((share((n, stem[:n])) for n in (6, 5, 4) if n < below and len(stem) >= n), 0.5)
        c, t = counts[unit]
        return (t + prior * above) / (t + c * scale + prior)

    def score(token):
        for unit in (token, (6, token[:6]), (5, token[:5]), (4, token[:4])):
            if (isinstance(unit, str) or len(token) >= unit[0]) and (p := share(unit)) is not None:
                return math.log(p / (1 - p))
        return 0.0

    known = {}
    return lambda token: known.setdefault(token, score(token))


def toxic_values(text, score, drift=0.5):
    """Scores of a text's tokens; the k-th time counts 1 / k**2."""
    out, times = [], collections.Counter()
    for t in toxic_tokens(text):
        s = score(t)
        if s - drift > 0:
            times[t] += 1
            s /= times[t] ** 2
        out.append(s - drift)
    return out


def best_segments(s):
    """The best segment, then the same on both sides of it."""
    sums = [0.0]
    for x in s:
        sums.append(sums[-1] + x)
    low, best = 0, (0.0, 0, 0)
    for b in range(1, len(sums)):
        if sums[b] - sums[low] > best[0]:
            best = (sums[b] - sums[low], low, b)
        if sums[b] < sums[low]:
            low = b
    if best[0] <= 0:
        return []
    _, a, b = best
    return [*best_segments(s[:a]), best[0], *best_segments(s[b:])]


def poisson_tail(r, mean):
    """-ln P(N >= r) of a Poisson number."""
    with decimal.localcontext(prec=60):
        m, k = mean, r
        term = (-m).exp() * m**r / math.factorial(r)
        total = term
        while term > total * decimal.Decimal("1e-40"):
            k += 1
            term *= m / k
            total += term
        return float(-total.ln())


def toxicity(rows, learnt, held):
    """(evidence, score) of texts, with the scores learnt from (text, toxic) pairs and calibrated on others."""
    score = toxic_scorer(learnt)
    clean = [toxic_values(t, score) for t, y in held if not y]
    bins = collections.Counter(round(s * 100) for v in clean for s in v)
    excess = lambda rate: sum(n * math.exp(rate * k / 100) for k, n in bins.items()) / sum(bins.values()) - 1
    low, high = 1e-3, 1.0
    while excess(high) < 0:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    rate = high
    constant = len(clean) / sum(max(len(v), 1) * math.exp(-rate * max(best_segments(v), default=0.0)) for v in clean)

    def evidence(text):
        v = toxic_values(text, score)
        means = sorted(decimal.Decimal(constant * len(v)) * decimal.Decimal(-rate * s).exp() for s in best_segments(v))
        return max((poisson_tail(r, m) for r, m in enumerate(means, 1) if m <= 0.05), default=0.0)

    points, a, b = [(evidence(t), y) for t, y in held], 0.0, 0.0
    for _ in range(500):
        p = [1 / (1 + math.exp(-(a + b * e))) for e, _ in points]
        ga, gb = sum(q - y for q, (_, y) in zip(p, points)) + 1e-3 * a, sum((q - y) * e for q, (e, y) in zip(p, points)) + 1e-3 * b
        haa, hab, hbb = sum(q * (1 - q) for q in p) + 1e-3, sum(q * (1 - q) * e for q, (e, _) in zip(p, points)), sum(q * (1 - q) * e * e for q, (e, _) in zip(p, points)) + 1e-3
        da, db = (hbb * ga - hab * gb) / (haa * hbb - hab * hab), (haa * gb - hab * ga) / (haa * hbb - hab * hab)
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
    return [(e := evidence(t), 1 / (1 + math.exp(-max(-40.0, min(40.0, a + b * e))))) for t in rows]
