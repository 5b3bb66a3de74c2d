"""Plain Python versions of the operators, straight from their definitions."""
from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall(text or "")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def op1(docs, window=35):
    lists = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i:i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, lists, strict=True):
        drop = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                drop.update(range(i, i + window))
        out.append((doc_id, len(w), len(drop), sha(" ".join(x for i, x in enumerate(w) if i not in drop))))
    return out


def op2_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """sizes: {source: words}; targets by clamping one round at a time."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def op3(docs, items, window=13):
    index = defaultdict(set)
    for item, text in items:
        t = terms(text)
        if t:
            n = min(window, len(t))
            for i in range(len(t) - n + 1):
                index[tuple(t[i:i + n])].add("" if item is None else str(item))
    sizes = sorted({len(k) for k in index})
    out = []
    for doc_id, text in docs:
        t, hit, found = terms(text), set(), set()
        for n in sizes:
            for i in range(len(t) - n + 1):
                if (ids := index.get(tuple(t[i:i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((doc_id, len(t), len(hit), len(found), sha(",".join(sorted(found))),
                    bool(hit) and 20 * len(hit) >= len(t)))
    return out


def op7_base(docs):
    out = []
    for doc_id, text in docs:
        text, w = text or "", words(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        count = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if count[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
        out.append((doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover),
                    len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    return out


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    bits = sum((a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
               for a, b in zip(p, q, strict=True)) / 2
    return math.sqrt(max(0.0, bits))


def shingles(text, n=3):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def roots(n, links):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        up[find(a)] = find(b)
    return [find(i) for i in range(n)]


def op8(docs, n=3, percent=90):
    return [r[:3] for r in op8_rooted(docs, n, percent)]


def op8_rooted(docs, n=3, percent=90):
    sets = [shingles(t, n) for _, t in docs]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    links = []
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g] if j > i)
        links += [(i, j) for j, c in common.items() if 100 * c >= percent * (len(s) + len(sets[j]) - c)]
    root, least = roots(len(docs), links), {}
    for (doc_id, _), r in zip(docs, root, strict=True):
        least[r] = doc_id if least.get(r) is None else least[r] if doc_id is None else min(least[r], doc_id)
    return [(doc_id, len(s), least[r], r) for (doc_id, _), s, r in zip(docs, sets, root, strict=True)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def op9_base(text):
    text, out = text or "", []
    for kind, pattern in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) \
                    or kind == "card" and 16 <= len(digits) <= 19 and luhn(digits) \
                    or kind == "phone" and 8 <= len(digits) <= 15:
                out.append((kind, *m.span()))
    return out
