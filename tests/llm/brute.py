"""Plain versions of the corpus operators, for small inputs."""

import re
from collections import Counter

import numpy as np
import xxhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `_cf_h` string, `_CF_keep` string, keep_id long"


def frame(spark, rows):
    """Documents with extra columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", 7) for i, t in rows], DOCS)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        total += (x * 2 - 9 * (x > 4)) if i % 2 else x
    return total % 10 == 0


# The patterns of the contract.
KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in KINDS for m in re.finditer(p, text or "") if ok(m.group())]


def told(texts, support, posterior, disclosure):
    """Sorted (term, posterior, least general class that is not told) by counting pairs of entity and term in documents."""
    held = []
    for t in texts:
        words = set(re.findall(r"[^\W\d_]{3,}", re.sub(KINDS[0][1], " ", t).lower()))
        held.append(({(k, t[a:b].lower()) for k, a, b in spans(t)}, words | {w[:3] + "*" for w in words} | {w[:1] + "*" for w in words}))
    df_e, df_t = Counter(e for es, _ in held for e in es), Counter(t for _, ts in held for t in ts)
    n, kinds = Counter((e, t) for es, ts in held for e in es for t in ts), {}
    for text, (es, ts) in zip(texts, held, strict=True):
        for e in es:
            for t in ts:
                kinds.setdefault((e, t), set()).add(text)
    out = {}
    for (e, t), k in n.items():
        p, content = min(1.0, k / df_t[t]), -np.log2(df_e[e] / len(texts))
        if len(kinds[e, t]) >= support and p >= posterior and content > 0 and np.log2(p) + content >= disclosure * content - 1e-12:
            out[t] = max(out.get(t, 0), p)
    return sorted((t, p, next((c for c in (t[:3] + "*", t[:1] + "*") if c not in out), None)) for t, p in out.items() if t[-1] != "*")


def sanitised(text, general):
    """The text without overlaps of kinds: base spans by their kind, told terms outside them by their class."""
    if text is None:
        return None
    base = spans(text)
    marks = [(a, b, f"[{k.upper()}]") for k, a, b in base]
    for m in re.finditer(r"[^\W\d_]{3,}", text):
        if m[0].lower() in general and not any(a < m.end() and m.start() < b for _, a, b in base):
            g = general[m[0].lower()]
            marks.append((m.start(), m.end(), f"[{g}]" if g else ""))
    for a, b, label in sorted(marks, reverse=True):
        text = text[:a] + label + text[b:]
    return text


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    ones = Counter(b for g in grams for h in [xxhash.xxh64_intdigest(g, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(grams))


def component_ids(fps):
    """fps: doc_id -> fingerprint."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def nearest(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        d[ids == q] = np.inf
        order = [i for i in np.lexsort((ids, d)) if d[i] < np.inf][:k]
        out[q] = [(int(ids[i]), float(d[i])) for i in order]
    return out
