"""Plain Python versions of the operators, straight from their definitions; quadratic where that is plainest."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = " \t\n\x0b\x0c\r"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = WORD.findall(low(text))
    if not w:
        return set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def base_rules(text):
    x = text or ""
    w = WORD.findall(x)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(windows)
    covered = {j for i, g in enumerate(windows) if n[g] > 1 for j in range(i, i + 5)}
    lines = [s for s in x.split("\n") if WORD.search(s)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x)), len(lines) - len(set(lines)), len(covered), failed


def scores(docs, trusted, buckets, smoothing):
    """docs: (doc_id, text) rows; score of each row by position."""

    def grams(text):
        h = [zlib.crc32(w.encode()) for w in WORD.findall(text or "")]
        return [x % buckets for x in h] + [(a * 31 + b) % buckets for a, b in zip(h, h[1:])]

    raw, target = collections.Counter(), collections.Counter()
    for d, t in docs:
        raw.update(grams(t))
        if d in trusted:
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())

    def weight(b):
        return 0.0 if not m else math.log((target[b] + smoothing) / (m + smoothing * buckets)) - math.log((raw[b] + smoothing) / (n + smoothing * buckets))

    return [sum(map(weight, g)) / len(g) if (g := grams(t)) else 0.0 for _, t in docs]


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    x = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found))


def near_duplicates(docs):
    """doc_id to component, for rows (doc_id, text); rows with one id are one document."""
    sets = [(d, shingles(t)) for d, t in docs if d is not None]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, r in sets[:i]:
            if s and 100 * len(s & r) >= 75 * len(s | r):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def remove_repeats(texts, span=200):
    """(n_bytes, n_removed, n_spans, sha256 of the rest) of each text."""
    raw = [(t or "").encode() for t in texts]
    n = collections.Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - span + 1):
            if n[b[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def line_dedup(docs, least=20, often=3):
    """(n_lines, n_dropped, kept text) of each row."""
    key = lambda s: low(s.strip(SPACES))
    held = collections.defaultdict(set)
    for d, t in docs:
        for s in (t or "").split("\n"):
            if len(key(s)) >= least:
                held[key(s)].add(d)
    order = lambda d: (d is not None, d or 0)
    last = {k: max(ds, key=order) for k, ds in held.items() if len(ds) >= often}
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [s for s in lines if key(s) not in last or last[key(s)] == d]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def kneser_ney(train, texts):
    """(log10 probability, base score, tokens, known tokens) of each text by a model of the training texts."""
    seq = lambda t: [*WORD.findall(low(t)), None]
    c, pairs = collections.Counter(), collections.Counter()
    for t in train:
        w = seq(t)
        c.update(w)
        pairs.update(zip(["<s>", *w[:-1]], w))
    n, v = sum(c.values()), len(c)

    def discounts(counts):
        k = [sum(x == j for x in counts.values()) for j in range(5)]
        y = k[1] / (k[1] + 2 * k[2]) if k[1] else 0
        d = [j - (j + 1) * y * k[j + 1] / k[j] if k[j] and y else 0.75 * j for j in (1, 2, 3)]
        return [0, *(x if 0 < x < j else 0.75 * j for j, x in enumerate(d, 1))]

    d2, k = discounts(pairs), collections.Counter(w for _, w in pairs)
    d1, total = discounts(k), max(1, len(pairs))
    left1 = sum(d1[min(x, 3)] for x in k.values()) / total if pairs else 1.0
    of, left = collections.Counter(), collections.Counter()
    for (a, _), x in pairs.items():
        of[a] += x
        left[a] += d2[min(x, 3)]
    out = []
    for t in texts:
        w = seq(t)
        p = 0.0
        for a, b in zip(["<s>", *w[:-1]], w):
            uni = max(k[b] - d1[min(k[b], 3)], 0) / total + left1 / (v + 1)
            p += math.log10((max(pairs[a, b] - d2[min(pairs[a, b], 3)], 0) + left[a] * uni) / of[a] if of[a] else uni)
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((p, base, len(w), sum(c[x] > 0 for x in w)))
    return out, n


def window_hashes(text: bytes, span: int) -> np.ndarray:
    """A 64-bit polynomial hash of every ``span`` bytes of a text, in the order of their starts."""
    base, rng = 0x9E3779B97F4A7C15, np.random.default_rng(1)
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)[np.frombuffer(text, np.uint8)]
    n = max(0, len(text) - span + 1)
    up = np.cumprod(np.full(len(text), base, np.uint64))
    down = np.cumprod(np.full(n, pow(base, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * up, dtype=np.uint64)])
    return (sums[span:] - sums[:n]) * down if n else np.zeros(0, np.uint64)


def without(text: bytes, starts, span: int):
    """n_bytes, n_removed, n_spans and the digest of what is left once ``span`` bytes from each start are gone."""
    depth = np.zeros(len(text) + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, np.asarray(starts) + span, -1)
    gone = np.cumsum(depth[:-1]) > 0
    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
    return len(text), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()
