"""Plain versions of the contracts."""

import hashlib
import re
import zlib
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def fingerprint(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(rows, radius=3):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, f"{prints[i]:016x}", ids.get(find(i))) for i, (d, _) in enumerate(rows)]


def suffix(rows, n):
    docs = [(d, (t or "").encode()) for d, t in rows]
    c = Counter(b[p : p + n] for _, b in docs for p in range(len(b) - n + 1))
    out = []
    for d, b in docs:
        gone = [False] * len(b)
        for p in range(len(b) - n + 1):
            if c[b[p : p + n]] > 1:
                gone[p : p + n] = [True] * n
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def substring(rows, n):
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in docs:
        if d is not None:
            for p in range(len(w) - n + 1):
                k = tuple(w[p : p + n])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if d is not None and first[tuple(w[p : p + n])] < d:
                gone[p : p + n] = [True] * n
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


def lines(rows):
    def key(x):
        k = x.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    holders = {}
    for d, t in rows:
        if d is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= 10:
                    holders.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if d is None or len(holders.get(key(x), ())) < 2 or min(holders[key(x)]) == d]
        out.append((d, len(own), len(own) - len(kept), sha("\n".join(kept).encode())))
    return out


def exact(rows):
    norm = [(d, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for d, t in rows]
    out = []
    for d, t in norm:
        group = [e for e, u in norm if u == t]
        keep = min((e for e in group if e is not None), default=None)
        out.append((d, keep, len(group), d == keep, sha(t.encode())))
    return out


def _lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def jaccard_join(rows, k=5):
    """(doc_id, set size, component) of every row, from all pairs that share a shingle."""
    sets = []
    for _, t in rows:
        w = WORD.findall(_lowered(t))
        sets.append({" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 80 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return [(d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point turns a into b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def spelling(rows):
    n = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = _lowered(run)
            h = zlib.crc32(f"{'null' if d is None else d}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % 31 == 0 else low] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    forms, counts = {}, {}
    for w in n:
        near = [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        counts[w] = len(near)
        best = min(near, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        end = w
        while forms[end]:
            end = forms[end]
        out.append((w, forms[w], end, n[w], counts[w], n.get(forms[w])))
    return out
