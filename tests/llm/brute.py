"""Plain, slow versions of the operators, straight from their definitions."""

import hashlib
import zlib
from collections import Counter, defaultdict


def substring(rows, width=35):
    words = [(t or "").encode().split() for _, t in rows]
    n = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if n[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def suffix(rows, length=100):
    rows = sorted(((d, (t or "").encode()) for d, t in rows), key=lambda r: r[0])
    seen, out = set(), []
    for doc, data in rows:
        gone = set()
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone.update(range(i, i + length))
            seen.add(s)
        spans = sum(i - 1 not in gone for i in gone)
        kept = bytes(b for i, b in enumerate(data) if i not in gone)
        out.append((doc, len(data), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text):
    w = (text or "").encode()
    w = bytes(b + 32 if 65 <= b <= 90 else b for b in w).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near(rows, percent=75):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(i)
    seen = set()
    for group in by.values():
        for a in group:
            for b in group:
                if a < b and (a, b) not in seen:
                    seen.add((a, b))
                    u, v = sets[a][1], sets[b][1]
                    k = len(u & v)
                    if 100 * k >= percent * (len(u) + len(v) - k):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least[find(i)], least[find(i)] == d) for i, (d, s) in enumerate(sets)]


def _plain_words(text):
    out, word = [], bytearray()
    for b in (text or "").encode():
        b = b + 32 if 65 <= b <= 90 else b
        if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128:
            word.append(b)
        elif word:
            out.append(bytes(word))
            word = bytearray()
    return out + [bytes(word)] * bool(word)


def contaminated(rows, items, width=10):
    windows = defaultdict(set)
    for item, text in items:
        w = _plain_words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in rows:
        w = _plain_words(text)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= x
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def unigram(rows):
    import math
    import zlib

    toks = {d: bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split() + [None] for d, t in rows}
    c = Counter(x for d, ts in toks.items() if zlib.crc32(str(d).encode()) % 7 != 2 for x in ts)
    n, v = sum(c.values()), len(c)
    return {d: (zlib.crc32(str(d).encode()) % 7 == 2, len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts)) for d, ts in toks.items()}


def rules_base(text):
    import re

    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = set()
    for i in range(len(w) - 4):
        if n[tuple(w[i : i + 5])] > 1:
            rep.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text), len(lines) - len(set(lines)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


_VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")


def _assigned(text, i):
    """End of an assignment that begins at i, whatever its value's length, and where the value begins."""
    low = "".join(c.lower() if c.isascii() else c for c in text[i : i + 8])
    for name in _NAMES:
        if low.startswith(name):
            j = i + len(name)
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            while text[j : j + 1] == " ":
                j += 1
            if text[j : j + 1] not in (":", "=") or j >= len(text):
                continue
            j += 1
            while text[j : j + 1] == " ":
                j += 1
            j += text[j : j + 1] in ("'", '"') and j < len(text)
            k = j
            while k < len(text) and text[k] in _VALUE:
                k += 1
            if k > j:
                return j, k
    return None


def secrets(text):
    """Base spans by walking over the characters; a match that is too short uses up its letters."""
    out, i = [], 0
    while i < len(text):
        if found := _assigned(text, i):
            if found[1] - found[0] >= 6:
                out.append((i, found[1], "assign"))
            i = found[1]
        else:
            i += 1
    i = 0
    while i < len(text):
        j = i + 4
        while text[i : i + 4] == "AKIA" and j < len(text) and text[j] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
            j += 1
        if j > i + 4:
            if j - i >= 20:
                out.append((i, j, "access"))
            i = j
        else:
            i += 1
    i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in "0123456789abcdef":
            j += 1
        if j - i >= 24:
            out.append((i, j, "hex"))
        i = max(j, i + 1)
    return out


def manifest(rows, fanout=16):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda r: H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def tree(hashes):
        ways, at = [[] for _ in hashes], list(range(len(hashes)))
        while len(hashes) > 1:
            for i, k in enumerate(at):
                low = k // fanout * fanout
                ways[i].append(("".join(hashes[low:k]), "".join(hashes[k + 1 : low + fanout])))
            at = [k // fanout for k in at]
            hashes = [H(*hashes[i : i + fanout]) for i in range(0, len(hashes), fanout)]
        return hashes[0], ways

    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((own, *tree([leaf(r) for r in own])))
    root, tops = tree([t[1] for t in trees]) if trees else (None, [])
    out = []
    for (own, sub, ways), top in zip(trees, tops):
        for r, way in zip(own, ways):
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
            now = leaf((*r[:4], text))
            for before, after in way + top:
                now = H(before, now, after)
            out.append((r[0], leaf(r), sub, root, H(*(b + a for b, a in way + top)), now, now == root))
    return out


def vectors(rows, cosine=0.98):
    """(vec_id, links, component, kept) of (vec_id, vector, label) rows: every pair is compared."""
    import numpy as np

    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, float)
        x = x / np.abs(x).max()
        return x / np.sqrt((x * x).sum())

    made = [unit(v) if label is not None else None for _, v, label in rows]
    links, component = [[] for _ in rows], list(range(len(rows)))
    for i, x in enumerate(made):
        for j, y in enumerate(made):
            if i != j and x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and (x * y).sum() >= cosine:
                links[i].append(j)
    for start in range(len(rows)):
        if component[start] == start:
            todo = [start]
            while todo:
                for j in links[todo.pop()]:
                    if component[j] != start and component[j] == j and j > start:
                        component[j] = start
                        todo.append(j)
    least = {}
    for i, c in enumerate(component):
        if rows[i][0] is not None:
            least[c] = min(least.get(c, rows[i][0]), rows[i][0])
    return [(r[0], len(links[i]), least.get(component[i]), r[0] == least.get(component[i])) for i, r in enumerate(rows)]


def ranked(docs, items, best=20):
    """(item_id, rank, doc_id, score) of (doc_id, text) rows for distinct (item_id, text) rows."""
    import math

    def terms(text):
        out, word = Counter(), []
        for c in (text or "") + " ":
            if c.isascii() and not c.isalnum():
                if word:
                    out["".join(word)] += 1
                word = []
            else:
                word.append(c.lower() if c.isascii() else c)
        return out

    counts = [(d, terms(t)) for d, t in docs]
    n = sum(1 for _, c in counts if c)
    length = sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for place, (doc, c) in enumerate(counts):
            m = 75 + (25 * sum(c.values()) * n) // length if length else 0
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in terms(text).items() if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, place, doc))
        out += [(item, k + 1, s[4], -s[0]) for k, s in enumerate(sorted(scores)[:best])]
    return out


def linked_secrets(text, base, weak, walls, reach, mixed):
    """Which weak parts are reported, from every pair of parts.  ``weak``: all candidates; ``mixed``: whether a secret has letters and digits."""

    def scope(x):
        low = max([w for w in walls if w <= x[0]], default=0)
        high = min([w for w in walls if w >= x[1]], default=len(text))
        return max(x[0] - reach, low), min(x[1] + reach, high)

    def over(x, y):
        return x[0] < y[1] and y[0] < x[1]

    named = [x for x in base if x[2] != "access"]
    weak = [x for x in weak if not (x[2] == "secret" and any(over(x, y) for y in named))]
    idents = [x for x in base if x[2] == "access"] + [x for x in weak if x[2] == "ident"]
    endpoints = [x for x in weak if x[2] == "endpoint"]
    secrets = []
    for x in weak:
        if x[2] == "secret":
            beside = any(over(x, scope(y)) for y in idents if not over(x, y))
            beside |= mixed(x) and not any(over(x, y) for y in endpoints) and any(over(x, scope(y)) for y in endpoints)
            if beside:
                secrets.append(x)
    return secrets + [x for x in weak if x[2] != "secret" and any(over(x, scope(y)) for y in named + secrets)]


def nn_pu(positive, unlabelled, prior, epochs, rate=0.3, decay=1e-4, seed=7, support=6, share=0.006, lift=0.5):
    """(places, weights, bias) by the non-negative positive-unlabelled risk; documents are lists of places."""
    import math

    import numpy as np

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def loss(x):
        return math.log1p(math.exp(x))

    inp, inu = Counter(x for d in positive for x in d), Counter(x for d in unlabelled for x in d)
    least = max(1, min(support, len(positive) // 8), share * len(positive))
    places = sorted(x for x, n in inp.items() if n >= least and (n / len(positive)) / ((inu[x] + 1) / (len(unlabelled) + 1)) >= lift / prior)
    w, g2 = dict.fromkeys(places, 0.0), dict.fromkeys(places, 1e-8)
    bias, b2 = math.log(prior / (1 - prior)), 1e-8
    rng = np.random.default_rng(seed)
    batch, steps = max(1, min(256, len(positive))), max(8, len(unlabelled) // 512)
    for _ in range(epochs):
        order = [rng.permutation(len(x)).tolist() for x in (positive, unlabelled)]
        for step in range(steps):
            ps = [positive[order[0][(step * batch + k) % len(positive)]] for k in range(batch)]
            us = [unlabelled[k] for k in order[1][step::steps]]
            logit = lambda d: sum(w.get(x, 0.0) for x in d) + bias
            zp, zu = [logit(d) for d in ps], [logit(d) for d in us]
            clean = sum(map(loss, zu)) / len(zu) - prior * sum(map(loss, zp)) / len(zp)
            grad, gb = {x: decay * w[x] for x in places}, 0.0
            for docs, slopes in (
                (ps, [(-prior * sigmoid(-z) - prior * sigmoid(z) if clean >= 0 else prior * sigmoid(z)) / len(zp) for z in zp]),
                (us, [(sigmoid(z) if clean >= 0 else -sigmoid(z)) / len(zu) for z in zu]),
            ):
                for d, slope in zip(docs, slopes):
                    gb += slope
                    for x in d:
                        if x in grad:
                            grad[x] += slope
            for x in places:
                g2[x] += grad[x] ** 2
                w[x] -= rate * grad[x] / math.sqrt(g2[x])
            b2 += gb * gb
            bias -= rate * gb / math.sqrt(b2)
    return places, [w[x] for x in places], bias
