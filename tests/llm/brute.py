"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def repeats(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[p : p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def near(rows, n=4, percent=85):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def tokens(tokenizer, rows, end=2):
    out, start = [], 0
    for i, t in sorted(rows):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [end]
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        out.append((i, start, len(ids), zlib.crc32(raw)))
        start += len(ids)
    return out


def gru_score(net, text, window=32, stride=16):
    """A text's score, one word and one unit after the other; 0 without words."""
    words = [w.encode() for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", text.lower())]
    sig = lambda v: 1 / (1 + np.exp(-v))
    best = 0.0
    starts = [0] if words else []
    while starts and starts[-1] + window < len(words):
        starts.append(starts[-1] + stride)
    for s in starts:
        xs = [net.known(pa.array([w], pa.large_binary()))[0].astype(float) for w in words[s : s + window]]
        states = {}
        for way, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
            w, u, c = (net.p[k + way].astype(float) for k in "WUc")
            n = u.shape[0]
            h = np.zeros(n)
            for t in order:
                g, a = xs[t] @ w + c, h @ u
                z, r = sig(g[:n] + a[:n]), sig(g[n : 2 * n] + a[n : 2 * n])
                h = z * h + (1 - z) * np.tanh(g[2 * n :] + r * a[2 * n :])
                states[way, t] = h
        both = [np.concatenate([states["f", t], states["b", t]]) for t in range(len(xs))]
        e = np.array([np.exp(np.tanh(h @ net.p["A"]) @ net.p["a"]) for h in both])
        pooled = sum(share * h for share, h in zip(e / e.sum(), both, strict=True))
        best = max(best, float(sig(pooled @ net.p["w"] + net.p["o"][0])))
    return best
