"""Plain versions of the operators' results, for small inputs."""

import collections
import hashlib
import re
import zlib

import numpy as np
import xxhash

SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def repeats(rows, window):
    tokens = [re.findall(SPACED, t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in tokens for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, tokens):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    return out


def contamination(rows, items):
    found = collections.defaultdict(set)
    for i, t in items:
        w = re.findall(ALNUM, low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found[tuple(w[k : k + n])].add("" if i is None else str(i))
    out = []
    for d, t in rows:
        w = re.findall(ALNUM, low(t))
        hit, ids = [0] * len(w), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in found:
                    ids |= found[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        out.append((d, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(sum(hit)) and 20 * sum(hit) >= len(w)))
    return out


def fingerprint(text):
    w = re.findall(SPACED, low(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps):
    """Index of the component of each fingerprint, by all pairs."""
    u = np.array(sorted(set(fps)), np.uint64)
    root = list(range(len(u)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    at = {int(x): i for i, x in enumerate(u)}
    return [find(at[x]) for x in fps]


def base_pii(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0
            kept = kind == "email"
            kept |= kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
            kept |= kind == "card" and 13 <= len(digits) <= 19 and luhn
            kept |= kind == "phone" and 9 <= len(digits) <= 15
            if kept:
                out.append((kind, m.start(), m.end()))
    return out


def license_places(text):
    w = re.findall(ALNUM, low(text))
    phrases = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
    return len(w), [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
