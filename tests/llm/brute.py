"""Plain, slow versions of the operators."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np

BLANKS = " \t\n\x0b\x0c\r"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def dedup(rows, min_chars=20, min_docs=3):
    """Kept lines of each (doc_id, text)."""
    key = lambda line: lower(line.strip(BLANKS))
    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= min_chars:
                    held[key(line)].add(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    return [(i, t, [x for x in (t or "").split("\n") if i is None or gone.get(key(x), i) == i]) for i, t in rows]


def fingerprint(text, n=3):
    import xxhash

    words = [w for w in lower(text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, bits=2):
    """Index of the first member of each entry's component."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def simhash_components(rows):
    fps = [fingerprint(t) for _, t in rows]
    own = groups(fps)
    ids = defaultdict(list)
    for (i, _), g in zip(rows, own):
        if i is not None:
            ids[g].append(i)
    return [(i, format(f, "016x"), min(ids[g], default=None)) for (i, _), f, g in zip(rows, fps, own)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def best_fit_bins(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms[rooms.index(min(fits))] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


def word_base(training, texts):
    words = [lower(t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") for t in training]
    c = Counter(w for ws in words for w in ws if w)
    n, v = sum(c.values()) + len(training), len(c) + bool(training)
    d = np.log10(n + 0.1 * (v + 1))
    out = []
    for t in texts:
        ws = [w for w in lower(t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
        out.append((len(ws) + 1, sum(w in c for w in ws) + bool(training), n, sum(np.log10(c[w] + 0.1) - d for w in ws) + np.log10(len(training) + 0.1) - d))
    return out
