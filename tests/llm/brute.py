"""Plain versions of the operators, for small inputs."""

import hashlib
import re

import xxhash


def simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, near):
    """Smallest id reachable, by repeated passes; ``near(i, j)`` over positions."""
    label, changed = list(ids), True
    pairs = [(i, j) for i in range(len(ids)) for j in range(i) if near(i, j)]
    while changed:
        changed = False
        for i, j in pairs:
            least = min(label[i], label[j])
            changed |= label[i] != least or label[j] != least
            label[i] = label[j] = least
    return label


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def common_length(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = best[j + 1]
            best[j + 1] = last + 1 if x == y else max(best[j + 1], best[j])
            last = keep
    return best[-1]
