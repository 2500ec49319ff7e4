"""Plain versions of the operators, for small inputs."""

import hashlib
import itertools
import re
from collections import Counter

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")


def removed(texts: list[str], length: int = 200) -> list[tuple]:
    """n_bytes, n_removed, n_spans, sha256 of what is left, of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def shingles(text: str | None) -> set:
    words = WORD.findall((text or "").translate(UPPER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def components(docs: list[tuple[int, str]], percent: int = 85) -> dict[int, int]:
    sets = {d: shingles(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def base_statistics(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Of contiguous cuts, by trying every capacity that a run of groups can have."""

    def fits(c):
        used, filled = 1, 0
        for s in sizes:
            if s > c:
                return False
            if filled + s > c:
                used, filled = used + 1, 0
            filled += s
        return used <= shards

    return min(c for c in {sum(sizes[i:j]) for i in range(len(sizes)) for j in range(i + 1, len(sizes) + 1)} if fits(c))


def likelihood(start, move, emit, codes) -> float:
    """Sum over all state paths."""
    total = 0.0
    for path in itertools.product(range(len(start)), repeat=len(codes)):
        p = start[path[0]] * emit[codes[0]][path[0]]
        for (a, b), c in zip(zip(path, path[1:]), codes[1:]):
            p *= move[a][b] * emit[c][b]
        total += p
    return total
