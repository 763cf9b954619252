"""Plain versions of the operators' contracts, one document at a time."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE = re.compile("[\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def order_of(docs):
    """(rank, id, text) of the distinct documents: null ids last."""
    return sorted({(i is None, i if i is not None else 0, t or "") for i, t in docs})


def components(docs, percent=85, width=5):
    """(id, text) -> (set size, component id, kept)."""
    sets = {}
    for i, text in docs:
        w = words(lower(text or ""))
        sets[i, text] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    distinct = sorted({s for s in sets.values() if s}, key=len)
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for k, a in enumerate(distinct):
        for b in distinct[k + 1 :]:
            if len(a) * 100 < percent * len(b):
                break
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                parent[find(a)] = find(b)
    least = {}
    for (i, _), s in sets.items():
        if s:
            r = find(s)
            least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    out = {}
    for (i, text), s in sets.items():
        c = least[find(s)] if s else i
        out[i, text] = (len(s), c, c == i)
    return out


def repeats(docs, span=50):
    """(id, text) -> (bytes, removed, runs, digest of the rest, mask)."""
    first, out = {}, {}
    ordered = order_of(docs)
    for rank, key in enumerate(ordered):
        data = key[2].encode()
        for p in range(len(data) - span + 1):
            first.setdefault(data[p : p + span], rank)
    for rank, key in enumerate(ordered):
        data = key[2].encode()
        gone = bytearray(len(data))
        for p in range(len(data) - span + 1):
            if first[data[p : p + span]] < rank:
                gone[p : p + span] = b"\1" * span
        runs = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
        rest = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), runs, hashlib.sha256(rest).hexdigest(), gone)
    return {(i, t): out[i is None, i if i is not None else 0, t or ""] for i, t in docs}


def line_marks(docs, percent=90, least=1):
    """(id, text) -> {place: (copy, similar)} of the lines with a word; ids must be unique or null-free."""
    seen, lines = {}, []
    for rank, (_, i, text) in enumerate(order_of(docs)):
        for place, line in enumerate(text.split("\n")):
            s = frozenset(words(line))
            if s:
                lines.append((rank, place, s))
                seen.setdefault(s, (rank, place))
    similar = set()
    for s, at in seen.items():
        for other, before in seen.items():
            if other != s and before < at and min(len(s), len(other)) >= least and 100 * len(s & other) >= percent * len(s | other):
                similar.add(s)
                break
    out = defaultdict(dict)
    for rank, place, s in lines:
        out[rank][place] = (len(s) >= least and seen[s] != (rank, place), s in similar)
    ranks = {k: r for r, k in enumerate(order_of(docs))}
    return {(i, t): out[ranks[i is None, i if i is not None else 0, t or ""]] for i, t in docs}


def base_scores(docs, held):
    """id -> (tokens, known, train tokens, base score); ``held``: ids that don't train."""
    tokens = {i: [*words(lower(t or "")), None] for i, t in docs}
    counts = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def best_fit(lengths, capacity):
    """Best-fit decreasing one by one: the loads of the sequences."""
    loads = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, load in enumerate(loads) if load + n <= capacity]
        if fits:
            loads[max(fits, key=lambda k: loads[k])] += n
        else:
            loads.append(n)
    return loads


def held(i, divisor, remainder):
    return i is not None and zlib.crc32(str(i).encode()) % divisor == remainder


def repeat_words(text, width=8):
    w = words(text)
    at = defaultdict(list)
    for k in range(len(w) - width + 1):
        at[tuple(w[k : k + width])].append(k)
    return len({j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + width)})


def duplicate_lines(text):
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(lines) - len(set(lines))
