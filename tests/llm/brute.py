"""Plain versions of the operators, for small inputs. Rows are (id, text) and may hold nulls and repeats."""

import hashlib
import math
import re
from collections import Counter, defaultdict

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = str.maketrans(UPPER, LOWER)
LAST = 2**63 - 1


def sha(b):
    return hashlib.sha256(b).hexdigest()


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def decontaminate(docs, items, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    wins = defaultdict(set)
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins[tuple(w[k : k + n])].add(item)
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= x - {None}
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit)))
    return out


def suffix(docs, size=50):
    first = {}
    data = [(LAST if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in data:
        for k in range(len(b) - size + 1):
            s = b[k : k + size]
            first[s] = min(i, first.get(s, LAST))
    out = []
    for (i, _), (own, b) in zip(docs, data, strict=True):
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < own:
                gone[k : k + size] = b"\1" * size
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone, strict=True) if not g))))
    return out


def substring(docs, size=35):
    words = [spaced(t) for _, t in docs]
    count = Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone[k : k + size] = [True] * size
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode())))
    return out


def fingerprint(text, n=4):
    from xxhash import xxh64_intdigest

    w = spaced((text or "").translate(LOW))
    parts = [" ".join(w[k : k + n]) for k in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if sum(x >> k & 1 for x in h) * 2 > len(h))


def components(docs, bits=4):
    prints = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    members = defaultdict(list)
    for k, (i, _) in enumerate(docs):
        members[find(k)].append(i)
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in members.items()}
    return [(i, f"{prints[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(docs)]


def ppm(texts, train, starts=(4, 6), discount=0.25, recent=16):
    """log10 probability of each text's bytes and end: codings from contexts of each of ``starts`` bytes, blended."""
    order = max(starts)
    plain = [defaultdict(Counter) for _ in range(order + 1)]
    pad = lambda t: bytes(order) + (t or "").encode() + b"\0"
    for t in train:
        p = pad(t)
        for i in range(order, len(p)):
            for k in range(order + 1):
                plain[k][p[i - k : i]][p[i]] += 1
    # a shorter context counts a byte once for each byte that was seen before the context
    updates = [defaultdict(Counter) for _ in range(order)]
    for k in range(order):
        for context, seen in plain[k + 1].items():
            for byte in seen:
                updates[k][context[1:]][byte] += 1

    def cost(g, start):
        gone, out = set(), 0.0
        for k in range(start, -1, -1):
            seen = (plain if k == start else updates)[k].get(g[order - k : order], {})
            left = {s: n for s, n in seen.items() if s not in gone}
            if left:
                total = sum(left.values())
                if g[-1] in left:
                    return out + math.log10((left[g[-1]] - discount) / total)
                out += math.log10(discount * len(left) / total)
            gone |= set(left)
        return out - math.log10(256 - len(gone))

    def score(p):
        done, out = [], 0.0
        for i in range(order, len(p)):
            now = [cost(p[i - order : i + 1], s) for s in starts]
            weight = [10 ** (sum(x[k] for x in done[-recent:]) / 2) for k in range(len(starts))]
            out += math.log10(sum(w * 10**c for w, c in zip(weight, now, strict=True)) / sum(weight))
            done.append(now)
        return out

    return [score(p) for p in map(pad, texts)]


def lm(docs, held):
    """All columns of the scoring operator; ``held`` tells whether an id is held out."""
    words = lambda t: [w for w in spaced((t or "").translate(LOW))] + ["end of text"]
    train = [t for i, t in docs if not held(i)]
    count = Counter(w for t in train for w in words(t))
    n, v = sum(count.values()), len(count)
    base = lambda t: sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words(t))
    scores = ppm([t for _, t in docs], train)
    return [(i, held(i), len(words(t)), sum(count[w] > 0 for w in words(t)), n, base(t), s) for (i, t), s in zip(docs, scores, strict=True)]


def fingerprints(docs, rare=0.001, common=0.2, subsets=16, levels=4, least=4):
    """id, n_chars, edited text, both fingerprints and both likenesses; the next of each row stands after it."""
    from xxhash import xxh64_intdigest

    texts = [t or "" for _, t in docs]
    terms = lambda t: {xxh64_intdigest(w.encode(), 42) for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w}
    held = Counter(x for t in texts for x in terms(t))
    lexicon = {x for x, n in held.items() if max(2, rare * len(texts)) <= n <= common * len(texts)}

    def codes(text):
        out = []
        for level in range(levels):
            dealt = defaultdict(list)
            for x in terms(text) & lexicon:
                dealt[(x >> (12, 16, 22, 30)[level]) % (subsets * 4**level)].append(x)
            for k in range(subsets):
                value = 42
                for x in sorted(x & 2**56 - 1 for x in dealt[k]):
                    value = xxh64_intdigest((k << 56 | x).to_bytes(8, "little"), value)
                out.append(f"{value & 0xFFFF:04x}" if dealt[k] else "----")
        return out, sha(text.encode())[:16]

    def near(a, b):
        if a == b:
            return 1.0
        best = 0.0
        for k in range(0, levels * subsets, subsets):
            pairs = [(x, y) for x, y in zip(a[0][k : k + subsets], b[0][k : k + subsets], strict=True) if (x, y) != ("----", "----")]
            best = max(best, sum(x == y for x, y in pairs) / max(least, len(pairs)))
        return best

    out = []
    for k, (i, _) in enumerate(docs):
        text, after = texts[k], texts[(k + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, new = codes(text), codes(edited)
        out.append((i, len(text), edited, "".join(own[0]) + own[1], "".join(new[0]) + new[1], near(own, new), near(own, codes(after))))
    return out


def two_fit(lengths, size):
    """Best-two-fit: the longest that fits, again and again; then the smallest gives way to the two that fill its gap best."""
    left, bins = sorted(lengths), []
    while left:
        held, gap = [], size
        while any(x <= gap for x in left):
            x = max(x for x in left if x <= gap)
            left.remove(x)
            held.append(x)
            gap -= x
        while gap:
            small = min(held)
            pairs = [(a + b, a, b) for k, b in enumerate(left) for a in left[k + 1 :] if small < a + b <= gap + small]
            if not pairs:
                break
            both, a, b = max(pairs)
            held.remove(small)
            for x in (a, b):
                left.remove(x)
            held += [a, b]
            left = sorted([*left, small])
            gap += small - both
        bins.append(held)
    return bins
