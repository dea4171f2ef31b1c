"""Plain versions of the operators, written apart from them, to hold them against."""

import hashlib
import itertools
import math
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def good(text):
    """The verdict of the quality rules."""
    words = WORD.findall(text or "")

    def covered(m):
        grams = [tuple(words[i : i + m]) for i in range(len(words) - m + 1)]
        count = Counter(grams)
        return {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(m)}

    if len(words) < 10 or 100 * len(covered(5)) > 20 * len(words):
        return False
    return sum(len(words[i]) for i in covered(10)) <= 0.1 * sum(map(len, words)) and not covered(61)


def similar(texts, least=0.8):
    """Root of each text's component; links: 5-word shingle sets alike by ``least``."""
    def shingles(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or (a | b and len(a & b) >= least * len(a | b)):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    return root


def base_secrets(t):
    t = t or ""
    pattern = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(pattern, t, re.A) if len(m.group(2)) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 32]
    return sorted(out)


def alphabet(token):
    for pattern, letters in (
        ("[0-9a-f]+|[0-9A-F]+", DIGITS + LOWER[:6]), ("[A-Z2-7]+", "234567" + UPPER), ("[A-Za-z0-9]+", DIGITS + UPPER + LOWER),
        ("[A-Za-z0-9+/]+", "+/" + DIGITS + UPPER + LOWER), ("[A-Za-z0-9_-]+", "-" + DIGITS + UPPER + "_" + LOWER),
    ):
        if re.fullmatch(pattern, token):
            return letters
    return None


def p_values(token):
    letters = alphabet(token)
    if len(letters) == 16:
        token = token.lower()
    tail = lambda z: math.erfc(z / math.sqrt(2)) / 2
    n, k, v = len(token), len(letters), [letters.index(c) for c in token]
    pairs, equal = n * (n - 1) / 2, sum(c * (c - 1) / 2 for c in Counter(token).values())
    share = max(0.065, 2 / k)
    few = tail((pairs * share - equal) / math.sqrt(pairs * share * (1 - share)))
    high = [x > (k - 1) / 2 for x in v]
    turns = sum(a != b for a, b in itertools.pairwise(high))
    many = tail((turns - (n - 1) * 0.35) / math.sqrt((n - 1) * 0.35 * 0.65))
    uniform = tail((equal - pairs / k) / math.sqrt(pairs / k * (1 - 1 / k)))
    n1 = sum(high)
    mean = 1 + 2 * n1 * (n - n1) / n
    var = (mean - 1) * (mean - 2) / (n - 1)
    runs = 2 * tail(abs((1 + turns - mean) / math.sqrt(var))) if var > 0 else 0.5 ** (n - 1)
    centre = sum(v) / n
    spread = sum((x - centre) ** 2 for x in v)
    serial = 2 * tail(abs(sum((a - centre) * (b - centre) for a, b in itertools.pairwise(v)) / spread * math.sqrt(n))) if spread else 0.0
    product = max(few * many, 1e-300)
    return product * (1 - math.log(product)), min(1.0, 3 * min(uniform, runs, serial))


def discovered(ps, rate):
    level = -1.0
    for i, p in enumerate(sorted(ps), 1):
        if p <= rate * i / len(ps):
            level = p
    return level


def random_secrets(t, rate=0.01, lost=0.002):
    t = t or ""
    base = base_secrets(t)
    places = {m.span() for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", t)}
    places |= {m.span() for m in re.finditer(r"[A-Za-z0-9+_-]{20,}", t)}
    tokens = sorted(s for s in places if alphabet(t[slice(*s)]) and not any(b[0] < s[1] and s[0] < b[2] for b in base))
    for which, level, below in ((0, rate, True), (1, lost, False)):
        if not tokens:
            return []
        mean = sum(b - a for a, b in tokens) / len(tokens)
        ps = [p_values(t[a:b])[which] * mean / (b - a) for a, b in tokens]
        at = discovered(ps, level)
        tokens = [s for s, p in zip(tokens, ps, strict=True) if (p <= at) == below]
    return [(a, 3, b) for a, b in tokens if not any(c <= a and b <= d and d - c > b - a for c, d in tokens)]


def secrets(t):
    return sorted(base_secrets(t) + random_secrets(t))


def redacted(t):
    if t is None:
        return None
    out, at = "", 0
    for a, _, b in secrets(t):
        if a >= at:
            out += t[at:a] + "[SECRET]"
        at = max(at, b)
    return out + t[at:]


def mixed(rows, cap=3, seed=42):
    """How often each (doc_id, text, source) is in the mix of whole documents."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(z for z, r in zip(size, rows, strict=True) if r[2] == n) for n in names}
    weight = {n: (1, 2, 3)[i % 3] for i, n in enumerate(names)}
    target, open_, left = {}, list(names), sum(size)
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = [n for n in open_ if cap * total[n] <= level * weight[n]]
        if not over:
            target |= {n: level * weight[n] for n in open_}
            break
        for n in over:
            target[n] = cap * total[n]
            left -= target[n]
            open_.remove(n)
    out = [0] * len(rows)
    for n in names:
        budget = math.floor(target[n] + 0.5)
        if not total[n]:
            continue
        full, rest = divmod(budget, total[n])
        key = lambda i: (int(hashlib.md5(f"{'null' if rows[i][0] is None else rows[i][0]}:{seed}".encode()).hexdigest()[:13], 16), -(2**63) if rows[i][0] is None else rows[i][0], size[i])
        for i in sorted((i for i, r in enumerate(rows) if r[2] == n), key=key):
            inside = min(size[i], max(0, rest))
            out[i] = (full + (inside * 2 >= size[i] and rest > 0)) if size[i] else 0
            rest -= size[i]
    return out
