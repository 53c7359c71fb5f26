"""Plain Python versions of the operators' results, for small inputs."""

import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1001, None), (1002, ""), (1003, " \t\n"), (1004, "one two"), (1005, "One TWO"), (1006, "one two three four five"), (1006, "one two three four five"),
    (1007, "x" * 30000), (1008, "word " * 30000), (1009, "ÄÖ ü\u00a0z \u2003 \x1c b"), (1010, "a b c d e\na b c d e\n\n  A  b c d e "), (None, "no id here at all"), (None, None),
]


def words(t):
    return WORD.findall(t or "")


def fold(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def quality(t):
    w, n = words(t), 8
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hit = set()
    for i in range(len(w) - n + 1):
        if grams[tuple(w[i : i + n])] > 1:
            hit |= set(range(i, i + n))
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit)


def covered(t, n):
    w = words(t)
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hit = {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(w[j]) for j in hit)


def shingles(t, n):
    w = words(fold(t))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(docs, n, percent=80):
    """doc_id -> (set size, component) by comparing every pair that shares a shingle."""
    sets = {i: shingles(t, n) for i, t in docs if i is not None}
    by = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            by[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    done = set()
    for ids in by.values():
        for a in ids:
            for b in ids:
                if a < b and (a, b) not in done:
                    done.add((a, b))
                    both = len(sets[a] & sets[b])
                    if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                        x, y = find(a), find(b)
                        root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def targets(sizes, weights, share):
    """Shares by repeated handing on, source by source."""
    names = sorted((k for k in sizes if k is not None), key=lambda s: s.encode()) + [k for k in sizes if k is None]
    w = {k: weights[i % len(weights)] for i, k in enumerate(names)}
    total, got, open_ = share * sum(sizes.values()), {}, list(names)
    while open_:
        level = (total - sum(got.values())) / sum(w[k] for k in open_)
        above = [k for k in open_ if level * w[k] > 2 * sizes[k]]
        if not above:
            got |= {k: level * w[k] for k in open_}
            break
        got |= {k: 2.0 * sizes[k] for k in above}
        open_ = [k for k in open_ if k not in above]
    return got


def nearest(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        out[int(ids[q])] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != ids[q]][:k]
    return out


def units(t, kind):
    """Lines, or the sentences of lines, each with what follows it up to the next."""
    out = []
    for line in re.split(r"(?<=\n)", t):
        if kind == "sentence":
            out += [line[a:b] for a, b in _between(line)]
        elif line:
            out.append(line)
    return out


def _between(line):
    ends = [m.end() for m in re.finditer(r"[.!?][ \t]+\n?", line)]
    edges = sorted({0, *ends, len(line)})
    return list(zip(edges, edges[1:]))


def line_dedup(docs, kind="sentence", min_words=20):
    """[(id, text, spans)] for rows with an id and a text, in order; the first of equal rows is done before the others."""
    seen, out = set(), []
    for i, t in sorted(d for d in docs if d[0] is not None and d[1] is not None):
        us = units(t, kind)
        ws = [tuple(words(fold(u))) for u in us]
        again = []
        for w in ws:
            again.append(bool(w) and w in seen)
            if w:
                seen.add(w)
        gone, run = set(), []
        for n in range(len(us) + 1):
            if n < len(us) and again[n]:
                run.append(n)
            elif n == len(us) or ws[n]:
                if sum(len(ws[k]) for k in run) >= min_words:
                    gone |= set(run)
                run = []
        at, keep, spans = 0, [], []
        for n, u in enumerate(us):
            if n in gone:
                spans.append((n, at, at + len(u)))
            else:
                keep.append(u)
            at += len(u)
        out.append((i, "".join(keep), spans))
    return out


# ---------------------------------------------------------------- Feistel pseudonyms, sign by sign


def feistel(value, key, rounds=8, hexadecimal=False, letters=26):
    import hashlib

    def turn(half, other, r):
        out = []
        for i, ch in enumerate(half):
            part = hashlib.sha512(f"{key}|{len(value)}|{r}|{i // 32}|{other}".encode()).hexdigest()
            step = int(part[i % 32 * 4 : i % 32 * 4 + 4], 16)
            if hexadecimal:
                out.append("0123456789abcdef"[(int(ch, 16) + step) % 16])
                continue
            for base, size in (("0", 10), ("a", letters), ("A", letters)):
                if ord(base) <= ord(ch) < ord(base) + (10 if base == "0" else 26):
                    ch = chr(ord(base) + (ord(ch) - ord(base) + step) % size)
                    break
            out.append(ch)
        return "".join(out)

    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for r in range(rounds):
        if r % 2 == 0:
            right = turn(right, left, r)
        else:
            left = turn(left, right, r)
    return left + right


def feistel_number(n, left, right, key, rounds=8):
    import hashlib

    a, b = divmod(n, right)
    noise = lambda r, other: int(hashlib.sha256(f"{key}|{r}|{other}".encode()).hexdigest()[:12], 16)
    for r in range(rounds):
        if r % 2 == 0:
            b = (b + noise(r, a)) % right
        else:
            a = (a + noise(r, b)) % left
    return a * right + b


def luhn(digits):
    """The check digit that goes behind the digits."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def pseudonym(kind, value, key):
    import datetime as dt

    if kind == "email":
        box, domain = value.split("@", 1)
        return feistel(box, f"{key}|email") + "@" + domain
    if kind == "card":
        digits = re.sub("[^0-9]", "", value)
        body = feistel(digits[:-1], f"{key}|card")
        new = iter(body + luhn(body))
        return "".join(next(new) if ch.isdigit() else ch for ch in value)
    if kind == "iban":
        body = feistel(value[4:], f"{key}|iban")
        number = int("".join(str(int(ch, 36)) for ch in body + value[:2] + "00"))
        return f"{value[:2]}{98 - number % 97:02d}{body}"
    if kind == "ip":
        n = 0
        for o in value.split("."):
            n = n * 256 + int(o)
        n = feistel_number(n, 65536, 65536, f"{key}|ip")
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        areas = [a for a in range(1, 900) if a != 666]
        n = feistel_number((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, f"{key}|ssn")
        return f"{areas[n // 9999 // 99]:03d}-{n // 9999 % 99 + 1:02d}-{n % 9999 + 1:04d}"
    if kind == "phone":
        head = re.match(r"(\+[0-9]{1,3}[ \-]?)?", value)[0]
        rest = value[len(head) :]
        new = iter(feistel(re.sub("[^0-9]", "", rest), f"{key}|phone"))
        return head + "".join(next(new) if ch.isdigit() else ch for ch in rest)
    if kind == "date":
        day, blocks = dt.date.fromisoformat(value).toordinal() - 1, [(0, 37_495, 5, 7499, "first"), *((37_495 + 72_900 * k, 72_900, 270, 270, "middle") for k in range(49)), (3_609_595, 42_464, 32, 1327, "last")]
        at, _, a, b, name = next(x for x in blocks if x[0] <= day < x[0] + x[1])
        return dt.date.fromordinal(at + feistel_number(day - at, a, b, f"{key}|date|{name}") + 1).isoformat()
    upper, lower = re.search("[A-F]", value), re.search("[a-f]", value)
    if upper and lower:
        return feistel(value, f"{key}|secret", letters=6)
    new = feistel(value.lower(), f"{key}|SECRET" if upper else f"{key}|secret", hexadecimal=True)
    return new.upper() if upper else new
