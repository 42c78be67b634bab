"""Brute-force versions of the operators' results, in plain Python."""
import hashlib
import math
import re
import string
from collections import Counter, defaultdict

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def quality(text):
    w, t = words(text), text or ""
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    counts, repeated = Counter(windows), set()
    for i, x in enumerate(windows):
        if counts[x] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)),
            len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w))


def secrets(text, kinds, classes, allow):
    t, base = text or "", []
    key = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k)
                   for k in ("password", "passwd", "secret", "token", "api_?key"))
    for m in re.finditer("(?:" + key + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 12:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    spans = list(base)
    for k, c in enumerate(classes, 3):
        for m in re.finditer(c.regex, t):
            allowed = [x.span() for x in re.finditer("|".join(f"(?:{a})" for a in allow), m[0])]
            for lo, hi in zip([0] + [e for _, e in allowed], [s for s, _ in allowed] + [len(m[0])]):
                v = m[0][lo:hi]
                if not re.search(c.needs, v):
                    continue
                high = []
                for i in range(len(v) - c.window + 1):
                    n = Counter(v[i:i + c.window]).values()
                    if -sum(x / c.window * math.log2(x / c.window) for x in n) >= c.bits - 1e-9:
                        high.append(i)
                if high:
                    spans.append((m.start() + lo + high[0], k, m.start() + lo + high[-1] + c.window))
    show = lambda s: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(s))
    return tuple(sum(s[1] == k for s in base) for k in range(3)) + (sha(show(base)), show(spans))


def contamination(docs, items, width=10):
    def low_words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    windows = defaultdict(set)
    for i, t in items:
        w = low_words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k:k + width])].add(i)
    out = []
    for d, t in docs:
        w, hit, found = low_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k:k + n])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def near_components(docs):
    def shingles(t):
        w = words((t or "").translate(LOW))
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in docs]
    holders, both = defaultdict(list), Counter()
    for i, s in enumerate(sets):
        for x in s if docs[i][0] is not None else ():
            holders[x].append(i)
    for h in holders.values():
        both.update((a, b) for n, b in enumerate(h) for a in h[:n])
    up = {d: d for d, _ in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            p, q = root(docs[a][0]), root(docs[b][0])
            up[max(p, q)] = min(p, q)
    return [(d, len(s), root(d), d is None or root(d) == d) for (d, _), s in zip(docs, sets)]


def without_repeats(docs, width=50):
    first, out = {}, []
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - width + 1 if d is not None else 0):
            x = tuple(w[k:k + width])
            first[x] = min(first.get(x, d), d)
    for d, t in docs:
        w, gone = words(t), set()
        for k in range(len(w) - width + 1 if d is not None else 0):
            if first[tuple(w[k:k + width])] < d:
                gone |= set(range(k, k + width))
        out.append((d, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return out


def url(u, rules):
    host = path = ""
    if u and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].translate(LOW)
        path = re.match(r"[^?#]*", rest[len(re.match(r"[^/?#]*", rest)[0]):])[0]
    fit = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: (r.host.count("."), len(r.path), r.action == "block"), default=None)
    return host, path, best and best.host + best.path, best.action if best else "allow"
