"""Plain Python versions of the training-data operators, for comparison on small inputs."""

import hashlib
import html
import re

WHITE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in WHITE.split(low) if w]


def shingles(text, width=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < width else [tuple(w[i:i + width]) for i in range(len(w) - width + 1)])


def components(ids, links):
    lab = {i: i for i in ids}

    def root(x):
        while lab[x] != x:
            x = lab[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        lab[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def near_duplicates(docs):
    sets = {d: shingles(t) for d, t in docs.items()}
    ids = sorted(docs)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {d: (len(sets[d]), c) for d, c in components(ids, links).items()}


def contaminated(docs, items, window=13, agree=10):
    out = {}
    known = {}
    for i, t in sorted(items.items()):
        known.setdefault(t, i)
    for d, text in docs.items():
        w = words(text)
        for t, i in known.items():
            v = words(t)
            for diagonal in range(-len(v), len(w)):
                same = [w[p] == v[p - diagonal] for p in range(max(0, diagonal), min(len(w), len(v) + diagonal))]
                if any(sum(same[k:k + window]) >= agree for k in range(len(same) - window + 1)):
                    out.setdefault(d, set()).add(i)
                    break
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    rules = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
             "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, rule in rules.items():
        for m in re.finditer(rule, text or ""):
            v, d = m.group(0), re.sub("[^0-9]", "", m.group(0))
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")),
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def secrets(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or "", re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m.group(0)) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m.group(0)) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def digest(spans):
    return hashlib.sha256(listed(spans).encode()).hexdigest()


def article(page):
    """Text of pages whose article holds only headings and paragraphs."""
    body = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)
