"""Plain one-process versions of what the operators must return, from lists of rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
GAPS = re.compile(r"[\x20\x09-\x0D]")
UP = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """sizes: source -> words. The contract as it reads: share by weight, stop at the cap, reshare the excess."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, open_, money = dict.fromkeys(sizes, 0.0), set(sizes), share * sum(sizes.values())
    while open_ and money > 1e-9 * max(1, sum(sizes.values())):
        unit = money / sum(w[s] for s in open_)
        money = 0.0
        for s in sorted(open_, key=str):
            out[s] += unit * w[s]
            if out[s] >= cap * sizes[s]:
                money += out[s] - cap * sizes[s]
                out[s] = cap * sizes[s]
                open_ = open_ - {s}
    return out


def url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(UP), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path, rules):
    fit = []
    for what, r in rules:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(r), r, what))
    return max(fit)[1:] if fit else (None, None)


def copies(rows):
    """rows: (doc_id, text) -> doc_id -> (keep_id, group_size, kept, sha)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[GAPS.sub("", t or "")].append((-len(t or ""), i))
    out = {}
    for k, g in groups.items():
        keep = min(g)[1]
        for _, i in g:
            out[i] = (keep, len(g), i == keep, hashlib.sha256(k.encode()).hexdigest())
    return out


def quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if times[g] > 1:
            hit |= {i, i + 1, i + 2}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def simhash(text):
    w = words((text or "").translate(UP))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(rows, near):
    """rows: (id, value) -> id -> smallest id reachable over near(value, value)."""
    ids, at = [i for i, _ in rows], {i: i for i, _ in rows}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if near(rows[a][1], rows[b][1]):
                x, y = root(rows[a][0]), root(rows[b][0])
                at[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def base_score(rows):
    """rows: (doc_id, text) -> doc_id -> (held_out, n_tokens, n_known, N, base)."""
    tok = {i: [*words((t or "").translate(UP)), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tok}
    c = Counter(w for i, x in tok.items() if not held[i] for w in x)
    n = sum(c.values())
    return {i: (held[i], len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + len(c) + 1)) for w in x)) for i, x in tok.items()}


def secrets(text):
    found = []
    text = text or ""
    for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 12 else []
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))
    return [sum(f[2] == k for f in found) for k in ("assign", "access", "hex")], hashlib.sha256(said.encode()).hexdigest(), said


def records(rows):
    """rows: (page_id, html) -> page_id -> (bytes, digest, type, refers_to)."""
    pay = {i: (h or "").encode() for i, h in rows}
    first = {}
    for i in sorted(pay):
        first.setdefault(pay[i], i)
    return {i: (len(p), hashlib.sha256(p).hexdigest(), *(("revisit", first[p]) if len(p) >= 100 and first[p] != i else ("response", None))) for i, p in pay.items()}
