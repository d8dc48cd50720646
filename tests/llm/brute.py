"""Plain, slow versions of the operators to hold results against."""

from __future__ import annotations

import hashlib
import re

import numpy as np

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def contamination(docs, items, width=10):
    """{(doc_id, n_words, n_hit, ids)} as a sorted list."""
    windows = {}
    for item_id, text in items:
        ws = words(text)
        for i in range(max(1, len(ws) - width + 1) if ws else 0):
            windows.setdefault(tuple(ws[i:i + width]), set()).add(item_id)
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text in docs:
        ws, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (found := windows.get(tuple(ws[i:i + n]))):
                    hit |= set(range(i, i + n))
                    ids |= found
        joined = ",".join(sorted(map(str, ids)))
        out.append((doc_id, len(ws), len(hit), len(ids), hashlib.sha256(joined.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


KINDS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
)


def secrets(docs):
    out = []
    for doc_id, text in docs:
        found = [
            (m.start(), rank, kind, m.end())
            for rank, (kind, pattern, group, least) in enumerate(KINDS)
            for m in pattern.finditer(text or "") if len(m[group]) >= least
        ]
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found))
        n = [sum(f[2] == k[0] for f in found) for k in KINDS]
        out.append((doc_id, *n, hashlib.sha256(listed.encode()).hexdigest(), listed))
    return sorted(out, key=repr)


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in links:
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return {n: root(n) for n in nodes}


def jaccard(docs, num=75, den=100, width=5):
    """{doc_id: (n_shingles, component_id)}; ids are different and not null."""
    sets = {}
    for doc_id, text in docs:
        ws = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
        sets[doc_id] = {tuple(ws[i:i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()
    inverted, links = {}, []
    for d, s in sets.items():
        for x in s:
            inverted.setdefault(x, []).append(d)
    overlap = {}
    for ds in inverted.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1:]:
                overlap[a, b] = overlap.get((a, b), 0) + 1
    for (a, b), o in overlap.items():
        if den * o >= num * (len(sets[a]) + len(sets[b]) - o):
            links.append((a, b))
    root = roots(sets, links)
    return {d: (len(s), root[d]) for d, s in sets.items()}


def near_vectors(rows, threshold=0.95):
    """(links as a set of pairs, {vec_id: component_id})."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) and all(c is not None for c in v)]
    good = [(i, v / np.linalg.norm(v)) for i, v in good if np.isfinite(v).all() and np.linalg.norm(v) > 0]
    ids = np.array([i for i, _ in good])
    x = np.stack([v for _, v in good])
    a, b = np.nonzero(np.triu(x @ x.T >= threshold, 1))
    links = {(int(ids[i]), int(ids[j])) for i, j in zip(a, b, strict=True)}
    return links, roots([i for i, _ in rows], links)


def url_rule(url, rules):
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3:]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(LOW)
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"
