"""Plain restatements of what the training-data operators return."""

import hashlib
import itertools
import re
import unicodedata

import xxhash

UPPER = {c: c + 32 for c in range(65, 91)}
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKEN = re.compile("[^\x20\x09-\x0d]+")


def jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def windows_hit(docs, items, size=10):
    """{doc: (n_words, n_hit, items)} of (doc, text) and (item, text) rows."""
    known = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(UPPER))
        m = min(size, len(w))
        for a in range(len(w) - m + 1) if w else ():
            known.setdefault(tuple(w[a : a + m]), set()).add(i)
    out = {}
    for d, t in docs:
        w = WORD.findall((t or "").translate(UPPER))
        hit, names = set(), set()
        for m in {len(k) for k in known}:
            for a in range(len(w) - m + 1):
                if (k := tuple(w[a : a + m])) in known:
                    hit.update(range(a, a + m))
                    names |= known[k]
        out[d] = (len(w), len(hit), sorted(n for n in names if n is not None))
    return out


def simhash(text, k=4):
    w = TOKEN.findall((text or "").translate(UPPER))
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def shingles(text, k):
    w = TOKEN.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def groups(nodes, linked):
    """Smallest reachable node of each, where linked(a, b)."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def repeats(docs, length=100):
    """{doc: (n_bytes, n_removed, n_spans, kept)} of (doc, text) rows in ascending order of doc."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                mark[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, m in enumerate(mark) if m and (not i or not mark[i - 1]))
        out[d] = (len(b), sum(mark), spans, bytes(x for x, m in zip(b, mark, strict=True) if not m))
    return out


def canonical(text):
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text or "").upper().lower()).strip(" ")


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def infill(key, text, seed=42):
    """(n, form, prefix_chars, middle_chars, output) of a document."""
    text = text or ""
    units = re.findall("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+", text)
    digest = sha(f"{seed}:{'' if key is None else key}")
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    spm = h[3] % 100 < 80
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def alignment(texts, a, b, a_bytes, b_bytes):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of texts; a and b encode, *_bytes spell ids."""
    held, count = [], {}
    for text in texts:
        x, y, want = a(" " + (text or "")), b(text or ""), (" " + (text or "")).encode()
        groups = []
        if text and b"".join(map(a_bytes, x)) == want == b"".join(map(b_bytes, y)):
            ends = [{e: k + 1 for k, e in enumerate(itertools.accumulate(len(f(i)) for i in ids))} for ids, f in ((x, a_bytes), (y, b_bytes))]
            i = j = 0
            for e in sorted(set(ends[0]) & set(ends[1])):
                groups.append((x[i : ends[0][e]], y[j : ends[1][e]]))
                i, j = ends[0][e], ends[1][e]
        links = [(p, q) for g in groups for p in g[0] for q in g[1]]
        for pair in set(links):
            count[pair] = count.get(pair, 0) + 1
        held.append((groups, links))
    most = {}
    for (p, _), c in count.items():
        most[p] = max(most.get(p, 0), c)
    for groups, links in held:
        told = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        yield (
            sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(links),
            sum(count[k] == most[k[0]] for k in links), sum(count[k] for k in links), sha(told) if groups else "",
        )
