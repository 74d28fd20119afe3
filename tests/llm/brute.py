"""Plain versions of the operators, for small tables."""

import base64
import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def lower(text):
    return (text or "").translate(_LOWER)


def contamination(docs, items):
    """{row: (n_words, hit places, item ids)}"""
    windows = defaultdict(set)
    for i, text in items:
        words = WORD.findall(lower(text))
        size = min(10, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[k : k + size])].add(str(i))
    out = []
    for i, text in docs:
        words, hit, ids = WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for k in range(len(words) - size + 1):
                if found := windows.get(tuple(words[k : k + size])):
                    hit |= set(range(k, k + size))
                    ids |= found
        out.append((i, len(words), sorted(hit), sorted(ids)))
    return out


def shingle_set(text, size=5):
    words = SPACE_WORD.findall(lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def near_groups(docs, percent):
    sets = [shingle_set(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for d, s in enumerate(sets):
        for x in s:
            by[x].append(d)
    counts = defaultdict(int)
    for ds in by.values():
        for k, a in enumerate(ds):
            for b in ds[k + 1 :]:
                counts[a, b] += 1
    for (a, b), both in counts.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d, (i, _) in enumerate(docs):
        if i is not None:
            least[find(d)] = min(least.get(find(d), i), i)
    return [(i, len(sets[d]), (least.get(find(d)) if sets[d] else i)) for d, (i, _) in enumerate(docs)]


def exact_groups(docs):
    groups = defaultdict(list)
    for i, text in docs:
        groups[lower(text)].append(i)
    return {k: (max((i for i in v if i is not None), default=None), len(v)) for k, v in groups.items()}


def repeated(docs, window):
    """[(id, n_bytes, n_removed, n_spans, sha256 of the rest)]"""
    texts = [(t or "").encode() for _, t in docs]
    seen = defaultdict(int)
    for t in texts:
        for k in range(len(t) - window + 1):
            seen[t[k : k + window]] += 1
    out = []
    for (i, _), t in zip(docs, texts, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        rest = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def base_secrets(text):
    text = text or ""
    found = []
    assign = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(found)]


def base_licenses(text):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    words = WORD.findall(lower(text))
    places, labels = [], set()
    for phrase, label in phrases.items():
        wanted = phrase.split()
        for k in range(len(words) - len(wanted) + 1):
            if words[k : k + len(wanted)] == wanted:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels)


def warc(pages):
    first = {}
    for i, html in pages:
        first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, html in pages:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        response = first[html or ""] == i
        out.append((i, len(data), digest, "response" if response else "revisit", None if response else first[html or ""]))
    return out
