"""The contracts of the queries in plain Python, a text at a time."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def fingerprint(text, size=3) -> int:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    runs = [" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs) -> dict:
    """doc_id -> (hex, component)"""
    prints = {d: fingerprint(t) for d, t in docs}
    up = {f: f for f in prints.values()}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    values = sorted(up)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 3:
                up[find(a)] = find(b)
    low = {}
    for d, f in prints.items():
        low[find(f)] = min(d, low.get(find(f), d))
    return {d: (f"{f:016x}", low[find(f)]) for d, f in prints.items()}


def passages(docs) -> dict:
    """Texts in order of ids -> (bytes, removed, runs, digest)"""
    seen, out = set(), {}
    for d, text in sorted(docs):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            part = data[i:i + 100]
            if part in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(part)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(data), sum(gone), runs, sha(bytes(x for x, g in zip(data, gone) if not g)))
    return out


def tokens(docs, model) -> list:
    """Documents in order -> (doc_id, start, count, crc)"""
    out, at = [], 0
    for d, text in docs:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((d, at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))
        at += len(ids)
    return out


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def secrets(text) -> tuple:
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return tuple(sum(f[1] == k for f in found) for k in range(3)) + (sha(shown), shown)


def targets(docs) -> dict:
    """(doc_id, source, text) -> source -> (words, target)"""
    total = Counter()
    for _, source, text in docs:
        total[source] += len(WORD.findall(text or ""))
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, sum(total.values()), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * total[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * total[s]
            left -= target[s]
            open_.discard(s)
    return {s: (total[s], target[s]) for s in names}


PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}


def licenses(text) -> tuple:
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hits = [(i, label) for i in range(len(words)) for phrase, label in PHRASES.items()
            if tuple(words[i:i + len(phrase)]) == phrase]
    places = [i for i, _ in hits]
    return (len(words), len(hits), min(places, default=None), max(places, default=None),
            ",".join(sorted({label for _, label in hits})))


def lines(docs) -> dict:
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    for d, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    last = {k: max(h) for k, h in holders.items() if len(h) >= 3}
    out = {}
    for d, text in docs:
        every = (text or "").split("\n")
        kept = [x for x in every if last.get(key(x), d) == d]
        out[d] = (len(every), len(every) - len(kept), sha("\n".join(kept)))
    return out


def quality(text) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    runs = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    repeated = {j for i in range(len(words) - 2) if runs[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    full = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)),
            len(repeated), len(words) < 50 or 100 * len(repeated) > 50 * len(words))
