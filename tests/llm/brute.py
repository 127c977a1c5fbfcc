"""Plain Python versions of the query contracts, over lists of rows."""

import hashlib
import re
import zlib


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def decontaminate(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(lower(t or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    lengths = {len(k) for k in windows}
    for d, t in docs:
        w = word.findall(lower(t or ""))
        hit, found = set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        yield d, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def private(docs):
    only = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only(m)) <= 19 and luhn(only(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only(m)) <= 15),
    ]
    for d, t in docs:
        spans = []
        for n, (_, p, ok) in enumerate(kinds):
            spans += [(m.start(), n, m.end()) for m in re.finditer(p, t or "") if ok(m[0])]
        spans.sort()
        yield d, *[sum(s[1] == n for s in spans) for n in range(4)], sha(",".join(f"{kinds[n][0]}:{a}:{b}" for a, n, b in spans))


def chats(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        yield c, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)


def edited(docs):
    docs = sorted(docs)
    for k, (d, t) in enumerate(docs):
        t, following = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        yield d, len(t), sha(t[: len(t) - half] + following[:half])


def sizes(docs):
    for d, t in docs:
        raw = t.encode() if t is not None else b""
        yield d, len(raw) + 16, zlib.crc32(raw)


def simhash(docs, k=4, radius=4):
    import xxhash

    fps = {}
    rows = []
    for d, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fp = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0
        rows.append((d, fp))
        fps.setdefault(fp, []).append(d)
    nodes = sorted(fps, key=lambda f: min(fps[f]))
    name = {}
    for f in nodes:
        if f in name:
            continue
        todo, name[f] = [f], min(fps[f])
        while todo:
            x = todo.pop()
            for y in nodes:
                if y not in name and (x ^ y).bit_count() <= radius:
                    name[y] = name[f]
                    todo.append(y)
    return [(d, f"{f:016x}", name[f]) for d, f in rows]


def unigram(docs):
    import math
    from collections import Counter

    held = lambda d: zlib.crc32(str(d).encode()) % 5 == 1 if d is not None else False
    tokens = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")), None]) for d, t in docs]
    count = Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(count.values()), len(count)
    for d, ws in tokens:
        yield d, held(d), len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)


def repeats(docs, length):
    raws = [(d, (t or "").encode()) for d, t in docs]
    count = {}
    for _, r in raws:
        for i in range(len(r) - length + 1):
            w = r[i : i + length]
            count[w] = count.get(w, 0) + 1
    for d, r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if count[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone) if not g)
        yield d, len(r), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()


def shared(docs, core, reach, anchors):
    """doc_id: whether it has `core` bytes at an anchor that an anchor of another document has too."""
    raws = [(d, (t or "").encode()) for d, t in docs]
    strings = [{r[p : p + core] for p in anchors(r)[0].tolist()} for _, r in raws]
    count = {}
    for mine in strings:
        for x in mine:
            count[x] = count.get(x, 0) + 1
    return {d: any(count[x] > 1 for x in mine) for (d, _), mine in zip(raws, strings)}
