"""Plain single-process versions of the corpus operators, for comparison on small tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def exact(rows):
    text = {(i, t): re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[text[i, t]].append(i)
    out = set()
    for (i, t), n in text.items():
        ids = [k for k in groups[n] if k is not None]
        keep = min(ids) if ids else None
        out.add((i, keep, len(groups[n]), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return out


def contamination(rows, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = {}
    for item, t in items:
        w = words(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = set()
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[x]
        out.add((i, len(w), len(hit), ",".join(sorted(found))))
    return out


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1)))


def jaccard(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    inverted = collections.defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            inverted[x].append(k)
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k, (_, s) in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in inverted[x] if j > k).items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                up[root(k)] = root(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets)), key=str)


def repeats(rows):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k:k + 50], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49 if i is not None else 0):
            if first[b[k:k + 50]] < i:
                gone[k:k + 50] = b"\1" * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        n = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def base_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        doubled = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def dropped_lines(rows, min_docs, similar=0.8, depth=3):
    """Line numbers dropped per row, by one pass over each leaf's shapes in the order of their text."""
    def shape(line):
        tokens = re.findall(r"[^\x20\x09-\x0D]+", line)
        return tuple("<*>" if re.search("[0-9]", t) else t for t in tokens)

    lines = [(r, k, shape(line)) for r in set(rows) for k, line in enumerate((r[1] or "").split("\n")) if shape(line)]
    leaves = collections.defaultdict(set)
    for _, _, s in lines:
        leaves[len(s), s[:depth]].add(s)
    name = {}
    for leaf, shapes in leaves.items():
        made = []
        for s in sorted(shapes, key=" ".join):
            agree = [sum(a == b for a, b in zip(t, s)) for t in made]
            best = max(range(len(made)), key=lambda k: (agree[k], -k), default=None)
            if best is not None and agree[best] >= similar * len(s):
                made[best] = tuple(a if a == b else "<*>" for a, b in zip(made[best], s))
            else:
                best = len(made)
                made.append(s)
            name[s] = (leaf, best)
        for s in shapes:
            name[s] = made[name[s][1]]
    docs = collections.defaultdict(set)
    for r, _, s in lines:
        docs[name[s]].add(r)
    out = collections.defaultdict(list)
    for r, k, s in lines:
        if len(docs[name[s]]) >= min_docs:
            out[r].append(k)
    return {r: sorted(out[r]) for r in set(rows)}


def spelling(rows, one_in=199, least_chars=6, least_count=5, ratio=5):
    counts = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % one_in == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least_chars:
                counts[w] += 1
    n = {w: k for w, k in counts.items() if k >= least_count}
    letters = {c for w in n for c in w}
    near = {}
    for w in n:
        edits = {w[:k] + w[k + 1:] for k in range(len(w))}
        edits |= {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in letters}
        edits |= {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        near[w] = sorted((-n[e], e) for e in edits & n.keys() - {w})
    form = {w: v[0][1] if v and -v[0][0] >= ratio * n[w] else None for w, v in near.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out, key=str)


def infill(rows, seed=1):
    out = []
    for i, t in rows:
        t = t or ""
        d = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(d[k:k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(t) + 1), h2 % (len(t) + 1)))
        if not t or h3 % 100 >= 90 or any(m in t for m in ("<P>", "<S>", "<M>")):
            out.append((i, len(t), "plain", None, None, t))
        elif h4 % 100 < 20:
            out.append((i, len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"))
        else:
            out.append((i, len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"))
    return sorted(out, key=str)
