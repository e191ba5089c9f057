"""Plain versions of what the operators return: by definition, on small inputs, without Spark."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from zlib import crc32

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
Doc = tuple[int, str | None]


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def spaced(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def contamination(docs: list[Doc], items: list[Doc], n: int = 13) -> list[tuple]:
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    grams = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            grams[tuple(w[i : i + n])].add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for gram, names in grams.items():
            for i in range(len(w) - len(gram) + 1):
                if w[i] == gram[0] and tuple(w[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found |= names
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def base_secrets(docs: list[Doc]) -> list[tuple]:
    out = []
    for doc, text in docs:
        found = [(m.start(), 0, m.end()) for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text or "") if len(m[2]) >= 6 and m[1].isascii()]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        kinds = Counter(k for _, k, _ in found)
        shown = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        out.append((doc, kinds[0], kinds[1], kinds[2], sha(shown)))
    return out


def byte_repeats(docs: list[Doc], n: int = 50) -> list[tuple]:
    first: dict[bytes, int] = {}
    for doc, text in docs:
        t = (text or "").encode()
        for i in range(len(t) - n + 1):
            first[t[i : i + n]] = min(first.get(t[i : i + n], doc), doc)
    out = []
    for doc, text in docs:
        t, gone = (text or "").encode(), set()
        for i in range(len(t) - n + 1):
            if first[t[i : i + n]] < doc:
                gone |= set(range(i, i + n))
        out.append((doc, len(t), len(gone), sum(i - 1 not in gone for i in gone), sha(bytes(t[i] for i in range(len(t)) if i not in gone))))
    return out


def word_repeats(docs: list[Doc], n: int = 20) -> list[tuple]:
    first: dict[tuple, tuple] = {}
    for doc, text in docs:
        w = spaced(text)
        for i in range(len(w) - n + 1):
            first[tuple(w[i : i + n])] = min(first.get(tuple(w[i : i + n]), (doc, i)), (doc, i))
    out = []
    for doc, text in docs:
        w, gone = spaced(text), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (doc, i):
                gone |= set(range(i, i + n))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def jaccard(docs: list[Doc], n: int = 4, percent: int = 85) -> list[tuple]:
    sets = {}
    for doc, text in docs:
        w = spaced((text or "").translate(UPPER))
        sets[doc] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    owners = defaultdict(list)
    for doc, s in sets.items():
        for x in s:
            owners[x].append(doc)
    up = {d: d for d in sets}

    def top(d: int) -> int:
        while up[d] != d:
            d = up[d]
        return d

    for a, s in sets.items():
        for b, both in Counter(d for x in s for d in owners[x] if d < a).items():
            if 100 * both >= percent * (len(s) + len(sets[b]) - both):
                up[max(top(a), top(b))] = min(top(a), top(b))
    return [(d, len(sets[d]), top(d)) for d, _ in docs]


def unigram(docs: list[Doc]) -> list[tuple]:
    import math

    tokens = {d: [*spaced((t or "").translate(UPPER)), None] for d, t in docs}
    held = {d: crc32(str(d).encode()) % 5 == 1 for d in tokens}
    counts = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    total = sum(counts.values())
    down = total + 0.5 * (len(counts) + 1)
    return [(d, held[d], len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 0.5) / down) for w in ws)) for d, ws in tokens.items()]


def fill_in_middle(docs: list[Doc], seed: int = 42, rate: int = 50, spm: int = 80) -> list[tuple]:
    out = []
    for doc, text in docs:
        t = text or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        h = [int(sha(f"{seed}:{doc}")[i : i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
            out.append((doc, len(units), "plain", None, None, sha(t), sha(t)))
        else:
            form, o = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
            out.append((doc, len(units), form, len(p), len(m), sha(o), sha(t)))
    return out


def divergence(docs: list[tuple], least: int = 3, top: int = 200) -> list[tuple]:
    """docs: text, lang, source."""
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))) for text, lang, source in docs]
    out = []
    for lang in {x[0] for x in terms}:
        of = Counter(t for x, _, ws in terms if x == lang for t in set(ws))
        kept = sorted(t for t, n in of.items() if n >= least)
        groups: dict[str, Counter] = defaultdict(Counter)
        for x, source, ws in terms:
            if x == lang:
                groups[source].update(w for w in ws if of[w] >= least)
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (c.total() + len(kept))  # noqa: B023, E731
        gap = lambda p, q: (p - q) ** 2 // q
        everything = sum(groups.values(), Counter())
        for source, c in groups.items():
            pair = [(other, sum(gap(share(c, t), share(d, t)) for t in kept)) for other, d in groups.items() if other != source]
            term = [(t, gap(share(c, t), share(everything, t))) for t in kept if c[t] and share(c, t) > share(everything, t)]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return out
