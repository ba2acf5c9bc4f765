"""Plain definitions of the operators' results, for small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return SPACE_WORD.findall(text or "")


def secrets(text):
    text, found = text or "", []
    assign = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|"""
              r"""[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for k, (kind, pattern, least) in enumerate((("assign", assign, 12), ("access", "AKIA[A-Z0-9]+", 18),
                                                ("hex", "[0-9a-f]+", 16))):
        for m in re.finditer(pattern, text):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                found.append((m.start(), k, kind, m.end()))
    found.sort()
    shown = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in found)
    count = Counter(f[2] for f in found)
    return count["assign"], count["access"], count["hex"], hashlib.sha256(shown.encode()).hexdigest()


def shingles(text):
    w = words(lower(text))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def near_duplicates(docs, percent=85):
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def quality(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i:i + 5])] > 1:
            covered.update(range(i, i + 5))
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)),
            len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for phrase, label in (("mit license", "mit"), ("apache license", "apache"),
                                               ("general public license", "gpl"))
              for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


def language_model(docs, mass, order=2):
    """(held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    tokens = [[*words(lower(t)), None] for _, t in docs]
    train = [t for (d, _), t in zip(docs, tokens, strict=True) if not held_out(d)]
    count = Counter(x for t in train for x in t)
    grams, histories = Counter(), Counter()
    for t in train:
        padded = ["begin"] * (order - 1) + [(x,) for x in t]
        for k in range(2, order + 1):
            for i in range(order - 1, len(padded)):
                gram = tuple(padded[i - k + 1:i + 1])
                grams[gram] += 1
                histories[gram[:-1]] += 1
    n, v = sum(count.values()), len(count)
    out = []
    for (d, _), t in zip(docs, tokens, strict=True):
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t)
        score, padded = 0.0, ["begin"] * (order - 1) + [(x,) for x in t]
        for i, x in enumerate(t, order - 1):
            p = (count[x] + 1) / (n + v + 1)
            for k in range(2, order + 1):
                gram = tuple(padded[i - k + 1:i + 1])
                p = (grams[gram] + mass * p) / (histories[gram[:-1]] + mass)
            score += math.log10(p)
        out.append((held_out(d), len(t), sum(count[x] > 0 for x in t), n, base, score))
    return out


def repeats(docs):
    """(n_words, n_removed, kept_sha256) by id; ids are distinct."""
    first, out = set(), {}
    for d, t in sorted(docs, key=lambda x: (x[0] is not None, x[0] or 0)):
        w = words(t)
        gone = set()
        for i in range(len(w) - 19):
            window = tuple(w[i:i + 20])
            if window in first:
                gone.update(range(i, i + 20))
            first.add(window)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out
