"""Small tables with every awkward case, and plain reference code for the tests."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, mark long, name string, position long, part int, score double, label string"


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, None if text is None else len(text), 1, 2, "x", None, 3, 0.5, None)


def edge_rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(20000))
    return [
        row(1, None), row(2, ""), row(3, " \t\n "), row(4, "one"), row(5, "one two three"), row(5, "one two three"),
        row(6, long, None, None), row(7, long + " more"), row(8, "Ünï çödé ünï çödé — … 漢字 漢字"), row(None, "no id here at all, none"),
        row(None, None, None, None), row(9, "a " * 300), row(10, "a " * 300), row(11, "!!! ??? ***"), row(12, "12 34 56 78"),
        row(13, "same text, other id"), row(14, "same text, other id"), row(14, "another text of the same id"), row(15, "x\r\ny\n\nz"),
        row(16, "<|endoftext|> it's a <|startoftext|> don't!"),
    ]


def near_rows(n=120, seed=3, families=6, words=60):
    """Families of near copies with random edits, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(words)] for _ in range(families)]
    out = []
    for i in range(n):
        own = list(rng.choice(bases)) if rng.random() < 0.8 else [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        out.append(row(i, " ".join(own)))
    return out


_LOWER = {c: c + 32 for c in range(65, 91)}


def solid(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_LOWER))


def lower(text):
    return (text or "").translate(_LOWER)


def components(rows, width, percent, words=solid):
    """Smallest id reachable by links, by comparing all pairs; for distinct ids."""
    sets = {}
    for doc, text, *_ in rows:
        w = words(lower(text))
        sets[doc] = set() if not w else {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}
