"""Small document tables with the awkward cases, and plain-loop versions of the operators."""

import random
import re

WHITE = re.compile(r"[\x20\x09-\x0D]")
#: The columns of documents and others whose names the operators use inside.
CLASHES = ("gone draw pattern norm digest salt lead mark time bucket comp center key score weight place spans words pos value "
           "hash first last band target source_size taken id ids").split()
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, size int, rank int, copies int, "
          + ", ".join(f"{c} string" for c in CLASHES))
SYLLABLES = "an er on re he in ed nd ha at en es of or nt ea ti to io le is".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def texts(seed=1, n=60):
    """Ordinary texts, exact and near copies, shared passages, and edge cases."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randint(3, 300))) for _ in range(n)]
    shared = " ".join(words(rng, 70))
    out = list(base)
    for t in base[:10]:
        out += [t, t.replace(" ", "\n", 3), t.upper()]
    long = words(rng, 250)
    for _ in range(25):  # near copies of one text with few to many edits
        w = list(long)
        for i in rng.sample(range(250), rng.choice([1, 3, 6, 12, 20])):
            w[i] = rng.choice(words(rng, 1))
        out.append(" ".join(w))
    out += [" ".join(words(rng, 40)) + " " + shared + " " + " ".join(words(rng, 40)) for _ in range(4)]
    out += [None, "", " \n\t", "a", "a b c", "a  b c", "日本 語 café naïve", "x" * 3000, "\n".join(["one two", "three", "four"] * 4)]
    return out


def row(i, text, source):
    return (i, text, "en", source, len(text or ""), True, "r", 3, 4, 5, *["c"] * len(CLASHES))


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def table(spark, items, sources=("b", "a", None), first=0):
    return frame(spark, [row(first + i, t, sources[i % len(sources)]) for i, t in enumerate(items)])


def awkward_rows():
    """(id, text) with repeated rows and null ids."""
    items = list(enumerate(texts(2, 12)))
    return [*items, *items[:5], (None, "no id here"), (None, None)]


def awkward(spark):
    """Repeated rows, null ids, nulls in every column."""
    rows = [row(i, t, ("b", "a", None)[(i or 0) % 3]) for i, t in awkward_rows()[:-2]]
    return frame(spark, [*rows, (None, "no id here", *[None] * (8 + len(CLASHES))), (None, None, *[None] * (8 + len(CLASHES)))])


def split(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = split(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {i: root(i) for i in ids}


def near(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = []
    for x, a in enumerate(ids):
        for b in ids[:x]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                links.append((a, b))
    return sets, components(ids, links)


def repeats(rows, least):
    """Spans of ``least`` or more words that another document holds, as (doc, start, end)."""
    held = {}
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - least + 1):
            held.setdefault(tuple(w[p:p + least]), set()).add(i)
    out = set()
    for i, t in rows:
        w, now = split(t), None
        for p in range(len(w) - least + 1):
            if len(held[tuple(w[p:p + least])]) > 1:
                if now and p <= now[1]:
                    now[1] = p + least
                else:
                    if now:
                        out.add((i, *now))
                    now = [p, p + least]
        if now:
            out.add((i, *now))
    return out
