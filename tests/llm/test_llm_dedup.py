import random

import numpy as np
import pytest
from corpus import SCHEMA, WHITE, awkward, near, repeats, split, table, texts, words
from pyspark.sql import functions as F

from hoopframe.llm import common, exact_dedup, line_dedup, minhash, suffixes, windows


def test_exact_groups(spark):
    items = texts(1) + ["a b c"] * 40
    rows = {r.doc_id: r for r in exact_dedup.exact_groups(table(spark, items)).collect()}
    groups = {}
    for i, t in enumerate(items):
        groups.setdefault(WHITE.sub("", t or ""), []).append(i)
    for members in groups.values():
        keep = min(members, key=lambda i: (-len(items[i] or ""), i))
        for i in members:
            assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (keep, len(members), i == keep)


def test_exact_edge_cases(spark):
    docs = awkward(spark)
    out = exact_dedup.exact_groups(docs)
    assert out.count() == docs.count()
    assert out.groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("n")).where("n <> 1").isEmpty()
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == out.where("kept").count() == out.select("text_sha256").distinct().count()
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0


def plain_lines(rows):
    first, out = {}, {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            part = tuple(lines[p:p + 3])
            if not WHITE.sub("", "".join(part)):
                continue
            if part not in first:
                first[part] = (i, p)
                continue
            d, q = first[part]
            gone |= set(range(max(p, q + 3) if d == i else p, p + 3))
        out[i] = (len(lines), sorted(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_lines(spark):
    body = ["a", "b", "c", "d", "e"]
    items = ["\n".join(body), "\n".join(["x", *body[:3], "y"]), "\n".join(["q"] * 9), "a\nb", None, "\n\n\n\n\n", "\n".join(body + body), "\n".join(body[1:])]
    want = plain_lines(enumerate(items))
    got = {r.doc_id: (r.n_lines, list(r.removed), r.text) for r in line_dedup.dedup_lines(table(spark, items)).collect()}
    assert got == want
    docs = awkward(spark)
    assert line_dedup.dedup_lines(docs).count() == docs.count()
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 8), (10, 10), (4, 3), (20, 19), (19, 18), (18, 17), (17, 16), (16, 30)]
    got = {r.v: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 16: 16, 17: 16, 18: 16, 19: 16, 20: 16, 30: 16}


@pytest.mark.parametrize("k", [4, 5])
def test_near_groups(spark, k):
    rows = list(enumerate(texts(k)))
    sets, want = near(rows, k, 80)
    got = minhash.near_groups(table(spark, [t for _, t in rows]), k, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_most_shared_never_falls_below_what_is_shared(spark):
    rng = np.random.default_rng(5)
    rows, want = [], []
    for n in (3, 40, 150, 4000):  # with 4000 shingles every group of the marks is taken
        z = rng.integers(0, 2**64, n, np.uint64)
        for share in (0.02, 0.1, 0.5, 1.0):
            sides = []
            common_ = rng.integers(0, 2**64, 6, np.uint64)
            for _ in range(2):
                gone = rng.random(n) < share
                sides.append((z[~gone], common_[rng.random(6) < 0.5], minhash.marks(z[gone]).tolist()))
            (x, u, p), (y, w, q) = sides
            rows.append((len(x), len(x) + len(u), p, len(y), len(y) + len(w), q))
            want.append(len(np.intersect1d(x, y)) + len(np.intersect1d(u, w)))
    df = spark.createDataFrame(rows, "i long, s long, lacks array<long>, c_i long, c_s long, c_lacks array<long>").coalesce(1)
    got = [r[0] for r in df.select(minhash.most_shared()).collect()]
    assert all(g >= t for g, t in zip(got, want)) and sum(g - t for g, t in zip(got[:12], want)) < 60


def test_near_edge_cases(spark):
    docs = awkward(spark)
    out = minhash.near_groups(docs)
    assert out.count() == docs.count()
    left = minhash.drop_near(docs)
    assert left.columns == docs.columns and left.count() == out.where("kept").count()
    assert minhash.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeated_passages(spark):
    rows = list(enumerate(texts(7)))
    got = suffixes.repeated_passages(table(spark, [t for _, t in rows]))
    assert {(r.doc_id, r.start, r.end) for r in got.collect()} == repeats(rows, 50)
    assert got.where("other_id = doc_id").isEmpty()


def test_passages_held_by_pairs_with_decoys(spark):
    """Suffixes whose nearest neighbour on the right shares less than another one on the left."""
    import random
    from corpus import words
    rng = random.Random(4)
    left, middle, right = words(rng, 40), words(rng, 25), words(rng, 40)
    items = [" ".join(words(rng, 30) + a + words(rng, 30)) for a in (left + middle, middle + right, left + middle, words(rng, 9) + middle, middle + right)]
    rows = list(enumerate(items))
    assert {(r.doc_id, r.start, r.end) for r in suffixes.repeated_passages(table(spark, items)).collect()} == repeats(rows, 50)


def test_passages_with_frequent_cores(spark):
    """Parts of a passage of two documents, each too short to count, that many other documents hold."""
    import random
    from corpus import words
    rng = random.Random(6)
    left, middle, right, core = words(rng, 10), words(rng, 30), words(rng, 10), words(rng, 44)

    def inside(part):
        return " ".join(words(rng, 30) + part + words(rng, 30))
    edges = [words(rng, 3), words(rng, 3)]
    whole = [inside(left + middle + right), inside(edges[0] + core + edges[1])]
    others = [inside(x) for _ in range(500) for x in (left + middle, middle + right, core)]
    items = others[:700] + whole + others[700:] + [inside(left + middle + right), inside(edges[0] + core + edges[1])]
    rows = list(enumerate(items))
    want = repeats(rows, 50)
    assert len(want) == 4
    assert {(r.doc_id, r.start, r.end) for r in suffixes.repeated_passages(table(spark, items)).collect()} == want


def test_near_passages_cover_exact_ones(spark):
    rows = list(enumerate(texts(8)))
    spans = {}
    for r in windows.near_passages(table(spark, [t for _, t in rows])).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    exact = repeats(rows, 50)
    found = [x for x in exact if any(min(b, x[2]) - max(a, x[1]) >= 0.8 * (x[2] - x[1]) for a, b in spans.get(x[0], []))]
    assert len(found) >= 0.95 * len(exact)
    clean = [i for i, t in rows[10:60] if i not in {x[0] for x in exact}]
    assert not set(clean) & set(spans)


def test_near_passages_of_pairs_with_frequent_shingles(spark):
    """A passage of two documents only, whose minima are mostly phrases that many other documents have too."""
    import random

    import numpy as np
    from corpus import words
    rng = random.Random(12)
    passages, phrases = [], set()
    for _ in range(8):
        p = words(rng, 50)
        values, _, pos = common.Words([" ".join(p)]).shingles(windows.SHINGLE)
        for k in range(windows.HASHES - 1):
            at = int(pos[np.maximum(windows.mix(values ^ windows._SEEDS[k]), np.uint64(1)).argmin()])
            phrases.add(tuple(p[at:at + windows.SHINGLE]))
        passages.append(p)
    phrases = sorted(phrases)
    stock = [words(rng, 60) for _ in range(60)]
    for w in stock:
        for x in rng.sample(phrases, len(phrases)):
            w += [*x, *words(rng, 50)]
    decoys = [" ".join(w) for w in stock]
    pairs = [" ".join(words(rng, 80) + p + words(rng, 80)) for p in passages for _ in range(2)]
    items = decoys[:30] + pairs + decoys[30:]
    rows = list(enumerate(items))
    spans = {}
    for r in windows.near_passages(table(spark, items)).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    exact = repeats(rows, 50)
    assert len(exact) == len(pairs)
    missed = [x for x in exact if not any(min(b, x[2]) - max(a, x[1]) >= 0.8 * (x[2] - x[1]) for a, b in spans.get(x[0], []))]
    assert not missed and not set(spans) - {x[0] for x in exact}


def test_compact_windows_hold_every_run():
    import numpy as np
    rng = np.random.default_rng(2)
    for least in (1, 3, 7):
        v = np.concatenate([[0], rng.integers(1, 9, 40), [0], rng.integers(1, 50, 5), [0]]).astype(np.uint64)
        got = set(zip(*(x.tolist() for x in windows.compact_windows(v, least))))
        assert all(v[c] == v[a:b + 1].min() and b - a + 1 >= least for a, c, b in got)
        for a in range(len(v)):
            for b in range(a + least - 1, len(v)):
                if v[a:b + 1].min() > 0:
                    assert sum(x <= a and b <= z and a <= c <= b for x, c, z in got) == 1


def test_passage_edge_cases(spark):
    docs = awkward(spark)
    for op in (suffixes.repeated_passages, windows.near_passages):
        assert op(docs).where("doc_id IS NULL").isEmpty()
        assert op(spark.createDataFrame([], SCHEMA)).count() == 0


def test_word_hashes_follow_words():
    items = texts(3)
    w = common.Words([t or "" for t in items])
    seen = {}
    for i, t in enumerate(items):
        mine = w.hashes[w.first[i]:w.first[i + 1]].tolist()
        assert len(mine) == len(split(t))
        for x, h in zip(split(t), mine):
            assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)


def test_near_passages_that_repeat_themselves(spark):
    rng = random.Random(4)
    line = "ka lo mi " * 30
    items = [" ".join(words(rng, 40)) + " " + line + " ".join(words(rng, 40)), " ".join(words(rng, 70)) + " " + line + " ".join(words(rng, 20)),
             "ha " * 500, "ha " * 500 + "x", "one two three four five " * 100, "x " + "one two three four five " * 90, " ".join(words(rng, 200))]
    got = windows.near_passages(table(spark, items)).collect()
    held = {i: sum(r.n_words for r in got if r.doc_id == i) for i in range(len(items))}
    assert 85 <= held[0] <= 110 and 85 <= held[1] <= 110 and held[2] >= 490 and held[3] >= 490 and held[4] >= 400 and held[5] >= 450 and held[6] == 0
    exact = suffixes.repeated_passages(table(spark, items)).collect()
    assert {(r.doc_id, r.start, r.end) for r in exact} == repeats(list(enumerate(items)), 50)


def test_exact_passages_of_texts_that_repeat_themselves(spark):
    items = ["ha " * 30_000, "ha " * 60_000, "a b c " * 5_000, "x " + "a b c " * 9_000 + "y", "b c a " * 20]
    got = {(r.doc_id, r.start, r.end) for r in suffixes.repeated_passages(table(spark, items)).collect()}
    assert got == {(0, 0, 30_000), (1, 0, 60_000), (2, 0, 15_000), (3, 1, 27_001), (4, 0, 60)}


def test_near_copies_with_any_column_names(spark):
    docs = table(spark, ["a b c d e f g"] * 3 + ["other words stand in here now"])
    kept = minhash.drop_near(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3]


def test_near_passages_whose_first_or_last_words_differ(spark):
    rng, items = random.Random(3), []
    for i in range(6):
        p = [f"w{rng.randrange(10**6)}" for _ in range(50)]
        items += [" ".join(p), " ".join(["x", *p[1:]] if i % 2 else [*p[:-1], "x"])]
    got = {(r.doc_id, r.start, r.end) for r in windows.near_passages(table(spark, items)).collect()}
    assert got == {(i, 0, 50) for i in range(len(items))}


def test_widened_parts_keep_the_threshold():
    x, y = np.arange(46), np.arange(46)
    y[:5] += 100
    assert windows.similar_parts(x, y, 46, 80) == [(0, 46, 0, 46)]  # 41 of 51
    y[5] += 100
    assert windows.similar_parts(x, y, 46, 80) == []  # 40 of 52


def test_pairs_extend_as_plain_loops_do():
    rng = np.random.default_rng(3)
    for _ in range(60):
        x, y = (np.tile(rng.integers(0, 4, rng.integers(2, 12)), 9)[:rng.integers(20, 70)] for _ in range(2))
        y[5:15] = x[2:12]
        places = [(p, q) for p in range(len(x) - 3) for q in range(len(y) - 3) if (x[p:p + 4] == y[q:q + 4]).all() and rng.random() < 0.5] or [(2, 5)]
        want, seen_x, seen_y = [], set(), set()
        by_shift = {}
        for p, q in places:
            by_shift.setdefault(q - p, []).append(p)
        for shift, starts in sorted(by_shift.items(), key=lambda s: (-len(s[1]), s[0])):
            found = set()
            for p in starts:
                if set(range(p, p + 4)) <= seen_x and set(range(p + shift, p + shift + 4)) <= seen_y:
                    continue
                a, b = p, p
                while a and a + shift and x[a - 1] == y[a + shift - 1]:
                    a -= 1
                while b < min(len(x), len(y) - shift) and x[b] == y[b + shift]:
                    b += 1
                if b - a >= 8:
                    found.add((a, a + shift, b - a))
            for a, c, n in found:
                seen_x |= set(range(a, a + n))
                seen_y |= set(range(c, c + n))
            want += sorted(found)
        p, q = np.array(places).T
        assert suffixes.extend(x, y, p, q, 8, 4) == want


def test_only_likely_pairs_meet_with_their_texts(spark):
    rng = random.Random(21)
    passage, phrase = words(rng, 60), words(rng, 12)
    items = [" ".join(words(rng, 40) + part + words(rng, 40)) for part in (passage, passage, phrase, phrase)] + [" ".join(words(rng, 90))] * 2
    docs = table(spark, items)
    key = F.expr(f"cast((key >> 32) & ~{windows.HASHES - 1} | key & {windows.HASHES - 1} as int)").alias("key")
    held = windows.windows(docs, 46, "doc_id", "text", places=True).groupBy("doc_id").agg(F.collect_set(F.struct(key, "l", "c", "r")).alias("held"))
    texts_ = docs.select("doc_id", "text").join(held, "doc_id")
    sketches = windows.sketched(texts_)
    pairs = spark.createDataFrame([(a, b) for b in range(6) for a in range(b)], "a long, b long")
    assert {(r.a, r.b) for r in windows.likely(pairs, sketches, 46, 80).collect()} == {(0, 1), (4, 5)}
    found = {(r.doc_id, r.other_id) for r in windows.verified(pairs, texts_, sketches, 46, 80).collect()}
    assert found == {(0, 1), (1, 0), (4, 5), (5, 4)}


def test_pairs_are_verified_in_slices(spark, monkeypatch):
    rng = random.Random(9)
    items = []
    for _ in range(6):
        core = words(rng, 70)
        items += [" ".join([*words(rng, 30), *core, *words(rng, 30)]) for _ in range(3)]
    docs, seen = table(spark, items), []
    whole = sorted(map(tuple, windows.near_passages(docs).collect()))
    slices = windows.verified_slice
    monkeypatch.setattr(windows, "verified_slice", lambda pairs, *given: seen.append(pairs.count()) or slices(pairs, *given))
    monkeypatch.setattr(windows, "PAIRS_A_SLICE", 3)
    assert sorted(map(tuple, windows.near_passages(docs).collect())) == whole and len(whole) == 18
    assert sum(n > 0 for n in seen) > 1 and max(seen) < sum(seen)


def test_near_passages_free_their_shuffles(spark, monkeypatch):
    from hoopframe.sources import staging
    before, held = spark.conf.get(staging.FREED_SHUFFLES), []

    def watched(df, name):
        held.append(spark.conf.get(staging.FREED_SHUFFLES))
        return staging.stage(df, name)
    monkeypatch.setattr(windows, "stage", watched)
    line = " ".join(f"w{i}" for i in range(60))
    assert windows.near_passages(table(spark, [line, line])).count() == 2
    assert held and set(held) == {"true"} and spark.conf.get(staging.FREED_SHUFFLES) == before


def test_distinct_values_of_parts():
    rng = np.random.default_rng(5)
    for v in (rng.integers(0, 9, 60), rng.permutation(40)):
        before = windows.earlier(v, np.argsort(v, kind="stable"))
        assert (before is None) == (len(set(v.tolist())) == len(v))
        assert all(windows.distinct(before, a, b) == len(set(v[a:b].tolist())) for a in range(len(v)) for b in range(a, len(v) + 1))
