"""Operators 11 to 13 against plain loops."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import compare, duck

from hoopframe.llm import importance, newer_queries, personal, trie


# --- personal data --------------------------------------------------------------------------------

def luhn(n):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (c > "4") for i, c in enumerate(reversed(n))) % 10 == 0


def base_spans(text):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        n = re.sub("[ -]", "", m[0])
        if 12 <= len(n) <= 19 and luhn(n):
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


CARD, OTHER = "4111111111111111", "5500005555555559"
PERSONAL = {
    "a@b.c_x@d.e a@b.c.x@d.e": None, "x@y.z@w.v and q@r": None, "1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.1 1.2.3": None,
    f"{CARD} {OTHER}": [f"card:0:16:{0.7}", "card:17:33:0.7"],  # two numbers side by side are one long run
    f"x 12 {CARD} 9": ["card:5:21:0.7"], f"{CARD}a {CARD[:-1]}2": None, f"order {CARD} {OTHER}": ["card:23:39:0.7"],  # words count up to the match before
    f"visa order {CARD} {OTHER}": ["card:11:27:0.7", "card:28:44:0.7"],
    "call 415-555-2671": ["phone:5:17:0.6"], "415-555-2671": [], "(415) 555-2671": ["phone:0:14:0.6"], "order (415) 555-2671": [],
    "+1 (415) 555-2671": None, "a(415) 555-2671": [], "GB82 WEST 1234 5698 7654 32": ["iban:0:27:0.7"], "DE89370400440532013000": ["iban:0:22:0.7"],
    "DE89370400440532013001": [], "xDE89370400440532013000": [], "😀😀 a@b.co ü 4111111111111111": None, "": None, None: None,
    "+49 (0) 30 123456, +1 2, +123456789012345678": None, "1-" * 200 + " a.b" * 300 + "@" * 50: None,
}


def test_personal_spans(spark):
    texts = list(PERSONAL)
    docs = corpus.frame(spark, [corpus.row(i, t, "s") for i, t in enumerate(texts)])
    reports = {r.doc_id: r for r in personal.personal_report(docs).collect()}
    found = {r.doc_id: r.spans for r in personal.find_personal(docs).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t or "")
        assert reports[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest(), t
        got = Counter(s.split(":")[0] for s in base.split(",") if s)
        assert [reports[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [got[k] for k in ("email", "ip", "card", "phone")], t
        assert all(s.value == (t or "")[s.start:s.end] for s in found[i])
        if PERSONAL[t] is not None:
            assert [f"{s.kind}:{s.start}:{s.end}:{s.score}" for s in found[i] if not s.base] == PERSONAL[t], t


def test_personal_on_long_and_random_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("0123456789.@+-() aA", k=rng.randint(0, 400))) for _ in range(300)]
    texts += ["1.1.1.1 " * 20_000, "1" * 200_000, "a.b" * 50_000 + "@x", "9 " * 50_000]
    docs = corpus.frame(spark, [corpus.row(i, t, "s") for i, t in enumerate(texts)])
    got = {r.doc_id: r.base_sha256 for r in personal.personal_report(docs).collect()}
    for i, t in enumerate(texts[:301]):
        assert got[i] == hashlib.sha256(base_spans(t).encode()).hexdigest(), t[:100]
    assert len(set(got[i] for i in range(301, 304))) == 1  # no span in any


def test_personal_sql_on_planted_rows(spark, tmp_path):
    texts = [t for t in PERSONAL] * 2
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), str(tmp_path / "documents.parquet"))
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    ok, message, _ = compare(newer_queries.op12(spark, str(tmp_path)), con, newer_queries.PERSONAL_SQL)
    assert ok, message


def test_redaction(spark):
    docs = corpus.frame(spark, [corpus.row(0, "😀 a@b.co, 4111111111111111 x", "s"), corpus.row(1, "call +1 (415) 555-2671, 1.2.3.4", "s"),
                                corpus.row(2, None, "s"), corpus.row(3, "plain", "s")])
    assert {r.doc_id: r.text for r in personal.redact(docs).collect()} == {
        0: "😀 <EMAIL>, <CARD> x", 1: "call <PHONE>, <IP>", 2: "", 3: "plain"}


# --- importance resampling ------------------------------------------------------------------------

def features(text, runs):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    out = []
    for n in range(1, runs + 1):
        out += [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return words, [zlib.crc32(f) for f in out]


def resampled(rows, target, buckets, runs, least, percent, seed="2024"):
    every = [(i, *features(t, runs)) for i, t in rows]
    s, t = Counter(f % buckets for _, _, fs in every for f in fs), Counter(f % buckets for x in target for f in features(x, runs)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_t * 0 + total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    scored = []
    for i, words, fs in every:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[f % buckets] for f in fs)
        scored.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least))
    able = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = len(able) * percent // 100
    return sorted([(*x[:4], n + 1 if n < drawn else None) for n, x in enumerate(able)] + [(*x[:4], None) for x in scored if not x[4]], key=str)


@pytest.mark.parametrize("runs,head", [(1, 20_000), (1, 3), (2, 5), (2, 20_000), (3, 50)])
def test_importance(spark, runs, head, monkeypatch):
    monkeypatch.setattr(importance, "CHUNK", 7)
    monkeypatch.setattr(importance, "HELD", 50)
    rows = corpus.awkward_rows() + [(900, "a b " * 400), (901, "Ä ö ÜBER straße 日本 " * 30)]
    docs = corpus.frame(spark, [corpus.row(i, t, "s") for i, t in rows])
    target = [t for _, t in rows[:9]] + [None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, goal, buckets=97, runs=runs, least_words=5, percent=30, head=head)
    assert sorted([tuple(r) for r in got.collect()], key=str) == resampled(rows, target, 97, runs, 5, 30)


def test_importance_empty(spark):
    docs, none = corpus.table(spark, corpus.texts(3, 5)), spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).collect() == []
    got = importance.resample(docs, none).collect()
    assert len(got) == docs.count() and all(r["rank"] is None or r.n_features >= 20 for r in got)
    chosen = importance.drawn_documents(docs, docs, percent=50)
    assert chosen.columns == docs.columns and 0 < chosen.count() < docs.count()


# --- conversation trie ----------------------------------------------------------------------------

def trie_rows(rows, rebuild=True):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    talks = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in talks.items()}
    if rebuild:
        built = {}
        for c, ts in talks.items():
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = talks.get(c - int(math.fmod(c, 5)), [])[:h] + ts[h:]
        talks = built
    members = defaultdict(list)
    for c, ts in talks.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(talks[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TALKS = "conv_id long, turn long, role string, text string, depth string, pos string, a string, node string, leaves string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x") for r in rows], TALKS).repartition(5)


def planted(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-12, 60):
        for t in range(rng.choice([0, 1, 2, 5, 9, 12, 30])):
            rows.append((c, rng.choice([t, t, t, None, 3]), rng.choice(["user", None]), rng.choice(["hi", "ho", "", None, "straße"])))
    rows += [(70 + c, t, "user", f"same {t}") for c in range(40) for t in range(11)]  # one hot path
    rows += [(1000, t, "r", str(t)) for t in range(150)] + [(1001, t, "r", str(t)) for t in range(149)]  # deep
    rows += [(None, 1, "user", "nobody's"), (5, 1, "user", "hi"), (5, 1, "user", "hi")]
    return rows


@pytest.mark.parametrize("rebuild,band", [(True, 8), (False, 8), (False, 2)])
def test_trie(spark, rebuild, band, monkeypatch):
    monkeypatch.setattr(trie, "BAND", band)
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = planted(3)
    got = trie.conversation_trie(talks(spark, rows), rebuild=rebuild)
    assert sorted([tuple(r) for r in got.collect()], key=str) == trie_rows(rows, rebuild)


def test_trie_edges(spark):
    assert trie.conversation_trie(talks(spark, [])).collect() == []
    assert trie.conversation_trie(talks(spark, [(None, 1, "a", "b")])).collect() == []
    one = [(1, None, None, None)]
    assert sorted([tuple(r) for r in trie.conversation_trie(talks(spark, one)).collect()], key=str) == trie_rows(one)
    long = [(1000, 0, "r", "ü" * 1_000_000), (1001, 0, "r", "ü" * 1_000_000), (1002, 0, "r", "ü" * 999_999 + "x")]
    assert sorted([tuple(r) for r in trie.conversation_trie(talks(spark, long), rebuild=False).collect()], key=str) == trie_rows(long, False)
