"""Operators 11 to 13: the Jaccard join, fill-in-the-middle and importance resampling."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from helpers import awkward, clashing, docs
from pyspark.sql import functions as F

from slotcast.llm import fill_middle, parity_join, queries, resample



def crowded(df, *names):
    """Further columns under names that operators use inside."""
    return clashing(df).withColumns({n: F.lit("x") for n in names})


# --- op11 --------------------------------------------------------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingle_set(text):
    words = WORDS.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset([" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)])


def classes_by_hand(rows, percent=90):
    """(doc_id, n, component) of every row, by comparing all pairs of different sets."""
    sets = {}
    for i, text in rows:
        sets.setdefault(shingle_set(text), []).append(i)
    keys = [s for s in sets if s]
    root = {s: s for s in keys}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for a, b in combinations(keys, 2):
        if 100 * len(a & b) >= percent * len(a | b):
            root[find(a)] = find(b)
    least = {}
    for s in keys:
        ids = [i for i in sets[s] if i is not None]
        if ids:
            least[find(s)] = min(*ids, least.get(find(s), ids[0]))
    return Counter((i, len(s := shingle_set(t)), i if not s else least.get(find(s))) for i, t in rows)


def near_copies(seed, families=6, members=14, words=(4, 12, 40, 150)):
    """Families of copies with few changed words, so that pairs lie on both sides of the limit."""
    draw = random.Random(seed)
    rows, n = [], 0
    for f in range(families):
        base = [f"w{draw.randrange(5000)}" for _ in range(draw.choice(words))]
        for _ in range(members):
            own = list(base)
            for _ in range(draw.randrange(0, 1 + max(1, len(base) // 40))):
                own[draw.randrange(len(own))] = f"x{draw.randrange(5000)}"
            if draw.random() < 0.3:
                own.append("tail")
            rows.append((n := n + 1, " ".join(own)))
    return rows


@pytest.mark.parametrize(("seed", "block"), [(1, 512), (2, 3), (3, 3)])
def test_classes_against_all_pairs(spark, seed, block):
    rows = near_copies(seed) + [(500, "One Two"), (501, "one two"), (502, "one"), (503, ""), (504, None), (505, "  \n"), (3, "one two"), (500, "One Two"), (None, "one two"), (None, "lonely null id")]
    got = Counter(tuple(r) for r in parity_join.jaccard_classes(docs(spark, rows), block=block).collect())
    assert got == classes_by_hand(rows)


def test_chain_of_links_through_one_key(spark):
    """Each text links its neighbours only: the star of a key does not reach, the search of its classes does."""
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*words[:40], *(f"y{j}" if j < 2 * i else words[40 + j] for j in range(80))])) for i in range(30)]
    draw = random.Random(5)
    draw.shuffle(rows)
    got = Counter(tuple(r) for r in parity_join.jaccard_classes(docs(spark, rows), block=4).collect())
    assert got == classes_by_hand(rows)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    for n, d in ((10, 1), (50, 4), (400, 40), (3000, 300)):
        both = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        a, b = np.sort(np.append(both, rng.integers(0, 1 << 63, d // 2 + 1).astype(np.uint64))), np.sort(np.append(both, rng.integers(0, 1 << 63, d - d // 2).astype(np.uint64)))
        apart = len(set(a.tolist()) ^ set(b.tolist()))
        for words in (1, 3, 8, 60):
            assert int(np.bitwise_count(parity_join.parity_sketch(a, words) ^ parity_join.parity_sketch(b, words)).sum()) <= apart


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_every_linked_pair_shares_a_key(percent):
    rng = np.random.default_rng(percent)
    met = 0
    for _ in range(300):
        n = int(rng.integers(5, 400))
        common = rng.integers(0, 1 << 63, n).astype(np.uint64)
        own = [rng.integers(0, 1 << 63, int(rng.integers(0, 2 + n // 8))).astype(np.uint64) for _ in "ab"]
        a, b = (np.unique(np.append(common, x)) for x in own)
        shared = len(np.intersect1d(a, b))
        if not np.array_equal(a, b) and 100 * shared >= percent * (len(a) + len(b) - shared):
            met += 1
            assert len(np.intersect1d(parity_join.band_keys(a, percent), parity_join.band_keys(b, percent)))
    assert met > 10


def test_levels_hold_all_partners():
    for percent in (50, 80, 90, 99):
        sizes = parity_join.levels(percent)
        for n in list(range(1, 400)) + [10_000, 123_456]:
            most = n * 100 // percent
            level = max(k for k, s in enumerate(sizes) if s <= n)
            assert most < sizes[level + 2]


def test_jaccard_awkward(spark):
    assert parity_join.jaccard_classes(docs(spark, [])).count() == 0
    found = parity_join.jaccard_classes(crowded(docs(spark, [(1, "a b c d"), (2, "A b  c\td")]), "n_shingles", "component_id", "digest", "rid", "tid", "keys")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 2, 1), (2, 2, 1)]
    long = "word " * 300_000 + " ".join(f"v{i}" for i in range(100_000))
    got = {r["doc_id"]: tuple(r) for r in parity_join.jaccard_classes(docs(spark, [(1, long), (2, long + " end"), (3, long.upper()), (4, "other")])).collect()}
    assert {got[i][2] for i in (1, 2, 3)} == {1} and got[4][2] == 4 and got[1][1] == len(shingle_set(long))


def test_repeated_and_unusual_rows(spark):
    table = awkward(spark)
    got = Counter(tuple(r) for r in parity_join.jaccard_classes(table).collect())
    assert got == classes_by_hand([(r["doc_id"], r["text"]) for r in table.collect()])


# --- op12 --------------------------------------------------------------------------------------------------------------


def fim_by_hand(doc_id, text):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, h = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    form = "spm" if h4 % 100 < 50 else "psm"
    return (n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def odd_texts():
    draw = random.Random(12)
    texts = ["".join(draw.choice(["a", "é", "\n", "\n", "😀", "<P", ">", "\r\n", " ", " "]) for _ in range(draw.randrange(30))) for _ in range(150)]
    return texts + [None, "", "\n", "\n\n\n", "no newline", "<P>", "a<M>\nb", "<S", "x\n" * 50_000, "y" * 2_000_000 + "\nz"]


def test_fill_in_middle_against_slices(spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a\nb\nc"), (7, "again\ntwice"), (7, "again\ntwice")]
    table = crowded(docs(spark, rows), "n", "form", "output", "_fim")
    full = fill_middle.fill_in_middle(table).select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", fill_middle.restored_text(F.col("output"), F.col("form")).alias("back"))
    got = Counter()
    for r in full.collect():
        assert r["back"] == (r["text"] or "")
        got[(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"])] += 1
    assert got == Counter((i, *fim_by_hand(i, t)) for i, t in rows)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    small = Counter(tuple(r) for r in fill_middle.digests(docs(spark, rows)).collect())
    assert small == Counter((i, *(f := fim_by_hand(i, t))[:4], digest(f[4]), digest(t or "")) for i, t in rows)
    assert {f for (_, _, f, *_) in got} == {"plain", "psm", "spm"}
    assert fill_middle.digests(docs(spark, [])).count() == 0 and fill_middle.fill_in_middle(docs(spark, [])).count() == 0


def test_pieces_split_and_stream(monkeypatch):
    monkeypatch.setattr(fill_middle, "CHUNK", 3)
    text = b"0123456789"
    whole = [fill_middle.Piece(False, 0, 10)]
    cut = fill_middle.split(fill_middle.split(fill_middle.split(whole, 4), 4), 7)
    assert [(p.start, p.end) for p in cut] == [(0, 4), (4, 7), (7, 10)]
    assert fill_middle.split(whole, 0) == fill_middle.split(whole, 10) == whole
    assert fill_middle.joined(cut[::-1], text) == b"7894560123" and fill_middle.digest(cut, text) == hashlib.sha256(text).hexdigest()
    assert max(len(v) for v in fill_middle.streamed(whole, text)) == 3


def test_what_is_no_output_is_refused():
    for bad, form in ((b"text", "psm"), (b"<S>a<P>b<M>c", "psm"), (b"x<P>a<S>b<M>c", "psm"), (b"<P>a<S>b<M>c<M>", "psm")):
        with pytest.raises(ValueError):
            fill_middle.restored(bad, form)


def test_rates_of_forms(spark):
    table = docs(spark, [(i, "a\nb\nc\nd") for i in range(2000)])
    forms = Counter(r["form"] for r in fill_middle.digests(table, rule=fill_middle.Rule(3, 60, 25)).collect())
    assert abs(forms["plain"] - 800) < 80 and abs(forms["spm"] - 300) < 60


# --- op13 --------------------------------------------------------------------------------------------------------------


def resample_by_hand(rows, target, order=1, percent=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def grams(text):
        words = word.findall(lower(text))
        return [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10_000 for k in range(1, order + 1) for i in range(len(words) - k + 1)], len(words)

    own, theirs = [grams(t) for _, t in rows], [grams(t) for t in target]
    s, t = Counter(b for g, _ in own for b in g), Counter(b for g, _ in theirs for b in g)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (all_s + 10_000) / ((s[b] + 1.0) * (all_t + 10_000))))
    out = []
    for (i, _), (g, n) in zip(rows, own):
        weight = sum(map(gain, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20])
    drawn = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    most = len(drawn) * percent // 100
    rank = {id(r): k + 1 for k, r in enumerate(drawn[:most])}
    return Counter((*r[:4], rank.get(id(r))) for r in out)


def corpus(seed=3, n=120):
    draw = random.Random(seed)
    vocabulary = [f"wört{i}" if i % 7 == 0 else f"Word{i}" for i in range(300)]
    rows = [(i, " ".join(draw.choice(vocabulary) + draw.choice(["", ",", "\n", "-x", "\x00"]) for _ in range(draw.randrange(0, 60)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, "?!"), (5, rows[5][1]), (5, rows[5][1]), (5, "other text " * 20), (None, "no id here " * 10)], [" ".join(vocabulary[:50]), None, ""]


@pytest.mark.parametrize(("order", "percent", "size"), [(1, 10, 1 << 21), (3, 100, 200), (2, 37, 1)])
def test_resampling_against_plain_counts(spark, monkeypatch, order, percent, size):
    monkeypatch.setattr(resample, "BATCH_BYTES", size)
    rows, target = corpus()
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    plan = resample.Plan(order=order, percent=percent)
    table = crowded(docs(spark, rows), "score", "rank", "weight", "_by", "bucket")
    got = Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in resample.importance_resample(table, bench, plan).collect())
    assert got == resample_by_hand(rows, target, order, percent)


def test_grams_keep_to_their_document():
    texts = [b"a b", b"", b"c", b"D e f"]
    code = lambda x: zlib.crc32(x) % 10_000
    bucket, owner, words = resample.features(texts, 2, 10_000)
    assert words.tolist() == [2, 0, 1, 3]
    assert sorted(zip(owner.tolist(), bucket.tolist())) == sorted([(0, code(b"a")), (0, code(b"b")), (0, code(b"a b")), (2, code(b"c")), (3, code(b"d")), (3, code(b"e")), (3, code(b"f")), (3, code(b"d e")), (3, code(b"e f"))])
    assert [x.tolist() for x in resample.features([b"", b"!"], 3, 10)] == [[], [], [0, 0]]


def test_resampling_awkward(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resample.importance_resample(docs(spark, []), bench).count() == 0
    got = resample.importance_resample(docs(spark, [(1, "w " * 400_000), (2, "x" * 3_000_000)]), bench).collect()
    assert {r["doc_id"]: r["n_features"] for r in got} == {1: 400_000, 2: 1} and all(r["rank"] is None for r in got)


def test_ranks_of_ties_and_repeats(spark):
    rows = [(i % 7, 5) for i in range(21)] + [(100 + i, 9) for i in range(3)] + [(50, None)]
    df = spark.createDataFrame(rows, "doc_id long, score long")
    got = sorted((r["rank"], r["doc_id"], r["score"]) for r in resample.with_rank(df, 10, "score").collect() if r["rank"])
    assert [r[0] for r in got] == list(range(1, 11))
    assert [r[1] for r in got] == [100, 101, 102, 0, 0, 0, 1, 1, 1, 2] and resample.with_rank(df, 0, "score").where("rank is not null").count() == 0


# --- against SQL on the tables -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_jaccard_join", "op12_fill_middle", "op13_resample"])
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    found = queries.QUERIES[name](spark, sf)
    assert Counter(tuple(r) for r in found.select(*want.columns).collect()) == Counter(want.fetchall())
