import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from helpers import awkward, clashing, docs
from pyspark.sql import functions as F

from slotcast.llm import decontaminate, language_id, near_dup, queries

WORD = re.compile(decontaminate.WORD)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- op2 ---------------------------------------------------------------------------------------------------------------


def brute_hits(text, items):
    words, hit, found = WORD.findall(lower(text)), set(), set()
    for item_id, item in items:
        w = WORD.findall(lower(item))
        for i in range(max(1, len(w) - 12) if w else 0):
            window = w[i : i + 13]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("max_patterns", [200_000, 7])
def test_contamination_against_brute_force(spark, max_patterns):
    rng = random.Random(2)
    vocabulary = ["a", "b", "Ü", "x1", "the", "of"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(20)), (2, say(14)), (3, "Only three words"), (4, "word"), (5, None), (6, ""), (7, say(13)), (8, say(30)), (8, say(30)), (None, say(13))]
    texts = [say(200) for _ in range(6)] + [items[0][1] + " , " + items[1][1], "x only THREE-words y", items[7][1] * 2, "a", "", None, "word"]
    table = docs(spark, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(table, bench, max_patterns=max_patterns).collect()}
    known = [(i, t) for i, t in items if i is not None]
    for i, text in enumerate(texts):
        n, hit, found = brute_hits(text, known)
        assert (got[i]["n_words"], got[i]["n_hit"], sorted(got[i]["items"])) == (n, hit, found)
        assert got[i]["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_window_shared_by_many_items_is_split_over_shards(spark):
    bench = spark.createDataFrame([(i, "one shared line") for i in range(60)], "item_id long, text string")
    row = decontaminate.contamination(docs(spark, [(1, "see one Shared line. here")]), bench, max_patterns=10).first()
    assert (row["n_hit"], sorted(map(int, row["items"]))) == (3, list(range(60)))


def test_contamination_awkward(spark):
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    rows = decontaminate.contamination(clashing(awkward(spark)), bench).collect()
    assert len(rows) == 10 and sum(r["contaminated"] for r in rows) == 2
    empty = decontaminate.contamination(awkward(spark).limit(0), bench)
    assert empty.count() == 0
    none = decontaminate.contamination(awkward(spark), bench.limit(0))
    assert none.where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(awkward(spark), bench).columns == awkward(spark).columns


# --- op3 ---------------------------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", lower(text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: 1 << 70)  # above every id
    for i, x in enumerate(ids):
        least[root(i)] = min(least[root(i)], x)
    return [least[root(i)] for i in range(len(ids))]


def test_fingerprints_and_classes_on_documents(spark, sf):
    rows = queries.op3_simhash(spark, sf).collect()
    text = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    assert len(rows) == len(text)
    ids = sorted(text)
    fps = [brute_fingerprint(text[i]) for i in ids]
    want = dict(zip(ids, zip((f"{f:016x}" for f in fps), brute_components(ids, fps))))
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == want


@pytest.mark.parametrize("hot", [2048, 8])
def test_links_lose_no_pair(spark, hot):
    """Also where every group is dealt anew."""
    rng = random.Random(3)
    near = rng.getrandbits(64)
    fps = {near} | {near ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(60)} | {f ^ 7 for f in list(fps)[:20]} | {0, (1 << 64) - 1, 1, 3}
    fps = sorted(fps)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    edges = near_dup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), hot)
    got = {r["node"]: r["root"] for r in near_dup.components(edges).collect()}
    for i, c in enumerate(brute_components(signed, fps)):
        assert got.get(signed[i], signed[i]) == c


def test_component_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 99), (5, 5)], "u long, v long")
    got = {r["node"]: r["root"] for r in near_dup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 99: 99, 100: 99}


def test_near_duplicates_awkward(spark):
    rows = near_dup.near_duplicates(clashing(awkward(spark))).collect()
    by = {r["doc_id"]: r["component_id"] for r in rows}
    assert len(rows) == 10 and by[2] == by[3] == by[1] == 1 and by[7] == 6 and by[4] == 4
    assert near_dup.near_duplicates(awkward(spark).limit(0)).count() == 0
    kept = near_dup.drop_near_duplicates(awkward(spark))
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 6, 8, 9]


def test_one_id_over_two_texts(spark):
    """Each class keeps a row, also where its smallest id lost in another class."""
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    kept = near_dup.drop_near_duplicates(docs(spark, [(0, a), (1, a), (1, b), (1, b), (2, b)]))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(0, a), (1, b)]


# --- op9 ---------------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, sf):
    got = queries.op9_language_id(spark, sf).join(queries.table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def brute_bits(text, counts, order):
    """PPM method C by dictionaries, byte by byte."""
    data, bits = b"\n" * order + text, 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts[k].get(data[i - k : i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            n = seen.get(data[i : i + 1])
            if n:
                bits += np.log2((total + kinds) / n)
                break
            bits += np.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def test_code_lengths_against_brute_force(spark):
    rng = random.Random(9)
    texts = {"en": ["the cat sat on the mat " * 3, "that hat"], "fr": ["le chat était là " * 4], "xx": ["zzz yyy"]}
    table = docs(spark, [(i, t, lang) for i, (lang, t) in enumerate((la, t) for la, ts in texts.items() for t in ts)])
    trees = language_id.train(table, 3)
    counts = {}
    for lang, own in texts.items():
        counts[lang] = [defaultdict(lambda: defaultdict(int)) for _ in range(4)]
        for t in own:
            data = b"\n" * 3 + t.encode()
            for i in range(3, len(data)):
                for k in range(4):
                    counts[lang][k][data[i - k : i]][data[i : i + 1]] += 1
    asked = [b"the chat", "là-bas".encode(), b"", bytes(rng.randrange(256) for _ in range(80)), b"the cat sat " * 30]
    got = trees.lengths(asked)
    want = [[brute_bits(t, counts[lang], 3) for lang in trees.langs] for t in asked]
    assert np.allclose(got, want, rtol=1e-4)


def test_long_text_in_pieces(spark, monkeypatch):
    trees = language_id.train(docs(spark, [(1, "the cat sat on the mat and that was that", "en")]), 3)
    text = b"the cat and the hat " * 50
    whole = trees.lengths([text, b"cat"])
    monkeypatch.setattr(language_id, "CHUNK", 64)
    assert np.allclose(trees.lengths([text, b"cat"]), whole, rtol=1e-5)


def test_language_awkward(spark):
    import zlib

    fr, en = [i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 4 != 2][:2]  # rows that are learned from
    rows = awkward(spark).unionByName(docs(spark, [(fr, "le chat est là", "fr"), (en, "the cat is here", "en"), (22, "12 34 !", "en"), (23, "これは日本語", None)]))
    got = {r["doc_id"]: r["found"] for r in language_id.identify(clashing(rows)).collect()}
    assert got[1]["lang"] == got[2]["lang"] == got[3]["lang"] == got[8]["lang"] == got[22]["lang"] == "und" and got[1]["score"] == 0
    assert language_id.identify(rows.limit(0)).count() == 0
    nothing = language_id.identify(docs(spark, [(1, "abc"), (2, None)])).collect()
    assert {r["found"]["lang"] for r in nothing} == {"und"}
    kept = {r["doc_id"] for r in language_id.keep_language(rows).collect()}
    assert {1, 2, 3, 8, 22, 23}.isdisjoint(kept) and {fr, en} <= kept
    assert language_id.keep_language(rows).columns == rows.columns


def test_held_out_rule(spark):
    import zlib

    rows = spark.range(200).select(F.col("id"), language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_texts_are_written_once_whatever_the_shards(spark, monkeypatch):
    """Three shards and more: one table holds texts, the passes hold places of hits."""
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(13))) for i in range(30)], "item_id long, text string")
    rows = [(i, f"before {' '.join(f'w{i % 40}x{j}' for j in range(13))} after") for i in range(80)] + [(3, None), (3, "")]
    table = docs(spark, rows)
    written = []
    plain = decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, name: written.append((name, "text" in df.columns)) or plain(df, name))
    got = {(r["doc_id"], r["text"]): r for r in decontaminate.contamination(table, bench, max_patterns=10).collect()}
    assert sum(texts for _, texts in written) == 1 and sum(name == "hits" for name, _ in written) == 3
    one = {(r["doc_id"], r["text"]): r for r in decontaminate.contamination(table, bench).collect()}
    assert got == one and sum(r["contaminated"] for r in got.values()) == 60 and len(got) == 82
