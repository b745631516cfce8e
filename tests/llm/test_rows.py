import hashlib
import random
import re
import time

import numpy as np
import pytest
from helpers import awkward, clashing, docs
from pyspark.sql import functions as F

from slotcast.llm import ann, chat, html_text, mixing, pii, queries, token_counts, url_filter

# --- op1 ---------------------------------------------------------------------------------------------------------------


def test_token_totals_against_a_recount(spark, sf):
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in queries.op1_token_counts(spark, sf).collect()}
    encoder = token_counts._encoder("/opt/tokenizers/byte_bpe_50k.tiktoken", token_counts.PATTERN)
    toxic = {r["doc_id"] for r in queries.table(spark, sf, "labels").where("toxic = 1").collect()}
    want = {}
    for r in queries.table(spark, sf, "documents").collect():
        if r["doc_id"] not in toxic:
            n = len(encoder.encode_ordinary(re.sub(queries.JUNK, "", r["text"] or "")))
            a, b = want.get((r["source"], r["lang"]), (0, 0))
            want[r["source"], r["lang"]] = (a + 1, b + n)
    assert got == want


COUNTED = "source string, lang string, tokenizer string, n_tokens long"


def test_rollup_is_idempotent(spark, tmp_path):
    store = token_counts.TokenRollup(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", "en", "v", 5), ("a", "en", "v", 7), (None, None, "v", 1)], COUNTED)
    assert store.totals().count() == 0 and store.batches().count() == 0 and not store.committed("1")
    assert store.commit("1", token_counts.inserts(rows)) and not store.commit("1", token_counts.inserts(rows))
    store.commit("2", token_counts.revisions(rows.where("n_tokens = 5").withColumn("n_tokens_new", F.lit(3).cast("long"))))
    store.commit("3", token_counts.deletes(rows.where("source is null")))
    store.commit("4", token_counts.inserts(rows.limit(0)))
    assert not store.commit("2", token_counts.inserts(rows))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 2, 10)]
    assert {tuple(r) for r in store.batches().collect()} == {(1, "1"), (2, "2"), (3, "3"), (4, "4")}


def test_one_of_two_writers_wins(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/store"
    one, two = token_counts.TokenRollup(spark, path), token_counts.TokenRollup(spark, path)
    rows = token_counts.inserts(spark.createDataFrame([("a", "en", "v", 5)], COUNTED))
    publish = one.publish

    def late(version, batch_id, table):
        """The other writer commits between this one's reading and its commit: first another batch, then the same."""
        monkeypatch.setattr(one, "publish", publish)
        assert two.commit(other, rows)
        return publish(version, batch_id, table)

    for other, mine, won in (("x", "y", True), ("z", "z", False)):
        monkeypatch.setattr(one, "publish", late)
        assert one.commit(mine, rows) is won
    assert [tuple(r) for r in two.totals().collect()] == [("a", "en", "v", 3, 15)]
    assert sorted(r["batch"] for r in two.batches().collect()) == ["x", "y", "z"]


def test_broken_commits_and_odd_ids(spark, tmp_path):
    store = token_counts.TokenRollup(spark, f"file://{tmp_path}/store")
    rows = token_counts.inserts(spark.createDataFrame([("a", "en", "v", 5)], COUNTED))
    for i, batch_id in enumerate(["a/b", "..", "a b%2F", "é", ""]):
        assert store.commit(batch_id, rows) and store.committed(batch_id) and not store.commit(batch_id, rows)
        for marker in (tmp_path / "store" / "done").iterdir():
            if marker.name == store._marker(batch_id):
                marker.unlink()  # the writer died between the log and the marker
        assert not store.commit(batch_id, rows) and store.totals().first()["n_docs"] == i + 1
    assert {p.name for p in tmp_path.iterdir()} == {"store"}
    (tmp_path / "store" / "totals" / "half").mkdir()  # a writer that died before the log
    (tmp_path / "store" / "latest").unlink()
    assert store.commit("last", rows) and store.totals().first()["n_docs"] == 6


def test_reading_totals_takes_one_table(spark, tmp_path):
    store = token_counts.TokenRollup(spark, f"file://{tmp_path}/store")
    rows = token_counts.inserts(spark.createDataFrame([("a", "en", "v", 5)], COUNTED))
    for i in range(token_counts.KEEP_VERSIONS + 2):
        store.commit(str(i), rows)
    assert len({f.rsplit("/", 2)[1] for f in store.totals().inputFiles()}) == 1
    assert len(list((tmp_path / "store" / "totals").iterdir())) == token_counts.KEEP_VERSIONS


def test_changes_awkward(spark, tmp_path):
    """Null counts and keys, repeated rows, moved documents, extra columns, very large counts."""
    store = token_counts.TokenRollup(spark, f"file://{tmp_path}/store")
    rows = spark.createDataFrame([("a", None, "v", None), ("a", None, "v", None), ("b", "en", "v", 10**15)], COUNTED).withColumn("n_docs", F.lit("x"))
    store.commit("1", token_counts.inserts(rows).withColumn("rank", F.lit(1)))
    moved = rows.where("source = 'b'").selectExpr("*", "'c' as source_new", "lang as lang_new", "'w' as tokenizer_new", "7L as n_tokens_new")
    store.commit("2", token_counts.moves(moved))
    assert {tuple(r) for r in store.totals().collect()} == {("a", None, "v", 2, 0), ("c", "en", "w", 1, 7)}


def test_token_counts_awkward(spark):
    got = awkward(spark).select("doc_id", token_counts.count_tokens(F.col("text"), queries.VERSION).alias("n")).collect()
    assert len(got) == 10 and {r["n"] for r in got if r["doc_id"] in (1, 2)} == {0}


# --- op4 ---------------------------------------------------------------------------------------------------------------

TRICKY = ["", "a<|b", "<\\|", "<\\\\|end|>", chat.END, chat.TURN + "assistant" + chat.TEXT, "</s>[INST] ok [/INST]", "<|endoftext|>", "é🙂 ünï\n\n", " lead and trail ", "tab\t<", "|>", "日本語", "<"]


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice("<|\\>a\n") for _ in range(rng.randrange(9)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_conversations_round_trip(spark):
    rng = random.Random(5)
    talks = {c: [(rng.choice(["user", "assistant", "system", "ro<|le"]), rng.choice(TRICKY)) for _ in range(rng.randint(1, 6))] for c in range(60)}
    rows = [(c, i, r, t) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = {r["conv_id"]: r for r in formatted.collect()}
    for r in chat.digests(formatted).collect():
        turns, one = talks[r["conv_id"]], full[r["conv_id"]]
        assert r["turns"] == "".join(f"{a}\n{b}\n" for a, b in turns) and r["n_turns"] == len(turns)
        assert r["loss_text"] == "".join(b for a, b in turns if a == "assistant")
        assert len(one["token_ids"]) == len(one["loss_mask"]) == len(one["token_starts"])


def test_conversations_awkward(spark):
    rows = [(1, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (None, 1, "user", "x"), (2, 1, "assistant", "b" * 200_000), (2, 0, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(table.withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(1)))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_text"] == "" and got[None]["turns"] == "user\nx\n" and len(got[2]["loss_text"]) == 200_000
    assert chat.format_conversations(table.limit(0)).count() == 0


# --- op5 ---------------------------------------------------------------------------------------------------------------

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{PLAIN[k][0]}:{a}:{b}" for a, k, b in sorted(out))


def check_spans(found, texts):
    for r in found:
        want, got = brute_spans(texts[r["doc_id"]]), r["spans"]
        assert hashlib.sha256(want.encode()).hexdigest() == r["base_sha256"], (want, got)
        assert set(filter(None, want.split(","))) <= set(got.split(","))


def test_base_spans_on_documents(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    check_spans(queries.op5_pii(spark, sf).collect(), texts)


def test_base_spans_against_brute_force(spark, tmp_path):
    rng = random.Random(6)
    bits = ["a@b.c", "a.b@c-d.e.f@g.h", "x+y@", "@b.c", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "0001.2.3.04", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+49 30 1234567", "+1", " ", "é", "🙂", "-", ".", "5", "99999999999999999999", "+12345678901(", "12 34"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    docs(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    check_spans(queries.op5_pii(spark, str(tmp_path)).collect(), texts)


def test_wide_spans_are_added(spark):
    text = "Please call (212) 555-0147 or mail jane.doe [at] example.com, card 4111 1111 1111 1111 4111 1111 1111 1111 ok"
    found = pii.find_spans(docs(spark, [(1, text), (2, "nothing here, see chapter 12")])).collect()
    kinds = {r["doc_id"]: [pii.KINDS[s["kind"]] for s in r["spans"]] for r in found}
    assert kinds == {1: ["phone", "email", "card", "card"], 2: []}


def test_labelers_are_rated(spark):
    rows = [(0, 1, 1, 1, 1, 2, 50), (0, 1, 1, 0, 1, 2, 30), (0, -1, -1, 0, -1, 1, 40), (0, 1, -1, 0, -1, 1, 5)]
    patterns = spark.createDataFrame(rows, "kind int, shape byte, gazetteer byte, context byte, boundary byte, size byte, n long")
    rated = pii.posteriors(patterns)
    p = {r["n"]: r["p"] for r in rated.collect()}
    assert p[50] > 0.95 and p[30] > 0.9 and p[40] < 0.05 and p[5] < 0.5
    told = {(r["labeler"], r["vote"]): r for r in pii.reliabilities(rated).collect()}
    assert told["gazetteer", 1]["on_true"] > 0.95 and told["gazetteer", -1]["on_false"] > 0.95


def test_posteriors_against_arrays(spark):
    """Two kinds of random votes, and no window in the plan, of which every round had four."""
    rng = np.random.default_rng(5)
    rows = [(k, *v, 0, int(rng.integers(1, 90))) for k in (0, 2) for v in sorted({tuple(int(y) for y in rng.integers(-1, 2, 4)) for _ in range(30)})]
    patterns = spark.createDataFrame(rows, "kind int, shape byte, gazetteer byte, context byte, boundary byte, size byte, n long")
    got = {tuple(r)[:5]: r["p"] for r in pii.posteriors(patterns).collect()}
    for kind in (0, 2):
        own = np.array([r for r in rows if r[0] == kind])
        votes, n = own[:, 1:5], own[:, 6]
        p = 1 / (1 + np.exp(-votes.sum(axis=1)))
        for _ in range(pii.ROUNDS):
            t, f = n * p, n * (1 - p)
            odds = np.full(len(n), np.log((t.sum() + 1) / (f.sum() + 1)))
            for v in votes.T:
                said = [sum(w[v == x].sum() * (v == x) for x in (-1, 0, 1)) for w in (t, f)]
                odds += np.log((said[0] + 2.0 ** (v + 1)) / (t.sum() + 7) / ((said[1] + 4 / 2.0 ** (v + 1)) / (f.sum() + 7)))
            p = 1 / (1 + np.exp(-odds))
        assert [got[tuple(r)[:5]] for r in own.tolist()] == pytest.approx(p.tolist(), rel=1e-9)


def test_pii_awkward_and_masking(spark):
    rows = pii.find_spans(clashing(awkward(spark))).collect()
    assert len(rows) == 10 and pii.find_spans(awkward(spark).limit(0)).count() == 0
    table = docs(spark, [(1, "é mail a@b.co now"), (2, None), (3, "+1 212 555 0100 and 4111 1111 1111 1111")])
    got = {r["doc_id"]: r for r in pii.mask_documents(table).collect()}
    assert got[1]["text"] == "é mail [EMAIL] now" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] is None and got[3]["text"] == "[PHONE] and [CARD]"
    assert pii.mask_documents(table).columns == table.columns


def test_wide_spans_apart_from_base(spark):
    rng = random.Random(12)
    rows = []
    for i in range(60):
        spans = [(a := rng.randrange(400), a + rng.randint(1, 25), rng.random() < 0.5) for _ in range(rng.choice([0, 3, 40, 700]))]
        rows.append((i, [(a, rng.randrange(4), e, b, 0, 0, 0, 0, 0, 0, 0) for a, e, b in spans]))
    table = spark.createDataFrame(rows, f"i int, c array<{pii._CAND}>")
    base, wide = F.filter("c", lambda x: x["base"]), F.filter("c", lambda x: ~x["base"])
    for r, (_, c) in zip(table.select("i", pii._apart(base, wide).alias("got")).orderBy("i").collect(), rows):
        kept = [x for x in c if x[3] or not any(y[3] and y[0] < x[2] and x[0] < y[2] for y in c)]
        assert sorted(tuple(x) for x in r["got"]) == sorted(kept)


def test_long_texts_in_linear_time(spark):
    """Many base and wide spans in one text; masked as by Python."""
    n = 12_000
    text = " é ".join(f"call ({200 + i % 700}) 555-{i % 10000:04d} or a{i}@b.co" for i in range(n))
    out = pii.mask_documents(docs(spark, [(1, text)])).first()
    assert out["text"] == re.sub(r"\(\d{3}\) 555-\d{4}", "[PHONE]", re.sub(r"a\d+@b\.co", "[EMAIL]", text)) and out["n_chars"] == len(out["text"])


def test_masking_by_pieces(spark):
    rng = random.Random(13)
    rows = []
    for i in range(80):
        text = "".join(rng.choice("aé🙂 \n") for _ in range(rng.choice([1, 1023, 1024, 1025, 5000])))
        spans = sorted((a := rng.randrange(len(text)), rng.randrange(4), min(len(text), a + rng.choice([1, 5, 1500]))) for _ in range(rng.choice([1, 4, 300])))
        rows.append((i, text, [(a, k, e, True) for a, k, e in spans]))
    table = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,kind:int,end:int,base:boolean>>")
    for r, (_, text, spans) in zip(table.select("i", pii.masked(F.col("text"), F.col("spans")).alias("m")).orderBy("i").collect(), rows):
        want, upto = [], 0
        for a, k, e, _ in spans:
            if a >= upto:
                want += [text[upto:a], f"[{pii.KINDS[k].upper()}]"]
            upto = max(upto, e)
        assert r["m"] == "".join(want) + text[upto:]


def test_held_out_spans(spark):
    """Trained without labels on one half, the classifier finds the added spans of the other."""
    rng = random.Random(14)

    def make(i):
        number = f"{rng.randint(200, 989)} {rng.randint(200, 989)} {rng.randint(0, 9999):04d}"
        if rng.random() < 0.5:
            return i, f"{rng.choice(['call', 'phone', 'tel', 'reach me by mobile'])} ({number[:3]}){number[3:]}{rng.choice([', please', '. Thanks', ''])}", 1
        return i, f"{rng.choice(['serial', 'order', 'invoice', 'part no'])} 0{number[1:]}{rng.choice(['', '.', ' shipped'])}", 0

    made = [make(i) for i in range(800)]
    halves = [pii.with_candidates(docs(spark, [m[:2] for m in made if m[0] % 2 == h])) for h in (0, 1)]
    weights = pii.train(halves[0])
    got = {r["doc_id"]: r["n"] for r in halves[1].select("doc_id", F.size(pii.accepted(F.col("cands"), weights)).alias("n")).collect()}
    right = [bool(got[i]) == bool(true) for i, _, true in made if i % 2]
    assert sum(right) / len(right) >= 0.95


# --- op6 ---------------------------------------------------------------------------------------------------------------


def test_pages_of_the_table(spark, sf):
    """On these pages the article element is the main text; a plain reading of it is the truth."""
    import html

    got = {r["page_id"]: r for r in queries.op6_html_text(spark, sf).collect()}
    for r in queries.table(spark, sf, "pages").collect():
        body = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = re.split("</?(?:p|h1|div|br)>", body)
        want = " ".join(filter(None, (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in blocks)))
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


PAGE = """<html><head><title>T</title><script>if (a < b) x("</p>")</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><div class="cookie-notice">We use cookies on this site to serve you.</div>
<div id=content><h1>Title &amp; more</h1><p>First <b>bold</b>text of the story with <a href=x>a link</a>,&nbsp;and\n more words to make it long enough.</p>
<p>Second paragraph of the story, which is also long enough to count as text.<ul><li>one<li>two</ul><table><tr><td>cell<td>next</table>
<form><input value=q>Search here</form><aside>Related stories</aside><div class="comments"><p>I like it</p></div></div>
<div class="sidebar"><p>Popular posts and other things to read today</p></div><footer>&copy; us</footer></body></html>"""


def test_page_without_article():
    assert html_text.extract(PAGE) == (
        "Title & more First boldtext of the story with a link, and more words to make it long enough. "
        "Second paragraph of the story, which is also long enough to count as text. one two cell next"
    )


STORY = "<p>" + "This is a sentence of the story that has some words. " * 3 + "</p>"
OTHER = "<p>" + "These words, a great many of them, belong to something else. " * 6 + "</p>"


def test_noise_does_not_compete():
    for noise in (f"<aside><div>{OTHER * 4}</div></aside>", f"<section class='comments'><div>{OTHER * 4}</div></section>", f"<div id=sidebar><div><div>{OTHER * 4}</div></div></div>", f"<form>{OTHER}</form>"):
        text = html_text.extract(f"<body><div id=w>{STORY * 3}</div>{noise}</body>")
        assert text.count("of the story") == 9 and "something else" not in text
        assert html_text.extract(f"<body><article>{STORY * 3}{noise}</article></body>") == text


def test_story_elements_are_kept():
    page = f"<body><article>{STORY}<div class='social-policy'>{STORY}</div><table class='share-prices'><tr><td>1.20<td>1.30</table></article></body>"
    assert html_text.extract(page).count("of the story") == 6 and html_text.extract(page).endswith("1.20 1.30")
    page = f"<body><div class='story'>{STORY}<div class='social-policy'>{STORY}</div>{STORY}</div></body>"
    assert html_text.extract(page).count("of the story") == 9


def test_broken_pages_take_linear_time():
    import time

    began = time.perf_counter()
    for page in ("<b>" * 330_000 + "<p>x", "<header>" * 100_000 + "x", "<p><div>" + "<b>" * 40_000 + "<p>a</p>" * 40_000, "<td><table>" + "<b>" * 40_000 + "<td></td>" * 40_000, "</i>" * 250_000, "<div>" * 90_000 + "x" + "</span>" * 90_000):
        html_text.extract(page)
    assert time.perf_counter() - began < 60


def test_densities_against_brute_force(spark, sf):
    """Every density and sum counted anew for each node from its own subtree, by recursion."""
    import math

    def count(node):
        chars = tags = link_chars = link_tags = 0
        for x in node.down:
            if isinstance(x, str):
                chars += 0 if node.noise else len(" ".join(x.split()))
                continue
            c, t, lc, lt = count(x)
            chars, tags = chars + c, tags + t + 1
            link_chars, link_tags = link_chars + (c if x.tag == "a" else lc), link_tags + lt + (x.tag == "a")
        return chars, tags, link_chars, link_tags

    def density(node, body):
        c, t, lc, lt = count(node)
        if node.tag == "a":
            lc = c
        bc, _, blc, _ = count(body)
        if not c:
            return 0.0
        t, lt = max(t, 1), max(lt, 1)
        base = math.log(c * lc / max(c - lc, 1) + blc / bc * c + math.e)
        ratio = max(c / max(lc, 1) * t / lt, 1.0)
        return c / t * (math.log(ratio) / math.log(base) if base > 1 else math.log(ratio) + 1)

    def nodes(x):
        yield x
        for y in x.down:
            if not isinstance(y, str):
                yield from nodes(y)

    for page in [PAGE, *[r["html"] for r in queries.table(spark, sf, "pages").limit(20).collect()]]:
        root = html_text.parse(page)
        best = html_text.main_node(root)
        body = next((x for x in nodes(root) if x.tag == "body"), root)
        for x in nodes(root):
            assert x.density == pytest.approx(density(x, body))
            assert x.total == pytest.approx(sum(density(y, body) for y in x.down if not isinstance(y, str)))
        free = [x for x in nodes(body) if not x.noise]
        path, top = [], max(free, key=lambda x: x.density)
        while top is not body.up:
            path.append(top.density)
            top = top.up
        passed = [x for x in free if x.density >= min(path) and x.tag not in html_text.SMALL]
        assert max(passed, key=lambda x: x.total) in list(nodes(best))


def test_pages_awkward(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text"), (4, None, "<p>" * 3000 + "deep"), (5, "u", "<b>open <i>never closed"), (6, "u", "<!-- only -->"), (7, "u", "a &lt; b &#233; &bogus; <"), (7, "u", "<p>" + "word " * 100_000)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = [r["t"] for r in table.select("page_id", html_text.main_text(F.col("html")).alias("t")).orderBy("page_id").collect()]
    assert got[:3] == ["", "", "plain text"] and got[3] == "deep" and got[4] == "open never closed" and got[5] == ""
    assert table.limit(0).select(html_text.main_text(F.col("html"))).count() == 0


# --- op7 ---------------------------------------------------------------------------------------------------------------


def _targets(spark, goals):
    return spark.createDataFrame([(m, v, float(t)) for m, own in goals.items() for v, t in own.items()], "margin string, value string, target double")


def test_raking_against_arrays(spark):
    """Free cells only: the plain algorithm by arrays."""
    rng = random.Random(7)
    rows = [(s, a, t, rng.randint(500, 1000), 1) for s in "abc" for a in ("en", "fr") for t in "xyz"]
    table = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, n_docs long")
    total = sum(r[3] for r in rows)
    goals = {"source": dict(zip("abc", (0.05, 0.08, 0.07))), "lang": {"en": 0.11, "fr": 0.09}, "topic": dict(zip("xyz", (0.08, 0.05, 0.07)))}
    goals = {m: {v: t * total for v, t in own.items()} for m, own in goals.items()}
    raked = mixing.rake(table, _targets(spark, goals), tolerance=1e-9).collect()
    weights = np.zeros((3, 2, 3))
    for s, a, t, n, _ in rows:
        weights["abc".index(s), ("en", "fr").index(a), "xyz".index(t)] = n
    for _ in range(60):
        for axis, m in enumerate(mixing.MARGINS):
            shape = [1, 1, 1]
            shape[axis] = -1
            weights *= (np.array(list(goals[m].values())) / weights.sum(axis=tuple(i for i in range(3) if i != axis))).reshape(shape)
    assert {(r["source"], r["lang"], r["topic"]): r["weight"] for r in raked} == pytest.approx(
        {(s, a, t): weights["abc".index(s), ("en", "fr").index(a), "xyz".index(t)] for s, a, t, _, _ in rows}, rel=1e-6
    )
    assert all(r["weight"] <= r["tokens"] for r in raked)


def _raking_nodes(spark, few):
    table = spark.createDataFrame([(s, a, t, 100.0, 0.5, 300.0, 290.0, 310.0, None, None, None) for s in "ab" for a in "cd" for t in "xy"],
        "source string, lang string, topic string, tokens double, times double, to_source double, to_lang double, to_topic double, off_source double, off_lang double, off_topic double")
    table = table.withColumn("tokens", F.col("tokens") + F.ascii("source") + 2 * F.ascii("lang"))
    rows = table.coalesce(1) if few else table
    for m in mixing.MARGINS:
        rows = mixing._scaled(rows, m, few)
    return sorted(tuple(r) for r in rows.select(*mixing.MARGINS, F.round("times", 12), *[F.round(f"off_{m}", 12) for m in mixing.MARGINS]).collect()), rows._jdf.queryExecution().optimizedPlan().toString()


def test_rounds_of_few_cells_read_them_once(spark):
    """Each margin doubled the plan of a round; the driver plans and compiles every round."""
    plain, joined = _raking_nodes(spark, False)
    got, once = _raking_nodes(spark, True)
    scans = [plan.count("LogicalRDD") + plan.count("LocalRelation") for plan in (joined, once)]
    assert str(got) == str(plain) and scans == [8, 1]


def test_full_cells_lose_no_mass(spark):
    """A plain weight above its cell's tokens: what it can't take goes to others, and every margin holds."""
    rows = [("s1", "en", "x", 100, 1), ("s1", "fr", "x", 3000, 1), ("s1", "en", "y", 2000, 1), ("s2", "en", "x", 4000, 1), ("s2", "fr", "x", 50, 1), ("s2", "fr", "y", 5000, 1)]
    table = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, n_docs long")
    goals = {"source": {"s1": 4500.0, "s2": 2000.0}, "lang": {"en": 3000.0, "fr": 3500.0}, "topic": {"x": 4000.0, "y": 2500.0}}
    targets = _targets(spark, goals)
    raked = mixing.stored(mixing.rake(table, targets), "test")
    assert raked.where("weight > tokens or weight < 0").count() == 0
    for r in mixing.residuals(raked, targets).collect():
        assert abs(r["missing"]) <= 1e-3 * r["target"], r
    free = {(r["source"], r["lang"], r["topic"]): r["weight"] / r["tokens"] for r in raked.collect()}
    assert max(free.values()) == 1.0  # some cell is full, so the cut would have lost its mass


def test_targets_that_cannot_hold(spark):
    rows = [("s1", "en", "x", 100, 1), ("s2", "fr", "x", 100, 1), ("s3", "de", "x", 0, 1)]
    table = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long, n_docs long")
    targets = _targets(spark, {"source": {"s1": 20, "s2": 80, "s3": 5}, "lang": {"en": 80, "fr": 20}, "topic": {"x": 100, "none": 4}})
    raked = mixing.rake(table, targets, rounds=5)
    missing = {(r["margin"], r["value"]): r["missing"] for r in mixing.residuals(raked, targets).collect()}
    assert raked.count() == 2 and max(abs(x) for x in missing.values()) > 10 and missing["source", "s3"] == 5
    none = mixing.rake(table, _targets(spark, {"source": {"s1": 0, "s2": 50}}))
    assert {r["source"]: r["weight"] for r in none.collect()} == pytest.approx({"s1": 0.0, "s2": 50.0})


def test_probabilities_meet_even_targets(spark):
    """One source with a third of the tokens, and a topic whose even target is more than it has."""
    rng = random.Random(3)
    rows = [(s, a, t, rng.randint(5, 400) if s != "a" else rng.randint(2000, 9000)) for s in "abcdef" for a in ("de", "en", "fr") for t in "xyz"]
    rows += [("g", "en", "w", 3), ("b", "fr", "w", 4)]
    table = spark.createDataFrame(rows, "source string, lang string, topic string, n_tokens long")
    cells = mixing.cells(table).cache()
    kept = cells.join(mixing.probabilities(table), mixing.MARGINS).withColumn("w", F.col("probability") * F.col("tokens")).cache()
    assert kept.where("probability > 1 or probability < 0").count() == 0 and kept.where("probability = 1").count() > 3
    total = sum(r[3] for r in rows)
    targets = mixing.even_targets(cells).collect()
    for m in mixing.MARGINS:
        even = {r["value"]: r["target"] for r in targets if r["margin"] == m}
        has = {r[m]: r["t"] for r in cells.groupBy(m).agg(F.sum("tokens").alias("t")).collect()}
        want = dict(even)
        for _ in range(20):  # the same water level by turns
            full = {v for v in want if want[v] >= has[v]}
            rest = sum(even.values()) - sum(has[v] for v in full)
            want = {v: has[v] if v in full else even[v] * rest / sum(even[x] for x in even if x not in full) for v in even}
        got = {r[m]: r["w"] for r in kept.groupBy(m).agg(F.sum("w").alias("w")).collect()}
        assert got == pytest.approx(want, rel=0.01) and sum(got.values()) == pytest.approx(total / 2, rel=1e-3)


def test_mixing_to_outside_targets(spark, sf):
    """From targets to documents: the expected tokens of each margin, a given topic column, draws without ids."""
    table = queries.table(spark, sf, "documents").select("doc_id", "source", "lang", "text", F.when(F.col("doc_id") % 3 == 0, "a").otherwise("b").alias("kind"))
    rows = mixing.stored(mixing.mix(table, topic=F.col("kind")), "test")
    total = rows.agg(F.sum("n_tokens")).first()[0]
    goals = {"lang": {"de": 0.1 * total, "en": 0.2 * total}, "topic": {"a": 0.2 * total}}
    out = mixing.mix(table, _targets(spark, goals), topic=F.col("kind")).cache()
    assert set(r[0] for r in out.select("topic").distinct().collect()) == {"a", "b"}
    for m, own in goals.items():
        got = {r[m]: r["w"] for r in out.groupBy(m).agg(F.sum(F.col("probability") * F.col("n_tokens")).alias("w")).collect()}
        assert {v: got[v] for v in own} == pytest.approx(own, rel=1e-3)
    nameless = mixing.mix(table.withColumn("doc_id", F.lit(None).cast("long")))
    share = nameless.agg(F.avg(F.col("sampled").cast("int"))).first()[0]
    assert 0.3 < share < 0.8


def test_mixing_awkward(spark):
    rows = mixing.mix(clashing(awkward(spark))).collect()
    assert len(rows) == 10 and all(0 <= r["probability"] <= 1 for r in rows)
    assert not any(r["sampled"] for r in rows if r["n_tokens"] == 0)
    assert mixing.mix(awkward(spark).limit(0)).count() == 0
    out = mixing.sample_documents(awkward(spark))
    assert out.columns[-1] == "mix_probability" and sorted(r["doc_id"] or 0 for r in out.collect()) == sorted(r["doc_id"] or 0 for r in rows if r["sampled"])


# --- op8 ---------------------------------------------------------------------------------------------------------------


def test_listed_urls_are_exact(spark):
    """With the filter broadcast, and joined by block."""
    urls = spark.createDataFrame([(i, f"http://h{i}.org/p") for i in range(3000)], "page_id long, url string")
    listed = urls.where("page_id % 7 = 0").select("url").unionByName(urls.limit(1).select("url"))
    for blocks in (1 << 16, 0):
        keyed = urls.withColumn("key", url_filter.canonical(F.col("url")))
        got = {r["page_id"]: r["listed"] for r in url_filter.on_list(keyed, listed.select(url_filter.canonical(F.col("url")).alias("key")), blocks).collect()}
        assert got == {i: i % 7 == 0 for i in range(3000)}


def test_bloom_filter_stops_most_of_a_long_list(spark):
    """A list past a million keys: all of them pass, and few others, on both ways."""
    keys = spark.range(1_200_000).select(F.concat(F.lit("k"), "id").alias("key"))
    urls = spark.range(1_190_000, 1_230_000).select(F.col("id").alias("page_id"), F.concat(F.lit("k"), "id").alias("key"))
    for blocks in (url_filter.BROADCAST_BLOCKS, 0):
        seen = url_filter.probed(urls, keys, blocks).groupBy(F.col("page_id") < 1_200_000).agg(F.count("*").alias("n"), F.sum(F.col("maybe").cast("int")).alias("maybe"))
        by = {r[0]: (r["n"], r["maybe"]) for r in seen.collect()}
        assert by[True] == (10_000, 10_000) and by[False][0] == 30_000 and by[False][1] < 600


def test_mirrored_stories(spark):
    rows = [(1, "http://a.org/1", "s"), (2, "http://A.org/2", "s"), (3, "http://b.org/3", "t"), (4, "http://c.org/4", "t"), (5, "http://d.org", None), (6, "http://e.org", ""), (7, None, "t")]
    table = spark.createDataFrame(rows, "page_id long, url string, story string").withColumn("digest", F.lit("x"))
    assert {r["url"] for r in url_filter.mirrored(table, F.col("story")).collect()} == {"http://b.org/3", "http://c.org/4", None}


def test_urls_awkward(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.com/en/7x?q#f"), (5, "x://a.Example.NET/de/8"), (6, "http://notcom/en/"), (7, "http://com/en/"), (8, "http://a.org#/es/"), (8, "http://a.org#/es/"), (None, "a://b?c://d/e")]
    table = spark.createDataFrame(rows, "page_id long, url string").withColumn("key", F.lit("x")).withColumn("host", F.lit("x"))
    got = url_filter.judge(table, table.limit(0).select("url")).collect()
    by = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert len(got) == 10
    assert by[1] == by[2] == by[3] == ("", "", None, "allow")
    assert by[4] == ("example.com", "/en/7x", "example.com/en/7", "allow") and by[5] == ("a.example.net", "/de/8", "example.net/de/8", "block")
    assert by[6] == ("notcom", "/en/", None, "allow") and by[7][2:] == ("com/en/", "block") and by[8] == ("a.org", "", None, "allow") and by[None][:2] == ("b", "")
    assert url_filter.judge(table.limit(0), table.select("url")).count() == 0
    long = spark.createDataFrame([(1, "http://h.org/" + "é/" * 300_000), (2, "http://h.org/" + "?a&b" * 100_000)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(long, long.where("page_id = 1").select("url")).collect()} == {1: "block", 2: "allow"}


# --- op10 --------------------------------------------------------------------------------------------------------------


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(12, 24))
    data = np.repeat(centers, 250, axis=0) + 0.6 * rng.normal(size=(3000, 24))
    data[1000:1900] = data[1000]  # one vector a third of all
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0"), shard_rows=700).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert len(got) == 60
    hits = 0
    for q, rows in got.items():
        dist = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(data)), dist)) if i != q][:10]
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and all(abs(s - dist[i]) < 1e-9 for _, i, s in rows)
        hits += len({i for _, i, _ in rows} & set(order))
        if 1000 <= q < 1900:
            assert [i for _, i, _ in rows] == order  # ties to the smaller id
    assert hits / 600 >= 0.95


def test_repeated_rows_of_equal_vectors(spark):
    """Every row three times: the ten smallest ids of twenty equal vectors come before farther ones."""
    rows = [(i, [1.0, 2.0]) for i in range(20)] + [(i, [1.0, 2.0 + i / 100]) for i in range(100, 120)]
    df = spark.createDataFrame([r for r in rows for _ in range(3)], "vec_id long, embedding array<double>").coalesce(1)
    got = sorted((r["rank"], r["vec_id"], r["score"]) for r in ann.nearest(df, df.where("vec_id = 15")).collect())
    assert got == [(i + 1, i, 0.0) for i in range(10)]


def _recall(spark, data, k=10, every=20, **options):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    hits = n = 0
    got = {}
    for r in ann.nearest(df, df.where(f"vec_id % {every} = 0"), k, **options).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    for q, found in got.items():
        dist = ann.distances(data, data[q])
        best = [i for i in np.lexsort((np.arange(len(data)), dist)) if i != q][:k]
        assert all(s == pytest.approx(dist[i], rel=1e-12) for i, s in found.items())
        hits, n = hits + len(set(best) & set(found)), n + len(best)
    assert n == k * -(-len(data) // every)
    return hits / n


def test_recall_far_from_the_origin(spark):
    """Means of 1e4 and 1e8, huge components, tight groups far apart."""
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(1000, 8))
    groups = np.repeat(rng.normal(size=(20, 8)) * 1e6, 50, axis=0) + unit
    for data in (unit + 1e4, unit + 1e8, unit * 1e20, unit * 1e300, groups):
        assert _recall(spark, data, shard_rows=600) >= 0.9


def test_distances_do_not_overflow():
    a = np.array([[3e300, 4e300], [0.0, 0.0], [-1.7e308, 0.0]])
    assert ann.distances(a[:2], np.zeros(2)).tolist() == pytest.approx([5e300, 0.0]) and ann.distances(a[2:], np.array([0.0, 1e300]))[0] == pytest.approx(1.7e308)


def test_recall_of_the_query(spark, sf):
    """Against brute force on the whole table of embeddings."""
    rows = queries.table(spark, sf, "embeddings").toPandas()
    data, ids = np.array(rows["embedding"].tolist(), float), rows["vec_id"].to_numpy()
    hits = n = 0
    for q, found in queries.op10_ann(spark, sf).toPandas().groupby("query_id"):
        dist = ann.distances(data, data[ids == q][0])
        best = [i for i in ids[np.lexsort((ids, dist))] if i != q][:10]
        hits, n = hits + len(set(best) & set(found["vec_id"])), n + len(best)
    assert n and hits / n >= 0.9


def test_one_id_with_two_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (0, [5.0, 5.0]), (1, [1.0, 2.5]), (2, [5.0, 5.5]), (3, [1.0, 3.0])], "vec_id long, embedding array<double>")
    first = min((np.array(v).tobytes(), v) for v in ([1.0, 2.0], [5.0, 5.0]))[1]
    for _ in range(3):
        got = ann.nearest(df.repartition(5), df.repartition(3).where("vec_id = 0"), k=1).collect()
        assert [(r["vec_id"], r["score"]) for r in got] == [(1 if first == [1.0, 2.0] else 2, 0.5)]


def test_vectors_awkward(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (7, []), (8, [1.0]), (None, [1.0, 1.0]), (9, [1e300, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("shard", F.lit("x"))
    got = ann.nearest(df, df.where("vec_id % 100 = 0")).collect()
    assert {r["query_id"] for r in got} == {0, 100} and {r["vec_id"] for r in got if r["query_id"] == 0} == {100, 6, 9}
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# --- one odd row ends no query --------------------------------------------------------------------------------------


def _plain(version="byte_bpe_50k"):
    path = f"{token_counts.TOKENIZERS}/{version}.tiktoken"
    return token_counts._encoder(path, token_counts.PATTERN).encode_ordinary, token_counts._encoder(path, r"\s+").encode_ordinary


def test_runs_of_white_space_encode_as_one(monkeypatch):
    """Cut at any length, the tokens are those of the plain encoder."""
    encode, spaces = _plain()
    draw = random.Random(3)
    signs = [" ", " ", "\n", "\t", " ", " ", "\x1c", "a", "9", ".", "é", "'s"]
    for least in (1, 2, 3):
        monkeypatch.setattr(token_counts, "_LONG", re.compile(f"[{token_counts._SPACE}]{{{least},}}"))
        for _ in range(2000):
            text = "".join(draw.choice(signs) for _ in range(draw.randrange(14)))
            assert token_counts.encode_whole(text, encode, spaces) == encode(text), repr(text)
            whole = chat.render([("user", text), ("assistant", text + " ")])[0]
            ids, offsets = chat.encode(whole)
            assert ids.tolist() == chat._tokenizer(chat.TOKENIZER)[0].encode(whole, allowed_special="all") and offsets[-1, 1] == len(whole)


@pytest.mark.parametrize("run", [" ", "\n", " \n\t"])
def test_millions_of_blanks(spark, run):
    text = "word" + run * (2_000_000 // len(run)) + "end"
    df = spark.createDataFrame([(text,), (run * 1_000_001,)], "text string")
    counts = [r[0] for r in df.select(token_counts.count_tokens(F.col("text"), "byte_bpe_50k")).collect()]
    assert all(c > 0 for c in counts)
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    row = chat.digests(chat.format_conversations(talk)).first()
    assert row["loss_text"] == text and row["n_turns"] == 2


@pytest.mark.parametrize("odd", ["<![ if gte mso 9]>", "<!", "<![", "</", "<?", "<", "<!-", "<!--", "<a b=", "<a b='", "</a", "<![CDATA[x]]>", "<!doctype", "<script", "<script>", "</ p>", "<a =b>", "<!-->"])
def test_odd_declarations_end_no_page(odd):
    draw = random.Random(odd)
    for _ in range(60):
        tail = "".join(draw.choice("<>!/?-[]='\" abI&#x;") for _ in range(draw.randrange(20)))
        assert html_text.extract(f"<p>One story in a few words.</p>{odd}{tail}").startswith("One story in a few words.")
    assert html_text.extract("<p>One story<![ if gte mso 9]> in a few<!--x--!> words.</p>") == "One story in a few words."


@pytest.mark.parametrize("piece", ["<!--", "<a ", '<a b="', "</", "<?", "<![", "<a b='x' ", "</a ", "<", "&#", "<!--a-->", "<!--a--!>", "<p/", "<textarea>", "<a =="])
def test_a_megabyte_of_openings_takes_linear_time(piece):
    began = time.perf_counter()
    html_text.extract("<body><p>A story.</p>" + piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 5


def test_a_form_around_the_page_is_no_noise():
    story = "<div><p>The story goes on and on for long.</p><p>And it has a second part.</p></div>"
    want = "The story goes on and on for long. And it has a second part."
    assert html_text.extract(f"<body><form id=f><div class=menu><a href=x>Home</a></div>{story}<input><button>Go</button></form></body>") == want
    assert html_text.extract(f"<body>{story}<form><label>Your mail address</label><button>Go</button></form></body>") == want


def test_slashes_take_linear_time(spark):
    url = "http://example.com/" + "/" * 200_000
    df = spark.createDataFrame([(url + "x",), (url,)], "url string")
    began = time.perf_counter()
    got = [r[0] for r in df.select(url_filter.canonical(F.col("url"))).collect()]
    assert got[0].endswith("/x") and got[1] == "example.com" and time.perf_counter() - began < 20


def test_stories_in_articles_with_attributes(spark):
    page = "<article class='post' id=a>one story</article>"
    rows = [("http://a.com/1", page), ("http://b.com/1", page), ("http://c.com/1", "<articles>one story</article>")]
    df = spark.createDataFrame(rows, "url string, html string")
    listed = url_filter.mirrored(df, F.regexp_extract("html", queries.STORY, 1))
    assert sorted(r[0] for r in listed.collect()) == ["http://a.com/1", "http://b.com/1"]


def test_huge_components_beside_ordinary_vectors(spark):
    rng = np.random.default_rng(12)
    vectors = rng.normal(size=(600, 12))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(600 + i, (v * 1e300).tolist()) for i, v in enumerate(rng.normal(size=(20, 12)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 30 = 0"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 600, 30):
        apart = np.sqrt(((vectors - vectors[q]) ** 2).sum(axis=1))
        apart[q] = np.inf
        want = np.argsort(apart)[:5]
        assert all(s == pytest.approx(apart[i]) for i, s in got[q])
        hits, total = hits + len(set(want.tolist()) & {i for i, _ in got[q]}), total + 5
    assert hits >= 0.9 * total
    every = np.array([r[1] for r in rows])
    want = np.sort(ann.distances(np.delete(every, 600, 0), every[600]))[:5]
    assert [s for _, s in got[600]] == pytest.approx(want)
