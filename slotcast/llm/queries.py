"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, fill_middle, html_text, language_id, mixing, near_dup, parity_join, pii, resample, token_counts, url_filter
from .common import new_path, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tokenizer version of op1, and what its revision takes out of texts.
VERSION = "byte_bpe_50k"
JUNK = r"[#$%&*]{3,}"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three committed batches: a load, a revision and a deletion.

    The load inserts every document, the revision recounts those from whose text runs
    of junk signs are taken, the deletion takes out the documents labelled toxic.  The
    revision is sent twice, and counts once.
    """
    docs = table(spark, sf_dir, "documents")
    revised = F.when(F.col("text").rlike(JUNK), F.regexp_replace("text", JUNK, ""))
    counted = stored(
        docs.select(
            "doc_id", "source", "lang", F.lit(VERSION).alias("tokenizer"), token_counts.count_tokens(F.col("text"), VERSION).alias("n_tokens"),
            revised.isNotNull().alias("revised"), token_counts.count_tokens(revised, VERSION).alias("n_tokens_new"),
        ), "counted",
    )
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    gone = counted.join(toxic, "doc_id", "left_semi").withColumn("n_tokens", F.when(F.col("revised"), F.col("n_tokens_new")).otherwise(F.col("n_tokens")))
    store = token_counts.TokenRollup(spark, new_path(spark, "token-rollup"))
    store.commit("load", token_counts.inserts(counted))
    store.commit("revise", token_counts.revisions(counted.where("revised")))
    store.commit("toxic", token_counts.deletes(gone))
    store.commit("revise", token_counts.revisions(counted.where("revised")))
    return store.totals()


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its hit words and the benchmark items found in it."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", F.col("n_hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and near-duplicate class."""
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A text of another template's control strings.
CONTROL = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, with digests of what its output holds."""
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"),
    )
    read = chat.digests(chat.format_conversations(own.unionByName(more)))
    return read.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its counts of base spans, and all spans."""
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda x: x["base"])

    def count(k: int):
        return F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")

    counts = [count(k) for k in range(len(pii.KINDS))]
    return found.select("doc_id", *counts, F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_text.main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell, calibrated probability and whether it is sampled."""
    return mixing.mix(table(spark, sf_dir, "documents"))


#: What two pages must share to be mirrors of one another.
STORY = r"(?s)<article(?:\s[^>]*)?>(.*?)</article>"


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, then by the list of the URLs of stories that stand on several hosts."""
    pages = table(spark, sf_dir, "pages")
    listed = url_filter.mirrored(pages, F.regexp_extract("html", STORY, 1))
    return url_filter.judge(pages.select("page_id", "url"), listed)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    found = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"),
        F.col("found.bits_per_byte").alias("bits_per_byte"),
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for each hundredth vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 100 == 0))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its class of similar documents."""
    return parity_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and arranged for filling in the middle, with digests of the output and of the text restored from it."""
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark texts and its rank in the draw."""
    found = resample.importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_decontaminate, op3_simhash, op4_chat_format, op5_pii, op6_html_text, op7_mixing, op8_url_filter, op9_language_id,
        op10_ann, op11_jaccard_join, op12_fill_middle, op13_resample, pipeline,
    )
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = rf"""
WITH items AS (
  SELECT item_id, w, len(w) AS n FROM (
    SELECT DISTINCT item_id, regexp_extract_all({_LOWER.format("text")}, '{decontaminate.WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL)
  WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS p, least(n, 13) AS m
  FROM (SELECT item_id, w, n, unnest(range(1, greatest(n - 12, 1) + 1)) AS i FROM items)
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{decontaminate.WORD}'), []) AS w FROM documents
), places AS (
  SELECT rid, i, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs CROSS JOIN (SELECT DISTINCT m FROM win) WHERE len(w) >= m)
), hits AS (
  SELECT DISTINCT rid, i, places.m AS m, item_id FROM places JOIN win ON places.p = win.p AND places.m = win.m
), words AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (rid) LEFT JOIN found USING (rid)
"""

_ESCAPED = r"regexp_replace({}, '<(\\*)\|', '<\1\\|', 'g')"
_OP4 = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id
"""


def _op7() -> str:
    """Targets are bounded by an exact cut in the order of filling; rounds end when the worst margin is near its target."""
    forms = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{t}'" for t, p in mixing.FORMS)
    id_ = "coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))"
    parts = [
        f"""rows AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
          CASE WHEN text IS NULL THEN 'none' {forms}
            WHEN length(text) < {mixing.SHORT} THEN 'short' WHEN length(text) >= {mixing.LONG} THEN 'long' ELSE 'prose' END AS topic,
          CAST(coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0) AS BIGINT) AS n_tokens,
          CAST('0x' || substr(md5('mix:' || {id_}), 1, 12) AS BIGINT) / 281474976710656.0 AS draw FROM documents)""",
        "cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM rows GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for m in mixing.MARGINS:
        parts.append(f"""want_{m} AS (SELECT {m}, t, pow(t, {mixing.EVEN}) / sum(pow(t, {mixing.EVEN})) OVER () * sum(t) OVER () * {mixing.KEEP} AS goal
          FROM (SELECT {m}, sum(tokens) AS t FROM cells GROUP BY {m}))""")
        # values in the order in which a growing factor fills them; the first factor that the next value does not cut is right
        parts.append(f"""cut_{m} AS (SELECT max(factor) AS factor FROM (SELECT (sum(goal) OVER () - coalesce(sum(t) OVER before, 0)) / sum(goal) OVER rest AS factor, t / goal AS full_at
          FROM want_{m} WINDOW before AS (ORDER BY t / goal, {m} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
            rest AS (ORDER BY t / goal, {m} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE factor < full_at)""")
        parts.append(f"to_{m} AS (SELECT {m}, least(t, goal * greatest(1.0, coalesce(factor, 'inf'::DOUBLE))) AS to_{m} FROM want_{m}, cut_{m})")
    step = "r"
    for m in mixing.MARGINS:
        gap = "0" if m == mixing.MARGINS[0] else "gap"
        full = f"sum(CASE WHEN a >= {mixing.FULL} THEN least(a, 1.0) * tokens ELSE 0 END) OVER (PARTITION BY {m})"
        open_ = f"sum(CASE WHEN a < {mixing.FULL} THEN a * tokens ELSE 0 END) OVER (PARTITION BY {m})"
        step = f"""(SELECT * REPLACE (greatest({gap}, abs((open_w + full_w) / to_{m} - 1)) AS gap,
          a * CASE WHEN open_w > 0 AND to_{m} > full_w THEN (to_{m} - full_w) / open_w ELSE to_{m} / (open_w + full_w) END AS a)
          FROM (SELECT * EXCLUDE (open_w, full_w), {open_} AS open_w, {full} AS full_w FROM {step}))"""
    return f"""WITH RECURSIVE {', '.join(parts)},
    r AS (SELECT 0 AS i, cells.*, to_source, to_lang, to_topic, 1.0::DOUBLE AS a, 0.0::DOUBLE AS gap, 1.0::DOUBLE AS worst, 0.0::DOUBLE AS open_w, 0.0::DOUBLE AS full_w
        FROM cells JOIN to_source USING (source) JOIN to_lang USING (lang) JOIN to_topic USING (topic)
      UNION ALL SELECT * REPLACE (i + 1 AS i, max(gap) OVER () AS worst) FROM {step} WHERE i < {mixing.ROUNDS} AND worst > {mixing.TOLERANCE}),
    out AS (SELECT rows.*, coalesce(probability, 0.0) AS probability FROM rows LEFT JOIN (SELECT source, lang, topic, round(least(a, 1.0), 6) AS probability
        FROM r WHERE i = (SELECT max(i) FROM r)) AS c USING (source, lang, topic))
    SELECT doc_id, source, lang, topic, n_tokens, probability, n_tokens > 0 AND draw < probability AS sampled FROM out"""


_HOST = _LOWER.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")
_PATH = r"regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(url, '(?s)^.*?://[^?#]*[?]([^#]*)', 1)"
_KEPT = f"array_to_string(list_sort([q for q in string_split({_QUERY}, '&') if q <> '' AND NOT regexp_matches(q, '^(?:{url_filter.TRACKING})(?:=|$)')]), '&')"
_CANONICAL = rf"""CASE WHEN {_HOST} = '' THEN NULL ELSE regexp_replace({_HOST}, '^www[.]|:(?:80|443)$', '', 'g') || regexp_replace({_PATH}, '/+$', '')
  || CASE WHEN {_KEPT} = '' THEN '' ELSE '?' || {_KEPT} END END"""


def _op8() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: len(r[1] + r[2]), reverse=True)
    fits = lambda h, p: f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    name = " ".join(f"{fits(h, p)} THEN '{h}{p}'" for _, h, p in rules)
    action = " ".join(f"{fits(h, p)} THEN '{a}'" for a, h, p in rules)
    return f"""
WITH parts AS (SELECT page_id, coalesce({_HOST}, '') AS host, coalesce({_PATH}, '') AS path, {_CANONICAL} AS key, regexp_extract(html, '{STORY}', 1) AS story FROM pages),
stories AS (SELECT story FROM parts WHERE story <> '' GROUP BY story HAVING count(DISTINCT host) > 1),
mirrors AS (SELECT DISTINCT key FROM parts WHERE story IN (SELECT story FROM stories) AND key IS NOT NULL),
seen AS (SELECT parts.*, mirrors.key IS NOT NULL AS listed FROM parts LEFT JOIN mirrors ON parts.key = mirrors.key)
SELECT page_id, host, path, CASE {name} ELSE NULL END AS rule,
  CASE {action} WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed FROM seen"""


#: Every pair of different sets of near sizes is compared; copies count as one set.
_OP11 = rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM words
), named AS (SELECT rid, doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS name FROM sets),
distinct_sets AS (SELECT name, any_value(s) AS s, any_value(n) AS n FROM named JOIN sets USING (rid) WHERE n > 0 GROUP BY name),
tokens AS (SELECT name, n, unnest(s) AS t FROM distinct_sets),
links AS (
  SELECT a.name AS a, b.name AS b FROM tokens AS a JOIN tokens AS b ON a.t = b.t AND a.name <> b.name AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.name, b.name HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT name AS a, name AS b FROM distinct_sets UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least_id AS (SELECT name, min(doc_id) AS first_id FROM named WHERE n > 0 GROUP BY name),
classes AS (SELECT a AS name, min(first_id) AS component_id FROM reach JOIN least_id ON least_id.name = reach.b GROUP BY a)
SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id FROM named LEFT JOIN classes USING (name)
"""

_UNSIGNED = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
_OP12 = rf"""
WITH rows AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
lines AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS l, len(regexp_extract_all(text, '[^\n]*\n|[^\n]+')) AS n FROM rows),
cuts AS (SELECT *, least({_UNSIGNED.format(1)} % (n + 1), {_UNSIGNED.format(9)} % (n + 1)) AS a, greatest({_UNSIGNED.format(1)} % (n + 1), {_UNSIGNED.format(9)} % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
    WHEN {_UNSIGNED.format(25)} % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lines),
parts AS (SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS p, coalesce(array_to_string(l[a + 1:b], ''), '') AS m, coalesce(array_to_string(l[b + 1:n], ''), '') AS s FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""

#: crc32 by a table of 256 entries, one step a byte, for each distinct word.
_OP13 = rf"""
WITH RECURSIVE bits AS (
  SELECT 0 AS step, i AS byte, i AS c FROM range(256) AS r(i)
  UNION ALL SELECT step + 1, byte, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE step < 8
), crc AS (SELECT list(c ORDER BY byte) AS entry FROM bits WHERE step = 8),
docs AS (SELECT row_number() OVER () AS rid, doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '{decontaminate.WORD}')) AS w FROM documents),
items AS (SELECT unnest(regexp_extract_all({_LOWER.format("text")}, '{decontaminate.WORD}')) AS w FROM benchmark),
bytes AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM docs UNION SELECT w FROM items)),
buckets AS (SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, entry[1 + (xor(c, b) & 255)])), 4294967295) % 10000 AS bucket FROM bytes, crc),
own AS (SELECT bucket, count(*) AS s FROM docs JOIN buckets USING (w) GROUP BY 1), theirs AS (SELECT bucket, count(*) AS t FROM items JOIN buckets USING (w) GROUP BY 1),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM own) AS all_s, (SELECT coalesce(sum(t), 0) FROM theirs) AS all_t),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (all_s + 10000) / ((s + 1.0::DOUBLE) * (all_t + 10000)))) AS BIGINT) AS g FROM own LEFT JOIN theirs USING (bucket), total),
means AS (SELECT rid, count(*) AS n, CAST(floor(sum(g) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight FROM docs JOIN buckets USING (w) JOIN gain USING (bucket) GROUP BY rid),
scored AS (SELECT doc_id, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) AS d LEFT JOIN means USING (rid)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n >= 20) OVER () AS all_n FROM scored)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 AND place <= 10 * all_n // 100 THEN place END AS rank FROM placed
"""

ORACLE_SQL = {"op11_jaccard_join": _OP11, "op12_fill_middle": _OP12, "op13_resample": _OP13, "op2_decontaminate": _OP2, "op4_chat_format": _OP4, "op7_mixing": _op7(), "op8_url_filter": _op8()}
