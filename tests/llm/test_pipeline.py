from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from helpers import awkward, clashing, docs
from pyspark.sql import functions as F

import __spark_entry__
from slotcast.llm import decontaminate, language_id, near_dup


def test_stages_keep_columns_and_take_effect(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    rows = table
    for name, stage in corpus_pipeline.STAGES:
        before = rows
        rows = corpus_pipeline.stored(stage(spark, before, sf), "test")
        if name != "mixing":
            assert rows.columns == table.columns
        assert rows.count() <= before.count()
    assert rows.columns == [*table.columns, "mix_probability"] and 0 < rows.count()


def test_run_equals_its_operators(spark, sf):
    """The rows that the first three stages keep, by the operators' own results."""
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = table
    for _, stage in corpus_pipeline.STAGES[:3]:
        rows = corpus_pipeline.stored(stage(spark, rows, sf), "test")
    known = language_id.keep_language(table)
    first = {r["doc_id"] for r in near_dup.near_duplicates(known).where("doc_id = component_id").collect()}
    dirty = {r["doc_id"] for r in decontaminate.contamination(known, spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    assert {r["doc_id"] for r in rows.collect()} == first - dirty


def test_empty_documents(spark, sf):
    rows = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        rows = corpus_pipeline.stored(stage(spark, rows, sf), "test")
    assert rows.count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_language_stage_drops_noise_and_hands_on_the_language(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    noise = ["xqzj kvwp zzqx jjkw qpxz vvkq xzjq wkpq zxcv qwjk pzxq vkjw", "g$k;hZ5zoa$P9L,:ivWk8_-uQE`_SD49Ih1Kqwz xkq vvq zzkq", "12 34 !!", None]
    rows = docs(spark, [(10**7 + i, t, None, "s") for i, t in enumerate(noise)])
    given = table.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, None).otherwise(F.col("lang")))
    kept = language_id.keep_language(given.unionByName(rows.select(*table.columns))).cache()
    assert kept.where("doc_id >= 10000000").count() == 0 and kept.count() >= 0.999 * table.count()
    true = table.select("doc_id", F.col("lang").alias("true"))
    assert kept.join(true, "doc_id").agg(F.avg((F.col("lang") == F.col("true")).cast("int"))).first()[0] > 0.98


def test_languages_and_limits_come_from_all_labelled_rows(spark, monkeypatch):
    """3,000 rows of one language: every gram is known, and the limit is that of all held-out rows."""
    texts = [f"the number of this line is {i * 7919} and no more words follow it {'zq' * (i % 5)}" for i in range(3000)]
    table = docs(spark, [(i, t, "en") for i, t in enumerate(texts)]).repartition(3)
    monkeypatch.setattr(language_id, "COUNT_CHUNK", 5000)
    held = {r["doc_id"] for r in table.where(language_id.held_out(F.col("doc_id"))).collect()}
    trees = language_id.train(table.where(~language_id.held_out(F.col("doc_id"))))
    counts = Counter(g for i, t in enumerate(texts) if i not in held for g in language_id._grams(np.frombuffer(language_id.padded(t.encode()), np.uint8), 4).tolist())
    grams = np.array(sorted(counts), np.uint64)
    own = language_id.ContextTrees(["en"], {"en": (grams, np.array([counts[g] for g in grams.tolist()]))})
    assert all(np.array_equal(a[k], b[k]) for a, b in zip(trees.levels, own.levels) for k in ("grams", "bits", "escape"))
    _, running, n = own.measure([texts[i].encode() for i in sorted(held)])
    rates = running[:, 0] / n
    assert language_id.limits(table, trees).collect() == [("en", pytest.approx(rates.mean() + language_id.SPREAD * rates.std()))]


def test_few_held_out_rows_set_no_limit(spark):
    rows = docs(spark, [(i, "the cat sat on the mat and that was all that it did " * (1 + i % 2), "en") for i in range(60)])
    assert language_id.limits(rows, language_id.train(rows)).count() == 0


def test_differing_texts_of_one_id_stay(spark):
    rows = docs(spark, [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, "alpha beta gamma delta epsilon zeta"), (None, "x"), (3, None), (4, "")])
    kept = sorted((r["doc_id"] or 0, r["text"] or "") for r in near_dup.drop_near_duplicates(rows).collect())
    assert kept == [(0, "x"), (1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six seven"), (3, "")]


def awkward_documents(spark):
    """The awkward rows and some with personal data and benchmark passages, with columns of clashing names."""
    told = [(20, "write to ann@example.org now", "en", "s"), (20, "write to ann@example.org now", "en", "s"), (21, PASSAGE, None, None), (21, PASSAGE, None, None), (None, PASSAGE, "en", "s")]
    return clashing(awkward(spark).unionByName(docs(spark, told)))


PASSAGE = " ".join(f"Item{i}" for i in range(14))


def said(df, *columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_awkward_rows_of_the_decontamination_stage(spark, tmp_path):
    rows = awkward_documents(spark)
    spark.createDataFrame([("a", PASSAGE.lower()), ("b", None), ("c", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.decontamination_stage(spark, rows, str(tmp_path))
    clean = rows.where(F.coalesce(F.col("text") != PASSAGE, F.lit(True)))
    assert kept.columns == rows.columns and said(kept, *rows.columns) == said(clean, *rows.columns)


def test_awkward_rows_of_the_pii_stage(spark, sf):
    rows = awkward_documents(spark)
    out = corpus_pipeline.pii_stage(spark, rows, sf).cache()
    assert out.columns == rows.columns
    others = [c for c in rows.columns if c not in ("text", "n_chars")]
    assert said(out, *others) == said(rows, *others)
    assert out.where("text like '%ann@example%'").count() == 0 and out.where("doc_id = 20").count() == 2
    quiet = "doc_id is null or doc_id in (1, 2, 3, 4, 6, 7, 21)"
    assert said(out.where(quiet), "doc_id", "text", "n_chars") == said(rows.where(quiet), "doc_id", "text", "n_chars")
    assert out.where("text is null").count() == 1 and out.where("n_chars <> length(text)").count() == 0


def test_awkward_rows_of_the_mixing_stage(spark, sf):
    rows = awkward_documents(spark).withColumn("mix_probability", F.lit("x"))
    out = corpus_pipeline.mixing_stage(spark, rows, sf).cache()
    assert sorted(out.columns) == sorted(rows.columns) and dict(out.dtypes)["mix_probability"] == "double"
    given = [c for c in rows.columns if c != "mix_probability"]
    assert set(said(out, *given)) <= set(said(rows, *given))
    assert out.where("doc_id in (1, 2, 3)").count() == 0  # no word
    assert all(out.where(f"doc_id = {i}").count() in (0, 2) for i in (4, 20, 21))
    assert out.where("mix_probability <= 0 or mix_probability > 1").count() == 0
