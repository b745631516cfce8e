"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed to cells (source, language, topic).  The token weights of the
cells are raked: one margin after the other is scaled to its target until all hold.
A cell can give no more than its tokens: one that has reached them is full, and what
its margins still need is asked of their other cells.  A cell's weight is
``tokens * least(1, a[source] * b[lang] * c[topic])``, which is of all weights that meet
the margins the closest to the tokens.  A document is sampled with the probability that
its cell's weight has against its cell's tokens, by a fixed draw from its id.
DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import stored

MARGINS = ["source", "lang", "topic"]
#: Raking ends when no margin is off its target by more than this share, or after so many rounds.
TOLERANCE, ROUNDS = 1e-4, 60
#: From this share of its tokens on a cell is full; a little under 1, as sums in another order differ in their last digits.
FULL = 1 - 1e-9
#: Share of all tokens to keep, and the power that evens out the margins' shares.
KEEP, EVEN = 0.5, 0.7
WORD = r"[^\x20\x09-\x0D]+"
#: Forms of text: the first whose pattern the text holds is the topic; else it goes by length.
FORMS = [("list", r"(?:^|\n)[ \t]*(?:[-*]|[0-9]+[.)]) "), ("table", r" \| |\t"), ("symbols", r"[#-&*+<->@\\^_`|~]{3}"), ("numbers", "[0-9]{4}")]
SHORT, LONG = 400, 4000
#: So many cells are raked in one partition, where sums and joins need no shuffle; more are dealt out.
ONE_PARTITION = 100_000


def topic_of(text: Column) -> Column:
    """A coarse topic by the form of the whole text; null texts have ``none``."""
    out = F.when(F.length(text) < SHORT, "short").when(F.length(text) >= LONG, "long").otherwise("prose")
    for topic, pattern in reversed(FORMS):
        out = F.when(text.rlike(pattern), topic).otherwise(out)
    return F.when(text.isNull(), "none").otherwise(out)


def token_weight(text: Column) -> Column:
    """Words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number from 0 to 1 (exclusive), fixed by id and seed; by the text where there is no id."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name).cast("binary")), 1, 12)
    return F.conv(digest, 16, 10).cast("long") / float(1 << 48)


def cells(rows: DataFrame) -> DataFrame:
    """Tokens of each cell; null margins are cells of their own, named by the empty string."""
    return rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))


def margin_tokens(table: DataFrame, amount: str = "tokens") -> DataFrame:
    """(margin, value, amount): sums of a column of the cells for each value of each margin."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("value")) for m in MARGINS]))
    return table.select(each.alias("v"), amount).groupBy("v.margin", "v.value").agg(F.sum(F.col(amount).cast("double")).alias(amount))


def even_targets(table: DataFrame, keep: float = KEEP, even: float = EVEN) -> DataFrame:
    """(margin, value, target): each margin's shares to the power ``even``, of ``keep`` of all tokens."""
    sums = margin_tokens(table).where("tokens > 0")
    whole = sums.groupBy("margin").agg(F.sum("tokens").alias("all_tokens"), F.sum(F.pow("tokens", F.lit(even))).alias("powers"))
    return sums.join(whole, "margin").select("margin", "value", (F.pow("tokens", F.lit(even)) / F.col("powers") * F.col("all_tokens") * keep).alias("target"))


def reachable_targets(table: DataFrame, targets: DataFrame) -> DataFrame:
    """(margin, value, target): targets of at most the tokens that a value has; the rest is asked of its margin's others in proportion.

    Values that are not in ``table``, or have no tokens, have no target, and neither
    has one of 0 or less.  One factor for each margin does it, found from below in as
    many sums as values fill up one after another.
    """
    rows = targets.where("target > 0").join(margin_tokens(table), ["margin", "value"], "left")
    rows = stored(rows.withColumn("tokens", F.coalesce("tokens", F.lit(0.0))), "targets")
    factors, before = dict.fromkeys(MARGINS, 1.0), None
    while factors != before:
        before = dict(factors)
        grown = F.col("target") * reduce(lambda out, m: F.when(F.col("margin") == m, factors[m]).otherwise(out), MARGINS, F.lit(1.0))
        full = grown >= F.col("tokens")
        sums = rows.groupBy("margin").agg(F.sum("target").alias("total"), F.sum(F.when(full, F.col("tokens"))).alias("taken"), F.sum(F.when(~full, F.col("target"))).alias("left"))
        for r in sums.collect():  # one row for each margin
            if r["left"]:
                factors[r["margin"]] = max(factors[r["margin"]], (r["total"] - (r["taken"] or 0.0)) / r["left"])
    return rows.where("tokens > 0").select("margin", "value", F.least(grown, "tokens").alias("target"))


def _scaled(rows: DataFrame, margin: str, few: bool = False) -> DataFrame:
    """``times`` multiplied by one factor for each value of ``margin``; ``off_margin`` says how far it was off.

    The open cells share what the full ones leave of the target.  Sums by value are
    partial before they are shuffled, and come back by a join: no value's cells meet in one task.
    A ``few`` cells, in one partition anyway, are summed over windows: joins of rows with sums of the same
    rows would double the plan for every margin.
    """
    weight, goal = F.least("times", F.lit(1.0)) * F.col("tokens"), F.first(f"to_{margin}")
    open_ = F.sum(F.when(F.col("times") < FULL, F.col("times") * F.col("tokens")).otherwise(0.0))
    if few:
        own = Window.partitionBy(margin)
        sums = rows.withColumns({"goal": F.col(f"to_{margin}"), "now": F.sum(weight).over(own), "open": open_.over(own)})
    else:
        sums = rows.groupBy(margin).agg(goal.alias("goal"), F.sum(weight).alias("now"), open_.alias("open"))
    full = F.col("now") - F.col("open")
    share = F.when((F.col("open") > 0) & (F.col("goal") > full), (F.col("goal") - full) / F.col("open")).otherwise(F.col("goal") / F.col("now"))
    off = F.abs(F.col("now") / F.col("goal") - 1)
    if few:
        is_known = F.col("goal").isNotNull() & (F.col("now") > 0)
        times = F.col("times") * F.when(is_known, share).otherwise(1.0)
        return sums.withColumns({"times": times, f"off_{margin}": F.when(is_known, off)}).drop("goal", "now", "open")
    known = sums.where("goal is not null and now > 0").select(margin, share.alias("factor"), off.alias(f"off_{margin}"))
    out = rows.drop(f"off_{margin}").join(known.hint("shuffle_hash"), margin, "left")
    return out.withColumn("times", F.col("times") * F.coalesce("factor", F.lit(1.0))).drop("factor")


def rake(table: DataFrame, targets: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``table`` with ``weight`` added, at most each cell's tokens, so that each margin has its targets (margin, value, target).

    Targets beyond a value's tokens are bounded by :func:`reachable_targets`; a target
    of 0 or less empties its cells; a margin leaves cells alone whose value has no target.
    Cells without tokens are left out.  Ends when all margins are within ``tolerance``;
    targets that can't hold together end after ``rounds``: :func:`residuals` shows by
    how much each is missed.
    """
    table = table.where("tokens > 0").withColumn("tokens", F.col("tokens").cast("double"))
    goals = reachable_targets(table, targets).unionByName(targets.where("target <= 0").select("margin", "value", F.lit(0.0).alias("target")))
    for margin in MARGINS:
        own = goals.where(F.col("margin") == margin).select(F.col("value").alias(margin), F.col("target").alias(f"to_{margin}"))
        table = table.join(own, margin, "left")
    empty = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"to_{m}") <= 0, F.lit(False)) for m in MARGINS])
    table = stored(table.withColumn("empty", empty), "cells")
    few = table.count() <= ONE_PARTITION
    rows = table.where("not empty").drop("empty").withColumn("times", F.lit(1.0))
    rows = rows.withColumns({f"off_{m}": F.lit(None).cast("double") for m in MARGINS})
    worst = F.max(F.greatest(*[F.coalesce(f"off_{m}", F.lit(0.0)) for m in MARGINS]))
    for _ in range(rounds):
        seen = Observation()
        rows = stored(reduce(lambda out, m: _scaled(out, m, few), MARGINS, rows.coalesce(1) if few else rows).observe(seen, worst.alias("worst")), "raked")
        if (seen.get["worst"] or 0.0) <= tolerance:
            break
    weighed = rows.withColumn("weight", F.least("times", F.lit(1.0)) * F.col("tokens")).drop("times", *[f"off_{m}" for m in MARGINS])
    none = table.where("empty").drop("empty").withColumn("weight", F.lit(0.0))
    return weighed.unionByName(none).withColumn("tokens", F.col("tokens").cast("long")).drop(*[f"to_{m}" for m in MARGINS])


def residuals(raked: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with weight and missing (target - weight) added."""
    sums = margin_tokens(raked, "weight")
    both = targets.join(sums, ["margin", "value"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return both.withColumn("missing", F.col("target") - F.col("weight"))


def _cell(topic: Column | None) -> list[Column]:
    """The margins of a document as they name its cell."""
    topic = topic_of(F.col("text")) if topic is None else F.coalesce(topic.cast("string"), F.lit(""))
    return [F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic.alias("topic")]


def probabilities(rows: DataFrame, targets: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(source, lang, topic, probability) of the cells of ``rows``, which have n_tokens.

    A probability is the cell's raked weight over its tokens, rounded to 6 digits.
    """
    table = stored(cells(rows), "cell-tokens")
    targets = even_targets(table) if targets is None else targets
    return rake(table, targets, rounds).select(*MARGINS, F.round(F.col("weight") / F.col("tokens"), 6).alias("probability"))


def mix(docs: DataFrame, targets: DataFrame | None = None, rounds: int = ROUNDS, seed: str = "mix", topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and sampled of every row of ``docs``.

    ``targets`` are (margin, value, target in tokens); without, each margin is evened
    out.  ``topic`` is a column of ``docs``; without, the form of the
    text.  Null sources and languages are the empty string; documents without words are
    never sampled; rows of one doc_id share one draw, rows without id draw by their
    text; an empty table gives an empty result; other columns are ignored.
    """
    slim = docs.select("doc_id", *_cell(topic), token_weight(F.col("text")).alias("n_tokens"), draw(F.col("doc_id"), F.col("text"), seed).alias("draw"))
    rows = stored(slim, "weighted")
    out = rows.join(probabilities(rows, targets, rounds), MARGINS, "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    out = out.withColumn("sampled", (F.col("n_tokens") > 0) & (F.col("draw") < F.col("probability")))
    return out.select("doc_id", *MARGINS, "n_tokens", "probability", "sampled")


def sample_documents(
    docs: DataFrame, targets: DataFrame | None = None, rounds: int = ROUNDS, seed: str = "mix", topic: Column | None = None
) -> DataFrame:
    """The sampled rows of ``docs`` with ``mix_probability`` added; as :func:`mix`.

    A row finds its probability by its cell, so the texts are not shuffled.
    """
    columns = [c for c in docs.columns if c != "mix_probability"]
    rows = docs.select(*_cell(topic), token_weight(F.col("text")).alias("n_tokens"))
    chance = stored(probabilities(rows, targets, rounds).withColumnRenamed("probability", "mix_probability"), "chances")
    kept = docs.select(*columns).where(F.col("text").rlike(WORD))
    whole = kept.select(F.struct("*").alias("row"), *_cell(topic))
    chosen = whole.join(chance, MARGINS).where(draw(F.col("row.doc_id"), F.col("row.text"), seed) < F.col("mix_probability"))
    return chosen.select("row.*", "mix_probability")
