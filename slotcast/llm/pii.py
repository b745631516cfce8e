"""Personal data by weak supervision, in DataFrame functions only.

Four base finders (email, ip, card, phone) have fixed rules; what they find always
stays.  Wider finders propose more candidates.  Labelers vote on every candidate, for
(1), against (-1) or not at all (0): a shape labeler (regular expressions and check
digits), a gazetteer labeler (lists of domains, issuers, prefixes), a context labeler
(cue words beside the span) and a boundary labeler.  Expectation-maximisation over
the counts of vote patterns estimates, for each kind, how often each labeler votes
each way on true and on false candidates.  Its posteriors are the soft labels on which
a logistic regression, the final span classifier, is trained; candidates that it
accepts are added to the base spans.

Only the table of patterns, whose size the number of votes, kinds and length classes
bounds, is ever gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

KINDS = ["email", "ip", "card", "phone"]
LABELERS = ["shape", "gazetteer", "context", "boundary"]
ROUNDS = 8
BESIDE = 48
RUN = 256
#: Code points of a piece of text in which places are looked up.
PIECE = 1024
#: Bits of a span's form, and classes of the word before it.
FORM_BITS, WORD_CLASSES = 4, 8

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: A run is entered where it begins or where the last match ended, and never given
#: back: the same matches as the plain patterns, in time linear in the text.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9]){13,}+",  # a shorter run can't pass, nor can a part of it
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?+(?:\(at\)|\[at\]|\{at\}) ?+[A-Za-z0-9-]{1,63}+(?: ?+(?:\.|\(dot\)|\[dot\]|\{dot\}) ?+[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.)(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
}
#: Strings of which every text with a match holds one; all others need a digit.
HINTS = {"email": (["@"], ["at)", "at]", "at}"]), "ip": (None, [":"]), "card": (None, None), "phone": (["+"], None)}
DIGIT = "has a digit"

# Cue words and lists of the labelers.
CUES = {
    "email": "e-?mail|mailto|contact|write to|reply|kontakt|correo|courriel|adresse",
    "ip": "ip|host|server|address|login|from|ping|adresse|servidor|serveur",
    "card": "card|visa|mastercard|amex|credit|debit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp|telefon|handy|anruf|tel[eé]fono|t[eé]l[eé]phone",
}
AGAINST = "version|release|isbn|issn|order|invoice|sku|part no|serial|build|chapter|figure|doi|page"
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|eu|de|fr|es|uk|it|nl|ch|at|us|ca"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|64[4-9]|35|30[0-5]|3[689]|62"


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if the check digit of a string of digits is right."""
    back = F.reverse(digits)
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    """At most 255, for any run of digits."""
    bare = F.regexp_replace(part, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), _small)
    if kind == "card":
        digits = _digits(hit)
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(10, 15)
    return F.lit(True)


_FOUND = "array<struct<kind:int,start:int,end:int,hit:string,before:string,after:string>>"


def _likely(text: Column, hints: list[str] | None) -> Column:
    """False only for texts without a match; far cheaper than the pattern."""
    if hints is None:
        return F.col(DIGIT)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(h)) for h in hints])


def _matches(text: Column, kind: str, pattern: str, likely: Column) -> Column:
    """Every match with its place in code points and the text beside it.

    The pieces between matches and the matches come from the same pattern, so their
    lengths add up to the places.
    """
    hits, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.arrays_zip(hits.alias("h"), pieces.alias("p"), F.slice(pieces, 2, 1 << 30).alias("n"))
    start = F.struct(F.lit(0).alias("at"), F.lit([]).cast(_FOUND).alias("out"))

    def add(a, x):
        begin = a["at"] + F.length(x["p"])
        end = begin + F.length(x["h"])
        one = F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), begin.alias("start"), end.alias("end"), x["h"].alias("hit"),
            F.right(x["p"], F.lit(BESIDE)).alias("before"), F.left(x["n"], F.lit(BESIDE)).alias("after"),
        )
        return F.when(x["h"].isNull(), a).otherwise(F.struct(end.alias("at"), F.concat(a["out"], F.array(one)).alias("out")))

    def shifted(x, by):
        return F.struct(x["kind"].alias("kind"), (x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), x["after"].alias("after"))

    def join(a, part):
        moved = F.transform(part["out"], lambda x: shifted(x, a["at"]))
        return F.struct((a["at"] + part["at"]).alias("at"), F.concat(a["out"], F.array(moved)).alias("out"))

    def places(found):
        """Runs of RUN matches each, then the runs: appending to one long array would be quadratic."""
        numbers = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / RUN).cast("int"))
        parts = F.transform(numbers, lambda k: F.aggregate(F.slice(found, k * RUN + 1, RUN), start, add))
        none = F.struct(F.lit(0).alias("at"), F.lit([]).cast(f"array<{_FOUND}>").alias("out"))
        return F.aggregate(parts, none, join, lambda a: F.flatten(a["out"]))

    whole = F.element_at(F.transform(F.array(rows), places), 1)  # so the matches are found once
    return F.when(likely, whole).otherwise(F.lit([]).cast(_FOUND))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("byte")


def _votes(kind: Column, hit: Column, before: Column, after: Column) -> dict[str, Column]:
    digits = _digits(hit)
    n = F.length(digits)
    near = F.lower(before)

    def by_kind(*columns: Column) -> Column:
        return reduce(lambda out, k: F.when(kind == k, columns[k]).otherwise(out), range(len(KINDS)), F.lit(0).cast("byte"))

    shape = by_kind(
        _vote(hit.rlike(r"(?i)^[a-z0-9][a-z0-9._%+-]*(@|[^a-z0-9]*at[^a-z0-9]*)[a-z0-9]"), hit.rlike(r"^[._%+-]|\.\.|-@")),
        _vote(hit.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|:"), hit.rlike(r"(^|\.)0[0-9]|[0-9]{4}")),
        F.when(n.between(14, 19), _vote(luhn(digits), F.lit(True))).otherwise(F.lit(-1).cast("byte")),
        _vote(n.between(10, 13) & hit.rlike(r"[ ().-]"), ~n.between(10, 15)),
    )
    gazetteer = by_kind(
        _vote(hit.rlike(rf"(?i)[^a-z0-9](?:{DOMAINS})$"), hit.rlike(r"(?i)\.(?:png|jpg|gif|js|css|html?)$")),
        _vote(hit.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|:"), hit.rlike(r"^0")),
        _vote(digits.rlike(f"^(?:{ISSUERS})"), digits.rlike("^0")),
        _vote(hit.rlike(r"^\+(?:1|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])|^\(?[2-9]"), digits.rlike("^0")),
    )
    context = by_kind(
        *[_vote(near.rlike(rf"(?:^|[^a-z])(?:{CUES[k]})[^a-z]*(?:[a-z]+[^a-z]+){{0,2}}$"), near.rlike(rf"(?:^|[^a-z])(?:{AGAINST})[^a-z]*$")) for k in KINDS]
    )
    clear = ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
    return {"shape": shape, "gazetteer": gazetteer, "context": context, "boundary": _vote(clear, ~clear)}


def _form(hit: Column, before: Column, after: Column) -> Column:
    """Four bits: blanks within, brackets or signs within, a label's colon before, an end after."""
    bits = [hit.rlike(" "), hit.rlike(r"[().+-]"), before.rlike(r"[:=#] ?$"), after.rlike(r"^(?:$|[\s,;.!?])")]
    return reduce(lambda a, b: a + b, [F.when(bit, 1 << i).otherwise(0) for i, bit in enumerate(bits)]).cast("byte")


def _word(before: Column) -> Column:
    """The class of the last word before a span, by a hash; 0 if there is none."""
    word = F.regexp_extract(F.lower(before), r"(\p{L}+)\P{L}*$", 1)
    return F.when(word == "", 0).otherwise(F.pmod(F.xxhash64(word), F.lit(WORD_CLASSES - 1)) + 1).cast("byte")


_CAND = "struct<start:int,kind:int,end:int,base:boolean," + ",".join(f"{x}:tinyint" for x in (*LABELERS, "size", "form", "word")) + ">"


def candidates(text: Column) -> Column:
    """Candidates of a text: start, kind (number), end, base, votes, length class, form and class of the word before.

    Places are in code points, the end exclusive.  Base candidates passed their rules;
    wide ones overlap none of them.
    """

    def found(kind: str, patterns: dict, hints: list[str] | None, check: bool) -> Column:
        spans = _matches(text, kind, patterns[kind], _likely(text, hints))
        return F.filter(spans, lambda x: _valid(kind, x["hit"])) if check else spans

    base = F.concat(*[found(k, BASE, HINTS[k][0], True) for k in KINDS])
    wide = F.concat(*[found(k, WIDE, HINTS[k][1], k == "card") for k in KINDS])  # a wrong check digit is no card

    def out(is_base: bool):
        def one(x):
            votes = _votes(x["kind"], x["hit"], x["before"], x["after"])
            votes |= {"size": F.least(F.floor(F.length(x["hit"]) / 8), F.lit(4)).cast("byte"), "form": _form(x["hit"], x["before"], x["after"]), "word": _word(x["before"])}
            return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(is_base).alias("base"), *[v.alias(k) for k, v in votes.items()])

        return one

    both = F.struct(F.transform(base, out(True)).alias("base"), F.transform(wide, out(False)).alias("wide"))
    return F.element_at(F.transform(F.array(both), lambda x: F.when(F.size(x["wide"]) == 0, x["base"]).otherwise(_apart(x["base"], x["wide"]))), 1)


def _in_runs(items: Column, state: Column, step, out: str) -> Column:
    """What ``step(state, item) -> (state, made)`` makes of each item in turn, as one array of type ``out``.

    Runs of RUN items are gathered and then put together: appending to one long array
    would copy it for every item.
    """

    def inner(a, x):
        now, made = step(a["s"], x)
        return F.struct(now.alias("s"), F.concat(a["out"], F.array(made)).alias("out"))

    def outer(a, k):
        run = F.aggregate(F.slice(items, k * RUN + 1, RUN), F.struct(a["s"].alias("s"), F.lit([]).cast(f"array<{out}>").alias("out")), inner)
        return F.element_at(F.transform(F.array(run), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out"))), 1)

    numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / RUN), F.lit(0)).cast("int"))
    return F.aggregate(numbers, F.struct(state.alias("s"), F.lit([]).cast(f"array<array<{out}>>").alias("out")), outer, lambda a: F.flatten(a["out"]))


def _apart(base: Column, wide: Column) -> Column:
    """Base candidates and the wide ones that overlap none of them, by start.

    In order of starts, a base candidate that overlaps either begins before and ends
    beyond the start (the largest end so far), or is the next that begins.
    """
    marked = f"struct<x:{_CAND},clash:boolean>"

    def ahead(upto, x):
        return F.when(x["base"], F.greatest(upto, x["end"])).otherwise(upto), F.struct(x.alias("x"), (~x["base"] & (x["start"] < upto)).alias("clash"))

    def back(following, y):
        x = y["x"]
        clash = y["clash"] | (~x["base"] & (following < x["end"]))
        return F.when(x["base"], x["start"]).otherwise(following), F.struct(x.alias("x"), clash.alias("clash"))

    one_way = F.element_at(F.transform(F.array(F.array_sort(F.concat(base, wide))), lambda c: F.reverse(_in_runs(c, F.lit(0), ahead, marked))), 1)
    both_ways = F.element_at(F.transform(F.array(one_way), lambda c: F.reverse(_in_runs(c, F.lit(2**31 - 1), back, marked))), 1)
    return F.transform(F.filter(both_ways, lambda y: ~y["clash"]), lambda y: y["x"])


def with_candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the array ``cands`` added: base ones, and wide ones apart from those."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn(DIGIT, text.rlike("[0-9]")).withColumn("cands", candidates(text))
    return rows.drop(DIGIT)


def _patterns(found: DataFrame) -> DataFrame:
    """Counts of (kind, votes, size, form, word): at most 4 x 3**4 x 5 x 16 x 8 rows."""
    return found.select(F.explode("cands").alias("x")).select("x.*").groupBy("kind", *LABELERS, "size", "form", "word").agg(F.count("*").alias("n"))


def posteriors(patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``patterns`` of votes, at most 4 x 3**4 rows, with ``p``, the probability that a candidate with these votes is true.

    Expectation-maximisation within each kind, whose patterns are one array: sums over
    the patterns of a vote give how often a labeler votes so on true and on false
    candidates; these give the odds of each pattern.  Starts from the majority of votes;
    a weak prior says that labelers are more often right than wrong, so the two classes
    can't change places.
    """

    def total(items, of):
        return F.aggregate(items, F.lit(0.0), lambda a, x: a + of(x))

    def once(value, f):
        return F.element_at(F.transform(F.array(value), f), 1)

    def rates(x):
        """The odds of a kind, and for each labeler those of its three votes."""
        t, f = total(x, lambda y: y["t"]), total(x, lambda y: y["f"])

        def vote(name, w):
            right = 2.0 ** (w + 1)  # 1, 2 or 4 votes before any is seen
            says_true, says_false = (total(x, lambda y: F.when(y["v"][name] == w, y[k]).otherwise(0.0)) for k in "tf")
            return F.log(((says_true + right) / (t + 7)) / ((says_false + 4 / right) / (f + 7)))

        return F.struct(F.log((t + 1) / (f + 1)).alias("whole"), *[F.array(*[vote(name, w) for w in (-1, 0, 1)]).alias(name) for name in LABELERS])

    def again(p, _):
        split = F.zip_with("_rows", p, lambda y, q: F.struct(y.alias("v"), (y["n"] * q).alias("t"), (y["n"] * (1 - q)).alias("f")))
        odds = lambda y, r: reduce(lambda a, name: a + F.get(r[name], y[name].cast("int") + 1), LABELERS, r["whole"])
        return once(once(split, rates), lambda r: F.transform("_rows", lambda y: 1 / (1 + F.exp(-odds(y, r)))))

    start = F.transform("_rows", lambda y: 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [y[x].cast("double") for x in LABELERS]))))
    kinds = patterns.groupBy("kind").agg(F.collect_list(F.struct(*patterns.columns)).alias("_rows"))
    rated = kinds.select("_rows", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, again).alias("_p"))
    each = F.explode(F.arrays_zip("_rows", "_p")).alias("_x")
    return stored(rated.select(each).select("_x._rows.*", F.col("_x._p").alias("p")), "posteriors")


def reliabilities(rated: DataFrame) -> DataFrame:
    """kind, labeler, vote, and how often it is cast on true and on false candidates."""
    votes = F.explode(F.array(*[F.struct(F.lit(x).alias("labeler"), F.col(x).alias("vote")) for x in LABELERS]))
    cast = rated.select("kind", "n", "p", votes.alias("v")).groupBy("kind", "v.labeler", "v.vote")
    sums = cast.agg(F.sum(F.col("n") * F.col("p")).alias("t"), F.sum(F.col("n") * (1 - F.col("p"))).alias("f"))
    whole = Window.partitionBy("kind", "labeler")
    return sums.select("kind", "labeler", "vote", (F.col("t") / F.sum("t").over(whole)).alias("on_true"), (F.col("f") / F.sum("f").over(whole)).alias("on_false"))


def _features(get) -> list[Column]:
    """For each kind, where the kind is this one: 1, the votes, the length class, the bits of the form and the class of the word before."""
    form = [get("form").bitwiseAND(F.lit(1 << i).cast("byte")) != 0 for i in range(FORM_BITS)]
    word = [get("word") == w for w in range(1, WORD_CLASSES)]
    each = [F.lit(1.0), *[get(x).cast("double") for x in LABELERS], get("size").cast("double") / 4, *[x.cast("double") for x in (*form, *word)]]
    return [F.when(get("kind") == k, x).otherwise(0.0) for k in range(len(KINDS)) for x in each]


def train(found: DataFrame) -> list[float] | None:
    """Weights of the span classifier from candidates ``cands``; None if there are none."""
    patterns = stored(_patterns(found), "patterns")
    if patterns.isEmpty():
        return None
    votes = stored(patterns.groupBy("kind", *LABELERS).agg(F.sum("n").alias("n")).coalesce(1), "votes")
    soft = patterns.join(posteriors(votes).drop("n"), ["kind", *LABELERS]).withColumn("features", array_to_vector(F.array(*_features(F.col))))
    rows = soft.select("features", F.lit(1.0).alias("label"), (F.col("n") * F.col("p")).alias("w")).unionByName(
        soft.select("features", F.lit(0.0).alias("label"), (F.col("n") * (1 - F.col("p"))).alias("w"))
    )
    fit = LogisticRegression(weightCol="w", regParam=1e-3, maxIter=15, standardization=False, fitIntercept=False).fit(stored(rows.coalesce(4), "soft-labels"))
    return [float(x) for x in fit.coefficients]


def accepted(cands: Column, weights: list[float] | None) -> Column:
    """Base candidates, and those that the classifier takes for true, by start and kind."""

    def keep(x):
        if weights is None:
            return x["base"]
        odds = reduce(lambda a, b: a + b, [F.lit(w) * f for w, f in zip(weights, _features(lambda name: x[name]))])
        return x["base"] | (odds > 0)

    slim = F.transform(F.filter(cands, keep), lambda x: F.struct(x["start"], x["kind"], x["end"], x["base"]))
    return F.array_sort(slim)


def find_spans(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all) of every row of ``docs``, and the array ``spans``.

    A span is (start, kind number, end, base).  Learns from all candidates of ``docs``.
    Null texts count as empty; repeated rows count as often as they occur; an empty
    table stays empty; columns named spans or cands are replaced; a text may be as long
    as a string can be.  Candidates are found once and written to the shared folder with
    the kept columns.
    """
    docs = docs.drop("spans", "cands")
    found = stored(with_candidates(docs, text_col).select(*(keep or docs.columns), "cands"), "candidates")
    return found.withColumn("spans", accepted(F.col("cands"), train(found))).drop("cands")


def written(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span (sorted by start) replaced by its kind in brackets; overlaps count as one.

    The text is cut into pieces of PIECE code points once, so a place is found without
    counting from the start of the text.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def whole(x):
        pieces = x["pieces"]

        def between(a, b):
            """Code points from ``a`` up to ``b``."""
            i, j = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
            head, middle, tail = F.substring(F.get(pieces, i), a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, i + 2, j - i - 1), ""), F.substring(F.get(pieces, j), F.lit(1), b % PIECE)
            return F.when(b <= a, "").when(i == j, F.substring(F.get(pieces, i), a % PIECE + 1, b - a)).otherwise(F.concat(head, middle, F.coalesce(tail, F.lit(""))))

        def add(upto, s):
            new = F.concat(between(upto, s["start"]), F.element_at(names, s["kind"] + 1))
            return F.greatest(upto, s["end"]), F.when(s["start"] >= upto, new).otherwise("")

        rest = between(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
        return F.concat(F.array_join(_in_runs(spans, F.lit(0), add, "string"), ""), rest)

    cut = F.array(F.struct(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces")))
    return F.when(F.size(spans) > 0, F.element_at(F.transform(cut, whole), 1)).otherwise(text)


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` masked and ``n_chars`` counted anew where it was; see :func:`find_spans` for the other cases.

    All other columns pass through, whatever their names.
    """
    others = F.struct(*[c for c in docs.columns if c != "text"]).alias("row")
    found = find_spans(docs.select("text", others)).withColumn("masked", masked(F.col("text"), F.col("spans")))
    own = {"text": F.col("masked"), "n_chars": F.when(F.size("spans") > 0, F.length("masked").cast("long")).otherwise(F.col("row")["n_chars"])}
    return found.select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
