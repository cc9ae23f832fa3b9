"""Personal data by fixed patterns, and the terms that give them away by co-occurrence.

**Base.** Emails, IPv4 addresses, card numbers and phone numbers are found per kind by
regular expressions over the whole text; places are code points, the end exclusive.  The
expressions are written with possessive repeats and a look behind, which match the same
stretches as the plain ones but stay linear on long runs and need no deep stack.

**Method.** A protected entity is a found value.  For each entity e and each term t (a word of
a text that holds e, beside the found values) the corpus tells how strongly t reveals e: with
n(t) texts that hold t and n(t, e) texts that hold both, whoever meets t guesses e with
p(e | t) = n(t,e) / (n(t) + ``PRIOR``), an estimate on the safe side: ``PRIOR`` more texts with t but without
e.  What is left of e's information then is -log2 p(e | t) bits, and what t gives is the PMI,
log2(p(e | t) / p(e)).  The disclosure is p(e | t) where t gives at least ``GAIN`` bits, else 0.  It does not depend on the
size of the corpus, and a word that met a value only once is no evidence.  Terms with a disclosure of at least
``REMOVE`` are removed and those from ``GENERALISE`` on (at most one bit is left) are
generalised to their form, wherever they stand in any text.  Counts cover all texts, words of any length and
values however rare.

Only DataFrame functions are used.  Counts are pre-aggregated per task before the shuffle;
an entity or a word that a third of all texts hold is one row per task.

Null texts are empty texts.  Rows are told apart by a number of their own, so NULL or
repeated doc_ids and repeated rows stay separate rows with equal results.  Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Kinds in their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text must pass to hold a match at all.
HINTS = {"email": "instr({t}, '@') > 0", "ip": "instr({t}, '.') > 0 and {t} rlike '[0-9][.][0-9]'",
         "card": "{t} rlike '[0-9][0-9 -]{{12}}'", "phone": "{t} rlike '[+][0-9]'"}
PRIOR = 2.0
GAIN = 3.0
#: Words are placed in pieces of so many, so that long texts stay linear.
PIECE = 64
REMOVE = 0.8
GENERALISE = 0.5
SPAN = "array<struct<start: int, kind: int, end: int, value: string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Digits from the right, every second one doubled, add up to a multiple of ten."""
    each = F.split(F.reverse(digits), "")
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int"))
                    .otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int"))),
        F.lit(0), lambda n, x: n + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0"))), lambda p: (F.length(p) <= 3) &
                        (F.coalesce(F.substring(p, 1, 3).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def find(kind: str, text: str) -> Column:
    """The spans of one kind: what lies between matches gives their places."""
    pattern = F.lit(PATTERNS[kind])
    gaps = F.split(text, PATTERNS[kind], -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    placed = F.aggregate(
        F.arrays_zip(gaps.alias("gap"), hits.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("found")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"),
            F.when(x["hit"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], F.array(F.struct(
                (acc["at"] + F.length(x["gap"])).alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                (acc["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"), x["hit"].alias("value"))))).alias("found")),
        lambda acc: acc["found"])
    some = F.expr(HINTS[kind].format(t=f"`{text}`"))
    return F.when(some, F.filter(placed, lambda s: valid(kind, s["value"]))).otherwise(
        F.expr(f"cast(array() as {SPAN})"))


def base_spans(docs: DataFrame) -> DataFrame:
    """row (a number of its own), doc_id, text and base (spans in order, with their value)."""
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.select("doc_id", "text", F.array_sort(F.concat(*[find(k, "text") for k in KINDS])).alias("base"))
    return saved(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", "base"), "base-spans")


def placed_words(rows: DataFrame) -> DataFrame:
    """Adds words (term, start, end) of the column text."""
    def piece(i):
        return F.slice("_w", i * PIECE + 1, PIECE)

    starts = F.aggregate(
        "_sizes", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out")),
        lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        lambda acc: acc["out"])

    def words(at, i):
        return F.aggregate(
            piece(i), F.struct(at.alias("at"), F.expr("cast(array() as array<struct<term: string, start: int, end: int>>)")
                               .alias("out")),
            lambda acc, w: F.struct((acc["at"] + F.length(w) + 1).alias("at"), F.when(w == "", acc["out"]).otherwise(
                F.concat(acc["out"], F.array(F.struct(w.alias("term"), acc["at"].alias("start"),
                                                      (acc["at"] + F.length(w)).alias("end"))))).alias("out")),
            lambda acc: acc["out"])

    return (rows.withColumn("_w", F.split("text", r"[\x20\x09-\x0D]", -1))
            .withColumn("_sizes", F.transform(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / PIECE).cast("int")),
                                              lambda i: F.aggregate(piece(i), F.lit(0), lambda n, w: n + F.length(w) + 1)))
            .withColumn("_starts", starts).withColumn("words", F.flatten(F.transform("_starts", words)))
            .drop("_w", "_sizes", "_starts"))


def beside(base: Column, t: Column) -> Column:
    """Whether a span overlaps none of the found values."""
    return ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))


def distinct_words() -> Column:
    return F.array_distinct(F.split("text", r"[\x20\x09-\x0D]+"))


def disclosures(base: DataFrame, n_texts: int, generalise: float = GENERALISE) -> DataFrame:
    """term, kind, value and how strongly the term reveals the value, from ``generalise`` on."""
    held = base.where("size(base) > 0").select("row", "text", "base", F.array_distinct(
        F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["value"].alias("value")))).alias("values"))
    terms = F.array_distinct(F.transform(F.filter("words", lambda w: beside(F.col("base"), w)), lambda w: w["term"]))
    # fewer texts with both can not reach the threshold: n(t) is at least n(t, e)
    pairs = saved(placed_words(held).select("values", F.explode(terms).alias("term"))
                  .select("term", F.explode("values").alias("e")).groupBy("e.kind", "e.value", "term")
                  .agg(F.count("*").alias("n_both")).where(F.col("n_both") / (F.col("n_both") + PRIOR) >= generalise), "pairs")
    texts_with = (base.select(F.explode(distinct_words()).alias("term")).where("term <> ''")
                  .groupBy("term").agg(F.count("*").alias("n_term")))
    # A plain join: a semi-join may be moved below the count, to every word of every text.
    known = saved(texts_with.join(pairs.select("term").distinct(), "term"), "term-counts")
    entities = saved(held.select(F.explode("values").alias("e")).groupBy("e.kind", "e.value")
                     .agg(F.count("*").alias("n_entity")), "entity-counts")
    p = F.col("n_both") / (F.col("n_term") + PRIOR)
    gain = F.log2(p * float(max(n_texts, 1)) / F.col("n_entity"))
    return (pairs.join(known, "term").join(entities, ["kind", "value"])
            .select("term", "kind", "value", F.when(gain >= GAIN, p).otherwise(0.0).alias("disclosure"))
            .where(F.col("disclosure") >= generalise))


def detect(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """row, doc_id, base and terms (spans start, end, action) of every row of ``docs``."""
    base = base_spans(docs)
    action = F.when(F.max("disclosure") >= remove, "remove").otherwise("generalise")
    revealing = saved(disclosures(base, base.count(), generalise).groupBy("term").agg(action.alias("action")), "disclosures")
    # words are placed only in texts that hold a revealing term; they are saved first, since a filter that explode brings
    # along would else be moved below the join, to every text
    holding = (base.select("row", F.explode(distinct_words()).alias("term")).join(revealing.select("term"), "term")
               .groupBy("row").agg(F.collect_list("term").alias("held")))
    rows = saved(base.select("row", "text").join(holding, "row"), "texts-with-terms")
    own = F.filter("words", lambda w: F.array_contains(F.col("held"), w["term"]))
    spans = (placed_words(rows).select("row", F.explode(own).alias("w"))
             .select("row", "w.term", "w.start", "w.end").join(revealing, "term")
             .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "action"))).alias("terms")))
    return base.join(saved(spans, "term-spans"), "row", "left").select(
        "row", "doc_id", F.transform("base", lambda s: s.dropFields("value")).alias("base"), F.filter(
            F.coalesce("terms", F.expr("cast(array() as array<struct<start: int, end: int, action: string>>)")),
            lambda t: beside(F.col("base"), t)).alias("terms"))


def _span_text(items: Column) -> Column:
    return F.array_join(items, ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, base_sha256 and spans of what :func:`detect` found."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform("base", lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"),
                                                     s["end"].cast("string")))
    every = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))),
        F.transform("terms", lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end")))))
    named = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_span_text(base).cast("binary"), 256).alias("base_sha256"),
        _span_text(F.transform(every, lambda s: F.concat_ws(
            ":", F.element_at(named, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))).alias("spans"))


def sanitise(text: Column, base: Column, terms: Column) -> Column:
    """The text with found values replaced by their kind, and terms removed or generalised.

    Spans that overlap are replaced together, under the name of the first."""
    kinds = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                             F.element_at(kinds, s["kind"] + 1).alias("by"))),
        F.transform(terms, lambda s: F.struct(
            s["start"].alias("start"), s["end"].alias("end"),
            F.when(s["action"] == "remove", "").when(F.substring(text, s["start"] + 1, s["end"] - s["start"])
                                                     .rlike("[0-9]"), "[NUMBER]").otherwise("[WORD]").alias("by")))))
    made = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["by"]))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return made
