"""Mixing sources to target weights by iterative proportional fitting.

Token weights are summed per cell of (source, language, topic).  Raking scales the cells to
the target share of each source, then of each language, then of each topic, and repeats for
``ROUNDS`` rounds; the marginals of a cell table with the zero pattern of the data converge.
Where no targets are given, a value's share is its natural share to the power ``TEMPER``,
normalised: large sources, languages and topics are turned down a little.

A document's probability is its cell's raked weight over the cell's tokens, scaled so that
the largest is 1: no probability is cut, so expected tokens match the raked marginals.
A document stays if a number in [0, 1) made from its doc_id by MD5 lies below its
probability.  The draw depends on doc_id alone: it repeats, and copies of a row share it.

Everything is DataFrame work: one aggregation of the texts, partial sums per task before
the shuffle, so a source with a third of all rows is one row per task; all later steps see
the table of cells alone.

NULL source or language is a value of its own.  Null texts count no tokens and are topic
``empty``; a cell without tokens has probability 1, since it adds nothing to any marginal.
A value that explicit targets leave out has share 0.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import null_safe_join
from .common import saved

TEMPER = 0.9
ROUNDS = 8
DIMS = ("source", "lang", "topic")
SEED = "mix"


def tokens(text: str = "text") -> Column:
    return F.expr(rf"coalesce(regexp_count(`{text}`, r'[^\x20\x09-\x0D]+'), 0)").cast("long")


def topic(text: str = "text", n: str = "_tokens") -> Column:
    """A coarse topic from the form of a text: empty, table, markup, note, long or prose."""
    signs = F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))
    return (F.when(F.coalesce(F.col(n), F.lit(0)) == 0, "empty").when(F.instr(text, " | ") > 0, "table")
            .when(signs * 20 > F.length(text), "markup").when(F.col(n) < 50, "note")
            .when(F.col(n) >= 1000, "long").otherwise("prose"))


def draw(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, topic and tokens of every row."""
    return (docs.select("doc_id", "source", "lang", "text", tokens().alias("_tokens"))
            .select("doc_id", "source", "lang", topic().alias("topic"), F.col("_tokens").alias("tokens")))


def tempered(cells: DataFrame, dim: str, temper: float = TEMPER) -> DataFrame:
    """dim and share: natural shares to a power, normalised."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), temper).alias("s"))
    total = sums.agg(F.sum("s").alias("t")).first()["t"] or 1.0
    return sums.select(dim, (F.col("s") / F.lit(total)).alias("share"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame] | None = None, temper: float = TEMPER,
         rounds: int = ROUNDS) -> DataFrame:
    """Cells with their raked weight: dims, tokens, weight.  ``targets``: dim -> (dim, share)."""
    cells = saved(cells.where("tokens > 0"), "cells")
    goal = {d: saved((targets or {}).get(d) if targets and d in targets else tempered(cells, d, temper), f"target-{d}")
            for d in DIMS}
    out = saved(cells.withColumn("weight", F.col("tokens").cast("double")), "raked")
    total = cells.agg(F.sum("tokens").cast("double").alias("t")).first()["t"] or 0.0
    for _ in range(rounds):
        for d in DIMS:
            sums = out.groupBy(d).agg(F.sum("weight").alias("_sum"))
            factor = null_safe_join(sums, goal[d], [d], "left").select(
                d, F.expr("case when _sum > 0 then coalesce(share, 0) / _sum else 0 end").alias("_factor"))
            out = (null_safe_join(out, factor, [d]).withColumn("weight", F.col("weight") * F.col("_factor") * total)
                   .drop("_factor"))
        out = saved(out, "raked")
    return out


def probabilities(cells: DataFrame, **options) -> DataFrame:
    """dims and p of every cell that holds tokens."""
    raked = rake(cells, **options)
    top = raked.agg(F.max(F.col("weight") / F.col("tokens")).alias("top")).first()["top"] or 1.0
    return saved(raked.select(*DIMS, (F.col("weight") / F.col("tokens") / F.lit(top)).alias("p")), "probabilities")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, lang, topic, tokens, p and sampled of every row of ``docs``."""
    rows = saved(described(docs), "described")
    chance = probabilities(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), **options)
    return (null_safe_join(rows, chance, list(DIMS), "left").withColumn("p", F.coalesce("p", F.lit(1.0)))
            .withColumn("sampled", draw() < F.col("p")))


def sample(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix samples."""
    cells = described(docs).groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"))
    chance = probabilities(cells, **options)
    names = docs.columns
    rows = (docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "doc_id", "source", "lang", "text",
                        tokens().alias("_tokens")).select("_row", "doc_id", "source", "lang", topic().alias("topic")))
    kept = null_safe_join(rows, chance, list(DIMS), "left").where(draw() < F.coalesce("p", F.lit(1.0)))
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in names])


def oracle(temper: float = TEMPER, rounds: int = ROUNDS, seed: str = SEED) -> str:
    """The same in DuckDB SQL, one pair of steps per marginal and round."""
    steps, last = [], "c0"
    for r in range(rounds):
        for d in DIMS:
            name = f"r{r}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens, c.weight * g.share * "
                         f"(SELECT sum(tokens) FROM c0) / sum(c.weight) OVER (PARTITION BY c.{d}) AS weight FROM {last} c "
                         f"JOIN g_{d} g ON c.{d} IS NOT DISTINCT FROM g.{d})")
            last = name
    goals = [f"g_{d} AS MATERIALIZED (SELECT {d}, pow(sum(tokens), {temper}) / sum(pow(sum(tokens), {temper})) OVER () "
             f"AS share FROM c0 GROUP BY {d})" for d in DIMS]
    return rf"""WITH n AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS tokens FROM documents),
t AS MATERIALIZED (SELECT doc_id, source, lang, tokens, CASE WHEN tokens = 0 THEN 'empty'
 WHEN contains(text, ' | ') THEN 'table'
 WHEN length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) * 20 > length(text) THEN 'markup'
 WHEN tokens < 50 THEN 'note' WHEN tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM n),
c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens) AS tokens, sum(tokens)::DOUBLE AS weight FROM t
 GROUP BY source, lang, topic HAVING sum(tokens) > 0),
{', '.join(goals)}, {', '.join(steps)},
p AS (SELECT source, lang, topic, weight / tokens / max(weight / tokens) OVER () AS p FROM {last})
SELECT t.doc_id, t.source, t.lang, t.topic, t.tokens, round(coalesce(p.p, 1), 6) AS p,
 CAST('0x' || substr(md5(coalesce(CAST(t.doc_id AS VARCHAR), '') || ':{seed}'), 1, 12) AS BIGINT) / 281474976710656.0
 < coalesce(p.p, 1) AS sampled
FROM t LEFT JOIN p ON t.source IS NOT DISTINCT FROM p.source AND t.lang IS NOT DISTINCT FROM p.lang AND t.topic = p.topic"""
