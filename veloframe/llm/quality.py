"""Quality by an interpolated modified Kneser-Ney model of character trigrams.

**Units.** Characters as they are, in every script; runs of white space are one space and all digits one.  Two pads lead.
A trigram is three code points of 21 bits in one number, so trigrams are exact.

**Counts.** Tasks read each text and hand on the trigrams of a block of texts, once each, with their count in trusted texts; a
shuffle sums them.  Discounts come from the counts of counts.  Probabilities of the three orders are put together by
joins of the count tables: trigram counts with totals of their contexts, those with continuation counts of the shorter
context, down to the uniform distribution.  The table holds every trigram of the corpus and grows with it.  The cost of a
trigram is its negative log probability.

**Score.** The costs of the trigrams that most texts hold, at most ``FREQUENT`` of them, are broadcast; tasks read the texts again
and sum these costs at once, a row per text.  The other trigrams, if any, are handed on: a row per such trigram of a block of texts,
with the texts that hold it, and how often, as packed numbers.  These rows are joined with the costs by trigram and summed per
text, first in the tasks, so a text has at most a row per rare trigram that it holds.  All trigrams count, and the result does not
depend on ``FREQUENT``.  Word pairs in place of trigrams were tried: nearly every one is new in its block, 20.8 million rows on
0.10 GB, and the disk budget was passed.

**Cross-fitting.** A text that the model was trained on looks better than it is, so there are two models: texts are dealt to two
folds by their content, and each is scored by the model of the other fold's trusted texts.  Copies share a fold.  A fold
without trusted units is replaced by all.

**Perplexity** is exp of the mean cost per character, where ``PRIOR`` characters at the trusted mean are added so that a text
of a few characters is not judged by chance.  Equal texts have one perplexity.  A text is rejected above the ``quantile`` of the
perplexities of trusted texts of its language, widened by ``slack``.  With fewer than ``min_trusted`` trusted texts the language's
threshold lies between that and the quantile of all its own documents, in proportion to their number: other languages never
judge it.

Quantiles are Spark's mergeable sketches, so a language with a third of all rows is many
partial sketches.  All trusted rows count; nothing is sampled.

Null or empty texts, and texts of white space only, are rejected (perplexity NULL).
Without any trusted text everything else is kept.  Ties with the threshold are kept.
Repeated rows are judged alike.  Labels: a text is trusted if any of its label rows says
quality 1 and none says quality 0 or toxic 1; NULL labels say nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, saved

PRIOR = 40
#: A block holds about so many distinct (text, trigram), and at most so many texts.
BLOCK = 2_000_000
BLOCK_TEXTS = 4096
#: Blocks that a task sums at once before it hands the sums on.
OPEN_BLOCKS = 256
BITS = 21
LAST = (1 << BITS) - 1
#: Trigrams whose costs are broadcast, at most (24 bytes each); the others are joined by a shuffle, the result is the same.
FREQUENT = 1_000_000
#: Trusted ids beyond this are joined by a shuffle instead of a broadcast; the result is the same.
BROADCAST_ROWS = 1_000_000
POSTINGS = "block long, fold int, gram long, docs binary, times binary, doc int, cost double, n long, key1 long, key2 long"
SUMS = "block long, doc int, cost double, n long, key1 long, key2 long"


def units(text: str | None) -> np.ndarray:
    """The code points of a text, normalised; none for a text without a character other than white space."""
    if not text or text.isspace():
        return np.zeros(0, np.int64)
    own = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    space = ((own >= 9) & (own <= 13)) | (own == 32) | (own == 133) | (own == 160) | ((own >= 8192) & (own <= 8202)) | (own == 12288)
    own[space] = 32
    own[(own >= 48) & (own <= 57)] = 48
    return own[~(space & np.concatenate([[True], space[:-1]]))]


def trigrams(text: str | None) -> np.ndarray:
    own = units(text)
    padded = np.concatenate([[0, 0], own])
    return (padded[:-2] << 2 * BITS) | (padded[1:-1] << BITS) | padded[2:]


def _blocks(batches):
    """(sequence number, fold, [(grams, times, trusted, n, key1, key2)]) of the texts of a task; a block has texts of one fold."""
    sequence, held, size = TaskContext.get().partitionId() << 32, ([], []), [0, 0]
    for batch in batches:
        for text, good, key1, key2 in zip(*batch.columns):
            own, fold = trigrams(text.as_py()), key1.as_py() & 1
            held[fold].append((*np.unique(own, return_counts=True), bool(good.as_py()), len(own), key1.as_py(), key2.as_py()))
            size[fold] += len(held[fold][-1][0])
            if size[fold] >= BLOCK or len(held[fold]) >= BLOCK_TEXTS:
                yield sequence, fold, held[fold]
                sequence, held[fold][:], size[fold] = sequence + 1, [], 0
    for fold in (0, 1):
        if held[fold]:
            yield sequence, fold, held[fold]
            sequence += 1


def trigram_counts(texts: DataFrame) -> DataFrame:
    """gram, own0, own1 (its count in the trusted texts of each fold) and held (the texts with it) of every trigram of rows (text, trusted, key1, key2)."""
    def run(batches):
        for _, fold, texts in _blocks(batches):
            gram, place = np.unique(np.concatenate([t[0] for t in texts]), return_inverse=True)
            times = np.concatenate([t[1] * t[2] for t in texts])
            own = np.bincount(place, weights=times, minlength=len(gram)).astype(np.int64)
            other = np.zeros(len(gram), np.int64)
            held = np.bincount(place, minlength=len(gram))
            yield pa.RecordBatch.from_arrays([pa.array(gram), *map(pa.array, (other, own) if fold else (own, other)), pa.array(held)],
                                             names=["gram", "own0", "own1", "held"])

    return (texts.select("text", "trusted", "key1", "key2").mapInArrow(run, "gram long, own0 long, own1 long, held long")
            .groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("own0", "own1", "held")]))


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """One binary per stretch of ``values`` that begins at ``starts``."""
    ends = np.append(starts, len(values)) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def frequent_costs(costs: DataFrame) -> tuple[tuple[np.ndarray, ...], DataFrame | None]:
    """gram (ascending), cost0 and cost1 of the trigrams that most texts hold, and the rows of the others (None without any).

    The first have one number of texts or more, the smallest power of two that at most ``FREQUENT`` trigrams reach.
    """
    reach = costs.agg(*[F.count_if(F.col("held") >= F.lit(1 << k)).alias(str(k)) for k in range(63)]).first()
    least = next((1 << k for k in range(63) if reach[k] <= FREQUENT), 1 << 62)
    own = costs.where(F.col("held") >= F.lit(least)).select("gram", "cost0", "cost1").toArrow().sort_by("gram")
    rest = costs.where(F.col("held") < F.lit(least)).select("gram", "cost0", "cost1") if least > 1 else None
    return tuple(own[c].to_numpy() for c in ("gram", "cost0", "cost1")), rest


def postings(texts: DataFrame, frequent: tuple[np.ndarray, ...]) -> DataFrame:
    """POSTINGS of rows (text, trusted, key1, key2): one per text with n, its keys and the cost of its ``frequent`` trigrams, and a row per
    other trigram of a block.

    ``docs`` holds the steps from text to text as 16-bit numbers, ``times`` how often as bytes; larger counts are several entries.
    """
    names = [c.split()[0] for c in POSTINGS.split(", ")]
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches):
        often, *costs = shared.value
        for block, fold, texts in _blocks(batches):
            many = len(texts)
            n, key1, key2 = zip(*[t[3:] for t in texts])
            gram, times = (np.concatenate([t[i] for t in texts]) for i in (0, 1))
            doc = np.repeat(np.arange(many), [len(t[0]) for t in texts])
            at = np.searchsorted(often, gram)
            known = at < len(often)
            known[known] = often[at[known]] == gram[known]
            cost = np.bincount(doc[known], weights=costs[fold][at[known]] * times[known], minlength=many).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(many, block)), pa.array(np.full(many, fold, np.int32)), pa.array(key1, pa.int64()), pa.nulls(many, pa.binary()),
                 pa.nulls(many, pa.binary()), pa.array(np.arange(many, dtype=np.int32)), pa.array(cost), pa.array(n, pa.int64()),
                 pa.array(key1, pa.int64()), pa.array(key2, pa.int64())], names=names)
            gram, times, doc = gram[~known], times[~known], doc[~known]
            if not len(gram):
                continue
            order = np.argsort(gram, kind="stable")
            gram, doc, times = gram[order], doc[order], times[order]
            parts = (times + 254) // 255
            last = np.cumsum(parts) - 1
            gram, doc = np.repeat(gram, parts), np.repeat(doc, parts)
            small = np.full(len(gram), 255, np.uint8)
            small[last] = times - 255 * (parts - 1)
            first = np.nonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))[0]
            steps = np.diff(doc, prepend=0)
            steps[first] = doc[first]
            for a in range(0, len(first), 10_000):
                own = first[a:a + 10_000]
                end = first[a + 10_000] if a + 10_000 < len(first) else len(gram)
                k = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(k, block)), pa.array(np.full(k, fold, np.int32)), pa.array(gram[own]),
                     _packed(steps[own[0]:end].astype(np.uint16), own - own[0]), _packed(small[own[0]:end], own - own[0]),
                     pa.nulls(k, pa.int32()), pa.nulls(k, pa.float64()), *(pa.nulls(k, pa.int64()) for _ in range(3))], names=names)

    return texts.select("text", "trusted", "key1", "key2").mapInArrow(run, POSTINGS)


def text_sums(joined: DataFrame) -> DataFrame:
    """SUMS of postings that have a cost: costs per (block, doc) of the rows a task sees, and the rows of the texts as they are."""
    names = [c.split()[0] for c in SUMS.split(", ")]

    def run(batches):
        sums: dict[int, np.ndarray] = {}

        def flush():
            for block, total in sums.items():
                doc = np.nonzero(total)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(doc), block)), pa.array(doc.astype(np.int32)), pa.array(total[doc]),
                     *(pa.nulls(len(doc), pa.int64()) for _ in range(3))], names=names)
            sums.clear()

        for batch in batches:
            whole = pa.Table.from_batches([batch])
            own = whole.filter(pa.compute.is_valid(whole["doc"]))
            yield from own.select(names).to_batches()
            rest = whole.filter(pa.compute.is_valid(whole["docs"])).combine_chunks()
            if not rest.num_rows:
                continue
            sizes = pa.compute.binary_length(rest["times"]).to_numpy().astype(np.int64)
            step = np.frombuffer(b"".join(rest["docs"].to_pylist()), np.uint16).astype(np.int64)
            times = np.frombuffer(b"".join(rest["times"].to_pylist()), np.uint8)
            upto = np.cumsum(step)
            starts = np.cumsum(sizes) - sizes
            doc = upto - np.repeat(upto[starts] - step[starts], sizes)
            cost = np.repeat(rest["cost"].to_numpy(), sizes) * times
            blocks, place = np.unique(rest["block"].to_numpy(), return_inverse=True)
            total = np.bincount(np.repeat(place, sizes) * BLOCK_TEXTS + doc, weights=cost, minlength=len(blocks) * BLOCK_TEXTS)
            for k, own in zip(blocks.tolist(), total.reshape(-1, BLOCK_TEXTS)):
                sums[k] = sums[k] + own if k in sums else own
            if len(sums) > OPEN_BLOCKS:
                yield from flush()
        yield from flush()

    return joined.select("block", "docs", "times", "cost", "doc", "n", "key1", "key2").mapInArrow(run, SUMS)


def _discounts(counts: DataFrame, n: str) -> dict[int, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more."""
    row = counts.agg(*[F.count_if(F.col(n) == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (max(x or 0, 1) for x in row)
    y = n1 / (n1 + 2 * n2)
    return {k: min(max(k - (k + 1) * y * b / a, 0.1), 0.95 * k) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))}


def _cut(n: Column, d: dict[int, float]) -> Column:
    return F.when(n == 1, d[1]).when(n == 2, d[2]).when(n >= 3, d[3]).otherwise(0.0)


def _level(counts: DataFrame, context: str, n: str, lower: list[Column]) -> DataFrame:
    """Adds p0 and p1 to rows that have counts n0, n1 (by the name ``n``): the probability in each model, with ``lower`` that of the shorter context."""
    d = [_discounts(counts, f"{n}{k}") for k in (0, 1)]
    totals = counts.groupBy(context).agg(*[F.sum(f"{n}{k}").alias(f"total{k}") for k in (0, 1)],
                                         *[F.sum(_cut(F.col(f"{n}{k}"), d[k])).alias(f"freed{k}") for k in (0, 1)])
    own = [F.when(F.col(f"total{k}") > 0, (F.col(f"{n}{k}") - _cut(F.col(f"{n}{k}"), d[k]) + F.col(f"freed{k}") * lower[k])
                  / F.col(f"total{k}")).otherwise(lower[k]) for k in (0, 1)]
    return counts.join(totals, context).select(*counts.columns, own[0].alias("p0"), own[1].alias("p1")).drop("lower0", "lower1")


def trigram_costs(counts: DataFrame) -> DataFrame:
    """gram, own0, own1, held, cost0 and cost1 of every trigram of ``counts``.

    ``cost0`` comes from the texts of fold 1 and judges those of fold 0, ``cost1`` the other way round.
    """
    sums = counts.agg(F.sum("own0").alias("own0"), F.sum("own1").alias("own1")).first()
    every = F.col("own0") + F.col("own1")
    three = saved(counts.select("*", (F.col("own1") if sums["own1"] else every).alias("n0"), (F.col("own0") if sums["own0"] else every).alias("n1"),
                                F.shiftright("gram", BITS).alias("ab"), F.col("gram").bitwiseAND(F.lit((1 << 2 * BITS) - 1)).alias("bc")), "trigrams")
    two = saved(three.groupBy("bc").agg(*[F.count_if(F.col(f"n{k}") > 0).alias(f"m{k}") for k in (0, 1)])
                .select("*", F.shiftright("bc", BITS).alias("b"), F.col("bc").bitwiseAND(F.lit(LAST)).alias("c")), "bigrams")
    one = saved(two.groupBy("c").agg(*[F.count_if(F.col(f"m{k}") > 0).alias(f"q{k}") for k in (0, 1)]), "characters")
    first = []
    for k in (0, 1):
        q = F.col(f"q{k}")
        d = _discounts(one, f"q{k}")
        total, freed, size = one.agg(F.sum(q), F.sum(_cut(q, d)), F.count_if(q > 0)).first()
        first.append(((q - _cut(q, d) + (freed or 1.0) / ((size or 0) + 1)) / (total or 1)).alias(f"lower{k}"))
    lower = [F.col("lower0"), F.col("lower1")]
    second = saved(_level(two.join(one.select("c", *first), "c"), "b", "m", lower), "second")
    third = _level(three.join(second.select("bc", F.col("p0").alias("lower0"), F.col("p1").alias("lower1")), "bc"), "ab", "n", lower)
    return saved(third.select("gram", "own0", "own1", "held", *[(-F.ln(f"p{k}")).alias(f"cost{k}") for k in (0, 1)]), "trigram-costs")


def text_costs(texts: DataFrame, costs: DataFrame) -> DataFrame:
    """cost, n, key1 and key2 of every row (text, trusted, key1, key2), by rows of :func:`trigram_costs`."""
    frequent, rest = frequent_costs(costs)
    own = postings(texts, frequent)
    if rest is None:
        return own.select("cost", "n", "key1", "key2")
    joined = own.join(saved(rest, "rare-costs"), "gram", "left").withColumn("cost", F.expr("coalesce(cost, if(fold = 0, cost0, cost1))"))
    return text_sums(joined).groupBy("block", "doc").agg(
        F.sum("cost").alias("cost"), F.max("n").alias("n"), F.max("key1").alias("key1"), F.max("key2").alias("key2")).drop("block", "doc")


def trusted_ids(labels: DataFrame) -> DataFrame:
    return (labels.where("doc_id is not null").groupBy("doc_id")
            .agg(F.max("quality").alias("hi"), F.min("quality").alias("lo"), F.max("toxic").alias("toxic"))
            .where("hi = 1 and lo = 1 and coalesce(toxic, 0) = 0").select("doc_id"))


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text; NULL as the empty text."""
    own = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(own), F.xxhash64(own, F.lit(1))


class Quality:
    """The fitted classifier: the perplexity of every text, and the threshold of each language."""

    def __init__(self, docs: DataFrame, labels: DataFrame, quantile: float = 0.995, slack: float = 1.1,
                 min_trusted: int = 50):
        ids = saved(trusted_ids(labels), "trusted-ids")
        few = ids.count() <= BROADCAST_ROWS
        marked = ids.select(F.col("doc_id").alias("_id"), F.lit(True).alias("trusted"))
        key1, key2 = text_keys(F.col("text"))
        rows = (docs.select("doc_id", "lang", F.col("text").cast("string").alias("text"), key1.alias("key1"), key2.alias("key2"))
                .join(F.broadcast(marked) if few else marked, F.col("doc_id") == F.col("_id"), "left"))
        costs = trigram_costs(saved(trigram_counts(rows), "trigram-counts"))
        mean = costs.agg(F.try_divide(F.sum(F.expr("own0 * cost0 + own1 * cost1")), F.sum(F.expr("own0 + own1")))).first()[0] or 0.0
        copies = F.count("*")
        self.perplexities = saved(text_costs(rows, costs).groupBy("key1", "key2").agg(
            F.when(F.sum("n") > 0, F.exp((F.sum("cost") / copies + PRIOR * mean) / (F.sum("n") / copies + PRIOR)))
            .alias("perplexity")), "text-perplexities")
        self.scored = saved(rows.select("doc_id", "lang", "key1", "key2", "trusted").join(self.perplexities, ["key1", "key2"], "left"),
                            "perplexities")
        judged = self.scored.where("perplexity is not null")
        known = judged.where("trusted")
        at = F.percentile_approx("perplexity", quantile, 10_000) * slack
        own = known.groupBy(F.col("lang").alias("_known")).agg(at.alias("own"), F.count("*").alias("n"))
        share = F.least(F.coalesce("n", F.lit(0)) / F.lit(float(max(min_trusted, 1))), F.lit(1.0))
        any_trusted = known.limit(1).count() > 0
        self.thresholds = saved(
            judged.groupBy(F.col("lang").alias("_lang")).agg(at.alias("every")).join(own, F.expr("_lang <=> _known"), "left")
            .select("_lang", (share * F.coalesce("own", "every") + (1 - share) * F.col("every")).alias("_q"))
            .where(F.lit(any_trusted)), "thresholds")

    def judge(self, scored: DataFrame) -> DataFrame:
        """Adds threshold and kept to rows that have lang and perplexity."""
        keeps = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
        return (scored.join(self.thresholds, F.expr("lang <=> _lang"), "left")
                .withColumn("threshold", F.col("_q")).withColumn("kept", keeps).drop("_lang", "_q"))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every row of ``docs``."""
    quality = Quality(docs, labels, **options)
    return quality.judge(quality.scored.select("doc_id", "lang", "perplexity"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps: those whose text and language are not among the rejected ones."""
    quality = Quality(docs, labels, **options)
    bad = quality.judge(quality.scored).where("not kept").select(
        F.col("key1").alias("_k1"), F.col("key2").alias("_k2"), F.col("lang").alias("_l")).distinct()
    row = free_name(docs.columns, "_row")
    key1, key2 = text_keys(F.col(f"{row}.text"))
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row)).join(
        bad, (key1 == F.col("_k1")) & (key2 == F.col("_k2")) & F.col(f"{row}.lang").eqNullSafe(F.col("_l")), "left_anti")
    return kept.select(*[F.col(f"{row}.`{c}`").alias(c) for c in docs.columns])
