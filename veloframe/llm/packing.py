"""Packing documents into sequences by a grouping genetic algorithm on islands.

Each text is tokenised, ended by token ``END`` and, only if longer than a sequence, cut
into full pieces.  Full pieces are sequences of their own.  The rest is dealt by a hash
into shards of about ``SHARD`` pieces; a shard is evolved by several islands, each a group
of its own.  An individual is a list of bins.  Crossover injects a random choice of whole
well-filled bins of one parent into the other, drops the bins there that hold one of the
injected pieces and puts the displaced pieces back by best fit, largest first; mutation
empties the worst bins.  Between epochs the best individual of each island moves to the
next island of its shard, through a shuffle.  The best individual of a shard wins; pieces
of its poorly filled bins meet those of other shards in one more pass.

All sizes are hashed into groups of a bounded number of rows, so neither a source nor a
length that a third of all documents share makes a large group.

Null texts are empty: one piece of one token.  Every input row is packed, repeated rows and
NULL doc_ids too.  Ties are broken by piece number; a run on the same rows gives the same
result.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, saved, text_bytes

LENGTH = 2048
END = 0
SHARD = 4096
ISLANDS = 2
EPOCHS = 2
CHILDREN = 24
GOOD = 0.97
CACHE = 200_000

PLAIN = re.compile(rb"[a-z]+[.,]?\Z")


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level BPE writes bytes: printable ones stand for themselves,
    the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def tokenizer(path: str) -> Callable[[bytes | None], bytes]:
    """Text to its ids as little-endian 32-bit numbers, without special tokens.

    White space never joins two words in this tokenizer, so a text's ids are those of its
    words in order, and words are kept in a two-generation cache of a bounded size.
    """
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    encode, pieces = tok.encode, tok.model.tokenize
    new: dict[bytes, bytes] = {}
    old: dict[bytes, bytes] = {}

    def pack(ids: Sequence[int]) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in ids])

    ends = {mark: pack(encode(mark.decode(), add_special_tokens=False).ids) for mark in (b".", b",")}

    def word(w: bytes) -> bytes:
        nonlocal new, old
        got = old.get(w)
        if got is None:
            if PLAIN.match(w):  # one run of letters, with or without one mark behind it
                got = (pack([t.id for t in pieces(w[:-1].decode())]) + ends[w[-1:]] if w[-1:] in ends
                       else pack([t.id for t in pieces(w.decode())]))
            else:
                got = pack(encode(w.decode(), add_special_tokens=False).ids)
        if len(new) >= CACHE:
            old, new = new, {}
        new[w] = got
        return got

    def ids(text: bytes | None) -> bytes:
        text = text or b""
        if b"<|" not in text:  # names of special tokens are told by case
            text = text.lower()
        get = new.get
        return b"".join([get(w) or word(w) for w in text.split()])

    return ids


def tokenize(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and item (a number of its own) of each piece."""
    def make():
        ids_of = tokenizer(path)
        end = END.to_bytes(4, "little")

        def cut(doc_id, text) -> Iterator[tuple]:
            ids = ids_of(text) + end
            for piece, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at:at + 4 * length]
                yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)

        return cut

    made = map_rows(docs.select("doc_id", text_bytes().alias("text")), make,
                    "doc_id long, piece int, start long, length long, ids_crc32 long")
    return saved(made.withColumn("item", F.monotonically_increasing_id()), "pieces")


class Bins:
    """Open bins by free space; best fit finds the fullest bin that has room in one step."""

    def __init__(self, sizes: Sequence[int], length: int):
        self.sizes, self.length = sizes, length
        self.bins: list[list[int]] = []
        self.free: list[int] = []
        self.by_free: list[list[int]] = [[] for _ in range(length + 1)]
        self.mask = 0

    def add(self, bin_: list[int], free: int) -> None:
        self.bins.append(bin_)
        self.free.append(free)
        self._open(len(self.bins) - 1, free)

    def _open(self, b: int, free: int) -> None:
        self.by_free[free].append(b)
        self.mask |= 1 << free

    def place(self, item: int) -> None:
        size = self.sizes[item]
        room = self.mask >> size
        if not room:
            self.add([item], self.length - size)
            return
        free = size + (room & -room).bit_length() - 1
        own = self.by_free[free]
        b = own.pop()
        if not own:
            self.mask &= ~(1 << free)
        self.bins[b].append(item)
        self.free[b] = free - size
        self._open(b, free - size)

    def solution(self) -> list[tuple[int, list[int]]]:
        return [(self.length - f, b) for f, b in zip(self.free, self.bins)]


def fitness(solution: list[tuple[int, list[int]]], length: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones: lower is better."""
    return len(solution), -sum((fill / length) ** 2 for fill, _ in solution)


def best_fit(items: Sequence[int], sizes: Sequence[int], length: int,
             start: Sequence[tuple[int, list[int]]] = ()) -> list[tuple[int, list[int]]]:
    bins = Bins(sizes, length)
    for fill, own in start:
        bins.add(list(own), length - fill)
    for i in items:
        bins.place(i)
    return bins.solution()


def cross(rng: random.Random, taker: list, giver: list, sizes: Sequence[int], length: int) -> list:
    good = [b for b in giver if b[0] >= GOOD * length]
    injected = rng.sample(good, rng.randint(1, max(1, len(good) // 2))) if good else []
    taken = {i for _, own in injected for i in own}
    stay, displaced = list(injected), []
    worst = sorted(range(len(taker)), key=lambda k: taker[k][0])[:max(1, len(taker) // 50)]
    emptied = set(worst)
    for k, (fill, own) in enumerate(taker):
        if k in emptied or any(i in taken for i in own):
            displaced += [i for i in own if i not in taken]
        else:
            stay.append((fill, own))
    displaced.sort(key=lambda i: -sizes[i])
    return best_fit(displaced, sizes, length, stay)


def evolve(sizes: Sequence[int], seeds: list[list[tuple[int, list[int]]]], length: int, seed: int,
           children: int = CHILDREN) -> list[tuple[int, list[int]]]:
    """The best of a population that starts from the seeds and from best fit in noisy order."""
    rng = random.Random(seed)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    population = seeds + [best_fit(order, sizes, length)]
    while len(population) < 4:
        noisy = sorted(order, key=lambda i: -sizes[i] * rng.uniform(0.8, 1.0))
        population.append(best_fit(noisy, sizes, length))
    floor = max(-(-sum(sizes) // length), sum(2 * s > length for s in sizes))
    population.sort(key=lambda s: fitness(s, length))
    for _ in range(children):
        if len(population[0]) <= floor:
            break
        a, b = rng.sample(population, 2)
        population.append(cross(rng, a, b, sizes, length))
        population.sort(key=lambda s: fitness(s, length))
        population.pop()
    return population[0]


def _epoch(state: DataFrame, length: int, epoch: int) -> DataFrame:
    """One epoch of each (shard, island): item, size, own and guest (bins of the two elites)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item")
        sizes = pdf["size"].tolist()
        seeds = []
        for column in ("own", "guest"):
            if pdf[column].notna().all():
                bins: dict[int, list[int]] = {}
                for i, b in enumerate(pdf[column].tolist()):
                    bins.setdefault(int(b), []).append(i)
                seeds.append([(sum(sizes[i] for i in own), own) for own in bins.values()])
        shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        best = evolve(sizes, seeds, length, seed=(shard * 31 + island) * 31 + epoch)
        made = [0] * len(sizes)
        for b, (_, own) in enumerate(best):
            for i in own:
                made[i] = b
        n, score = fitness(best, length)
        return pd.DataFrame({"shard": shard, "island": island, "item": pdf["item"], "size": sizes, "bin": made,
                             "n_bins": n, "score": score})

    return state.groupBy("shard", "island").applyInPandas(
        run, "shard long, island int, item long, size int, bin long, n_bins long, score double")


def pack(items: DataFrame, length: int = LENGTH, shard: int = SHARD, islands: int = ISLANDS,
         epochs: int = EPOCHS) -> DataFrame:
    """item -> shard, bin, size, for items (item, size) that are shorter than a sequence."""
    n_shards = max(1, -(-items.count() // shard))
    nothing = F.lit(None).cast("long")
    state = (items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(n_shards)))
             .withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
             .select("shard", "island", "item", "size", nothing.alias("own"), nothing.alias("guest")))
    for epoch in range(epochs):
        best = saved(_epoch(state, length, epoch), "islands")
        guests = best.select("shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), "item",
                             F.col("bin").alias("guest"))
        state = best.select("shard", "island", "item", "size", F.col("bin").alias("own")).join(
            guests, ["shard", "island", "item"])
    won = best.groupBy("shard").agg(F.min(F.struct("n_bins", "score", "island")).alias("w")).select(
        "shard", F.col("w.island").alias("island"))
    return best.join(won, ["shard", "island"]).select("shard", "bin", "item", "size")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    pieces = tokenize(docs, path, length)
    short = pieces.where(F.col("length") < length).select("item", F.col("length").cast("int").alias("size"))
    first = saved(pack(short, length, **options), "packed")
    poor = (first.groupBy("shard", "bin").agg(F.sum("size").alias("fill"))
            .where(F.col("fill") < GOOD * length).select("shard", "bin"))
    poor = saved(poor, "poor-bins")
    again = saved(pack(first.join(poor, ["shard", "bin"]).select((F.xxhash64("item", F.lit(1))).alias("k"), "item", "size")
                       .select("item", "size"), length, **options), "packed-again")
    number = F.col("shard") * (1 << 32) + F.col("bin") * 2
    placed = (first.join(poor, ["shard", "bin"], "left_anti").select("item", "size", number.alias("sequence_id"))
              .union(again.select("item", "size", (number + 1).alias("sequence_id"))))
    in_order = (placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("item", "size"))).alias("own"))
                .select("sequence_id", F.posexplode("own").alias("at", "x"), "own")
                .select("sequence_id", "x.item", F.expr("aggregate(slice(own, 1, at), 0L, (n, y) -> n + y.size)")
                        .alias("offset")))
    return (pieces.join(saved(in_order, "placed"), "item", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.coalesce("sequence_id", -1 - F.col("item")).alias("sequence_id"),
        F.coalesce("offset", F.lit(0).cast("long")).alias("offset")))
