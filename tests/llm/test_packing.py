import random
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veloframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_tokenizer(tok):
    ids_of = packing.tokenizer(PATH)
    texts = ["", " ", "Hello, world.", "Don't stop the word's end. I'll go", "É été ÉTÉ Ünder straße ẞ", "a<|endoftext|>b <|ENDOFTEXT|>",
             "x\x1cy\x85z w v \x0b\x0c\t\n", "İstanbul ΣΑΣ ǅ ﬁ", "é ́x", "12 345 ... ,, .a ,b a., b,. c.d", "中文 字。 😀!",
             "abc.def, abc. abc, a.b", "​﻿ x", "'s 't ''s it''s", "word " * 500]
    rng = random.Random(1)
    pool = "aAbzéÉ ßœ.,'!|<>\n\t 0129İΣ́ 中"
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids_of(t.encode()) == struct.pack(f"<{len(want)}I", *want), t


def check_layout(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    return len(by)


def test_round_trip_over_given_documents(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack_documents(docs, PATH).collect()
    n = check_layout(rows, 2048)
    total = sum(r.length for r in rows)
    assert n <= -(-total // 2048) + 3
    for d in docs.collect():
        ids = tok.encode(d.text, add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.doc_id == d.doc_id), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            part = ids[r.start:r.start + r.length]
            assert r.start == 2048 * r.piece and len(part) == r.length
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))


def test_many_shards_lose_nothing(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i if i % 7 else None, "word " * rng.randint(0, 90), "s") for i in range(300)] +
                                 [(1, None, "s"), (2, "", "s")], "doc_id long, text string, sequence_id string")
    rows = packing.pack_documents(docs, PATH, length=64, shard=40).collect()
    n = check_layout(rows, 64)
    total = sum(r.length for r in rows)
    assert total == sum(len((d.text or "").split()) + 1 for d in docs.collect())
    assert n <= 1.06 * total / 64 + 2
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0


def test_crossover_keeps_every_item_once():
    rng = random.Random(3)
    sizes = [rng.randint(1, 100) for _ in range(300)]
    order = list(range(300))
    population = []
    for _ in range(2):
        rng.shuffle(order)
        population.append(packing.best_fit(order, sizes, 100))
    for _ in range(20):
        child = packing.cross(rng, *population, sizes, 100)
        assert sorted(i for _, own in child for i in own) == list(range(300))
        assert all(fill == sum(sizes[i] for i in own) <= 100 for fill, own in child)
        population = [child, population[0]]
    best = packing.evolve(sizes, [], 100, seed=1)
    plain = packing.best_fit(sorted(order, key=lambda i: -sizes[i]), sizes, 100)
    assert sorted(i for _, own in best for i in own) == list(range(300)) and len(best) <= len(plain)
