import random
import re
import zlib
from collections import Counter

import pytest

from veloframe.llm import spelling

SCHEMA = "doc_id long, text string"


def brute_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    n = brute_words(rows)
    form, out = {}, []
    beside = {w: [v for v in n if near(w, v)] for w in n}
    for w in n:
        if beside[w]:
            best = min(beside[w], key=lambda v: (-n[v], v.encode()))
            if n[best] >= 5 * n[w]:
                form[w] = best
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(beside[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA + ", n long, word string, pos int")
    got = spelling.group_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_random_words(spark, seed):
    """Few letters, so that runs of equal letters and words one edit apart abound."""
    rng = random.Random(seed)
    letters = "abé" if seed else "abcdefghÿÀ"
    pool = []
    for _ in range(150):
        w = "".join(rng.choice(letters) for _ in range(rng.randint(4, 9)))
        pool.append(w)
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w = rng.choice([w[:k] + rng.choice(letters) + w[k:], w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k + 1:]])
            pool.append(w)
    rows = [(k, " ".join(rng.choices(pool, weights=[1 / (1 + j % 40) for j in range(len(pool))], k=60))) for k in range(120)]
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 2 and max(r[4] for r in want) > 2
    assert run(spark, rows) == want


def test_chains_ties_odd_rows_and_long_words(spark):
    long = "x" * 20 + "".join(chr(97 + k % 26) for k in range(40))
    edge = "abcdefghijklmnopqrstuvwxyzabcdef"  # 32 code points
    words = {"colour": 200, "colours": 30, "colourss": 5, "color": 9, "centre": 40, "center": 40, "cntere": 5, "wörtere": 25, "wörter": 5,
             "aaaaaa": 50, "aaaaaaa": 10, "aaaaaaaa": 5, "baaaaaa": 5, long: 60, long[:30] + long[31:]: 6, long + "q": 5, "y" + long: 5,
             "z" + long[1:]: 5, edge: 50, edge[:-1]: 5, edge + "g": 5, edge[1:]: 5, "q" + edge: 5, edge[:16] + "é" + edge[17:]: 5,
             "é" * 3000: 30, "é" * 2999: 5, "é" * 1500 + "e" + "é" * 1499: 5}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    rows = [(None, None), (1, None), (2, ""), (3, "--- 12 ÷×"), (3, text.replace("colour ", "Colour1")), (4, "ÀÉcolour x" * 3), (4, "ÀÉcolour x" * 3),
            (None, "ÀÉcolour " * 7)]
    rows += [(k, "slipped woords hereabouts") for k in range(1200)]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, [(1, None)]) == []
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_edit_and_keys():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(1, 6)))
        assert spelling.one_edit(a, b) == near(a, b)
        if near(a, b):
            assert set(spelling.deletion_keys(a)) & set(spelling.deletion_keys(b))
