import hashlib
import zlib

import pytest

from veloframe.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests, k):
    """(root, siblings before and after node ``k`` by level)"""
    path = []
    while len(digests) > 1:
        a = k - k % 16
        path.append((digests[a:k], digests[k + 1:a + 16]))
        digests, k = [sha("".join(digests[i:i + 16])) for i in range(0, len(digests), 16)], k // 16
    return digests[0], path


def brute(rows):
    """Tuples (doc_id, text, lang, source, n_chars) to sorted rows of the result."""
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda x: x[:3])
    subroots = [climb([x[2] for x in by[s]], 0)[0] for s in names]
    out = []
    for i, s in enumerate(names):
        for k, (_, _, own, r) in enumerate(by[s]):
            path = climb([x[2] for x in by[s]], k)[1] + climb(subroots, i)[1]
            root = climb(subroots, 0)[0]
            h = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1])
                h = leaf(r[0], text, *r[2:])
            for a, b in path:
                h = sha("".join(a) + h + "".join(b))
            out.append((r[0], own, subroots[i], root, sha("".join("".join(a + b) for a, b in path)), h, h == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, rows):
    return sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).select(*COLUMNS).collect()), key=repr)


def text(k):
    return None if k % 17 == 0 else "" if k % 13 == 0 else f"Été Text {k} É" * (k % 5)


@pytest.mark.parametrize("sizes", [[1], [1, 1], [16], [17, 1], [256, 257, 2], [4096], [4097, 1, 30]])
def test_trees_of_all_shapes(spark, sizes):
    rows = [(1000 * j + 3 * i, text(i), "en", f"s{j}", i) for j, n in enumerate(sizes) for i in range(n)]
    assert run(spark, rows) == brute(rows)


def test_many_sources(spark):
    rows = [(i, f"T{i}", None, f"s{i % 300}", None) for i in range(700)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, "A", None, None, None), (None, None, "de", None, 1), (5, "B" * 50_000, "é", "Z", -7), (5, "B" * 50_000, "é", "Z", -7),
            (5, "other", "é", "Z", 0), (-3, "", "", "", 0), (4, "x:1", "-", "é", 2), (7, "-", None, "z", 2)] + [(9, "Same", "en", "hot", 4)] * 600
    docs = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA + ", leaf string, tree int, block int")
    got = sorted((tuple(r) for r in merkle.manifest(docs).select(*COLUMNS).collect()), key=repr)
    assert got == brute(rows)
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_tampered_rows_fail_and_others_do_not(spark):
    rows = [(i, "Some Text", "en", f"s{i % 3}", 9) for i in range(200)]
    got = run(spark, rows)
    assert {r[0] for r in got if not r[-1]} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_more_than_one_round_of_superblocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, f"T{i}", "en", "a" if i % 9 else f"b{i}", i) for i in range(700)]
    assert run(spark, rows) == brute(rows)
