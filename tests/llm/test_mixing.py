import duckdb
import numpy as np

from veloframe.llm import mixing


def brute_rake(table, targets, rounds):
    w = table.astype(float)
    for _ in range(rounds):
        for axis, goal in enumerate(targets):
            other = tuple(k for k in range(3) if k != axis)
            shape = [1, 1, 1]
            shape[axis] = -1
            w = w * (goal * table.sum() / w.sum(axis=other)).reshape(shape)
    return w


def test_raking_agrees_with_arrays_and_meets_targets(spark):
    rng = np.random.default_rng(4)
    table = rng.integers(1, 500, (4, 3, 2))
    goals = [rng.dirichlet(np.ones(n) * 5) for n in table.shape]
    rows = [(f"s{i}" if i else None, f"l{j}", f"t{k}", int(table[i, j, k])) for i, j, k in np.ndindex(table.shape)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    names = [[None, "s1", "s2", "s3"], ["l0", "l1", "l2"], ["t0", "t1"]]
    targets = {d: spark.createDataFrame(list(zip(n, g.tolist())), f"{d} string, share double")
               for d, n, g in zip(mixing.DIMS, names, goals)}
    got = mixing.rake(cells, targets=targets, rounds=12).toPandas()
    want = brute_rake(table, goals, 12)
    for r in got.itertuples():
        i, j, k = names[0].index(r.source), names[1].index(r.lang), names[2].index(r.topic)
        assert np.isclose(r.weight, want[i, j, k])
    for d, g, n in zip(mixing.DIMS, goals, names):
        shares = got.groupby(d, dropna=False).weight.sum() / got.weight.sum()
        assert np.allclose([shares[shares.index.isna()].iloc[0] if v is None else shares[v] for v in n], g, atol=1e-3)


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    want = {r[0]: r for r in con.execute(f"SELECT doc_id, source, lang, topic, tokens, p, sampled FROM ({mixing.oracle()})").fetchall()}
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = mixing.mix(docs).select("doc_id", "source", "lang", "topic", "tokens", "p", "sampled").collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.doc_id]
        assert tuple(r)[:5] == w[:5] and r.sampled == w[6] and abs(r.p - w[5]) < 1e-6
    chosen = {r.doc_id for r in got if r.sampled}
    assert {r.doc_id for r in mixing.sample(docs).collect()} == chosen
    assert mixing.sample(docs).columns == docs.columns


def test_edges(spark):
    docs = spark.createDataFrame(
        [(1, None, "a", "en", 0.5), (2, "", None, None, 0.1), (3, "one two three", "a", None, 0.1), (3, "one two three", "a", None, 0.1),
         (None, "word " * 2000, None, "en", 0.2), (5, "x | y | z", "b", "de", 0.3)],
        "doc_id long, text string, source string, lang string, p double")
    got = mixing.mix(docs).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    assert by[1].topic == by[2].topic == "empty" and by[1].p == 1.0 and by[1].sampled
    assert by[None].topic == "long" and by[5].topic == "table"
    assert max(r.p for r in got) == 1.0 and min(r.p for r in got) > 0
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0
    assert mixing.sample(docs).columns == docs.columns
