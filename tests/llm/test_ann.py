import numpy as np

from veloframe.llm import ann


def brute(rows, asked, top=10):
    fine = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in fine:
        if asked(i):
            near = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in {(j, tuple(w)) for j, w in fine} if j != i and len(w) == len(v))
            out[i] = [(k + 1, j, d) for k, (d, j) in enumerate(near[:top])]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert [x[:2] for x in a[k]] == [x[:2] for x in b[k]]
        assert np.allclose([x[2] for x in a[k]], [x[2] for x in b[k]], rtol=1e-12, atol=0)


def test_small_tables_are_exact(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, None), (5, [None, 1.0]),
            (6, [float("inf"), 1.0]), (7, [3.0, 4.0]), (8, [3.0, 4.0]), (8, [3.0, 4.0]), (None, [1.0, 1.0]), (9, [-0.0, 2.0]), (10, [0.0, 2.0])]
    table = spark.createDataFrame([(i, v, 0.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    same(got(ann.search(table, "vec_id % 2 = 0")), brute(dict.fromkeys((i, None if v is None else tuple(v)) for i, v in rows), lambda i: i % 2 == 0))
    assert ann.search(table.limit(0), "vec_id % 2 = 0").count() == 0


def test_many_copies_of_one_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(300)] + [(300 + i, [float(i), 1.0, 2.0]) for i in range(20)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    same(got(ann.search(table, "vec_id % 100 = 0")), brute(rows, lambda i: i % 100 == 0))


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    found, want = got(ann.search(table, "vec_id % 100 = 0")), brute(rows, lambda i: i % 100 == 0)
    assert found.keys() == want.keys()
    hit = sum(len({x[1] for x in found[k]} & {x[1] for x in want[k]}) for k in want)
    assert hit / sum(map(len, want.values())) >= 0.9


def test_one_large_block_is_cut_by_planes(spark):
    """Vectors far from the origin lie on one side of most planes: near ones still share a block."""
    rng = np.random.default_rng(1)
    x = (100 + np.repeat(rng.standard_normal((300, 8)), 2, axis=0) + 1e-3 * rng.standard_normal((600, 8))).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    nodes = ann.nodes_of(table, 10)
    which = {r.node: r.ids[0] for r in nodes.collect()}
    found = {(which[r.u], which[r.v]) for r in ann.first_edges(nodes, 600, trees=6, leaf=20).collect()}
    assert np.mean([(i, i ^ 1) in found for i in range(600)]) > 0.97


def test_graph_and_search_go_on_until_they_settle(spark):
    """20,000 vectors without structure: two rounds leave the graph short of the true neighbours."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((20_000, 24)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    nodes = ann.nodes_of(table, 10)
    which = {r.node: r.ids[0] for r in nodes.collect()}
    rows = ann.neighbour_graph(nodes).where("u % 97 = 0").collect()
    near = {}
    for r in rows:
        near.setdefault(which[r.u], set()).add(which[r.v])
    hit = []
    for i, own in near.items():
        d = ((x.astype(np.float64) - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hit.append(len(own & set(np.argpartition(d, ann.K)[:ann.K].tolist())) / ann.K)
    assert np.mean(hit) > 0.93
