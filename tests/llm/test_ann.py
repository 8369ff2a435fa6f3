import numpy as np
from pyspark.sql import functions as F

from shelfspark.llm import ann
from shelfspark.llm.queries import op13_nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>, label int, v int, cell string, h string, part string, score string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "c", "h", "p", "s")
                                  for i, v in rows], SCHEMA)


def brute(rows, step, k):
    """query -> [(score, id)] of all products."""
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    unit = [(i, v / abs(v).max() / np.linalg.norm(v / abs(v).max())) for i, v in usable]
    out = {}
    for q, x in unit:
        if q % step == 0:
            best = out.setdefault(q, {})
            for i, y in unit:
                if i != q and len(x) == len(y):
                    best[i] = max(best.get(i, -2.0), float(x @ y))
    return {q: sorted(((-round(s, 9), i) for i, s in b.items()))[:k] for q, b in out.items() if b}


def answers(out):
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((-round(r["score"], 9), r["vec_id"]))
        assert r["rank"] == len(found[r["query_id"]])
    return found


def recall(found, want):
    """Part of the true neighbours that were found, by score (ties count alike)."""
    hit = total = 0
    for q, w in want.items():
        total += len(w)
        got = found.get(q, [])
        assert len(got) == len(w) and got == sorted(got)
        hit += sum(s <= w[-1][0] for s, _ in got)
    return hit / total


def test_small_tables_are_searched_whole(spark):
    rows = [(0, [1, 0, 0]), (1, [2, 0, 0]), (2, [0, 1, 0]), (3, [1, 1, 0]), (4, [1, 1e-3, 0]), (5, [-1, 0, 0]), (6, [0, 0, 5]),
            (7, None), (8, []), (9, [0, 0, 0]), (10, [1, None, 2]), (12, [1, float("nan"), 2]), (14, [float("inf"), 1, 1]), (None, [1, 0, 0]),
            (16, [1e200, 0, 0]), (18, [1e-320, 0, 0]), (20, [1, 2]), (21, [2, 4]), (22, [5.0]),
            (0, [1, 0, 0]), (4, [0, 1, 1e-3]), (1, [0, 2, 0])]  # a repeated row, and ids with two vectors
    assert answers(ann.nearest(_frame(spark, rows), F.col("vec_id") % 2 == 0)) == brute(rows, 2, 5)
    assert ann.nearest(_frame(spark, []), F.col("vec_id") % 2 == 0).collect() == []
    assert ann.nearest(_frame(spark, [(0, [1, 2])]), F.col("vec_id") % 2 == 0).collect() == []
    assert ann.nearest(_frame(spark, [(1, [1, 2]), (3, [1, 2])]), F.col("vec_id") % 2 == 0).collect() == []  # no query


def test_copies_and_cells_in_parts(spark):
    """A third of all rows are one vector, another tenth lies close together in one cell."""
    random = np.random.default_rng(1)
    far = random.standard_normal((1200, 8))
    near = np.array([1.0] * 8) + 1e-2 * random.standard_normal((200, 8))
    rows = list(enumerate([*far.tolist(), *[far[3].tolist()] * 700, *near.tolist()]))
    random.shuffle(rows)
    rows = [(int(i), v) for i, (_, v) in enumerate(rows)]
    found = answers(ann.nearest(_frame(spark, rows).repartition(6), F.col("vec_id") % 20 == 0, shelf_rows=32, queries_per_group=8))
    want = brute(rows, 20, 5)
    assert recall(found, want) >= 0.9
    copies = {i for i, v in rows if v == far[3].tolist()}
    for q in copies & set(found):  # the five copies of smallest id
        assert [i for _, i in found[q]] == sorted(copies - {q})[:5]


def test_recall_on_clustered_vectors_with_few_visits(spark):
    random = np.random.default_rng(2)
    centres = random.standard_normal((60, 16))
    rows = [(i, (centres[i % 60] + 0.15 * random.standard_normal(16)).tolist()) for i in range(6000)]
    frame = _frame(spark, rows)
    found = answers(ann.nearest(frame, F.col("vec_id") % 50 == 0))
    assert recall(found, brute(rows, 50, 5)) >= 0.9
    usable, entries = ann._entries(frame, 5, "vec_id", "embedding")
    asked = usable.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    _, model = ann.build(entries, asked, 6000, 16, 5, 0.96)
    assert model.reach < 3000  # the walk ends long before all rows are met
    assert int(model.sizes.sum()) == 6000  # every row is in a cell


def test_walk_takes_cells_by_summed_distance():
    random = np.random.default_rng(4)
    for a, b in ((1, 1), (1, 6), (7, 5)):
        x, y = random.random(a), random.random(b)
        sizes = random.integers(0, 2, a * b)
        model = ann.MultiIndex(np.zeros((a, 1)), np.zeros((b, 1)), sizes)
        sums = (x[:, None] + y[None]).reshape(-1)
        assert list(model.walk(x, y)) == [c for c in np.argsort(sums) if sizes[c]]


def test_query_op13(spark):
    sf = "/root/testdata/sf0.01"
    out = op13_nearest_neighbours(spark, sf)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert recall(answers(out), brute(rows, 50, 5)) >= 0.9
