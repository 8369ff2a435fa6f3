import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from helpers import awkward, empty
from shelfspark.llm import resample
from shelfspark.llm.queries import op12_importance_resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, run):
    words = WORDS.findall((text or "").translate(LOWER))
    return words, [crc32(" ".join(words[i:i + n]).encode()) for n in range(1, run + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, run=1, buckets=10_000, percent=10, least=20):
    found = [(i, *features(t, run)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s.update(c % buckets for c in f)
    for text in target:
        t.update(c % buckets for c in features(text, run)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    out, drawable = [], []
    for i, words, f in found:
        weight = sum(math.floor(1000 * math.log((t[c % buckets] + 1) * (n_s + buckets) / ((s[c % buckets] + 1) * (n_t + buckets)))) for c in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if len(words) >= least:
                drawable.append((-score, i))
        out.append((i, len(f), weight, score))
    drawn = sorted(drawable)[:percent * len(drawable) // 100]
    return out, [i for _, i in drawn]


def compare(got, docs, target, **options):
    want, drawn = brute(docs, target, **options)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got), key=key) == sorted(want, key=key)
    ranked = sorted((r["rank"], r["doc_id"]) for r in got if r["rank"] is not None)
    assert ranked == list(enumerate(drawn, 1))


def _target(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "item_id long, text string, word string, n int")


TEXTS = (["The quick brown fox " * 8, "a b c " * 9, "Größe ÄÖ straße no10 x_y-z " * 7, "über; uber? UBER! " * 8, "İI Ω ω " * 10]
         + [f"common words w{i} w{i % 3} go here and {'again ' * (i % 5)}" * 5 for i in range(60)])
GOAL = ["the quick words go", "w1 w2 again", None, "", "größe"]


def test_awkward_rows_and_runs(spark):
    rows = awkward(spark, [*TEXTS, "long word " * 60_000, "x" * 300_000])
    docs = [(r["doc_id"], r["text"]) for r in rows.collect()]
    for run in (1, 2, 3):
        compare(resample.resample(rows, _target(spark, GOAL), run=run).collect(), docs, GOAL, run=run)


def test_head_changes_no_result(spark):
    rows, goal = awkward(spark, TEXTS).repartition(3), _target(spark, GOAL)
    docs = [(r["doc_id"], r["text"]) for r in rows.collect()]
    for head in (1, 5, 1000):  # mostly tail, and mostly head
        compare(resample.resample(rows, goal, 50, run=2, buckets=97, head=head).collect(), docs, GOAL, run=2, buckets=97, percent=50)


def test_empty_tables(spark):
    goal = _target(spark, GOAL)
    assert resample.resample(empty(spark), goal).collect() == []
    rows = awkward(spark, TEXTS)
    docs = [(r["doc_id"], r["text"]) for r in rows.collect()]
    compare(resample.resample(rows, goal.limit(0), 100).collect(), docs, [], percent=100)


def test_thinning_keeps_frequent_words():
    counts = Counter({b"a": 50, b"b": 20, **{b"%d" % i: 1 for i in range(100)}})
    assert resample._thin(counts, 10) == Counter({b"a": 49, b"b": 19})
    assert resample._thin(counts, 1000) is counts


def test_head_holds_the_most_frequent_words(spark):
    texts = spark.createDataFrame([("x y " * 50 + f"r{i} s{i}",) for i in range(50)] + [(None,)], "text string").repartition(4)
    head = resample._frequent(texts, 2, 2, 97)
    assert head.states == {w: crc32(w) for w in (b"x", b"y")}
    assert head.pairs == {p: crc32(b" ".join(p)) % 97 for p in ((b"x", b"y"), (b"y", b"x"))}


def test_query_op12(spark):
    sf = "/root/testdata/sf0.001"
    out = op12_importance_resampling(spark, sf)
    assert out.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    compare(out.collect(), docs, [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
