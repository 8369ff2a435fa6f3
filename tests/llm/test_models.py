"""Language id, toxicity and quality: held-out accuracy and awkward rows."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from helpers import awkward, empty
from shelfspark.llm import langid, quality, toxicity

WORDS = {"xx": ["katu", "mora", "silva", "onto", "bere"], "yy": ["grzeb", "wrsch", "plotz", "krumt", "zwerk"]}


def _text(rng, lang, n=60):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))


def _docs(spark, n=120):
    rng = random.Random(1)
    rows = [(i, _text(rng, lang), lang, "s", 1) for i in range(n) for lang in ["xx" if i % 2 else "yy"]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_suffix_automaton_reads_exactly_the_substrings():
    word = [1, 2, 1, 1, 2, 3, 1]
    step = langid.suffix_automaton(word)

    def reads(s):
        state = 0
        for c in s:
            if c not in step[state]:
                return False
            state = step[state][c]
        return True

    inside = {tuple(word[i:j]) for i in range(len(word)) for j in range(i, len(word) + 1)}
    import itertools
    for n in range(5):
        for s in itertools.product([1, 2, 3], repeat=n):
            assert reads(s) == (s in inside)


def test_phrases_match_a_greedy_parse():
    model = langid.build({"a": "abracadabra abraca", "b": "zyzzyva zzyx"})
    text = "abrazyx qabra zzz"
    symbols = model.symbol[langid._codes(text)]
    learnt = {k: langid._squeezed(model.symbol[langid._codes(t)]).tolist() for k, t in (("a", "abracadabra abraca"), ("b", "zyzzyva zzyx"))}
    counts = langid.phrases(model, [symbols])[0]
    for k, lang in enumerate(model.languages):
        ref, n, at = learnt[lang], 0, 0
        s = symbols.tolist()
        while at < len(s):
            end = at + 1
            while end <= len(s) and any(ref[i:i + end - at] == s[at:end] for i in range(len(ref))):
                end += 1
            at, n = max(end - 1, at + 1), n + 1
        assert counts[k] == n


def test_language_of_held_out_texts(spark):
    docs = _docs(spark)
    model = langid.learn(docs, F.col("doc_id") % 4 != 2)
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("doc_id % 4 = 2").collect()
    assert rows and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    model = langid.learn(_docs(spark), F.lit(True))
    docs = awkward(spark, ["katumora silvaonto", "12 34 !!", "x" * 10_000])
    rows = langid.identify(docs, model).collect()
    assert len(rows) == docs.count()
    und = [r for r in rows if r.lang_pred == "und"]
    assert len(und) == 4 and all(r.score == 0 for r in und)
    assert langid.identify(empty(spark), model).count() == 0
    none = langid.learn(empty(spark), F.lit(True))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}


def _toxic(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(200):
        words = _text(rng, "xx", 40).split()
        bad = i % 4 == 0
        if bad:
            for k in rng.sample(range(40), rng.choice([2, 3, 8, 12])):
                words[k] = rng.choice(["vileword", "nasty" + rng.choice("abcdefg")])
        rows.append((i, " ".join(words), "xx", "s", 1))
        labels.append((i, 1, int(bad)))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_toxic_documents_go_and_clean_ones_stay(spark):
    docs, labels = _toxic(spark)
    train = labels.where("doc_id % 3 != 0")
    model = toxicity.learn(docs, train)
    assert len(model.thresholds) == 2 and model.thresholds[0] <= model.thresholds[1]
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(rows[i], i % 4 == 0) for i in range(200) if i % 3 == 0]
    assert sum(r.toxic == bad for r, bad in held) / len(held) > 0.97
    assert all(0 <= r.severity <= 2 and r.severity >= r.p_toxic - 1e-9 for r in rows.values())
    kept = toxicity.clean_documents(docs, train)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.toxic}


def test_ordinal_gradient_lowers_the_loss_and_orders_thresholds():
    rng = np.random.default_rng(0)
    x = rng.random((300, 2))
    grade = np.digitize(x @ np.array([2.0, 0.0]), [0.7, 1.4])
    row, col = np.repeat(np.arange(300), 2), np.tile([0, 1], 300)
    w, t = toxicity.fit_ordinal(row, col, x.ravel(), grade, 2)
    assert t[0] < t[1] and w[0] > 5 * abs(w[1])


def test_toxicity_of_awkward_rows(spark):
    docs, labels = _toxic(spark)
    model = toxicity.learn(docs, labels)
    odd = awkward(spark, ["vileword vileword nastya", "katumora"])
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and sum(r.toxic for r in rows) == 3  # the toxic text, its copy, and the row with a null id
    assert toxicity.clean_documents(odd, labels).columns == odd.columns
    nobody = toxicity.learn(docs, labels.where("toxic = 0"))
    assert not any(r.toxic or r.severity for r in toxicity.score(odd, nobody).collect())
    assert toxicity.score(empty(spark), model).count() == 0


def test_quality_held_out(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 != 0
        text = _text(rng, "xx", 50)
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels, F.col("doc_id") % 5 != 1)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all((got[i].predicted == 1) == (i % 3 != 0) for i in range(300) if i % 5 == 1)
    odd = awkward(spark, ["katumora", "A" * 5000])
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    one_class = quality.learn(docs, labels.where("quality = 1"), F.lit(True))
    assert all(r.score > 0.9 for r in quality.score(odd, one_class).collect())
    assert quality.score(empty(spark), quality.learn(empty(spark), labels, F.lit(True))).count() == 0


def test_shallow_tree_finds_the_step():
    g, h = np.array([1.0, 1, 1, -1, -1]) * 100, np.ones(5) * 100
    values = quality.shallow_tree(g, h, 2)
    assert (values[:3] < 0).all() and (values[3:] > 0).all() and len(set(np.round(values, 9))) == 2


def test_a_batch_is_scored_in_runs_of_bounded_size():
    texts = [None, "", *["word " * n for n in (10, 300_000, 90_000, 90_000, 90_000, 5)], None]
    batch = pa.RecordBatch.from_pydict({"k0": pa.array(range(len(texts))), "text": pa.array(texts)})
    parts = list(toxicity._pieces(iter([batch, batch.slice(0, 0)]), 1))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    sizes = [[len(t or "") for t in p.column(1).to_pylist()] for p in parts]
    assert len(parts) == 3 and all(sum(s) - max(s) <= toxicity.BATCH_BYTES for s in sizes)


def test_a_kept_text_is_sent_to_the_model_once(spark):
    docs = spark.createDataFrame([(1, "x" * 50, "en"), (2, None, None)], "doc_id long, text string, lang string")
    out = toxicity.score(docs, toxicity.Model(), keep=docs.columns)
    assert out.columns == [*docs.columns, "severity", "p_toxic", "toxic"] and out.drop("severity", "p_toxic", "toxic").exceptAll(docs).isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    sent = next(x for x in plan.splitlines() if "Project" in x)
    assert sent.count("AS ") == len(docs.columns)
