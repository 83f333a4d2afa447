import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from ontomill.llm import registry
from ontomill.llm import toxicity as T
from ontomill.llm.columns import crc32_hex_mod4
from tests.llm.awkward import ROWS, awkward, empty

SF = "/root/testdata/sf0.1"


def test_fold():
    assert T.fold("ІDIОТ") == "idiot"
    assert T.fold("1d10t m0r0n") == "idiot moron"
    assert T.fold("id​iot") == "idiot"
    assert T.fold("ｓｃｕｍ") == "scum"
    assert T.fold("in 2019, 42 men") == "in 2019, 42 men"


def brute_hits(text, weights, exceptions):
    """Weights of hits by plain search at every place."""
    s, total = T.fold(text), 0.0
    spared = [(i, i + len(p)) for p in exceptions for i in range(len(s)) if s.startswith(p, i) and (not i or not s[i - 1].isalnum()) and not s[i + len(p) : i + len(p) + 1].isalnum()]
    for i in range(len(s)):
        if i and s[i - 1].isalnum():
            continue
        best = (0.0, 0)
        for term, w in weights.items():
            form = term.rstrip("$")
            if s.startswith(form, i) and (not term.endswith("$") or not s[i + len(form) : i + len(form) + 1].isalnum()):
                best = max(best, (w, i + len(form)))
        if best[0] and not any(a <= i and best[1] <= b for a, b in spared):
            total += best[0]
    return total


def test_hits_equal_plain_search():
    weights = {"idiot$": 3.0, "mor": 1.5, "moron$": 2.5, "scum": 2.0}
    model = T.Lexicon(weights)
    a = model.automaton()
    for text in ["an idiot, a m0ron and scummy morals", "idiot proof trash can", "an idiot-proof idiot", "xidiot idiots", "", "idiot", "class clown scum"]:
        s = T.fold(text)
        words = 1 + s.count(" ") + s.count("\n")
        assert abs(T.features(text, a)[0] * (1 + np.log1p(words)) - brute_hits(text, weights, model.exceptions)) < 1e-9, text


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = T.learn(docs, labels)
    held = labels.where(crc32_hex_mod4() == 2)
    rows = T.score(docs, model).join(held, F.col("id") == F.col("doc_id")).select("score", "toxic").toPandas()
    pos, neg = rows[rows.toxic == 1].score, rows[rows.toxic == 0].score
    assert len(pos) >= 5
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    assert auc > 0.95
    assert (neg >= 0.3).mean() < 0.01
    assert rows.score.between(0, 1).all()


def test_awkward(spark):
    model = T.Lexicon({"alpha$": 5.0})
    out = {(r.id, r.score >= 0.3) for r in T.score(awkward(spark), model).collect()}
    assert (1, True) in out and (3, False) in out and (4, False) in out and (None, True) in out
    assert T.score(awkward(spark), model).count() == len(ROWS)
    df = awkward(spark)
    kept = T.drop_toxic(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 8, 9, 10}
    assert T.drop_toxic(empty(spark), model).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert set(T.learn(df, no_labels).weights) == {f"{w}$" for w in T.SEEDS}
    null_labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    T.learn(df, null_labels)


def test_long_tokens_take_linear_time():
    for text in ("x" * 300_000, "!" * 300_000, "a1" * 150_000, "idiot!" * 50_000):
        T.features(text, T.Lexicon({"idiot$": 3.0}).automaton())


def test_other_readings():
    """Words whose disguise ``fold`` leaves as it is are asked about in their other reading too."""
    weights = {"dumbass$": 3.0, "idiot$": 3.0, "asshole$": 3.0, "worthless$": 3.0}
    a = T.Lexicon(weights).automaton()
    for text in ("a dumba$$ there", "worthle$$", "you 1d107", "4$$h0l3"):
        assert T.features(text, a)[0] > 0, text
    for text in ("it cost $5 in 1990", "mail@example", "what!", "a 42"):
        assert T.features(text, a) == (0.0, 0.0), text


def brute_score(text, model):
    weights, total, s = model.weights, 0.0, T.fold(text)
    words = 1 + s.count(" ") + s.count("\n")
    more = T.other_readings(text)
    total = brute_hits_of(s + ("\n" + more if more else ""), weights, model.exceptions)
    f = (total / (1 + math.log1p(words)), math.log1p(100 * total / words)) if total and text else (0.0, 0.0)
    return 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * f[0] + model.curve[2] * f[1])))


def brute_hits_of(folded, weights, exceptions):
    fold, T.fold = T.fold, lambda s: s
    try:
        return brute_hits(folded, weights, exceptions)
    finally:
        T.fold = fold


def test_query_equals_plain_search(spark):
    """The registered query: every document once, held out by CRC-32, scores as by plain search, cut at 0.3."""
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = T.learn(docs, spark.read.parquet(f"{small}/labels.parquet"))
    out = {r.doc_id: r for r in registry.op1_toxicity(spark, small).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert set(out) == set(texts)
    for i, t in texts.items():
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert out[i].predicted == int(out[i].score >= 0.3)
        if len(t) < 3000:
            assert abs(out[i].score - brute_score(t, model)) < 1e-9, i
