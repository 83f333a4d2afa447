import hashlib
from collections import Counter

import corpus_pipeline as P
from ontomill.llm import bpe, mixing, registry
from tests.llm.awkward import ROWS, SCHEMA, awkward, empty
from tests.llm.test_near_dedup import brute_near_copies, kept_keys

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    clean = P.drop_toxic(spark, docs, SF)
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    rows = {r.doc_id: r.text for r in clean.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()}
    assert not (toxic & ({r.doc_id for r in docs.collect()} - set(rows)))
    once = P.drop_copies(spark, clean, SF)
    largest = {}
    for i, t in rows.items():
        largest[t] = max(largest.get(t, i), i)
    assert {r.doc_id for r in once.collect()} == set(largest.values()) and once.columns == columns
    few = P.drop_near_copies(spark, once, SF)
    assert kept_keys(few) == sorted(brute_near_copies([(i, t) for t, i in largest.items()]), key=str)
    mixed = P.mix(spark, few, SF)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(times) <= set(largest.values()) and sum(times.values()) > 0.5 * few.count()
    tokens = P.tokenize(spark, few, SF)
    with open(registry.tokenizer_path(), encoding="utf-8") as f:
        b = bpe.Bpe(f.read())
    by_id = {i: t for t, i in largest.items()}
    assert all(r.n_tokens == len(b.encode(by_id[r.doc_id])) for r in tokens.collect())


def test_run(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "bpe"]


def test_stages_on_awkward_tables(spark):
    """What a stage may take away is known exactly: nothing here is toxic, equal texts and near copies go, whole rows stay whole."""
    rows = list(dict.fromkeys((i, t) for i, t, *_ in ROWS))
    top = {}
    for i, t in rows:
        top[t or ""] = max(top.get(t or "", -1), -1 if i is None else i)
    for df, want_once, want_few in (
        (awkward(spark, False), {(None if i < 0 else i, t) for t, i in top.items()}, brute_near_copies(rows)),
        (empty(spark), set(), []),
        (spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA), {(None, "")}, [(None, hashlib.sha256(b"").hexdigest())]),
    ):
        clean = P.drop_toxic(spark, df, SF)
        assert kept_keys(clean) == kept_keys(df) and clean.columns == df.columns
        once = P.drop_copies(spark, df, SF)
        assert {(r.doc_id, r.text or "") for r in once.collect()} == want_once and once.count() == len(want_once)
        few = P.drop_near_copies(spark, df, SF)
        assert kept_keys(few) == sorted(want_few, key=str)
        mixed = P.mix(spark, df, SF)
        assert {str(r) for r in mixed.collect()} <= {str(r) for r in df.collect()} and mixed.columns == df.columns
        assert P.tokenize(spark, df, SF).count() == df.count()


def test_scarce_poor_documents_cost_no_good_ones(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = registry.labelled_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = labels.where("domain = 'toxic'").withColumnRenamed("id", "doc_id")
    docs = docs.join(toxic, "doc_id", "left_anti")
    model = mixing.fit_domains(docs, labels.where("domain <> 'toxic'"), P.DOMAINS)
    members = {r.id: r for r in mixing.memberships(docs, model).collect()}
    have = sum(r.n_tokens * r.p[1] for r in members.values()) / sum(r.n_tokens for r in members.values())
    assert have < P.SHARES[1]
    times = Counter(r.doc_id for r in P.mix(spark, docs, sf).collect())
    good = {r.id for r in labels.where("domain = 'good'").collect()} & set(members)
    assert good and all(times[i] >= 1 for i in good)
    tokens = sum(n * members[i].n_tokens for i, n in times.items())
    poor = sum(n * members[i].n_tokens * members[i].p[1] for i, n in times.items())
    assert have < poor / tokens < P.SHARES[1] + 0.02
