import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ontomill.llm import exact_dedup as X
from tests.llm.awkward import ROWS, awkward, empty


def brute(rows):
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[text or ""].append(i)
    out = []
    for text, ids in groups.items():
        top = max(ids, key=lambda i: (i is not None, i or 0))
        out += [(i, top, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def got(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.sha) for r in df.collect()), key=str)


def test_prints_compose():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    tables = X._tables()
    whole = X.text_print(data, tables)
    for cut in (0, 1, 63, 2500, 5000):
        assert X.combine(X.text_print(data[:cut], tables), X.text_print(data[cut:], tables), 5000 - cut) == whole
    assert X.text_print(data, tables, chunk=97) == whole
    h = 0
    for b in data:
        h = (h * X.BASES[0] + b + 1) % X.MODULI[0]
    assert h == whole[0]
    assert X.text_print(b"", tables) != X.text_print(b"\0", tables) != X.text_print(b"\0\0", tables)


@pytest.mark.parametrize("huge", [1 << 20, 1000, 0])
def test_classes(spark, huge):
    out = X.duplicate_classes(awkward(spark), huge_bytes=huge)
    assert got(out) == brute(ROWS)
    kept = [r for r in out.collect() if r.kept]
    assert len(kept) == len({r.sha for r in kept}) == len({t or "" for _, t, *_ in ROWS})


def test_collisions_are_told_apart(spark):
    assert got(X.duplicate_classes(awkward(spark), key=(F.lit(0),))) == brute(ROWS)


def test_drop(spark):
    df = awkward(spark)
    out = X.drop_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 2, 4, 5, 6, 7, 9, 10]


def test_huge_chunks_equal_plain(spark):
    df = awkward(spark, clashing=False).where("doc_id is not null")
    a = X.prints(df).collect()
    b = X.prints(df, huge_bytes=10, chunk_bytes=1000).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_hot_group_and_empty(spark):
    rows = [(i, "same text" if i % 3 else f"own {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert got(X.duplicate_classes(df)) == brute(rows)
    assert X.duplicate_classes(empty(spark)).count() == 0
    assert X.drop_duplicates(empty(spark)).count() == 0


def test_powers():
    assert X.powers(3, 7, 5).tolist() == [pow(3, k, 7) for k in range(4, -1, -1)]
    assert X.chunk_print(np.array([1], np.uint8), X._tables()) == (2, 2)


def test_repeated_rows_keep_the_same_one(spark):
    """Of rows alike in id and text the one that stays doesn't hang on their order."""
    rows = [(5, "same", x) for x in "dbca"] + [(5, "other", "z"), (None, "null id", "q"), (None, "null id", "p")]
    for parts in (1, 3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string, extra string").repartition(parts, "extra")
        assert sorted((str(r.doc_id), r.text, r.extra) for r in X.drop_duplicates(df).collect()) == [("5", "other", "z"), ("5", "same", "a"), ("None", "null id", "p")]


def test_huge_equal_and_differing_texts(spark):
    """Texts of many chunks are compared chunk by chunk: a difference in the last byte, or one more byte, is found."""
    long = "abcdefgh" * 40_000
    rows = [(1, long), (2, long), (3, long[:-1] + "x"), (4, long + "y"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(X.duplicate_classes(df, key=(F.lit(0),))) == brute(rows)
    assert got(X.duplicate_classes(df, huge_bytes=1000)) == brute(rows)
