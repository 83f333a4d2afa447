import hashlib
import random
import sys
import unicodedata

import pytest
from tokenizers import Tokenizer

from ontomill.llm import bpe, registry
from tests.llm.awkward import ROWS, awkward, empty


@pytest.fixture(scope="module")
def pair():
    path = registry.tokenizer_path()
    with open(path, encoding="utf-8") as f:
        return bpe.Bpe(f.read()), Tokenizer.from_file(path)


def same(pair, text):
    ids = pair[1].encode(text, add_special_tokens=False).ids
    assert pair[0].encode(text) == ids, repr(text[:80])
    assert pair[0].decode(ids) == pair[1].decode(ids, skip_special_tokens=False)


def test_documents(pair, spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        same(pair, r.text)


def test_every_character(pair):
    odd = []
    for c in map(chr, range(sys.maxunicode + 1)):
        if "\ud800" <= c <= "\udfff" or unicodedata.category(c) == "Cn" or ("" <= c <= "") or ord(c) > 0xF0000:
            continue
        text = f"a{c}b {c}{c} 1{c}"
        if pair[0].encode(text) != pair[1].encode(text, add_special_tokens=False).ids:
            odd.append(hex(ord(c)))
    assert not odd, (len(odd), odd[:40])


def test_awkward_texts(pair):
    for t in [t or "" for _, t, *_ in ROWS] + ["<|endoftext|>", "a<|startoftext|>b c<|endoftext|>", "it's we'll I'D they're x've", "ΑΣ ΣΑΣ.", "é<|endoftext|>́", "\x1c a\x1fb \x85 ​", "İstanbul ǅ ﬁ", "a" * 5000 + "b" * 3001]:
        same(pair, t)


def test_random_words(pair):
    rng = random.Random(3)
    for _ in range(3000):
        same(pair, "".join(rng.choice("etaoinshrdluéüñ' ,.0") for _ in range(rng.randrange(1, 40))))


def test_merge_equals_plain_search(pair):
    def plain(symbols):
        while True:
            found = [(r, i) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := pair[0].ranks.get(a << 20 | b)) is not None]
            if not found:
                return symbols
            r, i = min(found)
            symbols = [*symbols[:i], pair[0].merged[r], *symbols[i + 2 :]]

    rng = random.Random(4)
    for n in [1, 2, 3, 4, 5, 8, 9, 16, 17, 33, 200]:
        for _ in range(30):
            s = [pair[0].byte_ids[rng.choice(b"abest")] for _ in range(n)]
            assert pair[0].merge(list(s)) == plain(s)


def test_digests(spark, pair):
    out = {(r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(awkward(spark), registry.tokenizer_path()).collect()}
    want = set()
    for i, t, *_ in ROWS:
        ids = pair[1].encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(pair[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out == want
    assert bpe.digests(empty(spark), registry.tokenizer_path()).count() == 0
    df = bpe.encode_column(awkward(spark), registry.tokenizer_path())
    assert df.where("doc_id = 10").first().token_ids == pair[1].encode("one", add_special_tokens=False).ids
