import hashlib
import random
import re

import numpy as np
import xxhash

from ontomill.llm import near_dedup as N
from tests.llm.awkward import ROWS, awkward, empty


def brute_print(text, size=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, threshold=3):
    """prints: (id, fp); the least id reachable."""
    values = sorted({f for _, f in prints})
    up = {f: f for f in values}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= threshold:
                up[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return {f: least.get(root(f)) for f in values}


def test_simhash_equals_brute_force():
    texts = [t or "" for _, t, *_ in ROWS if len(t or "") < 100_000] + ["A b", "Ünï CÖDE x\x1cy\x85z w", "a\vb\fc\rd e f", "q " * 5 + "r"]
    for t in texts:
        for size in (3, 5):
            assert N.simhash(t.encode(), size) == brute_print(t, size), t[:40]


def test_pieces_join(monkeypatch):
    text = " ".join(f"w{i}" for i in range(3000))
    whole = N.simhash(text.encode())
    monkeypatch.setattr(N, "PIECE", 100)
    assert N.simhash(text.encode()) == whole == brute_print(text)


def test_code_is_perfect():
    words = np.arange(0, 1 << 23, 97)
    near, over = N.around(words, 0)
    assert near.shape[1] == 1 and not over.any()
    assert np.bitwise_count(words ^ near[:, 0]).max() == 3
    assert not N._syndromes(near[:, 0]).any()
    # the sphere of radius 3 + flips around a word holds that many code words on average
    sphere = [1, 23, 253, 1771, 8855, 33649]
    for flips in (1, 2):
        _, over = N.around(words, flips)
        assert abs((over <= flips).sum(1).mean() - sum(sphere[: 4 + flips]) / 2048) < 0.05


def test_close_pairs_share_an_anchor():
    rng = random.Random(5)
    for threshold in range(1, N.MOST + 1):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), threshold):
                b ^= 1 << bit
            rows, keys = N.anchors(np.array([a, b], np.uint64), threshold)
            assert set(keys[rows == 0].tolist()) & set(keys[rows == 1].tolist())
            assert len(keys) == len({*zip(rows.tolist(), keys.tolist(), strict=True)})


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_give_brute_force_components(spark):
    rng = random.Random(9)
    values = []
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 5, 60])):
            values.append(f)
            g = f
            for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5])):
                g ^= 1 << bit
            f = g if rng.random() < 0.5 else f
            values.append(g)
    values = sorted(set(values))
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for per_anchor, threshold in ((2048, 3), (3, 3), (3, 6)):
        want = brute_components([(i, v) for i, v in enumerate(values)], threshold)
        edges = N.links(df, threshold, per_anchor)
        roots = {r.node: r.root for r in N.connected_components(edges, "a", "b").collect()}
        groups, expected = {}, {}
        for v in values:
            groups.setdefault(roots.get(signed(v), signed(v)), set()).add(v)
            expected.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_classes(spark):
    base = "the quick brown fox jumps over the lazy dog again and again until the evening comes and the night falls over all of us in this small town".split()
    rows = list(ROWS)
    for k in range(40):
        words = list(base) * 4
        words[k] = f"new{k % 7}"
        rows.append((100 + k, " ".join(words), "en", "s", 1))
    df = spark.createDataFrame(rows, awkward(spark, False).schema)
    out = N.near_duplicate_classes(df).collect()
    prints = [(i, N.simhash((t or "").encode())) for i, t, *_ in rows]
    want = brute_components(prints)
    assert sorted(((r.id, r.fp & (1 << 64) - 1, r.component_id) for r in out), key=str) == sorted(((i, f, want[f]) for i, f in prints), key=str)


def test_drop_and_empty(spark):
    df = awkward(spark)
    out = N.drop_near_duplicates(df)
    assert out.columns == df.columns
    ids = [r.doc_id for r in out.collect()]
    assert 1 in ids and 2 not in ids and 9 not in ids
    assert N.near_duplicate_classes(empty(spark)).count() == 0
    assert N.drop_near_duplicates(empty(spark)).count() == 0


def test_words(spark):
    words = "b A a c B d".split()
    hs = [xxhash.xxh64_intdigest(w, seed=42) for w in "abcd"]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > 4)
    assert N.simhash_of_words(" ".join(words).encode()) == want and N.simhash_of_words(b" \n") == 0


def test_near_copies_of_similarity_go(spark):
    """Of edited copies whose five-word shingles have a similarity of 0.8 or more, most are found; unrelated texts are kept."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows, copies = [], 0
    for k in range(150):
        words = [vocabulary[int(3000 * rng.random() ** 2)] for _ in range(300)]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):
            edited = list(words)
            for at in rng.sample(range(300), 4):
                edited[at] = rng.choice(vocabulary)
            rows.append((10 * k + c, " ".join(edited)))
            copies += 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in N.drop_near_duplicates(df, threshold=6, size=0).collect()}
    assert all(10 * k in kept for k in range(150))
    assert len(kept) - 150 < 0.1 * copies


def test_ids_that_are_null_or_repeat_cost_no_unrelated_text(spark):
    one, other = "alpha beta gamma delta epsilon zeta", "wholly unrelated words stand in this one here"
    rows = [(1, one), (None, one), (None, other), (7, one), (7, "and a third text that nothing else is near to")]
    out = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)


def five(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingle_sets_equal_brute_force(monkeypatch):
    texts = ["", " \n", "a", "a B c d", "a b c d e", "a b c d e A B C D E", " ".join(f"w{i % 40}" for i in range(500))]
    want = [sorted({xxhash.xxh64_intdigest(" ".join(s).encode(), seed=42) for s in five(t)}) for t in texts]
    assert [N.shingle_set(t.encode()).tolist() for t in texts] == want
    monkeypatch.setattr(N, "PIECE", 50)
    assert [N.shingle_set(t.encode()).tolist() for t in texts] == want


def test_links_are_verified_on_the_texts(spark, monkeypatch):
    """Unrelated long texts of one vocabulary, reordered texts and repeated words stay; edited copies go, in small blocks too."""
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=50_000))) for i in range(3)]
    words = rng.sample(vocabulary, 200)
    for i in range(10, 14):
        rows.append((i, " ".join(words)))
        rng.shuffle(words)
    rows += [(20, "one two three four five six " + "six " * 60), (21, "six " + "five four three two one " * 40)]
    for i in range(30, 60):
        edited = list(words)
        edited[3 * (i - 30)] = "new"
        rows.append((i, " ".join(edited)))
    prints = [N.simhash_of_words(t.encode()) for _, t in rows]
    assert len(set(prints[:7])) <= 2
    sets, up = [five(t) for _, t in rows], {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 6 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                lo, hi = sorted((root(rows[a][0]), root(rows[b][0])))
                up[hi] = lo
    want = {root(i) for i, _ in rows}
    assert {0, 1, 2, 10, 11, 12, 13, 20, 21} <= want and len(want) < 20
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for per_block in (256, 4):
        monkeypatch.setattr(N._verified_classes, "__defaults__", (per_block, 8 << 20))
        assert {r.doc_id for r in N.drop_near_duplicates(df, threshold=6, size=0, similarity=0.8).collect()} == want


def test_word_prints_equal_brute_force():
    for text in ("", " .,", "b A a, c-B d. a", "x " * 5000 + "y"):
        words = re.findall(r"[^\x20\x09-\x0D!-/:-@\[-`{-~]+", text.lower())
        counts = {w: words.count(w) for w in set(words)}
        for seed, got in zip(N.SEEDS, N.word_prints(text.encode()), strict=True):
            weight = {w: round(1024 * n**0.5) for w, n in counts.items()}
            total = sum(weight.values())
            hs = {w: xxhash.xxh64_intdigest(w.encode(), seed=seed) for w in weight}
            assert got == sum(1 << b for b in range(64) if 2 * sum(weight[w] for w in weight if hs[w] >> b & 1) > total)


def brute_near_copies(rows):
    """Ids that stay of (id, text): the least of each component of verified links, over all pairs."""
    prints = [N.word_prints((t or "").encode()) for _, t in rows]
    sets = [five(t or "") for _, t in rows]
    up = {k: k for k in range(len(rows))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            bits = [(x ^ y).bit_count() for x, y in zip(prints[a], prints[b], strict=True)]
            if min(bits) <= N.NEAR and sum(bits) <= N.WHOLE and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = {}
    for k, (i, t) in enumerate(rows):
        least.setdefault(root(k), []).append((i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(((None if none else i, sha) for none, i, sha in map(min, least.values())), key=str)


def kept_keys(df):
    return sorted(((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in df.collect()), key=str)


def near_copy_rows():
    rng = random.Random(8)
    vocabulary = [f"word{i}" for i in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=5000))) for i in range(3)]
    words = rng.sample(vocabulary, 200)
    for i in range(10, 14):
        rows.append((i, " ".join(words)))
        rng.shuffle(words)
    rows += [(20, "one two three four five six " + "six " * 60), (21, "six " + "five four three two one " * 40), (22, None), (23, ""), (24, " ."), (None, "one two three"), (None, "one two three"), (None, "another text"), (25, "one two three")]
    for base in range(3):
        own = list(words) if not base else rng.sample(vocabulary, 150)
        for i in range(100 * base + 30, 100 * base + 60):
            edited = list(own)
            for at in rng.sample(range(len(own)), rng.randrange(1, 9)):
                edited[at] = rng.choice(vocabulary)
            rows.append((i, " ".join(edited)))
    return rows


def test_near_copies_equal_brute_force(spark, monkeypatch):
    """Every pair compared: unrelated, reordered, edited, short, null and repeated texts; blocks of any size give the same."""
    rows = near_copy_rows()
    want = sorted(brute_near_copies(rows), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for per_block in (256, 5):
        monkeypatch.setattr(N._verified_classes, "__defaults__", (per_block, 8 << 20))
        assert kept_keys(N.drop_near_copies(df)) == want, per_block


def test_labelled_links_pass_on_little_and_lose_none(spark):
    """A large group that is one label emits nothing in the second round; components are those of all pairs."""
    rng = random.Random(4)
    values = set()
    for _ in range(4):
        base = [rng.getrandbits(64) for _ in range(3)]
        for _ in range(150):
            values.add(tuple(signed(f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])))) for f in base))
    values = sorted(values)
    p = spark.createDataFrame(values, "fp0 long, fp1 long, fp2 long")
    prints = ["fp0", "fp1", "fp2"]
    got = {tuple(r[:3]): r.root for r in N.candidate_components(p, prints, 4, 20).select(*prints, "root").collect()}
    a = np.array(values, np.int64).view(np.uint64)
    up = list(range(len(a)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(N.near_prints(a[:i], a[i], 4, 20)):
            up[root(i)] = root(int(j))
    mine, theirs = {}, {}
    for k, v in enumerate(values):
        mine.setdefault(root(k), set()).add(v)
        theirs.setdefault(got[v], set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    one = spark.createDataFrame([(7, *v) for v in values], "label long, fp0 long, fp1 long, fp2 long")
    assert N.label_links(one, prints, 4, 20, 4).count() == 0


def test_most_edited_copies_are_found(spark):
    """Of pairs of edited copies whose five-word shingles have a similarity of 0.8 or more, nine in ten at least are linked."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    rows, copies = [], 0
    for k in range(150):
        words = [vocabulary[int(3000 * rng.random() ** 2)] for _ in range(300)]
        rows.append((10 * k, " ".join(words)))
        for c in range(1, 4):
            edited = list(words)
            for at in rng.sample(range(300), 5):
                edited[at] = rng.choice(vocabulary)
            if len(five(" ".join(words)) & five(" ".join(edited))) >= 0.8 * len(five(" ".join(words)) | five(" ".join(edited))):
                rows.append((10 * k + c, " ".join(edited)))
                copies += 1
    kept = {r.doc_id for r in N.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert copies > 300 and all(10 * k in kept for k in range(150))
    assert len(kept) - 150 < 0.1 * copies


def test_drop_near_copies_on_awkward_tables(spark):
    df = awkward(spark)
    out = N.drop_near_copies(df)
    assert out.columns == df.columns
    assert kept_keys(out) == sorted(brute_near_copies(list(dict.fromkeys((i, t) for i, t, *_ in ROWS))), key=str)
    assert N.drop_near_copies(empty(spark)).count() == 0
    nulls = spark.createDataFrame([(None, None)] * 3, "doc_id long, text string")
    assert N.drop_near_copies(nulls).count() == 1


def test_few_links_take_no_rounds_of_jobs(spark, monkeypatch):
    """Every job costs the driver memory; the rounds, for more links than a task takes, keep the same rows."""
    rng = random.Random(12)
    rows = []
    for group in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        for copy in range(4):
            edited = list(words)
            edited[rng.randrange(200)] = f"x{copy}"
            rows.append((len(rows), " ".join(edited)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tracker = spark.sparkContext.statusTracker()

    def kept(group):
        spark.sparkContext.setJobGroup(group, group)
        out = sorted(r.doc_id for r in N.drop_near_copies(df).collect())
        return out, len(tracker.getJobIdsForGroup(group))

    out, jobs = kept("few")
    assert out == list(range(0, 48, 4))
    assert jobs < 100
    monkeypatch.setattr(N, "AT_ONCE", 1)
    assert kept("rounds")[0] == out


def test_components_at_once_and_in_rounds(spark):
    edges = [(f"n{k:03}", f"n{k + 1:03}") for k in range(60) if k % 20 != 19] + [("n000", "n000"), (None, "n001")]
    df = spark.createDataFrame(edges, "a string, b string").repartition(7)
    want = {f"n{k:03}": f"n{k // 20 * 20:03}" for k in range(60)}
    for at_once in (0, 1, 1000):
        got = N.connected_components(df, "a", "b", at_once=at_once).collect()
        assert len(got) == 60 and {r.node: r.root for r in got} == want, at_once
    assert N.connected_components(df.limit(0), "a", "b", at_once=1000).count() == 0
