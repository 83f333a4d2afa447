"""SimHash near-duplicates by anchor-point covering.

A 64-bit fingerprint is cut into blocks of 23, 23 and 18 bits. Of at most t differing bits, some pair of blocks holds at most
two thirds of t. On each pair the anchors are the words of the product of two binary Golay codes [23, 12] (the 18-bit block is
padded with zeros): a perfect covering code of radius 3 a block. A fingerprint is replicated to every anchor within covering
radius plus half of the pair's threshold. Two fingerprints that differ in no more than that threshold have a word half-way
between them, and meet at that word's anchor, where they are compared. Of 2**24 anchors a pair, about 10 hold a fingerprint
for thresholds up to 4, about 60 for 5 and 6.

Only distinct fingerprints are replicated, and an anchor gives a spanning forest of its links, not all pairs. An anchor with
more than ``per_anchor`` fingerprints is dealt over the pairs of its salts.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.columns import string_bytes, text_of, uint64_to_signed, without
from ontomill.plans.graph import connected_components, stars
from ontomill.plans.rounds import durable, maybe_broadcast
from ontomill.plans.ship import arrow_rows

SEED = 42
THRESHOLD = 3
#: Differing bits that the replication is laid out for at most.
MOST = 6
#: Generator polynomial of the binary Golay code: x**11 + x**9 + x**7 + x**6 + x**5 + x + 1.
GOLAY = 0b101011100011
#: (first bit, bits) of each block, and the pairs of blocks.
BLOCKS = ((0, 23), (23, 23), (46, 18))
PAIRS = ((0, 1), (0, 2), (1, 2))
#: Bytes of a text whose shingles are hashed at a time.
PIECE = 1 << 20
#: Words of a shingle in the comparison of whole texts, and the Jaccard similarity from which texts are near copies.
SHINGLE = 5
SIMILARITY = 0.8
#: Seeds of a text's word prints, the bits in which one of them may differ, and those in which all may differ together.
SEEDS = (42, 43, 44)
NEAR = 4
WHOLE = 20
#: Edges that one task contracts to components; more take rounds over all tasks.
AT_ONCE = 100_000
#: ASCII punctuation, which parts words as white space does in the word prints.
BREAKS = bytes(32 if chr(b) in string.punctuation else b for b in range(256))


def _pieces(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, at most about a megabyte of them at a time."""
    if len(data) <= PIECE:
        yield data.split()
        return
    at = 0
    space = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
    while at < len(data):
        to = at + PIECE
        if to < len(data):
            found = [x for s in space if (x := data.find(s, to)) >= 0]
            to = min(found, default=len(data))
        yield data[at:to].split()
        at = to


def simhash(data: bytes, size: int = 3, seed: int = SEED) -> int:
    """The fingerprint of a text in UTF-8: words between ASCII white space, A-Z lower-cased, shingles of ``size`` words.

    A text of fewer words has one shingle, the whole; a text of none has fingerprint zero. A bit is one if it is set in over
    half the shingles' XXH64.
    """
    counts, n, tail = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for words in _pieces(data.lower()):
        words = tail + words
        if len(words) >= size:
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
            h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)), np.uint64, len(starts))
            for at in range(0, len(h), 1 << 16):
                part = h[at : at + (1 << 16)]
                counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(h)
            tail = words[len(words) - size + 1 :]
        else:
            tail = words
    if not n:
        if not tail:
            return 0
        return digest(b" ".join(tail), seed)
    bits = np.flatnonzero(2 * counts > n).tolist()
    return sum(1 << b for b in bits)


def simhash_of_words(data: bytes, seed: int = SEED) -> int:
    """The fingerprint of a text's distinct words, each counted once, so that frequent words don't decide it; of none, zero.

    An edited word changes one feature and not a whole run of shingles, so near copies stay within few bits.
    """
    words = set(data.lower().split())
    if not words:
        return 0
    h = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * counts > len(h)).tolist())


def _hash_rows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The last column holds texts; it is replaced by their fingerprints; size 0 stands for distinct words."""
    for batch in batches:
        texts = string_bytes(batch.column(batch.num_columns - 1))
        f = np.array([simhash(x, size) if size else simhash_of_words(x) for x in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(uint64_to_signed(f))], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``id, fp`` of every row, of shingles of ``size`` words or (size 0) of distinct words; null counts as empty text."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t"))
    return arrow_rows(rows, lambda it: _hash_rows(it, size), f"id {kind}, fp long")


@cache
def _cosets() -> tuple[np.ndarray, np.ndarray]:
    """Of each of the 2048 syndromes, the words of weight up to 5 with it, lightest first, and how far each exceeds the radius.

    A word and an error of its syndrome make a code word, so these are the ways to the anchors around a word; rows are filled
    up with an excess that never passes.
    """
    bits = 1 << np.arange(23)
    words = [np.zeros(1, np.int64)]
    for _ in range(5):
        # every word once: a further bit above the highest
        last = words[-1]
        words.append(np.concatenate([last[last < b] | b for b in bits]))
    words = np.concatenate(words)
    syndromes, excess = _syndromes(words), np.maximum(0, np.bitwise_count(words).astype(np.int64) - 3)
    order = np.lexsort((words, excess, syndromes))
    syndromes, words, excess = syndromes[order], words[order], excess[order]
    first = np.searchsorted(syndromes, np.arange(1 << 11))
    place = np.arange(len(words)) - first[syndromes]
    errors, over = np.zeros((1 << 11, place.max() + 1), np.int64), np.full((1 << 11, place.max() + 1), 9, np.int64)
    errors[syndromes, place], over[syndromes, place] = words, excess
    return errors, over


def _syndromes(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
    return x


@cache
def _syndrome_tables() -> tuple[np.ndarray, np.ndarray]:
    return _syndromes(np.arange(1 << 12)), _syndromes(np.arange(1 << 11) << 12)


def around(words: np.ndarray, flips: int) -> tuple[np.ndarray, np.ndarray]:
    """Code words within covering radius plus ``flips`` of each 23-bit word, nearest first, and by how much each exceeds the radius."""
    low, high = _syndrome_tables()
    syndromes = low[words & 0xFFF] ^ high[words >> 12]
    errors, over = _cosets()
    width = int((over <= flips).sum(1).max())
    return words[:, None] ^ errors[syndromes, :width], over[syndromes, :width]


def flips_for(threshold: int) -> int:
    """Half, rounded up, of the bits that can differ in the closest pair of blocks."""
    return -(-(2 * threshold // 3) // 2)


def anchors(fp: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor key) for each anchor that a fingerprint goes to."""
    flips = flips_for(threshold)
    blocks = [around((fp >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1), flips) for at, bits in BLOCKS]
    rows, keys = [], []
    for k, (i, j) in enumerate(PAIRS):
        (a, over_a), (b, over_b) = blocks[i], blocks[j]
        near = over_a[:, :, None] + over_b[:, None, :] <= flips
        rows.append(np.nonzero(near)[0])
        keys.append((a[:, :, None] << 23 | b[:, None, :])[near] | (k << 46))
    return np.concatenate(rows), np.concatenate(keys)


def _replicate(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(values), 2048):
            part = values[at : at + 2048]
            rows, keys = anchors(part.view(np.uint64), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], ["cell", "fp"])


def _near(x: np.ndarray, y: np.ndarray, threshold: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= threshold


def _links_of(values: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links within one anchor: each fingerprint is compared once with those not yet reached."""
    found, rest = [], values
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            hit = _near(rest, x, threshold)
            if hit.any():
                got = rest[hit]
                found.append((np.full(len(got), x), got))
                queue.extend(got)
                rest = rest[~hit]
    return found


def _compare(batches: Iterator[pa.RecordBatch], threshold: int, small: int = 12) -> Iterator[pa.RecordBatch]:
    """Links of rows (cell, part, fp) that come sorted by cell and part."""

    def links(c: np.ndarray, p: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (p[1:] != p[:-1]))))
        sizes = np.diff(np.append(new, len(c)))
        group = np.repeat(np.arange(len(new)), sizes)
        a, b = [], []
        little = sizes[group] <= small
        for shift in range(1, min(small, int(sizes.max(initial=0)))):
            hit = np.flatnonzero((group[shift:] == group[:-shift]) & little[shift:] & _near(f[shift:], f[:-shift], threshold))
            a.append(f[hit])
            b.append(f[hit + shift])
        for k in np.flatnonzero(sizes > small):
            for x, y in _links_of(f[new[k] : new[k] + sizes[k]], threshold):
                a.append(x)
                b.append(y)
        a, b = (np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    held = None
    for batch in batches:
        c, p, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        f = f.view(np.uint64)
        if held:
            c, p, f = (np.concatenate([x, y]) for x, y in zip(held, (c, p, f), strict=True))
        if not len(c):
            continue
        last = int(np.flatnonzero((c != c[-1]) | (p != p[-1]))[-1]) + 1 if (c[0], p[0]) != (c[-1], p[-1]) else 0
        if last:
            yield links(c[:last], p[:last], f[:last])
        held = c[last:], p[last:], f[last:]
    if held:
        yield links(*held)


def _dealt(cells: DataFrame, kept: list[str], salted_by: list[str], per_anchor: int) -> DataFrame:
    """``cell, part`` and the kept columns, sorted: a cell of more than ``per_anchor`` rows is dealt over the pairs of its salts."""
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > per_anchor).select(F.col("cell").alias("cell2"), F.ceil(F.col("n") / per_anchor).cast("int").alias("salts"))
    crowded = durable(crowded)  # at most one cell for each ``per_anchor`` rows
    joined = cells.join(maybe_broadcast(crowded, crowded.count(), 32), F.col("cell") == F.col("cell2"), "left").drop("cell2")
    salt = F.pmod(F.xxhash64(*salted_by, F.lit(7)), F.col("salts")).cast("int")
    other = F.when(F.col("salts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
    dealt = joined.select("cell", *kept, salt.alias("s"), F.explode(other).alias("o"))
    part = F.when(F.col("s").isNull(), 0).otherwise(F.least("s", "o").cast("long") * (1 << 31) + F.greatest("s", "o"))
    return dealt.select("cell", part.cast("long").alias("part"), *kept).repartition("cell", "part").sortWithinPartitions("cell", "part")


def links(distinct: DataFrame, threshold: int = THRESHOLD, per_anchor: int = 2048) -> DataFrame:
    """``a, b`` for links that hold all pairs of distinct fingerprints (column ``fp``) at ``threshold`` or fewer bits together."""
    if threshold > MOST:
        raise ValueError(f"the blocks are laid out for at most {MOST} differing bits")
    cells = arrow_rows(distinct.select("fp"), lambda it: _replicate(it, threshold), "cell long, fp long")
    dealt = _dealt(cells, ["fp"], ["fp"], per_anchor)
    return arrow_rows(dealt, lambda it: _compare(it, threshold), "a long, b long")


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, size: int = 3, per_anchor: int = 2048) -> DataFrame:
    """One row per row of ``docs``: ``id, fp, component_id`` (the least id reachable over links).

    Null text counts as empty (fingerprint zero); a null id is passed over when the least id is taken; an empty table gives
    an empty result; repeated rows have equal results.
    """
    return _classes(durable(fingerprints(docs, id_col, text_col, size)), threshold, per_anchor).select("id", "fp", "component_id")


def _classes(p: DataFrame, threshold: int, per_anchor: int = 2048) -> DataFrame:
    """The rows of ``p`` (``id, fp`` and others) with their ``root`` and ``component_id``."""
    distinct = durable(p.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(links(distinct, threshold, per_anchor), "a", "b")
    of = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = durable(of)
    least = of.where("root <> fp").groupBy("root").agg(F.min("least").alias("other"))
    own = of.where("root = fp").select("root", "least")
    least = own.join(least, "root", "left").select("root", F.coalesce(F.least("least", "other"), "least", "other").alias("component_id"))
    of = spread_join(of, durable(least), "root", "fp").select("fp", "root", "component_id")
    return p.join(of, "fp").select(*p.columns, "root", "component_id")


def spread_join(left: DataFrame, right: DataFrame, key: str, by: str, other: str | None = None, how: str = "inner", row_bytes: int = 64, ways: int = 16) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key (named ``other`` there, if not alike).

    A ``right`` of bounded size is broadcast; else rows of one key are dealt over ``ways`` tasks by column ``by`` of ``left``.
    """
    small = maybe_broadcast(right, n := right.count(), row_bytes)
    on = key if other is None else F.col(key) == F.col(other)
    if small is not right or not n:
        return left.join(small, on, how)
    left = left.withColumn("__way", F.pmod(F.xxhash64(by), F.lit(ways)).cast("int"))
    every = right.withColumn("__way2", F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    if other is None:
        return left.join(every.withColumnRenamed("__way2", "__way"), [key, "__way"], how).drop("__way")
    return left.join(every, on & (F.col("__way") == F.col("__way2")), how).drop("__way", "__way2")


def _keyed_prints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``id, sha, fp`` of every row; an id alone doesn't name a row where it is null or stands on several texts."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")).select("id", F.sha2("t", 256).alias("sha"), "t")
    return arrow_rows(rows, lambda it: _hash_rows(it, size), f"id {kind}, sha string, fp long")


def word_prints(data: bytes, seeds: tuple[int, ...] = SEEDS) -> list[int]:
    """Fingerprints of a text's words, one a seed; a word weighs the root of its count, so that no frequent word decides a bit.

    Words are runs between ASCII white space and punctuation, A-Z lower-cased; a text of none has fingerprints zero.
    """
    counts = Counter(data.lower().translate(BREAKS).split())
    if not counts:
        return [0] * len(seeds)
    weights = np.rint(1024 * np.sqrt(np.fromiter(counts.values(), np.float64, len(counts)))).astype(np.int64)
    digest, words, total, out = xxhash.xxh64_intdigest, list(counts), int(weights.sum()), []
    for seed in seeds:
        h = np.fromiter((digest(w, seed) for w in words), np.uint64, len(words))
        set_in = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 14):
            bits = np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            set_in += weights[at : at + (1 << 14)] @ bits
        out.append(sum(1 << b for b in np.flatnonzero(2 * set_in > total).tolist()))
    return out


def _word_print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column holds texts; it is replaced by their word prints."""
    for batch in batches:
        found = np.array([word_prints(x) for x in string_bytes(batch.column(batch.num_columns - 1))], np.uint64).reshape(-1, len(SEEDS))
        own = [pa.array(uint64_to_signed(found[:, k])) for k in range(len(SEEDS))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], [*batch.schema.names[:-1], *(f"fp{k}" for k in range(len(SEEDS)))])


def _word_keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, sha, fp0, fp1 ...`` of every row, of its words."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")).select("id", F.sha2("t", 256).alias("sha"), "t")
    return arrow_rows(rows, _word_print_rows, f"id {kind}, sha string, " + ", ".join(f"fp{k} long" for k in range(len(SEEDS))))


def near_prints(x: np.ndarray, y: np.ndarray, threshold: int, whole: int) -> np.ndarray:
    """Which rows of fingerprints (one column a seed) are near: one differs in ``threshold`` bits or fewer, all in ``whole`` or fewer."""
    d = np.bitwise_count(x ^ y)
    return (d.min(-1) <= threshold) & (d.sum(-1, dtype=np.int64) <= whole)


def _replicate_labelled(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """Of (label, fingerprints), a row for each anchor of each fingerprint."""
    for batch in batches:
        label, *prints = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
        for at in range(0, len(label), 2048):
            for k, f in enumerate(prints):
                rows, keys = anchors(f[at : at + 2048].view(np.uint64), threshold)
                rows = rows + at
                yield pa.RecordBatch.from_arrays([pa.array(keys | k << 48), pa.array(label[rows]), *(pa.array(g[rows]) for g in prints)], ["cell", *batch.schema.names])


def _label_links(label: np.ndarray, prints: np.ndarray, threshold: int, whole: int) -> list[tuple[int, int]]:
    """Pairs of labels that hold those of an anchor together whose fingerprints are near; equal labels need no pair."""
    found, rest = [], np.arange(len(label))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            same = label[rest] == label[x]
            near = ~same & near_prints(prints[rest], prints[x], threshold, whole)
            found += [(int(label[x]), y) for y in set(label[rest[near]].tolist())]
            queue.extend(rest[same | near])
            rest = rest[~(same | near)]
    return found


def _compare_labelled(batches: Iterator[pa.RecordBatch], threshold: int, whole: int, small: int = 12) -> Iterator[pa.RecordBatch]:
    """Links of labels of rows (cell, part, label, fingerprints) that come sorted by cell and part, each link once a batch."""

    def links(c: np.ndarray, p: np.ndarray, label: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        new = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (p[1:] != p[:-1]))))
        sizes = np.diff(np.append(new, len(c)))
        group = np.repeat(np.arange(len(new)), sizes)
        few, found = sizes[group] <= small, [np.zeros((0, 2), np.int64)]
        for shift in range(1, min(small, int(sizes.max(initial=0)))):
            at = np.flatnonzero((group[shift:] == group[:-shift]) & few[shift:] & (label[shift:] != label[:-shift]))
            at = at[near_prints(f[at + shift], f[at], threshold, whole)]
            found.append(np.stack([label[at], label[at + shift]], 1))
        for k in np.flatnonzero(sizes > small):
            own = slice(new[k], new[k] + sizes[k])
            found.append(np.array(_label_links(label[own], f[own], threshold, whole), np.int64).reshape(-1, 2))
        pairs = np.unique(np.sort(np.concatenate(found), 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    held = None
    for batch in batches:
        c, p, label, *f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns))
        f = np.stack(f, 1).view(np.uint64)
        if held:
            c, p, label, f = (np.concatenate([x, y]) for x, y in zip(held, (c, p, label, f), strict=True))
        if not len(c):
            continue
        last = int(np.flatnonzero((c != c[-1]) | (p != p[-1]))[-1]) + 1 if (c[0], p[0]) != (c[-1], p[-1]) else 0
        if last:
            yield links(c[:last], p[:last], label[:last], f[:last])
        held = c[last:], p[last:], label[last:], f[last:]
    if held:
        yield links(*held)


def label_links(nodes: DataFrame, prints: list[str], threshold: int, whole: int, reach: int, per_anchor: int = 2048) -> DataFrame:
    """``a, b``: labels of ``nodes`` (``label`` and fingerprints) that links hold together, found at the anchors within ``reach``.

    With ``reach`` as the threshold every near pair of nodes meets at some anchor. A group that has one label already passes on nothing.
    """
    kinds = "cell long, label long, " + ", ".join(f"{f} long" for f in prints)
    cells = arrow_rows(nodes.select("label", *prints), lambda it: _replicate_labelled(it, reach), kinds)
    dealt = _dealt(cells, ["label", *prints], prints, per_anchor)
    return arrow_rows(dealt, lambda it: _compare_labelled(it, threshold, whole), "a long, b long")


def candidate_components(p: DataFrame, prints: list[str], threshold: int, whole: int) -> DataFrame:
    """Distinct fingerprints of ``p``, how many rows have them (``n``), and the component (``root``) that near fingerprints link them to.

    In two rounds: at the nearest anchors alone, which joins much of a large group, then at all of them, where only links between
    what the first round left apart are passed on. Every near pair meets in the second round, so none is lost by the first.
    """
    nodes = durable(p.groupBy(*prints).agg(F.count("*").alias("n")).withColumn("label", F.monotonically_increasing_id()))
    # the first round only has to join many: nodes that are linked to the same node take its label, without rounds of components
    nearest = stars(label_links(nodes, prints, threshold, whole, 0), "a", "b")
    moved = spread_join(nodes, nearest, "label", prints[0], "u", "left")
    nodes = durable(moved.select(*prints, "n", F.coalesce("v", "label").alias("label")))
    found = connected_components(label_links(nodes, prints, threshold, whole, threshold), "a", "b", at_once=AT_ONCE)
    return durable(spread_join(nodes, found, "label", prints[0], "node", "left").select(*prints, "n", F.coalesce("root", "label").alias("root")))


def shingle_set(data: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, words as in ``simhash``; a text of fewer words has one, the whole, of none, none."""
    found, tail, short = [], [], True
    digest = xxhash.xxh64_intdigest
    for words in _pieces(data.lower()):
        words = tail + words
        n = len(words) - size + 1
        if n > 0:
            short = False
            found.append(np.unique(np.fromiter((digest(b" ".join(words[k : k + size]), seed) for k in range(n)), np.uint64, n)))
            tail = words[n:]
        else:
            tail = words
    if short and tail:
        return np.array([digest(b" ".join(tail), seed)], np.uint64)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column holds texts; it is replaced by their shingle sets."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingle_set(x).tobytes() for x in string_bytes(part.column(part.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sets, pa.binary())], [*part.schema.names[:-1], "s"])


def _similar(x: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sets have that Jaccard similarity, or more, to ``x``; two empty sets are equal."""
    out = np.zeros(len(others), bool)
    for k, y in enumerate(others):
        shared = 0
        if len(x) and len(y):
            at = np.searchsorted(x, y)
            at[at == len(x)] = 0
            shared = int((x[at] == y).sum())
        out[k] = shared * (1 + similarity) >= similarity * (len(x) + len(y)) - 1e-9
    return out


def _verified(label: np.ndarray, fps: np.ndarray, sets: list[np.ndarray], threshold: int, whole: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of labels that verified links hold together: near in fingerprint, their sets similar; equal labels need no link."""
    sizes = np.array([len(x) for x in sets])
    rest = np.arange(len(fps))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            taken = label[rest] == label[x]
            able = ~taken & (similarity * np.maximum(sizes[rest], sizes[x]) <= np.minimum(sizes[rest], sizes[x]) + 1e-9)
            hit = np.flatnonzero(able & near_prints(fps[rest], fps[x], threshold, whole))
            hit = hit[_similar(sets[x], [sets[k] for k in rest[hit]], similarity)]
            yield from {(int(label[x]), int(label[k])) for k in rest[hit]}
            taken[hit] = True
            queue.extend(rest[taken])
            rest = rest[~taken]


def _verify(batches: Iterator[pa.RecordBatch], threshold: int, whole: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of labels of rows (root, part, label, s, fingerprints) that come sorted by root and part."""

    def found(rows: list) -> pa.RecordBatch:
        label = np.array([r[0] for r in rows], np.int64)
        fps = np.array([r[2:] for r in rows], np.int64).view(np.uint64)
        pairs = list(_verified(label, fps, [np.frombuffer(r[1], np.uint64) for r in rows], threshold, whole, similarity))
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

    key, held = None, []
    for batch in batches:
        for root, part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, part) != key:
                if len(held) > 1:
                    yield found(held)
                key, held = (root, part), []
            held.append(row)
    if len(held) > 1:
        yield found(held)


def _verified_classes(docs: DataFrame, p: DataFrame, text_col: str, prints: list[str], threshold: int, whole: int, similarity: float, per_block: int = 256, block_bytes: int = 8 << 20) -> DataFrame:
    """``id, sha, root`` of the rows of ``p`` (``id, sha`` and fingerprints) that share a component of fingerprints with another row.

    Components of fingerprints are only where links are looked for: every pair in one of them that is near in fingerprint is
    compared by its texts' shingles, also where the fingerprints are equal, and the component is that of the verified links.
    A large component is cut into blocks. Texts are first compared within their block; then blocks of texts that this left apart
    meet each other and the blocks of the component's largest class, whose own blocks needn't meet again.
    """
    of = candidate_components(p, prints, threshold, whole)
    shared = durable(of.groupBy("root").agg(F.sum("n").alias("m")).where("m > 1").select("root"))
    of = durable(spread_join(of, shared, "root", prints[0]).select(*prints, "root"))
    members = durable(p.join(of, prints).select("id", "sha", *prints, "root"))
    wanted = members.select(F.col("sha").alias("sha2"), *prints, "root").distinct()
    texts = docs.select(text_of(text_col).alias("t")).withColumn("sha", F.sha2("t", 256))
    texts = texts.join(maybe_broadcast(wanted, members.count(), 200), F.col("sha") == F.col("sha2")).select("root", "sha", *prints, "t")
    kinds = "root long, sha string, " + ", ".join(f"{f} long" for f in prints)
    sets = arrow_rows(texts, _set_rows, f"{kinds}, s binary").dropDuplicates(["sha"])
    sets = durable(sets.withColumn("label", F.monotonically_increasing_id()))
    kept = ["root", "label", "s", *prints]
    count = F.greatest(F.ceil(F.count("*") / per_block), F.ceil(F.sum(F.octet_length("s").cast("long")) / block_bytes)).cast("int")

    def links_of(dealt: DataFrame) -> DataFrame:
        rows = dealt.select("root", "part", *kept[1:]).repartition("root", "part").sortWithinPartitions("root", "part")
        return connected_components(arrow_rows(rows, lambda it: _verify(it, threshold, whole, similarity), "a long, b long"), "a", "b", at_once=AT_ONCE)

    sizes = durable(sets.groupBy("root").agg(F.count("*").alias("m"), count.alias("blocks")).where("m > 1").select("root", "blocks"))
    first = spread_join(sets, sizes, "root", "sha").withColumn("part", F.pmod(F.xxhash64("sha"), F.col("blocks")).cast("long"))
    found = links_of(first)
    sets = _relabelled(sets, found)
    large = sizes.where("blocks > 1").select("root")
    sets = durable(sets)
    if not large.isEmpty():
        rows = spread_join(sets, large, "root", "sha")
        classes = rows.groupBy("root", "label").agg(F.count("*").alias("c"))
        most = durable(classes.groupBy("root").agg(F.max(F.struct("c", "label")).alias("most")).select("root", F.col("most.label").alias("main")))
        rows = spread_join(rows, most, "root", "sha").withColumn("pure", F.col("label") == F.col("main"))
        counts = rows.groupBy("root", "pure").agg(count.alias("blocks")).groupBy("root").agg(F.max(F.when(F.col("pure"), F.col("blocks"))).alias("pures"), F.max(F.when(~F.col("pure"), F.col("blocks"))).alias("mixed"))
        rows = spread_join(rows, durable(counts.where("mixed > 0")), "root", "sha")
        x = F.pmod(F.xxhash64("sha", F.lit(3)), F.when(F.col("pure"), F.col("pures")).otherwise(F.col("mixed")))
        rows = rows.withColumn("x", x.cast("long")).withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mixed").cast("long") - 1)))
        between = F.least("x", "y") * (1 << 31) + F.greatest("x", "y")
        across = F.lit(1 << 62) + F.col("y") * (1 << 31) + F.col("x")
        others = rows.where(~F.col("pure"))
        # a mixed block meets every mixed block, and every block of the largest class
        meet = others.where("y = 0").withColumn("z", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pures").cast("long") - 1)))
        meet = meet.withColumn("part", F.lit(1 << 62) + F.col("x") * (1 << 31) + F.col("z"))
        dealt = others.withColumn("part", between).select("part", *kept)
        dealt = dealt.unionByName(meet.select("part", *kept)).unionByName(rows.where("pure").withColumn("part", across).select("part", *kept))
        sets = _relabelled(sets, links_of(dealt))
    tops = sets.select(F.col("sha").alias("sha2"), F.col("label").alias("root"))
    return members.select("id", "sha").join(tops, F.col("sha") == F.col("sha2")).select("id", "sha", "root")


def _relabelled(sets: DataFrame, found: DataFrame) -> DataFrame:
    """``sets`` with each label replaced by the least of its component."""
    found = found.select("node", F.col("root").alias("top"))
    rows = spread_join(sets, found, "label", "sha", "node", "left")
    return rows.withColumn("label", F.coalesce("top", "label")).drop("node", "top")


def _one_of_each(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs``, of each class (``id, sha, root``) only the one with the least id (null last), then the least sha."""
    classes = durable(classes.groupBy("id", "sha").agg(F.min("root").alias("root"), F.count("*").alias("rows")))
    keep = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("keep"), F.sum("rows").alias("m")).where("m > 1")
    marked = spread_join(classes, durable(keep), "root", "sha")
    stays = F.col("id").eqNullSafe(F.col("keep.id")) & (F.col("sha") == F.col("keep.sha"))
    marked = durable(marked.select(F.col("id").alias("id2"), F.col("sha").alias("sha2"), stays.alias("stays"), (stays & (F.col("rows") > 1)).alias("again")).where("not stays or again"))
    return without(docs, marked, id_col, text_col)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, size: int = 3, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs``, one of each component (its least id, null last, then the least SHA-256), with their columns as they were.

    With ``similarity``, a link holds only if the texts' shingles of ``SHINGLE`` words have that Jaccard similarity or more.

    Rows go by id and text, so a null id, or one that stands on several texts, goes only where its own text is a near copy; of
    repeated rows (id and text alike) one stays, the one whose columns come first as JSON. Null text counts as empty, and an empty table gives an empty one.
    """
    p = durable(_keyed_prints(docs, id_col, text_col, size))
    classes = _classes(p, threshold) if similarity is None else _verified_classes(docs, p, text_col, ["fp"], threshold, threshold, similarity)
    return _one_of_each(docs, classes.select("id", "sha", "root"), id_col, text_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, threshold: int = NEAR, whole: int = WHOLE) -> DataFrame:
    """The rows of ``docs``, one of each component of near copies, as ``drop_near_duplicates`` chooses it.

    Candidates are texts of which one of the word prints differs in ``threshold`` bits or fewer and all of them in ``whole`` or
    fewer together; a link holds if the whole texts' shingles of ``SHINGLE`` words have that Jaccard similarity or more.
    """
    p = durable(_word_keyed(docs, id_col, text_col))
    prints = [f"fp{k}" for k in range(len(SEEDS))]
    return _one_of_each(docs, _verified_classes(docs, p, text_col, prints, threshold, whole, similarity), id_col, text_col)
