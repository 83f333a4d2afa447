"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, maps homoglyphs of other scripts to Latin letters, drops zero-width characters and undoes digit and sign
substitutions inside words. A lexicon entry is a word or the start of a word; its weight is a log odds, learned from a
labelled table over a seed list. Hits inside an exception phrase don't count. The sum of the weights is normalised by the
text's length, and two length-normalised figures give the score by a logistic curve with non-negative slopes.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.columns import crc32_hex_mod4, text_of
from ontomill.plans.rounds import durable
from ontomill.plans.ship import arrow_rows

# Characters that look like Latin letters, and signs that stand for letters inside words.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ⅼ": "l", "ℓ": "l",
}
INVISIBLE = "­​‌‍⁠﻿"
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
SEEDS = ("asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumbass", "filth", "idiot", "imbecile", "loser", "moron", "parasite", "pathetic", "retard", "scum", "stupid", "trash", "vermin", "worthless")
SEED_WEIGHT = 3.0
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bag", "idiot proof", "pathetic fallacy", "parasite host", "stupid question", "filth and dirt", "worthless check")

_TABLE = str.maketrans(HOMOGLYPHS | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | dict.fromkeys(INVISIBLE, ""))
_SIGNS = str.maketrans(SUBSTITUTES)
_SIGN = re.compile(r"[0134578@$!]")
_TOKEN = re.compile(r"[\w@$!]+")
_WORD = re.compile(r"[^\W\d_]+")
#: Letters of word starts that may become entries.
PREFIXES = (3, 4, 5, 6, 7)
#: Different surroundings that an entry needs, and toxic documents, at least and as a share of those labelled so.
VARIED, SUPPORT, SUPPORT_SHARE = 6, 4, 0.015
#: Entries of a partial count that are held before they are passed on.
HELD = 200_000


def _letters(m: re.Match) -> str:
    """A token with its substitutions undone, if a third of it are letters; closing signs are punctuation."""
    token = m[0]
    if not _SIGN.search(token):
        return token
    core = token.rstrip("@$!")
    letters = sum(map(str.isalpha, core))
    return core.translate(_SIGNS) + token[len(core) :] if letters >= 2 and letters * 3 >= len(core) else token


def fold(text: str) -> str:
    s = text.lower()
    if not s.isascii():
        s = s.translate(_TABLE)
    return _TOKEN.sub(_letters, s) if _SIGN.search(s) else s


def other_readings(text: str) -> str:
    """Tokens whose closing signs, or few letters, leave them as they are in ``fold``, with every substitution undone.

    ``dumba$$`` may be a word that ends in signs or a word in disguise; a lexicon is asked about both.
    """
    s = text.lower()
    if not s.isascii():
        s = s.translate(_TABLE)
    if not _SIGN.search(s):
        return ""
    out = []
    for token in _TOKEN.findall(s):
        if _SIGN.search(token) and any(map(str.isalpha, token)):
            whole = token.translate(_SIGNS)
            if whole != _TOKEN.sub(_letters, token) and whole.isalpha():
                out.append(whole)
    return " ".join(out)


def terms_of(word: str) -> list[str]:
    """Entries that could stand for a word: its starts, and the whole word marked with a closing ``$``."""
    out = [word[:k] for k in PREFIXES if len(word) > k]
    if len(word) >= 3:
        out.append(word + "$")
    return out


@dataclass(frozen=True)
class Lexicon:
    """Entries with weights, exception phrases, and the logistic curve: bias, slope of the damped sum, slope of the density."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 2.0, 1.0)

    def automaton(self) -> ahocorasick.Automaton:
        """Entries by surface form: (length, weight as a start of words or 0, weight as a whole word or 0)."""
        forms: dict[str, list[float]] = defaultdict(lambda: [0.0, 0.0])
        for term, w in self.weights.items():
            forms[term.rstrip("$")][term.endswith("$")] = w
        a = ahocorasick.Automaton()
        for form, (start, whole) in forms.items():
            a.add_word(form, (len(form), start, whole, False))
        for phrase in self.exceptions:
            if phrase not in forms:
                a.add_word(phrase, (len(phrase), 0.0, 0.0, True))
        a.make_automaton()
        return a


def features(text: str, automaton) -> tuple[float, float]:
    """The weights' sum damped by the logarithm of the number of words, and the logarithm of its density in per cent."""
    s = fold(text)
    if not s or not len(automaton):
        return 0.0, 0.0
    words = 1 + s.count(" ") + s.count("\n")
    if more := other_readings(text):
        s += "\n" + more
    best: dict[int, tuple[float, int]] = {}
    spared: list[tuple[int, int]] = []
    for end, (n, start_w, whole_w, exception) in automaton.iter(s):
        at = end - n + 1
        if at and s[at - 1].isalnum():
            continue
        closed = end + 1 == len(s) or not s[end + 1].isalnum()
        if exception:
            if closed:
                spared.append((at, end))
            continue
        w = max(start_w, whole_w if closed else 0.0)
        if w > best.get(at, (0.0, 0))[0]:
            best[at] = (w, end)
    total = sum(w for at, (w, end) in best.items() if not any(a <= at and end <= b for a, b in spared))
    if not total:
        return 0.0, 0.0
    return total / (1 + math.log1p(words)), math.log1p(100 * total / words)


def logistic(f: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(curve[0] + f @ np.array(curve[1:]), -30, 30)))


def fit_curve(f: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps; slopes are held at zero or above."""
    if not len(y) or y.min() == y.max():
        return Lexicon({}).curve
    x = np.column_stack([np.ones(len(y)), f])
    b, penalty = np.zeros(3), np.diag([1e-6, ridge, ridge]) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(3), x.T @ (y - p) - penalty @ b)
        b = b + step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        b[1:] = np.maximum(b[1:], 0)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(v), 6) for v in b)


def labelled_sample(labels: DataFrame, max_train: int, id_col: str = "doc_id", label_col: str = "toxic") -> tuple[DataFrame, int, int]:
    """``id, y`` of at most about ``max_train`` labelled ids, never those held out, and the numbers of both labels.

    Held out are ids whose CRC-32 as text modulo 4 is 2. A hash of the id picks the sample, so it doesn't depend on order.
    An id with several labels counts as toxic if one is; null ids and labels are left out.
    """
    y = labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & (crc32_hex_mod4(id_col) != 2))
    y = y.groupBy(F.col(f"`{id_col}`").alias("id")).agg(F.max((F.col(f"`{label_col}`") > 0).cast("int")).alias("y"))
    n = y.count()
    share = min(1.0, max_train / max(n, 1))
    picked = y.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    counts = dict(picked.groupBy("y").count().collect())
    return picked, counts.get(1, 0), counts.get(0, 0)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_train: int = 20_000, min_precision: float = 0.8) -> Lexicon:
    """A lexicon from labelled documents; the sample is bounded by ``max_train`` rows, and by it the candidate entries.

    An entry needs support in toxic documents, and in varied surroundings: the words before it must differ, so that the words
    of a copied passage don't count as evidence. Of entries of which one starts the other, the one with more support times
    log odds stands, and of equals the longer. Without labels the seeds stand alone.
    """
    sample, n_pos, n_neg = labelled_sample(labels, max_train, id_col)
    seeds = {f"{w}$": SEED_WEIGHT for w in SEEDS}
    if not n_pos or not n_neg:
        return Lexicon(seeds)
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")).join(F.broadcast(sample), "id").select("y", "t")
    texts = durable(texts)  # bounded by the sample, and read four times
    support = max(SUPPORT, round(SUPPORT_SHARE * n_pos))
    counted = arrow_rows(texts.where("y = 1").select("t"), _count_terms, "term string, n long, around long")
    pos = counted.groupBy("term").agg(F.sum("n").alias("n"), F.bit_or("around").alias("around")).where((F.col("n") >= support) & (F.bit_count("around") >= VARIED))
    pos = {r.term: r.n for r in pos.select("term", "n").collect()}
    wanted = frozenset(pos) | frozenset(seeds)
    neg = arrow_rows(texts.where("y = 0").select("t"), lambda it: _count_wanted(it, wanted), "term string, n long")
    neg = dict(neg.groupBy("term").agg(F.sum("n")).collect())
    odds = {t: math.log((pos.get(t, 0) + 0.5) / (n_pos + 1)) - math.log((neg.get(t, 0) + 0.5) / (n_neg + 1)) for t in wanted}
    precise = [t for t in pos if pos[t] >= min_precision * (pos[t] + neg.get(t, 0)) and odds[t] > 2]
    chosen: dict[str, float] = {}
    for t in sorted(precise, key=lambda t: (-pos[t] * odds[t], -len(t), t)):
        bare = t.rstrip("$")
        if not any(bare.startswith(c.rstrip("$")) and not c.endswith("$") or c.rstrip("$").startswith(bare) for c in chosen):
            chosen[t] = round(odds[t], 4)
    for t, w in seeds.items():
        if t not in pos and neg.get(t, 0) < 3 and not any(t.startswith(c.rstrip("$")) for c in chosen):
            chosen[t] = w
    model = Lexicon(chosen)
    rows = arrow_rows(texts, lambda it: _feature_rows(it, model), "y int, f1 double, f2 double").toPandas()
    return Lexicon(chosen, curve=fit_curve(rows[["f1", "f2"]].to_numpy(), rows["y"].to_numpy(float)))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each possible entry, and a bit map of the words before it."""
    held: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        got = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array(np.array([v[1] for v in held.values()], np.uint64).view(np.int64))], ["term", "n", "around"])
        held.clear()
        return got

    for batch in batches:
        for text in batch.column(0).to_pylist():
            around: dict[str, int] = defaultdict(int)
            before = ""
            for word in _WORD.findall(fold(text)):
                around[word] |= 1 << (sum(map(ord, before)) * 31 + len(before)) % 64
                before = word
            seen: dict[str, int] = defaultdict(int)
            for word, bits in around.items():
                for term in terms_of(word):
                    seen[term] |= bits
            for term, bits in seen.items():
                v = held.setdefault(term, [0, 0])
                v[0] += 1
                v[1] |= bits
            if len(held) > HELD:
                yield out()
    if held:
        yield out()


def _count_wanted(batches: Iterator[pa.RecordBatch], wanted: frozenset[str]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, int] = defaultdict(int)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for term in {t for word in set(_WORD.findall(fold(text))) for t in terms_of(word) if t in wanted}:
                counts[term] += 1
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])


def _feature_rows(batches: Iterator[pa.RecordBatch], model: Lexicon) -> Iterator[pa.RecordBatch]:
    automaton = model.automaton()
    for batch in batches:
        f = [features(t, automaton) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in f], pa.float64()), pa.array([x[1] for x in f], pa.float64())], ["y", "f1", "f2"])


def _scores(texts: list[str | None], automaton, curve: tuple[float, float, float]) -> np.ndarray:
    return logistic(np.array([features(t or "", automaton) for t in texts]).reshape(-1, 2), curve)


def score(docs: DataFrame, model: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row, score from 0 to 1; null counts as empty text; labels and other columns are not looked at."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(batch.column(1).to_pylist(), automaton, model.curve))], ["id", "score"])

    return arrow_rows(docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")), rows, f"id {kind}, score double")


def drop_toxic(docs: DataFrame, model: Lexicon, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows that score below ``threshold``, with their columns as they were."""
    at = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch.column(at).to_pylist(), automaton, model.curve) < threshold))

    return arrow_rows(docs, rows, docs.schema)
