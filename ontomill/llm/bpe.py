"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The leaves of the tree hold ``(rank, place)`` of each pair of neighbouring symbols, or infinity where the pair doesn't merge;
an inner node holds the least below it. So the root is the leftmost pair of lowest rank. A merge changes three leaves at most,
each at the cost of the tree's height, and encoding a word ends when the root is infinity.

Words are found as the tokenizer's file says: NFC, lower case, letters, single digits and runs of other signs; white space is
dropped. Each word's bytes become the vocabulary's byte characters, the last of them with the end-of-word suffix.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontomill.llm.columns import text_of
from ontomill.plans.ship import arrow_rows, ship

#: White space as the tokenizer's regular expressions see it; Python's own also has U+001C to U+001F.
SPACE = "\t\n\v\f\r \x85\xa0                　"
_SPACE = regex.compile(f"[{SPACE}]+")
_ODD = "\x1c\x1d\x1e\x1f"
NEVER = 1 << 62
#: Words, and texts between white space, that a worker remembers, each in two generations of this many.
REMEMBERED = 200_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it is a visible Latin-1 sign, else the next from U+0100."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Bpe:
    """A word-level BPE tokenizer read from the text of its JSON file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab = model["vocab"]
        self.pieces = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ", 1)
            self.ranks.setdefault(vocab[a] << 20 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        chars = byte_characters()
        self.byte_ids = [vocab[c] for c in chars]
        self.last_ids = [vocab[c + self.suffix] for c in chars]
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE))
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.forget()

    def forget(self) -> None:
        """Drops the words remembered; done at the end of a task, as a worker process outlives it."""
        self.new: dict[str, tuple] = {}
        self.old: dict[str, tuple] = {}
        self.new_words: dict[str, tuple[int, ...]] = {}
        self.old_words: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def _set(tree: list[int], at: int, value: int) -> None:
        """Sets a leaf and the least values above it, as far up as they change."""
        if tree[at] == value:
            return
        tree[at] = value
        while at > 1:
            other = tree[at ^ 1]
            at >>= 1
            if other < value:
                value = other
            if tree[at] == value:
                return
            tree[at] = value

    def merge(self, symbols: list[int]) -> list[int]:
        """The symbols after all merges, by the segment tree."""
        n = len(symbols)
        if n < 2:
            return symbols
        ranks, merged = self.ranks, self.merged
        size = 1 << max(n - 2, 0).bit_length()
        tree = [NEVER] * (2 * size)
        for i in range(n - 1):
            r = ranks.get(symbols[i] << 20 | symbols[i + 1])
            if r is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := tree[1]) != NEVER:
            i = top & 0xFFFFFFFF
            j = after[i]
            new = symbols[i] = merged[top >> 32]
            symbols[j] = -1
            k = after[i] = after[j]
            h = before[i]
            own = left = None
            if k < n:
                before[k] = i
                own = ranks.get(new << 20 | symbols[k])
            if h >= 0:
                left = ranks.get(symbols[h] << 20 | new)
                self._set(tree, size + h, NEVER if left is None else left << 32 | h)
            if j < n - 1:
                self._set(tree, size + j, NEVER)
            self._set(tree, size + i, NEVER if own is None else own << 32 | i)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        ids = [self.byte_ids[b] for b in data]
        ids[-1] = self.last_ids[data[-1]]
        return self.merge(ids)

    def _chunk(self, chunk: str) -> tuple[str, int, str]:
        """Of a text without white space: its ids as text, their number and the decoded text."""
        ids = [i for w in self.words.findall(chunk) for i in self.new_words.get(w) or self._remember_word(w)]
        return " ".join(map(str, ids)), len(ids), self.decode(ids)

    def _remember_word(self, word: str) -> tuple[int, ...]:
        got = self.old_words.get(word) or tuple(self.word(word))
        if len(word) <= 64:
            if len(self.new_words) >= REMEMBERED:
                self.old_words, self.new_words = self.new_words, {}
            self.new_words[word] = got
        return got

    def _parts(self, text: str) -> list[tuple[str, int, str]]:
        """The same for each chunk of a text without special tokens; every chunk has a token at least."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # letter by letter: a final sigma is no special case
        text = text.replace("Σ", "σ").lower()
        chunks = list(filter(None, _SPACE.split(text))) if any(c in text for c in _ODD) else text.split()
        known = self.new.get
        return [known(c) or self._remember(c) for c in chunks]

    def _remember(self, chunk: str) -> tuple[str, int, str]:
        got = self.old.get(chunk) or self._chunk(chunk)
        if len(chunk) <= 64:
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[chunk] = got
        return got

    def parts(self, text: str) -> list[tuple[str, int, str]]:
        if not any(t in text for t in self.special):
            return self._parts(text)
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += self._parts(text[at : m.start()])
            out.append((str(self.special[m[0]]), 1, m[0]))
            at = m.end()
        return out + self._parts(text[at:])

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _, _ in self.parts(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The pieces joined by spaces, suffixes and special tokens kept: the file names no decoder."""
        return " ".join([self.pieces[i] for i in ids if i in self.pieces])


_READY: dict[int, Bpe] = {}


def _tokenizer(shared) -> Bpe:
    """One tokenizer for each worker process and broadcast file."""
    if shared.id not in _READY:
        _READY.clear()
        _READY[shared.id] = Bpe(shared.value)
    return _READY[shared.id]


class Shared:
    """The tokenizer's file, broadcast (a fixed size of one or two megabytes); workers need no path of their own."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self.id, self.file = path, spark.sparkContext.broadcast(f.read())

    @property
    def value(self) -> str:
        return self.file.value


def digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` of every row's whole text; null counts as empty, which has no tokens."""
    kind = docs.schema[id_col].dataType.simpleString()
    shared = Shared(docs.sparkSession, tokenizer_path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _tokenizer(shared)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                parts = bpe.parts(text)
                n.append(sum([p[1] for p in parts]))
                ids.append(hashlib.sha256(" ".join([p[0] for p in parts]).encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join([p[2] for p in parts]).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        bpe.forget()

    return arrow_rows(docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("t")), rows, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(docs: DataFrame, tokenizer_path: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids; a column of that name is replaced."""
    shared = Shared(docs.sparkSession, tokenizer_path)

    def ids(texts: pd.Series) -> pd.Series:
        bpe = _tokenizer(shared)
        return texts.map(bpe.encode)

    ship(docs.sparkSession)
    return docs.withColumn(out, F.pandas_udf(ids, "array<int>", F.PandasUDFType.SCALAR)(text_of(text_col)))
