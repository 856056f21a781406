"""Byte-level BPE as a tokenization automaton.

The automaton reads token labels. It starts as one state that loops on every byte and is
changed by one gadget per merge (u, v) -> w, in rank order: from every state that has a
path u, v a new arc w leads to where that path led, and the state after u loses its arc v.
A text then has exactly one accepted path, and the labels on it are its encoding. Because
what may follow depends only on the last label, states are kept in persistent form: a
state is its last token, the token whose state it was copied from (its right part) and
the rank at which the copy was made. An arc is looked up along these copies and then
kept in a table, so 50,000 gadgets compile in well under a second and the table holds
just the arcs that texts use.

Encoding runs each pre-split word through a byte trie of the arc labels and the arc table,
left to right, without any search through merges. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.runtime import spread

#: Where public vocabulary files are; a parameter of every function that reads one.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.json"
# --- Fixed value: the pre-split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept with their ids in each Python worker; beyond, the memory of words starts anew.
WORDS_KEPT = 500_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1
    characters stand for themselves, the other bytes for code points from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class TokenAutomaton:
    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]]):
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        ids = {raw(s): i for s, i in vocabulary.items() if all(c in symbols for c in s)}
        self.label: dict[int, bytes] = {i: b for b, i in ids.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.rank: dict[int, int] = {}
        self.cut: dict[int, int] = {}  # u << 20 | v -> rank of the gadget that removes arc v after u
        self.arcs: dict[int, bool] = {}
        live = [ids[bytes([b])] for b in range(256) if bytes([b]) in ids]
        for i in live:
            self.rank[i] = -1
        for k, (a, b) in enumerate(merges):
            u, v, w = ids[raw(a)], ids[raw(b)], ids[raw(a) + raw(b)]
            if u not in self.rank or v not in self.rank or self.cut.setdefault(u << 20 | v, k) != k:
                continue
            # The gadget finds a path u, v only if the automaton so far has it.
            if w not in self.rank and self._arc(u, v, k):
                self.rank[w], self.left[w], self.right[w] = k, u, v
                live.append(w)
        # Trie of the labels: (node << 8 | byte) -> node, and the token that ends at a node.
        self.step: dict[int, int] = {}
        self.ends: dict[int, int] = {}
        nodes = 1
        for i in live:
            node = 0
            for byte in self.label[i]:
                key = node << 8 | byte
                node = self.step.get(key, -1)
                if node < 0:
                    node = self.step[key] = nodes
                    nodes += 1
            self.ends[node] = i

    def _arc(self, a: int, b: int, version: int) -> bool:
        """Has the state after ``a`` an arc ``b`` once ``version`` gadgets are applied?"""
        rank, left, right, cut = self.rank, self.left, self.right, self.cut
        while True:
            ra, rb = rank[a], rank[b]
            k = cut.get(a << 20 | b, version)
            if max(ra, rb) < k < version or k < version and ra == rb == -1:
                return False
            if ra == rb == -1:
                return True
            if a == b:
                # After w the state is that after its right part; w begins with its left part.
                a, b, version = right[a], left[b], ra
            elif rb > ra:
                # Arc b was added where the path of its parts was. If both parts are a, the
                # pair before it was taken first: greedy from the left.
                if left[b] == right[b] == a:
                    return False
                b, version = left[b], rb
            else:
                a, version = right[a], ra

    def follows(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) > 4_000_000:
                self.arcs.clear()
            known = self.arcs[key] = self._arc(a, b, 1 << 30)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """The labels of the one accepted path over ``word``. Linear in its length."""
        n = len(word)
        last = [-1] * (n + 1)  # state after each prefix: its last token
        step, ends, follows = self.step, self.ends, self.follows
        for i in range(n):
            state = last[i]
            if i and state < 0:
                continue
            node = 0
            for j in range(i, n):
                node = step.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                token = ends.get(node, -1)
                if token >= 0 and last[j + 1] < 0 and (not i or follows(state, token)):
                    last[j + 1] = token
        out, i = [], n
        while i:
            token = last[i]
            out.append(token)
            i -= len(self.label[token])
        return out[::-1]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.label[i] for i in ids)


class Encoder:
    """Pre-split, then the automaton, with a bounded memory of words."""

    def __init__(self, automaton: TokenAutomaton, pattern: str = PATTERN):
        self.automaton, self.split, self.words = automaton, regex.compile(pattern).findall, {}

    def encode(self, text: str) -> list[int]:
        words, out = self.words, []
        for w in self.split(text):
            ids = words.get(w)
            if ids is None:
                ids = self.automaton.encode_word(w.encode("utf-8", "surrogatepass"))
                if len(w) <= 64:
                    if len(words) >= WORDS_KEPT:
                        words.clear()
                    words[w] = ids
            out += ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def load_encoder(path: str, data: bytes | None = None) -> Encoder:
    """The encoder of a vocabulary file, or of its content; compiled once in each Python worker."""
    if path not in _ENCODERS:
        model = json.loads(data if data is not None else Path(path).read_bytes())["model"]
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        _ENCODERS[path] = Encoder(TokenAutomaton(model["vocab"], merges))
    return _ENCODERS[path]


#: Vocabularies sent to the workers, by session and content.
_SENT: dict[tuple[str, str], object] = {}


def _ship(spark: SparkSession, path: str) -> tuple[str, object]:
    """(name, broadcast content) of a vocabulary file, which only the driver needs to have. Its
    size is that of a vocabulary, a few megabytes."""
    data = Path(path).read_bytes()
    key = (spark.sparkContext.applicationId, hashlib.sha256(data).hexdigest())
    if key not in _SENT:
        _SENT[key] = spark.sparkContext.broadcast(data)
    return key[1], _SENT[key]


def vocabulary_path(folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> str:
    return os.fspath(Path(folder, name))


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row, without special tokens; their strings are ordinary text.

    Null and empty texts have an empty array. Rows are kept one to one, also with null or
    repeated keys; other columns, whatever their names, are not read. Texts are encoded
    whole. Each task encodes its own rows in Arrow batches; only a table too small to have
    a task for each core is spread first.
    """
    name, sent = _ship(docs.sparkSession, path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load_encoder(name, sent.value).encode
        for batch in batches:
            flat: list[np.ndarray] = []
            offsets = np.zeros(batch.num_rows + 1, dtype=np.int32)
            for i, t in enumerate(batch.column(1)):
                t = t.as_py()
                ids = encode(t) if t else ()
                offsets[i + 1] = offsets[i] + len(ids)
                flat.append(np.asarray(ids, dtype=np.int32))
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["k", "ids"])

    kind = dict(docs.dtypes)[key]
    out = spread(docs.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.select(F.col("k").alias(key), "ids")


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text): the labels of the ids. An empty array gives the empty text, null stays null."""
    name, sent = _ship(encoded.sparkSession, path or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = load_encoder(name, sent.value).automaton.decode
        for batch in batches:
            texts = [None if ids is None else decode(ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = dict(encoded.dtypes)[key]
    out = encoded.select(F.col(key).alias("k"), "ids").mapInArrow(run, f"k {kind}, text string")
    return out.select(F.col("k").alias(key), "text")
