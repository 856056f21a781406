"""Every occurrence of every phrase at word boundaries.

Boundaries are single characters, so matches start exactly at the starts of tokens. A
ruleset of proven size becomes a trie of tokens that each Python worker builds once for its
digest and walks over Arrow batches, without a shuffle. A larger one is joined: tokens of all texts
meet the rules on up to four tokens, and only texts with a hit are looked at again.
Both ways give the same rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from anchorloom.functions.text import normalize_text
from anchorloom.runtime import Workspace, spread

# --- Fixed values: characters that end a word. Hyphen, slash, apostrophe, underscore,
# asterisk, angle brackets and dashes do not.
BOUNDARY = " \t\n\r\u00a0:.;,!?…()[]{}\"„“”«»"
_CLASS = r"[ \t\n\r\u00a0:.;,!?…()\[\]{}\"„“”«»]"

#: A ruleset is sent to every worker if it has at most so many phrases and characters.
MAX_SENT_PHRASES, MAX_SENT_CHARS = 200_000, 8_000_000
#: Tokens of a phrase that form the join key.
KEY_TOKENS = 4
_JOIN = "\x01"
_SPLIT = re.compile("([" + re.escape(BOUNDARY) + "])").split


def build_trie(phrases) -> dict:
    """Nested dicts over token, then separator and token; key None holds the phrase."""
    root: dict = {}
    for p in phrases:
        parts = _SPLIT(p)
        node = root.setdefault(parts[0], {})
        for i in range(1, len(parts), 2):
            node = node.setdefault(parts[i] + parts[i + 1], {})
        node[None] = p
    return root


def walk(trie: dict, norm: str) -> list[tuple[int, int, str]]:
    """(start, length, phrase) of all occurrences, in order of start, then length."""
    parts, out, at = _SPLIT(norm), [], 0
    n = len(parts)
    for i in range(0, n, 2):
        node, j = trie.get(parts[i]), i
        while node is not None:
            p = node.get(None)
            if p is not None:
                out.append((at, len(p), p))
            j += 2
            if j >= n:
                break
            node = node.get(parts[j - 1] + parts[j])
        at += len(parts[i]) + 1
    return out


#: The trie of the ruleset in use, in each Python worker, by the ruleset's digest.
_TRIES: dict[str, dict] = {}
#: Rulesets that were sent to the workers, by session and digest: a ruleset that comes again,
#: as with every micro-batch of a stream, is neither sent nor built again. The last ones only.
_SENT: dict[tuple[str, str], object] = {}
KEPT = 4


def _send(spark: SparkSession, phrases: list[str]) -> tuple[str, object]:
    """(digest, broadcast) of a sorted list of phrases."""
    digest = hashlib.sha256("\x00".join(phrases).encode()).hexdigest()
    key = (spark.sparkContext.applicationId, digest)
    if key not in _SENT:
        while len(_SENT) >= KEPT:
            _SENT.pop(next(iter(_SENT)))
        _SENT[key] = spark.sparkContext.broadcast(phrases)
    return digest, _SENT[key]


def _by_trie(base: DataFrame, keys: list[str], phrases: list[str]) -> DataFrame:
    digest, sent = _send(base.sparkSession, sorted(phrases))

    def trie() -> dict:
        if digest not in _TRIES:
            _TRIES.clear()
            _TRIES[digest] = build_trie(sent.value)
        return _TRIES[digest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, length, phrase = [], [], [], []
            t = trie()
            for i, text in enumerate(b.column(b.num_columns - 1).to_pylist()):
                for at, n, p in walk(t, text):
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    phrase.append(p)
            at = pa.array(row, pa.int64())
            kept = [b.column(i).take(at) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(start, pa.int32()), pa.array(length, pa.int32()), pa.array(phrase, pa.string())], names=[*b.schema.names[:-1], "start", "length", "phrase"])

    texts = base.select(*keys, "node_index", "norm").where(F.col("norm").isNotNull())
    head = StructType([f for f in texts.schema.fields if f.name != "norm"])
    return texts.mapInArrow(run, head.add("start", IntegerType()).add("length", IntegerType()).add("phrase", StringType()))


def _by_join(base: DataFrame, keys: list[str], phrases: DataFrame) -> DataFrame:
    tokens_of = F.split("phrase", _CLASS)
    r = phrases.select("phrase", F.array_join(F.slice(tokens_of, 1, KEY_TOKENS), _JOIN).alias("key"), F.size(tokens_of).alias("n"))
    grams = F.transform("tokens", lambda t, i: F.transform(F.sequence(F.lit(1), F.lit(KEY_TOKENS)), lambda k: F.when(i + k <= F.size("tokens"), F.array_join(F.slice("tokens", i + 1, k), _JOIN))))
    t = base.select(*keys, "node_index", F.split("norm", _CLASS).alias("tokens")).select(*keys, "node_index", F.posexplode(grams).alias("pos", "grams"))
    t = t.select(*keys, "node_index", "pos", F.explode("grams").alias("key")).where(F.col("key").isNotNull())
    hits = t.join(r, "key").select(*keys, "node_index", "pos", "phrase", "n")
    per_node = hits.groupBy(*keys, "node_index").agg(F.collect_list(F.struct("pos", "phrase", "n")).alias("hits"))
    d = base.join(per_node, [*keys, "node_index"]).withColumn("tokens", F.split("norm", _CLASS))
    # Equal tokens first; the place in the text is worked out for those only.
    d = d.withColumn("hits", F.filter("hits", lambda h: F.slice("tokens", h["pos"] + 1, h["n"]) == F.split(h["phrase"], _CLASS)))
    start = lambda h: F.when(h["pos"] == 0, F.lit(0)).otherwise(F.length(F.array_join(F.slice("tokens", F.lit(1), h["pos"]), " ")) + 1)
    one = d.select(*keys, "node_index", "norm", F.explode(F.transform("hits", lambda h: F.struct(start(h).alias("start"), F.length(h["phrase"]).alias("length"), h["phrase"].alias("phrase")))).alias("m"))
    one = one.select(*keys, "node_index", "norm", "m.start", "m.length", "m.phrase")
    return one.where(F.substring("norm", F.col("start") + 1, F.col("length")) == F.col("phrase")).drop("norm")


def scan(nodes: DataFrame, rules: DataFrame, keys: list[str] = ["doc_id"], max_phrases: int = MAX_SENT_PHRASES, max_chars: int = MAX_SENT_CHARS) -> DataFrame:  # noqa: B006
    """(*keys, node_index, start, length, phrase), nested and overlapping occurrences included.

    ``nodes`` has the keys, node_index and text; keys and node_index identify a row. ``rules``
    has phrase, normalized and unique. Offsets count code points from 0. Texts of fewer than
    two characters and null texts give nothing; very long texts are scanned whole.
    """
    base = spread(nodes.where(F.length("text") >= 2).select(*keys, "node_index", "text"), *keys).select(*keys, "node_index", normalize_text("text").alias("norm"))
    # Compiled once: counted, sent or joined from what is written.
    phrases = Workspace(base.sparkSession, "rules").write(rules.where(F.col("phrase") != "").select("phrase"), "phrases")
    size = phrases.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("phrase")), F.lit(0)).alias("chars")).first()
    if size["n"] <= max_phrases and size["chars"] <= max_chars:
        return _by_trie(base, keys, [r["phrase"] for r in phrases.collect()])
    return _by_join(base, keys, phrases)
