"""Waves of posts to process again after phrases changed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.filters import linkable
from anchorloom.functions.text import ascii_strip, raw_spellings
from anchorloom.runtime import spread
from anchorloom.settings import Settings

LEAST_LENGTH = 3
#: Characters of the spellings that one automaton holds; more go through several, one after the other.
SLICE_CHARS = 8_000_000


def wave_phrases(phrases: DataFrame) -> DataFrame:
    """(phrase): stripped, at least three characters, once each, however many."""
    return phrases.select(ascii_strip("phrase").alias("phrase")).where(F.length("phrase") >= LEAST_LENGTH).distinct()


def all_phrases(terms: DataFrame) -> DataFrame:
    """(phrase) of a wave over everything that can link."""
    return wave_phrases(terms.where(linkable()).select(F.col("normalized_phrase").alias("phrase")))


#: The automaton in use, in each Python worker.
_AUTOMATA: dict[str, object] = {}


def _finder(mark: str, spellings: list[str]):
    """A function that tells whether a text holds any spelling, in one pass over it."""
    if mark not in _AUTOMATA:
        _AUTOMATA.clear()
        try:
            import ahocorasick

            known = ahocorasick.Automaton()
            for s in spellings:
                known.add_word(s, True)
            known.make_automaton()
            _AUTOMATA[mark] = lambda text: next(known.iter(text), None) is not None
        except ImportError:
            _AUTOMATA[mark] = lambda text: any(s in text for s in spellings)
    return _AUTOMATA[mark]


def candidates(posts: DataFrame, phrases: DataFrame, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """Posts that are not deleted and whose raw text holds a phrase, letter case ignored, in any
    spelling. ``phrases`` are those of ``wave_phrases``.

    All spellings together are an automaton, so a text is read once whatever their number.
    It is sent to the workers; where the spellings have more than ``slice_chars``
    characters (counted first), they are cut into slices of about that size, and texts
    without a hit go on to the next one. Posts without a text hold nothing.
    """
    live = posts.where(F.col("deleted_at").isNull() & F.col("raw").isNotNull())
    spellings = phrases.select(F.explode(raw_spellings("phrase")).alias("s")).select(F.lower("s").alias("s")).where(F.col("s") != "").distinct()
    chars = spellings.agg(F.sum(F.length("s")).alias("n")).first()["n"]
    if not chars:
        return live.where(F.lit(False))
    slices = -(-chars // slice_chars)
    marked = spread(live).select("*", F.lower("raw").alias("__text"), F.lit(False).alias("__hit"))
    for k in range(slices):
        own = spellings.where(F.pmod(F.xxhash64("s"), F.lit(slices)) == k) if slices > 1 else spellings
        marked = _mark(marked, sorted(r["s"] for r in own.collect()))
    return marked.where("__hit").drop("__text", "__hit")


def _mark(texts: DataFrame, spellings: list[str]) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(spellings)
    mark = str(hash(tuple(spellings)))
    at_text, at_hit = texts.columns.index("__text"), texts.columns.index("__hit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _finder(mark, sent.value)
            hit = [h or found(t) for t, h in zip(b.column(at_text).to_pylist(), b.column(at_hit).to_pylist(), strict=True)]
            yield b.set_column(at_hit, "__hit", pa.array(hit, pa.bool_()))

    return texts.mapInArrow(run, texts.schema)


def batch(posts: DataFrame, phrases: DataFrame, after_id: int = 0, budget: int = 200) -> DataFrame:
    """(id): the next posts after ``after_id``, by id."""
    return candidates(posts.where(F.col("id") > after_id), phrases).select("id").orderBy("id").limit(budget)


@dataclass
class Wave:
    """Driver-side state of a wave: bounded batches until one is short or the cap is reached."""

    settings: Settings
    max_posts: int = 0
    after_id: int = 0
    done: bool = False

    @property
    def budget(self) -> int:
        per_job = self.settings.max_rebakes_per_job_run
        return min(per_job, self.max_posts) if self.max_posts > 0 else per_job

    def advance(self, ids: list[int]) -> None:
        if len(ids) < self.budget:
            self.done = True
            return
        self.after_id = ids[-1]
        if self.max_posts > 0:
            self.max_posts -= len(ids)
            self.done = self.max_posts <= 0


def gate(changes: DataFrame, settings: Settings) -> DataFrame:
    """(n_phrases, decision): none, skip (more than the setting allows) or one job."""
    g = changes.agg(F.countDistinct("phrase").alias("n_phrases"))
    return g.withColumn("decision", F.when(F.col("n_phrases") == 0, "none").when(F.col("n_phrases") > settings.auto_rebake_max_phrases, "skip").otherwise("rebake"))
