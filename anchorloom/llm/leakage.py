"""Evaluation passages in training text, through a positional inverted index.

The corpus' count of every test term is taken first. Of each window of consecutive item
words the rarest terms are its anchors, for proximity so many that enough of them are left
when all words that may differ are anchors. Only anchors have postings: one row per
occurrence in the corpus with document and position. Shifted by the anchor's own
position in the item, postings of one passage meet on one diagonal (document, item,
document position minus item position); a window whose anchors meet there is a candidate
and is compared word for word with the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from anchorloom.operators.skew import lookup
from anchorloom.runtime import Workspace, spread

#: Consecutive words that make a passage.
PASSAGE = 12
#: Rarest terms of a window that have postings for exact phrases, and how many must meet for a proximity candidate.
ANCHORS, MEET = 3, 2
#: Equal words of a window, at equal distances, that make a proximity match.
NEAR = 9
#: The anchors of all items are sent to the workers if they are at most so many, with at most so
#: many characters together; more are joined.
MAX_SPOTS, MAX_SPOT_CHARS = 500_000, 5_000_000


def words(text: Column | str) -> Column:
    """Runs of letters and digits in lower case; null gives null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def item_words(items: DataFrame, passage: int = PASSAGE) -> DataFrame:
    """(item_id, item_words) of items with at least ``passage`` words. Shorter and null ones cannot leak."""
    one = items.where(F.col("item_id").isNotNull()).select("item_id", words("item_text").alias("item_words"))
    return one.where(F.size("item_words") >= passage).distinct()


def term_counts(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): occurrences of each test term in the whole corpus, combined on the map side."""
    tokens = docs.select(F.explode(words(text)).alias("term"))
    return tokens.join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def _met_by_join(work: Workspace, docs: DataFrame, spots: DataFrame, windows: DataFrame, meet: int) -> DataFrame:
    """Postings as rows that join the items' spots by term, then the windows of their item."""
    rows = docs.select("doc_id", F.posexplode(words("text")).alias("pos", "term"))
    met = rows.join(spots, "term").groupBy("doc_id", "item_id", (F.col("pos") - F.col("p")).alias("diagonal")).agg(F.collect_set("p").alias("ps"))
    by_item = windows.groupBy("item_id").agg(F.collect_list(F.struct("start", "positions")).alias("windows"))
    met = lookup(work.write(met.where(F.size("ps") >= meet), "met"), by_item, ["item_id"], spread="doc_id")
    anchored = F.filter("windows", lambda w: F.size(F.array_intersect(w["positions"], F.col("ps"))) >= meet)
    return met.select("doc_id", "item_id", "diagonal", F.transform(anchored, lambda w: w["start"]).alias("starts")).where(F.size("starts") > 0)


def _met_by_shard(work: Workspace, docs: DataFrame, spots: list, windows: list, meet: int) -> DataFrame:
    """An index parted by documents: the postings of a document are one row, stored, and its
    lists are intersected where they are, so that no posting is shuffled."""
    terms = sorted({r["term"] for r in spots})
    code = {t: i for i, t in enumerate(terms)}
    order = np.array(sorted((code[r["term"]], r["item_id"], r["p"]) for r in spots), dtype=np.int64).reshape(-1, 3)
    n_of = np.bincount(order[:, 0], minlength=len(terms))
    first = np.cumsum(n_of) - n_of
    known = pa.array(terms, pa.string())
    # The windows that an item position is an anchor of.
    anchors = np.array(sorted((r["item_id"], p, r["start"]) for r in windows for p in r["positions"]), dtype=np.int64).reshape(-1, 3)
    far = int(anchors[:, 1:].max()) + 1 if len(anchors) else 1
    items, item_code = np.unique(anchors[:, 0], return_inverse=True)
    place, w_first, w_n = np.unique(item_code * far + anchors[:, 1], return_index=True, return_counts=True)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            at = pc.index_in(pc.list_flatten(lists), value_set=known)
            hit = _np(pc.is_valid(at))
            row = _np(pc.list_parent_indices(lists))
            start = np.searchsorted(row, np.arange(b.num_rows))
            pos = (np.arange(len(row)) - start[row])[hit] if len(row) else row
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=b.num_rows))]).astype(np.int32)
            flat = [at.filter(pa.array(hit)).cast(pa.int32()), pa.array(pos, pa.int32())]
            out = pa.RecordBatch.from_arrays([b.column(0), *[pa.ListArray.from_arrays(pa.array(ends), x) for x in flat]], names=["doc_id", "terms", "places"])
            yield out.filter(pa.array(np.diff(ends) > 0))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = _np(pc.list_parent_indices(b.column(1)))
            term, pos = _np(pc.list_flatten(b.column(1))), _np(pc.list_flatten(b.column(2)))
            # Each posting once for every spot of its term in the items.
            times = n_of[term]
            of = np.repeat(np.arange(len(term)), times)
            spot = order[first[term[of]] + np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)]
            met = np.column_stack([row[of], spot[:, 1], pos[of] - spot[:, 2], spot[:, 2]]).astype(np.int64)
            met = met[np.lexsort(met.T[::-1])]
            new = np.ones(len(met), bool)
            new[1:] = (met[1:] != met[:-1]).any(1)
            met = met[new]
            new = np.ones(len(met), bool)
            new[1:] = (met[1:, :3] != met[:-1, :3]).any(1)
            begin = np.flatnonzero(new)
            size = np.diff(np.append(begin, len(met)))
            keep = size >= meet
            head, met = met[begin[keep]], met[np.repeat(keep, size)]
            which = np.repeat(np.arange(len(head)), size[keep])
            # Of each meeting the windows of which enough anchors are there.
            at = np.searchsorted(place, np.searchsorted(items, met[:, 1]) * far + met[:, 3])
            n = w_n[at]
            each = np.repeat(np.arange(len(met)), n)
            start = anchors[w_first[at[each]] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n), 2]
            found, anchored = np.unique(which[each] * far + start, return_counts=True)
            found = found[anchored >= meet]
            n = np.bincount(found // far, minlength=len(head))
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            out = pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(head[:, 0])), pa.array(head[:, 1]), pa.array(head[:, 2], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(found % far, pa.int32()))],
                names=["doc_id", "item_id", "diagonal", "starts"],
            )
            yield out.filter(pa.array(n > 0))

    cut = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), words("text").alias("words"))
    stored = work.write(cut.mapInArrow(index, "doc_id bigint, terms array<int>, places array<int>"), "postings")
    return stored.mapInArrow(intersect, "doc_id bigint, item_id bigint, diagonal int, starts array<int>")


def _np(a) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def meetings(work: Workspace, docs: DataFrame, spots: DataFrame, windows: DataFrame, meet: int, max_spots: int = MAX_SPOTS, max_chars: int = MAX_SPOT_CHARS) -> DataFrame:
    """(doc_id, item_id, diagonal, starts): windows of which at least ``meet`` anchors stand in a
    document at their distances in the item. Spots of proven small size are sent to the
    workers, with their windows, at most PASSAGE to a spot; more are joined as rows. Both
    ways give the same meetings."""
    size = spots.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("chars")).first()
    if size["n"] <= max_spots and size["chars"] <= max_chars:
        return _met_by_shard(work, docs, spots.collect(), windows.collect(), meet)
    return _met_by_join(work, docs, spots, windows, meet)


def window_anchors(items: DataFrame, counts: DataFrame, passage: int = PASSAGE, anchors: int = ANCHORS) -> DataFrame:
    """(item_id, start, positions): the positions of the rarest terms of each window; ties
    go to the earlier position. A term the corpus lacks has count 0, and such a window
    cannot be anywhere as a whole."""
    placed = items.select("item_id", F.posexplode("item_words").alias("p", "term")).join(counts, "term", "left").select("item_id", "p", F.coalesce("n", F.lit(0)).alias("n"))
    by_item = Window.partitionBy("item_id").orderBy("p").rowsBetween(0, passage - 1)
    windows = placed.withColumn("w", F.collect_list(F.struct("n", "p")).over(by_item)).where(F.size("w") == passage)
    rarest = F.slice(F.array_sort("w"), 1, anchors)
    return windows.select("item_id", F.col("p").alias("start"), F.transform(rarest, lambda s: s["p"]).alias("positions"))


def passage_matches(spark: SparkSession, docs: DataFrame, items: DataFrame, passage: int = PASSAGE, near: int = NEAR, max_spots: int = MAX_SPOTS) -> DataFrame:
    """(doc_id, item_id, best_words): the most equal words of any window of ``passage``
    item words on one diagonal of the document, if at least ``near``; ``passage`` means an
    exact phrase. Exact phrases are found without exception: all their anchors meet.
    So are proximity matches: of ``passage - near + MEET`` anchors at least MEET meet, whichever words differ.

    ``docs`` has doc_id and text, ``items`` item_id and item_text. Null, empty and short
    texts match nothing; repeated rows give one row; rows with a null id are left out.
    Texts are read whole. Common terms are counted, not stored. Items are joined as a
    table, broadcast only where Spark measures them to be small; candidates of an item
    that leaks everywhere are spread by a salt, and a text is read once for all its candidates.
    """
    work = Workspace(spark, "leakage")
    base = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    its = work.write(item_words(items, passage), "items")
    terms = its.select(F.explode("item_words").alias("term")).distinct()
    counts = work.write(term_counts(base, terms), "counts")
    # All anchors of an exact phrase meet; for proximity passage - near of them may be missing.
    meet = ANCHORS if near >= passage else min(MEET, near)
    anchors = ANCHORS if near >= passage else passage - near + meet
    windows = work.write(window_anchors(its, counts, passage, anchors), "windows")
    # Where an anchor stands in the items: few rows, each with the term and its item position.
    used = windows.select("item_id", F.explode("positions").alias("p")).distinct()
    spots = used.join(its.select("item_id", F.posexplode("item_words").alias("p", "term")), ["item_id", "p"])
    spots = work.write(spots.select("term", "item_id", "p"), "spots")
    cands = work.write(meetings(work, base, spots, windows, meet, max_spots), "candidates")
    for t in (counts, windows, spots):
        work.drop(t)
    # The exact comparison reads only documents that have a candidate, each once: its
    # candidates, no more than its own postings, travel to the text with the item's words.
    with_words = lookup(cands, its, ["item_id"], spread="doc_id")
    per_doc = with_words.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonal", "starts", "item_words")).alias("cands"))
    # Repeated rows of a document bring the same words: one of them is compared.
    texts = base.join(per_doc, "doc_id").select("doc_id", words("text").alias("doc_words"), "cands")
    # One comparison per item position on the diagonal, then a sum per window.
    equal = lambda c: F.transform(c["item_words"], lambda w, i: F.when((i + c["diagonal"] >= 0) & (F.get("doc_words", i + c["diagonal"]) == w), 1).otherwise(0))
    windowed = lambda c, e: F.array_max(F.transform(c["starts"], lambda s: F.aggregate(F.slice(e, s + 1, F.lit(passage)), F.lit(0), lambda a, x: a + x)))
    # As an element of an array the comparison is made once, not once per window.
    best = lambda c: F.struct(c["item_id"].alias("item_id"), F.transform(F.array(equal(c)), lambda e: windowed(c, e))[0].alias("best"))
    scored = texts.select("doc_id", F.explode(F.transform("cands", best)).alias("b")).select("doc_id", "b.item_id", "b.best")
    return scored.where(F.col("best") >= near).groupBy("doc_id", "item_id").agg(F.max("best").alias("best_words"))
