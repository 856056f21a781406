"""Which of the overlapping occurrences become links, under the limits of a document."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents with more candidates go through an Arrow function with sorted spans; the
#: expression compares each candidate with all claimed spans.
MANY = 200

_CAND = "struct<rank:int,priority:int,node_index:int,start:int,length:int,phrase:string,url:string,type:string,own_priority:int,entry_id:bigint>"
_SPAN = "struct<node_index:int,start:int,stop:int>"


def _expression(cands, per_destination: int, total: int):
    empty = F.struct(F.from_json(F.lit("[]"), f"array<{_SPAN}>").alias("claimed"), F.from_json(F.lit("[]"), f"array<{_CAND}>").alias("accepted"))

    def step(acc, c):
        stop = c["start"] + c["length"]
        free = ~F.exists(acc["claimed"], lambda s: (s["node_index"] == c["node_index"]) & (s["start"] < stop) & (s["stop"] > c["start"]))
        allowed = F.lit(True)
        if total:
            allowed = allowed & (F.size(acc["accepted"]) < total)
        if per_destination:
            allowed = allowed & (F.size(F.filter(acc["accepted"], lambda a: a["url"] == c["url"])) < per_destination)
        span = F.struct(c["node_index"].alias("node_index"), c["start"].alias("start"), stop.alias("stop"))
        # A winner that a limit refuses still claims its span.
        return F.struct(
            F.when(free, F.concat(acc["claimed"], F.array(span))).otherwise(acc["claimed"]).alias("claimed"),
            F.when(free & allowed, F.concat(acc["accepted"], F.array(c))).otherwise(acc["accepted"]).alias("accepted"),
        )

    return F.aggregate(cands, empty, step, lambda acc: acc["accepted"])


def greedy(cands: list[dict], per_destination: int, total: int) -> list[dict]:
    """The same on one document's sorted candidates, in n log n."""
    claimed: dict[int, list[tuple[int, int]]] = {}
    counts: dict[str, int] = {}
    out = []
    for c in cands:
        spans = claimed.setdefault(c["node_index"], [])
        start, stop = c["start"], c["start"] + c["length"]
        i = bisect_right(spans, (start, stop))
        if i and spans[i - 1][1] > start or i < len(spans) and spans[i][0] < stop:
            continue
        spans.insert(i, (start, stop))
        if total and len(out) >= total or per_destination and counts.get(c["url"], 0) >= per_destination:
            continue
        counts[c["url"]] = counts.get(c["url"], 0) + 1
        out.append(c)
    return out


def resolve(candidates: DataFrame, rules: DataFrame, keys: list[str] = ["doc_id"], per_destination: int = 1, total: int = 0) -> DataFrame:  # noqa: B006
    """(*keys, node_index, start, length, phrase, url, type, priority, entry_id) of accepted links.

    ``candidates`` are the rows of ``scan``, ``rules`` compiled ones. Longer first, then lower
    priority, then document order; a candidate that overlaps a claimed span of its node is
    skipped; a winner claims its span even if a limit (0: none) refuses it. The total limit
    and the limit per url hold per document. The group of a document is as large as its
    text at most.
    """
    r = rules.select("phrase", "url", "type", F.col("priority").alias("own_priority"), "entry_id")
    full = candidates.join(r, "phrase")
    whole = lambda c: F.col(c).cast("int").alias(c)
    cand = F.struct((-F.col("length")).cast("int").alias("rank"), F.coalesce("own_priority", F.lit(0)).alias("priority"), whole("node_index"), whole("start"), whole("length"), "phrase", "url", "type", "own_priority", "entry_id")
    docs = full.groupBy(*keys).agg(F.array_sort(F.collect_list(cand)).alias("cands"))

    @F.pandas_udf(f"array<{_CAND}>")
    def arrow(lists: pd.Series) -> pd.Series:
        return lists.map(lambda cs: None if cs is None else greedy(list(cs), per_destination, total))

    few = F.size("cands") <= MANY
    accepted = F.when(few, _expression(F.col("cands"), per_destination, total)).otherwise(arrow(F.when(~few, F.col("cands"))))
    one = docs.select(*keys, F.explode(accepted).alias("a"))
    return one.select(*keys, "a.node_index", "a.start", "a.length", "a.phrase", "a.url", "a.type", F.col("a.own_priority").alias("priority"), "a.entry_id")
