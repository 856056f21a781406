"""Keyword-stuffed and link-list pages: robust Mahalanobis distance per language.

A document is cut into windows of sentences and lines. Each window has five features: density
of links and separators, lack of entropy, repetition of the document's own keywords, lack of
function words, and code. Centre and scatter of a language come from all its windows: medians
and absolute deviations first, then mean and covariance of the windows near that centre. A
window is spam if its squared distance is beyond the cutoff and its deviation lies in the
directions of spam: fewer function words together with more density, repetition or sameness.
A document is a stuffed page if more than half of its text is in such windows.

The features of a batch are worked out with Arrow kernels and numpy, never row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.runtime import Workspace, spread

# --- Fixed values: frequent function words by language. Words that shops put beside
# keywords (for, near, me, en, pas, de, à) are not among them.
FUNCTION_WORDS = {
    "en": "the a an and is are was were be been it its this that these those i you he she we they my your his her our their of to in on at with from by as or but not no if when where which who what how there has have had do does did would could should will can may so than then because although though until unless after before while only just nobody somebody anyone all about into over them him us through one first less more some any very own same such against between during without within rather indeed perhaps almost somehow also even still quite yet again never always often however",
    "de": "der die das und ist ich nicht den dem des ein eine einen einem einer mit auf bei von zu zum zur im am es sie er wir ihr sich wie so ob als auch wer was noch nur aber oder wenn weil dass kann hat habe war sind wird wurde nach vor bis aus hier schon keiner deshalb außerdem jemand man laut würde",
    "fr": "le la les un une et est il elle je tu nous vous que qui ne du des dans sur au aux ce cette ces se sa son ses mon ma mes avec par ou mais si comme on y été était ont ai quelqu quelque sans plus cela j l c qu n puis donc alors ainsi",
    "es": "el la los las un una y es no que se lo por su sus mi mis como pero o si ya muy hay sin desde hasta esta este del al con más alguien fue ha han según yo sigo",
    "pl": "i nie się jest na w z do że to po o od jak czy przez przed ze już tak co nic ktoś bez teraz wszystko za dla ale nadal był było mi",
    "ru": "и в на не что с по как это к у из за от до для о же бы но а ли я мы вы он она его очень или то так при под все всё если кто теперь пока каждый после вчера ту мне",
}
#: Kana that stand for particles and endings, which Japanese keyword lists lack.
JA_ENDINGS = r"です|ます|ました|ません|でした|ています|ている|ください|たい|から|ので|のに|けど|には|では|[をがはにへで][\p{L}\p{N}]"

FEATURES = ("f_dense", "f_flat", "f_repeat", "f_bare", "f_code")
#: Squared distance beyond which a window is an outlier: the 0.95 quantile of chi-square with 5
#: degrees of freedom. The cone of spam's directions holds few of the windows beyond it.
CUTOFF = 11.07
#: Least deviation, in robust standard deviations, of both sides of a direction of spam, and the
#: deviation from which a window is code.
TOWARDS, CODE = 2.1, 2.5
#: Least standard deviations, so that a feature that is constant in most windows keeps a scale.
FLOORS = (0.08, 0.05, 0.06, 0.08, 0.08)
#: Windows within this squared distance of the first centre give the estimates: the 0.99 quantile of chi-square.
NEAR = 15.086
#: Weight of a language's own estimates is n / (n + PRIOR) of its n windows, the rest is that of all windows.
PRIOR = 500
#: Weight of the identity in the correlations, which keeps them positive definite.
SHRINK = 0.3
#: Most and fewest words of a window. Longer segments are cut evenly, shorter neighbours joined.
MOST, LEAST = 50, 12
#: Characters that count as one word of a window where there are fewer words, as in links.
LETTERS = 8
#: Share of the text that must be stuffing, and the fewest words that can be a page rather than a remark.
SHARE, LEAST_WORDS = 0.5, 20
#: Letters of Japanese that count as one word, and letters of prose to one particle or ending.
JA_WORD, JA_LETTERS = 2, 5
#: Bins of a feature between 0 and 1 for medians and deviations.
BINS = 400

_CODES = [*FUNCTION_WORDS, "ja", "xx"]
_K = len(FEATURES)
_LINK = r"https?://\S+|www\.\S+|<a\s[^>]*>|</a>|\]\([^)\s]*\)|\[url[^\]]*\]|#[\p{L}\p{N}_]+|^\s*\p{L}+(?: \p{L}+)?:(?:\s|$)"
_SEPARATOR = r"[|>•·»,;、]"
_CODE = r"[={}\\$@]|\)\s*[:;{]|\w\([^)]*\)|[;:]\s*$"
_KANA, _CYRILLIC, _CJK = r"[ぁ-ヿ]", r"\p{Cyrillic}", r"[ぁ-ヿ々\p{Han}]"
#: Ends of sentences, where a line break is put. Before a small letter only after a word of three
#: letters, as after shorter ones the stop is mostly that of an abbreviation.
_ENDS = [(r"([.!?…]['\")\]]?)[ \t\r]+([\p{Lu}¿¡\"'(\[\p{N}#<])", r"\1" "\n" r"\2"), (r"(\p{L}{3}[.!?…])[ \t\r]+", r"\1" "\n"), (r"([。！？])", r"\1" "\n")]

WINDOWS = "doc_id bigint, language string, n_words int, windows array<struct<size:float," + ",".join(f"{f}:float" for f in FEATURES) + ">>"


@cache
def _word_sets() -> list[pa.Array]:
    return [pa.array(sorted(set(ws.split()))) for ws in FUNCTION_WORDS.values()]


def _np(a) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _run_starts(*keys: np.ndarray) -> np.ndarray:
    """True where any key differs from the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def window_batch(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language code, number of words, first window, windows) of a batch of texts.

    Language codes index ``_CODES``; text i has the windows from ``first[i]`` to ``first[i + 1]``;
    a window is a row of size and features. Every text is judged by itself, whatever its batch.
    """
    n_docs = len(texts)
    cut = texts
    for pattern, mark in _ENDS:
        cut = pc.replace_substring_regex(cut, pattern, mark)
    lines = pc.split_pattern(cut, "\n")
    doc, seg = _np(pc.list_parent_indices(lines)), pc.utf8_trim_whitespace(pc.list_flatten(lines))
    size = _np(pc.utf8_length(seg)).astype(float)
    full = size > 0
    # Blank lines part paragraphs.
    para = np.cumsum(~full)[full]
    doc, size, seg = doc[full], size[full], seg.filter(pa.array(full))
    plain = pc.replace_substring_regex(seg, _LINK, " ")
    linked = size - _np(pc.utf8_length(plain))
    seps = _np(pc.count_substring_regex(plain, _SEPARATOR)).astype(float)
    code = _np(pc.count_substring_regex(plain, _CODE)).astype(float)
    parts = pc.split_pattern_regex(pc.utf8_lower(plain), r"[^\p{L}\p{M}]+")
    w_seg, words = _np(pc.list_parent_indices(parts)), pc.list_flatten(parts)
    some = pc.greater(pc.binary_length(words), 0)
    w_seg, words = w_seg[_np(some)], words.filter(some)
    coded = words.dictionary_encode()
    w, known = _np(coded.indices), coded.dictionary
    d = max(1, len(known))
    w_doc = doc[w_seg]
    n_seg = np.bincount(w_seg, minlength=len(seg)).astype(float)

    # The language of each text: kana, Cyrillic letters, else most function words.
    n_words = _np(pc.count_substring_regex(texts, r"[\p{L}\p{M}]+"))
    in_set = [_np(pc.is_in(known, value_set=s)) if len(known) else np.zeros(0, bool) for s in _word_sets()]
    per = np.stack([np.bincount(w_doc, in_set[i][w], n_docs) if len(w) else np.zeros(n_docs) for i in range(len(in_set))])
    per[list(FUNCTION_WORDS).index("ru")] = 0
    language = np.where(per.max(0) > 0, per.argmax(0), _CODES.index("xx"))
    letters = np.bincount(w_doc, _np(pc.utf8_length(known))[w] if len(w) else None, n_docs)
    language[_np(pc.count_substring_regex(texts, _CYRILLIC)) * 2 > letters] = _CODES.index("ru")
    language[_np(pc.count_substring_regex(texts, _KANA)) > 2] = _CODES.index("ja")
    ja = language == _CODES.index("ja")
    cjk, endings = np.zeros(len(seg)), np.zeros(len(seg))
    in_ja = ja[doc]
    if in_ja.any():
        kana = seg.filter(pa.array(in_ja))
        cjk[in_ja], endings[in_ja] = _np(pc.count_substring_regex(kana, _CJK)), _np(pc.count_substring_regex(kana, JA_ENDINGS))
        # Japanese has no spaces between words: its letters are counted.
        n_words = np.maximum(n_words, (np.bincount(doc, cjk, n_docs) / JA_WORD).astype(int))
        n_seg = np.maximum(n_seg, cjk / JA_WORD)

    # Windows: short neighbours of a paragraph together, long segments in even parts.
    # A link has no words of its own but takes its place.
    extent = np.maximum(n_seg, size / LETTERS)
    short = extent < LEAST
    run = np.cumsum(_run_starts(doc, para, short)) - 1
    before = np.cumsum(extent) - extent
    first_of_run = np.concatenate([[True], run[1:] != run[:-1]]) if len(run) else np.zeros(0, bool)
    bucket = ((before - before[first_of_run][run]) // LEAST).astype(int) if len(run) else run
    start = _run_starts(run, np.where(short, bucket, 0)) | ~short
    group = np.cumsum(start) - 1
    k = np.where(short | in_ja, 1, np.maximum(1, np.ceil(n_seg / MOST))).astype(int)
    g_k = k[start]
    base = np.cumsum(g_k) - g_k
    n_win = int(g_k.sum())
    at = np.arange(len(w_seg)) - (np.cumsum(np.bincount(w_seg, minlength=len(seg))) - np.bincount(w_seg, minlength=len(seg)))[w_seg] if len(w_seg) else w_seg
    w_win = base[group[w_seg]] + (at * k[w_seg] // np.maximum(1, n_seg[w_seg])).astype(int) if len(w_seg) else w_seg
    # What belongs to characters is shared evenly by the parts of a segment.
    spread_over = np.repeat(np.arange(len(g_k)), g_k)
    by_window = lambda x: (np.bincount(group, x, len(g_k)) / g_k)[spread_over]
    win_doc = doc[start][spread_over]
    n = np.bincount(w_win, minlength=n_win).astype(float)
    one = np.maximum(n, 1.0)

    function = np.logical_or.reduce(in_set)
    fun = np.bincount(w_win, function[w], n_win) / one if len(w) else np.zeros(n_win)
    fun_ja = np.minimum(1.0, by_window(endings) * JA_LETTERS / np.maximum(1.0, by_window(cjk)))
    bare = 1.0 - np.where(ja[win_doc] & (by_window(cjk) > 0), fun_ja, fun)
    # Entropy over the words of a window.
    pair, times = np.unique(w_win.astype(np.int64) * d + w, return_counts=True)
    of = (pair // d).astype(int)
    p = times / one[of]
    entropy = np.bincount(of, -p * np.log(p), n_win)
    flat = np.where(n > 1, 1.0 - entropy / np.log(np.maximum(n, 2.0)), 0.0)
    # Keywords: at least three times and a fiftieth of the words of the text's different segments.
    seg_code = _np(seg.dictionary_encode().indices).astype(np.int64) if len(seg) else np.zeros(0, np.int64)
    _, kept = np.unique(doc.astype(np.int64) * max(1, len(seg)) + seg_code, return_index=True)
    distinct = np.zeros(len(seg), bool)
    distinct[kept] = True
    w_key = w_doc.astype(np.int64) * d + w
    keys, times = np.unique(w_key[distinct[w_seg]], return_counts=True)
    total = np.bincount(w_doc[distinct[w_seg]], minlength=n_docs)
    frequent = keys[(times >= 3) & (times * 50 >= total[(keys // d).astype(int)]) & ~function[(keys % d).astype(int)]] if len(keys) else keys
    slot = np.searchsorted(frequent, w_key)
    hit = frequent[np.minimum(slot, max(0, len(frequent) - 1))] == w_key if len(frequent) else np.zeros(len(w_key), bool)
    repeat = np.bincount(w_win, hit, n_win) / one if len(w) else np.zeros(n_win)
    chars = by_window(size)
    dense = np.minimum(1.0, by_window(linked) / np.maximum(1.0, chars) + by_window(seps) / (n + 1.0))
    windows = np.column_stack([chars, dense, flat, repeat, bare, np.minimum(1.0, by_window(code) / one)]) if n_win else np.zeros((0, _K + 1))
    first = np.searchsorted(win_doc, np.arange(n_docs + 1))
    return language, n_words, first, windows


def spam_features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, n_words, windows), one row per row of ``docs`` with a non-blank text.

    One pass over the whole texts; a small table is first spread over the cores.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            language, n_words, first, win = window_batch(texts.cast(pa.string()) if texts.type != pa.string() else texts)
            cols = [pa.array(win[:, i], pa.float32()) for i in range(_K + 1)]
            lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.StructArray.from_arrays(cols, names=["size", *FEATURES]))
            codes = pa.array(_CODES).take(pa.array(language))
            yield pa.RecordBatch.from_arrays([b.column(0), codes, pa.array(n_words, pa.int32()), lists], names=["doc_id", "language", "n_words", "windows"])

    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"\S"))
    return spread(d).mapInArrow(run, WINDOWS)


def _unpack(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of each window, its size, its features) of a batch of ``spam_features``."""
    lists = b.column("windows")
    flat = pc.list_flatten(lists)
    x = np.column_stack([_np(flat.field(i)) for i in range(_K + 1)]).astype(float) if len(flat) else np.zeros((0, _K + 1))
    return _np(pc.list_parent_indices(lists)), x[:, 0], x[:, 1:]


def _by_row(b: pa.RecordBatch, estimates: dict[str, tuple]) -> np.ndarray:
    """Index into the estimates for each row, by language; unknown ones take 'xx'."""
    names = list(estimates)
    at = _np(pc.index_in(b.column("language"), value_set=pa.array(names)).fill_null(names.index("xx")))
    return at.astype(int)


def mahalanobis(x: np.ndarray, at: np.ndarray, estimates: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, deviations in standard deviations) of each row of ``x`` from the
    (centre, scatter) that ``at`` names."""
    centres = np.stack([c for c, _ in estimates])
    inverse = np.stack([np.linalg.inv(s) for _, s in estimates])
    scale = np.stack([np.sqrt(np.diag(s)) for _, s in estimates])
    dev = x - centres[at]
    return np.einsum("ij,ijk,ik->i", dev, inverse[at], dev), dev / scale[at]


def towards_spam(z: np.ndarray) -> np.ndarray:
    """How far a deviation lies towards spam: the lesser of the lack of function words and the
    greatest of density, sameness and repetition; nothing for code."""
    return np.where(z[:, 4] > CODE, 0.0, np.minimum(z[:, 3], z[:, :3].max(1))) if len(z) else np.zeros(0)


def _blend(own: np.ndarray, rest: np.ndarray, n: float) -> np.ndarray:
    return (n * own + PRIOR * rest) / (n + PRIOR)


def _first_estimates(features: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Medians and absolute deviations by language from histograms of all windows. What reaches
    the driver is bounded by languages, features and bins."""

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, x = _unpack(b)
            lang = _np(pc.index_in(b.column("language"), value_set=pa.array(_CODES)))[row].astype(int)
            cell = np.clip(np.rint(x * BINS), 0, BINS).astype(int)
            key = (lang[:, None] * _K + np.arange(_K)) * (BINS + 1) + cell
            keys, n = np.unique(key, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    rows = features.mapInArrow(bins, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(_CODES) * _K * (BINS + 1))
    for r in rows:
        counts[r["cell"]] = r["n"]
    counts = counts.reshape(len(_CODES), _K, BINS + 1)
    if not counts.any():
        return {}
    grid = np.arange(BINS + 1) / BINS

    def middle(values: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(values, kind="stable")
        return float(values[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)])

    def of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = np.array([middle(grid, c[f]) for f in range(_K)])
        mad = np.array([middle(np.abs(grid - centre[f]), c[f]) for f in range(_K)])
        return centre, np.maximum(1.4826 * mad, FLOORS)

    every = of(counts.sum(0))
    out = {}
    for i, code in enumerate(_CODES):
        # Texts without any function word have no language, hence no centre of their own.
        n = 0.0 if code == "xx" else counts[i, 0].sum()
        centre, scale = of(counts[i]) if n else every
        out[code] = (_blend(centre, every[0], n), np.diag(_blend(scale, every[1], n) ** 2))
    return out


def robust_estimates(features: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(centre, scatter) by language from all windows: of those near the first centre mean and
    covariance, blended with those of all languages by their number. No windows: nothing."""
    first = _first_estimates(features)
    if not first:
        return {}
    frames = list(first.values())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, _, x = _unpack(b)
            at = _by_row(b, first)[row]
            near = mahalanobis(x, at, frames)[0] <= NEAR
            x, at = x[near], at[near]
            code = np.arange(len(frames))
            one = np.array([(at == c).sum() for c in code], float)
            lin = [np.bincount(at, x[:, i], len(code)) for i in range(_K)]
            sq = [np.bincount(at, x[:, i] * x[:, j], len(code)) for i in range(_K) for j in range(_K)]
            cols = [pa.array(code, pa.int32()), *[pa.array(v, pa.float64()) for v in (one, *lin, *sq)]]
            yield pa.RecordBatch.from_arrays(cols, names=["code", *names])

    names = ["n", *[f"m{i}" for i in range(_K)], *[f"s{i}{j}" for i in range(_K) for j in range(_K)]]
    schema = "code int, " + ", ".join(f"{n} double" for n in names)
    got = features.mapInArrow(sums, schema).groupBy("code").agg(*[F.sum(n).alias(n) for n in names]).collect()
    table = np.zeros((len(frames), len(names)))
    for r in got:
        table[r["code"]] = [r[n] for n in names]

    def of(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = t[1 : 1 + _K] / t[0]
        return m, t[1 + _K :].reshape(_K, _K) / t[0] - np.outer(m, m)

    if not table[:, 0].any():
        return first
    every, out = of(table.sum(0)), {}
    for i, code in enumerate(first):
        n = 0.0 if code == "xx" else table[i, 0]
        m, s = of(table[i]) if n else every
        m, s = _blend(m, every[0], n), _blend(s, every[1], n)
        sd = np.sqrt(np.maximum(np.diag(s), 1e-12))
        corr = (1 - SHRINK) * s / np.outer(sd, sd) + SHRINK * np.eye(_K)
        np.fill_diagonal(corr, 1.0)
        sd = np.maximum(sd, FLOORS)
        out[code] = (m, corr * np.outer(sd, sd))
    return out


def judged_pages(features: DataFrame, estimates: dict[str, tuple[np.ndarray, np.ndarray]], cutoff: float = CUTOFF, towards: float = TOWARDS) -> DataFrame:
    """(doc_id, language, n_words, distance, spam_share): the mean squared distance of a text's
    windows and the share of its characters in windows that are outliers towards spam."""
    frames = list(estimates.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, size, x = _unpack(b)
            distance, z = mahalanobis(x, _by_row(b, estimates)[row], frames)
            spam = (distance > cutoff) & (towards_spam(z) > towards)
            n = b.num_rows
            total = np.maximum(np.bincount(row, size, n), 1e-9)
            share, mean = np.bincount(row, size * spam, n) / total, np.bincount(row, size * distance, n) / total
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("language"), b.column("n_words"), pa.array(mean), pa.array(share)], names=["doc_id", "language", "n_words", "distance", "spam_share"]
            )

    return features.mapInArrow(run, "doc_id bigint, language string, n_words int, distance double, spam_share double")


def spam_pages(spark: SparkSession, docs: DataFrame, cutoff: float = CUTOFF, towards: float = TOWARDS) -> DataFrame:
    """(doc_id, language, distance, spam_share) of stuffed pages.

    ``docs`` has doc_id and text. A window is spam if its squared distance exceeds ``cutoff``
    and it deviates towards spam by more than ``towards``; a page is one if more than half of
    its characters are in such windows. Null and blank texts and remarks of fewer than
    LEAST_WORDS words are no pages; repeated rows give one row each. Very long texts are
    read whole. An empty table gives no rows.
    """
    work = Workspace(spark, "spam")
    features = work.write(spam_features(docs), "features")
    estimates = robust_estimates(features)
    if not estimates:
        return features.select("doc_id", "language", F.lit(0.0).alias("distance"), F.lit(0.0).alias("spam_share")).limit(0)
    d = judged_pages(features, estimates, cutoff, towards)
    return d.where((F.col("n_words") >= LEAST_WORDS) & (F.col("spam_share") > SHARE)).drop("n_words")
