"""Canonical form, residue, tokenizer, leakage and spam on small tables and models."""

import base64
import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from anchorloom.llm import leakage
from anchorloom.llm.canonical import canonical, canonical_column, canonical_records, unstable
from anchorloom.llm.residue import residue_entries
from anchorloom.llm.spam import judged_pages, robust_estimates, spam_features, spam_pages
from anchorloom.llm.tokenizer import PATTERN, TokenAutomaton, decode_documents, encode_documents, load_encoder, vocabulary_path

CASES = [
    ("Ｂｅｎｃｈ ６２", "Bench 62"), ("ﬁne ﬀ", "fine ff"), ("étau が", "étau が"), ("a​b­c﻿", "abc"), ("a b c　d", "a b c d"), ("Pаtϲһ", "Patch"), ("Kiln", "Kiln"),
    ("Calibrating a Pug Міⅼⅼѕ", "Calibrating a Pug Mills"), ("пpeсc для cидрa", "пресс для сидра"), ("bow saw кіtѕ", "bow saw kits"), ("сoсна", "сосна"), ("e​́", "é"), ("\U0001d40bathe", "Lathe"),
]
SAME = ["Ελληνικά and Русский", "naïve café", "™ № ² ½ ③ … “q” – ’", "👩‍🔧 ⚙️ 🇩🇪 1️⃣", "Tシャツ", "tab\there\nline", "", "日本語、です。", "x → y €", "µm"]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_canonical(text, want):
    assert canonical(text) == want
    assert canonical(want) == want


@pytest.mark.parametrize("text", SAME)
def test_left_alone(text):
    assert canonical(text) == text


def test_quick_check_never_misses(spark):
    rnd = random.Random(2)
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = [t for c in rnd.sample(points, 15000) + list(range(1, 0x600)) + list(range(0x2000, 0x2200)) + list(range(0xFE00, 0xFFFE)) for t in (chr(c), f"a{chr(c)}b", f"д{chr(c)}д")]
    need = [t for t in texts if canonical(t) != t]
    assert all(canonical(canonical(t)) == canonical(t) for t in need)
    df = spark.createDataFrame([(t,) for t in need], "t string")
    assert df.where(~unstable("t")).count() == 0


def test_canonical_records(spark):
    df = spark.createDataFrame([(1, "Ａ", "a", "c"), (1, "Ａ", "a", "c"), (2, None, "b​", "c"), (None, "Ａ", None, "c"), (3, "", "plain" * 20000, "c"), (4, "x" * 50000 + " ", None, "c")], "id int, p string, q string, canonical string")
    got = {(r["record_id"], r["field"]) for r in canonical_records({"t": (df, "id", ["p", "q"])}).collect()}
    assert got == {(1, "p"), (2, "q"), (4, "p")}
    assert canonical_records({"t": (df.limit(0), "id", ["p"])}).count() == 0
    assert [r[0] for r in df.select(canonical_column("q")).collect()] == ["a", "a", "b", None, "plain" * 20000, None]


THINGS = ["bow saw", "kiln controller", "reed knife", "star tracker", "rope fid", "pug mill", "cone holder"]
RESIDUE = [
    "HTTP 410 - Ivernook", "Title (change me)", "Exception in layout.tpl line 92", "Error establishing a database connection (ref 9b9)", "&LT;%= TITLE %&GT;", "404 Not Found", "Tarnwick | 502 - Bad Gateway", "%%PAGE_TITLE%% Wiring Diagram", "Honey Extractor - {{ page.title }}", "&lt;%= title %&gt;", "Lorem ipsum dolor sit amet - X Shop", "Untitled-3", "New Page 1",
    "Please enable JavaScript to view this page", "Включите JavaScript | Rastavel", "Einen Moment bitte...", "error 500: página no encontrada", "Access to this page has been denied - Corvale", "NaN - undefined", "%s - %s",
    "This site can’t be reached", "Application error: a client-side exception has occurred (ref a65d59)", "Velmora | Application error: a client-side exception has occurred", "ページが見つかりません", "Hello {first_name}, meet the Reed Knife", "[Insert title here]",
]
REAL = [
    "How to Fix a 404 Error on the Velmora Hub", "Lorem Ipsum Poster, Black", "Page Not Found: A Bookbinder's Guide to Warp Beams", "Writing {{ mustache }} Tags for Loom Shuttle Labels", "Understanding the ${name} Syntax in Scripts",
    "Enabling JavaScript in the Aldervane Editor", "JavaScript Control for the Bow Saw", "Access Denied Door Sign", "Maintenance Mode Explained", "Bow Saw – Maintenance", "Untitled Sketchbook", "100% Wool Felt for Kiln", "Room 404 Rope Fid",
    "Coming Soon to Merrivale: Envelope Follower Fair", "Blank Page Journal, Tarnwick", "Moment Arm Basics", "Loading Dock Sail Needle", "Test Page Holder for Chain Whip", "[Solved] Pug Mill Rattles at 500 rpm", "Fehlerseiten gestalten mit Corvale", "Bow Saw | Tarnwick", None, "", "  ",
]


def test_residue(spark):
    rows = [(i, f"https://www.tarnwick.example/{i}", t, 2, "x") for i, t in enumerate(RESIDUE + REAL)]
    # An older state with another title does not count; a repeated row does not matter.
    rows += [(len(RESIDUE), "https://h/x", "404 Not Found", 1, "x"), rows[0], (None, "https://h/x", "404", 1, "x"), (900, None, "404", 1, "x"), (901, "https://h", "word " * 20000 + "404", 1, "x")]
    # Names are known from other titles, as lines or as their first words.
    rows += [(2000 + 10 * k + n, f"https://www.other.example/{k}/{n}", t.format(THINGS[n]), 2, "x") for k, name in enumerate(("Ivernook", "Corvale", "Velmora", "Rastavel")) for n, t in enumerate((f"{{}} | {name}", f"{name} {{}}", f"{name} {{}} Kit"))]
    df = spark.createDataFrame(rows, "id int, url string, title string, updated_at int, kind string")
    got = {r["entry_id"] for r in residue_entries(df).collect()}
    wrong = [(RESIDUE + REAL)[i] for i in range(len(RESIDUE + REAL)) if (i in got) != (i < len(RESIDUE))]
    assert not wrong
    assert 900 in got and 901 not in got
    # The counts decide: without them titles with a name beside the evidence are lost.
    lost = got - {r["entry_id"] for r in residue_entries(df, recurrent=10**9).collect()}
    assert {RESIDUE[i] for i in lost} >= {"HTTP 410 - Ivernook", "Access to this page has been denied - Corvale", "Velmora | Application error: a client-side exception has occurred"}
    assert residue_entries(df.limit(0)).count() == 0


def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary_path(name="byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tokenizer_matches_reference():
    enc, ref, rnd = load_encoder(vocabulary_path()), reference(), random.Random(4)
    bits = ["a", "aa", "the", " ", "  ", "\n", "=", "-", "é", "日本", "ing", "1", "00", "😀", "\t", "<|endoftext|>", "'s", "A", "́", "\x00"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(32, 126), rnd.randint(0xA0, 0x4FF), rnd.randint(0x3040, 0x30FF)])) for _ in range(30)) for _ in range(3000)]
    texts += [c * n for c in ("a", "=", " ", "ab", "\n", "é", "0") for n in (1, 2, 3, 7, 16, 33, 129, 5000)]
    for t in texts:
        ids = enc.encode(t)
        assert ids == ref.encode_ordinary(t)
        assert enc.automaton.decode(ids).decode("utf-8", "replace") == t


def test_automaton_on_small_merges():
    """Against merging by rank, on a vocabulary small enough to try all words."""
    vocab = {c: i for i, c in enumerate("abc")} | {"ab": 3, "aa": 4, "abc": 5, "aaa": 6, "bc": 7, "abab": 8, "caa": 9}
    merges = [("a", "b"), ("a", "a"), ("ab", "c"), ("aa", "a"), ("b", "c"), ("ab", "ab"), ("c", "aa")]

    def by_rank(word):
        parts = list(word)
        while True:
            best = min((merges.index(p) for p in zip(parts, parts[1:], strict=False) if p in merges), default=None)
            if best is None:
                return [vocab[p] for p in parts]
            out, i = [], 0
            while i < len(parts):
                if tuple(parts[i : i + 2]) == merges[best]:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out

    import itertools

    a = TokenAutomaton(vocab, merges)
    for n in range(1, 9):
        for w in itertools.product("abc", repeat=n):
            word = "".join(w)
            assert a.encode_word(word.encode()) == by_rank(word), word


def test_encode_documents(spark):
    df = spark.createDataFrame([(1, "the cat <|endoftext|>", "x"), (2, None, "x"), (3, "", "x"), (None, "a", "x"), (1, "the cat <|endoftext|>", "x"), (4, "word " * 30000, "x")], "doc_id bigint, text string, ids string")
    ref = reference()
    out = encode_documents(df)
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in out.collect())
    assert got == sorted((i or 0, ref.encode_ordinary(t or "")) for i, t, _ in df.collect())
    assert {r["doc_id"]: r["text"] for r in decode_documents(out).collect()}[4] == "word " * 30000
    assert encode_documents(df.limit(0)).count() == 0


def test_leakage_against_brute_force(spark):
    import re

    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.randint(5, 30)))) for i in range(12)] + [(50, "Name the river."), (51, None), (52, ""), (0, None)]
    docs = []
    for d in range(60):
        words = rnd.choices(vocab, k=rnd.randint(0, 40))
        if d % 2:
            it = items[rnd.randrange(12)][1].split()
            n = rnd.choice([11, 12, 13, 30])
            at = rnd.randrange(max(1, len(it) - n + 1))
            cut = it[at : at + n]
            words[5:5] = [w.upper() + rnd.choice(["", ",", "**", "\n"]) for w in cut]
        docs.append((d, rnd.choice([" ", " - ", "\n"]).join(words)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (1, docs[1][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id")
    i = spark.createDataFrame(items, "item_id bigint, item_text string").selectExpr("*", "1 AS doc_id")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.passage_matches(spark, d, i).collect() if r["best_words"] == 12}
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = lambda t: {tuple(cut(t)[k : k + 12]) for k in range(len(cut(t)) - 11)}
    want = {(a, b) for a, s in docs if a is not None for b, q in items if grams(s) & grams(q)}
    assert got == want and len(want) >= 8
    assert leakage.passage_matches(spark, d.limit(0), i).count() == 0
    assert leakage.passage_matches(spark, d, i.limit(0)).count() == 0


PROSE = [
    "I picked up the {0} from the shop and it still feels sturdy. There is a spacer between the {1} and the frame that people forget, so I wrote it down. What do you use for the {0} in the winter?",
    "You want the older {0}, if you plan on cleaning it yourself. We measured {n} mm at the rear and it was not what the manual says. She told me that the {1} is the same as on the other one.",
]


def spam_docs():
    rnd = random.Random(8)
    t = lambda: rnd.choice(THINGS)
    good = [(i, rnd.choice(PROSE).format(t(), t(), n=rnd.randint(1, 400)) + " " + rnd.choice(PROSE).format(t(), t(), n=i)) for i in range(400)]
    good += [(400, "+1"), (401, None), (402, ""), (403, "def close(lid):\n    if lid.open:\n        lid.turn(90)\n    return lid\n" * 5), (404, "a" * 3000)]
    good += [(405, "\n".join(f"{k}. " + rnd.choice(PROSE).format(t(), t(), n=k).split(".")[0] + f". [{k}](https://a.example/n/{k})" for k in range(12)))]
    good += [(406, PROSE[0].format("x", "y") + "\n\nSee also:\n- https://a.example/one\n- https://a.example/two")]
    bad = [
        (500, " ".join(f"{t()} {rnd.choice(['cheap', 'buy', 'sale', 'best'])}" for _ in range(80))), (501, "\n".join(f"- [{t()}](https://a.example/p/{k})" for k in range(30))), (502, " ".join(f"#{t().replace(' ', '')}" for _ in range(90))),
        (503, "\n".join(f"Tags: {t()}, {t()}, narrow, {t()}" for _ in range(25))), (504, "\n".join(f'<a href="http://a.example/{k}">buy {t()}</a>' for k in range(30))), (505, "\n".join(f"{t().title()} > {t().title()} > Corvale" for _ in range(25))),
        (506, PROSE[0].format("x", "y") + "\n\n" + ", ".join(f"{t()} sale" for _ in range(200))),
    ]
    return good, bad


def test_spam(spark):
    good, bad = spam_docs()
    df = spark.createDataFrame(good + bad + bad[:1], "doc_id bigint, text string").selectExpr("*", "'x' AS language", "1 AS distance")
    got = [r["doc_id"] for r in spam_pages(spark, df).collect()]
    assert set(got) == {i for i, _ in bad} and got.count(500) == 2
    assert spam_pages(spark, df.limit(0)).count() == 0
    features = spam_features(df)
    f = {r["doc_id"]: r for r in features.collect()}
    assert 401 not in f and 402 not in f and f[0]["windows"][0]["f_bare"] < 0.6 < f[501]["windows"][0]["f_dense"] and f[0]["language"] == "en"
    # The distance decides: without it, or from another centre and scatter, other pages are found.
    estimates = robust_estimates(features)
    pages = lambda **k: {r["doc_id"] for r in judged_pages(features, k.pop("estimates", estimates), **k).where("spam_share > 0.5").collect()}
    assert pages() >= {i for i, _ in bad}
    far = sorted(r["distance"] for r in judged_pages(features, estimates).collect() if r["doc_id"] >= 500)
    assert not pages(cutoff=1e9) and set() < pages(cutoff=far[len(far) // 2]) < pages()
    assert pages(estimates={c: (m + 1, s) for c, (m, s) in estimates.items()}) != pages()
    assert pages(towards=-9.0) - pages()


def test_queries_and_sql(spark):
    from anchorloom.llm import queries
    from oracle import SF, check, connect

    con = connect()
    for name, sql in queries.ORACLES.items():
        check(spark, con, queries.QUERIES[name], sql)
    for name in set(queries.QUERIES) - set(queries.ORACLES):
        queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()


def spam_shares(spark, texts):
    """Share of stuffing and number of words of each text, among 400 documents of prose."""
    good, _ = spam_docs()
    df = spark.createDataFrame(good[:400] + [(1000 + k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    features = spam_features(df)
    got = {r["doc_id"]: r for r in judged_pages(features, robust_estimates(features)).collect()}
    return [(got[1000 + k]["spam_share"], got[1000 + k]["n_words"]) for k in range(len(texts))]


def test_spam_one_line(spark):
    """A page without line breaks is judged by its windows, not all or nothing."""
    things = [f"{a} {b}" for a in ("cheap", "best", "buy", "sale") for b in THINGS]
    prose = "I keep the old saw in the shed because it is dry. She told me that the kiln was not hot. We were at the river when it broke. What do you do with this? They have had the same mill. He is on the roof with a rope."
    half, quarter, none, upper = (x for x, _ in spam_shares(spark, [prose + " " + ", ".join(things * 2) + ".", prose + " " + ", ".join(things[:6]) + ".", prose, prose.upper() + "\n" + ", ".join(things)]))
    assert 0.6 < half < 0.9 and quarter < 0.45 and none == 0 and 0.5 < upper < 0.8


def test_spam_at_any_length(spark):
    """Repetition counts the same however long it goes on; so do Japanese endings."""
    deals = lambda n: " ".join(f"deals on {THINGS[k % 7]}" for k in range(n))
    listing = "ボビン 格安 通販 釉薬 ふるい 最安値 ボビン 送料 無料 ガイド 望遠鏡 "
    japanese = "昨日、窯のコントローラーのばねが折れてしまいました。誰か釉薬ふるいの説明書を持っていませんか。冬の間は乾いた場所に置いています。"
    prose = "she told me that when the river rose in spring nobody could cross at our old ford so we built a raft from barrels and rope which held until some cattle broke it and then my uncle said he would rather swim than wait again because his letters had been lost twice already on that road"
    texts = [listing * 40 + "ボビンから", listing * 3 + "\n" + listing * 30, ("buy bow saw " * 8).strip(), "buy bow saw\n" * 200, japanese * 40, japanese.replace("。", "、") * 4, prose, prose + " " + ", ".join(f"{t} sale" for t in THINGS * 8), "", "x"]
    got = spam_shares(spark, texts[:8])
    assert [round(x) for x, _ in got[:7]] == [1, 1, 1, 1, 0, 0, 0], got
    assert 0.5 < got[7][0] < 0.98 and got[5][1] >= 20
    assert [round(x) for x, _ in spam_shares(spark, [deals(30), deals(200), deals(2000)])] in ([1, 1, 1], [0, 0, 0])


def test_windows_do_not_depend_on_the_batch():
    import pyarrow as pa

    from anchorloom.llm.spam import window_batch

    good, bad = spam_docs()
    texts = [t for _, t in good[380:400] + bad if t] + ["", " \n ", "a", "日本語です。", "é" * 50, "http://x.example " * 70]
    _, _, first, whole = window_batch(pa.array(texts))
    for i, t in enumerate(texts):
        _, _, _, alone = window_batch(pa.array([t]))
        # Equal but for the order in which the terms of an entropy are added.
        assert alone.tolist() == [pytest.approx(w, abs=1e-9) for w in whole[first[i] : first[i + 1]].tolist()]


def test_near_with_the_rarest_words_replaced(spark):
    """Proximity against brute force: up to three of twelve words differ, the rarest ones first."""
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, [rnd.choice(vocab[:20]) if k % 4 else f"rare{i}x{k}" for k in range(12)]) for i in range(12)]
    docs = [(i * 10 + n, vocab[20:24] + [f"other{k}" if k % 4 == 0 and k // 4 < n else w for k, w in enumerate(ws)]) for i, ws in items for n in range(4)]
    docs += [(500 + k, [w for _, ws in items for w in ws if w[0] == "r"]) for k in range(2)] + [(600, sum((ws for _, ws in items), []))]
    d = spark.createDataFrame([(i, " ".join(ws)) for i, ws in docs], "doc_id bigint, text string")
    i = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id bigint, item_text string")
    best = {(a, b): max(sum(0 <= s + k < len(x) and x[s + k] == w for k, w in enumerate(y)) for s in range(-11, len(x))) for a, x in docs for b, y in items}
    want = {k: v for k, v in best.items() if v >= leakage.NEAR}
    assert {9, 10, 11, 12} <= set(want.values())
    for most in (leakage.MAX_SPOTS, 0):  # sent to the workers, and joined
        assert {(r["doc_id"], r["item_id"]): r["best_words"] for r in leakage.passage_matches(spark, d, i, max_spots=most).collect()} == want
