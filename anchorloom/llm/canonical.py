"""One consistent form for text that looks the same but differs in its characters.

Quick check first: two JVM patterns hold every character that is not "yes" in the
normalization quick check used here (compatibility letters, combining marks, invisible
characters, odd spaces) and words that mix alphabets. Texts without any are not touched
and never leave the JVM. In the others only the unstable segments, each with its
boundary context (the base character before, the combining marks after, or the whole
word for letters of another alphabet), are normalized and spliced back between the
unchanged stretches.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------------
#: Letters of other alphabets that stand in for Latin letters, by the letter they look like.
LOOKALIKES = {
    "A": "АΑᎪᗅꓮ", "B": "ВΒᏴꓐ", "C": "СϹᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧ", "I": "ІΙӀꓲ", "J": "ЈͿᎫꓙ", "K": "КΚᏦꓗ", "L": "Ꮮꓡ", "M": "МΜᎷϺꓟ",
    "N": "Νꓠ", "O": "ОΟՕꓳ", "P": "РΡᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᎳꓪ", "X": "ХΧꓫ", "Y": "ΥҮꓬ", "Z": "ΖᏃꓜ",
    "a": "аαɑ", "b": "ЬƄβв", "c": "сϲᴄ", "d": "ԁ", "e": "еεҽ", "f": "ք", "g": "ɡց", "h": "һհ", "i": "іιɩ", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "мμ", "n": "ոηпν", "o": "оοօᴏσ", "p": "рρ",
    "q": "ԛզգ", "r": "гᴦ", "s": "ѕꜱ", "t": "тτ", "u": "υսʋᴜ", "v": "ѵᴠ", "w": "ԝωᴡա", "x": "хχ", "y": "уγүყ", "z": "ζᴢ",
}
#: Latin letters of phonetic alphabets that count as another alphabet beside plain Latin letters.
PHONETIC = "ɑɡɩʋᴄᴏᴜᴠᴡᴢꜱ"
#: Invisible characters besides those of category Cf.
BLANKS = r"\u034f\u115f\u1160\u17b4\u17b5\u180b-\u180f\u2800\u3164\uffa0"

_TO_LATIN = {c: latin for latin, cs in LOOKALIKES.items() for c in cs}
# A look-alike capital in lower case stands for the lower-case letter, unless it looks like another one.
_TO_LATIN = {c.lower(): latin.lower() for c, latin in _TO_LATIN.items() if latin.isupper() and len(c.lower()) == 1} | _TO_LATIN
_FROM_LATIN: dict[str, dict[str, str]] = {}
for _c, _latin in _TO_LATIN.items():
    _FROM_LATIN.setdefault(unicodedata.name(_c).split()[0].title(), {}).setdefault(_latin, _c)

#: Characters on either side of a word that tell which alphabet its text is written in.
CONTEXT = 40

# --- Rules --------------------------------------------------------------------------
#: Compatibility letters: full-width letters and digits, half-width kana and hangul, ligatures,
#: letter-like signs, mathematical alphabets, Roman numerals, digraphs. Signs with a look of
#: their own (trade marks, numero, superscripts, circled and squared letters) are not here.
_COMPAT = (
    r"０-９Ａ-Ｚａ-ｚｦ-ﾟﾡ-ￜﬀ-ﬆﬓ-ﬗĲĳǄ-ǌǱ-ǳ"
    r"ℂℇℊ-ℓℕℙ-ℝℤΩℨK-ℭℯ-ℱℳ-ℹⅅ-ⅉⅠ-ⅿ"
)
_INVISIBLE = rf"\p{{Cf}}\u0890\u0891\U00013430-\U0001343f\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f\ufe00-\ufe0f\U000e0100-\U000e01ef{BLANKS}"
_SPACES = r"\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x0b\x0c\x85"
#: Combining marks that form letters with what stands before, and conjoining jamo.
_MARKS = r"\u0300-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u3099\u309aᄀ-ᇿ"

_JVM_COMPAT = _COMPAT + r"\x{1d400}-\x{1d7ff}\x{1ee00}-\x{1eeff}"
_JVM_INVISIBLE = _INVISIBLE.replace(r"\U000e0100-\U000e01ef", r"\x{e0100}-\x{e01ef}").replace(r"\U00013430-\U0001343f", r"\x{13430}-\x{1343f}")
#: Not "yes" in the quick check, as a Java pattern. Precomposed characters that normalization
#: replaces (angstrom sign and other singletons, compatibility ideographs) are there, too.
_SINGLETONS = r"ʹ;·άέήίόύώιΐΰ΅`´क़-य़ড়ঢ়য়ਲ਼ਸ਼ਖ਼-ਜ਼ਫ਼ଡ଼ଢ଼གྷཌྷདྷབྷཛྷཀྵ\u2000\u2001ΩKÅ〈〉⫝̸豈-\ufaff"
UNSTABLE = rf"[{_JVM_COMPAT}{_JVM_INVISIBLE}{_SPACES}{_MARKS}{_SINGLETONS}{PHONETIC}]"
#: Letters of two alphabets side by side. Plain ranges: script properties are looked up by
#: binary search for each character. Marks between letters are unstable anyway.
_RANGES = {
    "Latin": r"A-Za-zªºÀ-ÖØ-öø-ʯᴀ-ᴥᵢ-ᵥᵫ-ᵷᵹ-ᶾḀ-ỿⱠ-ⱿꜢ-ꟿꬰ-ꭤ",
    "Greek": r"Ͱ-ͳͶͷͻ-ͿΆ-ϡϰ-Ͽἀ-\u1fff",
    "Cyrillic": r"Ѐ-ԯᲀ-\u1c8fꙀ-\ua69f",
    "Armenian": r"Ա-ֈ",
    "Cherokee": r"Ꭰ-ᏽꭰ-ꮿ",
    "Lisu": r"ꓐ-ꓽ",
}
_NOT_LATIN = "".join(r for a, r in _RANGES.items() if a != "Latin")
MIXED = (
    rf"[{_NOT_LATIN}](?:(?=[{_RANGES['Latin']}])|(?<=[{_RANGES['Latin']}].))|"
    + "|".join(rf"[{r}](?=[{''.join(q for b, q in _RANGES.items() if b not in (a, 'Latin'))}])" for a, r in _RANGES.items() if a != "Latin")
)
#: Texts of only these characters are stable and hold no second alphabet. Few ranges, so that
#: most texts are done after one cheap look.
PLAIN = r"[^\t\n\r -~¡-¬®-ıĴ-Ʃ‐-‧、-ゖ゠-ヿ一-鿿]"

_PY_UNSTABLE = UNSTABLE.replace(r"\x{1d400}-\x{1d7ff}\x{1ee00}-\x{1eeff}", "\U0001d400-\U0001d7ff\U0001ee00-\U0001eeff").replace(r"\x{e0100}-\x{e01ef}", "\U000e0100-\U000e01ef").replace(r"\x{13430}-\x{1343f}", "\U00013430-\U0001343f")
#: An unstable stretch with its context: one character before, the marks after.
_SEGMENT = regex.compile(rf"(?:\P{{M}}(?={_PY_UNSTABLE}))?{_PY_UNSTABLE}+\p{{M}}*")
_EMOJI_ONE = r"[\p{Extended_Pictographic}\p{Emoji_Presentation}][\ufe0e\ufe0f\U0001f3fb-\U0001f3ff]*"
_EMOJI = regex.compile(rf"[\U0001f1e6-\U0001f1ff]{{2}}|[0-9#*]\ufe0f?\u20e3|{_EMOJI_ONE}[\U000e0020-\U000e007f]*(?:\u200d(?:{_EMOJI_ONE}|[♀♂⚕⚖✈❤]\ufe0f?))*")
_COMPAT_RE = regex.compile("[" + _COMPAT + "\U0001d400-\U0001d7ff\U0001ee00-\U0001eeff]+")
_INVISIBLE_RE = regex.compile(f"[{_INVISIBLE}]+")
_SPACES_RE = regex.compile(f"[{_SPACES}]")
_WORD = regex.compile("[" + "".join(_RANGES.values()) + r"\p{Mn}]+")
_SCRIPTS = {a: regex.compile(f"[{r}]") for a, r in _RANGES.items()}


@lru_cache(maxsize=100_000)
def _script(c: str) -> str | None:
    if c in PHONETIC:
        return "Phonetic"
    return next((s for s, p in _SCRIPTS.items() if p.match(c)), None)


def _one_alphabet(m: regex.Match) -> str:
    """A word whose letters come from several alphabets, in one of them, if each foreign
    letter looks like one of that alphabet; otherwise the word as it is."""
    word = m.group()
    scripts: dict[str, int] = {}
    own: dict[str, int] = {}
    for c in word:
        s = _script(c)
        if s is None:
            continue
        scripts[s] = scripts.get(s, 0) + 1
        if s == "Latin" and c not in LOOKALIKES or s != "Latin" and c not in _TO_LATIN:
            own[s] = own.get(s, 0) + 1
    if len(scripts) < 2:
        return word
    # The alphabet with most letters that only it has; then that of the surrounding text.
    near = m.string[max(0, m.start() - CONTEXT) : m.end() + CONTEXT]
    around = {s: sum(_script(c) == s for c in near) for s in scripts}
    order = sorted(scripts, key=lambda s: (s != "Phonetic", own.get(s, 0), around[s], s == "Latin"), reverse=True)
    for target in dict.fromkeys([*order[:1], "Latin"]):
        out = []
        for c in word:
            s = _script(c)
            if s is None or s == target:
                out.append(c)
                continue
            latin = c if s == "Latin" else _TO_LATIN.get(c)
            out.append(latin if target == "Latin" else _FROM_LATIN.get(target, {}).get(latin))
        if None not in out:
            return "".join(out)
    return word


def _segment(s: str) -> str:
    s = _INVISIBLE_RE.sub("", s)
    s = _SPACES_RE.sub(" ", s)
    s = _COMPAT_RE.sub(lambda m: unicodedata.normalize("NFKC", m.group()), s)
    return unicodedata.normalize("NFC", s)


def _stable(s: str) -> str:
    """Splice canonical segments between the stretches that the quick check passes."""
    return _SEGMENT.sub(lambda m: _segment(m.group()), s)


def canonical(text: str | None) -> str | None:
    """The canonical form of one text; null stays null, an emoji sequence stays whole.

    Removing an invisible character can bring a base and its mark together, and folding a
    letter can complete a word of one alphabet; hence words are looked at last and the
    result is a fixed point: ``canonical(canonical(t)) == canonical(t)``.
    """
    if text is None:
        return None
    while True:
        parts, at = [], 0
        for m in _EMOJI.finditer(text):
            if len(m.group()) > 1:  # a sequence; single emoji need no protection
                parts += [_stable(text[at : m.start()]), m.group()]
                at = m.end()
        parts.append(_stable(text[at:]))
        out = _WORD.sub(_one_alphabet, "".join(parts))
        if out == text:
            return out
        text = out


def unstable(c: Column | str) -> Column:
    """Quick check: may the text differ from its canonical form? Never false for one that does."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(PLAIN) & (c.rlike(UNSTABLE) | c.rlike(MIXED))


def canonical_batch(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        # Equal texts of a batch are done once.
        yield batch.map({t: canonical(t) for t in batch.unique()}) if len(batch) else batch


def canonical_column(c: Column | str) -> Column:
    """The canonical form; Python sees only texts that the quick check stops. Others pass as they are."""
    c = F.col(c) if isinstance(c, str) else c
    udf = F.pandas_udf(canonical_batch, "string")
    return F.when(unstable(c), udf(F.when(unstable(c), c))).otherwise(c)


def canonical_records(tables: dict[str, tuple[DataFrame, str, list[str]]]) -> DataFrame:
    """(record_table, record_id, field, original, canonical) of every text that needed it.

    ``tables`` maps a name to (rows, id column, text columns). Null and empty texts, null
    ids and texts in canonical form give no row; identical texts of an id give one. Very
    long texts are processed whole. Narrow until the last step: the only shuffle is that of
    the found rows, which drops repeated ones.
    """
    out = None
    for name, (df, key, fields) in tables.items():
        texts = df.where(F.col(key).isNotNull()).select(
            F.lit(name).alias("record_table"),
            F.col(key).cast("long").alias("record_id"),
            F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("original")) for f in fields])).alias("t"),
        )
        texts = texts.select("record_table", "record_id", "t.field", "t.original").where(F.col("original").isNotNull() & unstable("original"))
        out = texts if out is None else out.unionByName(texts)
    fixed = out.withColumn("canonical", F.pandas_udf(canonical_batch, "string")("original"))
    return fixed.where(F.col("canonical") != F.col("original")).distinct()
