"""Matching phrases of a title: conservative variants, then a gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.text import ascii_strip, normalize_text
from anchorloom.settings import Settings

# --- Fixed values: common words that are weak as a single-word phrase.
COMMON_WORDS = """
pack packs belt belts patch patches uniform uniforms suit suits glove gloves boot boots shirt shirts hat hats
pin pins kit kits set sets tube tubing hose hoses wire wires label labels sticker stickers strap straps clip clips
light lights sound sounds board boards frame frames pad pads foam metal plastic resin rubber leather gun guns
box boxes bag bags case cases cover covers grip grips handle handles mount mounts screw screws spring springs
magnet magnets battery batteries speaker speakers red blue green grey gray black white yellow orange brown purple
pink gold silver brass copper chrome clear custom official vintage classic original special limited standard basic
complete full half quarter mini micro mega super ultra pro plus deluxe premium guide guides news blog page pages
home shop store wiki forum gallery video videos photo photos image images music song songs episode episodes
season seasons character characters people person crew cast story stories history location locations vehicle
vehicles equipment gear bank banks tank tanks barrel barrels bottle bottles glass glasses poster posters banner
banners button buttons badge badges keychain comic comics game games movie movies film films book books toy toys
card cards sign signs mug mugs cap caps
""".split()


def _each(variants: Column, f) -> Column:
    """The variants so far, followed by what ``f`` makes of each (null: nothing)."""
    return F.concat(variants, F.filter(F.transform(variants, f), lambda v: v.isNotNull()))


def _match(v: Column, pattern: str, group: int) -> Column:
    return F.when(v.rlike(pattern), F.regexp_extract(v, pattern, group))


def _number(v: Column, plurals: bool) -> Column:
    words = F.filter(F.split(v, r"\s+"), lambda w: w != "")
    last = F.lower(F.element_at(words, -1))
    plural = F.when(last.rlike(r"(?:s|x|z|ch|sh)\z"), F.concat(v, F.lit("es"))).otherwise(F.concat(v, F.lit("s")))
    cut = lambda n: F.substring(v, F.lit(1), F.length(v) - n)
    other = (
        F.when(~last.rlike(r"s\z"), plural if plurals else F.lit(None).cast("string"))
        .when(last.rlike(r"(?:xes|ses|zes|ches|shes)\z"), cut(2))
        .when((F.length(last) > 4) & ~last.rlike(r"(?:ss|us|is|ns)\z"), cut(1))
    )
    return F.when(~F.contains(v, F.lit(":")) & ~F.contains(v, F.lit("(")), other)


def variants(title: Column | str, settings: Settings = Settings()) -> Column:
    """array<string> of raw variants in order; each stage works on all before it. A blank
    or null title has none."""
    c = F.col(title) if isinstance(title, str) else title
    base = ascii_strip(F.regexp_replace(c, r"\s+", " "))
    vs = F.filter(F.array(base, _match(base, r"\A[^:]{2,24}:\s+(.+)\z", 1)), lambda v: v.isNotNull())
    vs = _each(vs, lambda v: _match(v, r"\A(.*\S)\s*\([^)]*\)\z", 1))
    vs = _each(vs, lambda v: F.when(v.rlike(r"(?i)\Athe\s+"), F.regexp_replace(v, r"(?i)\Athe\s+", "")))
    vs = _each(vs, lambda v: _number(v, settings.generate_plurals))
    vs = _each(
        vs,
        lambda v: F.when(F.contains(v, F.lit(" & ")), F.replace(v, F.lit(" & "), F.lit(" and "))).when(v.rlike(r"\sand\s"), F.regexp_replace(v, r"\sand\s", " & ")),
    )
    return F.when(base != "", vs).otherwise(F.array().cast("array<string>"))


def _singular(w: Column) -> Column:
    stem = F.substring(w, F.lit(1), F.length(w) - 1)
    return F.when((F.length(w) >= 5) & F.endswith(w, F.lit("s")) & ~w.rlike(r"(?:ss|us|is)\z") & stem.isin(COMMON_WORDS), stem).otherwise(w)


def review_reason(phrase: Column | str, settings: Settings = Settings()) -> Column:
    """Why a normalized phrase waits for review; null if it is active at once."""
    p = F.col(phrase) if isinstance(phrase, str) else phrase
    words = F.filter(F.split(p, r"\s+"), lambda w: w != "")
    return (
        F.when(F.length(p) < settings.min_phrase_length, "too_short")
        .when((F.size(words) == 1) & _singular(p).isin(COMMON_WORDS), "generic_word")
        .when((F.size(words) <= 2) & F.forall(words, lambda w: _singular(w).isin(COMMON_WORDS)), "generic_words")
        .when((F.size(words) < settings.min_phrase_words) & ~(p.rlike("(?i)[a-z]") & p.rlike(r"[0-9]")), "below_min_words")
    )


def generate_terms(entries: DataFrame, settings: Settings = Settings(), key: str = "id", title: str = "title") -> DataFrame:
    """(entry_id, ordinal, phrase, normalized_phrase, state, review_reason) per title.

    One row per normalized phrase and entry, the first raw spelling; excluded terms never
    appear. No shuffle: variants, removal of repeats and gate are expressions on one row.
    """
    pairs = entries.select(F.col(key).alias("entry_id"), F.transform(variants(title, settings), lambda v: F.struct(v.alias("phrase"), normalize_text(v).alias("norm"))).alias("vs"))
    pairs = pairs.withColumn("norms", F.transform("vs", lambda v: v["norm"]))
    one = pairs.select("entry_id", F.posexplode(F.filter("vs", lambda v, i: (v["norm"] != "") & (F.array_position(F.col("norms"), v["norm"]) == i + 1))).alias("ordinal", "v"))
    out = one.select("entry_id", "ordinal", F.col("v.phrase").alias("phrase"), F.col("v.norm").alias("normalized_phrase"))
    if settings.excluded_terms:
        out = out.where(~F.col("normalized_phrase").isin(*settings.excluded_terms))
    reason = review_reason("normalized_phrase", settings)
    return out.withColumn("state", F.when(reason.isNull(), "auto_active").otherwise("pending_review")).withColumn("review_reason", reason)
