"""Text column helpers. All but `fold` (beyond ASCII) and the entities of `unescape_entities` stay in the JVM."""

from __future__ import annotations

import html
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed_values as V


@F.pandas_udf(T.StringType())
def _fold_wide(texts: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))

    return texts.map(one)


def fold(c: Column) -> Column:
    """Lower case, compatibility-decomposed, without combining marks.

    Spark has no NFKD function, so texts beyond ASCII go to Python; of the others only a null does.
    """
    wide = c.rlike(r"[^\x00-\x7F]")
    return F.when(wide, _fold_wide(F.when(wide, c))).otherwise(F.lower(c))


# What `html.unescape` looks at. No entity holds a blank, and none decodes to a blank before \x01.
_ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_BETWEEN = " \x01"


@F.pandas_udf(T.StringType())
def _decode_entities(entities: pd.Series) -> pd.Series:
    return entities.map(html.unescape, na_action="ignore")


def unescape_entities(c: Column) -> Column:
    """HTML entities to characters. Only the entities go to Python; the text around them stays in the JVM."""
    some = c.contains("&")
    entities = F.when(some, F.array_join(F.regexp_extract_all(c, F.lit(_ENTITY), F.lit(0)), _BETWEEN))
    around, decoded = F.split(c, _ENTITY, -1), F.split(_decode_entities(entities), _BETWEEN, -1)
    written = F.zip_with(around, decoded, lambda text, char: F.concat(text, F.coalesce(char, F.lit(""))))
    return F.when(some, F.array_join(written, "")).otherwise(c)


# Java's \s leaves out no-break and other wide spaces, which pages are full of.
SPACES = r"[\s\p{Z}]+"


def blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) > 0, c)


def given(name: str) -> Column:
    """The text column holds something."""
    return F.coalesce(F.length(name) > 0, F.lit(False))


def cut(c: Column, size: int | None) -> Column:
    """The first `size` characters, or with None all of them."""
    return c if size is None else F.substring(c, 1, size)


def clean_label(c: Column, size: int | None = None) -> Column:
    """Squeeze white space, and cut where a size is asked for."""
    return cut(F.trim(F.regexp_replace(c, SPACES, " ")), size)


def short_id(c: Column) -> Column:
    """Last path part of an id link; null when nothing is left."""
    return blank_to_null(F.substring_index(F.rtrim(c, F.lit("/")), "/", -1))


def url_host(c: Column) -> Column:
    """Lower-case host of a URL, null when the URL cannot be parsed."""
    return F.lower(F.try_parse_url(c, F.lit("HOST")))


def registered_domain(c: Column) -> Column:
    """Crude registered domain of a host: three labels for ac.uk-like endings, else two (F2)."""
    host = F.trim(F.split(F.lower(c), ":")[0], F.lit("."))
    host = F.regexp_replace(host, r"^www\.", "")
    parts = F.split(host, r"\.")
    size = F.size(parts)
    long_form = (
        (size >= 3)
        & F.try_element_at(parts, F.lit(-2)).isin(V.SECOND_LEVEL)
        & (F.length(F.element_at(parts, -1)) == 2)
    )
    return F.when(host == "", F.lit("")).otherwise(
        F.when(long_form, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    )


def email_host(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^@]*@", "")


def name_tokens(folded: Column) -> Column:
    """Letters-only words of a folded name, honorifics out."""
    words = F.split(folded, "[^a-z]+")
    return F.filter(words, lambda w: (w != "") & ~w.isin(V.HONORIFICS))


def name_key(tokens: Column) -> Column:
    """First initial and surname, `j|doe`; null for an empty name."""
    return F.when(
        F.size(tokens) > 0,
        F.concat(F.substring(F.element_at(tokens, 1), 1, 1), F.lit("|"), F.element_at(tokens, -1)),
    )


def org_tokens(folded: Column) -> Column:
    """Distinctive words of an organisation name."""
    words = F.split(folded, "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(V.ORG_FILLER)))


def email_fits_name(email: Column, tokens: Column) -> Column:
    """Local part holds the surname or first name (3 letters or more), or equals the initials."""
    local = F.regexp_replace(F.lower(F.substring_index(email, "@", 1)), "[^a-z]", "")
    first, last = F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(-1))
    initials = F.array_join(F.transform(tokens, lambda t: F.substring(t, 1, 1)), "")
    fits = (
        ((F.length(last) >= 3) & local.contains(last))
        | ((F.length(first) >= 3) & local.contains(first))
        | ((F.length(initials) >= 2) & (local == initials))
    )
    return F.coalesce((F.size(tokens) > 0) & fits, F.lit(False))


def stem(w: Column) -> Column:
    """Light stemmer for a word without apostrophes: plurals meet their singular."""
    n = F.length(w)

    def ends(*endings):
        return reduce(lambda x, y: x | y, [w.endswith(e) for e in endings])

    return (
        F.when((n <= 3) | ~w.endswith("s"), w)
        .when(w.endswith("ies") & (n > 4), F.concat(w.substr(F.lit(1), n - 3), F.lit("y")))
        .when(ends("sses", "xes", "ches", "shes"), w.substr(F.lit(1), n - 2))
        .when(ends("ss", "us", "is"), w)
        .otherwise(w.substr(F.lit(1), n - 1))
    )


def concept_tokens(folded: Column) -> Column:
    """Stemmed words of a folded text in order, stop words out.

    Apostrophes are settled once per text: a possessive `'s` goes, any other
    joins the letters behind it to the word and ends it.
    """
    plain = F.regexp_replace(folded, "([a-z0-9])['’](?:s(?![a-z])|([a-z]+))", "$1$2 ")
    words = F.regexp_extract_all(plain, F.lit("[a-z0-9]+"), F.lit(0))
    return F.filter(F.transform(words, stem), lambda w: (w != "") & ~w.isin(V.STOP_WORDS))


def _stemmed_generic() -> list[str]:
    """The generic words as `stem` leaves them ("studies" -> "study"); none has another ending it touches."""
    return sorted({w[:-3] + "y" if w.endswith("ies") else w for w in V.GENERIC_WORDS})


GENERIC_STEMS = _stemmed_generic()


def significant(tokens: Column) -> Column:
    """Tokens that say something on their own."""
    return F.filter(tokens, lambda w: ~w.isin(GENERIC_STEMS))


def evidence_words(c: Column) -> Column:
    """Words compared when looking for shared interests."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9][a-z0-9-]+"), F.lit(0)))


def clean_topic(c: Column) -> Column:
    """One listed topic without bullets, numbering, quotes or doubled spaces."""
    c = F.regexp_replace(c, r"^[\s\p{Z}\-*•\d.)]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[\"'`]", ""), SPACES, " "))


def dedupe_interests(topics: Column, most: int | None = None, size: int | None = None) -> Column:
    """Cleaned topics in order, the first of a case-insensitive pair.

    With `size` longer topics are left out, with `most` only the first so many stay. Equal topics meet by sorting, so a
    list of any length costs n log n.
    """
    cleaned = F.filter(F.transform(topics, clean_topic), lambda t: (t != "") if size is None else (t != "") & (F.length(t) <= size))
    keyed = F.array_sort(F.transform(cleaned, lambda t, i: F.struct(F.lower(t).alias("key"), i.alias("at"), t.alias("topic"))))

    def firsts(pairs):
        return F.filter(pairs, lambda p, i: (i == 0) | (F.get(pairs, i - 1)["key"] != p["key"]))

    first = F.transform(F.array(keyed), firsts)[0]  # sorted once, however often the filter names it
    kept = F.transform(F.array_sort(F.transform(first, lambda p: F.struct(p["at"], p["topic"]))), lambda p: p["topic"])
    return kept if most is None else F.slice(kept, 1, most)


def topics_from_text(c: Column, words: int = 6) -> Column:
    """Free text split into topics (D5). A part of more than `words` words is a sentence and no topic."""
    parts = F.split(c, r"(?i)[\n,;•]|\band\b|[\s\p{Z}]-[\s\p{Z}]")
    parts = F.transform(parts, lambda p: F.regexp_replace(p, V.LEAD_INS, ""))
    short = F.filter(parts, lambda p: F.size(F.split(F.trim(F.regexp_replace(p, SPACES, " ")), " ")) <= words)
    return dedupe_interests(short)
