"""Keyword search, concept matching and profile tags.

Tables: queries(query_id, text); concepts(query_id, concept_pos, concept);
groups(group_id, term_pos, term, narrower): interchangeable terms of a group and
narrower ones; vocabulary(tag, people); synonyms(tag, subfield, keywords array);
person_tags(person_id, pos, tag). Weights are rounded to 9 digits so that ties
are ties on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import store, top_per_group
from ..functions.text import concept_tokens, fold, significant

KEYWORD, SUBFIELD, PREFIX_MATCH = 0.8, 0.6, 0.85
SYNONYM, NARROWER, WORD_BY_WORD = 0.9, 0.75, 0.95
SHORTEST, LONGEST = 5, 32  # letters of a word that begins others; letters of a cut
_CONCEPT = ["query_id", "concept_pos"]


# --- keyword search -------------------------------------------------------------------------------------

def token_index(catalog: DataFrame, *keep: str) -> DataFrame:
    """Words of name, title and publication titles with their place: token, person_id, pos, and the columns `keep`.

    `sources.keyword_index` stores it by word and keeps it up.
    """
    words = F.filter(F.split(F.lower(_person_text(catalog)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return catalog.select("person_id", *keep, F.posexplode(words).alias("pos", "token")).select("token", "person_id", "pos", *keep)


def _person_text(catalog: DataFrame) -> Column:
    titles = [F.array_join("publication_titles", " ")] if "publication_titles" in catalog.columns else []
    return F.concat_ws(" ", "name", "title", *titles)


def keyword_search(catalog: DataFrame, query: str, index: DataFrame | None = None) -> DataFrame:
    """People for a keyword query; order_catalog(..., "relevance") sorts them best first.

    Tier 0: every query word starts a word of the person's text (or, without
    an index, the query is part of the text). Tier 1: the institution's name or
    an area contains the query. -> person_id, tier, first_pos
    """
    needle = query.strip().lower()
    terms = list(dict.fromkeys("".join(c if c.isalnum() else " " for c in needle).split()))
    if index is not None and terms:
        starts = F.array(*[F.when(F.col("token").startswith(w), F.lit(i)) for i, w in enumerate(terms)])
        any_term = F.col("token").startswith(terms[0])
        for w in terms[1:]:
            any_term = any_term | F.col("token").startswith(w)
        hits = (
            index.where(any_term)
            .select("person_id", "pos", F.explode(F.array_compact(starts)).alias("_term"))
            .groupBy("person_id")
            .agg(F.count_distinct("_term").alias("_n"), F.min("pos").alias("first_pos"))
            .where(F.col("_n") == len(terms))
            .select("person_id", F.lit(0).alias("tier"), "first_pos")
        )
    else:
        hits = catalog.where(F.lower(_person_text(catalog)).contains(needle)).select("person_id", F.lit(0).alias("tier"), F.lit(0).alias("first_pos"))
    around = catalog.where(
        F.lower("institution_name").contains(needle) | F.exists("domains", lambda d: F.lower(d).contains(needle))
    ).select("person_id", F.lit(1).alias("tier"), F.lit(0).alias("first_pos"))
    return hits.unionByName(around).groupBy("person_id").agg(F.min(F.struct("tier", "first_pos")).alias("_b")).select("person_id", "_b.*")


# --- concepts ----------------------------------------------------------------------------------------------

def with_concept_tokens(df: DataFrame, col: str, out: str = "tokens") -> DataFrame:
    """Stemmed words of a text and the significant ones among them."""
    return df.withColumn(out, concept_tokens(fold(F.col(col)))).withColumn(f"significant_{out}", significant(F.col(out)))


def parse_concepts(queries: DataFrame) -> DataFrame:
    """Parts of a query; those too short or too general carry a `reason` (T4)."""
    parts = queries.select("query_id", F.posexplode(F.split("text", r"(?i)\s*(?:\+|&|,|;|\band\b)\s*")).alias("concept_pos", "concept"))
    parts = parts.withColumn("concept", F.trim(F.regexp_replace("concept", r"\s+", " "))).where(F.length("concept") > 0)
    parts = with_concept_tokens(parts, "concept", "_t")
    reason = (
        F.when(F.size("_t") == 0, "no words to match")
        .when(F.size("significant__t") == 0, "too general")
        .when(F.length("concept") <= 1, "too short")
    )
    return parts.select("query_id", "concept_pos", "concept", reason.alias("reason"))


def _phrase(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def expand_concepts(concepts: DataFrame, groups: DataFrame) -> DataFrame:
    """Weighted alternatives of every concept (T5).

    Order: the part itself, synonyms and narrower terms of the phrase, of the
    phrase without generic words, then word by word; the first weight of a
    token set wins. -> query_id, concept_pos, alt_pos, label, tokens, weight
    """
    parts = concepts.select(
        *_CONCEPT, F.posexplode(F.split("concept", r"(?i)\s*(?:/|\bor\b)\s*")).alias("part", "phrase")
    ).where(F.length(F.trim("phrase")) > 0)
    parts = with_concept_tokens(parts, "phrase", "t").withColumn("key", _phrase(F.col("t"))).withColumn("sig", _phrase(F.col("significant_t")))
    members = groups.select("group_id", "term_pos", "narrower", _phrase(concept_tokens(fold(F.col("term")))).alias("member"))
    entry = members.where(~F.col("narrower")).select("group_id", F.col("member").alias("lookup")).distinct()

    def lookup(phase, j, word, before, after, factor):
        return F.struct(
            F.lit(phase).alias("phase"), j.alias("j"), word.alias("lookup"), before.alias("before"), after.alias("after"),
            F.lit(factor).alias("factor"),
        )

    none, zero = F.lit(""), F.lit(0)
    by_word = F.transform(
        "t",
        lambda w, i: lookup(
            3, i, w, _phrase(F.slice(F.col("t"), F.lit(1), i)), _phrase(F.slice(F.col("t"), i + 2, F.size("t"))), WORD_BY_WORD
        ),
    )
    lookups = F.concat(
        F.array(lookup(1, zero, F.col("key"), none, none, 1.0)),
        F.when(F.col("sig") != F.col("key"), F.array(lookup(2, zero, F.col("sig"), none, none, 1.0))).otherwise(F.array().cast(
            "array<struct<phase:int,j:int,lookup:string,before:string,after:string,factor:double>>")),
        by_word,
    )
    found = (
        parts.select(*_CONCEPT, "part", F.explode(lookups).alias("l"))
        .select(*_CONCEPT, "part", "l.*")
        .join(entry, "lookup")
        .join(members, "group_id")
        .where(F.col("narrower") | (F.col("member") != F.col("lookup")))
    )
    base = F.when(F.col("narrower"), NARROWER).otherwise(SYNONYM)
    blank = lambda c: F.when(F.length(c) > 0, c)
    alternatives = found.select(
        *_CONCEPT,
        F.struct("part", "phase", "j", "group_id", F.col("narrower").cast("int").alias("n"), "term_pos").alias("_order"),
        F.concat_ws(" ", blank(F.col("before")), "member", blank(F.col("after"))).alias("label"),
        F.round(base * F.col("factor"), 9).alias("weight"),
    )
    # Their labels are made of words, which are folded already.
    alternatives = alternatives.withColumn("tokens", significant(concept_tokens(F.col("label"))))
    itself = parts.select(
        *_CONCEPT,
        F.struct("part", F.lit(0).alias("phase"), F.lit(0).alias("j"), F.lit(0).cast(groups.schema["group_id"].dataType).alias("group_id"),
                 F.lit(0).alias("n"), F.lit(0).cast(groups.schema["term_pos"].dataType).alias("term_pos")).alias("_order"),
        F.col("phrase").alias("label"),
        F.lit(1.0).alias("weight"),
        F.col("significant_t").alias("tokens"),
    )
    every = itself.unionByName(alternatives).where(F.size("tokens") > 0)
    first = every.groupBy(*_CONCEPT, _phrase(F.col("tokens")).alias("_key")).agg(
        F.min_by(F.struct("label", "tokens", "weight"), "_order").alias("_a"), F.min("_order").alias("alt_pos")
    )
    return first.select(*_CONCEPT, "alt_pos", "_a.*")


def word_links(words: DataFrame, tokens: DataFrame) -> DataFrame:
    """Words and the distinct tokens they meet: the same token, or one that a word of five letters or more begins.

    words(_w), tokens(_tok) -> _w, _tok, _same. A token is cut at every length from 5 to 32 and its cuts meet words by equality, so a
    beginning that many tokens share costs nothing unless it is a word itself. Longer words meet by 32 letters and are then compared.
    """
    size = F.length("_tok")
    ends = F.sequence(F.least(size, F.lit(SHORTEST)), F.least(size, F.lit(LONGEST)))
    cuts = tokens.select("_tok").distinct().select("_tok", F.explode(ends).alias("_end"))
    cuts = cuts.select("_tok", F.col("_tok").substr(F.lit(1), F.col("_end")).alias("_cut"))
    wanted = words.select("_w").distinct().withColumn("_cut", F.substring("_w", 1, LONGEST))
    return cuts.join(wanted, "_cut").where(F.col("_tok").startswith(F.col("_w"))).select("_w", "_tok", (F.col("_w") == F.col("_tok")).alias("_same"))


def phrase_matches(alternatives: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """How well each alternative's words occur in each text: all words 1, some as prefixes 0.85.

    texts(*keys, text). Words of five letters or more also match longer words
    they start. Prefixes meet the distinct tokens only (`word_links`); texts then join the linked tokens on
    equality, and each text comes to a word's alternatives once.
    """
    alts = alternatives.withColumn("_words", F.array_distinct("tokens"))
    words = alts.select(*_CONCEPT, "alt_pos", "label", "weight", F.size("_words").alias("_n"), F.explode("_words").alias("_w"))
    tokens = texts.select(*keys, F.explode(F.array_distinct(concept_tokens(fold(F.col("text"))))).alias("_tok"))
    met = tokens.join(word_links(words, tokens), "_tok").groupBy(*keys, "_w").agg(F.max("_same").alias("_same"))
    counted = words.join(met, "_w").groupBy(*_CONCEPT, "alt_pos", "label", "weight", "_n", *keys).agg(
        F.count_distinct("_w").alias("_any"), F.count_distinct(F.when(F.col("_same"), F.col("_w"))).alias("_exact")
    )
    return counted.where(F.col("_any") == F.col("_n")).select(
        *_CONCEPT, "alt_pos", "label", "weight", *keys, F.when(F.col("_exact") == F.col("_n"), 1.0).otherwise(PREFIX_MATCH).alias("fit")
    )


def rarity(people: Column, total: Column) -> Column:
    """1 for a rare tag, 0.5 for one that half of the people or more carry."""
    share = people / total
    return F.when((F.coalesce(people, F.lit(0)) == 0) | (F.coalesce(total, F.lit(0)) == 0), 1.0).when(share >= 0.5, 0.5).otherwise(1 - share)


def with_total(vocabulary: DataFrame, total: int | None = None) -> DataFrame:
    """The number of people the rarity of a tag is measured against, as a column."""
    most = vocabulary.agg(F.max("people")).first()[0] or 0  # one number
    return vocabulary.withColumn("total", F.lit(max(total or 0, most, 1)))


def concept_tags(alternatives: DataFrame, vocabulary: DataFrame, synonyms: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """Tags every concept reaches, with weight and what they were reached through.

    -> query_id, concept_pos, tag, weight, via
    """
    vocabulary = with_total(vocabulary.select("tag", "people"), total)
    texts = vocabulary.select("tag", F.lit(0).alias("_kind"), F.lit(0).alias("_i"), F.col("tag").alias("text"))
    if synonyms is not None:
        known = synonyms.join(vocabulary.select("tag"), "tag", "left_semi")
        texts = texts.unionByName(known.select("tag", F.lit(1).alias("_kind"), F.posexplode("keywords").alias("_i", "text")))
        texts = texts.unionByName(
            known.where(F.length("subfield") > 0).select("tag", F.lit(2).alias("_kind"), F.lit(0).alias("_i"), F.col("subfield").alias("text"))
        )
    fits = phrase_matches(alternatives, texts, ["tag", "_kind", "_i", "text"])
    factor = F.when(F.col("_kind") == 0, 1.0).when(F.col("_kind") == 1, KEYWORD).otherwise(SUBFIELD)
    # A name that fits always beats keywords and subfield: it is at least 0.85 of the weight.
    order = F.struct(F.when(F.col("_kind") == 0, 1).otherwise(0).alias("name"), F.col("w"), (-F.col("_kind")).alias("k"), (-F.col("_i")).alias("i"))
    via = F.when((F.col("_kind") == 0) & (F.col("weight") == 1), F.lit(None).cast("string")).when(F.col("_kind") == 0, F.col("label")).otherwise(F.col("text"))
    per_alt = (
        fits.withColumn("w", F.round(F.col("fit") * F.col("weight") * factor, 9))
        .groupBy(*_CONCEPT, "alt_pos", "tag")
        .agg(F.max_by(F.struct("w", via.alias("via")), order).alias("_b"))
    )
    best = per_alt.groupBy(*_CONCEPT, "tag").agg(
        F.max("_b.w").alias("_w"), F.min_by("_b.via", F.struct((-F.col("_b.w")).alias("w"), "alt_pos")).alias("via")
    )
    return best.join(vocabulary, "tag").select(
        *_CONCEPT, "tag", F.round(F.col("_w") * rarity(F.col("people"), F.col("total")), 9).alias("weight"), "via"
    )


def position_strength(pos: Column) -> Column:
    """A person's first tag counts in full, later ones progressively less."""
    return 1 / (1 + 0.15 * pos)


def score_concepts(
    person_tags: DataFrame,
    reached: DataFrame,
    concepts: DataFrame,
    catalog: DataFrame | None = None,
    alternatives: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """People scored per query, and the evidence per concept.

    Scores are means over all concepts of the query; a person without tags is
    scored by research areas, and by title where no area fits (`catalog`:
    person_id, domains, title).
    -> (query_id, person_id, score, matched), (…, concept_pos, tag, via, hit)
    """
    tags = person_tags.select("person_id", "pos", "tag", F.lower("tag").alias("_key"))
    wanted = reached.select(*_CONCEPT, F.lower("tag").alias("_key"), "weight", "via")
    hits = tags.join(wanted, "_key").select(
        *_CONCEPT, "person_id", "pos", "tag", "via", F.round(F.col("weight") * position_strength(F.col("pos")), 9).alias("hit")
    )
    if catalog is not None and alternatives is not None:
        tagless = catalog.join(person_tags.select("person_id"), "person_id", "left_anti")
        places = tagless.select("person_id", F.posexplode("domains").alias("pos", "text"))
        fits = phrase_matches(alternatives, places.select("text").distinct(), ["text"])
        areas = fits.groupBy(*_CONCEPT, "text").agg(F.max(F.col("fit") * F.col("weight")).alias("w"))
        by_area = places.join(areas, "text").select(
            *_CONCEPT, "person_id", "pos", F.col("text").alias("tag"), F.lit(None).cast("string").alias("via"),
            F.round(F.col("w") * SUBFIELD * position_strength(F.col("pos")), 9).alias("hit"),
        )
        titled = tagless.where(F.length("title") > 0).select("person_id", F.col("title").alias("text"))
        title_fits = phrase_matches(alternatives, titled.select("text").distinct(), ["text"])
        titles = title_fits.groupBy(*_CONCEPT, "text").agg(F.max(F.col("fit") * F.col("weight")).alias("w"))
        by_title = (
            titled.join(titles, "text")
            .join(by_area.select(*_CONCEPT, "person_id"), [*_CONCEPT, "person_id"], "left_anti")
            .select(*_CONCEPT, "person_id", F.lit(0).alias("pos"), F.col("text").alias("tag"), F.lit("title").alias("via"),
                    F.round(F.col("w") * 0.4, 9).alias("hit"))
        )
        hits = hits.unionByName(by_area).unionByName(by_title)
    order = F.struct("hit", (-F.col("pos")).alias("p"), "tag")
    best = hits.groupBy(*_CONCEPT, "person_id").agg(F.max_by(F.struct("tag", "via", "hit"), order).alias("_b")).select(
        *_CONCEPT, "person_id", "_b.*"
    )
    sizes = concepts.groupBy("query_id").agg(F.count("*").alias("_concepts"))
    scores = (
        best.groupBy("query_id", "person_id")
        .agg(F.sum("hit").alias("_sum"), F.count("*").alias("matched"))
        .join(sizes, "query_id")
        .select("query_id", "person_id", F.round(F.col("_sum") / F.col("_concepts"), 6).alias("score"), "matched", F.col("_concepts").alias("concepts"))
    )
    return scores, best


def combine_concepts(scores: DataFrame, mode: str = "all") -> DataFrame:
    """People matched by every concept of the query, or by any."""
    return scores.where(F.col("matched") >= (F.lit(1) if mode == "any" else F.col("concepts")))


def concept_reach(reached: DataFrame, examples: int = 6) -> DataFrame:
    """Tags per concept and the best examples."""
    counts = reached.groupBy(*_CONCEPT).agg(F.count("*").alias("tags"))
    best = top_per_group(reached, _CONCEPT, [F.col("weight").desc(), F.col("tag").asc()], examples, "_k")
    names = best.groupBy(*_CONCEPT).agg(F.array_sort(F.collect_list(F.struct("_k", "tag"))).alias("_e"))
    return counts.join(names, _CONCEPT).select(*_CONCEPT, "tags", F.col("_e.tag").alias("examples"))


# --- profiles ---------------------------------------------------------------------------------------------------

def profile_tags(
    profiles: DataFrame,
    vocabulary: DataFrame,
    synonyms: DataFrame | None = None,
    total: int | None = None,
    limit: int | None = 12,
    share: float | None = 0.2,
) -> DataFrame:
    """Vocabulary tags whose significant words all occur in a profile, rarer first.

    profiles(profile_id, interests, summary, text). T10's own rule leaves out
    tags that more than `share` of the people carry and keeps the best `limit`
    of a profile; with None for both every tag stays. A tag meets only profiles that hold its
    rarest word, then containment is checked in full. The words of the profiles that tags need are
    written once beside the checkpoints.
    """
    vocabulary = with_total(vocabulary.select("tag", "people"), total)
    if share is not None:
        vocabulary = vocabulary.where(F.col("people") / F.col("total") <= share)
    names = vocabulary.select("tag", F.lit(1.0).alias("factor"), F.col("tag").alias("text"))
    if synonyms is not None:
        known = synonyms.join(vocabulary.select("tag"), "tag", "left_semi")
        names = names.unionByName(known.select("tag", F.lit(0.7).alias("factor"), F.explode("keywords").alias("text")))
    names = names.withColumn("_list", significant(concept_tokens(fold(F.col("text"))))).where(F.size("_list") > 0)
    names = names.select("tag", "factor", F.size("_list").alias("_len"), F.array_distinct("_list").alias("_needed")).distinct()

    said = significant(concept_tokens(fold(F.array_join(F.coalesce("interests", F.array().cast("array<string>")), " . "))))
    told = significant(concept_tokens(fold(F.concat_ws(" ", "summary", "text"))))
    needed = names.select("tag", "factor", "_len", "_needed", F.explode("_needed").alias("_w"))

    def marked(words: Column, listed: bool) -> Column:
        none = F.array().cast("array<string>")
        return F.transform(F.array_distinct(F.coalesce(words, none)), lambda w: F.struct(w.alias("_w"), F.lit(listed).alias("_said")))

    # One row per word of a profile; no row carries a whole text.
    words = store(
        profiles.select("profile_id", F.explode(F.concat(marked(said, True), marked(told, False))).alias("_p"))
        .select("profile_id", "_p.*")
        .join(needed.select("_w").distinct(), "_w", "left_semi")
        .groupBy("profile_id", "_w")
        .agg(F.max("_said").alias("_said"))
    )
    held = words.groupBy("_w").agg(F.count("*").alias("_profiles"))
    rarest = (
        needed.join(held, "_w", "left")
        .groupBy("tag", "factor", "_len", "_needed")
        .agg(F.min_by("_w", F.struct(F.coalesce("_profiles", F.lit(0)), "_w")).alias("_w"))
    )
    met = words.select("profile_id", "_w").join(rarest, "_w")
    every = met.select("profile_id", "tag", "factor", "_len", F.size("_needed").alias("_n"), F.explode("_needed").alias("_w"))
    met = (
        every.join(words, ["profile_id", "_w"])
        .groupBy("profile_id", "tag", "factor", "_len", "_n")
        .agg(F.count("*").alias("_held"), F.count_if("_said").alias("_listed"))
        .where(F.col("_held") == F.col("_n"))
    )
    in_interests = F.col("_listed") == F.col("_n")
    fit = F.when(in_interests, 2 * F.col("factor")).otherwise(F.col("factor") * F.least(F.lit(1.0), 0.5 + 0.25 * F.col("_len")))
    best = met.groupBy("profile_id", "tag").agg(F.max(fit).alias("_fit")).join(vocabulary, "tag")
    scored = best.select(
        "profile_id", "tag", F.round(F.col("_fit") * rarity(F.col("people"), F.col("total")), 9).alias("weight")
    )
    order = [F.col("weight").desc(), F.col("tag").asc()]
    if limit is None:
        return scored.withColumn("tag_rank", F.row_number().over(Window.partitionBy("profile_id").orderBy(*order)))  # the vocabulary at most
    return top_per_group(scored, ["profile_id"], order, limit, "tag_rank")


def profile_overlap(tags: DataFrame, person_tags: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Overlap 0-1 of a person's tags with a profile's (T11). tags(profile_id, tag, weight)

    With `pairs(profile_id, person_id)` only those are scored: each pair meets
    the profile's few tags, so a tag that many people carry costs nothing extra.
    """
    most = tags.groupBy("profile_id").agg(F.max("weight").alias("_max"))
    wanted = tags.join(most, "profile_id").select("profile_id", F.lower("tag").alias("_key"), (F.col("weight") / F.col("_max")).alias("_share"))
    carried = person_tags.select("person_id", "pos", F.lower("tag").alias("_key"))
    if pairs is None:
        met = carried.join(wanted, "_key")
    else:
        met = pairs.select("profile_id", "person_id").join(wanted, "profile_id").join(carried, ["person_id", "_key"])
    return met.groupBy("profile_id", "person_id").agg(
        F.round(F.least(F.lit(1.0), F.sum(F.col("_share") * position_strength(F.col("pos"))) / 2), 6).alias("overlap")
    )


def suggest_tags(tags: DataFrame, used: DataFrame, n: int = 8) -> DataFrame:
    """A profile's best tags that are not in use as concepts yet (T12). used(profile_id, concept)"""
    taken = used.select("profile_id", F.lower("concept").alias("_key"))
    fresh = tags.withColumn("_key", F.lower("tag")).join(taken, ["profile_id", "_key"], "left_anti")
    return top_per_group(fresh, ["profile_id"], [F.col("weight").desc(), F.col("tag").asc()], n, "place").select(
        "profile_id", "place", "tag", "weight"
    )
