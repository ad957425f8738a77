"""Addresses, names, organisations, titles and where a contact detail came from.

Tables: people(person_id, name, institution_id), institution_domains(
institution_id, domain), employments(person_id, org, ror, role, department,
start, current), candidates(person_id, field, value, source, pos).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.ranking import with_row_number
from ..functions.text import (
    SPACES,
    email_fits_name,
    email_host,
    fold,
    name_key,
    name_tokens,
    org_tokens,
    registered_domain,
    unescape_entities,
    url_host,
)

# Java's \b and \s cover all letters and spaces only under (?U).
_SPELLED_DOMAIN = (
    rf"{V.EMAIL_LABEL}(?:(?:\.|\s+dot\s+){V.EMAIL_LABEL}){{0,{V.EMAIL_LABELS}}}(?:\.|\s+dot\s+){V.EMAIL_TLD}"
)
_ADDRESS = rf"(?U)\b{V.EMAIL_LOCAL}+@{V.EMAIL_LABEL}(?:\.{V.EMAIL_LABEL}){{0,{V.EMAIL_LABELS}}}\.{V.EMAIL_TLD}\b"
_GAP = r"[\s\p{Z}]"
_SPELLED_AT = rf"at{_GAP}+[a-z0-9-]+(?:\.[a-z0-9]|{_GAP}+dot{_GAP}|{_GAP}*[\[({{<])|[\[({{<]{_GAP}*at{_GAP}*[\])}}>]"


def may_hold_address(c: Column) -> Column:
    """A sign, an entity, a bracketed "at", or "at" in front of something dotted: every address has one of them."""
    return c.contains("@") | c.rlike("&#?[0-9A-Za-z]+;") | F.lower(c).rlike(_SPELLED_AT)


# --- addresses --------------------------------------------------------------------------------

def plain_addresses(c: Column) -> Column:
    """Obfuscated addresses of an entity-free text written out: [at], (dot), "jane at uni dot edu" (F1)."""
    c = F.regexp_replace(c, r"(?i)\s*[\[({<]\s*at\s*[\])}>]\s*", "@")
    c = F.regexp_replace(c, r"(?i)\s*[\[({<]\s*dot\s*[\])}>]\s*", ".")
    c = F.regexp_replace(c, rf"(?iU)\b({V.EMAIL_LOCAL})\s+at\s+({_SPELLED_DOMAIN})\b", "$1@$2")
    c = F.regexp_replace(c, rf"(?iU)@\s*({_SPELLED_DOMAIN})", "@$1")
    # Spelled-out dots right of an "@": each match starts at the "@" or where the last one ended.
    return F.regexp_replace(
        c,
        rf"(?iU)(@{V.EMAIL_LABEL}|(?!^)\G{V.EMAIL_LABEL})(?:\.|\s+dot\s+)(?=(?:{V.EMAIL_LABEL}(?:\.|\s+dot\s+)){{0,{V.EMAIL_LABELS}}}{V.EMAIL_TLD})",
        "$1.",
    )


def addresses(c: Column) -> Column:
    """Distinct plausible personal addresses of an entity-free text, lower case, in order (F1)."""
    found = F.regexp_extract_all(plain_addresses(c), F.lit(_ADDRESS), F.lit(0))
    found = F.transform(found, lambda e: F.lower(F.trim(e, F.lit("."))))

    def personal(e):
        local = F.substring_index(e, "@", 1)
        image = reduce(lambda a, b: a | b, [e.endswith(x) for x in V.IMAGE_ENDINGS])
        return ~local.isin(V.PLACEHOLDER_LOCALS + V.ROLE_LOCALS) & ~image

    return F.array_distinct(F.filter(found, personal))


def extract_emails(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row per address and text: keys, pos, email (F1).

    Texts without a trace of an address never reach the entity decoder.
    """
    likely = df.where(may_hold_address(F.col(text))).select(*keys, unescape_entities(F.col(text)).alias("_t"))
    return likely.select(*keys, F.posexplode(addresses(F.col("_t"))).alias("pos", "email"))


def with_registered_domain(df: DataFrame, col: str, out: str = "registered_domain") -> DataFrame:
    """Registered domain of a host, an address or a URL (F2)."""
    c = F.col(col)
    host = F.when(c.contains("://"), url_host(c)).when(c.contains("@"), email_host(c)).otherwise(c)
    return df.withColumn(out, registered_domain(host))


def institution_domains(institutions: DataFrame) -> DataFrame:
    """Registered domains an institution is known by: listed ones and its homepage's."""
    listed = F.col("email_domains") if "email_domains" in institutions.columns else F.array().cast("array<string>")
    every = F.array_append(F.coalesce(listed, F.array().cast("array<string>")), registered_domain(url_host(F.col("homepage_url"))))
    return institutions.select("institution_id", F.explode(F.array_compact(every)).alias("domain")).where("domain <> ''").distinct()


def join_email_domain(emails: DataFrame, domains: DataFrame) -> DataFrame:
    """Addresses on a domain of their person's institution (J7). emails(institution_id, email, ...)"""
    keyed = emails.withColumn("domain", registered_domain(email_host(F.col("email"))))
    return keyed.join(domains, ["institution_id", "domain"], "left_semi").drop("domain")


def institutional_urls(urls: DataFrame, domains: DataFrame) -> DataFrame:
    """Links on the institution's own site (J9). urls(institution_id, url, ...)"""
    keyed = urls.withColumn("domain", registered_domain(url_host(F.col("url"))))
    return keyed.join(domains, ["institution_id", "domain"], "left_semi").drop("domain")


def with_name_key(df: DataFrame, col: str, out: str = "name_key") -> DataFrame:
    """First initial and surname of a name column."""
    return df.withColumn(out, name_key(name_tokens(fold(F.col(col)))))


def vet_emails(candidates: DataFrame, people: DataFrame) -> DataFrame:
    """Candidate addresses whose local part fits the person's name (J8). candidates(person_id, email, ...)"""
    names = people.select("person_id", name_tokens(fold(F.col("name"))).alias("_tokens"))
    return candidates.join(names, "person_id").where(email_fits_name(F.col("email"), F.col("_tokens"))).drop("_tokens")


def vetted_emails(texts: DataFrame, people: DataFrame, domains: DataFrame) -> DataFrame:
    """First address in a person's texts that fits both name and institution.

    texts(person_id, text_pos, text)
    """
    found = extract_emails(texts, "text", ["person_id", "text_pos"])
    fitting = vet_emails(found, people).join(people.select("person_id", "institution_id"), "person_id")
    fitting = join_email_domain(fitting, domains)
    return fitting.groupBy("person_id").agg(F.min_by("email", F.struct("text_pos", "pos")).alias("email"))


# --- names and organisations ------------------------------------------------------------------------

def join_directory(people: DataFrame, directory: DataFrame) -> DataFrame:
    """Directory entry of every person by initial and surname; the first entry of a name wins.

    directory(institution_id, entry_pos, name, email, profile_url, title)
    """
    entries = with_name_key(directory, "name").where("name_key IS NOT NULL")
    fields = F.struct(*[F.col(c).alias(f"directory_{c}") for c in directory.columns if c not in ("institution_id", "entry_pos")])
    first = entries.groupBy("institution_id", "name_key").agg(F.min_by(fields, "entry_pos").alias("_e"))
    joined = with_name_key(people, "name").join(first, ["institution_id", "name_key"], "left")
    return joined.select(*people.columns, "_e.*")


def name_classes(left: DataFrame, right: DataFrame, left_id: str, right_id: str, name: str = "name") -> DataFrame:
    """Rows of both sides under the surname and first initial that they share, without forming pairs.

    -> name_key, side (`left` or `right`), id (as text), lefts, rights: how many rows of each side the class has. One row per input
    row whose class has both sides, so a name with very many bearers costs their number and no more.
    """
    sides = [
        with_name_key(df, name).select("name_key", F.lit(side).alias("side"), F.col(i).cast("string").alias("id")).where("name_key IS NOT NULL")
        for df, i, side in ((left, left_id, "left"), (right, right_id, "right"))
    ]
    members = sides[0].unionAll(sides[1])
    return members.join(_class_sizes(members), "name_key")


def _class_sizes(members: DataFrame) -> DataFrame:
    sizes = members.groupBy("name_key").agg(F.count_if(F.col("side") == "left").alias("lefts"), F.count_if(F.col("side") == "right").alias("rights"))
    return sizes.where((F.col("lefts") > 0) & (F.col("rights") > 0))


def match_names(left: DataFrame, right: DataFrame, name: str = "name", most_pairs: int | None = None) -> DataFrame:
    """Pairs of rows of both sides whose surname and first initial agree.

    Right columns come back with the prefix `other_`. A class of m and n rows gives m * n pairs. With `most_pairs` only
    classes of so many pairs or fewer are expanded; `name_classes` has every class, large ones included.
    """
    a = with_name_key(left, name, "_key").where("_key IS NOT NULL")
    b = with_name_key(right, name, "_key").where("_key IS NOT NULL")
    if most_pairs is not None:
        members = a.select(F.col("_key").alias("name_key"), F.lit("left").alias("side")).unionAll(b.select("_key", F.lit("right")))
        small = _class_sizes(members).where(F.col("lefts") * F.col("rights") <= most_pairs).select(F.col("name_key").alias("_key"))
        a, b = a.join(small, "_key", "left_semi"), b.join(small, "_key", "left_semi")
    b = b.select("_key", *[F.col(c).alias(f"other_{c}") for c in right.columns])
    return a.join(b, "_key").drop("_key")


def resolve_entities(candidates: DataFrame) -> DataFrame:
    """Best candidate per query: name overlap, place in the result list, kind.

    candidates(query_id, query, position, candidate_id, candidate, type);
    position counts from 0 and the earlier candidate wins a tie.
    """
    a, b = name_tokens(fold(F.col("query"))), name_tokens(fold(F.col("candidate")))
    tokens = candidates.withColumn("_a", F.array_distinct(a)).withColumn("_b", F.array_distinct(b))
    overlap = F.size(F.array_intersect("_a", "_b")) / F.greatest(F.lit(1), F.size(F.array_union("_a", "_b")))
    scored = tokens.withColumn(
        "match_score",
        F.round(2 * overlap - 0.1 * F.col("position") + F.when(F.col("type") == "education", 0.5).otherwise(0.0), 9),
    )
    return scored.groupBy("query_id").agg(
        F.max_by(F.struct("candidate_id", "match_score"), F.struct("match_score", -F.col("position"))).alias("_b")
    ).select("query_id", "_b.*")


def name_candidates(queries: DataFrame, institutions: DataFrame, share: float = 0.5, names: str = "institution_name") -> DataFrame:
    """Institutions whose name words overlap a query's by `share` (Jaccard) or more, nearest first.

    queries(query_id, query), institutions(institution_id, `names`, type).
    -> query_id, query, position, candidate_id, candidate, type, as `resolve_entities` takes them.

    Equal word sets are one class, however many rows have them. With words in order of rarity, two sets that overlap enough share one of
    their first n - ceil(share * n) + 1 words; classes meet on those and if their sizes allow the overlap, so a
    common word joins only names that have little else. Every pair above the share is found. Names without words match nothing.
    Equal overlaps are placed by institution_id. Cuts a checkpoint.
    """
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")

    def worded(df, text):
        words = F.array_sort(F.array_distinct(name_tokens(fold(F.col(text)))))
        return df.withColumn("_words", words).where(F.size("_words") > 0)

    asked = worded(queries.select("query_id", "query"), "query")
    known = worded(institutions.select(F.col("institution_id").alias("candidate_id"), F.col(names).alias("candidate"), "type"), "candidate")
    classes = [asked.select("_words").distinct(), known.select("_words").distinct()]
    # A word's rank must be the same on both sides, no more; classes of both sides count.
    rank = classes[0].unionAll(classes[1]).select(F.explode("_words").alias("_w")).groupBy("_w").agg(F.count("*").alias("_n"))

    def heads(sets):
        """The first words of each class by rarity, one row each. A class is as long as its name."""
        ranked = sets.select("_words", F.explode("_words").alias("_w")).join(rank, "_w").groupBy("_words").agg(
            F.array_sort(F.collect_list(F.struct("_n", "_w"))).alias("_r")
        )
        # The tolerance keeps a product such as 0.7 * 10 from being taken for more than it is.
        first = F.size("_r") - F.ceil(F.lit(share) * F.size("_r") - 1e-9) + 1
        return ranked.select("_words", F.explode(F.slice(F.col("_r._w"), F.lit(1), first.cast("int"))).alias("_w"))

    left, right = heads(classes[0]).withColumnRenamed("_words", "_a"), heads(classes[1]).withColumnRenamed("_words", "_b")
    sized = (F.size("_a") >= share * F.size("_b") - 1e-9) & (F.size("_b") >= share * F.size("_a") - 1e-9)
    met = left.join(right, "_w").where(sized).select("_a", "_b").distinct()
    near = met.withColumn("_near", F.size(F.array_intersect("_a", "_b")) / F.size(F.array_union("_a", "_b"))).where(F.col("_near") >= share - 1e-9)
    pairs = asked.join(near, asked["_words"] == near["_a"]).drop("_words").join(known, F.col("_b") == known["_words"])
    pairs = pairs.select("query_id", "query", "_near", "candidate_id", "candidate", "type")
    placed = with_row_number(pairs, [F.col("_near").desc(), F.col("candidate_id")], "_place", ["query_id"])
    return placed.select("query_id", "query", (F.col("_place") - 1).alias("position"), "candidate_id", "candidate", "type")


def resolve_names(queries: DataFrame, institutions: DataFrame, share: float = 0.5, names: str = "institution_name") -> DataFrame:
    """The institution that a name means: candidates by their words, then the best of `resolve_entities`.

    queries(query_id, query) -> query_id, candidate_id, match_score; null where no name is near. Queries of the same words are resolved once. Cuts a checkpoint.
    """
    key = F.array_join(F.array_sort(F.array_distinct(name_tokens(fold(F.col("query"))))), " ")
    asked = queries.select("query_id", key.alias("_key"))
    classes = asked.where("_key <> ''").select(F.col("_key").alias("query_id"), F.col("_key").alias("query")).distinct()
    best = resolve_entities(name_candidates(classes, institutions, share, names)).withColumnRenamed("query_id", "_key")
    return asked.join(best, "_key", "left").drop("_key")


def same_organisation(org: Column, ror: Column, names: Column, rors: Column) -> Column:
    """Registry ids decide when both sides have one, else one name's words contain the other's.

    `org` and each of `names` are token arrays; `rors` is an array of ids.
    """
    known = F.filter(F.coalesce(rors, F.array().cast("array<string>")), lambda r: r.isNotNull())
    tail = F.substring_index(F.rtrim(ror, F.lit("/")), "/", -1)
    by_id = F.exists(known, lambda r: F.substring_index(F.rtrim(r, F.lit("/")), "/", -1) == tail)

    def contains(n):
        either = (F.size(F.array_except(n, org)) == 0) | (F.size(F.array_except(org, n)) == 0)
        return (F.size(n) > 0) & either

    by_name = (F.size(org) > 0) & F.exists(names, contains)
    return F.when((F.length(ror) > 0) & (F.size(known) > 0), by_id).otherwise(by_name)


def match_orgs(orgs: DataFrame, institutions: DataFrame) -> DataFrame:
    """Organisation names to institutions: pairs (org_id, institution_id).

    orgs(org_id, org, ror), institutions(institution_id, institution_name, ror).
    Candidates share the rarer side's rarest word, so no pair is formed for the
    common ones; containment is then checked in full.
    """
    a = orgs.select("org_id", F.col("ror").alias("_ror"), org_tokens(fold(F.col("org"))).alias("_org"))
    b = institutions.select(
        "institution_id", F.col("ror").alias("_inst_ror"), org_tokens(fold(F.col("institution_name"))).alias("_name")
    )
    by_id = a.where(F.length("_ror") > 0).withColumn("_tail", F.substring_index(F.rtrim("_ror", F.lit("/")), "/", -1)).join(
        b.where(F.length("_inst_ror") > 0).withColumn("_tail", F.substring_index(F.rtrim("_inst_ror", F.lit("/")), "/", -1)),
        "_tail",
    )
    every_a = a.select("org_id", "_ror", "_org", F.explode("_org").alias("_w"))
    every_b = b.select("institution_id", "_inst_ror", "_name", F.explode("_name").alias("_w"))
    rarity = every_a.select("_w").unionAll(every_b.select("_w")).groupBy("_w").agg(F.count("*").alias("_n"))
    rare_a = every_a.join(rarity, "_w").groupBy("org_id").agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"))
    rare_b = every_b.join(rarity, "_w").groupBy("institution_id").agg(F.min_by("_w", F.struct("_n", "_w")).alias("_w"))
    no_ids = ~((F.length("_ror") > 0) & (F.length("_inst_ror") > 0))
    undecided = F.coalesce(no_ids, F.lit(True))
    inside_org = (
        every_a.join(rare_b.join(b, "institution_id"), "_w").where(undecided & (F.size(F.array_except("_name", "_org")) == 0))
    )
    inside_name = (
        every_b.join(rare_a.join(a, "org_id"), "_w").where(undecided & (F.size(F.array_except("_org", "_name")) == 0))
    )
    pairs = [d.select("org_id", "institution_id") for d in (by_id, inside_org, inside_name)]
    return pairs[0].unionAll(pairs[1]).unionAll(pairs[2]).distinct()


# --- titles and roles ----------------------------------------------------------------------------------

def title_of(c: Column) -> Column:
    """Best academic title in a text: a professorship "of" something, else the longest."""
    found = F.regexp_extract_all(c, F.lit("(?U)" + V.TITLE_PATTERN), F.lit(1))
    tidy = F.transform(found, lambda m: F.trim(F.regexp_replace(m, SPACES, " "), F.lit(" ,-")))
    start = F.struct(F.lit(None).cast("string").alias("best"), F.lit(False).alias("done"))

    def step(acc, m):
        best = acc["best"]
        better = best.isNull() | (
            m.contains("Professor") & ((F.length(m) > F.length(best)) | ~best.contains("Professor"))
        )
        chosen = F.when(~acc["done"] & better, m).otherwise(best)
        return F.struct(
            chosen.alias("best"), (acc["done"] | (chosen.contains("Professor") & chosen.contains(" of "))).alias("done")
        )

    return F.aggregate(tidy, start, step, lambda acc: acc["best"])


def extract_titles(df: DataFrame, text: str, out: str = "title") -> DataFrame:
    """Academic title found in a text column, null when there is none."""
    return df.withColumn(out, title_of(F.col(text)))


def with_role(df: DataFrame, title: str = "title") -> DataFrame:
    """Coarse `role` of a title: the first rule with a matching phrase."""
    padded = F.concat(F.lit(" "), F.lower(F.coalesce(title, F.lit(""))), F.lit(" "))
    role = F.lit(None).cast("string")
    for name, phrases in reversed(V.ROLE_RULES):
        hit = reduce(lambda a, b: a | b, [padded.contains(p) for p in phrases])
        role = F.when(hit, name).otherwise(role)
    return df.withColumn("role", role)


def employment_titles(employments: DataFrame, people: DataFrame, institutions: DataFrame) -> DataFrame:
    """Best title from current jobs at the person's institution, and whether any job is there.

    institutions(institution_id, names array, rors array). -> person_id, title, affiliation
    """
    current = employments.where(F.col("current") & (F.length("org") > 0))
    known = institutions.select("institution_id", F.col("names").alias("_names"), F.col("rors").alias("_rors"))
    # Names of an institution are few: tokenise them as rows, then fold back.
    tokenised = (
        known.select("institution_id", "_rors", F.explode("_names").alias("_n"))
        .select("institution_id", "_rors", org_tokens(fold(F.col("_n"))).alias("_t"))
        .groupBy("institution_id")
        .agg(F.collect_set("_t").alias("_names"), F.first("_rors").alias("_rors"))
    )
    jobs = (
        current.join(people.select("person_id", "institution_id"), "person_id")
        .join(tokenised, "institution_id", "left")
        .withColumn("_org", org_tokens(fold(F.col("org"))))
        .withColumn("_here", F.coalesce(same_organisation(F.col("_org"), F.col("ror"), F.col("_names"), F.col("_rors")), F.lit(False)))
    )
    role = F.lower(F.coalesce("role", F.lit("")))
    place = F.lit(len(V.EMPLOYMENT_ORDER))
    for i, word in reversed(list(enumerate(V.EMPLOYMENT_ORDER))):
        place = F.when(role.contains(word), i).otherwise(place)
    tidy = F.trim(F.regexp_replace("role", SPACES, " "), F.lit(" ,;"))
    tidy = F.when(F.lower(tidy).isin("prof", "prof."), "Professor").otherwise(tidy)
    tidy = F.concat(F.upper(F.substring(tidy, 1, 1)), tidy.substr(F.lit(2), F.length(tidy)))
    department = F.trim(F.regexp_replace("department", SPACES, " "))
    full = F.when(
        (F.length("department") > 0) & ~F.lower(tidy).contains(F.lower("department")), F.concat(tidy, F.lit(", "), department)
    ).otherwise(tidy)
    rank = F.struct(place.alias("o"), (-F.coalesce("start", F.lit(0))).alias("s"), F.col("org").alias("n"), F.col("role").alias("r"), F.col("department").alias("d"))
    return jobs.groupBy("person_id").agg(
        F.min_by(full, F.when(F.col("_here") & (F.length("role") > 0), rank)).alias("title"),
        F.when(F.max("_here"), "match").otherwise("elsewhere").alias("affiliation"),
    )


# --- choosing between sources ------------------------------------------------------------------------------

# Source priority per field, best first.
SOURCE_ORDER = {
    "email": ["directory", "profile_page", "orcid", "paper_affiliation", "europepmc"],
    "title": ["directory", "profile_page", "orcid_employment"],
    "profile_url": ["directory", "orcid_researcher_url", "orcid", "openalex"],
}
ON_DOMAIN = ["profile_page", "orcid", "paper_affiliation", "europepmc"]
NAME_FITS = ["profile_page", "paper_affiliation", "europepmc"]


def resolve_contacts(people: DataFrame, candidates: DataFrame, domains: DataFrame) -> DataFrame:
    """Best address, title and link per person with where each came from.

    candidates(person_id, field, value, source, pos). Addresses from
    pages must fit the name and, when the institution's domains are known, be on
    one; addresses from contact records must be on one; paper addresses need
    both and known domains; researcher links must be on the institution's site.
    """
    tokens = people.select("person_id", "institution_id", name_tokens(fold(F.col("name"))).alias("_tokens"))
    known = domains.select("institution_id").distinct().withColumn("_known", F.lit(True))
    rows = candidates.where(F.length("value") > 0).join(tokens, "person_id").join(known, "institution_id", "left")
    host = F.when(F.col("field") == "email", email_host(F.col("value"))).otherwise(url_host(F.col("value")))
    rows = rows.withColumn("_domain", registered_domain(host))
    ours = domains.select("institution_id", F.col("domain").alias("_domain"), F.lit(True).alias("_ours"))
    rows = rows.join(ours.distinct(), ["institution_id", "_domain"], "left")
    is_ours, has_domains = F.coalesce("_ours", F.lit(False)), F.coalesce("_known", F.lit(False))
    email, source = F.col("field") == "email", F.col("source")
    named = ~source.isin(NAME_FITS) | email_fits_name(F.col("value"), F.col("_tokens"))
    on_site = ~source.isin(ON_DOMAIN) | is_ours | ((source == "profile_page") & ~has_domains)
    good = F.when(email, named & on_site).when(source == "orcid_researcher_url", is_ours).otherwise(F.lit(True))
    priority = F.lit(None).cast("int")
    for field, order in SOURCE_ORDER.items():
        for i, name in enumerate(order):
            priority = F.when((F.col("field") == field) & (source == name), i).otherwise(priority)
    rows = rows.where(good).withColumn("_priority", priority).where("_priority IS NOT NULL")
    rank = F.struct("_priority", "pos", "value")
    best = [
        F.min_by(F.struct("value", "source"), F.when(F.col("field") == f, rank)).alias(f"_{f}") for f in SOURCE_ORDER
    ]
    return rows.groupBy("person_id").agg(*best).select(
        "person_id",
        *[F.col(f"_{f}.value").alias(f) for f in SOURCE_ORDER],
        F.col("_email.source").alias("email_source"),
        F.col("_title.source").alias("title_source"),
        F.col("_profile_url.source").alias("profile_source"),
    )


def with_contact_link(df: DataFrame) -> DataFrame:
    """Web search limited to the institution's site, else with its name."""
    host = F.regexp_replace(url_host(F.col("homepage_url")), r"^www\.", "")
    where = F.when(F.length(host) > 0, F.concat(F.lit("site:"), host)).otherwise(F.col("institution_name"))
    terms = F.concat_ws(" ", F.concat(F.lit('"'), F.coalesce("name", F.lit("")), F.lit('"')), F.when(F.length(where) > 0, where))
    # Spaces as %20, and the marks a URL component keeps.
    encoded = F.url_encode(terms)
    for code, mark in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(mark))
    return df.withColumn("contact_link", F.concat(F.lit("https://www.google.com/search?q="), encoded))
