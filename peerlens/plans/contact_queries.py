"""Queries on addresses, names, organisations, pages and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_label
from ..operators import contacts as C
from ..operators import pages as G
from ..operators import profiles as R
from ..operators import works as W
from .bindings import Tables
from .people_queries import records
from .registry import query

ADDRESS_SQL = r"""'[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}\b'"""


@query(
    "emails_in_documents", "F1",
    f"SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, {ADDRESS_SQL}))) AS email FROM documents",
)
def _(t: Tables):
    return C.extract_emails(t.texts("documents"), "text", ["doc_id"]).select("doc_id", "email")


@query(
    "emails_in_conversations_and_pages", "F1",
    f"""SELECT DISTINCT 'page' AS kind, page_id AS id, lower(unnest(regexp_extract_all(html, {ADDRESS_SQL}))) AS email FROM pages
    UNION SELECT DISTINCT 'turn', conv_id, lower(unnest(regexp_extract_all(text, {ADDRESS_SQL}))) FROM conversations""",
)
def _(t: Tables):
    texts = t.texts("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    texts = texts.unionByName(t.texts("conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), "text"))
    return C.extract_emails(texts, "text", ["kind", "id"]).select("kind", "id", "email").distinct()


def spelled_addresses(t: Tables):
    """Supplier addresses written in different disguises inside a sentence."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    local, host = F.concat(F.lit("s"), k), F.concat(F.lit("nation"), n)
    forms = [
        F.concat(local, F.lit(" [at] "), host, F.lit(" [dot] ac [dot] uk")),
        F.concat(local, F.lit("(at)"), host, F.lit("(dot)ac.uk")),
        F.concat(local, F.lit(" at "), host, F.lit(" dot ac dot uk")),
        F.concat(local, F.lit("&#64;"), host, F.lit(".ac.uk")),
        F.concat(local, F.lit(" {AT} "), host, F.lit(" dot ac dot uk")),
        F.concat(F.lit("info@"), host, F.lit(".ac.uk")),
    ]
    form = forms[-1]
    for i, f in enumerate(forms[:-1]):
        form = F.when(k % 6 == i, f).otherwise(form)
    return t.raw("supplier").select(
        k.alias("person_id"), n.alias("institution_id"), F.lit(0).alias("text_pos"),
        F.concat(F.lit("Professor at the university, write to: "), form, F.lit(". Office hours at noon.")).alias("text"),
    )


@query(
    "disguised_emails", "F1",
    "SELECT s_suppkey AS person_id, 's' || s_suppkey || '@nation' || s_nationkey || '.ac.uk' AS email FROM supplier WHERE s_suppkey % 6 < 5",
)
def _(t: Tables):
    return C.extract_emails(spelled_addresses(t), "text", ["person_id"]).select("person_id", "email")


@query(
    "vetted_emails", "F10 J7 J8",
    """SELECT s_suppkey AS person_id, 's' || s_suppkey || '@nation' || s_nationkey || '.ac.uk' AS email FROM supplier
    WHERE s_suppkey % 6 < 5 AND s_suppkey % 2 = 0 AND s_nationkey < 20""",
)
def _(t: Tables):
    # The local part is one letter and digits, so only people with those initials fit: "S." names do not, "S. S." neither.
    people = t.raw("supplier").select(
        F.col("s_suppkey").alias("person_id"), F.col("s_nationkey").alias("institution_id"),
        F.when(F.col("s_suppkey") % 2 == 0, "Ann Ssmith").otherwise("Bo Xu").alias("name"),
    )
    texts = spelled_addresses(t).withColumn("text", F.regexp_replace("text", r"\bs(\d+)", "ssmith$1"))
    # Institutions from 20 on stand for those without known domains, so that their addresses are refused; no bound of the operators.
    domains = C.institution_domains(t.institutions.where("institution_id < 20"))
    found = C.vetted_emails(texts, people, domains)
    return found.withColumn("email", F.regexp_replace("email", "^ssmith", "s"))


DOMAIN_SQL = """, hosts AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?]+)', 1)) AS host FROM pages),
  labels_ AS (SELECT page_id, string_split(regexp_replace(host, '^www\\.', ''), '.') AS p FROM hosts)
SELECT page_id, CASE WHEN len(p) >= 3 AND p[-2] IN ('ac', 'edu', 'co', 'com', 'org', 'gov', 'net') AND len(p[-1]) = 2
  THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS registered_domain FROM labels_"""


@query("registered_domains", "F2", DOMAIN_SQL)
def _(t: Tables):
    return C.with_registered_domain(t.texts("pages"), "url").select("page_id", "registered_domain")


# Names: whole texts, folded, letters only.
NAMES_SQL = """, words AS (
  SELECT doc_id, text AS name, lang, source, n_chars FROM documents),
tok AS (SELECT *, list_filter(regexp_split_to_array(strip_accents(lower(name)), '[^a-z]+'), lambda x: x <> '' AND x NOT IN
  ('dr','prof','professor','mr','mrs','ms','sir','dame','phd','md','frs','jr','sr')) AS tk FROM words),
keyed AS (SELECT *, CASE WHEN len(tk) > 0 THEN substr(tk[1], 1, 1) || '|' || tk[-1] END AS name_key FROM tok),
bench AS (SELECT item_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^a-z]+'), lambda x: x <> '' AND x NOT IN
  ('dr','prof','professor','mr','mrs','ms','sir','dame','phd','md','frs','jr','sr')) AS tk FROM benchmark),
bkeyed AS (SELECT item_id, CASE WHEN len(tk) > 0 THEN substr(tk[1], 1, 1) || '|' || tk[-1] END AS name_key FROM bench)
"""


def named_documents(t: Tables):
    return t.texts("documents").select("doc_id", F.col("text").alias("name"), "lang", "source", "n_chars")


def named_benchmark(t: Tables):
    return t.raw("benchmark").select("item_id", F.col("text").alias("name"))


@query("name_keys", "F3", NAMES_SQL + "SELECT doc_id, name_key FROM keyed")
def _(t: Tables):
    return C.with_name_key(named_documents(t), "name").select("doc_id", "name_key")


@query(
    "directory_join", "J3",
    NAMES_SQL + """, dir AS (SELECT lang, name_key, min(doc_id) AS entry FROM keyed WHERE doc_id % 3 = 0 AND name_key IS NOT NULL GROUP BY ALL)
    SELECT k.doc_id AS person_id, 'e' || entry AS directory_email FROM keyed k LEFT JOIN dir USING (lang, name_key)""",
)
def _(t: Tables):
    docs = named_documents(t)
    people = docs.select(F.col("doc_id").alias("person_id"), "name", F.col("lang").alias("institution_id"))
    directory = docs.where("doc_id % 3 = 0").select(
        F.col("lang").alias("institution_id"), F.col("doc_id").alias("entry_pos"), "name",
        F.concat(F.lit("e"), "doc_id").alias("email"),
    )
    return C.join_directory(people, directory).select("person_id", "directory_email")


@query("matching_names", "J4", NAMES_SQL + "SELECT item_id, doc_id AS other_doc_id FROM bkeyed JOIN keyed USING (name_key)")
def _(t: Tables):
    return C.match_names(named_benchmark(t), named_documents(t)).select("item_id", "other_doc_id")


@query(
    "name_classes", "J4",
    NAMES_SQL + """, members AS (SELECT name_key, 'left' AS side, CAST(item_id AS VARCHAR) AS id FROM bkeyed WHERE name_key IS NOT NULL
      UNION ALL SELECT name_key, 'right', CAST(doc_id AS VARCHAR) FROM keyed WHERE name_key IS NOT NULL)
    SELECT name_key, side, id, count(*) FILTER (side = 'left') OVER w AS lefts, count(*) FILTER (side = 'right') OVER w AS rights FROM members
    WINDOW w AS (PARTITION BY name_key) QUALIFY lefts > 0 AND rights > 0""",
)
def _(t: Tables):
    return C.name_classes(named_benchmark(t), named_documents(t), "item_id", "doc_id")


@query(
    "resolved_entities", "J5",
    """, freq AS (SELECT l_suppkey AS q, p_name, p_type, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    cand AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY n DESC, p_name, p_type) - 1 AS pos FROM freq QUALIFY pos < 5),
    target AS (SELECT q, min(p_name) || ' ring' AS name FROM freq GROUP BY 1),
    sets AS (SELECT q, pos, p_name || '/' || p_type AS candidate_id, p_type, list_distinct(string_split(name, ' ')) AS a, string_split(p_name, ' ') AS b FROM cand JOIN target USING (q)),
    sc AS (SELECT q, pos, candidate_id, round(2.0 * len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) - 0.1 * pos
       + CASE WHEN p_type = 'PROMO' THEN 0.5 ELSE 0 END, 9)::DOUBLE AS match_score FROM sets)
    SELECT q AS query_id, candidate_id, match_score FROM sc QUALIFY row_number() OVER (PARTITION BY q ORDER BY match_score DESC, pos) = 1""",
)
def _(t: Tables):
    from ..functions.ranking import top_per_group

    freq = t.author_topics.groupBy(F.col("person_id").alias("query_id"), "topic", "subfield").agg(F.sum("n").alias("n"))
    five = top_per_group(freq, ["query_id"], [F.col("n").desc(), F.col("topic"), F.col("subfield")], 5, "place")
    names = freq.groupBy("query_id").agg(F.concat(F.min("topic"), F.lit(" ring")).alias("query"))
    candidates = five.join(names, "query_id").select(
        "query_id", "query", (F.col("place") - 1).alias("position"),
        F.concat_ws("/", "topic", "subfield").alias("candidate_id"), F.col("topic").alias("candidate"),
        F.when(F.col("subfield") == "PROMO", "education").otherwise("company").alias("type"),
    )
    return C.resolve_entities(candidates).select("query_id", "candidate_id", "match_score")


@query(
    "resolved_names", "J5",
    """, target AS (SELECT l_suppkey AS query_id, min(p_name) || ' ring' AS name FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
    asked AS (SELECT name, list_distinct(string_split(name, ' ')) AS a FROM (SELECT DISTINCT name FROM target)),
    known AS (SELECT DISTINCT p_name || '/' || p_type AS candidate_id, p_type, list_distinct(string_split(p_name, ' ')) AS b FROM part),
    near AS (SELECT *, len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE AS share FROM asked, known),
    spots AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY share DESC, candidate_id) - 1 AS pos FROM near WHERE share >= 0.5),
    best AS (SELECT name, candidate_id, round(2 * share - 0.1 * pos + CASE WHEN p_type = 'PROMO' THEN 0.5 ELSE 0 END, 9) AS match_score FROM spots
      QUALIFY row_number() OVER (PARTITION BY name ORDER BY match_score DESC, pos) = 1)
    SELECT query_id, candidate_id, match_score FROM target LEFT JOIN best USING (name)""",
)
def _(t: Tables):
    names = t.author_topics.groupBy(F.col("person_id").alias("query_id")).agg(F.concat(F.min("topic"), F.lit(" ring")).alias("query"))
    known = t.author_topics.select("topic", "subfield").distinct().select(
        F.concat_ws("/", "topic", "subfield").alias("institution_id"), F.col("topic").alias("institution_name"),
        F.when(F.col("subfield") == "PROMO", "education").otherwise("company").alias("type"),
    )
    return C.resolve_names(names, known)


@query(
    "matching_organisations", "J6",
    """, o AS (SELECT DISTINCT p_name || '/' || p_type AS org_id, list_filter(string_split(p_name || ' ' || lower(p_type), ' '), lambda x: true) AS a,
        CASE WHEN p_type = 'PROMO' THEN 'promo ' || p_name END AS ror FROM part),
    i AS (SELECT DISTINCT p_name AS institution_id, string_split(p_name, ' ') AS b, CASE WHEN p_name < 'l' THEN 'promo ' || p_name END AS ror FROM part)
    SELECT org_id, institution_id FROM o, i WHERE CASE WHEN o.ror IS NOT NULL AND i.ror IS NOT NULL THEN o.ror = i.ror
      ELSE list_has_all(a, b) OR list_has_all(b, a) END""",
)
def _(t: Tables):
    names = t.raw("part").select("p_name", "p_type").distinct()
    orgs = names.select(
        F.concat_ws("/", "p_name", "p_type").alias("org_id"),
        F.concat_ws(" ", F.lit("University of"), "p_name", "p_type").alias("org"),
        F.when(F.col("p_type") == "PROMO", F.concat(F.lit("https://ror.org/promo "), "p_name")).alias("ror"),
    )
    institutions = names.select("p_name").distinct().select(
        F.col("p_name").alias("institution_id"), F.concat(F.lit("The "), "p_name").alias("institution_name"),
        F.when(F.col("p_name") < "l", F.concat(F.lit("promo "), "p_name")).alias("ror"),
    )
    return C.match_orgs(orgs, institutions)


def address_events(t: Tables):
    """Addresses seen in events; a third are on the domain of another nation."""
    u, e = F.col("user_id"), F.col("event_id")
    return t.raw("events").select(
        u.alias("person_id"), (u % 25).cast("int").alias("institution_id"), e.alias("pos"),
        F.concat(F.when(e % 2 == 0, "ulla.").otherwise("xy."), u, F.lit("@cs.nation"), F.when(e % 3 == 0, (u + e) % 25).otherwise(u % 25), F.lit(".ac.uk")).alias("email"),
        F.concat(F.lit("https://www.nation"), F.when(e % 3 == 0, (u + e) % 25).otherwise(u % 25), F.lit(".ac.uk:8080/~u"), e).alias("url"),
    )


SEEN_SQL = """, seen AS (SELECT user_id AS person_id, user_id % 25 AS institution_id, event_id AS pos, event_id % 2 = 0 AS named,
  event_id % 3 <> 0 OR (user_id + event_id) % 25 = user_id % 25 AS ours,
  CASE WHEN event_id % 2 = 0 THEN 'ulla.' ELSE 'xy.' END || user_id || '@cs.nation' || CASE WHEN event_id % 3 = 0 THEN (user_id + event_id) % 25 ELSE user_id % 25 END || '.ac.uk' AS email FROM events)
"""


@query("emails_on_institution_domain", "J7", SEEN_SQL + "SELECT person_id, count(*) AS n, min(email) AS email FROM seen WHERE ours GROUP BY 1")
def _(t: Tables):
    on = C.join_email_domain(address_events(t), C.institution_domains(t.institutions))
    return on.groupBy("person_id").agg(F.count("*").alias("n"), F.min("email").alias("email"))


@query("emails_fitting_names", "J8", SEEN_SQL + "SELECT person_id, count(*) AS n, max(email) AS email FROM seen WHERE named GROUP BY 1")
def _(t: Tables):
    people = t.raw("events").select(F.col("user_id").alias("person_id"), F.lit("Prof. Ulla O'Neil").alias("name")).distinct()
    fit = C.vet_emails(address_events(t).select("person_id", "email"), people)
    return fit.groupBy("person_id").agg(F.count("*").alias("n"), F.max("email").alias("email"))


@query("links_on_institution_site", "J9", SEEN_SQL + "SELECT institution_id, count(*) AS n FROM seen WHERE ours GROUP BY 1")
def _(t: Tables):
    on = C.institutional_urls(address_events(t), C.institution_domains(t.institutions))
    return on.groupBy("institution_id").agg(F.count("*").alias("n"))


@query(
    "resolved_contacts", "F9",
    SEEN_SQL + """, c AS (SELECT s.*, CASE pos % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'email' WHEN 2 THEN 'title' ELSE 'profile_url' END AS field, event_type AS et, event_id
       FROM seen s JOIN events ON event_id = pos),
    e AS (SELECT person_id, email, pos, CASE et WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS pr FROM c WHERE field = 'email'
       AND CASE et WHEN 'view' THEN pos % 50 < 2 WHEN 'click' THEN named AND ours WHEN 'purchase' THEN ours ELSE named AND ours END),
    em AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY pr, pos) = 1),
    ti AS (SELECT person_id, 'Title ' || pos AS title, CASE et WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS pr FROM c WHERE field = 'title'
       AND (et <> 'view' OR pos % 50 = 2) AND et IN ('view', 'click', 'purchase')
       QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY pr, pos) = 1)
    SELECT person_id, em.email, title, CASE em.pr WHEN 0 THEN 'directory' WHEN 1 THEN 'profile_page' WHEN 2 THEN 'orcid' WHEN 3 THEN 'paper_affiliation' WHEN 4 THEN 'europepmc' END AS email_source,
      CASE ti.pr WHEN 0 THEN 'directory' WHEN 1 THEN 'profile_page' WHEN 2 THEN 'orcid_employment' END AS title_source
    FROM em FULL JOIN ti USING (person_id)""",
)
def _(t: Tables):
    seen = address_events(t).join(t.raw("events").select(F.col("event_id").alias("pos"), "event_type"), "pos")
    slot = F.col("pos") % 5
    field = F.when(slot < 2, "email").when(slot == 2, "title").otherwise("profile_url")
    e = F.col("event_type")
    source = (
        F.when(e == "view", "directory").when(e == "click", "profile_page")
        .when(e == "purchase", F.when(field == "email", "orcid").when(field == "title", "orcid_employment").otherwise("orcid"))
        .when(e == "signup", "paper_affiliation").otherwise("europepmc")
    )
    value = F.when(slot < 2, F.col("email")).when(slot == 2, F.concat(F.lit("Title "), "pos")).otherwise(F.col("url"))
    candidates = seen.select("person_id", field.alias("field"), value.alias("value"), source.alias("source"), "pos")
    candidates = candidates.where((F.col("source") != "directory") | (F.col("field") == "profile_url") | (F.col("pos") % 50 < 5))
    people = seen.select("person_id", "institution_id", F.lit("Ulla Neil").alias("name")).distinct()
    out = C.resolve_contacts(people, candidates, C.institution_domains(t.institutions))
    return out.select("person_id", "email", "title", "email_source", "title_source").where("email IS NOT NULL OR title IS NOT NULL")


@query(
    "employment_titles", "W10",
    """, jobs AS (SELECT l_suppkey AS person_id, s_nationkey, l_orderkey % 25 AS org, l_returnflag AS f, year(l_shipdate) AS y,
        'Dept ' || l_linenumber AS dep FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'O'),
    best AS (SELECT person_id, CASE f WHEN 'A' THEN 'Professor' ELSE 'Senior lecturer' END || ', ' || dep AS title FROM jobs
       WHERE org = s_nationkey AND f <> 'R' QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY f, y DESC, dep) = 1)
    SELECT person_id, title, CASE WHEN max(org = s_nationkey) THEN 'match' ELSE 'elsewhere' END AS affiliation
    FROM jobs LEFT JOIN best USING (person_id) GROUP BY person_id, title""",
)
def _(t: Tables):
    jobs = t.raw("lineitem").select(
        F.col("l_suppkey").alias("person_id"),
        F.concat(F.lit("University of NATION_"), F.col("l_orderkey") % 25).alias("org"),
        F.lit(None).cast("string").alias("ror"),
        F.when(F.col("l_returnflag") == "A", " Prof. ").when(F.col("l_returnflag") == "N", "senior  lecturer").alias("role"),
        F.concat(F.lit("Dept "), "l_linenumber").alias("department"),
        F.year("l_shipdate").alias("start"),
        (F.col("l_linestatus") == "O").alias("current"),
    )
    jobs = jobs.withColumn("role", F.when(F.col("role") == " Prof. ", "professor").otherwise(F.col("role")))
    names = t.institutions.select("institution_id", F.array("institution_name").alias("names"), F.array().cast("array<string>").alias("rors"))
    return C.employment_titles(jobs, t.authors.select("person_id", "institution_id"), names)


@query(
    "extracted_titles", "F4",
    """SELECT person_id, CASE title WHEN 'PhD Student' THEN NULL WHEN 'Postdoctoral Fellow' THEN 'Fellow' WHEN 'Research Scientist' THEN NULL ELSE title END AS title
    FROM contact""",
)
def _(t: Tables):
    texts = t.contacts.select("person_id", F.concat_ws("\n", F.lit("Welcome."), "title", F.lit("Building 4")).alias("text"))
    return C.extract_titles(texts, "text").select("person_id", "title")


@query(
    "roles", "F5",
    """SELECT person_id, CASE person_id % 7 WHEN 0 THEN 'faculty' WHEN 1 THEN 'student' WHEN 2 THEN 'postdoc' WHEN 3 THEN 'emeritus'
      WHEN 4 THEN 'researcher' WHEN 5 THEN 'faculty' END AS role FROM contact""",
)
def _(t: Tables):
    return C.with_role(t.contacts).select("person_id", "role")


@query(
    "contact_links", "F13",
    """SELECT person_id, 'https://www.google.com/search?q=' || url_encode('"' || name || '" ' || CASE WHEN institution_id < 20
       THEN 'site:' || lower(replace(institution_name, '_', '')) || '.ac.uk' ELSE institution_name END) AS contact_link FROM people JOIN inst USING (institution_id)""",
)
def _(t: Tables):
    inst = t.institutions.select(
        "institution_id", "institution_name", F.when(F.col("institution_id") < 20, F.col("homepage_url")).alias("homepage_url")
    )
    return C.with_contact_link(t.authors.join(inst, "institution_id")).select("person_id", "contact_link")


# --- pages -------------------------------------------------------------------------------------

@query(
    "page_links", "D1",
    """SELECT page_id, len(regexp_extract_all(html, '<a href="(/|http)')) AS links,
      regexp_extract(url, '^([a-z]+://[^/]+)', 1) || regexp_extract(html, '<a href="(/[^"]*)"', 1) AS first_link FROM pages""",
)
def _(t: Tables):
    return G.extract_pages(t.texts("pages")).select(
        "page_id", F.size("links").alias("links"), F.get("links", F.lit(0))["url"].alias("first_link")
    )


@query(
    "page_texts", "D1",
    r""", bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<!DOCTYPE[^>]*>', '<x>', 'g'), '(?s)<script.*?</script>|<style.*?</style>|<noscript.*?</noscript>', '<x>', 'g') AS h FROM pages),
    piece AS (SELECT page_id, regexp_split_to_array(h, '<[^>]*>') AS p FROM bare),
    plain AS (SELECT page_id, list_transform(p, lambda s: trim(replace(replace(replace(replace(replace(replace(replace(s, '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '&amp', '&'), chr(10) || ' ')) AS p FROM piece),
    text AS (SELECT page_id, array_to_string(list_filter(p, lambda s: s <> ''), chr(10)) AS t FROM plain)
    SELECT page_id, length(t) AS chars, sha256(t) AS text_hash FROM text""",
)
def _(t: Tables):
    return G.extract_pages(t.texts("pages")).select("page_id", F.length("text").alias("chars"), F.sha2("text", 256).alias("text_hash"))


def directory_pages(t: Tables):
    """One directory page per supplier: a card for the supplier and one for the next, inside a list block."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")

    def card(key, disguise):
        return F.format_string(
            '<li class="card"><h3>Ana Smith%d</h3><p>Associate Professor of Widgets</p><a href="/p/%d">Ana Smith%d</a> <span>%s</span></li>',
            key, key, key, disguise,
        )

    html = F.concat(
        F.lit('<html><body><div class="list"><ul>'),
        card(k, F.concat(F.lit("smith"), k, F.lit(" [at] nation"), n, F.lit(" dot ac dot uk"))),
        card(k + 1, F.concat(F.lit('<a href="mailto:SMITH'), k + 1, F.lit("@nation"), n, F.lit('.ac.uk?subject=x">mail</a>'))),
        F.lit("</ul></div><script>var a='x@y.com'</script></body></html>"),
    )
    return t.raw("supplier").select(
        k.alias("page_id"), F.concat(F.lit("https://www.nation"), n, F.lit(".ac.uk/people/")).alias("url"), html.alias("html")
    )


CARDS_SQL = """, cards AS (SELECT s_suppkey AS page_id, s_nationkey, unnest([s_suppkey, s_suppkey + 1]) AS k FROM supplier)
SELECT page_id, 'Ana Smith' || k AS name, 'smith' || k || '@nation' || s_nationkey || '.ac.uk' AS email,
  'https://www.nation' || s_nationkey || '.ac.uk/p/' || k AS profile_url, 'Associate Professor of Widgets' AS title FROM cards"""


@query("directory_entries", "D3", CARDS_SQL)
def _(t: Tables):
    return G.directory_entries(directory_pages(t)).drop("entry_pos")


@query("directory_entries_by_selector", "D3", CARDS_SQL)
def _(t: Tables):
    return G.directory_entries(directory_pages(t), "div.list li.card").drop("entry_pos")


@query(
    "page_contacts", "D2",
    """SELECT s_suppkey AS person_id, 'smith' || (s_suppkey + 1) || '@nation' || s_nationkey || '.ac.uk' AS email, 'Associate Professor of Widgets' AS title FROM supplier""",
)
def _(t: Tables):
    people = t.raw("supplier").select(
        F.col("s_suppkey").alias("person_id"), F.lit("Ana Smith").alias("name"),
        F.col("s_nationkey").alias("institution_id"), F.col("s_suppkey").alias("page_id"),
    )
    return G.page_contacts(directory_pages(t), people, t.institutions)


# --- profiles ----------------------------------------------------------------------------------------

@query(
    "document_profiles", "D4",
    r""", raw AS (SELECT doc_id, lang, source, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents),
    ln AS (SELECT doc_id, generate_subscripts(l, 1) AS i, trim(regexp_replace(unnest(l), '\s+', ' ', 'g')) AS s FROM raw),
    bare AS (SELECT doc_id, i, trim(regexp_replace(s, '^[\s*•·▪◦‣\d.)-]+', '')) AS s FROM ln WHERE s <> ''),
    prose AS (SELECT doc_id, i, s FROM bare WHERE len(string_split(trim(s), ' ')) >= 4
      AND NOT regexp_matches(s, '(?i)(@|https?://|www\.|linkedin\.com|github\.com|scholar\.google|orcid\.org|curriculum\s+vitae|\bpage\s+\d+|\+?\d[\d\s().-]{8,}\d)')),
    parts AS (SELECT doc_id, 0 AS i, lang || ' poetry, ' || source AS s FROM raw WHERE doc_id % 3 = 0 UNION ALL SELECT * FROM prose),
    whole AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS t FROM parts GROUP BY doc_id)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang || ' poetry|' || source ELSE '' END AS interests,
      coalesce(t, '') AS text FROM raw LEFT JOIN whole USING (doc_id)""",
)
def _(t: Tables):
    docs = t.texts("documents").withColumn(
        "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("CV\nResearch interests:\n- "), "lang", F.lit(" poetry, "), "source", F.lit("\nEducation\n"), "text")).otherwise(F.col("text"))
    )
    out = R.document_profiles(docs)
    return out.select("doc_id", F.array_join("interests", "|").alias("interests"), "text")


TOPICS_SQL = r""", parts AS (SELECT id, generate_subscripts(p, 1) AS i, unnest(p) AS s FROM (
    SELECT id, regexp_split_to_array(text, '(?i)[\n,;•]|\band\b|\s-\s') AS p FROM src)),
bare AS (SELECT id, i, regexp_replace(s, '(?i)^(i am |i''m |also |interested in |working on |my research is )+', '') AS s FROM parts),
few AS (SELECT * FROM bare WHERE len(string_split(trim(regexp_replace(s, '\s+', ' ', 'g')), ' ')) <= 6),
cleaned AS (SELECT id, i, trim(regexp_replace(regexp_replace(regexp_replace(s, '^[\s*•\d.)-]+', ''), '["''`]', '', 'g'), '\s+', ' ', 'g')) AS topic FROM few),
firsts AS (SELECT id, arg_min(topic, i) AS topic, min(i) AS i FROM cleaned WHERE topic <> '' GROUP BY id, lower(topic)),
numbered AS (SELECT id, topic, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS pos FROM firsts)
"""


@query("topics_in_texts", "D5", ", src AS (SELECT doc_id AS id, text FROM documents)" + TOPICS_SQL + "SELECT id AS doc_id, pos, topic FROM numbered")
def _(t: Tables):
    return R.text_topics(t.texts("documents"), "text", "doc_id")


@query(
    "parsed_replies", "D6",
    ", src AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations WHERE role = 'assistant')" + TOPICS_SQL
    + """SELECT s.id, coalesce(string_agg(topic, '|' ORDER BY pos), '') AS interests, false AS structured FROM src s LEFT JOIN numbered n ON s.id = n.id GROUP BY 1""",
)
def _(t: Tables):
    replies = t.texts("conversations").where("role = 'assistant'").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return R.parse_replies(replies, "text", ["id"]).select("id", F.array_join("interests", "|").alias("interests"), "structured")


@query(
    "structured_replies", "D6",
    """SELECT event_id AS id, event_type || ' study|k' AS interests, CAST(user_id AS VARCHAR) AS summary FROM events""",
)
def _(t: Tables):
    text = F.concat(
        F.lit('Sure! ```json {"interests": ["'), "event_type", F.lit(' study", "'), F.upper("event_type"), F.lit(' STUDY", "k"], "summary": " '),
        "user_id", F.lit(' ", "props": '), "props", F.lit("} ``` Anything {else}?"),
    )
    replies = t.raw("events").select(F.col("event_id").alias("id"), text.alias("text"))
    return R.parse_replies(replies, "text", ["id"]).select("id", F.array_join("interests", "|").alias("interests"), "summary")


@query(
    "publication_profiles", "D7",
    """, best AS (SELECT person_id, topic, row_number() OVER (PARTITION BY person_id ORDER BY max(n) DESC, topic) AS k FROM topics GROUP BY person_id, topic QUALIFY k <= 8),
    head AS (SELECT person_id, string_agg(topic, '|' ORDER BY k) AS interests, 'Research areas: ' || string_agg(topic, ', ' ORDER BY k) || '.' AS h FROM best GROUP BY 1),
    newest AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY d DESC, work_id) AS k FROM pubs QUALIFY k <= 25)
    SELECT person_id, interests, h || ' ' || (SELECT string_agg(title, ' ' ORDER BY k) FROM newest f WHERE f.person_id = head.person_id) AS text FROM head""",
)
def _(t: Tables):
    out = R.publication_profiles(t.author_topics, t.publications)
    return out.select("person_id", F.array_join("interests", "|").alias("interests"), "text")


@query(
    "parsed_references", "D8",
    """SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN 'orcid' WHEN c_custkey % 4 = 2 THEN 'openalex' END AS ref_kind,
      CASE WHEN c_custkey % 4 < 2 THEN '0000-0002-1825-' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || 'X' WHEN c_custkey % 4 = 2 THEN 'A' || (c_custkey + 10000) END AS ref_id FROM customer""",
)
def _(t: Tables):
    k = F.col("c_custkey")
    orcid = F.concat(F.lit("0000-0002-1825-"), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("x"))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("https://orcid.org/"), orcid)).when(k % 4 == 1, orcid)
        .when(k % 4 == 2, F.concat(F.lit("https://openalex.org/a"), k + 10000)).otherwise(F.col("c_name"))
    )
    return R.parse_refs(t.raw("customer").withColumn("ref", text), "ref").select("c_custkey", "ref_kind", "ref_id")


@query(
    "merged_profiles", "A22",
    """, s AS (SELECT user_id AS profile_id, event_id AS pos, event_type || ' ' || event_id % 30 AS topic, CASE WHEN event_id % 5 = 0 THEN props END AS summary, 't' || event_id % 20 AS text FROM events),
    f AS (SELECT profile_id, lower(topic) AS key, arg_min(topic, pos) AS topic, min(pos) AS pos FROM s GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY pos) AS r FROM f),
    x AS (SELECT profile_id, text, min(pos) AS pos FROM s GROUP BY 1, 2)
    SELECT profile_id, (SELECT string_agg(topic, '|' ORDER BY r) FROM k WHERE k.profile_id = p.profile_id) AS interests,
      coalesce((SELECT arg_max(summary, pos) FROM s WHERE s.profile_id = p.profile_id AND summary IS NOT NULL), '') AS summary,
      (SELECT string_agg(text, ' ' ORDER BY pos) FROM x WHERE x.profile_id = p.profile_id) AS text
    FROM (SELECT DISTINCT profile_id FROM s) p""",
)
def _(t: Tables):
    e = F.col("event_id")
    topic = F.concat("event_type", F.lit(" "), e % 30)
    sources = t.raw("events").select(
        F.col("user_id").alias("profile_id"), e.alias("pos"),
        F.array(F.concat(F.lit("- "), topic), F.concat(F.lit("'"), topic, F.lit("'"))).alias("interests"),
        F.when(e % 5 == 0, F.col("props")).alias("summary"), F.concat(F.lit("t"), e % 20).alias("text"),
    )
    return R.merge_profiles(sources).withColumn("interests", F.array_join("interests", "|"))


@query(
    "person_texts", "F11",
    """SELECT person_id, concat_ws(' ', title || '.', 'Research areas: ' || primary_domain || ', ' || (SELECT string_agg(domain, ', ' ORDER BY weight DESC, domain_rank) FROM dom d WHERE d.person_id = c.person_id AND weight > 0) || '.',
      'Recent work: ' || (SELECT string_agg(title, '; ' ORDER BY recency) FROM recent r WHERE r.person_id = c.person_id) || '.') AS embedding_text FROM contact c LEFT JOIN prim USING (person_id)""",
)
def _(t: Tables):
    full = records(t).join(W.publication_arrays(t.recent), "person_id", "left")
    return R.with_person_text(full).select("person_id", "embedding_text")


@query(
    "profile_texts", "F12",
    """SELECT doc_id, 'Research areas: ' || lang || ', ' || source || '. about ' || lang || ' ' || text AS embedding_text FROM documents""",
)
def _(t: Tables):
    profiles = t.texts("documents").select(
        "doc_id", F.array("lang", "source").alias("interests"), F.concat(F.lit("about "), "lang").alias("summary"), "text"
    )
    return R.with_profile_text(profiles).select("doc_id", "embedding_text")


@query(
    "resolved_people", "J14",
    NAMES_SQL + """, hit AS (SELECT b.item_id AS ref_id, k.doc_id, n_chars FROM bkeyed b JOIN keyed k USING (name_key) WHERE regexp_matches(source, '(?i)^(WEB|C|F|B)'))
    SELECT item_id AS ref_id, (SELECT arg_min(doc_id, (-n_chars, doc_id)) FROM hit WHERE ref_id = item_id) AS person_id,
      (SELECT count(*) FROM hit WHERE ref_id = item_id) AS candidates FROM bench""",
)
def _(t: Tables):
    people = named_benchmark(t).select(F.col("item_id").alias("ref_id"), "name", F.lit("^(WEB|C|F|B)").alias("institution_pattern"))
    authors = named_documents(t).select(
        F.col("doc_id").alias("person_id"), "name", F.col("source").alias("institutions"), F.col("n_chars").alias("works_count")
    )
    return R.resolve_people(people, authors).select("ref_id", "person_id", "candidates")


@query(
    "verified_pins", "J15",
    NAMES_SQL + """SELECT a.doc_id AS ref_id, CASE WHEN a.name_key = b.name_key THEN b.doc_id END AS person_id,
      CASE WHEN b.doc_id IS NULL THEN 'pinned id not found' WHEN coalesce(a.name_key = b.name_key, false) THEN NULL ELSE 'pinned id belongs to ' || b.name END AS note
    FROM keyed a LEFT JOIN keyed b ON b.doc_id = a.doc_id + a.doc_id % 2""",
)
def _(t: Tables):
    docs = named_documents(t)
    people = docs.select(F.col("doc_id").alias("ref_id"), "name", (F.col("doc_id") + F.col("doc_id") % 2).alias("pinned_id"))
    return R.verify_pins(people, docs.select(F.col("doc_id").alias("person_id"), "name"))


@query("clean_labels", "F14", r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS label, CAST(doc_id AS VARCHAR) AS id FROM documents""")
def _(t: Tables):
    linked = t.texts("documents").select("doc_id", clean_label(F.col("text")).alias("label"), F.concat(F.lit("https://openalex.org/"), "doc_id", F.lit("/")).alias("id"))
    return R.with_short_ids(linked, "id")


@query(
    "affiliation_strings", "S5",
    """, hit AS (SELECT doc_id % 10 AS person_id, trim(text) AS text FROM documents WHERE text LIKE '%@%')
    SELECT person_id, count(DISTINCT text) AS strings FROM hit GROUP BY 1""",
)
def _(t: Tables):
    from ..sources.readers import affiliation_strings

    rows = t.texts("documents").select((F.col("doc_id") % 10).alias("person_id"), F.col("doc_id").alias("pos"), "text")
    return affiliation_strings(rows).groupBy("person_id").agg(F.count("*").alias("strings"))
