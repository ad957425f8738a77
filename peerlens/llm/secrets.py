"""Secret scans with multipart credential linking.

Strong findings stand alone: assignments, access identifiers and long
hexadecimal strings. Weak candidates (a mixed string that could be a secret, an
endpoint, an account name) are reported only when a complementary part lies in
the same scope: each weak interval is joined with the intervals of the
complementary roles within `scope` code points before or behind it. A partner
is another piece of text: an interval that overlaps the candidate does not
count, and a mixed string in the host, path or fragment of an endpoint is a part of that
link and no candidate. One in the userinfo or query of an endpoint stays, and
the two complete each other. A mixed string must look random, which names in
camel case and paths do not. A plain link, which stands beside everything, completes
one only behind a naming word ("key", "token:"); a link with a credential of its own
needs none, and one with a user and a password is complete by itself. Long hexadecimal strings complete nothing: digests stand beside links
and names everywhere. Both sides are sorted by position, so the join looks only at the nearest
neighbour on each side and costs n log n for any number of parts.

Everything a document needs is in its own row, so nothing is shuffled.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# The strong patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "weak", "endpoint", "account")
LEAST_VALUE = 8

# Weak parts: a string of 20 or more with letters in both cases and digits, a place to connect to, a named account.
WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
ENDPOINT = re.compile(r"\b(?:https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>]+")
# What stands before the host: up to the last @ of the authority, or of the rest if the colon is not that of a port (passwords may hold a slash).
USERINFO = re.compile(r"[^/?#:@]*:(?!\d*(?:[/?#]|$)).*@|[^/?#]*@")
ACCOUNT = re.compile(r"""\b(?:user(?:name)?|login|account(?:_?id)?|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@+-]+)""", re.IGNORECASE | re.ASCII)
# A word that names what follows it, at most so many code points before.
NAMING = re.compile(r"""\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|account)?[_\x20-]?key|credentials?|auth(?:orization)?|bearer|sig(?:nature)?)["']?(?:\s+is\b)?\s*[:=]?\s*["'`(]?$""", re.IGNORECASE)
NAME_REACH = 40
# A query field that carries a credential.
CREDENTIAL = re.compile(r"[?&;](?:[a-z_-]*(?:key|token|secret|password|passwd|pwd|auth|sig|signature|credential))=[^&#;\s]", re.IGNORECASE)
# Letters that read like a word: three lower-case ones or more, or four capitals, with a vowel among them.
WORDLIKE = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")
VOWELS = frozenset("aeiouyAEIOUY")
# What completes what: a string needs an identifier, an account or an endpoint that carries a credential, a named string any
# endpoint; an endpoint or an account needs something secret.
PARTNERS = {
    "weak": ("access", "account", "holding"), "named": ("endpoint",),
    "endpoint": ("assign", "access", "named"), "holding": ("weak",), "account": ("assign", "weak"),
}
CLOSER = {"weak": "named", "endpoint": "holding"}  # those among a kind that more can complete
SCOPE = 300


def _random(s: str) -> bool:
    """Letters in both cases and digits, under half of them in what reads like words, and 2 bits a character or more."""
    if not (any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)):
        return False
    wordlike = sum(len(m[0]) for m in WORDLIKE.finditer(s) if not VOWELS.isdisjoint(m[0]))
    if 2 * wordlike >= sum(c.isalnum() for c in s):
        return False
    return sum(-n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= 2


def _may_hold(text: str, endpoint: tuple[int, int]) -> list[tuple[int, int]]:
    """Userinfo and query of an endpoint, where secrets stand; the rest says where to connect to."""
    host, end = text.index("://", *endpoint) + 3, endpoint[1]
    held = []
    if user := USERINFO.match(text, host, end):
        held.append((host, user.end()))
        host = user.end()
    fragment = text.find("#", host, end)
    query = text.find("?", host, end if fragment < 0 else fragment)
    return [*held, (query, end if fragment < 0 else fragment)] if query >= 0 else held


def _signs_in(text: str, endpoint: tuple[int, int]) -> bool:
    """Whether an endpoint names a user and a password."""
    host, end = text.index("://", *endpoint) + 3, endpoint[1]
    user = USERINFO.match(text, host, end)
    return bool(user) and re.search(r":[^@]", user[0]) is not None


def _around(spans: list[tuple[int, int]], a: int, b: int) -> tuple[int, int] | None:
    """The one of some disjoint spans that holds (a, b)."""
    at = bisect.bisect_right(spans, a, key=lambda s: s[0]) - 1
    return spans[at] if at >= 0 and b <= spans[at][1] else None


def find_parts(text: str) -> dict[str, list[tuple[int, int]]]:
    """Intervals of every kind, in code points, each list by start; `named` and `holding` are some of the weak strings and endpoints.

    Weak ones that touch a strong one are left out, and so are mixed strings in an endpoint beside its userinfo and query.
    """
    parts: dict[str, list[tuple[int, int]]] = {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE],
        "access": [m.span() for m in ACCESS.finditer(text)],
        "hex": [m.span() for m in HEX.finditer(text)],
    }
    strong = sorted(s for spans in parts.values() for s in spans)
    begins = [a for a, _ in strong]
    reach, furthest = [], 0
    for _, b in strong:
        furthest = max(furthest, b)
        reach.append(furthest)

    def clear(span):
        before = bisect.bisect_left(begins, span[1]) - 1
        return before < 0 or reach[before] <= span[0]

    endpoints = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    holding: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def apart(span):
        link = _around(endpoints, *span)
        if link is None:
            return True
        if link not in holding:
            holding[link] = _may_hold(text, link)
        return any(c < span[1] and span[0] < d for c, d in holding[link])

    parts["weak"] = [m.span() for m in WEAK.finditer(text) if _random(m[0]) and clear(m.span()) and apart(m.span())]
    parts["endpoint"] = [s for s in endpoints if clear(s)]
    parts["account"] = [m.span() for m in ACCOUNT.finditer(text) if clear(m.span())]
    parts["named"] = [s for s in parts["weak"] if NAMING.search(text[max(0, s[0] - NAME_REACH) : s[0]])]
    carry = {link for s in parts["weak"] if (link := _around(endpoints, *s))}
    parts["holding"] = [s for s in parts["endpoint"] if s in carry or CREDENTIAL.search(text, *s) or _signs_in(text, s)]
    return parts


def linked_spans(text: str | None, scope: int = SCOPE) -> list[tuple[str, int, int]]:
    """Strong spans and the weak ones with a complementary part in scope, by start, then in the order of KINDS."""
    if not text:
        return []
    parts = find_parts(text)
    starts = {kind: [a for a, _ in spans] for kind, spans in parts.items()}
    ends = {kind: [b for _, b in spans] for kind, spans in parts.items()}  # spans of a kind are disjoint, so these are sorted too
    inside = {(a, b): link for a, b in parts["weak"] if (link := _around(parts["endpoint"], a, b))}
    joined = {"weak": inside.keys(), "endpoint": {*inside.values(), *(s for s in parts["holding"] if _signs_in(text, s))}, "account": ()}

    closer = {kind: set(parts[some]) for kind, some in CLOSER.items()}

    def complete(kind, a, b):
        if (a, b) in joined[kind]:
            return True
        for role in PARTNERS[kind] + (PARTNERS[CLOSER[kind]] if (a, b) in closer.get(kind, ()) else ()):
            ahead = bisect.bisect_left(starts[role], b)
            if ahead < len(starts[role]) and starts[role][ahead] - b <= scope:
                return True
            behind = bisect.bisect_right(ends[role], a)
            if behind and a - ends[role][behind - 1] <= scope:
                return True
        return False

    found = [(a, KINDS.index(k), b, k) for k in KINDS[:3] for a, b in parts[k]]
    found += [(a, KINDS.index(k), b, k) for k in KINDS[3:] for a, b in parts[k] if complete(k, a, b)]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def find_secrets(docs: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Add `found`, an array of (kind, start, end) in code points, end exclusive, by start. Null and empty texts have none.

    Rows, repeated ones included, stay as they are; a column of that name is replaced.
    """

    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in linked_spans(t, scope)] for t in texts], dtype=object)

    column = F.pandas_udf(scan, "array<struct<kind:string,start:int,end:int>>")(F.col(text_col))
    return docs.withColumn("found", column)


def count_of(kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")


def spans_text(kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    chosen = F.filter("found", lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Replace spans by [kind]; overlapping spans become one, named after the first."""
    if not text or not spans:
        return text
    out, at, name, stop = [], 0, None, 0
    for kind, a, b in spans:
        if name is not None and a < stop:
            stop = max(stop, b)
            continue
        if name is not None:
            out.append(f"[{name}]")
            at = stop
        out.append(text[at:a])
        name, stop = kind, b
    return "".join([*out, f"[{name}]", text[stop:]])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None, scope: int = SCOPE) -> DataFrame:
    """`docs` with secrets replaced by their kind in brackets; with `length_col`, that column holds the new length."""

    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, linked_spans(t, scope)) for t in texts], dtype=object)

    rows = fresh(docs, "_clean").withColumn("_clean", F.pandas_udf(clean, "string")(F.col(text_col)))
    change = {text_col: F.col("_clean")} | ({length_col: F.length("_clean").cast("long")} if length_col else {})
    return rows.select(*[change[c].alias(c) if c in change else F.col(f"`{c}`") for c in docs.columns])
