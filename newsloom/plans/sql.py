"""The text functions and rule sets as DuckDB SQL, made from the same data as the column expressions."""

from __future__ import annotations

from ..functions.similarity import LEAD, LINKING, MOST_TOKENS, STOP_WORDS
from ..functions.urls import TRACKING
from ..operators.classify import GAZETTE_LIMIT, LIMIT, NO_CONTEXT, NO_TEXT, STRONG_REASON
from ..operators.rules import GENERAL, REJECTED, RuleSet, re2

SPACE = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def whitespace(x: str) -> str:
    x = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    for pattern, mark in (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'")):
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(mark)}, 'gi')"
    return f"trim(regexp_replace({x}, '{SPACE}', ' ', 'g'))"


def for_match(x: str) -> str:
    return f"lower(strip_accents({whitespace(x)}))"


def canonical(x: str) -> str:
    bare = f"regexp_replace({x}, '(?s)#.*$', '')"
    head = f"lower(regexp_extract({bare}, '(?s)^([^/]+//[^/?]*)', 1))"
    head = f"regexp_replace(regexp_replace({head}, '^(http://.*):80$', '\\1'), '^(https://.*):443$', '\\1')"
    rest = f"regexp_extract({bare}, '(?s)^[^/]+//[^/?]*(.*)$', 1)"
    path, query = f"regexp_extract({rest}, '(?s)^([^?]*)', 1)", f"regexp_extract({rest}, '(?s)^[^?]*\\?(.*)$', 1)"
    parts = f"string_split({query}, '&')"
    tracking = f"regexp_matches(regexp_extract(p, '(?s)^([^=]*)', 1), '{TRACKING}')"
    kept = f"list_filter({parts}, lambda p: p <> '' AND NOT {tracking})"
    asked = f"CASE WHEN len(list_filter({parts}, lambda p: {tracking})) > 0 THEN CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END WHEN contains({rest}, '?') THEN '?' || {query} ELSE '' END"
    return f"CASE WHEN regexp_matches({x}, '(?i)^https?://[^/?#\\s@]+') THEN {head} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || {asked} ELSE {x} END"


def fingerprint(x: str) -> str:
    return f"sha256(regexp_replace({for_match(x)}, '\\b({LINKING})\\b', ' ', 'g'))"


def tokens(title: str, text: str) -> str:
    both = for_match(f"coalesce({title}, '') || ' ' || substr(coalesce({text}, ''), 1, {LEAD})")
    words = f"regexp_extract_all({both}, '[a-z0-9]{{3,}}')"
    stop = "(" + ", ".join(quoted(w) for w in STOP_WORDS) + ")"
    # each word's first place, by grouping: looking every word up in its list would be quadratic in a title
    placed = f"SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT {words} AS ws)"
    first = f"SELECT w FROM ({placed}) WHERE w NOT IN {stop} GROUP BY w ORDER BY min(i) LIMIT {MOST_TOKENS}"
    return f"coalesce((SELECT list(w ORDER BY w) FROM ({first})), [])"


def host(x: str) -> str:
    return f"lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


def classify(items: str, rules: RuleSet) -> str:
    """CTEs seg, hit, scored and best over a CTE `items` (id, kind, title, summary, excerpts, url)."""
    has = lambda p, of="text": f"regexp_matches({of}, {quoted(re2(p))})"
    hits = ", ".join("(" + " + ".join(f"{has(p)}::INT" for p in r.patterns) + f") AS h{i}" for i, r in enumerate(rules.rules))
    lost = ", ".join("(" + " OR ".join(f"({has(a)}" + (f" AND NOT {has(b)})" if b else ")") for a, b in p.cases) + f") AS n{i}" for i, p in enumerate(rules.penalties))
    points = " + ".join(f"CASE WHEN h{i} > 0 AND public THEN {r.weight} + least(h{i} - 1, 2) ELSE 0 END" for i, r in enumerate(rules.rules))
    minus = " ".join(f"- CASE WHEN n{i} THEN {p.points} ELSE 0 END" for i, p in enumerate(rules.penalties))
    best = sorted(enumerate(rules.rules), key=lambda x: (-x[1].priority, -x[1].weight))
    category = " ".join(f"WHEN h{i} > 0 THEN {quoted(r.category)}" for i, r in best)
    rejected = " OR ".join(f"n{i}" for i in range(len(rules.penalties))) or "false"
    reasons = [f"CASE WHEN strong THEN {quoted(STRONG_REASON)} END"]
    reasons += [f"CASE WHEN h{i} > 0 THEN CASE WHEN public THEN {quoted(r.category)} ELSE {quoted(f'{REJECTED}{r.category} {NO_CONTEXT}')} END END" for i, r in enumerate(rules.rules)]
    reasons += [f"CASE WHEN n{i} THEN {quoted(REJECTED + p.reason)} END" for i, p in enumerate(rules.penalties)]
    official = " OR ".join(f"ends_with({host('url')}, {quoted(e)})" for e in rules.official) or "false"
    return f"""{items},
parts AS (
  SELECT id, kind, title, url, CASE WHEN len(excerpts) > 0 THEN excerpts ELSE [coalesce(summary, '')] END AS texts FROM items
), cut AS (
  SELECT id, kind, title, url, list_filter(list_transform(texts, lambda s: substr({whitespace("s")}, 1, CASE WHEN kind = 'gazette' THEN {GAZETTE_LIMIT} ELSE {LIMIT} END)), lambda s: s <> '') AS segs FROM parts
), seg AS (
  SELECT id, kind, title, url, i - 1 AS idx, segs[i] AS evidence, {for_match("coalesce(title, '') || ' ' || segs[i]")} AS text FROM (SELECT *, unnest(range(1, len(segs) + 1)) AS i FROM cut)
), hit AS (
  SELECT id, idx, evidence, {has(rules.subject)} AS subject, {has(rules.strong)} AS strong, {has(rules.local)} AS local_,
         {has(rules.subject, for_match("title"))}::INT + (coalesce(kind, '') <> 'gazette' AND ({official}))::INT AS extra, {hits}{", " + lost if lost else ""} FROM seg
), open_ AS (SELECT *, (strong OR (subject AND local_)) AS public FROM hit
), scored AS (
  SELECT id, idx, evidence, public, strong, (subject::INT + public::INT + 2 * strong::INT + extra + {points} {minus})::INT AS score,
         CASE WHEN {rejected} OR NOT public THEN {quoted(GENERAL)} ELSE CASE {category} ELSE {quoted(GENERAL)} END END AS category,
         list_filter([{", ".join(reasons)}], lambda x: x IS NOT NULL) AS reasons FROM open_
), best AS (
  SELECT items.id, coalesce(b.category, {quoted(GENERAL)}) AS category, coalesce(b.score, 0)::INT AS score, coalesce(b.reasons, [{quoted(NO_TEXT)}]) AS reasons, coalesce(b.idx, -1)::INT AS evidence_index
  FROM items LEFT JOIN (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, idx) = 1) b ON b.id = items.id
)"""


