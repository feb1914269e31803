"""Headlines, summaries and messages as DuckDB SQL, made from the same wording as the column expressions."""

from __future__ import annotations

import re

from ..functions.dates import MONTHS, ZONE
from ..functions.text import LEFT, RIGHT
from ..operators import render
from .sql import SPACE, for_match, quoted, whitespace


def plain(text: str) -> str:
    """A text with line ends as a SQL expression."""
    return " || chr(10) || ".join(quoted(x) for x in text.split("\n"))


def printable(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\x00-\\x1f\\x7f]', ' ', 'g'))"


def inline(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({printable(x)}, '[*_~`]', '', 'g'), '{SPACE}', ' ', 'g'))"


def _re2(pattern: str) -> str:
    return quoted(pattern.replace(LEFT, r"\b").replace(RIGHT, r"\b").replace("(?iu)", "(?i)"))


def _found(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_re2(pattern)})"


def _template(text: str) -> str:
    return " || ".join(x[1:-1] if x.startswith("{") else quoted(x) for x in re.split(r"(\{\w+\})", text) if x)


def _chosen(templates: dict[str, tuple[str, str]], variant: str, otherwise: str) -> str:
    cases = []
    for key, (named, other) in templates.items():
        text = _template(other) if named == other else f"CASE WHEN label <> '' THEN {_template(named)} ELSE {_template(other)} END"
        cases.append(f"WHEN {variant} = {quoted(key)} THEN {text}")
    return f"CASE {' '.join(cases)} ELSE {otherwise} END"


def _first_sentence(x: str, other: str) -> str:
    plain_, other = whitespace(x), whitespace(other)
    first = f"trim(regexp_extract({plain_}, '([^.!?]+[.!?]+)', 1))"
    return f"CASE WHEN {first} <> '' AND length({first}) <= 280 THEN {first} WHEN regexp_matches({other}, '[.!?]$') THEN {other} ELSE {other} || '.' END"


def messages(rows: str) -> str:
    """CTEs over a CTE of classified items (kind, title, summary, url, source, published_at, territory_name, category, emoji, evidence_text); `messages` has id,
    headline, line and message."""
    never = "(" + ", ".join(quoted(x) for x in render.NO_NAME) + ")"
    names = [f"CASE WHEN category = 'RATEIO' THEN upper(regexp_extract(whole, {_re2('(?iu)' + render.SHARE_NAME)}, 1)) END"] + [f"upper(regexp_extract(whole, {_re2('(?iu)' + n)}, 1))" for n in render.NAMES]
    name = ", ".join(f"CASE WHEN {n} NOT IN {never} THEN nullif({n}, '') END" for n in names)
    law, number = (f"regexp_extract(start, {_re2(render.LAW)}, {i})" for i in (1, 2))
    year = f"CASE WHEN contains({number}, '/') OR published_at IS NULL THEN '' ELSE '/' || year(published_at) END"
    legal = f"CASE WHEN {law} = '' THEN {quoted(render.NO_LEGAL)} WHEN lower({law}) = 'decreto' THEN 'O Decreto' WHEN contains(lower({law}), 'complementar') THEN 'A Lei Complementar' ELSE 'A Lei' END || CASE WHEN {law} = '' THEN '' ELSE ' nº ' || {number} || {year} END"
    heads = f"CASE WHEN category = 'RATEIO' AND {_found('named', render.SHARE_CONTRACT)} THEN 'RATEIO contrato' WHEN category = 'GOVERNANÇA' AND {_found('substr(opening, 1, 800)', render.PROTOCOL_CHANGE)} THEN 'GOVERNANÇA alteração' ELSE category END"
    share = "substr(opening, 1, 700)"
    contract = f"CASE WHEN {_found(share, render.ADDENDUM)} THEN 'RATEIO aditivo' ELSE 'RATEIO contrato' END"
    leads = (
        f"CASE WHEN category = 'RATEIO' THEN CASE WHEN {_found(share, render.SHARE_CONTRACT)} THEN {contract} WHEN {_found('opening', render.ALLOTMENT)} THEN 'RATEIO dotação' ELSE 'RATEIO' END "
        f"WHEN category = 'GOVERNANÇA' AND {_found('substr(proof, 1, 800)', render.PROTOCOL_CHANGE)} THEN 'GOVERNANÇA alteração' ELSE category END"
    )
    labels = " ".join(f"WHEN category = {quoted(c)} THEN {quoted(t)}" for c, t in render.LABELS.items())
    points = "[" + ", ".join(f"CASE WHEN {_found('proof', p)} THEN {quoted(s)} END" for p, s in render.KEY_POINTS) + "]"
    months = "[" + ", ".join(quoted(m) for m in MONTHS) + "]"
    here = f"((published_at AT TIME ZONE 'UTC') AT TIME ZONE '{ZONE}')"
    return f"""worded AS (
  SELECT *, {for_match("coalesce(title, '') || ' ' || coalesce(summary, '')")} AS named, substr({for_match("coalesce(summary, '')")}, 1, 1000) AS opening,
         {for_match("coalesce(nullif(evidence_text, ''), coalesce(summary, ''))")} AS proof, substr({whitespace("coalesce(summary, '')")}, 1, 260) AS start,
         CASE WHEN kind = 'gazette' THEN substr({whitespace("coalesce(title, '') || ' ' || coalesce(summary, '')")}, 1, 1600) ELSE {whitespace("coalesce(title, '') || ' ' || coalesce(summary, '')")} END AS whole
  FROM (SELECT * EXCLUDE (n) FROM {rows})
), labelled AS (
  SELECT *, coalesce({name}, '') AS label, {legal} AS legal, list_filter({points}, lambda p: p IS NOT NULL)[1:3] AS points FROM worded
), aimed AS (SELECT *, CASE WHEN label <> '' THEN 'o ' || label ELSE {quoted(render.NO_TARGET)} END AS target FROM labelled
), headed AS (
  SELECT *, CASE WHEN kind = 'gazette' THEN {_chosen(render.HEADLINES, heads, inline("title"))} ELSE {inline("title")} END AS headline
  FROM (SELECT *, {inline(f"coalesce(nullif(territory_name, ''), {quoted(render.TOWN)})")} AS place FROM aimed)
), lined AS (
  SELECT * EXCLUDE (place), CASE WHEN kind = 'gazette' THEN {_chosen(render.LEADS, leads, _first_sentence("summary", "title"))} ELSE {_first_sentence("coalesce(nullif(evidence_text, ''), summary)", "title")} END AS line
  FROM (SELECT * EXCLUDE (place), {inline(f"coalesce(nullif(territory_name, ''), {quoted(render.SOME_TOWN)})")} AS place FROM headed)
), bodies AS (
  SELECT id, headline, line, list_concat(list_concat([
    emoji || ' *' || CASE WHEN category = 'RATEIO' AND NOT {_found("named", render.SHARE_CONTRACT)} THEN {quoted(render.LOOSE_SHARE_LABEL)} ELSE CASE {labels} ELSE {quoted(render.OTHER_LABEL)} END END || '*',
    '*' || {inline("headline")} || '*', '', '> ' || {inline("line")}],
    CASE WHEN kind = 'gazette' AND len(points) > 0 THEN list_concat(['', {quoted(render.POINTS_TITLE)}], list_transform(points, lambda p: '- ' || {inline("p")})) ELSE []::VARCHAR[] END),
    ['', '_📅 ' || strftime({here}, '%d') || ' ' || {months}[month({here})] || ' ' || year({here}) || '  ·  📰 ' || {inline("source")} || '_',
     '🔗 *' || CASE WHEN kind = 'gazette' THEN {quoted(render.OFFICIAL_LINK)} ELSE {quoted(render.NEWS_LINK)} END || ':*', coalesce(url, '')]) AS lines FROM lined
), messages AS (SELECT id, headline, line, trim(array_to_string(list_filter(lines, lambda x, i: x <> '' OR i = 1 OR lines[i - 1] <> ''), chr(10))) AS message FROM bodies)"""
