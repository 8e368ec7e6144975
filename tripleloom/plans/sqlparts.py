"""Common parts of the SQL texts."""

from __future__ import annotations

STRIP = r"trim({}, e' \t\r\n')"


def strip(x: str) -> str:
    return STRIP.format(x)


def triples(table: str, name: str = "trip", key: str = "row_id") -> str:
    """``name(qid, seq, h, r, t)``: the valid triples of a table."""
    return f"""{name}_raw AS (SELECT {key} AS qid, unnest(graph) AS g, generate_subscripts(graph, 1) - 1 AS seq FROM {table}),
{name} AS (SELECT qid, seq, {strip('g.h')} AS h, {strip('g.r')} AS r, {strip('g.t')} AS t FROM {name}_raw
  WHERE {strip('g.h')} <> '' AND {strip('g.r')} <> '' AND {strip('g.t')} <> '')"""


def last_wins(source: str = "trip", name: str = "edges") -> str:
    return f"{name} AS (SELECT qid, h, arg_max(r, seq) AS r, t FROM {source} GROUP BY qid, h, t)"


def members(table: str, column: str, name: str, key: str = "row_id") -> str:
    """``name(qid, pos, e)``: the stripped, non-blank members of a list column in order."""
    return f"""{name} AS (SELECT {key} AS qid, pos, {strip('e')} AS e FROM
  (SELECT {key}, unnest({column}) AS e, generate_subscripts({column}, 1) AS pos FROM {table}) WHERE {strip('e')} <> '')"""


MED = "(starts_with({0}, 'm.') OR starts_with({0}, 'g.'))"


def med(x: str) -> str:
    return MED.format(x)


#: ``kg(h, r, t)``: the distinct triples of both question tables; ``clean``: collapsed, without mediators and loops.
KG = f"""{triples('rog_webqsp', 'ta')}, {triples('rog_cwq', 'tb')},
kg AS (SELECT DISTINCT h, r, t FROM (SELECT h, r, t FROM ta UNION ALL SELECT h, r, t FROM tb)),
made AS (SELECT a.h, a.r || '-' || b.r AS r, b.t FROM kg a JOIN kg b ON a.t = b.h WHERE {med('a.t')} AND NOT {med('a.h')} AND NOT {med('b.t')}),
collapsed AS (SELECT h, r, t, bool_and(created) AS created FROM (SELECT h, r, t, false AS created FROM kg UNION ALL SELECT h, r, t, true FROM made) GROUP BY h, r, t),
clean AS (SELECT h, r, t FROM collapsed WHERE NOT {med('h')} AND NOT {med('t')} AND h <> t)"""

STEP = "h || '-[' || r || ']->' || t"
