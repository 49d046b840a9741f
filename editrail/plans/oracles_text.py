"""SQL twins of the queries on texts, headings and lines, over all rows: other letters, digits and blanks are those of Unicode."""

from __future__ import annotations

from editrail.plans.oracles import _CAT, _PARA, BASE
from editrail.plans.oracles_compare import _CITED, _FAMILY, _FORCE, _LIMIT, bare, blocks, family, lcs, letters, plain, ratio, value, words

_S = BASE[len("WITH ") :].split(", e AS")[0]
_TEXTS = f"{_PARA}, x AS (SELECT * FROM q WHERE text IS NOT NULL)"
_LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ß": "ss"}


def upper(x: str) -> str:
    """Full upper case: ligatures and the sharp s have several letters."""
    for one, row in _LIGATURES.items():
        x = f"replace({x}, '{one}', '{row}')"
    return f"upper({x})"


_BLANKS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NAME = "trim(regexp_replace(regexp_replace({x}, '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
# a year in the middle of other letters is no year: those are kept as a mark until it is found
_BARE = rf"regexp_replace(text, '{_BLANKS}*\([A-Z][A-Za-z0-9&-]{{1,5}}\){_BLANKS}*$', '')"
_HEADING = _NAME.format(x=rf"regexp_replace({letters(upper(_BARE))}, '\b(?:19|20)[0-9]{{2}}\b', 'FY', 'g')")

_TAGS = f"""tk AS (SELECT para_id, ws, unnest(range(len(ws))) AS k FROM (SELECT para_id, {words('text')} AS ws FROM x)),
    tb AS (SELECT para_id, ws[k + 1] AS word, {bare('ws[k + 1]')} AS bw, {bare('ws[k + 2]')} AS nx, CASE WHEN k > 0 THEN {bare('ws[k]')} END AS pv, array_to_string(list_transform(ws[greatest(0, k - 5) + 1:k], lambda w: {bare('w')}), ' ') AS pre
      FROM tk WHERE k + 1 < len(ws)),
    due AS (SELECT DISTINCT para_id FROM tb WHERE regexp_matches(nx, '^(days?|weeks?|months?|years?|calendar|business)$') AND {value('bw')} IS NOT NULL AND NOT (NOT contains(word, '$') AND regexp_full_match(bw, '(19|20)[0-9]{{2}}'))
      AND NOT (regexp_matches({plain('pre')}, '{_CITED}') AND NOT regexp_matches(pre, '(than|to|of)$'))
      AND NOT coalesce(regexp_matches(pv, '^(january|february|march|april|may|june|july|august|september|october|november|december)$'), false))"""

# ---- lines, by the rules of the print
_LINES = rf"""l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
    l1 AS (SELECT doc_id, i, line, regexp_replace(line, '^{_BLANKS}+', '') AS tail, regexp_replace(line, '{_BLANKS}+$', '') AS lead FROM l0),
    l2 AS (SELECT *, regexp_replace(tail, '{_BLANKS}+$', '') AS t, length(line) - length(tail) AS ind FROM l1),
    l3 AS (SELECT *, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) AS ls, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS us, len(regexp_extract_all(t, '{_BLANKS}{{3,}}')) AS gaps, {words('t')} AS ws FROM l2),
    l4 AS (SELECT *, CASE WHEN ls > 0 THEN us::DOUBLE / ls ELSE 0 END AS share, regexp_matches(line, '\.{{4,}}{_BLANKS}*[\p{{Nd}},.()$+\-* ]*$') AS leads FROM l3),
    l5 AS (SELECT *, t <> '' AND length(t) <= 70 AND regexp_matches(t, '[A-Za-z]') AND NOT (regexp_matches(t, '([.,;]|--)$') AND NOT ends_with(t, 'etc.')) AND NOT leads AND NOT regexp_full_match(t, '[-=_]{{8,}}')
        AND NOT contains(t, '.--') AND NOT contains(t, '....') AND length(regexp_replace({letters('t')}, '(?i)\b(FY|Fiscal Year|[0-9]+)\b|[^A-Za-z]', '', 'g')) >= 3
        AND NOT regexp_matches(t, '(?i)^(TOTAL|SUBTOTAL)\b') AND NOT regexp_matches(t, '\p{{Nd}}[\p{{Nd}},]*{_BLANKS}+\p{{Nd}}') AS may FROM l4),
    l6 AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN regexp_full_match(t, '[-=_]{{8,}}') THEN 'table_rule' WHEN regexp_matches(line, '(?i)GRAPHIC\(S\)? NOT AVAILABLE|\[In thousands') THEN 'table_marker' WHEN leads THEN 'leader'
        WHEN may AND ((regexp_matches(t, '^TITLE{_BLANKS}+[IVXLC]+\b') AND share >= 0.9) OR ((ind >= 6 OR length(t) > 58) AND (share >= 0.9 OR (abs(ind - (70 - length(t)) / 2) <= 4 AND regexp_matches(t, '^\p{{Lu}}') AND len(ws) <= 10
          AND len(list_filter(ws, lambda w: NOT (regexp_matches(w, '^\p{{Lu}}') OR length(w) <= 3 OR regexp_full_match(w, '\([A-Z0-9&./-]{{2,}}\)')))) = 0)))) THEN 'heading' ELSE 'body' END AS kind,
      CASE WHEN length(lead) > 40 AND regexp_matches(line, '[\p{{Nd}},.()+\-]+{_BLANKS}{{2,}}[+\-(]?[\p{{Nd}},.()][\p{{Nd}},.()+\-]*(?:{_BLANKS}|\*)*$') THEN 'numeric' WHEN gaps >= 2 AND length(lead) >= 76 THEN 'wide'
        WHEN gaps >= 2 AND regexp_matches(line, '\p{{Nd}}{{1,3}}(?:,\p{{Nd}}{{3}})+{_BLANKS}*$') THEN 'columnar' ELSE '' END AS shape FROM l5)"""

_SMALL = "['a', 'an', 'and', 'as', 'at', 'by', 'for', 'in', 'of', 'on', 'or', 'the', 'to', 'under', 'with']"
_ROMAN = "['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x']"
_RUN = f"CASE WHEN list_contains({_ROMAN}, r) THEN upper(r) ELSE upper(left(r, 1)) || substr(r, 2) END"
_NAMED = f"list_transform(list_zip(ws, range(len(ws))), lambda z: CASE WHEN z[2] > 0 AND list_contains({_SMALL}, z[1]) THEN z[1] ELSE array_to_string(list_transform(regexp_extract_all(z[1], '[a-z]+|[^a-z]+'), lambda r: {_RUN}), '') END)"
_BODY = "left(array_to_string(list_transform({x}, lambda z: z.text), ' '), {n})"
_REMAINDERS = """list_intersect(wa, wb) AS shared, list_filter(wa, lambda x: NOT list_contains(wb, x)) AS ua, list_filter(wb, lambda x: NOT list_contains(wa, x)) AS ub"""


def _token_set(pairs: str, name: str) -> str:
    """CTE name(a, b, score): token-set ratio of distinct pairs of texts."""
    sorted_ = lambda x: f"array_to_string(list_sort({x}), ' ')"
    return f"""{name}_p AS (SELECT a, b, list_distinct({words('a')}) AS wa, list_distinct({words('b')}) AS wb FROM (SELECT DISTINCT a, b FROM {pairs})), {name}_q AS (SELECT a, b, wa AS xa, wb AS xb, {_REMAINDERS} FROM {name}_p),
    {name}_s AS (SELECT a AS ta, b AS tb, len(shared) AS n, {sorted_('shared')} AS base, {sorted_('ua')} AS a, {sorted_('ub')} AS b, len(xa) AS na, len(xb) AS nb FROM {name}_q), {lcs(f'{name}_s', f'{name}_l')},
    {name}_t AS (SELECT s.*, l.n AS l, length(base) + CASE WHEN s.n > 0 AND s.a <> '' THEN 1 ELSE 0 END + length(s.a) AS la, length(base) + CASE WHEN s.n > 0 AND s.b <> '' THEN 1 ELSE 0 END + length(s.b) AS lb FROM {name}_s s LEFT JOIN {name}_l l ON l.a = s.a AND l.b = s.b),
    {name} AS (SELECT ta AS a, tb AS b, CASE WHEN na = 0 OR nb = 0 THEN 0.0 WHEN n > 0 AND ({name}_t.a = '' OR {name}_t.b = '') THEN 100.0 ELSE greatest(100.0::DOUBLE * (1 - (length({name}_t.a) + length({name}_t.b) - 2 * l)::DOUBLE / (la + lb)),
      CASE WHEN n > 0 THEN greatest(200.0::DOUBLE * length(base) / (length(base) + la), 200.0::DOUBLE * length(base) / (length(base) + lb)) ELSE 0 END) END AS score FROM {name}_t)"""


def _word_blocks(pairs: str, name: str) -> str:
    """CTE name(a, b, n, na, nb): words in matching blocks, and words of each side, of distinct pairs of texts."""
    return f"""{name}_t AS (SELECT row_number() OVER () AS sid, a, b, {words('a')} AS wa, {words('b')} AS wb FROM (SELECT DISTINCT a, b FROM {pairs})), {name}_a AS (SELECT sid, unnest(range(len(wa))) AS i, unnest(wa) AS t FROM {name}_t WHERE a <> b), {name}_b AS (SELECT sid, unnest(range(len(wb))) AS j, unnest(wb) AS t FROM {name}_t WHERE a <> b),
    {blocks(f'{name}_k', f'{name}_a', f'{name}_b')},
    {name} AS (SELECT a, b, CASE WHEN a = b THEN len(wa) ELSE coalesce(n, 0) END AS n, len(wa) AS na, len(wb) AS nb FROM {name}_t LEFT JOIN (SELECT sid, sum(bn) AS n FROM {name}_k GROUP BY sid) z ON z.sid = {name}_t.sid)"""


_R = BASE.replace("WITH ", "WITH RECURSIVE ", 1)

ORACLES = {
    "catalog_union": f"WITH {_CAT} SELECT package_id, chamber, stage, source FROM k",
    "heading_normalise": f"""SELECT DISTINCT heading_id, {_HEADING} AS heading, {_NAME.format(x=upper('text'))} AS name, trim(regexp_replace(lower(text), '[^a-z0-9$%]+', ' ', 'g')) AS key FROM headings WHERE text IS NOT NULL""",
    "heading_occurrences": f"WITH h AS (SELECT DISTINCT heading_id, package_id, text FROM headings WHERE text IS NOT NULL) SELECT package_id, {_HEADING} AS name, count(*) AS n FROM h GROUP BY ALL HAVING count(*) > 1",
    "display_headings": rf"""WITH h AS (SELECT DISTINCT heading_id, text, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS ws FROM headings WHERE text IS NOT NULL)
        SELECT heading_id, CASE WHEN regexp_matches(text, '\p{{Ll}}') THEN text ELSE array_to_string({_NAMED}, ' ') END AS shown FROM h""",
    "paragraph_kinds": rf"""WITH {_TEXTS}, z AS (SELECT para_id, regexp_extract(text, '^(?:Section|Sec\.){_BLANKS}+(\p{{Nd}}+[A-Za-z]?)(?:[^\p{{L}}\p{{N}}_]|$)', 1) AS num, regexp_extract(text, '^([A-Z][^.]{{2,80}}?)\.--', 1) AS lead FROM x)
        SELECT para_id, CASE WHEN num <> '' THEN 'gp_section' WHEN lead <> '' THEN 'directive' ELSE 'narrative' END AS kind, CASE WHEN num <> '' THEN 'Section ' || num WHEN lead <> '' THEN lead END AS topic FROM z""",
    "family_counts": f"WITH {_TEXTS}, z AS (SELECT para_id, {letters('lower(text)')} AS t FROM x) SELECT para_id, {', '.join(f'CAST({family(c, chr(116))} AS INTEGER) AS {chr(34)}{c}{chr(34)}' for c in [*_FORCE, *_FAMILY, 'limit', 'deadline'])} FROM z",
    "describe_tags": rf"""WITH {_TEXTS}, {_TAGS}, z AS (SELECT para_id, text, {letters('lower(text)')} AS t FROM x) SELECT z.para_id, array_to_string(list_filter([
          CASE WHEN regexp_matches(t, '{_FAMILY['prohibition']}') THEN 'prohibition' END, CASE WHEN regexp_matches(t, '{_FORCE['mandatory']}') THEN 'mandatory direction' END, CASE WHEN regexp_matches(t, '{_FAMILY['reporting']}') THEN 'reporting requirement' END,
          CASE WHEN due.para_id IS NOT NULL THEN 'deadline' END, CASE WHEN regexp_matches(t, '{_LIMIT}') AND contains(text, '$') THEN 'floor / ceiling' END,
          CASE WHEN regexp_matches(t, '{_FAMILY['eligibility']}') AND regexp_matches(t, '\beligib|\bonly\b|limited to') THEN 'eligibility / scope' END], lambda v: v IS NOT NULL), ',') AS tags FROM z LEFT JOIN due ON due.para_id = z.para_id""",
    "word_totals": f"WITH {_TEXTS} SELECT package_id, kind, CAST(sum(len({words('text')})) AS BIGINT) AS words, count(*) AS n FROM x GROUP BY ALL",
    "figures": rf"""WITH {_TEXTS}, z AS (SELECT para_id, text, {letters('text')} AS t FROM x) SELECT para_id, CAST(len(regexp_extract_all(text, '\$[0-9]')) AS INTEGER) AS amounts, CAST(len(regexp_extract_all(t, '\b[0-9]+ percent\b')) AS INTEGER) AS shares,
        CAST(len(regexp_extract_all(t, '\b[0-9]+ (?:days|weeks|months)\b')) AS INTEGER) AS spans, CAST(len(regexp_extract_all(t, '\b(?:19|20)[0-9]{{2}}\b')) AS INTEGER) AS years,
        CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '\$([0-9][0-9,]*)', 1), lambda v: CAST(replace(v, ',', '') AS BIGINT))), 0) AS BIGINT) AS dollars FROM z""",
    "line_kinds": f"WITH {_LINES} SELECT doc_id, kind, count(*) AS n, CAST(sum(i) AS BIGINT) AS line_sum, count_if(shape = 'numeric') AS \"numeric\", count_if(shape = 'wide') AS wide, count_if(shape = 'columnar') AS columnar FROM l6 GROUP BY ALL",
    "leader_spans": f"""WITH {_LINES}, k AS (SELECT doc_id, i FROM l6 WHERE kind IN ('leader', 'table_rule', 'table_marker')), r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM k)
        SELECT doc_id, CAST(min(i) AS INTEGER) AS start, CAST(max(i) + 1 AS INTEGER) AS "end" FROM r GROUP BY doc_id, island""",
    "structure_sweep": rf"""WITH {_S} SELECT package_id, count(*) AS sections, CAST(sum(len(paragraphs)) AS BIGINT) AS paragraphs, CAST(sum(table_spans) AS BIGINT) AS tables, CAST(sum(len(list_filter(paragraphs, lambda z: z.kind = 'directive'))) AS BIGINT) AS directives,
        CAST(sum(len(list_filter(paragraphs, lambda z: coalesce(regexp_matches(z.text, '\.{{6,}}|-{{6,}}'), false)))) AS BIGINT) AS leaks,
        count(*) < 15 OR sum(len(paragraphs)) < 30 OR sum(len(list_filter(paragraphs, lambda z: coalesce(regexp_matches(z.text, '\.{{6,}}|-{{6,}}'), false)))) > 0 AS thin FROM s GROUP BY package_id""",
    "structure_findings": rf"""WITH {_S}, a AS (SELECT DISTINCT path[-1] AS name FROM s WHERE level = 1 AND len(path) > 0), t AS (SELECT package_id, section_id, path FROM s WHERE len(path) > 0 AND NOT (len(path) = 2 AND regexp_matches(path[-1], '^SEC [0-9]')))
        SELECT package_id, array_to_string(path, ' > ') AS path, 'nested_agency' AS finding FROM t WHERE len(list_filter(path, lambda z: z IN (SELECT name FROM a))) > 1
        UNION ALL SELECT package_id, array_to_string(path, ' > '), 'annotation' FROM t WHERE regexp_matches(path[-1], '^(INCLUDING|EXCLUDING)\b')""".replace("len(list_filter(path, lambda z: z IN (SELECT name FROM a))) > 1", "section_id IN (SELECT section_id FROM (SELECT section_id, unnest(path) AS name FROM t) u JOIN a USING (name) GROUP BY section_id HAVING count(*) > 1)"),
    "navigation": f"{BASE} SELECT chamber, string_agg(DISTINCT slug, ',' ORDER BY slug) AS subcommittees FROM p GROUP BY chamber",
    "wanted_pairs": f"{BASE} SELECT pair, old_fy, new_fy FROM p WHERE chamber = 'house' AND new_fy BETWEEN 2015 AND 2020",
    "indel_scores": f"""{_R}, z AS (SELECT pair, old_id, new_id, {_BODY.format(x='op', n=1500)} AS a, {_BODY.format(x='np', n=1500)} AS b FROM m), zd AS (SELECT DISTINCT a, b FROM z WHERE a <> b), {lcs('zd', 'li')}, {_token_set('z', 'ts')}, {_word_blocks('z', 'wb')},
        bg AS (SELECT a, b, sum(least(x, y)) AS n FROM (SELECT a, b, w, count(*) FILTER (s = 0) AS x, count(*) FILTER (s = 1) AS y FROM (SELECT a, b, 0 AS s, unnest({words('a')}) AS w FROM zd UNION ALL SELECT a, b, 1, unnest({words('b')}) FROM zd) GROUP BY ALL) GROUP BY ALL)
        SELECT z.pair, old_id, new_id, round(CASE WHEN z.a = z.b THEN 100.0 ELSE {ratio('z.a', 'z.b', 'li.n')} END, 6) AS indel, round(ts.score, 6) AS token_set, round(CASE WHEN wb.na + wb.nb = 0 THEN 1.0 ELSE 2.0::DOUBLE * wb.n / (wb.na + wb.nb) END, 6) AS blocks,
          round(CASE WHEN wb.na + wb.nb = 0 OR z.a = z.b THEN 1.0 ELSE 2.0::DOUBLE * coalesce(bg.n, 0) / (wb.na + wb.nb) END, 6) AS bag
        FROM z LEFT JOIN li ON li.a = z.a AND li.b = z.b JOIN ts ON ts.a = z.a AND ts.b = z.b JOIN wb ON wb.a = z.a AND wb.b = z.b LEFT JOIN bg ON bg.a = z.a AND bg.b = z.b""",
    "automatic_labels": f"""{_R}, z AS (SELECT pair, old_id, new_id, {_BODY.format(x='op', n=4000)} AS a, {_BODY.format(x='np', n=4000)} AS b FROM m), {_token_set('z', 'ts')}, {_word_blocks('z', 'wb')}
        SELECT z.pair, old_id, new_id, CASE WHEN z.a = '' AND z.b = '' THEN 'same' WHEN ts.score >= 97 THEN 'same' END AS label, round(CASE WHEN wb.na = 0 THEN 1.0 ELSE wb.n::DOUBLE / wb.na END, 6) AS agreement FROM z JOIN ts ON ts.a = z.a AND ts.b = z.b JOIN wb ON wb.a = z.a AND wb.b = z.b""",
}
