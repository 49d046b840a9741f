"""SQL twins of the queries on chains: threads joined over gaps, their cells, and the accounts they belong to.

Joining goes on until nothing joins; here as many rounds are written out as the test tables need and one more.
"""

from __future__ import annotations

from editrail.plans.oracles import _E, BASE
from editrail.plans.oracles_compare import _KINDS, _PLACES, _REDLINES, _THREADS, COMPARE, DIFF, MATCH, lcs, ratio, words

_FULL = f"""{_E.replace('e AS', 'e0 AS', 1)},
e AS (SELECT chamber, slug, fy, package_id FROM (SELECT e0.*, count(*) OVER (PARTITION BY chamber, slug) AS years FROM e0 JOIN (SELECT package_id FROM s GROUP BY package_id HAVING count(*) >= 15) USING (package_id)) WHERE years >= 2)"""
_BODY = "left(array_to_string(list_transform(s.paragraphs, lambda z: z.text), ' '), 2000)"
_ROUNDS = 2


def _round(r: int) -> str:
    """CTEs of one round: link{r}(chamber, slug, dead, born, fy, kind) and mem{r}, the members under their new names."""
    sorted_ = lambda x: f"array_to_string(list_sort({x}), ' ')"
    return f"""
th{r} AS (SELECT chamber, slug, thread, min(struct_pack(fy := fy, id := section_id)) AS a, max(struct_pack(fy := fy, id := section_id)) AS z FROM mem{r - 1} GROUP BY ALL),
de{r} AS (SELECT th.chamber, th.slug, th.thread AS dead, yy.next_fy AS death, m.path, m.body, m.w FROM th{r} th JOIN yy ON yy.chamber = th.chamber AND yy.slug = th.slug AND yy.fy = th.z.fy JOIN mem0 m ON m.section_id = th.z.id WHERE yy.next_fy IS NOT NULL),
bn{r} AS (SELECT th.chamber, th.slug, th.thread AS born, th.a.fy AS birth, m.path, m.body, m.w FROM th{r} th JOIN yy ON yy.chamber = th.chamber AND yy.slug = th.slug AND yy.fy = th.a.fy JOIN mem0 m ON m.section_id = th.a.id WHERE th.a.fy > yy.first_fy),
sp{r} AS (SELECT d.chamber, d.slug, dead, born, death, birth, d.path[-1] = b.path[-1] AND d.path[1] = b.path[1] AND NOT starts_with(d.path[-1], 'SEC ') AS same, d.body AS db, b.body AS bb, least(length(d.body), length(b.body)) AS short, greatest(length(d.body), length(b.body)) AS long,
    list_intersect(d.w, b.w) AS shared, list_filter(d.w, lambda x: NOT list_contains(b.w, x)) AS wo, list_filter(b.w, lambda x: NOT list_contains(d.w, x)) AS wn, len(d.w) AS no_, len(b.w) AS nn
  FROM de{r} d JOIN bn{r} b ON d.chamber = b.chamber AND d.slug = b.slug WHERE birth >= death AND dead <> born),
sq{r} AS (SELECT *, {sorted_('shared')} AS base, {sorted_('wo')} AS jo, {sorted_('wn')} AS jn, len(shared) AS n_shared FROM sp{r} WHERE same OR (short >= 40 AND short >= 0.4 * long)),
ss{r} AS (SELECT jo AS a, jn AS b FROM sq{r}),
{lcs(f'ss{r}', f'lt{r}')},
st{r} AS (SELECT q.*, l.n AS lj, length(base) + CASE WHEN n_shared > 0 AND jo <> '' THEN 1 ELSE 0 END + length(jo) AS lo, length(base) + CASE WHEN n_shared > 0 AND jn <> '' THEN 1 ELSE 0 END + length(jn) AS ln FROM sq{r} q LEFT JOIN lt{r} l ON l.a = jo AND l.b = jn),
su{r} AS (SELECT *, CASE WHEN no_ = 0 OR nn = 0 THEN 0.0 WHEN n_shared > 0 AND (jo = '' OR jn = '') THEN 100.0 ELSE greatest(100.0::DOUBLE * (1 - (length(jo) + length(jn) - 2 * lj)::DOUBLE / (lo + ln)),
    CASE WHEN n_shared > 0 THEN greatest(200.0::DOUBLE * length(base) / (length(base) + lo), 200.0::DOUBLE * length(base) / (length(base) + ln)) ELSE 0 END) END AS score FROM st{r}),
sv{r} AS (SELECT * FROM su{r} WHERE (same AND score >= 45) OR score >= 80),
sw_{r} AS (SELECT db AS a, bb AS b FROM sv{r} WHERE NOT same AND short < 300),
{lcs(f'sw_{r}', f'lu{r}')},
sk{r} AS (SELECT v.*, row_number() OVER (PARTITION BY chamber, slug ORDER BY score + CASE WHEN same THEN 10 ELSE 0 END DESC, born, dead) AS k FROM sv{r} v LEFT JOIN lu{r} l ON l.a = db AND l.b = bb
  WHERE (same AND score >= 45) OR (short >= 40 AND short >= 0.4 * long AND (short >= 300 OR {ratio('db', 'bb', 'l.n')} >= 85))),
sg{r}(chamber, slug, k, taken, hit) AS (SELECT DISTINCT chamber, slug, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false FROM sk{r}
  UNION ALL SELECT g.chamber, g.slug, g.k + 1, CASE WHEN list_contains(taken, dead) OR list_contains(taken, born) THEN taken ELSE list_concat(taken, [dead, born]) END, NOT (list_contains(taken, dead) OR list_contains(taken, born))
  FROM sg{r} g JOIN sk{r} q ON q.chamber = g.chamber AND q.slug = g.slug AND q.k = g.k + 1),
link{r} AS (SELECT q.chamber, q.slug, dead, born, CASE WHEN birth = death THEN 'reorganized' ELSE 'returned' END AS kind, birth AS fy FROM sk{r} q JOIN sg{r} g ON g.chamber = q.chamber AND g.slug = q.slug AND g.k = q.k WHERE g.hit),
mem{r} AS (SELECT m.chamber, m.slug, m.fy, m.section_id, coalesce(l.dead, m.thread) AS thread FROM mem{r - 1} m LEFT JOIN link{r} l ON l.born = m.thread)"""


STITCH = (
    COMPARE.replace(_E, _FULL, 1)
    + f""",
{_THREADS},
mem0 AS (SELECT e.chamber, e.slug, e.fy, s.section_id, s.path, s.heading, s.level, {_BODY} AS body, list_distinct({words(_BODY)}) AS w, coalesce(t.head, s.section_id) AS thread FROM s JOIN e ON e.package_id = s.package_id LEFT JOIN t ON t.node = s.section_id WHERE len(s.path) > 0),
yy AS (SELECT chamber, slug, fy, lead(fy) OVER (PARTITION BY chamber, slug ORDER BY fy) AS next_fy, min(fy) OVER (PARTITION BY chamber, slug) AS first_fy FROM e),
{','.join(_round(r) for r in range(1, _ROUNDS + 1))},
links AS ({' UNION ALL '.join(f'SELECT * FROM link{r}' for r in range(1, _ROUNDS + 1))}),
ends AS (SELECT DISTINCT z.thread, l.fy FROM links l JOIN mem0 m ON m.thread = l.dead JOIN mem{_ROUNDS} z ON z.section_id = m.section_id WHERE l.kind = 'reorganized'),
cells AS (SELECT p.chamber, p.slug, z.thread, p.new_fy AS fy, x.pair, x.old_id, x.new_id, coalesce(b.kind, x.change) AS label, x.changed_words, x.score, x.renamed_from IS NOT NULL AS renamed
  FROM sections_ x JOIN p ON p.pair = x.pair JOIN mem0 f ON f.section_id = coalesce(x.new_id, x.old_id) JOIN mem{_ROUNDS} z ON z.section_id = f.section_id
  LEFT JOIN links b ON b.born = f.thread AND b.fy = p.new_fy AND x.change = 'new' LEFT JOIN ends q ON q.thread = z.thread AND q.fy = p.new_fy AND x.change = 'dropped' WHERE q.thread IS NULL),
ths AS (SELECT z.thread, sum(x.score) AS score FROM sections_ x JOIN mem{_ROUNDS} z ON z.section_id = coalesce(x.new_id, x.old_id) GROUP BY z.thread),
acc AS (SELECT z.chamber, z.slug, z.thread, min(z.fy) AS birth, max(struct_pack(fy := z.fy, id := m.section_id, path := m.path, heading := m.heading, level := m.level)) AS z, min(struct_pack(fy := z.fy, id := m.section_id, path := m.path, heading := m.heading)) AS a
  FROM mem{_ROUNDS} z JOIN mem0 m ON m.section_id = z.section_id GROUP BY ALL),
ac2 AS (SELECT acc.*, coalesce(ths.score, 0.0) AS score, CASE WHEN NOT starts_with(acc.z.path[-1], 'SEC ') AND acc.z.level >= 4 AND len(acc.z.path) > 1 THEN acc.z.path[1:len(acc.z.path) - 1] ELSE acc.z.path END AS display FROM acc LEFT JOIN ths ON ths.thread = acc.thread),
ac3 AS (SELECT *, row_number() OVER (PARTITION BY chamber, slug, display, birth ORDER BY score DESC, thread) - 1 AS nth FROM ac2),
ac4 AS (SELECT *, array_to_string(display, ' > ') || CASE WHEN starts_with(display[-1], 'SEC ') THEN ' > B' || birth || CASE WHEN nth > 0 THEN '.' || nth ELSE '' END ELSE '' END AS row_key FROM ac3),
rws AS (SELECT chamber, slug, row_key, any_value(display) AS display, max(CASE WHEN z.path = display THEN struct_pack(s := score, t := -thread, h := z.heading, l := z.path[-1], al := a.path[-1], ah := a.heading, b := birth) END) AS own, count(*) AS members, sum(score) AS score FROM ac4 GROUP BY ALL),
rc AS (SELECT ac4.chamber, ac4.slug, row_key, c.fy, list(DISTINCT label) AS labels, CAST(sum(changed_words) AS BIGINT) AS words, bool_or(renamed) AS renamed, max(CASE label WHEN 'unchanged' THEN 0 WHEN 'numbers only' THEN 1 WHEN 'minor' THEN 2 WHEN 'substantive' THEN 3 WHEN 'new' THEN 4 WHEN 'dropped' THEN 5 ELSE 3 END) AS top
  FROM ac4 JOIN cells c ON c.thread = ac4.thread GROUP BY ALL),
rl_ AS (SELECT chamber, slug, row_key, fy, words, renamed, CASE WHEN len(list_filter(labels, lambda x: x NOT IN ('dropped', 'reorganized'))) = 0 THEN CASE WHEN list_contains(labels, 'reorganized') THEN 'reorganized' ELSE 'dropped' END
    WHEN len(list_filter(labels, lambda x: x NOT IN ('new', 'returned'))) = 0 THEN CASE WHEN list_contains(labels, 'returned') THEN 'returned' ELSE 'new' END
    ELSE ['unchanged', 'numbers only', 'minor', 'substantive', 'new', 'dropped'][top + 1] END AS label FROM rc)"""
)

_TITLED = "array_to_string(list_transform(string_split(lower(display[-1]), ' '), lambda x: upper(left(x, 1)) || substr(x, 2)), ' ')"
_DUMP = "to_json(list(struct_pack(seq := seq, heading := heading, level := level, path := path, paragraphs := paragraphs, table_spans := table_spans) ORDER BY seq, heading, level))"

ORACLES = {
    "stitched_threads": f"{STITCH} SELECT section_id, thread FROM mem{_ROUNDS}",
    "stitch_links": f"{STITCH} SELECT dead, born, kind, fy FROM links",
    "thread_rows": f"{STITCH} SELECT chamber, slug, row_key, coalesce(own.h, {_TITLED}) AS heading, CASE WHEN own.al <> own.l THEN own.ah || ' (FY' || own.b || ')' END AS formerly, members, round(score, 4) AS score FROM rws",
    "row_cells": f"{STITCH} SELECT chamber, slug, row_key, fy, label, words, renamed FROM rl_",
    "active_rows": f"{STITCH} SELECT chamber, slug, row_key, count(*) AS n FROM rl_ GROUP BY ALL HAVING bool_or(label NOT IN ('unchanged', 'numbers only'))",
    "transition_heat": f"{STITCH}, h AS (SELECT chamber, slug, fy, CAST(sum(changed_words) AS BIGINT) AS words FROM cells GROUP BY ALL) SELECT *, CAST(greatest(4, round(100 * words / greatest(max(words) OVER (PARTITION BY chamber, slug), 1))) AS INTEGER) AS heat FROM h",
    "section_rows": f"{STITCH} SELECT m.section_id, ac4.row_key FROM ac4 JOIN mem{_ROUNDS} m ON m.thread = ac4.thread",
    "thread_words": f"{STITCH} SELECT thread, fy, CAST(sum(changed_words) AS BIGINT) AS words FROM cells GROUP BY ALL",
    "section_dump": f"{BASE} SELECT package_id, {_DUMP} AS json FROM s GROUP BY package_id",
    "manifest": f"""{DIFF}, {_KINDS}, ix AS (SELECT pair, CAST(sum(c) AS BIGINT) AS changed, CAST(sum(n) AS BIGINT) AS new, CAST(sum(g) AS BIGINT) AS dropped FROM (SELECT pair, CAST(kind <> 'unchanged' AS INTEGER) AS c, 0 AS n, 0 AS g FROM ki UNION ALL SELECT pair, 0, 1, 0 FROM come UNION ALL SELECT pair, 0, 0, 1 FROM gone) GROUP BY pair),
      rf AS (SELECT pair, count(*) AS n FROM pd JOIN fl ON fl.eid = pd.eid WHERE fl.tier >= 2 GROUP BY pair), ct AS (SELECT * FROM catalog_entries QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY loaded_at DESC) = 1),
      wh AS (SELECT w.package_id, struct_pack(package_id := w.package_id, url := CASE WHEN ct.package_id IS NULL THEN NULL WHEN regexp_matches(coalesce(html_url, ''), '(?i)^https?://') THEN html_url ELSE '' END, read_from := CASE WHEN ct.package_id IS NULL THEN NULL WHEN coalesce(from_pdf, false) THEN 'pdf' ELSE 'htm' END, sha256 := sha256(json)) AS r
        FROM (SELECT package_id, {_DUMP} AS json FROM s GROUP BY package_id) w LEFT JOIN ct ON ct.package_id = w.package_id)
      SELECT p.pair, to_json(struct_pack(pair := p.pair, sections := struct_pack(changed := coalesce(changed, 0), "new" := coalesce(new, 0), dropped := coalesce(dropped, 0)), review_flags := coalesce(rf.n, 0), "old" := a.r, "new" := b.r)) AS json
      FROM p LEFT JOIN ix ON ix.pair = p.pair LEFT JOIN rf ON rf.pair = p.pair LEFT JOIN wh a ON a.package_id = p.old_package LEFT JOIN wh b ON b.package_id = p.new_package""",
    "document_page": f"""{COMPARE}, {_REDLINES}, {_PLACES}, rt AS (SELECT eid, count(*) FILTER (tier >= 2) AS n FROM fl GROUP BY eid),
      rw AS (SELECT pd.pair, pd.old_id, pd.new_id, pd.idx, CASE WHEN a.pair IS NOT NULL OR b.pair IS NOT NULL THEN 'moved' ELSE pd.change END AS change, md5(CASE WHEN pd.change = 'new' THEN '<ins>' || new_text || '</ins>' WHEN pd.change = 'dropped' THEN '<del>' || old_text || '</del>' ELSE coalesce(rl.line, new_text) END) AS body,
          CAST(coalesce(rt.n, 0) + CAST(a.pair IS NOT NULL AS INTEGER) + CAST(b.pair IS NOT NULL AS INTEGER) AS INTEGER) AS n_notes
        FROM pd LEFT JOIN wt ON wt.a = pd.old_text AND wt.b = pd.new_text LEFT JOIN rl ON rl.sid = wt.sid LEFT JOIN rt ON rt.eid = pd.eid LEFT JOIN mv a ON a.pair = pd.pair AND a.new_key = pd.new_id || ':' || pd.j LEFT JOIN mv b ON b.pair = pd.pair AND b.old_key = pd.old_id || ':' || pd.i)
      SELECT pl.pair, pl.old_id, pl.new_id, CAST(place_new AS INTEGER) AS place_new, CAST(place_old AS INTEGER) AS place_old, q.change AS section_change, rw.idx, rw.change, rw.body, rw.n_notes FROM pl JOIN sections_ q ON q.pair = pl.pair AND q.old_id IS NOT DISTINCT FROM pl.old_id AND q.new_id IS NOT DISTINCT FROM pl.new_id
      LEFT JOIN rw ON rw.pair = pl.pair AND rw.old_id = pl.old_id AND rw.new_id = pl.new_id""",
}
