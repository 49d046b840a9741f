"""SQL that the core queries are checked with, in another engine's dialect and written apart from them."""

from __future__ import annotations

_S = "s AS (SELECT * REPLACE (coalesce(paragraphs, []) AS paragraphs) FROM sections QUALIFY row_number() OVER (PARTITION BY section_id ORDER BY loaded_at DESC) = 1)"
_E = "e AS (SELECT chamber, lower(subcommittee) AS slug, fiscal_year AS fy, max(package_id) AS package_id FROM reports WHERE fiscal_year IS NOT NULL GROUP BY ALL)"
_Y = "y AS (SELECT *, lag(fy) OVER w AS old_fy, lag(package_id) OVER w AS old_package FROM e WINDOW w AS (PARTITION BY chamber, slug ORDER BY fy))"
_P = "p AS (SELECT concat_ws('-', chamber, slug, 'fy' || old_fy, 'fy' || fy) AS pair, chamber, slug, old_fy, fy AS new_fy, old_package, package_id AS new_package FROM y WHERE old_fy IS NOT NULL)"
_SIDES = """o AS (SELECT p.pair, s.* FROM p JOIN s ON s.package_id = p.old_package WHERE len(s.path) > 0),
n AS (SELECT p.pair, s.* FROM p JOIN s ON s.package_id = p.new_package WHERE len(s.path) > 0)"""
_M = """oo AS (SELECT *, row_number() OVER (PARTITION BY pair, path ORDER BY seq, section_id) AS occ FROM o),
nn AS (SELECT *, row_number() OVER (PARTITION BY pair, path ORDER BY seq, section_id) AS occ FROM n),
m AS (SELECT oo.pair, oo.section_id AS old_id, nn.section_id AS new_id, oo.paragraphs AS op, nn.paragraphs AS np, oo.seq AS old_seq, nn.seq AS new_seq, nn.path
  FROM oo JOIN nn ON oo.pair = nn.pair AND oo.path = nn.path AND oo.occ = nn.occ)"""
BASE = f"WITH {_S}, {_E}, {_Y}, {_P}, {_SIDES}, {_M}"
_PARA = "q AS (SELECT * FROM paragraphs QUALIFY row_number() OVER (PARTITION BY para_id ORDER BY loaded_at DESC) = 1)"
_CAT = """c AS (SELECT * FROM catalog_entries QUALIFY row_number() OVER (PARTITION BY package_id ORDER BY loaded_at DESC) = 1),
k AS (SELECT package_id, congress, chamber, subcommittee, fiscal_year, coalesce(stage, 'committee') AS stage, coalesce(title, '') AS title, coalesce(html_url, '') AS html_url,
  coalesce(pdf_url, '') AS pdf_url, coalesce(local_path, '') AS local_path, coalesce(source, '') AS source, coalesce(from_pdf, false) AS from_pdf FROM c)"""


def _mask(x: str) -> str:
    months = "January|February|March|April|May|June|July|August|September|October|November|December"
    return (
        rf"regexp_replace(regexp_replace(regexp_replace({x}, '\b(?:19|20)\d{{2}}\b', '#Y', 'g'), '\$?\b\d[\d,]*(?:\.\d+)?\b', '#', 'g'), "
        rf"'\b(?:{months})\s+#(?:,\s*#Y)?', '#D', 'g')"
    )


def _joined(x: str) -> str:
    return f"array_to_string(list_transform({x}, lambda z: coalesce(z.text, '')), chr(10))"


ORACLES = {
    "catalog_latest": f"WITH {_CAT} SELECT package_id, chamber, subcommittee, fiscal_year, stage, title FROM k",
    "catalog_upsert": f"WITH {_CAT} SELECT package_id, CASE WHEN stage = 'reported' THEN 'committee' ELSE stage END AS stage, fiscal_year FROM k",
    "usable_reports": f"""WITH {_CAT} SELECT package_id, chamber, subcommittee, fiscal_year FROM k
        WHERE stage = 'committee' AND trim(coalesce(subcommittee, '')) <> '' AND fiscal_year IS NOT NULL AND NOT starts_with(upper(title), 'MAKING')""",
    "like_for_like": f"""WITH {_CAT}, x AS (SELECT *, bool_or(local_path <> '') OVER (PARTITION BY chamber, fiscal_year) AS pre FROM k)
        SELECT package_id, CASE WHEN pre AND local_path = '' THEN true ELSE from_pdf END AS from_pdf FROM x WHERE NOT pre OR local_path <> '' OR pdf_url <> ''""",
    "catalog_paths": rf"""WITH {_CAT}, x AS (SELECT *, CASE WHEN local_path <> '' THEN local_path ELSE format('raw/{{}}/{{}}/{{}}.htm', congress, chamber, package_id) END AS path FROM k)
        SELECT package_id, path, regexp_replace(path, '\.htm$', '.pdf') AS pdf, CASE WHEN regexp_matches(html_url, '(?i)^https?://') THEN html_url ELSE '' END AS url FROM x""",
    "lexicon_unambiguous": f"""WITH {_S}, x AS (SELECT trim(regexp_replace(regexp_replace(upper(path[3]), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS name,
          trim(regexp_replace(regexp_replace(upper(path[2]), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS parent FROM s WHERE len(path) >= 3),
        z AS (SELECT * FROM x WHERE name <> '' AND parent <> '')
        SELECT name, min(parent) AS parent FROM z GROUP BY name HAVING count(DISTINCT parent) = 1 AND name NOT IN (SELECT parent FROM z)""",
    "pair_adjacent_years": f"{BASE} SELECT pair, old_fy, new_fy, old_package, new_package, CAST(greatest(1, new_fy - old_fy) AS INTEGER) AS year_delta FROM p",
    "chain_transitions": f"{BASE} SELECT chamber, slug, old_fy AS from_fy, fy AS to_fy FROM y WHERE old_fy IS NOT NULL",
    "stub_editions": f"""{BASE}, c AS (SELECT package_id, count(*) AS sections FROM s GROUP BY 1 HAVING count(*) >= 15)
        SELECT package_id, chamber, slug, fy, sections FROM e JOIN c USING (package_id) QUALIFY count(*) OVER (PARTITION BY chamber, slug) >= 2""",
    "align_exact_path": f"{BASE} SELECT pair, old_id, new_id FROM m",
    "align_unique_heading": f"""{BASE},
        fo AS (SELECT o.pair, o.path[-1] AS leaf, min(o.section_id) AS old_id FROM o LEFT JOIN m ON m.pair = o.pair AND m.old_id = o.section_id
          WHERE m.old_id IS NULL AND NOT starts_with(o.path[-1], 'SEC ') GROUP BY ALL HAVING count(*) = 1),
        fn AS (SELECT n.pair, n.path[-1] AS leaf, min(n.section_id) AS new_id FROM n LEFT JOIN m ON m.pair = n.pair AND m.new_id = n.section_id
          WHERE m.new_id IS NULL AND NOT starts_with(n.path[-1], 'SEC ') GROUP BY ALL HAVING count(*) = 1)
        SELECT fo.pair, old_id, new_id FROM fo JOIN fn ON fo.pair = fn.pair AND fo.leaf = fn.leaf""",
    "mask_text": f"WITH {_PARA} SELECT para_id, md5({_mask('text')}) AS masked FROM q WHERE text IS NOT NULL",
    "anchors": f"""WITH {_S}, b AS (SELECT *, 's-' || left(array_to_string(list_transform(path, lambda z: replace(lower(z), ' ', '_')), '-'), 60) || '-' || left(md5(array_to_string(path, ' > ')), 6) AS base FROM s WHERE len(path) > 0),
        x AS (SELECT section_id, base, row_number() OVER (PARTITION BY package_id, base ORDER BY seq, section_id) AS nth FROM b)
        SELECT section_id, CASE WHEN nth = 1 THEN base ELSE base || '-' || nth END AS anchor FROM x""",
    "masked_section_changes": f"""{BASE}, x AS (SELECT pair, {_joined('op')} AS a, {_joined('np')} AS b FROM m)
        SELECT pair, CASE WHEN a = b THEN 'unchanged' WHEN {_mask('a')} = {_mask('b')} THEN 'numbers only' ELSE 'language' END AS kind, count(*) AS n FROM x GROUP BY ALL""",
    "thread_names": f"""WITH {_S} SELECT section_id, left(replace(trim(regexp_replace(lower(array_to_string(path, ' ')), '[^a-z0-9]+', ' ', 'g')), ' ', '-'), 90) || '-' || left(md5(array_to_string(path, ' > ')), 6) AS name FROM s WHERE len(path) > 0""",
    "directive_sections": f"WITH {_S} SELECT section_id, package_id FROM s WHERE len(list_filter(paragraphs, lambda z: z.kind = 'directive')) > 0",
    "token_sets": rf"""{BASE}, w AS (SELECT pair, old_id, new_id, list_distinct(list_filter(string_split_regex(lower(array_to_string(list_transform(op, lambda z: coalesce(z.text, '')), ' ')), '[ \t\r\n]+'), lambda v: v <> '')) AS a,
          list_distinct(list_filter(string_split_regex(lower(array_to_string(list_transform(np, lambda z: coalesce(z.text, '')), ' ')), '[ \t\r\n]+'), lambda v: v <> '')) AS b FROM m)
        SELECT pair, old_id, new_id, CAST(len(list_intersect(a, b)) AS INTEGER) AS shared, CAST(len(a) - len(list_intersect(a, b)) AS INTEGER) AS only_old, CAST(len(b) - len(list_intersect(a, b)) AS INTEGER) AS only_new FROM w""",
    "linkage_by_pass": """WITH c AS (SELECT DISTINCT * FROM linkage_candidates WHERE score IS NOT NULL), x AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY decided_at DESC) = 1)
        SELECT match_pass, count(*) AS n, CAST(count_if(accepted) AS BIGINT) AS "right", CAST(count_if(NOT auto) AS BIGINT) AS reviewed FROM x WHERE accepted IS NOT NULL GROUP BY match_pass""",
    "linkage_sweep": """WITH c AS (SELECT DISTINCT * FROM linkage_candidates WHERE score IS NOT NULL), x AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY decided_at DESC) = 1),
        b AS (SELECT CAST(70 + unnest([-15, -10, -5, 0, 5, 10, 15]) AS DOUBLE) AS bar)
        SELECT bar, CAST(count_if(score >= bar AND accepted) AS BIGINT) AS "right", CAST(count_if(score >= bar AND NOT accepted) AS BIGINT) AS wrong, CAST(count_if(score < bar AND accepted) AS BIGINT) AS missed FROM x, b WHERE accepted IS NOT NULL GROUP BY bar""",
    "duplicate_paths": f"WITH {_S} SELECT package_id, array_to_string(path, ' > ') AS path, count(*) AS n FROM s GROUP BY ALL HAVING count(*) > 1",
    "resumed_parents": f"""WITH {_S}, a AS (SELECT package_id, seq, section_id, array_to_string(path[1:2], ' > ') AS parent FROM s WHERE len(path) > 1),
        b AS (SELECT *, lag(parent) OVER (PARTITION BY package_id ORDER BY seq, section_id) AS before FROM a), c AS (SELECT package_id, parent, count(*) - 1 AS again FROM b WHERE before IS DISTINCT FROM parent GROUP BY ALL)
        SELECT package_id, CAST(sum(again) AS BIGINT) AS n FROM c GROUP BY package_id HAVING sum(again) > 0""",
    "parent_drift": f"""{BASE}, u AS (SELECT e.chamber, e.slug, e.fy, s.path[-1] AS heading, min(s.path[-2]) AS parent FROM s JOIN e ON s.package_id = e.package_id WHERE len(s.path) > 1 GROUP BY ALL HAVING count(*) = 1)
        SELECT a.chamber, a.slug, a.heading, a.fy AS old_fy, b.fy AS new_fy, a.parent AS old_parent, b.parent AS new_parent
        FROM p JOIN u a ON a.chamber = p.chamber AND a.slug = p.slug AND a.fy = p.old_fy JOIN u b ON b.chamber = p.chamber AND b.slug = p.slug AND b.fy = p.new_fy AND b.heading = a.heading WHERE a.parent <> b.parent""",
    "outline_nodes": f"""WITH {_S}, a AS (SELECT package_id, seq, section_id, path, lag(path) OVER (PARTITION BY package_id ORDER BY seq, section_id) AS before FROM s WHERE len(path) > 0),
        b AS (SELECT *, unnest(range(1, len(path) + 1)) AS depth FROM a),
        c AS (SELECT *, sum(CASE WHEN before[1:depth] IS NOT DISTINCT FROM path[1:depth] THEN 0 ELSE 1 END) OVER (PARTITION BY package_id, depth ORDER BY seq, section_id) AS node FROM b)
        SELECT package_id, CAST(depth AS INTEGER) AS depth, CAST(node AS BIGINT) AS node, array_to_string(min(path[1:depth]), ' > ') AS prefix, min(seq) AS first_seq, count(*) AS sections FROM c GROUP BY package_id, depth, node""",
    "merged_labels": """WITH c AS (SELECT least(old_section_id, new_section_id) AS a, greatest(old_section_id, new_section_id) AS b, accepted, auto, decided_at FROM linkage_candidates
          WHERE old_section_id IS NOT NULL AND new_section_id IS NOT NULL AND accepted IS NOT NULL)
        SELECT a, b, accepted, auto AS drafted FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY auto, decided_at DESC, accepted DESC) AS rn FROM c) WHERE rn = 1""",
    "stratified_sample": f"""WITH {_PARA}, {_E} SELECT para_id, kind, fy, turn FROM (SELECT para_id, kind, fy, CAST(row_number() OVER (PARTITION BY kind, fy ORDER BY md5(CAST(para_id AS VARCHAR)), para_id) AS INTEGER) AS turn
        FROM q JOIN e USING (package_id)) WHERE turn <= 5""",
}
