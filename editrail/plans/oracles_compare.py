"""The whole comparison of editions once more, in the other engine's SQL, from the sections to ranked changes.

Written apart from the operators: the longest common subsequence is a recursion over bit strings that adds by carries, the
matching blocks of difflib a recursion over ranges of diagonal runs, greedy choices a recursion over ranks.
"""

from __future__ import annotations

from editrail.plans.oracles import BASE, _mask

# Text as the other engine's ASCII word boundaries, blanks and digits need it: other letters and digits as one word character, other blanks as a blank.
_BLANK = r"[\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LETTER = r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]"


def letters(x: str) -> str:
    """Other letters and digits as one word character; blanks as they are, since a phrase's blanks are plain ones."""
    return f"regexp_replace({x}, '{_LETTER}', '_', 'g')"


def plain(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_BLANK}', ' ', 'g'), '{_LETTER}', '_', 'g')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace({x}, '{_BLANK}', ' ', 'g'), '\s+'), lambda w: w <> '')"


def lcs(pairs: str, name: str) -> str:
    """CTE name(a, b, n): length of the longest common subsequence of each pair (a, b) of strings of at most 2,048 characters in `pairs`."""
    g, p = f"v & coalesce(m, z)", "v & ~coalesce(m, z)"
    step = f"SELECT a, b, k, v, z, coalesce(m, z) AS m, {g} AS g, {p} AS p FROM {{src}}"
    inner = step
    for d in (1 << k for k in range(11)):
        inner = f"SELECT a, b, k, v, z, m, g | (p & (g << {d})) AS g, p & (p << {d}) AS p FROM ({inner})"
    src = f"(SELECT r.a, r.b, r.k, r.v, r.z, x.m FROM {name}_r r LEFT JOIN {name}_m x ON x.a = r.a AND x.c = substr(r.b, r.k + 1, 1) WHERE r.k < length(r.b))"
    inner = inner.format(src=src)
    return f"""{name}_i AS (SELECT DISTINCT a, b FROM {pairs} WHERE a <> '' AND b <> ''),
    {name}_m AS (SELECT a, c, array_to_string(list_reverse(list_transform(string_split(a, ''), lambda q: CASE WHEN q = c THEN '1' ELSE '0' END)), '')::BIT AS m
      FROM (SELECT a, unnest(list_distinct(string_split(a, ''))) AS c FROM (SELECT DISTINCT a FROM {name}_i))),
    {name}_r(a, b, k, v, z) USING KEY (a, b) AS (
      SELECT a, b, 0, repeat('1', length(a))::BIT, repeat('0', length(a))::BIT FROM {name}_i
      UNION SELECT a, b, k + 1, xor(xor(v, v & m), g << 1) | (v & ~m), z FROM ({inner})
    ),
    {name} AS (SELECT a, b, length(a) - bit_count(v) AS n FROM {name}_r UNION ALL SELECT DISTINCT a, b, 0 FROM {pairs} WHERE a = '' OR b = '')"""


def ratio(a: str, b: str, n: str) -> str:
    return f"CASE WHEN length({a}) + length({b}) = 0 THEN 100.0::DOUBLE ELSE 200.0::DOUBLE * {n} / (length({a}) + length({b})) END"


_BODY = "array_to_string(list_transform({x}, lambda z: z.text), ' ')"
_SORTED = "array_to_string(list_sort(string_split(path[-1], ' ')), ' ')"


def _side(free: str) -> str:
    return f"SELECT pair, section_id, path, seq, sort_order, left({_BODY.format(x='paragraphs')}, 2000) AS body, list_distinct({words('left(' + _BODY.format(x='paragraphs') + ', 2000)')}) AS w, {_SORTED} AS sorted FROM {free}"


def _words_of(xs: str) -> str:
    return f"array_to_string(list_sort({xs}), ' ')"


MATCH = (
    BASE.replace("WITH ", "WITH RECURSIVE ", 1)
    + f""",
m0 AS (SELECT pair, old_id, new_id, 'exact' AS match_pass, 100.0::DOUBLE AS score FROM m),
u AS (SELECT a.pair, a.id AS old_id, b.id AS new_id FROM
    (SELECT pair, path[-1] AS leaf, min(section_id) AS id FROM o ANTI JOIN m0 ON m0.pair = o.pair AND m0.old_id = o.section_id GROUP BY ALL HAVING count(*) = 1) a
    JOIN (SELECT pair, path[-1] AS leaf, min(section_id) AS id FROM n ANTI JOIN m0 ON m0.pair = n.pair AND m0.new_id = n.section_id GROUP BY ALL HAVING count(*) = 1) b ON a.pair = b.pair AND a.leaf = b.leaf),
m1 AS (SELECT * FROM m0 UNION ALL SELECT pair, old_id, new_id, 'unique_heading', 100.0 FROM u),
fo AS ({_side('o ANTI JOIN m1 ON m1.pair = o.pair AND m1.old_id = o.section_id')}),
fn AS ({_side('n ANTI JOIN m1 ON m1.pair = n.pair AND m1.new_id = n.section_id')}),
pp AS (SELECT fo.pair, fo.section_id AS old_id, fn.section_id AS new_id, fo.path AS op, fn.path AS np, fo.seq AS old_rank, fn.seq AS new_rank, abs(fo.sort_order - fn.sort_order) AS apart, fo.body AS bo, fn.body AS bn,
    fo.path[1] = fn.path[1] AS same_title, fo.path[1:len(fo.path) - 1] = fn.path[1:len(fn.path) - 1] AS same_parent, fo.sorted AS ho, fn.sorted AS hn, left(fo.body, 1500) AS so, left(fn.body, 1500) AS sn,
    list_intersect(fo.w, fn.w) AS shared, list_filter(fo.w, lambda x: NOT list_contains(fn.w, x)) AS wo, list_filter(fn.w, lambda x: NOT list_contains(fo.w, x)) AS wn
  FROM fo JOIN fn ON fo.pair = fn.pair AND (fo.path[1] = fn.path[1] OR (len(fo.path) = 1 AND len(fn.path) = 1))),
pq AS (SELECT *, {_words_of('shared')} AS base, {_words_of('wo')} AS jo, {_words_of('wn')} AS jn, len(shared) AS n_shared, len(shared) + len(wo) AS n_o, len(shared) + len(wn) AS n_n FROM pp),
strings AS (SELECT ho AS a, hn AS b FROM pq WHERE same_parent UNION SELECT so, sn FROM pq WHERE same_parent UNION SELECT jo, jn FROM pq),
{lcs('strings', 'l')},
ps AS (SELECT pq.*, CASE WHEN same_parent THEN {ratio('ho', 'hn', 'lh.n')} END AS heading, CASE WHEN same_parent THEN {ratio('so', 'sn', 'lb.n')} END AS bodies, lj.n AS lj,
    length(base) + CASE WHEN n_shared > 0 AND jo <> '' THEN 1 ELSE 0 END + length(jo) AS len_o, length(base) + CASE WHEN n_shared > 0 AND jn <> '' THEN 1 ELSE 0 END + length(jn) AS len_n
  FROM pq LEFT JOIN l lh ON lh.a = ho AND lh.b = hn LEFT JOIN l lb ON lb.a = so AND lb.b = sn LEFT JOIN l lj ON lj.a = jo AND lj.b = jn),
pt AS (SELECT *, CASE WHEN n_o = 0 OR n_n = 0 THEN 0.0 WHEN n_shared > 0 AND (jo = '' OR jn = '') THEN 100.0
      ELSE greatest(100.0::DOUBLE * (1 - (length(jo) + length(jn) - 2 * lj)::DOUBLE / (len_o + len_n)),
        CASE WHEN n_shared > 0 THEN greatest(200.0::DOUBLE * length(base) / (length(base) + len_o), 200.0::DOUBLE * length(base) / (length(base) + len_n)) ELSE 0 END) END AS alike FROM ps),
sc AS (SELECT pair, old_id, new_id, op, np, old_rank, new_rank, same_title, same_parent, length(bo) AS old_length, length(bn) AS new_length, alike, alike - 0.05::DOUBLE * apart AS content,
    CASE WHEN heading >= 60 THEN 0.6::DOUBLE * heading + 0.4::DOUBLE * bodies END AS fuzzy FROM pt),
passes AS (SELECT pair, old_id, new_id, old_rank, new_rank, 1 AS pass, 'fuzzy_heading' AS match_pass, fuzzy AS score, 70.0 AS bar FROM sc WHERE same_parent AND fuzzy IS NOT NULL
  UNION ALL SELECT pair, old_id, new_id, old_rank, new_rank, 2, 'content_parent', content, 80.0 FROM sc WHERE same_parent UNION ALL SELECT pair, old_id, new_id, old_rank, new_rank, 3, 'content_title', content, 80.0 FROM sc WHERE same_title),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY pass, score DESC, new_rank, old_rank) AS k FROM passes WHERE score >= bar),
g(pair, k, taken, hit) AS (SELECT DISTINCT pair, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false FROM ranked
  UNION ALL SELECT g.pair, g.k + 1, CASE WHEN list_contains(taken, 'o' || old_id) OR list_contains(taken, 'n' || new_id) THEN taken ELSE list_concat(taken, ['o' || old_id, 'n' || new_id]) END,
    NOT (list_contains(taken, 'o' || old_id) OR list_contains(taken, 'n' || new_id)) FROM g JOIN ranked r ON r.pair = g.pair AND r.k = g.k + 1),
tk AS (SELECT r.* FROM ranked r JOIN g ON g.pair = r.pair AND g.k = r.k WHERE g.hit),
m2 AS (SELECT * FROM m1 UNION ALL SELECT pair, old_id, new_id, match_pass, score FROM tk),
bc AS (SELECT sc.*, row_number() OVER (PARTITION BY pair, old_id ORDER BY alike DESC, new_rank) = 1 AS old_best, row_number() OVER (PARTITION BY pair, new_id ORDER BY alike DESC, old_rank) = 1 AS new_best
  FROM sc ANTI JOIN m2 x ON x.pair = sc.pair AND x.old_id = sc.old_id ANTI JOIN m2 y ON y.pair = sc.pair AND y.new_id = sc.new_id WHERE same_title AND alike >= 50),
paths AS (SELECT m2.pair, o.path AS op, n.path AS np FROM m2 JOIN o ON o.pair = m2.pair AND o.section_id = m2.old_id JOIN n ON n.pair = m2.pair AND n.section_id = m2.new_id),
bp AS (SELECT *, op[1:len(op) - 1] AS po, np[1:len(np) - 1] AS pn, string_split(op[-1], ' ') AS wo, string_split(np[-1], ' ') AS wn FROM bc WHERE old_best AND new_best),
rn AS (SELECT DISTINCT bp.pair, old_id, new_id, alike FROM bp LEFT JOIN paths q ON q.pair = bp.pair AND q.op = po
  WHERE alike >= CASE WHEN old_length < 200 OR new_length < 200 THEN 85 WHEN po = pn AND (len(list_filter(wo, lambda x: NOT list_contains(wn, x))) = 0 OR len(list_filter(wn, lambda x: NOT list_contains(wo, x))) = 0) THEN 55 ELSE 65 END
    AND (po = pn OR q.np = pn OR po[1:least(len(po), len(pn))] = pn[1:least(len(po), len(pn))])),
mm AS (SELECT * FROM m2 UNION ALL SELECT pair, old_id, new_id, 'renamed', alike FROM rn),
gone AS (SELECT o.* FROM o ANTI JOIN mm ON mm.pair = o.pair AND mm.old_id = o.section_id), come AS (SELECT n.* FROM n ANTI JOIN mm ON mm.pair = n.pair AND mm.new_id = n.section_id)"""
)

TRACE = """, d AS (SELECT p.*, coalesce(a.pass, 9) AS oa, coalesce(b.pass, 9) AS na FROM passes p LEFT JOIN tk a ON a.pair = p.pair AND a.old_id = p.old_id LEFT JOIN tk b ON b.pair = p.pair AND b.new_id = p.new_id)
SELECT d.pair, d.old_id, d.new_id, d.match_pass, round(d.score, 6) AS score, t.pair IS NOT NULL AS accepted FROM d LEFT JOIN tk t ON t.pair = d.pair AND t.old_id = d.old_id AND t.new_id = d.new_id AND t.pass = d.pass
WHERE d.score >= d.bar - 20 AND d.oa >= d.pass AND d.na >= d.pass"""


def blocks(name: str, a: str, b: str) -> str:
    """CTEs name(sid, bi, bj, bn): difflib's matching blocks of two sequences; {name}_g(sid, i1, i2, j1, j2): what lies between them.

    a(sid, i, t), b(sid, j, t): the elements. Of the longest blocks the earliest in a counts, then in b, and so on before and after it.
    """
    best = "max(struct_pack(n := e - s, ni := -(i0 + s), nj := -(j0 + s))) AS best"
    clip = "greatest(0, alo - i0, blo - j0) AS s, least(len, ahi - i0, bhi - j0) AS e"
    take = f"SELECT sid, alo, ahi, blo, bhi, -best.ni AS bi, -best.nj AS bj, best.n AS bn FROM (SELECT sid, alo, ahi, blo, bhi, {best} FROM (SELECT c.*, i0, j0, {clip} FROM {{src}} c JOIN {name}_u q ON q.sid = c.sid) WHERE e > s GROUP BY ALL)"
    return f"""{name}_n AS (SELECT coalesce(x.sid, y.sid) AS sid, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM (SELECT sid, count(*) AS n FROM {a} GROUP BY sid) x FULL JOIN (SELECT sid, count(*) AS n FROM {b} GROUP BY sid) y ON x.sid = y.sid),
    {name}_u AS (SELECT sid, min(i) AS i0, min(j) AS j0, count(*) AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY sid, i - j ORDER BY i) AS island FROM (SELECT x.sid, x.i, y.j FROM {a} x JOIN {b} y ON x.sid = y.sid AND x.t = y.t)) GROUP BY sid, i - j, island),
    {name}_r(sid, alo, ahi, blo, bhi, bi, bj, bn) AS (
      {take.format(src=f"(SELECT sid, CAST(0 AS BIGINT) AS alo, na AS ahi, CAST(0 AS BIGINT) AS blo, nb AS bhi FROM {name}_n)")}
      UNION ALL {take.format(src=f"(SELECT sid, alo, bi AS ahi, blo, bj AS bhi FROM {name}_r UNION ALL SELECT sid, bi + bn, ahi, bj + bn, bhi FROM {name}_r)")}
    ),
    {name} AS (SELECT sid, bi, bj, bn FROM {name}_r),
    {name}_g AS (SELECT sid, i1, i2, j1, j2 FROM (SELECT sid, lag(bi + bn, 1, 0) OVER w AS i1, bi AS i2, lag(bj + bn, 1, 0) OVER w AS j1, bj AS j2 FROM (SELECT * FROM {name} UNION ALL SELECT sid, na, nb, 0 FROM {name}_n) WINDOW w AS (PARTITION BY sid ORDER BY bi, bj)) WHERE i2 > i1 OR j2 > j1)"""


def _key(p: str) -> str:
    return f"CASE WHEN {p}.topic <> '' THEN {p}.kind || ':' || lower({p}.topic) ELSE left({_mask(f'lower(coalesce({p}.text, chr(0)))')}, 120) END"


# Fixed values once more, as this engine's patterns.
_FORCE = {
    "mandatory": r"\b(shall|must|requires?|required|directs?|directed|instructs?|instructed|mandates)\b",
    "expectation": r"\b(expects?|expected|should|will)\b",
    "hortatory": r"\b(urges?|urged|encourages?|encouraged|recommends?|requests?|requested|consider)\b",
    "permissive": r"\b(may|can|allows?|allowed|permits?|permitted|authorizes?|authorized|discretion)\b",
}
_FUNDED = r"\brecommends?\s+(?:\S+\s+){0,3}\$"
_FAMILY = {
    "negation": r"\b(not|no|never|none|neither|nor|cannot|without)\b",
    "prohibition": r"\b(prohibit\w*|none of the funds|no funds|may not|shall not|must not|restrict\w*|preclud\w*|ban(?:s|ned)?|forbid\w*|barred)\b",
    "eligibility": r"\b(eligib\w*|ineligib\w*|qualif\w*|only|exclusively|solely|limited to|priority|prioritiz\w*|preference|except|exclud\w*|exempt\w*)\b",
    "condition": r"\b(unless|until|provided(?:, however,)? that|subject to|contingent|conditions?|conditioned|only if|if|prior to|notwithstanding|approv\w*|in consultation with|in coordination with)\b",
    "reporting": r"\b(reports?|briefings?|brief|notif\w*|certif\w*|submit\w*|testify|testimony)\b",
    "provision": r"\b(modif\w*|amend\w*|new provision|repeal\w*|rescind\w*|rescission\w*|extend\w*|terminat\w*|expir\w*)\b",
}
_LIMIT = r"\b(not less than|not more than|not to exceed|no more than|no less than|no fewer than|not fewer than|up to|at least|a minimum of|a maximum of|minimum|maximum|cap|ceiling|limited to|limits? to|limit)\b"
_DEADLINE = r"\b(not later than|no later than|within|deadline)\b"
_SCOPED = r"\b(not less than|not more than|not to exceed|no more than|no less than|no fewer than|not fewer than|not later than|no later than|none of the funds|no funds|may not|shall not|must not)\b"
_CITED = r"\b(section|sections|sec|secs|title|division|public law|law|paragraph|subsection|clause|u\.?s\.?c|stat|number|no|h\.?r|s|report|rept|congress)\s*$"
_SPELT = "one two three four five six seven eight nine ten eleven twelve fifteen twenty thirty forty forty-five fifty sixty ninety hundred".split()
_VALUES = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 15, 20, 30, 40, 45, 50, 60, 90, 100]
_STOP = "a an the of and to in on for its their his her this that these those such also date as with by at is are be been being which who whom whose it further additionally therefore however".split()
_PUNCT = r"[.,;:()\[\]\x{22}\x{27}\x{201c}\x{201d}\x{2018}\x{2019}]+"


def _n(pattern: str, text: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def family(name: str, text: str) -> str:
    """Count of a family's phrases in a lower-cased text made plain."""
    if name == "hortatory":
        spaced = f"regexp_replace({text}, '{_BLANK}', ' ', 'g')"
        return f"({_n(_FORCE[name], text)} - {_n(_FUNDED, spaced)})"
    if name == "negation":
        return _n(_FAMILY[name], f"regexp_replace({text}, '{_SCOPED}', ' ', 'g')")
    return _n((_FORCE | _FAMILY | {"limit": _LIMIT, "deadline": _DEADLINE})[name], text)


def bare(word: str) -> str:
    return f"regexp_replace(regexp_replace(lower({word}), '^{_PUNCT}', ''), '{_PUNCT}$', '')"


def value(b: str) -> str:
    """The number that a bare word is, null if none."""
    t = f"regexp_replace(replace(replace({b}, '$', ''), ',', ''), '%+$', '')"
    spelt = " ".join(f"WHEN '{w}' THEN {v}" for w, v in zip(_SPELT, _VALUES))
    return rf"CASE {t} {spelt} ELSE CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?') THEN TRY_CAST({t} AS DOUBLE) END END"


def _window(tokens: str, a: str, b: str, pad: int) -> str:
    return plain(f"lower(array_to_string({tokens}[greatest(0, {a} - {pad}) + 1:{b} + {pad}], ' '))")


_TOKENS = "[{}]".format(", ".join(f"'{w}'" for w in _STOP))
_NAMES = [*_FORCE, *_FAMILY]
_COUNTS = ", ".join(f"{family(c, 'lo')} AS o_{c}, {family(c, 'ln')} AS n_{c}" for c in _NAMES)
_H_COUNTS = ", ".join(f"{family(c, 'wo')} AS ho_{c}, {family(c, 'wn')} AS hn_{c}" for c in _NAMES)
_FORCE_DIFFER = " OR ".join(f"o_{c} <> n_{c}" for c in _FORCE)
_PART_DIFFERS = " OR ".join(f"{family(c, 'po')} <> {family(c, 'pn')}" for c in _FORCE)


def _content(side: str, voice: bool) -> str:
    kept = f"list_filter(list_transform(list_filter(list_transform({side}, lambda w: {bare('w')}), lambda w: w <> '' AND NOT list_contains({_TOKENS}, w) AND {value('w')} IS NULL), lambda w: rtrim(w, 's')), lambda w: true)"
    if voice:
        forced = " OR ".join(f"regexp_matches({plain('w')}, '{p}')" for p in _FORCE.values())
        kept = f"list_filter({kept}, lambda w: w <> 'committee' AND NOT ({forced}))"
    return kept


def _lone_acronym(a: str, b: str) -> str:
    said = f"list_filter({a}, lambda w: NOT list_contains({_TOKENS}, {bare('w')}))"
    return rf"(len({said}) = 1 AND regexp_matches({said}[1], '^\(?[A-Z][A-Za-z&-]*[A-Z](?:\x{{27}}s|\x{{2019}}s)?\)?[.,;:]?$') AND (len({b}) = 0 OR len(list_filter({b}, lambda w: regexp_matches(w, '^\p{{Lu}}'))) > 0))"


_EDITORIAL = f"""(regexp_replace(lower(array_to_string(so, ' ')), '[^a-z0-9]', '', 'g') = regexp_replace(lower(array_to_string(sn, ' ')), '[^a-z0-9]', '', 'g')
  OR {_content('so', False)} = {_content('sn', False)} OR (NOT forced AND ({_content('so', True)} = {_content('sn', True)}))
  OR (len({_content('so', False)}) = 0 AND len({_content('sn', False)}) = 0) OR (NOT forced AND len({_content('so', True)}) = 0 AND len({_content('sn', True)}) = 0) OR {_lone_acronym('so', 'sn')} OR {_lone_acronym('sn', 'so')})"""

DIFF = (
    MATCH
    + f""",
ms AS (SELECT row_number() OVER (ORDER BY mm.pair, old_id, new_id) AS sid, mm.pair, old_id, new_id, o.paragraphs AS op, n.paragraphs AS np, greatest(1, p.new_fy - p.old_fy) AS gap
  FROM mm JOIN o ON o.pair = mm.pair AND o.section_id = old_id JOIN n ON n.pair = mm.pair AND n.section_id = new_id JOIN p ON p.pair = mm.pair),
pa AS (SELECT sid, i, p, {_key('p')} AS t FROM (SELECT sid, unnest(range(len(op))) AS i, unnest(op) AS p FROM ms)),
pb AS (SELECT sid, j, p, {_key('p')} AS t FROM (SELECT sid, unnest(range(len(np))) AS j, unnest(np) AS p FROM ms)),
{blocks('k', 'pa', 'pb')},
eq AS (SELECT sid, bi AS i1, bj AS j1, bi + x AS i, bj + x AS j FROM (SELECT *, unnest(range(bn)) AS x FROM k)),
cd AS (SELECT g.sid, g.i1, g.j1, pa.i, pb.j, coalesce(pa.p.text, '') AS a, coalesce(pb.p.text, '') AS b FROM k_g g JOIN pa ON pa.sid = g.sid AND pa.i >= g.i1 AND pa.i < g.i2 JOIN pb ON pb.sid = g.sid AND pb.j >= g.j1 AND pb.j < g.j2),
wt AS (SELECT row_number() OVER (ORDER BY a, b) AS sid, a, b, {words('a')} AS wa, {words('b')} AS wb FROM (SELECT DISTINCT a, b FROM (SELECT a, b FROM cd UNION ALL
  SELECT coalesce(pa.p.text, ''), coalesce(pb.p.text, '') FROM eq JOIN pa ON pa.sid = eq.sid AND pa.i = eq.i JOIN pb ON pb.sid = eq.sid AND pb.j = eq.j) WHERE a <> b)),
ta AS (SELECT sid, unnest(range(len(wa))) AS i, unnest(wa) AS t FROM wt), tb AS (SELECT sid, unnest(range(len(wb))) AS j, unnest(wb) AS t FROM wt),
{blocks('w', 'ta', 'tb')},
wr AS (SELECT wt.sid, wt.a, wt.b, CASE WHEN len(wa) + len(wb) = 0 THEN 1.0 ELSE 2.0::DOUBLE * coalesce(x.n, 0) / (len(wa) + len(wb)) END AS ratio, coalesce(y.changed, 0) AS changed
  FROM wt LEFT JOIN (SELECT sid, sum(bn) AS n FROM w GROUP BY sid) x ON x.sid = wt.sid LEFT JOIN (SELECT sid, sum(greatest(i2 - i1, j2 - j1)) AS changed FROM w_g GROUP BY sid) y ON y.sid = wt.sid),
ck AS (SELECT cd.*, row_number() OVER (PARTITION BY cd.sid ORDER BY i1, j1, CASE WHEN cd.a = cd.b THEN 1.0 ELSE ratio END DESC, i, j) AS k FROM cd LEFT JOIN wr ON wr.a = cd.a AND wr.b = cd.b WHERE cd.a = cd.b OR ratio >= 0.5),
cg(sid, k, taken, hit) AS (SELECT DISTINCT sid, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false FROM ck
  UNION ALL SELECT cg.sid, cg.k + 1, CASE WHEN list_contains(taken, 'o' || i) OR list_contains(taken, 'n' || j) THEN taken ELSE list_concat(taken, ['o' || i, 'n' || j]) END, NOT (list_contains(taken, 'o' || i) OR list_contains(taken, 'n' || j))
  FROM cg JOIN ck ON ck.sid = cg.sid AND ck.k = cg.k + 1),
both_ AS (SELECT sid, i1, j1, i, j FROM eq UNION ALL SELECT ck.sid, i1, j1, i, j FROM ck JOIN cg ON cg.sid = ck.sid AND cg.k = ck.k WHERE cg.hit),
rows_ AS (SELECT * FROM both_
  UNION ALL SELECT g.sid, g.i1, g.j1, pa.i, NULL FROM k_g g JOIN pa ON pa.sid = g.sid AND pa.i >= g.i1 AND pa.i < g.i2 ANTI JOIN both_ x ON x.sid = g.sid AND x.i = pa.i
  UNION ALL SELECT g.sid, g.i1, g.j1, NULL, pb.j FROM k_g g JOIN pb ON pb.sid = g.sid AND pb.j >= g.j1 AND pb.j < g.j2 ANTI JOIN both_ x ON x.sid = g.sid AND x.j = pb.j),
placed AS (SELECT r.sid, CAST(row_number() OVER (PARTITION BY r.sid ORDER BY i1, j1, CASE WHEN r.i IS NULL THEN 1 ELSE 0 END, r.i, r.j) - 1 AS INTEGER) AS idx, r.i, r.j, CASE WHEN r.i IS NOT NULL THEN coalesce(pa.p.text, '') END AS old_text,
    CASE WHEN r.j IS NOT NULL THEN coalesce(pb.p.text, '') END AS new_text, CASE WHEN r.j IS NOT NULL THEN pb.p.kind ELSE pa.p.kind END AS kind, CASE WHEN r.j IS NOT NULL THEN pb.p.topic ELSE pa.p.topic END AS topic
  FROM rows_ r LEFT JOIN pa ON pa.sid = r.sid AND pa.i = r.i LEFT JOIN pb ON pb.sid = r.sid AND pb.j = r.j),
-- characters are compared only where words leave it open and the bags of characters allow it
mk AS (SELECT wr.sid, {_mask('a')} AS ma, {_mask('b')} AS mb, changed FROM wr),
op_ AS (SELECT sid, ma, mb FROM mk WHERE ma <> mb AND changed > 5 AND least(length(ma), length(mb)) * 2.0 >= 0.97 * (length(ma) + length(mb))),
bag AS (SELECT sid, sum(least(x, y)) AS n FROM (SELECT sid, c, count(*) FILTER (s = 0) AS x, count(*) FILTER (s = 1) AS y FROM (SELECT sid, 0 AS s, unnest(string_split(ma, '')) AS c FROM op_ UNION ALL SELECT sid, 1, unnest(string_split(mb, '')) FROM op_) GROUP BY ALL) GROUP BY sid),
oq AS (SELECT op_.* FROM op_ JOIN bag ON bag.sid = op_.sid WHERE 2.0 * n >= 0.97 * (length(ma) + length(mb))),
ca AS (SELECT sid, unnest(range(length(ma))) AS i, unnest(string_split(ma, '')) AS t FROM oq), cb AS (SELECT sid, unnest(range(length(mb))) AS j, unnest(string_split(mb, '')) AS t FROM oq),
{blocks('c', 'ca', 'cb')},
lt AS (SELECT mk.sid, CASE WHEN ma = mb THEN 'numbers only' WHEN changed <= 5 OR 2.0::DOUBLE * x.n / (length(ma) + length(mb)) >= 0.97 THEN 'minor' ELSE 'substantive' END AS literal FROM mk LEFT JOIN (SELECT sid, sum(bn) AS n FROM c GROUP BY sid) x ON x.sid = mk.sid),
-- what edits change: only texts that were paired
ed AS (SELECT DISTINCT wt.sid AS wid, ms.gap, wt.a, wt.b, wa, wb, wt.sid * 1000 + ms.gap AS eid FROM placed q JOIN ms ON ms.sid = q.sid JOIN wt ON wt.a = q.old_text AND wt.b = q.new_text WHERE q.i IS NOT NULL AND q.j IS NOT NULL),
ec AS (SELECT *, {_COUNTS} FROM (SELECT *, {letters('lower(a)')} AS lo, {letters('lower(b)')} AS ln FROM ed)),
ef AS (SELECT *, ({_FORCE_DIFFER}) AS forced FROM ec),
hp AS (SELECT *, sum(fresh) OVER (PARTITION BY sid ORDER BY i1, j1) AS hunk FROM (SELECT *, CASE WHEN i1 - lag(i2) OVER (PARTITION BY sid ORDER BY i1, j1) <= 3 THEN 0 ELSE 1 END AS fresh FROM w_g)),
hh AS (SELECT sid, hunk, min(i1) AS i1, max(i2) AS i2, min(j1) AS j1, max(j2) AS j2 FROM hp GROUP BY ALL),
hx AS (SELECT ef.*, hh.hunk, hh.i1, hh.i2, hh.j1, hh.j2, wa[hh.i1 + 1:hh.i2] AS so, wb[hh.j1 + 1:hh.j2] AS sn, {_window('wa', 'hh.i1', 'hh.i2', 4)} AS wo, {_window('wb', 'hh.j1', 'hh.j2', 4)} AS wn FROM ef JOIN hh ON hh.sid = ef.wid),
hc AS (SELECT *, {_H_COUNTS} FROM hx),
fd AS (SELECT DISTINCT eid, hunk, 'discretion' AS category, 2 AS tier FROM (SELECT ef.eid, hp.hunk, {_window('wa', 'hp.i1', 'hp.i2', 4)} AS po, {_window('wb', 'hp.j1', 'hp.j2', 4)} AS pn FROM ef JOIN hp ON hp.sid = ef.wid WHERE forced) WHERE {_PART_DIFFERS}),
ff AS ({' UNION ALL '.join(f"SELECT eid, hunk, '{c}' AS category, 2 AS tier FROM hc WHERE o_{c} <> n_{c} AND ho_{c} <> hn_{c}" for c in _FAMILY)}),
-- numbers of the hunks, with the words around them
nt AS (SELECT eid, gap, hunk, 0 AS side, wa AS ws, unnest(range(i1, i2)) AS k FROM hx UNION ALL SELECT eid, gap, hunk, 1, wb, unnest(range(j1, j2)) FROM hx),
nb AS (SELECT *, ws[k + 1] AS word, {bare('ws[k + 1]')} AS bw, CASE WHEN k + 1 < len(ws) THEN {bare('ws[k + 2]')} END AS nx, CASE WHEN k > 0 THEN {bare('ws[k]')} END AS pv,
    array_to_string(list_transform(ws[greatest(0, k - 5) + 1:k], lambda w: {bare('w')}), ' ') AS pre FROM nt),
nv AS (SELECT * FROM (SELECT *, {value('bw')} AS val FROM nb) WHERE val IS NOT NULL),
nk AS (SELECT *, CASE WHEN NOT contains(word, '$') AND regexp_full_match(bw, '(19|20)[0-9]{{2}}') THEN 'year'
    WHEN regexp_matches({plain('pre')}, '{_CITED}') AND NOT regexp_matches(pre, '(than|to|of)$') THEN 'citation'
    WHEN regexp_matches(pv, '^(january|february|march|april|may|june|july|august|september|october|november|december)$') THEN 'date'
    WHEN regexp_matches(nx, '^(days?|weeks?|months?|years?|calendar|business)$') THEN 'deadline'
    WHEN ends_with(word, '%') OR regexp_matches(nx, '^(percent|per|%)') THEN 'share' WHEN regexp_matches({plain('pre')}, '{_LIMIT}') THEN 'limit' WHEN contains(word, '$') THEN 'dollars'
    WHEN contains(bw, '-') OR (contains(bw, '.') AND NOT regexp_full_match(replace(bw, '.', ''), '[0-9]+')) THEN 'other'
    WHEN regexp_full_match(nx, '[a-z][a-z-]+') AND NOT list_contains({_TOKENS}, nx) THEN 'quantity' ELSE 'other' END AS kind FROM nv),
nh AS (SELECT eid, hunk, list(DISTINCT kind) AS kinds, list(val ORDER BY k) FILTER (side = 0 AND kind IN ('year', 'date')) AS yo, list(val ORDER BY k) FILTER (side = 1 AND kind IN ('year', 'date')) AS yn FROM nk GROUP BY ALL),
hl AS (SELECT hx.eid, hx.hunk, hx.gap, nh.kinds, yo, yn, nh.eid IS NULL AS bare_, {family('limit', _window('wa', 'i1', 'i2', 5))} <> {family('limit', _window('wb', 'j1', 'j2', 5))} AS limit5,
    {family('limit', _window('wa', 'i1', 'i2', 1))} <> {family('limit', _window('wb', 'j1', 'j2', 1))} AS limit1, {family('deadline', _window('wa', 'i1', 'i2', 1))} <> {family('deadline', _window('wb', 'j1', 'j2', 1))} AS due1,
    len(list_filter(wb[j1 + 1:j2 + 5], lambda w: regexp_matches({bare('w')}, '^(days?|weeks?|months?|years?|calendar|business)$'))) > 0 AS timed FROM hx LEFT JOIN nh ON nh.eid = hx.eid AND nh.hunk = hx.hunk),
fnum AS (SELECT eid, hunk, 'limit' AS category, 2 AS tier FROM hl WHERE (bare_ AND limit1) OR (NOT bare_ AND (list_contains(kinds, 'limit') OR limit5))
  UNION ALL SELECT eid, hunk, 'deadline', 2 FROM hl WHERE (bare_ AND NOT limit1 AND due1 AND timed) OR (NOT bare_ AND (list_contains(kinds, 'deadline')
    OR len(list_filter(list_zip(yo, yn, true), lambda y: y[1] > 1900 AND y[1] < 2100 AND y[2] - y[1] <> 0 AND y[2] - y[1] <> gap)) > 0))
  UNION ALL SELECT eid, hunk, 'share', 2 FROM hl WHERE list_contains(kinds, 'share') UNION ALL SELECT eid, hunk, 'quantity', 2 FROM hl WHERE list_contains(kinds, 'quantity')
  UNION ALL SELECT eid, hunk, 'funding', 1 FROM hl WHERE list_contains(kinds, 'dollars') AND NOT (list_contains(kinds, 'limit') OR limit5)),
f1 AS (SELECT DISTINCT eid, hunk, category, tier FROM (SELECT * FROM fd UNION ALL SELECT * FROM ff UNION ALL SELECT * FROM fnum)),
fl AS (SELECT * FROM f1 UNION ALL SELECT eid, hunk, 'wording', 1 FROM hx ANTI JOIN f1 ON f1.eid = hx.eid AND f1.hunk = hx.hunk WHERE NOT {_EDITORIAL}),
fp AS (SELECT eid, count(*) AS n_flags, max(tier) AS tier, list(DISTINCT category) AS cats FROM fl GROUP BY eid),
pd AS (SELECT ms.pair, ms.old_id, ms.new_id, q.idx, q.i, q.j, q.kind, q.topic, q.old_text, q.new_text, ed.eid,
    CASE WHEN q.j IS NULL THEN 'dropped' WHEN q.i IS NULL THEN 'new' WHEN q.old_text = q.new_text THEN 'unchanged' WHEN fp.tier >= 2 THEN 'substantive' ELSE lt.literal END AS change,
    CASE WHEN q.i IS NOT NULL AND q.j IS NOT NULL THEN CASE WHEN q.old_text = q.new_text THEN 'unchanged' ELSE lt.literal END END AS literal,
    CAST(CASE WHEN q.j IS NULL THEN len({words('q.old_text')}) WHEN q.i IS NULL THEN len({words('q.new_text')}) ELSE coalesce(wr.changed, 0) END AS INTEGER) AS changed_words, CAST(coalesce(n_flags, 0) AS INTEGER) AS n_flags, coalesce(cats, []) AS cats, coalesce(tier, 0) AS tier
  FROM placed q JOIN ms ON ms.sid = q.sid LEFT JOIN wt ON wt.a = q.old_text AND wt.b = q.new_text LEFT JOIN wr ON wr.sid = wt.sid LEFT JOIN lt ON lt.sid = wt.sid LEFT JOIN ed ON ed.wid = wt.sid AND ed.gap = ms.gap LEFT JOIN fp ON fp.eid = ed.eid)"""
)

_RANK = "CASE {c} WHEN 'unchanged' THEN 0 WHEN 'numbers only' THEN 1 WHEN 'minor' THEN 2 WHEN 'substantive' THEN 3 WHEN 'new' THEN 4 ELSE 5 END"
_NAMES_BY_RANK = "['unchanged', 'numbers only', 'minor', 'substantive', 'new', 'dropped']"
_WEIGHTS = {"negation": 60, "prohibition": 60, "discretion": 50, "eligibility": 40, "condition": 40, "deadline": 40, "limit": 40, "share": 40, "quantity": 30, "reporting": 30, "provision": 40, "funding": 8, "wording": 6}
_WEIGHT = "CASE c " + " ".join(f"WHEN '{k}' THEN {v}.0::DOUBLE" for k, v in _WEIGHTS.items()) + " END"
_ANCHOR = "'s-' || left(array_to_string(list_transform(path, lambda z: replace(lower(z), ' ', '_')), '-'), 60) || '-' || left(md5(array_to_string(path, ' > ')), 6)"

CLASSES = (
    DIFF
    + f""",
sl AS (SELECT mm.pair, mm.old_id, mm.new_id, coalesce({_NAMES_BY_RANK}[max(CASE WHEN pd.change IS NOT NULL THEN least(3, {_RANK.format(c='pd.change')}) END) + 1], 'unchanged') AS change, CAST(coalesce(sum(pd.changed_words), 0) AS BIGINT) AS changed_words
  FROM mm LEFT JOIN pd ON pd.pair = mm.pair AND pd.old_id = mm.old_id AND pd.new_id = mm.new_id GROUP BY ALL)"""
)


def _loose(side: str, id_: str, idx: str, text: str, label: str) -> str:
    return f"""SELECT x.pair, section, section || ':' || idx AS key, s.seq * 4294967296 + idx AS ord, txt, topic FROM (
    SELECT pair, section_id AS section, idx, p.text AS txt, p.topic AS topic FROM (SELECT pair, section_id, unnest(paragraphs) AS p, unnest(range(len(paragraphs))) AS idx FROM {side})
    UNION ALL SELECT pair, {id_}, {idx}, {text}, topic FROM pd WHERE change = '{label}') x JOIN {'o' if side == 'gone' else 'n'} s ON s.pair = x.pair AND s.section_id = x.section WHERE txt <> ''"""


COMPARE = (
    CLASSES
    + f""",
lo_ AS ({_loose('gone', 'old_id', 'i', 'old_text', 'dropped')}), ln_ AS ({_loose('come', 'new_id', 'j', 'new_text', 'new')}),
v1 AS (SELECT x.pair, x.key AS old_key, y.key AS new_key FROM (SELECT *, row_number() OVER (PARTITION BY pair, txt ORDER BY ord, key) AS occ FROM lo_) x JOIN (SELECT *, row_number() OVER (PARTITION BY pair, txt ORDER BY ord, key) AS occ FROM ln_) y ON x.pair = y.pair AND x.txt = y.txt AND x.occ = y.occ),
lo1 AS (SELECT lo_.* FROM lo_ ANTI JOIN v1 ON v1.pair = lo_.pair AND v1.old_key = lo_.key), ln1 AS (SELECT ln_.* FROM ln_ ANTI JOIN v1 ON v1.pair = ln_.pair AND v1.new_key = ln_.key),
tc AS (SELECT row_number() OVER () AS sid, x.pair, x.key AS old_key, y.key AS new_key, x.ord AS oo, y.ord AS no_, x.txt AS a, y.txt AS b FROM lo1 x JOIN ln1 y ON x.pair = y.pair AND lower(x.topic) = lower(y.topic) WHERE x.topic <> '' AND 2 * least(length(x.txt), length(y.txt)) > 0.5 * (length(x.txt) + length(y.txt))),
xa AS (SELECT sid, unnest(range(length(a))) AS i, unnest(string_split(a, '')) AS t FROM tc), xb AS (SELECT sid, unnest(range(length(b))) AS j, unnest(string_split(b, '')) AS t FROM tc),
{blocks('x', 'xa', 'xb')},
ts AS (SELECT tc.*, 2.0::DOUBLE * q.n / (length(a) + length(b)) AS score FROM tc JOIN (SELECT sid, sum(bn) AS n FROM x GROUP BY sid) q ON q.sid = tc.sid WHERE 2.0 * q.n / (length(a) + length(b)) > 0.5),
tr AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY no_, new_key, score DESC, oo, old_key) AS k FROM ts),
tg(pair, k, taken, hit) AS (SELECT DISTINCT pair, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), false FROM tr
  UNION ALL SELECT tg.pair, tg.k + 1, CASE WHEN list_contains(taken, 'o' || old_key) OR list_contains(taken, 'n' || new_key) THEN taken ELSE list_concat(taken, ['o' || old_key, 'n' || new_key]) END, NOT (list_contains(taken, 'o' || old_key) OR list_contains(taken, 'n' || new_key))
  FROM tg JOIN tr ON tr.pair = tg.pair AND tr.k = tg.k + 1),
v2 AS (SELECT tr.pair, old_key, new_key, score FROM tr JOIN tg ON tg.pair = tr.pair AND tg.k = tr.k WHERE tg.hit),
lo2 AS (SELECT lo1.* FROM lo1 ANTI JOIN v2 ON v2.pair = lo1.pair AND v2.old_key = lo1.key), ln2 AS (SELECT ln1.* FROM ln1 ANTI JOIN v2 ON v2.pair = ln1.pair AND v2.new_key = ln1.key),
nc AS (SELECT x.pair, x.key AS old_key, y.key AS new_key, x.section AS os, y.section AS ns, x.ord AS oo, y.ord AS no_, x.txt AS a, y.txt AS b FROM lo2 x JOIN ln2 y ON x.pair = y.pair
  WHERE len({words('x.txt')}) >= 12 AND len({words('y.txt')}) >= 12 AND least(length(x.txt), length(y.txt)) >= 0.8 * greatest(length(x.txt), length(y.txt))),
{lcs('nc', 'z')},
nz AS (SELECT nc.*, {ratio('nc.a', 'nc.b', 'z.n')} AS score FROM nc JOIN z ON z.a = nc.a AND z.b = nc.b),
v3 AS (SELECT pair, old_key, new_key, score FROM (SELECT *, row_number() OVER (PARTITION BY pair, old_key ORDER BY score DESC, no_, new_key) AS ro, row_number() OVER (PARTITION BY pair, new_key ORDER BY score DESC, oo, old_key) AS rn_ FROM nz WHERE score >= 85) WHERE ro = 1 AND rn_ = 1 AND os IS DISTINCT FROM ns),
mv AS (SELECT pair, old_key, new_key, 'verbatim' AS how, CAST(NULL AS DOUBLE) AS score FROM v1 UNION ALL SELECT pair, old_key, new_key, 'topic', score FROM v2 UNION ALL SELECT pair, old_key, new_key, 'near', score FROM v3),
mw AS (SELECT mv.pair, x.section AS os, y.section AS ns, len({words('x.txt')}) AS w FROM mv JOIN lo_ x ON x.pair = mv.pair AND x.key = mv.old_key JOIN ln_ y ON y.pair = mv.pair AND y.key = mv.new_key WHERE x.txt = y.txt),
ls AS (SELECT pair, section_id, CAST(coalesce(list_sum(list_transform(paragraphs, lambda z: len({words("coalesce(z.text, '')")}))), 0) AS BIGINT) AS w, len(list_filter(paragraphs, lambda z: z.kind = 'directive')) > 0 AS lifted, 'dropped' AS change FROM gone
  UNION ALL SELECT pair, section_id, CAST(coalesce(list_sum(list_transform(paragraphs, lambda z: len({words("coalesce(z.text, '')")}))), 0) AS BIGINT), len(list_filter(paragraphs, lambda z: z.kind = 'directive')) > 0, 'new' FROM come),
sr AS (SELECT pair, old_id, new_id, change, changed_words FROM sl UNION ALL SELECT pair, CASE WHEN change = 'dropped' THEN section_id END, CASE WHEN change = 'new' THEN section_id END, change, w FROM ls),
sw AS (SELECT sr.pair, sr.old_id, sr.new_id, sr.change, greatest(0, changed_words - CAST(coalesce(a.w, 0) AS BIGINT) - CAST(coalesce(b.w, 0) AS BIGINT)) AS changed_words FROM sr
  LEFT JOIN (SELECT pair, os, sum(w) AS w FROM mw GROUP BY ALL) a ON a.pair = sr.pair AND a.os = sr.old_id LEFT JOIN (SELECT pair, ns, sum(w) AS w FROM mw GROUP BY ALL) b ON b.pair = sr.pair AND b.ns = sr.new_id),
fw AS (SELECT pair, old_id, new_id, sum({_WEIGHT}) AS flagged FROM (SELECT pair, old_id, new_id, unnest(cats) AS c FROM pd) GROUP BY ALL),
bo_ AS (SELECT pair, old_id, new_id, max(CASE WHEN kind = 'directive' THEN CASE WHEN change IN ('new', 'dropped') THEN 3.0 WHEN change <> 'unchanged' THEN 1.5 ELSE 1.0 END ELSE 1.0 END) AS boost FROM pd GROUP BY ALL),
sx AS (SELECT sw.*, (sw.changed_words * CASE sw.change WHEN 'unchanged' THEN 0.0 WHEN 'numbers only' THEN 0.2 WHEN 'minor' THEN 0.5 WHEN 'substantive' THEN 1.0 ELSE 2.0 END::DOUBLE + coalesce(fw.flagged, 0.0)) * coalesce(bo_.boost, CASE WHEN ls.lifted THEN 3.0 END, 1.0)::DOUBLE AS score
  FROM sw LEFT JOIN fw ON fw.pair = sw.pair AND fw.old_id = sw.old_id AND fw.new_id = sw.new_id LEFT JOIN bo_ ON bo_.pair = sw.pair AND bo_.old_id = sw.old_id AND bo_.new_id = sw.new_id
  LEFT JOIN ls ON ls.pair = sw.pair AND ls.change = sw.change AND ls.section_id = coalesce(sw.new_id, sw.old_id) AND (sw.old_id IS NULL OR sw.new_id IS NULL)),
sy AS (SELECT sx.*, coalesce(n.path, o.path) AS path, coalesce(n.seq, o.seq) AS seq, CASE WHEN rn.pair IS NOT NULL AND o.path[-1] <> n.path[-1] THEN o.heading END AS renamed_from FROM sx LEFT JOIN o ON o.pair = sx.pair AND o.section_id = sx.old_id LEFT JOIN n ON n.pair = sx.pair AND n.section_id = sx.new_id
  LEFT JOIN rn ON rn.pair = sx.pair AND rn.old_id = sx.old_id AND rn.new_id = sx.new_id),
sz AS (SELECT *, CAST(row_number() OVER (PARTITION BY pair ORDER BY score DESC, path, seq, new_id NULLS FIRST, old_id NULLS FIRST) AS INTEGER) AS place, {_ANCHOR} AS base FROM sy),
sections_ AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY pair, base ORDER BY place) = 1 THEN base ELSE base || '-' || row_number() OVER (PARTITION BY pair, base ORDER BY place) END AS anchor FROM sz)"""
)

_ESCAPED = "replace(replace(replace(array_to_string({x}, ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_REDLINES = f"""rl AS (SELECT sid, string_agg(txt, ' ' ORDER BY i1, j1) AS line FROM (
    SELECT g.sid, i1, j1, concat_ws(' ', CASE WHEN i2 > i1 THEN '<del>' || {_ESCAPED.format(x='wa[i1 + 1:i2]')} || '</del>' END, CASE WHEN j2 > j1 THEN '<ins>' || {_ESCAPED.format(x='wb[j1 + 1:j2]')} || '</ins>' END) AS txt FROM w_g g JOIN wt ON wt.sid = g.sid
    UNION ALL SELECT q.sid, i1, j1, {_ESCAPED.format(x='wb[j1 + 1:j1 + n]')} FROM (SELECT sid, min(bi) AS i1, min(bj) AS j1, sum(bn) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY sid ORDER BY bi, bj) AS run FROM (SELECT *, CASE WHEN bi = lag(bi + bn) OVER v AND bj = lag(bj + bn) OVER v THEN 0 ELSE 1 END AS fresh FROM w WINDOW v AS (PARTITION BY sid ORDER BY bi, bj))) GROUP BY sid, run) q JOIN wt ON wt.sid = q.sid
  ) GROUP BY sid)"""
_PLACES = """pl AS (SELECT *, coalesce(new_seq, CASE WHEN old_seq IS NOT NULL THEN carried END, -1) AS place_new, CASE WHEN new_seq IS NOT NULL THEN -1 ELSE old_seq END AS place_old FROM (
    SELECT *, last_value(new_seq IGNORE NULLS) OVER (PARTITION BY pair ORDER BY old_seq NULLS LAST ROWS UNBOUNDED PRECEDING) AS carried FROM (
      SELECT o.pair, o.section_id AS old_id, o.seq AS old_seq, mm.new_id, n.seq AS new_seq FROM o LEFT JOIN mm ON mm.pair = o.pair AND mm.old_id = o.section_id LEFT JOIN n ON n.pair = mm.pair AND n.section_id = mm.new_id
      UNION ALL SELECT pair, NULL, NULL, section_id, seq FROM come)))"""
_KINDS = f"""ki AS (SELECT pair, CASE WHEN a = b THEN 'unchanged' WHEN {_mask('a')} = {_mask('b')} THEN 'numbers only' ELSE 'language' END AS kind FROM (
    SELECT mm.pair, array_to_string(list_transform(o.paragraphs, lambda z: coalesce(z.text, '')), chr(10)) AS a, array_to_string(list_transform(n.paragraphs, lambda z: coalesce(z.text, '')), chr(10)) AS b FROM mm JOIN o ON o.pair = mm.pair AND o.section_id = old_id JOIN n ON n.pair = mm.pair AND n.section_id = new_id))"""
_THREADS = """t AS (SELECT old_id AS node, old_id AS head FROM mm WHERE old_id NOT IN (SELECT new_id FROM mm) UNION ALL SELECT l.new_id, t.head FROM t JOIN mm l ON l.old_id = t.node)"""
_CELLS = f"""{_THREADS}, cells AS (SELECT coalesce(t.head, s.section_id) AS thread, e.chamber, e.slug, e.fy, s.section_id, s.heading, s.path, coalesce(sl.change, 'new') AS change
    FROM s JOIN e ON s.package_id = e.package_id LEFT JOIN t ON t.node = s.section_id LEFT JOIN sl ON sl.new_id = s.section_id WHERE len(s.path) > 0)"""
_LONE = "coalesce(new_id, old_id) AS section_id"

ORACLES = {
    "align_cascade": f"{MATCH} SELECT pair, old_id, new_id, match_pass, round(score, 6) AS score FROM mm",
    "align_candidates": MATCH + TRACE,
    "rename_promotion": f"{MATCH} SELECT pair, old_id, new_id, round(alike, 6) AS score FROM rn",
    "related_hints": f"""{MATCH}, b2 AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.pair, sc.old_id ORDER BY alike DESC, new_rank) = 1 AS ob, row_number() OVER (PARTITION BY sc.pair, sc.new_id ORDER BY alike DESC, old_rank) = 1 AS nb
        FROM sc ANTI JOIN mm x ON x.pair = sc.pair AND x.old_id = sc.old_id ANTI JOIN mm y ON y.pair = sc.pair AND y.new_id = sc.new_id WHERE same_title AND alike >= 50),
      one AS (SELECT pair, old_id AS section_id, new_id AS other_id, alike, nb AS mutual FROM b2 WHERE ob UNION ALL SELECT pair, new_id, old_id, alike, ob FROM b2 WHERE nb)
      SELECT pair, section_id, other_id, round(alike, 6) AS overlap FROM one WHERE alike >= CASE WHEN mutual THEN 50 ELSE 60 END""",
    "removed_sections": f"{MATCH} SELECT pair, section_id FROM gone",
    "added_sections": f"{MATCH} SELECT pair, section_id FROM come",
    "paragraph_diffs": f"{DIFF} SELECT pair, old_id, new_id, idx, CAST(i AS INTEGER) AS old_idx, CAST(j AS INTEGER) AS new_idx, change, literal, changed_words, n_flags FROM pd",
    "word_diff": f"{DIFF}, {_REDLINES} SELECT pair, old_id, new_id, idx, rl.line AS redline, changed_words AS words FROM pd JOIN wt ON wt.a = pd.old_text AND wt.b = pd.new_text JOIN rl ON rl.sid = wt.sid WHERE pd.i IS NOT NULL AND pd.j IS NOT NULL",
    "policy_flags": f"""{DIFF} SELECT pair, old_id, new_id, idx, CAST(hh.i1 AS INTEGER) AS first_word, category, CASE category WHEN 'discretion' THEN 'discretion / force' WHEN 'eligibility' THEN 'eligibility / scope' WHEN 'reporting' THEN 'reporting requirement'
        WHEN 'provision' THEN 'provision effect' WHEN 'limit' THEN 'floor / ceiling' WHEN 'share' THEN 'percentage / share' WHEN 'quantity' THEN 'program quantity' WHEN 'funding' THEN 'dollar amount' WHEN 'wording' THEN 'wording change' ELSE category END AS label, CAST(fl.tier AS INTEGER) AS tier
      FROM pd JOIN fl ON fl.eid = pd.eid JOIN hh ON hh.sid = pd.eid // 1000 AND hh.hunk = fl.hunk""",
    "flags_for_review": f"""{DIFF}, r AS (SELECT eid, count(*) FILTER (tier >= 2) AS n FROM fl GROUP BY eid) SELECT pair, CAST(sum(coalesce(r.n, 0)) AS BIGINT) AS n, CAST(max(pd.tier) AS INTEGER) AS highest FROM pd LEFT JOIN r ON r.eid = pd.eid GROUP BY pair""",
    "policy_summary": f"{DIFF} SELECT pair, category, CASE WHEN literal IN ('minor', 'numbers only') THEN 'small' ELSE 'large' END AS size, count(*) AS n FROM pd JOIN fl ON fl.eid = pd.eid GROUP BY ALL",
    "section_class": f"{CLASSES} SELECT pair, old_id, new_id, change, changed_words FROM sl",
    "change_counts": f"{CLASSES} SELECT pair, change, count(*) AS n FROM (SELECT pair, change FROM sl UNION ALL SELECT pair, 'dropped' FROM gone UNION ALL SELECT pair, 'new' FROM come) GROUP BY ALL",
    "collapsed_paragraphs": f"""{DIFF}, c1 AS (SELECT *, CASE WHEN change = 'unchanged' AND lag(change) OVER v = 'unchanged' THEN 0 ELSE 1 END AS starts FROM pd WINDOW v AS (PARTITION BY pair, old_id, new_id ORDER BY idx)),
      c2 AS (SELECT *, sum(starts) OVER (PARTITION BY pair, old_id, new_id ORDER BY idx) AS run FROM c1) SELECT pair, old_id, new_id, min(change) AS change, min(idx) AS first, max(idx) AS last, count(*) AS n FROM c2 GROUP BY pair, old_id, new_id, run""",
    "significance": f"{COMPARE} SELECT pair, old_id, new_id, change, changed_words, round(score, 4) AS score FROM sections_",
    "rank_top_k": f"{COMPARE} SELECT pair, old_id, new_id, change, changed_words, round(score, 4) AS score, place FROM sections_ WHERE place <= 10",
    "compare_sections": f"{COMPARE} SELECT pair, place, old_id, new_id, change, changed_words, round(score, 4) AS score, renamed_from, anchor FROM sections_",
    "compare_moves": f"{COMPARE} SELECT pair, old_key, new_key, how FROM mv",
    "moves_verbatim": f"{COMPARE} SELECT pair, old_key, new_key FROM v1",
    "moves_same_topic": f"{COMPARE} SELECT pair, old_key, new_key, round(score, 6) AS score FROM v2",
    "moves_near": f"{COMPARE} SELECT pair, old_key, new_key, round(score, 6) AS score FROM v3",
    "new_section_scores": f"{COMPARE} SELECT pair, {_LONE}, change, CAST(changed_words AS INTEGER) AS words, score FROM sections_ WHERE change IN ('new', 'dropped') AND (old_id IS NULL OR new_id IS NULL)",
    "shown_sections": f"""{COMPARE}, mk_ AS (SELECT pair, old_id, new_id, max(tier) AS tier, bool_or(kind = 'directive') AS edited FROM pd GROUP BY ALL),
      dr_ AS (SELECT q.pair, q.old_id, q.new_id, q.change, CAST(coalesce(mk_.tier, 0) AS INTEGER) AS tier, coalesce(mk_.edited, false) OR coalesce(len(list_filter(coalesce(n.paragraphs, o.paragraphs), lambda z: z.kind = 'directive')) > 0, false) AS directive
        FROM sections_ q LEFT JOIN mk_ ON mk_.pair = q.pair AND mk_.old_id = q.old_id AND mk_.new_id = q.new_id LEFT JOIN o ON o.pair = q.pair AND o.section_id = q.old_id LEFT JOIN n ON n.pair = q.pair AND n.section_id = q.new_id)
      SELECT pair, old_id, new_id, change, tier FROM dr_ WHERE directive AND change NOT IN ('unchanged', 'numbers only')""",
    "document_order": f"{MATCH}, {_PLACES} SELECT pair, old_id, new_id, CAST(place_new AS INTEGER) AS place_new, CAST(place_old AS INTEGER) AS place_old FROM pl",
    "index_page": f"""{MATCH}, {_KINDS}, z AS (SELECT pair, CAST(kind <> 'unchanged' AS INTEGER) AS changed, 0 AS new, 0 AS dropped FROM ki WHERE kind <> 'unchanged' UNION ALL SELECT pair, 0, 0, 1 FROM gone UNION ALL SELECT pair, 0, 1, 0 FROM come)
      SELECT pair, CAST(sum(changed) AS BIGINT) AS changed, CAST(sum(new) AS BIGINT) AS new, CAST(sum(dropped) AS BIGINT) AS dropped FROM z GROUP BY pair""",
    "thread_ids": f"{MATCH}, {_THREADS} SELECT node AS section_id, head AS thread FROM t",
    "provenance": f"""{CLASSES}, {_CELLS}, g2 AS (SELECT thread, min(fy) AS added_fy, max(fy) AS last_fy, max(CASE WHEN change NOT IN ('unchanged', 'new') THEN fy END) AS edited_fy, arg_max(change, fy) FILTER (change NOT IN ('unchanged', 'new')) AS edit FROM cells GROUP BY thread)
      SELECT thread, added_fy, edited_fy, edit, CASE WHEN edited_fy IS NULL THEN 'unchanged since FY' || added_fy ELSE 'added FY' || added_fy || '; ' || CASE edit WHEN 'numbers only' THEN 'figures updated' WHEN 'minor' THEN 'tweaked' ELSE 'revised' END || ' FY' || edited_fy END AS label, coalesce(edited_fy = last_fy, false) AS hot FROM g2""",
    "name_runs": f"""{CLASSES}, {_CELLS}, c1 AS (SELECT thread, fy, heading, CASE WHEN lag(fy) OVER v IS NOT NULL AND heading IS DISTINCT FROM lag(heading) OVER v THEN 1 ELSE 0 END AS starts FROM cells WINDOW v AS (PARTITION BY thread ORDER BY fy)),
      c2 AS (SELECT *, sum(starts) OVER (PARTITION BY thread ORDER BY fy) AS run FROM c1) SELECT thread, min(heading) AS heading, min(fy) AS first_fy, max(fy) AS last_fy, count(*) AS n FROM c2 GROUP BY thread, run""",
    "active_headings": f"{CLASSES}, {_CELLS} SELECT chamber, slug, heading, count(*) AS n FROM cells GROUP BY ALL HAVING bool_or(change NOT IN ('unchanged', 'numbers only'))",
    "chain_timeline": f"{CLASSES}, {_CELLS} SELECT chamber, slug, heading, fy, count(*) AS n FROM cells WHERE change NOT IN ('unchanged', 'numbers only') GROUP BY ALL",
    "stitch_returned": f"""{CLASSES}, {_CELLS}, yy AS (SELECT chamber, slug, fy, lead(fy) OVER (PARTITION BY chamber, slug ORDER BY fy) AS next_fy, min(fy) OVER (PARTITION BY chamber, slug) AS first_fy FROM e),
      g2 AS (SELECT thread, min(fy) AS a, max(fy) AS b, min(chamber) AS chamber, min(slug) AS slug, arg_min(path, fy) AS p0, arg_max(path, fy) AS p1 FROM cells GROUP BY thread),
      d AS (SELECT g2.chamber, g2.slug, p1[1] || ' > ' || p1[-1] AS key, thread AS dead_id, next_fy AS death FROM g2 JOIN yy ON yy.chamber = g2.chamber AND yy.slug = g2.slug AND yy.fy = g2.b WHERE next_fy IS NOT NULL),
      b2 AS (SELECT g2.chamber, g2.slug, p0[1] || ' > ' || p0[-1] AS key, thread AS born_id, a AS birth FROM g2 JOIN yy ON yy.chamber = g2.chamber AND yy.slug = g2.slug AND yy.fy = g2.a WHERE a > first_fy),
      dr AS (SELECT *, row_number() OVER (PARTITION BY chamber, slug, key ORDER BY death, dead_id) AS nth FROM d WHERE NOT contains(key, '> SEC ')), nr AS (SELECT *, row_number() OVER (PARTITION BY chamber, slug, key ORDER BY birth, born_id) AS nth FROM b2 WHERE NOT contains(key, '> SEC '))
      SELECT dr.chamber, dr.slug, dead_id, born_id, CASE WHEN birth = death THEN 'reorganized' ELSE 'returned' END AS kind FROM dr JOIN nr ON dr.chamber = nr.chamber AND dr.slug = nr.slug AND dr.key = nr.key AND dr.nth = nr.nth WHERE birth >= death""",
}
