"""The same results in SQL, worked out from single sites."""

from __future__ import annotations

from .fixtures import QUERY_OFFSET, duck_sites
from .queries import BEST, RADIUS, TRIM

INVALID = "('N', 'X', 'O', '-', '?', '.')"
ACGT = "('A', 'C', 'G', 'T')"
MASK = "CASE c WHEN 'A' THEN 1 WHEN 'C' THEN 2 WHEN 'G' THEN 4 WHEN 'T' THEN 8 WHEN 'R' THEN 5 WHEN 'Y' THEN 10 WHEN 'S' THEN 6 WHEN 'W' THEN 9 WHEN 'K' THEN 12 WHEN 'M' THEN 3 ELSE 0 END"
FULL = "ACGT_matches, text_matches, partial_matches, valid_pair_comparisons, ACGT_matches_unique, valid_ref_sites"
ONLY_ACGT = "ACGT_matches, valid_ACGT_comparisons, ACGT_matches_unique, valid_ref_sites, dist_consensus, dist_unique"

#: All sites of references and queries, with mask, validity and ACGT as numbers.
SITES = f"""
rs AS (SELECT id, site, c, {MASK} AS m, CASE WHEN c IN {INVALID} THEN 0 ELSE 1 END AS v, CASE WHEN c IN {ACGT} THEN 1 ELSE 0 END AS a FROM ({duck_sites("customer", "c_custkey", 0)}) x),
qs AS (SELECT id, site, c, {MASK} AS m, CASE WHEN c IN {INVALID} THEN 0 ELSE 1 END AS v, CASE WHEN c IN {ACGT} THEN 1 ELSE 0 END AS a FROM ({duck_sites("supplier", "s_suppkey", QUERY_OFFSET)}) x)"""
CLEAR = "HAVING (count(*) - sum(v)) / count(*)::DOUBLE <= 0.5 AND sum(a) / count(*)::DOUBLE >= 1 - 1.1 * 0.5"
QUERIES = f"qp AS (SELECT * FROM qs WHERE id IN (SELECT id FROM qs GROUP BY id {CLEAR}))"
REFS = "rp AS (SELECT * FROM rs WHERE id IN (SELECT id FROM rs GROUP BY id HAVING sum(v) >= floor(count(*) * 0.5)))"
REF_TEXT = "rt AS (SELECT id, string_agg(c, '' ORDER BY site) AS seq FROM rs GROUP BY id)"


def profile(known: str = "v", trim: int = 0, table: str = "qp", name: str = "prof") -> str:
    """Site profile of ``table``; ``known``: v or a."""
    used = f"(site >= {trim} AND site < 120 - {trim})"
    return f"""{name} AS (SELECT site, n_distinct, n_missing, class, CASE class WHEN 'u' THEN 'N' WHEN 'p' THEN '#' ELSE c END AS consensus FROM (
SELECT *, CASE WHEN NOT {used} OR n_distinct = 0 THEN 'u' WHEN n_distinct > 1 THEN 'p' WHEN n_missing > 0 THEN 'm' ELSE 'c' END AS class FROM (
SELECT site, count(DISTINCT CASE WHEN {known} = 1 THEN c END) AS n_distinct, CAST(sum(1 - {known}) AS BIGINT) AS n_missing, max(CASE WHEN {known} = 1 THEN c END) AS c FROM {table} GROUP BY site) y) z)"""


def nearest_full(refs: str = "rp", queries: str = "qp") -> str:
    """``nn`` from references, queries and ``prof``."""
    return f"""scored AS (SELECT q.id AS qid, r.id AS rid,
CAST(sum(CASE WHEN q.a = 1 AND q.c = r.c THEN 1 ELSE 0 END) AS BIGINT) AS ACGT_matches,
CAST(sum(CASE WHEN q.v = 1 AND q.c = r.c THEN 1 ELSE 0 END) AS BIGINT) AS text_matches,
CAST(sum(CASE WHEN q.v = 1 AND r.v = 1 AND (q.c = r.c OR (q.m & r.m) <> 0) THEN 1 ELSE 0 END) AS BIGINT) AS partial_matches,
CAST(sum(q.v * r.v) AS BIGINT) AS valid_pair_comparisons,
CAST(sum(CASE WHEN q.a = 1 AND q.c = r.c AND p.class <> 'c' THEN 1 ELSE 0 END) AS BIGINT) AS ACGT_matches_unique
FROM {queries} q JOIN {refs} r ON q.site = r.site JOIN prof p ON p.site = q.site WHERE p.class <> 'u' GROUP BY q.id, r.id),
known AS (SELECT id, CAST(sum(v) AS BIGINT) AS valid_ref_sites FROM {refs} GROUP BY id),
nn AS (SELECT * FROM (SELECT qid, rid, {FULL}, row_number() OVER (PARTITION BY qid ORDER BY ACGT_matches DESC, text_matches DESC, partial_matches DESC, valid_pair_comparisons DESC, ACGT_matches_unique DESC, valid_ref_sites DESC, rid) AS rank
FROM scored JOIN known ON known.id = scored.rid) x WHERE rank <= {BEST})"""


NEAREST_ACGT = f"""scored AS (SELECT q.id AS qid, r.id AS rid,
CAST(sum(CASE WHEN q.a = 1 AND q.c = r.c THEN 1 ELSE 0 END) AS BIGINT) AS ACGT_matches,
CAST(sum(q.a * r.a) AS BIGINT) AS valid_ACGT_comparisons,
CAST(sum(CASE WHEN q.a = 1 AND q.c = r.c AND p.class <> 'c' THEN 1 ELSE 0 END) AS BIGINT) AS ACGT_matches_unique,
CAST(sum(CASE WHEN q.a * r.a = 1 AND q.c <> r.c AND p.class <> 'p' THEN 1 ELSE 0 END) AS BIGINT) AS dist_consensus,
CAST(sum(CASE WHEN q.a * r.a = 1 AND q.c <> r.c AND p.class = 'p' THEN 1 ELSE 0 END) AS BIGINT) AS dist_unique
FROM qp q JOIN rp r ON q.site = r.site JOIN prof p ON p.site = q.site WHERE p.class <> 'u' GROUP BY q.id, r.id),
known AS (SELECT id, CAST(sum(v) AS BIGINT) AS valid_ref_sites FROM rp GROUP BY id),
nn AS (SELECT * FROM (SELECT qid, rid, {ONLY_ACGT}, row_number() OVER (PARTITION BY qid ORDER BY ACGT_matches DESC, valid_ACGT_comparisons DESC, ACGT_matches_unique DESC, valid_ref_sites DESC, dist_consensus DESC, dist_unique DESC, rid) AS rank
FROM scored JOIN known ON known.id = scored.rid) x WHERE rank <= {BEST})"""


def named(columns: str) -> str:
    return f"SELECT 'query' || qid AS query, 'ref' || rid AS reference, rank, {columns} FROM nn"


def redundancy(more: bool, known: str = "v", name: str = "kq") -> str:
    """``name``: the clear queries that stay."""
    lost = "v = known_a AND known_b > known_a" if more else "v = known_b AND known_b < known_a"
    return f"""sign AS (SELECT id, string_agg(CASE WHEN {known} = 1 THEN c ELSE 'N' END, '' ORDER BY site) AS s, sum({known}) AS known FROM qp GROUP BY id),
firsts AS (SELECT min(id) AS id, max(known) AS known FROM sign GROUP BY s),
fp AS (SELECT id, site, c FROM qp WHERE {known} = 1 AND id IN (SELECT id FROM firsts)),
both_known AS (SELECT x.id AS a, y.id AS b, count(*) AS v, sum(CASE WHEN x.c = y.c THEN 1 ELSE 0 END) AS t FROM fp x JOIN fp y ON x.site = y.site GROUP BY x.id, y.id),
lost AS (SELECT a FROM (SELECT p.*, fa.known AS known_a, fb.known AS known_b FROM both_known p JOIN firsts fa ON fa.id = p.a JOIN firsts fb ON fb.id = p.b) x WHERE t = v AND {lost}),
{name} AS (SELECT * FROM qp WHERE id IN (SELECT id FROM firsts) AND id NOT IN (SELECT a FROM lost))"""


def ball(known: str, pair: bool, keep: str) -> str:
    """References within the radius; ``pair``: compared with the query on all sites."""
    if pair:
        outer, inner, join = "0", f"CASE WHEN q.{known} * r.{known} = 1 AND q.c <> r.c THEN 1 ELSE 0 END", ""
    else:
        outer, join = "CASE WHEN p.class IN ('c', 'm') AND r.v = 1 AND p.consensus <> r.c THEN 1 ELSE 0 END", "JOIN prof p ON p.site = q.site"
        inner = "CASE WHEN p.class = 'p' AND q.v * r.v = 1 AND q.c <> r.c THEN 1 ELSE 0 END"
    return f"""d AS (SELECT q.id AS qid, r.id AS rid, sum({outer}) AS o, sum({inner}) AS i FROM kq q JOIN rp r ON q.site = r.site {join} GROUP BY q.id, r.id),
near AS (SELECT rid, max(o) AS o, min(o + i) AS distance FROM d GROUP BY rid)
SELECT rid AS ordinal, 'ref' || rid AS name, CAST(distance AS BIGINT) AS distance FROM near WHERE {keep}"""


def legacy() -> str:
    clear = f"lr AS (SELECT * FROM rs WHERE id IN (SELECT id FROM rs GROUP BY id {CLEAR}))"
    return f"""{clear}, sc AS (SELECT q.id AS qid, r.id AS rid, CAST(sum(q.v * r.v) AS BIGINT) AS valid_sites,
CAST(sum(CASE WHEN q.a = 1 AND q.c = r.c THEN 1 ELSE 0 END) AS BIGINT) AS ACGT_matches,
round(sum(CASE WHEN q.v = 1 AND q.c = r.c THEN 1 ELSE 0 END) / CAST(sum(q.v * r.v) AS DOUBLE), 8) AS prop_char_matches,
round(sum(CASE WHEN q.m > 0 AND r.m > 0 THEN bit_count(q.m & r.m) / CAST(bit_count(q.m) * bit_count(r.m) AS DOUBLE) ELSE 0 END), 3) AS partial_matches
FROM qp q JOIN lr r ON q.site = r.site GROUP BY q.id, r.id)"""


LEGACY_NAMED = "'query' || qid AS query, 'ref' || rid AS reference, valid_sites, ACGT_matches, prop_char_matches, partial_matches"


def legacy_chosen(n: int = 8) -> str:
    """``chosen`` from ``sc``: three lists of each query."""
    most = 2 * n
    ranks, listed = [], []
    for key, size in (("ACGT_matches", "total"), ("prop_char_matches", "total // 8"), ("partial_matches", "total // 16")):
        inside = f"(acgt_rank <= {size})"
        ranks.append(f"row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN {inside} THEN 0 ELSE 1 END, {key} DESC, acgt_rank) AS rank_{key}, max(CASE WHEN {inside} THEN {key} END) OVER (PARTITION BY qid) AS best_{key}")
        enough = {"total": "TRUE", "total // 8": "total > 16", "total // 16": "total > 32"}[size]
        listed.append(f"({enough} AND {inside} AND (rank_{key} <= {n} OR rank_{key} <= {most} AND best_{key} - {key} < 1e-15))")
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ACGT_matches DESC, rid) AS acgt_rank, (SELECT count(DISTINCT rid) FROM sc) AS total FROM sc),
ranks AS (SELECT *, {", ".join(ranks)} FROM o), chosen AS (SELECT * FROM ranks WHERE {" OR ".join(listed)})"""


PAIRS = f"""WITH {SITES}, nq AS (SELECT count(DISTINCT id) AS n FROM qs), pairs AS (SELECT q.id AS query_ordinal, r.id AS ordinal, q.site, q.c AS qc, r.c AS rc, q.m AS qm, r.m AS rm, q.v AS qv, r.v AS rv, q.a AS qa, r.a AS ra FROM qs q JOIN rs r ON q.id % (SELECT n FROM nq) = r.id % (SELECT n FROM nq) AND q.site = r.site)
SELECT query_ordinal, ordinal, """
BY_PAIR = "GROUP BY query_ordinal, ordinal"
INNER = f"WHERE site >= {TRIM} AND site < 120 - {TRIM} "


def total(condition: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def resolution(k: str) -> str:
    left, right = f"sum(CASE WHEN q{k} = 1 AND r{k} = 0 THEN 1 ELSE 0 END)", f"sum(CASE WHEN r{k} = 1 AND q{k} = 0 THEN 1 ELSE 0 END)"
    return f"CAST(CASE WHEN {left} > 0 AND {right} > 0 THEN 255 WHEN {left} > 0 THEN -1 WHEN {right} > 0 THEN 1 ELSE 0 END AS BIGINT)"


BASE = f"WITH {SITES}, {QUERIES}, {REFS}"
WITH_NEAREST = f"{BASE}, {profile()}, {nearest_full()} "
BACKBONE = "base AS (SELECT site, coalesce(arg_min(c, id) FILTER (WHERE a = 1), 'A') AS base FROM rs GROUP BY site)"
SNPS = f"WITH {SITES}, {BACKBONE}, snp AS (SELECT r.id, r.site, CASE WHEN r.v = 1 AND r.c <> b.base THEN 1 ELSE 0 END AS snp FROM rs r JOIN base b ON r.site = b.site) "
SHARED = f"""{SITES}, {QUERIES}, rx AS (SELECT * FROM rs WHERE id % 400 NOT IN (SELECT id % 40 FROM qp)), rp AS (SELECT * FROM rx WHERE id IN (SELECT id FROM rx GROUP BY id HAVING sum(v) >= floor(count(*) * 0.5)))"""

#: Leader clustering record by record, then rounds in which half of the queues take in the others; four rounds serve up to 16 queues.
CLUSTER_ROUNDS = 4


def merge_round(k: int) -> str:
    """From the medoids ``m{k}`` and members ``a{k}`` to those of half as many queues."""
    return f"""h{k} AS (SELECT (max(queue) + 2) // 2 AS half FROM m{k}),
s{k} AS (SELECT m.*, row_number() OVER (ORDER BY d_ref DESC, snp DESC, known DESC, medoid) AS place, CASE WHEN queue < half THEN queue ELSE queue - half END AS pair, queue >= half AS moves FROM m{k} m, h{k}),
i{k} AS (SELECT r.medoid, arg_min(l.medoid, l.place) AS into_ FROM s{k} r JOIN near n ON n.a = r.medoid JOIN s{k} l ON l.medoid = n.b AND l.pair = r.pair AND NOT l.moves WHERE r.moves GROUP BY r.medoid),
b{k} AS (SELECT into_, medoid, d_ref, snp, known FROM (SELECT i.into_, s.*, row_number() OVER (PARTITION BY i.into_ ORDER BY known DESC, d_ref DESC, s.medoid) AS rn FROM i{k} i JOIN s{k} s ON s.medoid = i.medoid) x WHERE rn = 1),
o{k} AS (SELECT l.pair AS queue, l.medoid AS was, CASE WHEN b.known > l.known THEN b.medoid ELSE l.medoid END AS medoid, CASE WHEN b.known > l.known THEN b.d_ref ELSE l.d_ref END AS d_ref,
 CASE WHEN b.known > l.known THEN b.snp ELSE l.snp END AS snp, CASE WHEN b.known > l.known THEN b.known ELSE l.known END AS known FROM s{k} l LEFT JOIN b{k} b ON b.into_ = l.medoid WHERE NOT l.moves
 UNION ALL SELECT pair, medoid, medoid, d_ref, snp, known FROM s{k} WHERE moves AND medoid NOT IN (SELECT medoid FROM i{k})),
n{k} AS (SELECT was, medoid FROM o{k} UNION ALL SELECT i.medoid, o.medoid FROM i{k} i JOIN o{k} o ON o.was = i.into_),
m{k + 1} AS (SELECT queue, medoid, d_ref, snp, known FROM o{k}),
a{k + 1} AS (SELECT n.medoid, a.member FROM a{k} a JOIN n{k} n ON n.was = a.medoid)"""


def clusters(distance: int = 1, queue: int = 1000) -> str:
    ranked = "(r.known > m.known OR r.known = m.known AND r.d_ref > m.d_ref)"
    return f"""WITH RECURSIVE {SITES}, {BACKBONE}, marked AS (SELECT r.id, r.site, r.v, CASE WHEN r.v = 1 AND r.c <> b.base THEN 1 ELSE 0 END AS snp FROM rs r JOIN base b ON r.site = b.site),
rec AS (SELECT id, id // {queue} AS queue, CAST(sum(snp) AS BIGINT) AS d_ref, CAST(coalesce(min(CASE WHEN snp = 1 THEN site END), -1) AS BIGINT) AS snp, CAST(sum(v) AS BIGINT) AS known FROM marked GROUP BY id),
half AS (SELECT x.id AS a, y.id AS b, sum(CASE WHEN x.v = 1 AND y.v = 1 AND x.c <> y.c THEN 1 ELSE 0 END) AS d FROM rec r JOIN rec m ON r.id < m.id AND abs(r.d_ref - m.d_ref) <= {distance}
 JOIN rs x ON x.id = r.id JOIN rs y ON y.id = m.id AND y.site = x.site GROUP BY x.id, y.id HAVING sum(CASE WHEN x.v = 1 AND y.v = 1 AND x.c <> y.c THEN 1 ELSE 0 END) <= {distance}),
near AS MATERIALIZED (SELECT a, b, d FROM half UNION ALL SELECT b, a, d FROM half),
cand AS MATERIALIZED (SELECT r.id, r.queue, row_number() OVER (PARTITION BY r.queue ORDER BY r.id) AS pos, coalesce(list(m.id) FILTER (WHERE m.id IS NOT NULL), []) AS close_to, coalesce(list(m.id) FILTER (WHERE n.d = 0 AND {ranked}), []) AS better_than
 FROM rec r LEFT JOIN near n ON n.a = r.id LEFT JOIN rec m ON m.id = n.b AND m.queue = r.queue GROUP BY r.id, r.queue),
lead_ AS (SELECT DISTINCT queue, CAST(0 AS BIGINT) AS pos, CAST([] AS BIGINT[]) AS medoids, CAST(0 AS BIGINT) AS at, CAST(NULL AS BIGINT) AS id FROM rec
 UNION ALL SELECT queue, pos, CASE WHEN f = 0 THEN list_append(medoids, id) WHEN list_contains(better_than, medoids[f]) THEN list_transform(medoids, lambda m, i: CASE WHEN i = f THEN id ELSE m END) ELSE medoids END,
  CASE WHEN f = 0 THEN len(medoids) + 1 ELSE f END, id
 FROM (SELECT l.queue, c.pos, l.medoids, c.id, c.better_than, CAST(coalesce(list_position(list_transform(l.medoids, lambda m: list_contains(c.close_to, m)), true), 0) AS BIGINT) AS f FROM lead_ l JOIN cand c ON c.queue = l.queue AND c.pos = l.pos + 1) x),
last_ AS (SELECT queue, arg_max(medoids, pos) AS medoids FROM lead_ GROUP BY queue),
a0 AS MATERIALIZED (SELECT last_.medoids[l.at] AS medoid, l.id AS member, l.queue FROM lead_ l JOIN last_ ON last_.queue = l.queue WHERE l.id IS NOT NULL),
m0 AS MATERIALIZED (SELECT r.queue, r.id AS medoid, r.d_ref, r.snp, r.known FROM rec r WHERE r.id IN (SELECT medoid FROM a0)),
{", ".join(merge_round(k) for k in range(CLUSTER_ROUNDS))}, final_ AS (SELECT medoid, count(*) AS n_members FROM a{CLUSTER_ROUNDS} GROUP BY medoid),
ordered AS (SELECT f.medoid, n_members, row_number() OVER (ORDER BY n_members DESC, d_ref DESC, snp DESC, known DESC, f.medoid) - 1 AS place FROM final_ f JOIN rec r ON r.id = f.medoid) """


CLUSTERS = clusters()
#: Costs row by row of the reference; ``b``, ``d``, ``s``: least cost of all paths, of those that end in a deletion, in an insertion.
ALIGN = f"""WITH RECURSIVE {SITES}, {BACKBONE}, edits AS (SELECT id, site, CASE WHEN c IN ('N', '-') OR (id * 13 + site) % 97 = 0 THEN '' WHEN (id * 11 + site) % 101 = 0 THEN c || 'T' ELSE c END AS t FROM rs),
whole AS (SELECT id, string_agg(t, '' ORDER BY site) AS w FROM edits GROUP BY id),
cut AS (SELECT id, CASE WHEN id % 9 = 4 THEN substr(w, 31) WHEN id % 11 = 5 THEN w || reverse(w) ELSE w END AS s FROM whole),
fit AS MATERIALIZED (SELECT id, s, length(s) AS n FROM cut WHERE 3 * length(s) >= 240 AND 2 * length(s) <= 360 AND length(regexp_replace(s, '[^ACGT]', '', 'g')) / CAST(length(s) AS DOUBLE) >= 1 - 1.1 * 0.5),
cells AS MATERIALIZED (SELECT id, j, substr(s, CAST(j AS INTEGER), 1) AS c FROM (SELECT id, s, unnest(range(0, n + 1)) AS j FROM fit) x),
ref_ AS MATERIALIZED (SELECT site, base FROM base),
dp AS (SELECT CAST(-1 AS BIGINT) AS i, id, j, CAST(CASE WHEN j = 0 THEN 0 ELSE 6 + 2 * j END AS BIGINT) AS b, CAST(1000000 AS BIGINT) AS d FROM cells
 UNION ALL SELECT i, id, j, least(o, CAST(coalesce(min(o - 2 * j) OVER (PARTITION BY id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 * j + 6, 1000000) AS BIGINT)), d
 FROM (SELECT i, id, j, least(d, diagonal) AS o, d FROM (SELECT p.i + 1 AS i, p.id, p.j, least(p.d, p.b + 6) + 2 AS d,
  CAST(coalesce(lag(p.b) OVER (PARTITION BY p.id ORDER BY p.j) + CASE WHEN c.c = r.base THEN 0 ELSE 4 END, 1000000) AS BIGINT) AS diagonal
  FROM dp p JOIN cells c ON c.id = p.id AND c.j = p.j JOIN ref_ r ON r.site = p.i + 1) x) y)
SELECT dp.id AS ordinal, CAST(b AS BIGINT) AS cost FROM dp JOIN fit ON fit.id = dp.id AND fit.n = dp.j WHERE i = 119"""

ORACLES = {
    "normalise": f"WITH {SITES}, {REF_TEXT} SELECT id AS ordinal, seq FROM rt",
    "trim": f"WITH {SITES} SELECT id AS ordinal, string_agg(c, '' ORDER BY site) AS seq FROM rs {INNER}GROUP BY id",
    "char_classes": f"WITH {SITES} SELECT id AS ordinal, {total('a = 1')} AS n_acgt, {total('a = 0 AND v = 1')} AS n_partial, {total('v = 0')} AS n_invalid FROM rs GROUP BY id",
    "compress_acgt": f"WITH {SITES} SELECT id AS ordinal, string_agg(CASE WHEN a = 1 THEN c ELSE '' END, '' ORDER BY site) AS seq FROM rs GROUP BY id",
    "count_valid": f"WITH {SITES} SELECT id AS ordinal, CAST(sum(v) AS BIGINT) AS n FROM rs GROUP BY id",
    "count_acgt": f"WITH {SITES} SELECT id AS ordinal, CAST(sum(a) AS BIGINT) AS n FROM rs GROUP BY id",
    "proportions": f"WITH {SITES} SELECT id AS ordinal, round(sum(a) / CAST(count(*) AS DOUBLE), 8) AS acgt, round(sum(1 - v) / CAST(count(*) AS DOUBLE), 8) AS invalid FROM rs GROUP BY id",
    "filter_queries": f"WITH {SITES}, {QUERIES} SELECT DISTINCT id AS ordinal, 'query' || id AS name FROM qp",
    "filter_refs": f"WITH {SITES} SELECT id AS ordinal, 'ref' || id AS name FROM rs GROUP BY id HAVING sum(v) >= floor(count(*) * 0.7)",
    "filter_refs_ball": f"WITH {SITES} SELECT id AS ordinal, 'ref' || id AS name FROM rs GROUP BY id HAVING sum(v) >= floor(count(*) * 0.3)",
    "filter_unaligned": f"""WITH {SITES}, edits AS (SELECT id, site, CASE WHEN c IN ('N', '-') OR (id * 13 + site) % 97 = 0 THEN '' WHEN (id * 11 + site) % 101 = 0 THEN c || 'T' ELSE c END AS t FROM rs),
whole AS (SELECT id, string_agg(t, '' ORDER BY site) AS w FROM edits GROUP BY id),
cut AS (SELECT id, CASE WHEN id % 9 = 4 THEN substr(w, 31) WHEN id % 11 = 5 THEN w || reverse(w) ELSE w END AS s FROM whole)
SELECT id AS ordinal, 'ref' || id AS name FROM cut WHERE 3 * length(s) >= 240 AND 2 * length(s) <= 360 AND length(regexp_replace(s, '[^ACGT]', '', 'g')) / CAST(length(s) AS DOUBLE) >= 1 - 1.1 * 0.5""",
    "run_counters": f"""WITH {SITES}, {QUERIES}, per AS (SELECT id, CASE WHEN id % 400 IN (SELECT id % 40 FROM qp) THEN 1 ELSE 0 END AS same, CASE WHEN sum(v) >= floor(count(*) * 0.5) THEN 1 ELSE 0 END AS clear FROM rs GROUP BY id)
SELECT count(*) AS n_read, {total('same = 1')} AS n_same_name, {total('same = 0 AND clear = 0')} AS n_ambiguous, {total('same = 0 AND clear = 1')} AS n_kept FROM per""",
    "site_profile": f"WITH {SITES}, {QUERIES}, {profile()} SELECT site, n_distinct, n_missing, class, consensus FROM prof",
    "site_profile_acgt": f"WITH {SITES}, {QUERIES}, {profile('a', TRIM)} SELECT site, n_distinct, n_missing, class, consensus FROM prof",
    "consensus": f"WITH {SITES}, {QUERIES}, {profile()} SELECT string_agg(consensus, '' ORDER BY site) AS consensus FROM prof",
    "site_class_counts": f"WITH {SITES}, {QUERIES}, {profile()} SELECT class, count(*) AS n_sites FROM prof GROUP BY class",
    "query_order": f"WITH {SITES}, {QUERIES}, k AS (SELECT id, CAST(sum(v) AS BIGINT) AS n_known FROM qp GROUP BY id) SELECT id AS ordinal, 'query' || id AS name, n_known, row_number() OVER (ORDER BY n_known, id) AS resolution_order FROM k",
    "pair_score_full": PAIRS + f"{total('qa = 1 AND qc = rc')} AS acgt, {total('qv = 1 AND qc = rc')} AS text, {total('qv * rv = 1 AND (qc = rc OR (qm & rm) <> 0)')} AS partial, {total('qv * rv = 1')} AS valid FROM pairs {BY_PAIR}",
    "pair_score_acgt": PAIRS + f"{total('qa * ra = 1 AND qc <> rc')} AS mismatches, {total('qa * ra = 1')} AS acgt_valid FROM pairs {BY_PAIR}",
    "pair_acgt_dist": PAIRS + f"{total('qa * ra = 1 AND qc <> rc')} AS distance FROM pairs {INNER}{BY_PAIR}",
    "pair_text_dist": PAIRS + f"{total('qv * rv = 1 AND qc <> rc')} AS distance FROM pairs {INNER}{BY_PAIR}",
    "pair_hamming": PAIRS + f"{total('qc <> rc')} AS distance FROM pairs {INNER}{BY_PAIR}",
    "resolution_order": PAIRS + f"{resolution('v')} AS known, {resolution('a')} AS acgt FROM pairs {BY_PAIR}",
    "nn_full": WITH_NEAREST + named(FULL),
    "nn_acgt": f"{BASE}, {profile('a')}, {NEAREST_ACGT} " + named(ONLY_ACGT),
    "nn_exclude_self": f"WITH {SHARED}, {profile()}, {nearest_full()} SELECT qid AS query_ordinal, rid AS ref_ordinal, rank, {FULL} FROM nn",
    "nn_keep_resolved": f"{BASE}, {redundancy(True)}, {profile(table='kq')}, {nearest_full(queries='kq')} " + named(FULL),
    "nn_trimmed": f"{BASE}, {profile(trim=TRIM)}, {nearest_full()} " + named(FULL),
    "nn_reference_union": WITH_NEAREST + "SELECT DISTINCT 'ref' || rid AS name FROM nn",
    "snp_distance": WITH_NEAREST + "SELECT 'query' || qid AS query, 'ref' || rid AS reference, valid_pair_comparisons - partial_matches AS snp_distance FROM nn",
    "snp_distance_acgt": f"{BASE}, {profile('a')}, {NEAREST_ACGT} SELECT 'query' || qid AS query, 'ref' || rid AS reference, dist_consensus + dist_unique AS snp_distance FROM nn",
    "closest_names": WITH_NEAREST + "SELECT DISTINCT 'ref' || rid AS name FROM nn WHERE rank = 1",
    "closest_alignment": f"{BASE}, {profile()}, {nearest_full()}, {REF_TEXT} SELECT id AS ordinal, 'ref' || id AS name, seq FROM rt WHERE id IN (SELECT rid FROM nn WHERE rank = 1)",
    "keep_resolved": f"{BASE}, {redundancy(True)} SELECT DISTINCT id AS ordinal, 'query' || id AS name FROM kq",
    "keep_less_resolved": f"{BASE}, {redundancy(False)} SELECT DISTINCT id AS ordinal, 'query' || id AS name FROM kq",
    "ball_full": f"{BASE}, {redundancy(False)}, {ball('v', True, f'distance <= {RADIUS}')}",
    "ball_acgt": f"{BASE}, {redundancy(False, 'a')}, {ball('a', True, f'distance <= {RADIUS}')}",
    "ball_consensus": f"{BASE}, {redundancy(False)}, {profile(table='kq')}, {ball('v', False, f'distance <= {RADIUS}')}",
    "ball_as_written": f"{BASE}, {redundancy(False)}, {profile(table='kq')}, {ball('v', False, f'o <= {RADIUS} AND (2 * o <= {RADIUS} OR distance <= {RADIUS})')}",
    "legacy_scores": f"WITH {SITES}, {QUERIES}, {legacy()} SELECT {LEGACY_NAMED} FROM sc",
    "legacy_search": f"WITH {SITES}, {QUERIES}, {legacy()}, {legacy_chosen()} SELECT {LEGACY_NAMED} FROM chosen",
    "legacy_chosen": f"WITH {SITES}, {QUERIES}, {legacy()}, {legacy_chosen()} SELECT DISTINCT rid AS ordinal, 'ref' || rid AS name FROM chosen",
    "synth_reference": f"WITH {SITES}, {BACKBONE} SELECT site, base FROM base",
    "snp_vs_reference": SNPS + """, listed AS (SELECT id, sum(snp) AS n, list(site ORDER BY site) FILTER (WHERE snp = 1) AS sites FROM snp GROUP BY id)
SELECT id AS ordinal, CAST(n AS BIGINT) AS distance, CAST(coalesce(sites[1], -1) AS BIGINT) AS snp_1, CAST(coalesce(sites[2], -1) AS BIGINT) AS snp_2 FROM listed""",
    "snp_counter": SNPS + "SELECT site, CAST(sum(snp) AS BIGINT) AS n_snps FROM snp GROUP BY site HAVING sum(snp) > 0",
    "snp_sites": SNPS + "SELECT site FROM snp GROUP BY site HAVING sum(snp) > 0",
    "fasta_roundtrip": f"WITH {SITES}, {REF_TEXT} SELECT 'ref' || id AS name, seq FROM rt",
    "fasta_codecs": f"WITH {SITES}, {REF_TEXT} SELECT 'ref' || id AS name, seq FROM rt",
    "fasta_xz": f"WITH {SITES}, {REF_TEXT} SELECT row_number() OVER (ORDER BY id) - 1 AS ordinal, 'ref' || id AS name, seq FROM rt",
    "fasta_multi": f"WITH {SITES}, {REF_TEXT}, both_files AS (SELECT 0 AS f, id, 'ref' || id AS name, seq FROM rt UNION ALL SELECT 1, id, 'query' || id, string_agg(c, '' ORDER BY site) FROM qs GROUP BY id) SELECT row_number() OVER (ORDER BY f, id) - 1 AS ordinal, name, seq FROM both_files",
    "nn_table": f"{BASE}, {profile()}, {nearest_full()}, k AS (SELECT id, sum(v) AS n_known FROM qp GROUP BY id), o AS (SELECT id, row_number() OVER (ORDER BY n_known, id) AS resolution_order FROM k) SELECT 'query' || qid AS query, 'ref' || rid AS reference, rank, {FULL}, resolution_order FROM nn JOIN o ON o.id = nn.qid",
    "sql_weighted": PAIRS + f"round(sum(CASE WHEN qm > 0 AND rm > 0 THEN bit_count(qm & rm) / CAST(bit_count(qm) * bit_count(rm) AS DOUBLE) ELSE 0 END), 3) AS partial_matches FROM pairs {BY_PAIR}",
    "sql_snps": f"""WITH {SITES}, base AS (SELECT site, c, v FROM rs WHERE id = (SELECT min(id) FROM rs)), d AS (SELECT r.id, r.site FROM rs r JOIN base b ON r.site = b.site WHERE r.v = 1 AND b.v = 1 AND r.c <> b.c)
SELECT x.id AS ordinal, count(d.site) AS distance, coalesce(min(d.site), -1) AS snp_1 FROM (SELECT DISTINCT id FROM rs) x LEFT JOIN d ON d.id = x.id GROUP BY x.id""",
}
ORACLES |= {
    "align_cost": ALIGN,
    # What must hold for any alignment of the least cost.
    "align_cigar": ALIGN.replace("SELECT dp.id AS ordinal, CAST(b AS BIGINT) AS cost FROM", "SELECT dp.id AS ordinal, CAST(b AS BIGINT) AS cost, CAST(120 AS BIGINT) AS ref_sites, CAST(fit.n AS BIGINT) AS seq_letters, CAST(120 AS BIGINT) AS projected, true AS agrees FROM"),
    "cluster_leader": f"{CLUSTERS} SELECT CAST(queue AS INTEGER) AS queue, medoid, member FROM a0",
    "cluster_merge": f"{CLUSTERS} SELECT medoid, member FROM a{CLUSTER_ROUNDS}",
    "cluster_sizes": f"{CLUSTERS} SELECT medoid, 'ref' || medoid AS medoid_name, n_members FROM final_",
    "cluster_medoids": f"{CLUSTERS}, {REF_TEXT} SELECT place AS ordinal, 'ref' || medoid AS name, seq FROM ordered JOIN rt ON rt.id = ordered.medoid",
    # Lines of up to 1000 names: larger clusters are cut by a hash that SQL lacks.
    "cluster_table": f"{CLUSTERS} SELECT place, n_members, o.medoid, CAST(0 AS BIGINT) AS part, concat_ws(',', 'ref' || o.medoid, string_agg('ref' || member, ',' ORDER BY member) FILTER (WHERE member <> o.medoid)) AS line FROM ordered o JOIN a{CLUSTER_ROUNDS} a ON a.medoid = o.medoid GROUP BY place, n_members, o.medoid",
}
ORACLES["stream_nn"] = ORACLES["nn_full"]
#: A reference enters with its own quarter, if it is among the best of those up to then.
ENTRANTS = nearest_full().replace(f"WHERE rank <= {BEST}", "").replace("row_number() OVER (PARTITION BY qid ORDER BY", "row_number() OVER (PARTITION BY qid, batch ORDER BY")
ENTRANTS = ENTRANTS.replace("FROM scored JOIN known ON known.id = scored.rid", "FROM scored JOIN known ON known.id = scored.rid JOIN (SELECT CAST(range AS BIGINT) AS batch FROM range(4)) b ON rid % 4 <= batch").replace("SELECT qid, rid,", "SELECT qid, rid, batch,")
ORACLES["stream_entrants"] = f"{BASE}, {profile()}, {ENTRANTS} SELECT 'query' || qid AS query, 'ref' || rid AS reference, batch AS entered_at_batch FROM nn WHERE rank <= {BEST} AND rid % 4 = batch"
ORACLES["observed_counters"] = ORACLES["run_counters"]
ORACLES["stream_fasta_nn"] = ORACLES["nn_full"]
ORACLES["stream_ball"] = ORACLES["ball_full"]
ORACLES["stream_align"] = ORACLES["align_cost"]
ORACLES["nn_worst"] = ORACLES["nn_full"] + " QUALIFY rank = max(rank) OVER (PARTITION BY qid)"
ORACLES["stream_cluster"] = ORACLES["cluster_leader"]
ORACLES["sql_functions"] = ORACLES["pair_score_full"]
ORACLES["sql_resolution"] = ORACLES["resolution_order"]
