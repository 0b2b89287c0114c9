"""Fingerprints and duplicated blocks over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import clones, rollups, rules
from tessera.plans.analysis_queries import LIMITS, measured
from tessera.plans.corpus import TOKENS_SQL, document_files

K, W = clones.window_sizes(100)

FNV_SQL = "list_reduce([2166136261::BIGINT] || list_transform(string_split(token, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_ROLL = "list_reduce([0::BIGINT] || ids[p + 1:p + {k}], lambda h, x: (h * {base} + x) & 4294967295)"
GRAMS_SQL = TOKENS_SQL + f""", vocabulary AS (SELECT token, {FNV_SQL} AS id FROM (SELECT DISTINCT token FROM tokens)),
arrays AS (SELECT path, list(id ORDER BY pos) AS ids FROM tokens JOIN vocabulary USING (token) GROUP BY path),
grams AS (SELECT path, p::INT AS pos, {_ROLL.format(k=K, base=clones.BASE_1)} * 2097152 + ({_ROLL.format(k=K, base=clones.BASE_2)} >> 11) AS hash FROM arrays, unnest(range(greatest(len(ids) - {K - 1}, 0))) AS x(p))"""
ALL_PRINTS_SQL = GRAMS_SQL + f""", windows AS (SELECT path, pos, count(*) OVER (PARTITION BY path) AS n, min({{'h': hash, 'p': -pos}}) OVER (PARTITION BY path ORDER BY pos ROWS BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS m FROM grams),
prints AS (SELECT DISTINCT path, (-m.p)::INT AS pos, m.h AS hash FROM windows WHERE pos >= {W - 1} OR (n < {W} AND pos = n - 1))"""
PRINTS_SQL = ALL_PRINTS_SQL + f""",
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY path, pos) AS k FROM prints) WHERE k <= {clones.MOST_OCCURRENCES})"""

#: Equal runs are islands on the diagonals that seeds lie on; a file takes matches from the first place on, by recursion.
BLOCKS_SQL = PRINTS_SQL.replace("arrays AS (SELECT path, list(id ORDER BY pos) AS ids", "arrays AS (SELECT path, list(id ORDER BY pos) AS ids, list(line ORDER BY pos) AS at_line") + f""",
seeds AS (SELECT p.path, p.pos, k.path AS partner, k.pos AS ppos, k.pos - p.pos AS d FROM prints p JOIN kept k USING (hash) WHERE p.path <> k.path OR p.pos <> k.pos),
ids AS (SELECT path, pos, id FROM tokens JOIN vocabulary USING (token)),
equal AS (SELECT s.path, s.partner, s.d, t.pos AS i, t.pos - row_number() OVER (PARTITION BY s.path, s.partner, s.d ORDER BY t.pos) AS island
    FROM (SELECT DISTINCT path, partner, d FROM seeds) s JOIN ids t ON t.path = s.path JOIN ids u ON u.path = s.partner AND u.pos = t.pos + s.d AND u.id = t.id),
runs AS (SELECT path, partner, d, min(i) AS s, max(i) + 1 AS e FROM equal GROUP BY path, partner, d, island HAVING count(*) >= 100),
matches AS (SELECT path, pos, partner, ppos, s, e, s + d AS there FROM seeds JOIN runs r USING (path, partner, d) WHERE s <= pos AND pos + {K} <= e AND NOT (path = partner AND s + d < e AND s < e + d)),
taken AS (SELECT path, -1 AS pos, NULL::VARCHAR AS partner, 0::BIGINT AS s, 0::BIGINT AS e, 0::BIGINT AS there, 0::BIGINT AS reach FROM (SELECT DISTINCT path FROM matches)
    UNION ALL SELECT m.path, m.pos, m.partner, m.s, m.e, m.there, greatest(t.reach, m.e) FROM taken t JOIN matches m ON m.path = t.path AND m.pos >= t.reach
    QUALIFY row_number() OVER (PARTITION BY m.path ORDER BY m.pos, m.partner, m.ppos) = 1),
sorted AS (SELECT *, max(e) OVER (PARTITION BY path ORDER BY s, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM taken WHERE partner IS NOT NULL),
islands AS (SELECT *, sum(CASE WHEN s <= before THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY s, pos) AS island FROM sorted),
merged AS (SELECT path, min(s) AS s, max(e) AS e, arg_min({{'p': partner, 'there': there}}, s * 1000000 + pos) AS f FROM islands GROUP BY path, island),
blocks AS (SELECT m.path, a.at_line[s + 1] AS start_line, a.at_line[e] AS end_line, (e - s)::INT AS tokens, f.p AS partner_path, b.at_line[f.there + 1] AS partner_line FROM merged m JOIN arrays a ON a.path = m.path JOIN arrays b ON b.path = f.p)"""


def _prints(spark, sf_dir):
    return clones.fingerprints(clones.token_arrays(document_files(spark, sf_dir)))


def token_id_stats(spark, sf_dir):
    ids = clones.token_arrays(document_files(spark, sf_dir))
    return ids.select("path", F.size("ids").cast("long").alias("tokens"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), F.array_max("lines").alias("last_line"))


def winnow_fingerprints(spark, sf_dir):
    return _prints(spark, sf_dir)


def hot_fingerprint_cap(spark, sf_dir):
    """The places that are kept of fingerprints that stand more than once."""
    kept = clones.cap_occurrences(_prints(spark, sf_dir))
    return kept.groupBy("hash").agg(F.collect_list(F.struct("path", "pos")).alias("p")).where(F.size("p") > 1).select("hash", F.explode("p").alias("p")).select("hash", "p.path", "p.pos")


def clone_pairs(spark, sf_dir):
    """All pairs of files that share a fingerprint."""
    return clones.clone_pairs(_prints(spark, sf_dir), None)


def clone_blocks(spark, sf_dir):
    return clones.clone_blocks(clones.token_arrays(document_files(spark, sf_dir)))


def duplication_findings(spark, sf_dir):
    """The findings of duplicated blocks, from texts to debt."""
    found = rules.evaluate(clones.with_blocks(measured(spark, sf_dir), clone_blocks(spark, sf_dir)), LIMITS, "blocks")
    every = rollups.explode_findings(found)
    return every.where("rule_id = 'CQ007'").select("path", "severity", "line", "end_line", "value", "debt_minutes", "message")


def affected_paths(spark, sf_dir):
    prints = _prints(spark, sf_dir)
    changed = document_files(spark, sf_dir).where("path LIKE 'src1/%'").select("path")
    return clones.affected_paths(prints, changed)


QUERIES = {
    "token_id_stats": (token_id_stats, f"WITH {TOKENS_SQL}, v AS (SELECT token, {FNV_SQL} AS id FROM (SELECT DISTINCT token FROM tokens)) SELECT path, count(*) AS tokens, sum(id)::BIGINT AS id_sum, max(line) AS last_line FROM tokens JOIN v USING (token) GROUP BY path"),
    "winnow_fingerprints": (winnow_fingerprints, f"WITH {PRINTS_SQL} SELECT * FROM prints"),
    "hot_fingerprint_cap": (hot_fingerprint_cap, f"WITH {PRINTS_SQL} SELECT hash, path, pos FROM kept QUALIFY count(*) OVER (PARTITION BY hash) > 1"),
    "clone_pairs": (clone_pairs, f"WITH {ALL_PRINTS_SQL} SELECT a.path, b.path AS partner, count(*) AS shared FROM prints a JOIN prints b ON a.hash = b.hash AND a.path < b.path GROUP BY ALL"),
    "clone_blocks": (clone_blocks, f"WITH RECURSIVE {BLOCKS_SQL} SELECT * FROM blocks"),
    "duplication_findings": (duplication_findings, f"""WITH RECURSIVE {BLOCKS_SQL}, n AS (SELECT *, end_line - start_line + 1 AS n FROM blocks)
        SELECT path, CASE WHEN n >= 50 THEN 'critical' ELSE 'major' END AS severity, start_line AS line, end_line, n::DOUBLE AS value, 10 + floor(n / 5 + 0.5)::BIGINT AS debt_minutes,
            n || ' lines also in ' || partner_path || ' from line ' || (partner_line + 1) AS message FROM n"""),
    "affected_paths": (affected_paths, f"WITH {PRINTS_SQL} SELECT path FROM prints WHERE hash IN (SELECT hash FROM prints WHERE path LIKE 'src1/%') UNION SELECT path FROM files WHERE path LIKE 'src1/%'"),
}
