"""Queries of splits and protocols over trial_manifest."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.functions.ids import hash_fraction
from cohortloom.operators import splits as S
from cohortloom.store import table


def _rows(s, d):
    return S.prepare(table(s, d, "trial_manifest"))


def hash_split(s, d):
    c = F.col("content")
    return _rows(s, d).select("content").distinct().select("content", F.round(hash_fraction(F.lit("42"), c), 12).alias("fraction"), S.content_partition(c).alias("partition"))


def quota_counts(s, d):
    return S.quota_counts(s.range(3, 203).select(F.col("id").alias("n")))


def quota_split(s, d):
    e = S.entity_partition(_rows(s, d))
    return e.select("cohort", "entity", F.col("rank").cast("int").alias("rank"), "partition")


def protocol_text_unseen(s, d):
    return S.partition_counts(S.text_unseen(_rows(s, d)), [])


def protocol_diagonal(s, d):
    x = S.diagonal(_rows(s, d))
    return x.select("row_id", "partition", "reason")


def protocol_cross_domain(s, d):
    return S.cross_domain(_rows(s, d)).groupBy("protocol", "partition", "reason").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("content").alias("n_contents"))


def strict_masks(s, d):
    return S.strict_masks(_rows(s, d))


def protocol_counts(s, d):
    return S.partition_counts(S.cross_domain(_rows(s, d)), ["protocol"])


def protocol_ratios(s, d):
    n = S.diagonal(_rows(s, d)).groupBy("partition").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("content").alias("n_contents"))
    every = Window.partitionBy()  # a handful of partitions
    return n.select("partition", "n_rows", F.round(F.col("n_rows") / F.sum("n_rows").over(every), 9).alias("of_manifest"), F.round(F.when(F.col("partition").isNotNull(), F.col("n_rows")) / F.sum(F.when(F.col("partition").isNotNull(), F.col("n_rows"))).over(every), 9).alias("of_selected"), "n_contents")


def quality_accounting(s, d):
    x = S.diagonal(_rows(s, d))
    has = lambda f: F.count_if(F.array_contains(F.split("quality_flag", r"\|"), f))
    return x.groupBy(F.coalesce("partition", F.lit("excluded")).alias("part")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("fuzzy")).alias("n_fuzzy"), F.count_if(F.col("missing")).alias("n_missing"), has("implausible_eeg_trial_duration").alias("n_implausible"), has("material_variant_uncertain").alias("n_uncertain"))


def accounting(s, d):
    return S.accounting(S.cross_domain(_rows(s, d)), ["protocol"])


def leakage_pairs(s, d):
    r = _rows(s, d)
    a, b = S.text_unseen(r), S.diagonal(r)
    one = lambda x, p, w: S.leakage(x, [], w).select(F.lit(p).alias("protocol"), F.lit(w).alias("what"), "pair", "n")
    return one(a, "A", "content").unionByName(one(a, "A", "entity")).unionByName(one(b, "B", "content")).unionByName(one(b, "B", "entity"))


def leakage_check(s, d):
    """Content groups that the delivered split tears apart."""
    clean = F.when(F.lower(F.trim("split")) == "validation", "valid").otherwise(F.lower(F.trim("split")))
    g = _rows(s, d).groupBy("content").agg(F.array_join(F.array_sort(F.collect_set(clean)), "+").alias("splits"), F.count(F.lit(1)).alias("n_rows"))
    return g.where(F.col("splits").contains("+"))


def split_recompute(s, d):
    """Delivered split against the one recomputed from the stored seed and group."""
    t = table(s, d, "trial_manifest")
    clean = F.when(F.lower(F.trim("split")) == "validation", "valid").otherwise(F.lower(F.trim("split")))
    again = S.partition_of(hash_fraction(F.col("split_seed").cast("string"), F.lower(F.trim("split_group_id"))))
    return t.groupBy(clean.alias("stored"), again.alias("recomputed")).agg(F.count(F.lit(1)).alias("n_rows"))


_H = "('0x' || substr(sha256({}), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0"
_PART = f"CASE WHEN {_H.format(chr(39) + '42' + chr(39) + ' || chr(0) || content')} < 0.8::DOUBLE THEN 'train' WHEN {_H.format(chr(39) + '42' + chr(39) + ' || chr(0) || content')} < 0.8::DOUBLE + 0.1::DOUBLE THEN 'validation' ELSE 'test' END"
_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BASE = f"""r0 AS (SELECT row_id, record_id, lower(trim(split_group_id)) AS content, dataset_version || '::' || paradigm AS cohort, dataset_version || '::' || paradigm || '::' || subject_id AS entity, paradigm AS domain,
global_text_alignment_status = 'fuzzy' AS fuzzy, raw_text IS NULL OR regexp_replace(raw_text, '{_WS}', '', 'g') = '' AS missing, list_contains(string_split(quality_flag, '|'), 'material_variant_uncertain') AS uncertain, quality_flag, split, split_seed FROM trial_manifest),
r AS (SELECT *, {_PART} AS cp FROM r0)"""
_QUOTA = """t AS (SELECT n, unnest(range(1, n + 1)) AS t FROM sizes WHERE n >= 3), v AS (SELECT n, t, unnest(range(1, n - t + 1)) AS v FROM t), q0 AS (SELECT n, t, v, n - t - v AS e FROM v WHERE n - t - v >= 1),
quota AS (SELECT n, t AS n_train, v AS n_valid, e AS n_test FROM q0 QUALIFY row_number() OVER (PARTITION BY n ORDER BY round(abs(t - n * 0.8::DOUBLE) + abs(v - n * 0.1::DOUBLE) + abs(e - n * 0.1::DOUBLE), 9), round((t - n * 0.8::DOUBLE) ** 2 + (v - n * 0.1::DOUBLE) ** 2 + (e - n * 0.1::DOUBLE) ** 2, 9), -t, -v, e) = 1
UNION ALL SELECT n, n, 0, 0 FROM sizes WHERE n < 3)"""
_ENT = f"""en AS (SELECT DISTINCT cohort, entity FROM r), cn AS (SELECT cohort, count(*) AS n FROM en GROUP BY 1), sizes AS (SELECT DISTINCT n FROM cn), {_QUOTA},
rk AS (SELECT cohort, entity, row_number() OVER (PARTITION BY cohort ORDER BY {_H.format("'42' || chr(0) || cohort || chr(0) || entity")}, entity) - 1 AS rank FROM en),
ent AS (SELECT cohort, entity, rank, CASE WHEN rank < n_train THEN 'train' WHEN rank < n_train + n_valid THEN 'validation' ELSE 'test' END AS ep FROM rk JOIN cn USING (cohort) JOIN quota USING (n))"""
_B = f"{_BASE}, {_ENT}, b AS (SELECT r.*, CASE WHEN cp = ep THEN cp END AS partition, CASE WHEN cp <> ep THEN 'off_diagonal_subject_' || ep || '__content_' || cp END AS reason FROM r JOIN ent USING (entity))"
_MASK = "m AS (SELECT content, CASE WHEN bool_or(fuzzy) THEN 'fuzzy_global_alignment' WHEN bool_or(missing) THEN 'missing_text' WHEN bool_or(uncertain) THEN 'material_variant_uncertain' END || '_group_excluded_from_strict_main' AS mask FROM r GROUP BY 1)"
_CROSS = f"""{_BASE}, {_MASK}, c0 AS (SELECT r.*, mask, x.* FROM r LEFT JOIN m USING (content) CROSS JOIN (VALUES {", ".join(f"('{n}', {list(src)!r}, '{t}')" for n, src, t in S.CROSS)}) x(protocol, sources, target)),
c AS (SELECT *, CASE WHEN mask IS NOT NULL THEN NULL WHEN list_contains(sources, domain) AND cp <> 'test' THEN cp WHEN NOT list_contains(sources, domain) AND domain = target AND cp = 'test' THEN cp END AS partition,
CASE WHEN mask IS NOT NULL THEN mask WHEN list_contains(sources, domain) THEN CASE WHEN cp = 'test' THEN 'source_paradigm_test_content_excluded' END WHEN domain = target THEN CASE WHEN cp <> 'test' THEN 'target_paradigm_non_test_content_excluded' END ELSE 'paradigm_out_of_protocol_scope' END AS reason FROM c0)"""
_COUNTS = "count(*) AS n_rows, count(DISTINCT content) AS n_contents, count(DISTINCT entity) AS n_entities, count(DISTINCT domain) AS n_domains"


def _leak(src, p, part, what):
    return f"SELECT '{p}' AS protocol, '{what}' AS what, a.p || '+' || b.p AS pair, count(*) AS n FROM (SELECT DISTINCT {what} AS k, {part} AS p FROM {src}) a JOIN (SELECT DISTINCT {what} AS k, {part} AS p FROM {src}) b ON a.k = b.k AND a.p < b.p GROUP BY 3"


SQL = {
    "hash_split": f"WITH {_BASE} SELECT DISTINCT content, round({_H.format(chr(39) + '42' + chr(39) + ' || chr(0) || content')}, 12) AS fraction, cp AS partition FROM r",
    "quota_counts": f"WITH sizes AS (SELECT range AS n FROM range(3, 203)), {_QUOTA} SELECT * FROM quota",
    "quota_split": f"WITH {_BASE}, {_ENT} SELECT cohort, entity, rank::INTEGER AS rank, ep AS partition FROM ent",
    "protocol_text_unseen": f"WITH {_BASE} SELECT cp AS partition, {_COUNTS} FROM r GROUP BY 1",
    "protocol_diagonal": f"WITH {_B} SELECT row_id, partition, reason FROM b",
    "protocol_cross_domain": f"WITH {_CROSS} SELECT protocol, partition, reason, count(*) AS n_rows, count(DISTINCT content) AS n_contents FROM c GROUP BY ALL",
    "strict_masks": f"WITH {_BASE}, {_MASK} SELECT * FROM m WHERE mask IS NOT NULL",
    "protocol_counts": f"WITH {_CROSS} SELECT protocol, partition, {_COUNTS} FROM c WHERE partition IS NOT NULL GROUP BY ALL",
    "protocol_ratios": f"WITH {_B}, n AS (SELECT partition, count(*) AS n_rows, count(DISTINCT content) AS n_contents FROM b GROUP BY 1) SELECT partition, n_rows, round(n_rows / sum(n_rows) OVER (), 9) AS of_manifest, round(CASE WHEN partition IS NOT NULL THEN n_rows END / sum(CASE WHEN partition IS NOT NULL THEN n_rows END) OVER (), 9) AS of_selected, n_contents FROM n",
    "quality_accounting": f"WITH {_B} SELECT coalesce(partition, 'excluded') AS part, count(*) AS n_rows, count(*) FILTER (fuzzy) AS n_fuzzy, count(*) FILTER (missing) AS n_missing, count(*) FILTER (list_contains(string_split(quality_flag, '|'), 'implausible_eeg_trial_duration')) AS n_implausible, count(*) FILTER (uncertain) AS n_uncertain FROM b GROUP BY 1",
    "accounting": f"WITH {_CROSS} SELECT protocol, count(partition) AS n_kept, count(reason) AS n_excluded, count(*) AS n_all, count(*) FILTER ((partition IS NULL) = (reason IS NULL)) AS unaccounted FROM c GROUP BY 1",
    "leakage_pairs": f"WITH {_B}, k AS (SELECT * FROM b WHERE partition IS NOT NULL) " + " UNION ALL ".join((_leak("r", "A", "cp", "content"), _leak("r", "A", "cp", "entity"), _leak("k", "B", "partition", "content"), _leak("k", "B", "partition", "entity"))),
    "leakage_check": "WITH g AS (SELECT lower(trim(split_group_id)) AS content, string_agg(DISTINCT CASE WHEN lower(trim(split)) = 'validation' THEN 'valid' ELSE lower(trim(split)) END, '+' ORDER BY CASE WHEN lower(trim(split)) = 'validation' THEN 'valid' ELSE lower(trim(split)) END) AS splits, count(*) AS n_rows FROM trial_manifest GROUP BY 1) SELECT * FROM g WHERE contains(splits, '+')",
    "split_recompute": f"WITH h AS (SELECT CASE WHEN lower(trim(split)) = 'validation' THEN 'valid' ELSE lower(trim(split)) END AS stored, {_H.format('split_seed::VARCHAR || chr(0) || lower(trim(split_group_id))')} AS f FROM trial_manifest) SELECT stored, CASE WHEN f < 0.8::DOUBLE THEN 'train' WHEN f < 0.8::DOUBLE + 0.1::DOUBLE THEN 'valid' ELSE 'test' END AS recomputed, count(*) AS n_rows FROM h GROUP BY ALL",
}
QUERIES = {k: globals()[k] for k in SQL}
