"""Queries of the subpackage, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import alike, cut, families, leak, mixing, overlap, reading, sample
from cohortloom.operators.intervals import WINDOW_SCALE_SQL
from cohortloom.operators.joins import spread_join
from cohortloom.store import materialize, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """record_id of the valid and test trials with the same or a near-same raw_text in train."""
    return overlap.overlapping(table(spark, d, "trial_manifest"), "record_id")


def p1_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Each overlapping evaluation form with its number of links, and edits, merged match length and spans of the nearest training form."""
    return overlap.overlaps(table(spark, d, "trial_manifest"))[1]


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """The overlapping evaluation records with the form that p1_overlaps describes."""
    m = table(spark, d, "trial_manifest")
    return overlap.members(m, "record_id", *overlap.overlaps(m))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping rows per split, dataset_version, paradigm and book_id."""
    m = table(spark, d, "trial_manifest")
    texts, links = overlap.overlaps(m)
    return overlap.report(m, links, texts, ["dataset_version", "paradigm", "book_id"])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """family_id of the families whose trials carry two or more splits."""
    return families.torn(*families.trial_families(table(spark, d, "trial_manifest"), table(spark, d, "group_links"))).select("family_id")


def p2_torn(spark: SparkSession, d: str) -> DataFrame:
    """The torn families with their splits and sizes."""
    return families.torn(*families.trial_families(table(spark, d, "trial_manifest"), table(spark, d, "group_links")))


def _own(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))


def p2_assign(spark: SparkSession, d: str) -> DataFrame:
    """Every trial row with its family and split, families whole; a row without a group is a family of its own, ``row:`` and its id."""
    m = table(spark, d, "trial_manifest")
    counted, family = families.trial_families(m, table(spark, d, "group_links"))
    rows = m.select("row_id", "record_id", families.clean_id(F.col("split_group_id")).alias("group"))
    alone = rows.where(F.col("group").isNull()).select("row_id", "record_id", _own("row", "row_id").alias("family"))
    weights = counted.join(family, "group").groupBy("family").agg(F.sum("n").alias("weight")).unionByName(alone.groupBy("family").agg(F.count(F.lit(1)).alias("weight")))
    chosen = materialize(families.assign(weights))
    grouped = spread_join(rows.where(F.col("group").isNotNull()), family.join(chosen, "family"), ["group"], ["row_id"])
    out = grouped.drop("group").unionByName(alone.join(chosen, "family"))
    return out.select("row_id", "record_id", F.col("family").alias("family_id"), "assigned")


def p2_subjects(spark: SparkSession, d: str) -> DataFrame:
    """Every window with its split, subjects whole; a window without a subject is one of its own, ``window:`` and its id."""
    w = table(spark, d, "pl_windows").select("window_id", F.coalesce(families.clean_id(F.col("subject_group_id")), _own("window", "window_id")).alias("family"))
    chosen = families.assign(w.groupBy("family").agg(F.count(F.lit(1)).alias("weight")))
    return spread_join(w.distinct(), chosen, ["family"], ["window_id"]).select("window_id", F.col("family").alias("subject_group_id"), "assigned")


def _sampled(spark: SparkSession, d: str) -> DataFrame:
    """(split_group_id, u, first_load) of the chosen groups that the table holds, by the register of this table."""
    m = table(spark, d, "trial_manifest")
    register = sample.replay(m, "split_group_id", "load_no", "split_seed", sample.Register.of(spark, f"{d}/trial_manifest", "split_group_id"))
    here = sample.identifiers(m, "split_group_id", "load_no").select("id")
    return register.chosen().join(here, "id", "left_semi").select(F.col("id").alias("split_group_id"), "u", "first_load")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The 10 % sample of content groups, with each group's permanent number and first load."""
    return _sampled(spark, d)


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """The trial rows of the sampled groups."""
    m = table(spark, d, "trial_manifest").select("row_id", "record_id", "load_no", families.clean_id(F.col("split_group_id")).alias("split_group_id"))
    return spread_join(m, _sampled(spark, d).select("split_group_id"), ["split_group_id"], ["row_id"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """(record_id, unit_id): trial and workbook row that print alike but are not the same string."""
    return alike.alike(table(spark, d, "trial_manifest"), "record_id", "raw_text", table(spark, d, "material_units"), "unit_id", "normalized_text")


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every distinct text of trials and workbook rows."""
    trials = alike.forms(table(spark, d, "trial_manifest"), "row_id", "raw_text").select(F.lit("trial").alias("kind"), F.col("row_id").alias("id"), "text", "form")
    units = alike.forms(table(spark, d, "material_units"), "unit_id", "normalized_text").select(F.lit("unit").alias("kind"), F.col("unit_id").alias("id"), "text", "form")
    return trials.unionByName(units)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """window_id of the windows that had to be cut: those with a second piece."""
    found = cut.pieces(table(spark, d, "pl_windows"), table(spark, d, "marker_stream"))
    return found.where("piece = 1").select("window_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of the windows longer than their window_sec."""
    return cut.pieces(table(spark, d, "pl_windows"), table(spark, d, "marker_stream"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id): documents and the items that leaked into each."""
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """The leaks with the share of the item found and the number of passages."""
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen repeats of every document."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    return mixing.shares(mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets")), table(spark, d, "mix_targets"))


def p8_fit(spark: SparkSession, d: str) -> DataFrame:
    """Held-out quality of the soft membership and the end of the fit of the rates."""
    return mixing.fitted(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """doc_id of the documents written at level 5."""
    return reading.levels(table(spark, d, "documents"), table(spark, d, "labels")).where("level = 5").select("doc_id").distinct()


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Score, grade and level of every document."""
    return reading.levels(table(spark, d, "documents"), table(spark, d, "labels"))


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents per clean source, writing language and level, with the mean grade."""
    docs = table(spark, d, "documents")
    lang = F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang")
    known = docs.select("doc_id", mixing.clean_source(F.col("source")).alias("source"), lang).join(reading.levels(docs, table(spark, d, "labels")), "doc_id")
    return known.groupBy("source", "lang", "level").agg(F.count(F.lit(1)).alias("n_documents"), F.round(F.avg("grade"), 4).alias("mean_grade"))


QUERIES = {"p1_found": p1_found, "p1_overlaps": p1_overlaps, "p1_members": p1_members, "p1_report": p1_report, "p2_found": p2_found, "p2_torn": p2_torn, "p2_assign": p2_assign, "p2_subjects": p2_subjects, "p3_found": p3_found, "p3_forms": p3_forms, "p4_sample": p4_sample, "p4_rows": p4_rows, "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_fit": p8_fit, "p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile}

_FAMILY = """
WITH RECURSIVE l AS (SELECT lower(trim(left_group_id)) a, lower(trim(right_group_id)) b FROM group_links WHERE review_status = 'accepted'),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS v, a AS w FROM e UNION SELECT r.v, e.b FROM r JOIN e ON r.w = e.a),
c AS (SELECT v, min(w) AS family FROM r GROUP BY v),
t AS (SELECT coalesce(c.family, g) AS family, g, s, n FROM (SELECT lower(trim(split_group_id)) g, CASE WHEN lower(trim(split)) = 'validation' THEN 'valid' ELSE lower(trim(split)) END s, count(*) n FROM trial_manifest GROUP BY 1, 2) x LEFT JOIN c ON c.v = x.g)
"""
#: Whole families to splits, from ``w`` (family, weight): the heavy ones to what lacks most, the rest end to end in hash order.
_ASSIGN = """
total AS (SELECT coalesce(sum(weight), 0)::DOUBLE AS t FROM w),
heavy AS (SELECT family, weight, row_number() OVER (ORDER BY weight DESC, family) AS k FROM w, total WHERE weight > 0.005 * t),
step AS (SELECT 0::BIGINT AS k, ''::VARCHAR AS family, '' AS assigned, 0.8::DOUBLE * t AS a, 0.1::DOUBLE * t AS b, 0.1::DOUBLE * t AS c FROM total
  UNION ALL SELECT k, family, s, a - CASE WHEN s = 'train' THEN weight ELSE 0 END, b - CASE WHEN s = 'valid' THEN weight ELSE 0 END, c - CASE WHEN s = 'test' THEN weight ELSE 0 END
  FROM (SELECT h.k, h.family, h.weight, a, b, c, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'valid' ELSE 'test' END AS s FROM step JOIN heavy h ON h.k = step.k + 1)),
lack AS (SELECT greatest(a, 0) AS a, greatest(b, 0) AS b, greatest(c, 0) AS c FROM step ORDER BY k DESC LIMIT 1),
rest AS (SELECT family, sum(weight) OVER (ORDER BY u, family)::DOUBLE - weight / 2.0::DOUBLE AS mid FROM (SELECT family, weight, ('0x' || substr(sha256('42' || chr(0) || family), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u FROM w, total WHERE weight <= 0.005 * t)),
edge AS (SELECT a / (a + b + c) * n AS x, a / (a + b + c) * n + b / (a + b + c) * n AS y FROM lack, (SELECT t - coalesce((SELECT sum(weight) FROM heavy), 0)::DOUBLE AS n FROM total)),
chosen AS (SELECT family, assigned FROM step WHERE k > 0 UNION ALL SELECT family, CASE WHEN mid < x THEN 'train' WHEN mid < y THEN 'valid' ELSE 'test' END FROM rest, edge)
"""
SQL: dict[str, str] = {
    "p2_assign": _FAMILY + """,
m AS (SELECT row_id, record_id, nullif(lower(trim(split_group_id)), '') AS g FROM trial_manifest),
k AS (SELECT row_id, record_id, coalesce(family, g, 'row:' || row_id) AS family FROM m LEFT JOIN (SELECT v, family FROM c) c ON v = g),
w AS (SELECT family, count(*) AS weight FROM k GROUP BY 1),""" + _ASSIGN + "SELECT row_id, record_id, family AS family_id, assigned FROM k JOIN chosen USING (family)",
    "p2_subjects": """
WITH RECURSIVE d AS (SELECT window_id, coalesce(nullif(lower(trim(subject_group_id)), ''), 'window:' || window_id) AS family FROM pl_windows),
w AS (SELECT family, count(*) AS weight FROM d GROUP BY 1),""" + _ASSIGN + "SELECT DISTINCT window_id, family AS subject_group_id, assigned FROM d JOIN chosen USING (family)",
    "p2_found": _FAMILY + "SELECT family AS family_id FROM t GROUP BY family HAVING count(DISTINCT s) > 1",
    "p2_torn": _FAMILY + "SELECT family AS family_id, string_agg(DISTINCT s, '+' ORDER BY s) AS splits, count(DISTINCT g)::BIGINT AS n_groups, sum(n)::BIGINT AS n_rows FROM t GROUP BY family HAVING count(DISTINCT s) > 1",
    "p6_found": f"SELECT DISTINCT window_id FROM pl_windows WHERE eeg_stop_sample - eeg_start_sample > round_even(window_sec * {WINDOW_SCALE_SQL} * eeg_sampling_rate_hz, 0)",
    "p6_pieces": f"""
WITH RECURSIVE o AS (SELECT DISTINCT window_id, eeg_file, eeg_start_sample AS a, eeg_stop_sample AS z, round_even(window_sec * scale * eeg_sampling_rate_hz, 0)::BIGINT AS lim, round_even((window_sec - stride_sec) * scale * eeg_sampling_rate_hz, 0)::BIGINT AS over
  FROM (SELECT *, {WINDOW_SCALE_SQL} AS scale FROM pl_windows) WHERE eeg_stop_sample - eeg_start_sample > round_even(window_sec * scale * eeg_sampling_rate_hz, 0)),
w AS (SELECT window_id, eeg_file, a, z, lim, greatest(0, least(coalesce(over, 0), lim - 1)) AS over, (row_number() OVER (PARTITION BY window_id ORDER BY a, z, lim, over, eeg_file) - 1)::INTEGER AS variant FROM o WHERE lim > 0),
k AS (SELECT DISTINCT eeg_file, CASE WHEN trial_type IN ('ROWS', 'ROWE') THEN trial_type WHEN regexp_full_match(upper(trim(trial_type)), 'CH[ ]*[0-9]+') THEN 'CH' END AS kind, sample FROM marker_stream),
l AS (SELECT window_id, variant, list(sample) FILTER (kind = 'CH') AS c, list(sample) FILTER (kind = 'ROWS') AS s, list(sample) FILTER (kind = 'ROWE') AS e FROM w JOIN k USING (eeg_file) WHERE sample > a AND sample < z AND kind IS NOT NULL GROUP BY 1, 2),
m AS (SELECT w.*, list_filter(list_transform(coalesce(c, []), lambda x : list_min(list_filter(coalesce(s, []), lambda y : y >= x))), lambda x : x IS NOT NULL) AS c, coalesce(s, []) AS s, coalesce(e, []) AS e FROM w LEFT JOIN l USING (window_id, variant)),
r AS (SELECT *, -1 AS piece, 0::BIGINT AS start_sample, NULL::BIGINT AS stop_sample, '' AS cut FROM m
UNION ALL SELECT window_id, eeg_file, a, z, lim, over, variant, c, s, e, piece + 1, b, coalesce(x.at, CASE WHEN b + lim >= z THEN z ELSE b + lim END), CASE WHEN b + lim >= z THEN 'end' WHEN x.at IS NULL THEN 'sample' ELSE x.kind END
  FROM (SELECT *, CASE WHEN b + lim >= z THEN NULL WHEN p IS NOT NULL THEN {{'at': p, 'kind': 'chapter'}} WHEN q IS NOT NULL THEN {{'at': q, 'kind': 'ROWS'}} WHEN u IS NOT NULL THEN {{'at': u, 'kind': 'ROWE'}} END AS x
    FROM (SELECT *, list_max(list_filter(c, lambda v : v > b + over AND v <= b + lim)) AS p, list_max(list_filter(s, lambda v : v > b + over AND v <= b + lim)) AS q, list_max(list_filter(e, lambda v : v > b + over AND v <= b + lim)) AS u
      FROM (SELECT *, coalesce(stop_sample - over, a) AS b FROM r WHERE cut <> 'end'))))
SELECT window_id, variant, piece::INTEGER AS piece, start_sample, stop_sample, cut FROM r WHERE piece >= 0""",
    "p4_sample": """
WITH seed AS (SELECT split_seed FROM trial_manifest WHERE load_no = (SELECT min(load_no) FROM trial_manifest) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
g AS (SELECT lower(trim(split_group_id)) id, min(load_no)::INTEGER first_load FROM trial_manifest GROUP BY 1),
u AS (SELECT id, ('0x' || substr(sha256((SELECT split_seed FROM seed)::VARCHAR || chr(0) || id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u, first_load FROM g)
SELECT id AS split_group_id, u, first_load FROM u WHERE u < 0.1""",
    "p4_rows": """
WITH seed AS (SELECT split_seed FROM trial_manifest WHERE load_no = (SELECT min(load_no) FROM trial_manifest) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
g AS (SELECT lower(trim(split_group_id)) id, min(load_no)::INTEGER first_load FROM trial_manifest GROUP BY 1),
u AS (SELECT id, ('0x' || substr(sha256((SELECT split_seed FROM seed)::VARCHAR || chr(0) || id), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS u, first_load FROM g)
SELECT row_id, record_id, load_no, id AS split_group_id FROM trial_manifest JOIN u ON id = lower(trim(split_group_id)) WHERE u < 0.1""",
}
