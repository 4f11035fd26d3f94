"""Retrieval, scaling and series queries over embeddings, windows and trials."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.operators import retrieval as R
from cohortloom.operators import series as V
from cohortloom.operators.guards import delay_label
from cohortloom.operators.joins import null_safe_join, ordered_index
from cohortloom.store import table

# The baselines that a report must have.
REQUIRED = ("random", "duration_only", "character_count_only", "padding_mask_only", "sentence_position_only", "subject_id_only", "audio_envelope")
#: Baselines that score equality of a window's own value with the candidate's.
EXACT = {"duration_only": "window_sec", "padding_mask_only": "padded_eeg_samples", "character_count_only": "char_count", "subject_id_only": "speaker_id"}
MOST_QUERIES, MOST_TARGETS = 64, 32


def _e(s, d):
    return table(s, d, "embeddings")


def _queries(s, d):
    """Even ids are queries, whose positive is the next odd id; odd ids are candidates."""
    e = _e(s, d).where("embedding IS NOT NULL")
    q = e.where("vec_id % 2 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), (F.col("vec_id") + 1).alias("positive"), "label")
    return q, e.where("vec_id % 2 = 1").select(F.col("vec_id").alias("candidate_id"), F.col("embedding").alias("vector"))


def _ranked(s, d, kind="y"):
    q, c = _queries(s, d)
    return R.ranks(R.rank_parts(q.drop("label"), c, kind)).join(q.select("query_id", "label"), "query_id")


def similarity_norms(s, d):
    e = _e(s, d)
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", *[F.round(R.similarity(F.col("a"), F.col("b"), k), 6).alias(f"s_{k}") for k in ("none", "x", "y", "xy")])


def rank_policies(s, d):
    return _ranked(s, d).select("query_id", "pessimistic", "optimistic")


def query_ranks(s, d):
    return _ranked(s, d).select("query_id", "label", F.col("pessimistic").alias("rank"), "n")


def retrieval_global(s, d):
    return R.metrics(_ranked(s, d), "pessimistic")


def metrics_by_group(s, d):
    return R.metrics(_ranked(s, d), "pessimistic", ["label"])


def metrics_macro(s, d):
    return R.macro(R.metrics(_ranked(s, d), "pessimistic", ["label"]), ["r_at_1", "r_at_5", "r_at_10", "median_rank", "mrr"])


def chance_metrics(s, d):
    return s.range(1, 501).select(F.col("id").alias("n"), *[F.round(c, 9).alias(n) for c, n in zip(R.chance(F.col("id")), ("r_at_1", "r_at_5", "r_at_10", "median_rank", "mrr"))])


def retrieval_position_local(s, d):
    """Rank among the positive and its nearest negatives by position, at whatever distance: a band of ranks of position.

    Candidates are numbered in order within cells whose sizes are summed first; the nearest 20 are among the 20 before
    and the 20 behind the query.
    """
    q, c = _queries(s, d)
    pool = 20
    a = q.select(F.col("query_id").alias("id"), "positive", "vector", F.lit(0).alias("k"))
    both = a.unionByName(c.select(F.col("candidate_id").alias("id"), F.lit(None).cast("long").alias("positive"), "vector", F.lit(1).alias("k"))).withColumn("b", F.floor(F.col("id") / R.BLOCK))
    n = both.groupBy("b").agg(F.sum("k").alias("n"))
    base = n.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("base"))  # one row a cell
    order = Window.partitionBy("b").orderBy("id", "k").rowsBetween(Window.unboundedPreceding, 0)
    both = both.join(base, "b").withColumn("at", (F.col("base") + F.sum("k").over(order)).cast("double"))
    a = both.where("k = 0").select(F.col("id").alias("query_id"), "positive", F.col("vector").alias("qv"), (F.col("at") + 0.5).alias("pos"))
    b = both.where("k = 1").select(F.col("id").alias("candidate_id"), F.col("vector").alias("cv"), F.col("at").alias("c_pos"))
    near = R.interval_pairs(a, b, "pos", float(pool), float(pool)).withColumn("gap", F.abs(F.col("query_id") - F.col("candidate_id")))
    own = F.col("candidate_id") == F.col("positive")
    w = Window.partitionBy("query_id").orderBy(F.when(own, 0).otherwise(1), "gap", "candidate_id")
    x = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= pool).withColumn("s", F.round(R.similarity(F.col("qv"), F.col("cv"), "y"), 9))
    p = F.max(F.when(own, F.col("s"))).over(Window.partitionBy("query_id"))
    return x.withColumn("p", p).groupBy("query_id").agg(F.count(F.lit(1)).alias("pool"), F.count_if(F.col("s") >= F.col("p")).alias("rank"))


def length_matched_pool(s, d):
    """Targets within one character and half a second of each query target: sizes of the pools.

    A target without a duration, on either side, matches at any duration.
    """
    t = table(s, d, "pl_windows").where("char_count IS NOT NULL").groupBy("split_group_id").agg(F.min("char_count").cast("double").alias("chars"), F.min("source_trial_eeg_duration_sec").alias("sec"))
    # records with equal lengths meet as one: pools are counted per distinct (characters, duration)
    c = t.groupBy("chars", "sec").agg(F.count(F.lit(1)).alias("k"))
    near = F.coalesce(F.abs(F.col("sec") - F.col("c_sec")) <= 0.5, F.lit(True))
    pairs = R.interval_pairs(c.select("chars", "sec"), c.select(F.col("chars").alias("c_chars"), F.col("sec").alias("c_sec"), "k"), "chars", 1.0, 1.0).where(near)
    sizes = pairs.groupBy(F.col("chars").alias("q_chars"), F.col("sec").alias("q_sec")).agg(F.sum("k").alias("pool"))
    return t.join(sizes, (F.col("chars") == F.col("q_chars")) & F.col("sec").eqNullSafe(F.col("q_sec"))).select("split_group_id", "pool", (F.col("pool") >= 20).alias("enough"))


def contrastive_loss(s, d, block=R.BLOCK):
    """Mean of -log softmax of each query's positive among all candidates, scores of x normed by y over temperature 0.07.

    A query whose positive is missing counts in ``n`` but not in the mean.
    """
    q, c = _queries(s, d)
    own = q.join(c.select(F.col("candidate_id").alias("positive"), F.col("vector").alias("cv")), "positive", "left").select("query_id", (R.similarity(F.col("vector"), F.col("cv"), "y") / 0.07).alias("own"))
    g = R.log_sum_exp(q, c, "y", 0.07, block).join(own, "query_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("lse") - F.col("own")), 6).alias("loss"))


def shortcut_random(s, d):
    """Ranks under pseudo-random scores: the hash fraction of seed and pair, candidates counted per query."""
    q, c = _queries(s, d)
    key = lambda x: F.substring(F.sha2(F.concat(F.lit("42\0"), F.col("query_id").cast("string"), F.lit("\0"), x.cast("string")).cast("binary"), 256), 1, 12)
    blocks = R.block_count(c)
    held = c.groupBy(F.pmod(F.xxhash64("candidate_id"), F.lit(blocks)).alias("cb")).agg(F.collect_list("candidate_id").alias("ids"))  # a block of bounded size
    x = q.select("query_id", "positive").withColumn("own", key(F.col("positive"))).withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    n = x.join(held, "cb").select("query_id", F.size(F.filter("ids", lambda i: key(i) >= F.col("own"))).cast("long").alias("n"))
    return n.groupBy("query_id").agg(F.sum("n").alias("rank"))


def shortcut_correlation(s, d):
    return R.metrics(_ranked(s, d, "xy"), "pessimistic")


def shortcut_exact(s, d):
    """Metadata equality as a score: a positive ties with all of its value, so the pessimistic rank is that value's count."""
    t = table(s, d, "pl_windows").select("audio_target_id", "stimulus_position", "speaker_id").distinct()
    n = t.groupBy("stimulus_position").agg(F.countDistinct("audio_target_id").alias("rank"))
    return R.metrics(t.join(n, t["stimulus_position"].eqNullSafe(n["stimulus_position"])).select("rank"), "rank")


def shortcut_membership(s, d):
    """Membership of a query's position in a target's set of positions: targets that hold it, per query window."""
    w = table(s, d, "pl_windows").select("window_id", "split_group_id", "stimulus_position").distinct()
    sets = w.select("split_group_id", "stimulus_position").distinct().groupBy("stimulus_position").agg(F.count(F.lit(1)).alias("rank"))
    return R.metrics(w.join(sets, "stimulus_position"), "rank")


def _first_windows(s, d):
    """(windows, candidates) of the test split: every window, and of every target its first window."""
    w = table(s, d, "pl_windows").where("lower(trim(split)) = 'test' AND audio_target_id IS NOT NULL AND window_id IS NOT NULL")
    w = w.select("window_id", "audio_target_id", "stimulus_position", *EXACT.values()).distinct()
    return w, w.groupBy("audio_target_id").agg(*[F.min_by(c, "window_id").alias(c) for c in EXACT.values()])


def shortcut_report(s, d):
    """Global metrics of the baselines that see nothing but a window's metadata, with ties ranked last.

    A candidate whose value equals the window's (or whose positions hold the window's) scores 1, else 0. So where the window's
    own target scores 1 its rank is how many do, and where it scores 0 how many candidates there are: no pair is formed.
    """
    w, c = _first_windows(s, d)
    n = F.broadcast(c.agg(F.count(F.lit(1)).alias("n")))  # one row
    text = lambda x: F.col(x).cast("string")
    queries = w.select("window_id", "audio_target_id", F.explode(F.array(*[F.struct(F.lit(k).alias("baseline"), text(v).alias("v")) for k, v in EXACT.items()])).alias("x")).select("window_id", "audio_target_id", "x.*")
    values = c.select("audio_target_id", F.explode(F.array(*[F.struct(F.lit(k).alias("baseline"), text(v).alias("c")) for k, v in EXACT.items()])).alias("x")).select("audio_target_id", "x.*")
    level = values.groupBy("baseline", F.col("c").alias("v")).agg(F.count(F.lit(1)).alias("k"))
    own = queries.join(values, ["audio_target_id", "baseline"])
    exact = null_safe_join(own, level, ["baseline", "v"], "left").join(n).select("baseline", F.when(F.col("v").eqNullSafe(F.col("c")), F.col("k")).otherwise(F.col("n")).alias("rank"))
    sets = w.select("audio_target_id", "stimulus_position").distinct().groupBy("stimulus_position").agg(F.count(F.lit(1)).alias("rank"))
    member = null_safe_join(w.select("window_id", "stimulus_position"), sets, ["stimulus_position"]).select(F.lit("sentence_position_only").alias("baseline"), "rank")
    return R.metrics(exact.unionByName(member), "rank", ["baseline"])


def required_baselines(s, d):
    """Baselines that a report must have but that neither shortcut_report nor the queries of random scores and envelopes give."""
    have = shortcut_report(s, d).select("baseline").unionByName(s.createDataFrame([("random",), ("audio_envelope",)], "baseline string"))
    return R.required_missing(have.withColumnRenamed("baseline", "name"), REQUIRED)


def limited_queries(s, d):
    """The first queries and the first targets in order of their ids, as a run with limits takes them."""
    w = table(s, d, "pl_windows").where("window_id IS NOT NULL AND audio_target_id IS NOT NULL")
    q = w.select(F.lit("query").alias("kind"), F.col("window_id").alias("id")).distinct().orderBy("id").limit(MOST_QUERIES)
    return q.unionByName(w.select(F.lit("target").alias("kind"), F.col("audio_target_id").alias("id")).distinct().orderBy("id").limit(MOST_TARGETS))


def argmin_select(s, d):
    """The delay with the least mean gap per session, earlier delay first among equals."""
    w = table(s, d, "pl_windows").groupBy("session_id", "eeg_delay_ms").agg(F.round(F.avg(F.abs(F.col("audio_stop_sec") - F.col("audio_start_sec") - 3)), 9).alias("loss"))
    b = w.groupBy("session_id").agg(F.min(F.struct("loss", "eeg_delay_ms")).alias("b"))
    return b.select("session_id", "b.loss", "b.eeg_delay_ms")


def entity_index(s, d):
    """Every entity with its number from 0 in order."""
    return ordered_index(table(s, d, "pl_windows"), "subject_group_id").select("subject_group_id", F.col("i").cast("int").alias("i"))


def unique_target_batches(s, d):
    """Batches without a repeated target: the r-th window of every target is of round r, rounds are cut by hash order."""
    w = table(s, d, "pl_windows").select("window_id", "audio_target_id").distinct()
    h = lambda c: F.sha2(F.concat(F.lit("42\0"), F.col(c)).cast("binary"), 256)
    r = w.withColumn("round", F.row_number().over(Window.partitionBy("audio_target_id").orderBy(h("window_id"))) - 1)
    # order within a round: hash buckets whose sizes are summed first, then ranks within each bucket
    r = r.withColumn("h", h("window_id")).withColumn("b", F.substring("h", 1, 2))
    n = r.groupBy("round", "b").agg(F.count(F.lit(1)).alias("k"))
    base = n.select("round", "b", (F.sum("k").over(Window.partitionBy("round").orderBy("b")) - F.col("k")).alias("base"))
    x = r.join(base, ["round", "b"]).withColumn("i", F.col("base") + F.row_number().over(Window.partitionBy("round", "b").orderBy("h")) - 1)
    return x.select("window_id", F.col("round").cast("int").alias("round"), F.floor(F.col("i") / 32).alias("batch"))


def robust_fit(s, d):
    return V.robust_fit(_train(s, d), ["eeg_file"], "eeg_duration_sec").withColumns({c: F.round(c, 9) for c in ("center", "scale")})


def _train(s, d):
    return table(s, d, "trial_manifest").where((F.lower(F.trim("split")) == "train") & (F.abs("eeg_duration_sec") <= 1e300))


def robust_scale(s, d):
    t = table(s, d, "trial_manifest").where(F.abs("eeg_duration_sec") <= 1e300)
    return V.robust_scale(t, V.robust_fit(_train(s, d), ["eeg_file"], "eeg_duration_sec"), ["eeg_file"], "eeg_duration_sec").select("row_id", F.round("scaled", 6).alias("scaled"))


def _standard(s, d):
    w = table(s, d, "pl_windows").where(F.lower(F.trim("split")) == "train").groupBy("audio_target_id").agg(F.count(F.lit(1)).alias("w"), F.min("source_trial_eeg_duration_sec").alias("x"))
    return V.standard_fit(w, "x", "w")


def standard_fit(s, d):
    return _standard(s, d).select(F.col("n").cast("long").alias("n"), F.round("center", 6).alias("center"), F.round("scale", 6).alias("scale"))


def standard_scale(s, d):
    f = _standard(s, d)
    w = table(s, d, "pl_windows").select("window_id", "source_trial_eeg_duration_sec").distinct()
    return w.join(F.broadcast(f)).select("window_id", F.round((F.col("source_trial_eeg_duration_sec") - F.col("center")) / F.col("scale"), 6).alias("scaled"))


def zscore(s, d):
    z = _e(s, d).select("vec_id", V.zscore(F.col("embedding")).alias("z"))
    return z.select("vec_id", F.round(F.element_at("z", 1), 5).alias("first"), F.round(F.element_at("z", 64), 5).alias("last"), F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x), 5).alias("power"))


def crop_align(s, d):
    q, t = V.crop_query(F.col("embedding"), 4), V.crop_target(F.col("embedding"), 4)
    return _e(s, d).select("vec_id", F.size(q).alias("n_query"), F.size(t).alias("n_target"), F.round(R.dot(q, t), 5).alias("lag_product"))


def conv_geometry(s, d):
    return s.range(1).select(*V.geometry([10, 3, 3, 3, 3, 2, 2], [5, 2, 2, 2, 2, 2, 2]))


def _frames(s, d):
    w = table(s, d, "pl_windows").select("window_id", "audio_start_sec", "audio_stop_sec").distinct().where("audio_stop_sec > audio_start_sec")
    n = F.greatest(F.lit(1), F.floor((F.col("audio_stop_sec") - F.col("audio_start_sec") - 0.025) / 0.5).cast("int") + 1)
    return w.select("window_id", F.posexplode(V.frame_offsets(F.col("audio_start_sec"), F.col("audio_stop_sec"), n, F.lit(16000.0), 8000, 400)).alias("frame", "f")).select("window_id", "frame", "f.*")


def frame_offsets(s, d):
    return _frames(s, d).withColumns({c: F.round(c, 6) for c in ("start_sec", "stop_sec")})


def overlap_pool(s, d):
    """Mean, in two dimensions, of the frames that overlap the second second of each window; windows without one are left out."""
    w = table(s, d, "pl_windows").where("audio_start_sec IS NOT NULL").groupBy("window_id").agg(F.min("audio_start_sec").alias("o"))
    spans = w.select("window_id", F.lit(0).alias("span"), (F.col("o") + 1).alias("a"), (F.col("o") + 2).alias("z"))
    frames = _frames(s, d).select("window_id", F.col("start_sec").alias("start"), F.col("stop_sec").alias("stop"), F.array((F.col("start_sec") + F.col("stop_sec")) / 2, F.col("frame").cast("double")).alias("vector"))
    x = V.overlap_mean(spans, frames, "window_id", 4.0)
    return x.select("window_id", "n", *[F.round(F.element_at("vector", i + 1), 6).alias(k) for i, k in enumerate(("middle", "frame"))])


def token_pool(s, d):
    """First, attended and content means over the tokens of each vector, the first and last as special tokens."""
    t = _e(s, d).select("vec_id", F.posexplode("embedding").alias("p", "v"))
    v = F.col("v").cast("double")
    return t.groupBy("vec_id").agg(F.round(F.max(F.when(F.col("p") == 0, v)), 5).alias("first"), F.round(F.avg(v), 5).alias("attended"), F.round(F.avg(F.when((F.col("p") > 0) & (F.col("p") < 63), v)), 5).alias("content"))


def char_token_overlap(s, d):
    """State of every character of the workbook rows: the mean of the tokens that overlap it, tokens of three characters at every second one, with their place and lit length as their vector."""
    from cohortloom.functions.text import lit_count

    u = table(s, d, "material_units").where("normalized_text <> ''").select("unit_id", "normalized_text", F.length("normalized_text").alias("n"))
    last = F.floor((F.col("n") - 1) / 2).cast("int")
    t = u.select("unit_id", "normalized_text", "n", F.explode(F.sequence(F.lit(0), last)).alias("k"))
    frames = t.select("unit_id", (F.col("k") * 2).alias("start"), F.least(F.col("k") * 2 + 3, "n").alias("stop"), F.array(F.col("k").cast("double"), lit_count(F.substr("normalized_text", F.col("k") * 2 + 1, F.lit(3))).cast("double")).alias("vector"))
    spans = u.select("unit_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("span")).select("unit_id", "span", F.col("span").alias("a"), (F.col("span") + 1).alias("z"))
    x = V.overlap_mean(spans, frames, "unit_id", 64.0)
    return x.select("unit_id", F.col("span").alias("position"), "n", *[F.round(F.element_at("vector", i + 1), 6).alias(k) for i, k in enumerate(("token", "lit"))])


def field_power(s, d):
    """Per label, the root mean square over vectors of z-scored values at each position."""
    z = _e(s, d).select("label", F.posexplode(V.zscore(F.col("embedding"))).alias("t", "z"))
    return z.groupBy("label", "t").agg(F.round(F.sqrt(F.avg(F.col("z") * F.col("z"))), 5).alias("power"))


def interp_series(s, d):
    """Ten points of every vector by centres, by end points, and the latter standardized."""
    a = F.transform("embedding", lambda x: x.cast("double"))
    three = F.arrays_zip(V.interpolate(a, 10).alias("centred"), V.interpolate(a, 10, True).alias("cornered"), V.standardize(V.interpolate(a, 10, True)).alias("scaled"))
    x = _e(s, d).where("embedding IS NOT NULL").select("vec_id", F.posexplode(three).alias("point", "x"))
    return x.select("vec_id", "point", *[F.round(F.col("x")[c], 5).alias(c) for c in ("centred", "cornered", "scaled")])


def envelope(s, d):
    x = _e(s, d).where("embedding IS NOT NULL").select("vec_id", F.posexplode(V.envelope(F.col("embedding"), 5)).alias("point", "v"))
    return x.select("vec_id", "point", F.round("v", 5).alias("envelope"))


def pooled_scores(s, d):
    """Centred and pooled vectors scaled by 1 / 0.07: each vector is taken as four channels of sixteen steps, and scored against the next one."""
    four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("c", k * 16 + 1, F.lit(16)))
    x = _e(s, d).where("embedding IS NOT NULL").select("vec_id", V.centred(F.col("embedding")).alias("c")).select("vec_id", V.time_pool(four).alias("p"))
    y = x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    return x.join(y, "vec_id").select("vec_id", F.round(R.dot(F.col("p"), F.col("q")) / 0.07, 5).alias("score"))


def layer_means(s, d):
    """Mean of the first and the last of four layers of every vector, per unit."""
    four = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.transform(F.slice("embedding", k * 16 + 1, F.lit(16)), lambda v: v.cast("double")))
    x = _e(s, d).where("embedding IS NOT NULL").select("vec_id", F.posexplode(V.layer_mean(four, [0, -1])).alias("unit", "v"))
    return x.select("vec_id", "unit", F.round("v", 6).alias("mean"))


def delay_labels(s, d):
    """Windows per label of their delay."""
    return table(s, d, "pl_windows").groupBy(delay_label(F.col("eeg_delay_ms")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))"
_Q = """v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings WHERE embedding IS NOT NULL), n AS (SELECT *, greatest(sqrt(list_dot_product(e, e)), 1e-8) AS w FROM v),
q AS (SELECT vec_id AS query_id, vec_id + 1 AS positive, e AS qe, w AS qw, label FROM n WHERE vec_id % 2 = 0), c AS (SELECT vec_id AS candidate_id, e AS ce, w AS cw FROM n WHERE vec_id % 2 = 1)"""
_RANK = _Q + """, s AS (SELECT query_id, positive, label, candidate_id, round(list_dot_product(qe, ce) / cw{x}, 9) AS s FROM q, c), p AS (SELECT query_id, s AS p FROM s WHERE candidate_id = positive),
k AS (SELECT query_id, label, count(*) FILTER (s >= p) AS pessimistic, 1 + count(*) FILTER (s > p) AS optimistic, count(*) AS n FROM s JOIN p USING (query_id) GROUP BY 1, 2)"""
_Y, _XY = _RANK.format(x=""), _RANK.format(x=" / qw")
_M = "count({r}) AS n, round(avg(({r} <= 1)::INT), 9) AS r_at_1, round(avg(({r} <= 5)::INT), 9) AS r_at_5, round(avg(({r} <= 10)::INT), 9) AS r_at_10, round(quantile_cont({r}, 0.5), 9) AS median_rank, round(avg(1.0::DOUBLE / {r}), 9) AS mrr"
_MP, _MR = _M.format(r="pessimistic"), _M.format(r="rank")
_TRAIN = "t AS (SELECT * FROM trial_manifest WHERE lower(trim(split)) = 'train' AND isfinite(eeg_duration_sec)), l AS (SELECT eeg_file, list_sort(list(eeg_duration_sec)) AS x, count(*) AS n FROM t GROUP BY 1), f AS (SELECT eeg_file, n, x[floor(n * 0.5::DOUBLE)::INT + 1] AS center, CASE WHEN x[floor(n * 0.75::DOUBLE)::INT + 1] = x[floor(n * 0.25::DOUBLE)::INT + 1] THEN 1.0::DOUBLE ELSE x[floor(n * 0.75::DOUBLE)::INT + 1] - x[floor(n * 0.25::DOUBLE)::INT + 1] END AS scale FROM l)"
_STD = "w AS (SELECT audio_target_id, count(*) AS w, min(source_trial_eeg_duration_sec) AS x FROM pl_windows WHERE lower(trim(split)) = 'train' GROUP BY 1), s AS (SELECT sum(w)::DOUBLE AS n, sum(w * x) AS s, sum(w * x * x) AS ss FROM w WHERE x IS NOT NULL), f AS (SELECT n, s / n AS center, sqrt(greatest(0, (ss - s * s / n) / (n - 1))) AS scale FROM s)"
_FR = "w AS (SELECT DISTINCT window_id, audio_start_sec AS a, audio_stop_sec AS z FROM pl_windows WHERE audio_stop_sec > audio_start_sec), g AS (SELECT *, unnest(range(greatest(1, floor((z - a - 0.025::DOUBLE) / 0.5::DOUBLE)::INT + 1))) AS frame FROM w), fr AS (SELECT window_id, a, frame::INTEGER AS frame, a + frame * 8000 / 16000.0::DOUBLE AS start_sec, least(z, a + (frame * 8000 + 400) / 16000.0::DOUBLE) AS stop_sec FROM g)"
_Z = "v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), m AS (SELECT *, list_avg(e) AS mu FROM v), sd AS (SELECT *, sqrt(list_avg(list_transform(e, lambda x: (x - mu) * (x - mu)))) AS sd FROM m), z AS (SELECT vec_id, label, list_transform(e, lambda x: (x - mu) / greatest(sd, 1e-8)) AS z FROM sd)"
SQL = {
    "similarity_norms": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, greatest(sqrt(list_dot_product(e, e)), 1e-8) AS w FROM v), s AS (SELECT a.vec_id, list_dot_product(a.e, b.e) AS s, a.w AS x, b.w AS y FROM n a JOIN n b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(s, 6) AS s_none, round(s / x, 6) AS s_x, round(s / y, 6) AS s_y, round(s / x / y, 6) AS s_xy FROM s",
    "rank_policies": f"WITH {_Y} SELECT query_id, pessimistic, optimistic FROM k",
    "query_ranks": f"WITH {_Y} SELECT query_id, label, pessimistic AS rank, n FROM k",
    "retrieval_global": f"WITH {_Y} SELECT {_MP} FROM k",
    "metrics_by_group": f"WITH {_Y} SELECT label, {_MP.replace('AS n,', 'AS n,')} FROM k GROUP BY 1",
    "metrics_macro": f"WITH {_Y}, m AS (SELECT label, {_MP} FROM k GROUP BY 1) SELECT count(*) AS groups, " + ", ".join(f"round(avg({c}), 9) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 9) AS {c}_std" for c in ("r_at_1", "r_at_5", "r_at_10", "median_rank", "mrr")) + " FROM m",
    "chance_metrics": "WITH n AS (SELECT range AS n FROM range(1, 501)) SELECT n, round(1.0::DOUBLE / n, 9) AS r_at_1, round(least(5, n) / n, 9) AS r_at_5, round(least(10, n) / n, 9) AS r_at_10, round((n + 1) / 2, 9) AS median_rank, round(list_sum(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / i)) / n, 9) AS mrr FROM n",
    "retrieval_position_local": f"WITH {_Q}, r AS (SELECT query_id, positive, candidate_id, round(list_dot_product(qe, ce) / cw, 9) AS s, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN candidate_id = positive THEN 0 ELSE 1 END, abs(query_id - candidate_id), candidate_id) AS k FROM q, c), o AS (SELECT *, max(CASE WHEN candidate_id = positive THEN s END) OVER (PARTITION BY query_id) AS p FROM r WHERE k <= 20) SELECT query_id, count(*) AS pool, count(*) FILTER (s >= p) AS rank FROM o GROUP BY 1",
    "length_matched_pool": "WITH t AS (SELECT split_group_id, min(char_count) AS chars, min(source_trial_eeg_duration_sec) AS sec FROM pl_windows WHERE char_count IS NOT NULL GROUP BY 1) SELECT a.split_group_id, count(*) AS pool, count(*) >= 20 AS enough FROM t a JOIN t b ON abs(a.chars - b.chars) <= 1 AND coalesce(abs(a.sec - b.sec) <= 0.5, true) GROUP BY 1",
    "contrastive_loss": f"WITH {_Q}, s AS (SELECT query_id, positive, candidate_id, list_dot_product(qe, ce) / cw / 0.07::DOUBLE AS s FROM q, c), m AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS m FROM s), g AS (SELECT query_id, max(m) + ln(sum(exp(s - m))) AS lse, max(CASE WHEN candidate_id = positive THEN s END) AS own FROM m GROUP BY 1) SELECT count(*) AS n, round(avg(lse - own), 6) AS loss FROM g",
    "shortcut_random": f"WITH {_Q}, h AS (SELECT query_id, positive, candidate_id, substr(sha256('42' || chr(0) || query_id || chr(0) || candidate_id), 1, 12) AS h FROM q, c), p AS (SELECT query_id, h AS p FROM h WHERE candidate_id = positive) SELECT query_id, count(*) FILTER (h >= p) AS rank FROM h JOIN p USING (query_id) GROUP BY 1",
    "shortcut_correlation": f"WITH {_XY} SELECT {_MP} FROM k",
    "shortcut_exact": f"WITH t AS (SELECT DISTINCT audio_target_id, stimulus_position, speaker_id FROM pl_windows), n AS (SELECT stimulus_position, count(DISTINCT audio_target_id) AS rank FROM t GROUP BY 1) SELECT {_MR} FROM t JOIN n ON t.stimulus_position IS NOT DISTINCT FROM n.stimulus_position",
    "shortcut_membership": f"WITH w AS (SELECT DISTINCT window_id, split_group_id, stimulus_position FROM pl_windows), n AS (SELECT stimulus_position, count(DISTINCT split_group_id) AS rank FROM w GROUP BY 1) SELECT {_MR} FROM w JOIN n USING (stimulus_position)",
    "required_baselines": "SELECT unnest([" + ", ".join(f"'{x}'" for x in REQUIRED) + "]) AS name EXCEPT SELECT unnest([" + ", ".join(f"'{x}'" for x in (*EXACT, "sentence_position_only", "random", "audio_envelope")) + "])",
    "shortcut_report": "WITH w AS (SELECT DISTINCT window_id, audio_target_id, stimulus_position, window_sec, padded_eeg_samples, char_count, speaker_id FROM pl_windows WHERE lower(trim(split)) = 'test' AND audio_target_id IS NOT NULL AND window_id IS NOT NULL), "
    "c AS (SELECT audio_target_id, " + ", ".join(f"arg_min_null({v}, window_id) AS {v}" for v in EXACT.values()) + " FROM w GROUP BY 1), n AS (SELECT count(*) AS n FROM c), r AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS baseline, CASE WHEN w.{v} IS NOT DISTINCT FROM c.{v} THEN (SELECT count(*) FROM c z WHERE z.{v} IS NOT DISTINCT FROM w.{v}) ELSE n END AS rank FROM w JOIN c USING (audio_target_id), n" for k, v in EXACT.items())
    + " UNION ALL SELECT 'sentence_position_only', (SELECT count(DISTINCT audio_target_id) FROM w z WHERE z.stimulus_position IS NOT DISTINCT FROM w.stimulus_position) FROM w) SELECT baseline, " + _MR + " FROM r GROUP BY 1",
    "limited_queries": f"(SELECT DISTINCT 'query' AS kind, window_id AS id FROM pl_windows WHERE window_id IS NOT NULL AND audio_target_id IS NOT NULL ORDER BY id LIMIT {MOST_QUERIES}) UNION ALL (SELECT DISTINCT 'target' AS kind, audio_target_id AS id FROM pl_windows WHERE window_id IS NOT NULL AND audio_target_id IS NOT NULL ORDER BY id LIMIT {MOST_TARGETS})",
    "delay_labels": "SELECT CASE WHEN floor(eeg_delay_ms) = eeg_delay_ms THEN lpad(eeg_delay_ms::BIGINT::VARCHAR, 3, '0') ELSE replace(eeg_delay_ms::VARCHAR, '.', '_') END || 'ms' AS label, count(*) AS n FROM pl_windows GROUP BY 1",
    "layer_means": "WITH x AS (SELECT vec_id, unnest(range(16))::INTEGER AS unit, embedding AS e FROM embeddings WHERE embedding IS NOT NULL) SELECT vec_id, unit, round((e[unit + 1]::DOUBLE + e[unit + 49]::DOUBLE) / 2, 6) AS mean FROM x",
    "pooled_scores": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT vec_id, e, list_sum(e) / len(e) AS m FROM v), p AS (SELECT vec_id, list_transform(range(4), lambda k : list_sum(list_transform(e[k * 16 + 1 : k * 16 + 16], lambda x : x - m)) / 16) AS p FROM c) SELECT a.vec_id, round(list_dot_product(a.p, b.p) / 0.07::DOUBLE, 5) AS score FROM p a JOIN p b ON b.vec_id = a.vec_id + 1",
    "interp_series": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : x::DOUBLE) AS e, len(embedding) AS n FROM embeddings WHERE embedding IS NOT NULL), x AS (SELECT vec_id, e, n, unnest(range(10))::INTEGER AS point FROM v), "
    "y AS (SELECT *, greatest(0.0::DOUBLE, (point + 0.5::DOUBLE) * n / 10.0::DOUBLE - 0.5::DOUBLE) AS p, point * (n - 1) / 9.0::DOUBLE AS q FROM x), "
    "z AS (SELECT vec_id, point, e[least(floor(p)::INT, n - 1) + 1] * (1 - (p - least(floor(p)::INT, n - 1))) + e[least(least(floor(p)::INT, n - 1) + 1, n - 1) + 1] * (p - least(floor(p)::INT, n - 1)) AS a, "
    "e[least(floor(q)::INT, n - 1) + 1] * (1 - (q - least(floor(q)::INT, n - 1))) + e[least(least(floor(q)::INT, n - 1) + 1, n - 1) + 1] * (q - least(floor(q)::INT, n - 1)) AS b FROM y) "
    "SELECT vec_id, point, round(a, 5) AS centred, round(b, 5) AS cornered, round(CASE WHEN stddev_pop(b) OVER w > 1e-8 THEN (b - avg(b) OVER w) / stddev_pop(b) OVER w ELSE b - avg(b) OVER w END, 5) AS scaled FROM z WINDOW w AS (PARTITION BY vec_id)",
    "envelope": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x : x::DOUBLE) AS e, len(embedding)::INTEGER AS n FROM embeddings WHERE embedding IS NOT NULL), x AS (SELECT vec_id, e, n, unnest(range(n))::INTEGER AS point FROM v) SELECT vec_id, point, round(sqrt(list_sum(list_transform(e[greatest(1, point - 1) : least(n, point + 3)], lambda x : x * x)) / 5), 5) AS envelope FROM x",
    "argmin_select": "WITH w AS (SELECT session_id, eeg_delay_ms, round(avg(abs(audio_stop_sec - audio_start_sec - 3)), 9) AS loss FROM pl_windows GROUP BY 1, 2) SELECT session_id, loss, eeg_delay_ms FROM w QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY loss, eeg_delay_ms) = 1",
    "entity_index": "SELECT subject_group_id, (row_number() OVER (ORDER BY subject_group_id) - 1)::INTEGER AS i FROM (SELECT DISTINCT subject_group_id FROM pl_windows)",
    "unique_target_batches": "WITH w AS (SELECT DISTINCT window_id, audio_target_id, sha256('42' || chr(0) || window_id) AS h FROM pl_windows), r AS (SELECT *, row_number() OVER (PARTITION BY audio_target_id ORDER BY h) - 1 AS round FROM w) SELECT window_id, round::INTEGER AS round, (row_number() OVER (PARTITION BY round ORDER BY h) - 1) // 32 AS batch FROM r",
    "robust_fit": f"WITH {_TRAIN} SELECT eeg_file, n, round(center, 9) AS center, round(scale, 9) AS scale FROM f",
    "robust_scale": f"WITH {_TRAIN} SELECT row_id, round(greatest(-20, least(20, CASE WHEN center IS NOT NULL THEN (eeg_duration_sec - center) / scale END)), 6) AS scaled FROM trial_manifest LEFT JOIN f USING (eeg_file) WHERE isfinite(eeg_duration_sec) AND center IS NOT NULL UNION ALL SELECT row_id, NULL FROM trial_manifest LEFT JOIN f USING (eeg_file) WHERE isfinite(eeg_duration_sec) AND center IS NULL",
    "standard_fit": f"WITH {_STD} SELECT n::BIGINT AS n, round(center, 6) AS center, round(scale, 6) AS scale FROM f",
    "standard_scale": f"WITH {_STD} SELECT DISTINCT window_id, round((source_trial_eeg_duration_sec - center) / scale, 6) AS scaled FROM pl_windows, f",
    "zscore": f"WITH {_Z} SELECT vec_id, round(z[1], 5) AS first, round(z[64], 5) AS last, round(list_sum(list_transform(z, lambda x: x * x)), 5) AS power FROM z",
    "crop_align": f"WITH v AS (SELECT vec_id, embedding[5:64] AS a, embedding[1:60] AS b FROM embeddings) SELECT vec_id, len(a)::INTEGER AS n_query, len(b)::INTEGER AS n_target, round({_DOT.format(a='a', b='b')}, 5) AS lag_product FROM v",
    "conv_geometry": "SELECT 320::BIGINT AS stride, 400::BIGINT AS field",
    "frame_offsets": f"WITH {_FR} SELECT window_id, frame, round(start_sec, 6) AS start_sec, round(stop_sec, 6) AS stop_sec FROM fr",
    "overlap_pool": f"WITH {_FR}, o AS (SELECT window_id, min(audio_start_sec) AS o FROM pl_windows WHERE audio_start_sec IS NOT NULL GROUP BY 1) SELECT window_id, count(*) AS n, round(avg((start_sec + stop_sec) / 2), 6) AS middle, round(avg(frame), 6) AS frame FROM fr JOIN o USING (window_id) WHERE start_sec < o + 2 AND stop_sec > o + 1 GROUP BY 1",
    "token_pool": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings) SELECT vec_id, round(e[1], 5) AS first, round(list_avg(e), 5) AS attended, round(list_avg(e[2:63]), 5) AS content FROM v",
    "char_token_overlap": "WITH u AS (SELECT unit_id, normalized_text AS t, length(normalized_text) AS n FROM material_units WHERE normalized_text <> ''), c AS (SELECT unit_id, unnest(range(n)) AS position FROM u), k AS (SELECT unit_id, t, n, unnest(range((n - 1) // 2 + 1)) AS k FROM u), f AS (SELECT unit_id, k, k * 2 AS a, least(k * 2 + 3, n) AS z, length(regexp_replace(substr(t, k * 2 + 1, 3), '[\\p{P}\\p{Z}\\p{C}]', '', 'g')) AS lit FROM k) SELECT unit_id, position::INTEGER AS position, count(*) AS n, round(avg(k), 6) AS token, round(avg(lit), 6) AS lit FROM c JOIN f USING (unit_id) WHERE a < position + 1 AND z > position GROUP BY 1, 2",
    "field_power": f"WITH {_Z}, p AS (SELECT label, unnest(z) AS z, unnest(range(64))::INTEGER AS t FROM z) SELECT label, t, round(sqrt(avg(z * z)), 5) AS power FROM p GROUP BY 1, 2",
}
QUERIES = {k: globals()[k] for k in SQL}
