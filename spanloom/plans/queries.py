"""A query for each operator over the driver's tables, rounded to six digits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.vectors import doubles, l2_normalize, norm, round_half_away, rounded
from spanloom.operators import aggregates, chunking, frames, joins, metrics, moments, reports, scoring
from spanloom.operators import windows as W
from spanloom.plans import views as V
from spanloom.sources import loaders

R: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    R[f.__name__] = f
    return f


def r6(df: DataFrame, *columns: str) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: round_half_away(F.col(c)) if kinds[c] == "double" else F.round(F.col(c), 6) for c in columns})


# ---------------------------------------------------------------- windows and series


@query
def w01_window_grid(s, d):
    return W.window_grid(V.meta(s, d), 3.5)


@query
def w02_first_interval(s, d):
    return W.first_interval(V.windows(s, d))


@query
def w03_median_interval(s, d):
    return W.median_interval(V.windows(s, d))


@query
def w04_adjacent_cosine(s, d):
    return r6(W.adjacent_similarity(V.windows(s, d)), "value", "t_sec")


@query
def w05_smooth_zero(s, d):
    return r6(W.smooth_zero(V.series(s, d), "user_id", ["ts", "event_id"], "value", 4).select("user_id", "event_id", "smooth"), "smooth")


@query
def w06_smooth_edge(s, d):
    return r6(W.smooth_edge(V.series(s, d), "user_id", ["ts", "event_id"], "value", 5).select("user_id", "event_id", "smooth"), "smooth")


@query
def w07_islands(s, d):
    runs = W.islands(V.series(s, d), ["user_id"], ["ts", "event_id"], F.col("value") > 50)
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).drop("island")


@query
def w09_peaks(s, d):
    return r6(W.peaks(V.series(s, d), "user_id", ["ts", "event_id"], "value"), "strength")


@query
def w15_std_boundaries(s, d):
    return chunking.std_boundaries(W.adjacent_similarity(V.windows(s, d)), 1.0)


@query
def w16_high_boundaries(s, d):
    return chunking.std_boundaries(W.adjacent_similarity(V.windows(s, d)), 1.0, high=True)


# ---------------------------------------------------------------- chunks


@query
def c02_std_chunks(s, d):
    return V.chunks(s, d)


@query
def c08_transitions(s, d):
    sig = W.adjacent_similarity(V.windows(s, d))
    return W.regions(sig, F.col("value") < 0.0, 2.0)


@query
def c09_labelled_chunks(s, d):
    regions = W.regions(W.adjacent_similarity(V.windows(s, d)), F.col("value") < 0.0, 4.0)
    return chunking.label_chunks(V.chunks(s, d), regions, V.meta(s, d))


@query
def c11_chunk_vectors(s, d):
    return V.chunk_embs(s, d, "mean").select("video_id", "chunk_idx", rounded(F.col("emb")).alias("emb"))


@query
def c14_uniform_chunks(s, d):
    return chunking.uniform_chunks(V.meta(s, d), 7)


@query
def c15_equal_split(s, d):
    return chunking.equal_split(V.meta(s, d), 7)


@query
def c16_boundaries(s, d):
    return r6(chunking.boundaries_of(V.chunks(s, d), V.meta(s, d)), "t")


@query
def c19_grouped_chunks(s, d):
    return chunking.grouped_chunks(V.chunks(s, d), 4)


@query
def c03_kernel_change_points(s, d):
    return chunking.change_points(V.windows(s, d), 1.2, 2)


@query
def c04_pelt_change_points(s, d):
    return chunking.change_points(V.windows(s, d), 0.02, 2, "pelt")


@query
def c10_merge_short_chunks(s, d):
    c = V.chunks(s, d).withColumn("label", F.lit("stable"))
    return chunking.merge_short_chunks(c, V.chunk_embs(s, d), V.meta(s, d), 8.0, 60.0)


@query
def c12_merge_by_query(s, d):
    return chunking.merge_chunks_by_query(V.chunks(s, d), V.chunk_embs(s, d), V.queries(s, d), V.meta(s, d))


# ---------------------------------------------------------------- joins


@query
def j02_windows_to_chunks(s, d):
    return joins.windows_to_chunks(V.windows(s, d), V.chunks(s, d), V.meta(s, d), 20.0).select("video_id", "w_idx", "chunk_idx")


@query
def j03_members(s, d):
    c = chunking.uniform_chunks(V.meta(s, d), 9)
    return joins.members(V.windows(s, d), c, V.meta(s, d))


@query
def j04_overlapping_subtitles(s, d):
    c, m = V.talk_chunks(s, d)
    return joins.overlapping(c, m, V.subtitles(s, d))


@query
def j05_aligned_subtitles(s, d):
    c, m = V.talk_chunks(s, d)
    return joins.aligned(V.subtitles(s, d), c.where("chunk_idx = 0"), m)


@query
def j06_subtitles_around(s, d):
    c, m = V.talk_chunks(s, d)
    return joins.around(c.select("video_id", (F.col("start_frame") / 30.0).alias("t")), V.subtitles(s, d))


@query
def j07_bracket(s, d):
    grid = V.windows(s, d).withColumn("center", F.col("t_sec") + 1.0)
    return r6(joins.bracket(chunking.boundaries_of(V.chunks(s, d), V.meta(s, d)), grid), "t")


@query
def j08_nearest(s, d):
    grid = V.windows(s, d).withColumn("center", F.col("t_sec") + 1.0)
    return r6(joins.nearest(chunking.boundaries_of(V.chunks(s, d), V.meta(s, d)), grid), "t")


# ---------------------------------------------------------------- vector aggregates


def _aggregate(method):
    def f(s, d):
        return r6(V.chunk_embs(s, d, method).withColumn("emb", rounded(F.col("emb"))), "coherence")

    return f


for _m, _n in (("mean", "a01_mean"), ("gem", "a02_gem"), ("coherence_mean", "a03_coherence_mean"), ("lse", "a04_lse"), ("max_sim", "a06_max_sim")):
    R[_n] = _aggregate(_m)


@query
def a08_normalize(s, d):
    e = V.table(s, d, "embeddings")
    return e.select("vec_id", rounded(l2_normalize(doubles(F.col("embedding")))).alias("unit"), round_half_away(norm(doubles(F.col("embedding")))).alias("norm"))


# ---------------------------------------------------------------- scores


@query
def r01_chunk_cosine(s, d):
    return r6(scoring.single_vector(V.chunk_embs(s, d), V.queries(s, d)), "score")


@query
def r02_max_sim(s, d):
    return V.chunk_scores(s, d).select("video_id", "query_id", "chunk_idx", "score")


@query
def r03_round_robin(s, d):
    return scoring.round_robin(V.relevance(s, d), ["video_id", "query_id"], 130).select("video_id", "query_id", "w_idx", "frames")


@query
def r04_neighbours(s, d):
    return scoring.neighbours(V.relevance(s, d), ["video_id", "query_id"], 8).select("video_id", "query_id", "w_idx", "step")


@query
def r07_ranked_chunks(s, d):
    return scoring.ranked(V.chunk_scores(s, d), ["video_id", "query_id"], top=10).select("video_id", "query_id", "chunk_idx", "score", "rank")


@query
def r09_preselected(s, d):
    return scoring.preselected(V.chunk_scores(s, d), ["video_id", "query_id"], 5).select("video_id", "query_id", "chunk_idx", "position")


@query
def r12_gallery(s, d):
    items = V.windows(s, d).select((F.col("video_id") * 100000 + F.col("w_idx")).alias("item"), "emb")
    return r6(scoring.gallery(items, V.queries(s, d), "item", 10), "score").select("query_id", "item", "score", "rank")


# ---------------------------------------------------------------- moments


@query
def m01_penalized_dp(s, d):
    return r6(moments.penalized_dp(V.chunk_scores(s, d)), "score")


@query
def m02_top_gap(s, d):
    return moments.top_gap(V.chunk_scores(s, d), 0.06).drop("rank")


@query
def m03_score_drop(s, d):
    return moments.score_drop(V.chunk_scores(s, d))


@query
def m04_diagnostics(s, d):
    c = V.chunk_scores(s, d)
    return moments.diagnostics(c, moments.score_drop(c)).withColumns({x: F.round(x, 9) for x in ("score_mean", "score_std")})  # scores have six digits, so that ties at a rounding edge are common there


# ---------------------------------------------------------------- frames


def _frames(method, mapped, n=8, **params):
    def f(s, d):
        w, m = V.windows(s, d), V.meta(s, d)
        c = V.chunks(s, d) if mapped else None
        to = joins.windows_to_chunks(w, c, m) if mapped else None
        return r6(frames.select_frames(w, V.relevance(s, d), m, method, n, V.STEP, to, c if method == "weighted" else None, **params), "frame_time")

    return f


for _n, _m, _c, _p in (
    ("f01_weighted", "weighted", True, {}), ("f02_mmr", "mmr", False, {}), ("f03_mmr_chunk_penalty", "mmr_chunk_penalty", True, {"chunk_weight": 0.1}), ("f04_mmr_chunk_constrained", "mmr_chunk_constrained", True, {}),
    ("f06_temporal", "temporal", False, {}), ("f07_constrained", "constrained", False, {}), ("f08_coverage", "coverage", False, {}), ("f09_rdmv", "rdmv", False, {}), ("f10_nudge", "nudge", False, {}),
    ("f11_stretch", "stretch", False, {}), ("f12_focused", "focused", False, {}), ("f12b_focused_representative", "focused", False, {"context_mode": "representative"}), ("f13_segment_adaptive", "segment_adaptive", False, {}),
):
    R[_n] = _frames(_m, _c, **_p)


@query
def f05_intra_chunk_greedy(s, d):
    to = joins.windows_to_chunks(V.windows(s, d), V.chunks(s, d), V.meta(s, d))
    return frames.intra_chunk_native(V.relevance(s, d), to, 8)


@query
def f14_uniform_topk(s, d):
    return frames.uniform_topk_native(V.relevance(s, d), 8)


@query
def f17_middle_frames(s, d):
    return frames.middle_frames(V.chunks(s, d))


@query
def f18_interior_frames(s, d):
    return frames.interior_frames(V.chunks(s, d), 3)


# ---------------------------------------------------------------- metrics

IOUS = (0.1, 0.3, 0.5, 0.7)


@query
def e02_best_iou(s, d):
    return r6(metrics.best_iou(V.predictions(s, d), V.truths(s, d)), "iou")


@query
def e03_recall(s, d):
    return r6(metrics.recall_at(V.predictions(s, d), V.truths(s, d), (1, 5), IOUS), "recall")


@query
def e04_average_precision(s, d):
    return r6(metrics.average_precision(V.predictions(s, d), V.truths(s, d), IOUS), "ap")


@query
def e05_map(s, d):
    return r6(metrics.mean_average_precision(V.predictions(s, d), V.truths(s, d), IOUS), "map")


@query
def e06_mean_iou(s, d):
    return r6(metrics.mean_iou(V.predictions(s, d), V.truths(s, d)), "miou")


@query
def e07_binary_ap(s, d):
    e = V.series(s, d).withColumn("label", (F.col("event_type") == "purchase").cast("int"))
    return r6(metrics.binary_ap(e, "user_id", "value", "label", "event_id"), "ap")


@query
def e08_clip_scores(s, d):
    dur = V.meta(s, d).select(F.col("video_id").alias("query_id"), (F.col("total_frames") / F.col("fps")).alias("duration"))
    return r6(metrics.clip_scores(V.predictions(s, d), dur), "score")


def _answers(s, d):
    c = V.table(s, d, "conversations")
    return c.withColumn("correct", F.coalesce(T.any_letter(F.col("text")) == F.char(F.col("conv_id") % 4 + 65), F.lit(False)))


@query
def e10_accuracy_breakdown(s, d):
    return r6(metrics.accuracy_breakdown(_answers(s, d), "correct", ["role", "turn"]), "accuracy")


@query
def e12_macro_accuracy(s, d):
    return r6(metrics.macro_accuracy(_answers(s, d), "correct", "role"), "macro", "micro")


@query
def e15_boundary_f1(s, d):
    e = V.series(s, d).select(F.col("user_id").alias("video_id"), "event_type", (F.unix_micros("ts") / 1e6 - 1704067200).alias("t"))
    dur = e.select("video_id").distinct().withColumn("duration", F.lit(2592000.0))
    return r6(metrics.boundary_f1(e.where("event_type IN ('click', 'view')").withColumnRenamed("event_type", "rater"), e.where("event_type = 'purchase'").select("video_id", "t"), dur, (0.001, 0.005, 0.01, 0.05)), "precision", "recall", "f1")


@query
def e16_pass_at_k(s, d):
    items = V.windows(s, d).select((F.col("video_id") * 100000 + F.col("w_idx")).alias("item"), "emb")
    ranks = scoring.ranked(r6(scoring.relevance(items, V.queries(s, d), ["item"]), "score"), ["query_id"], "item")
    return r6(metrics.pass_at(ranks.select("query_id", "item", "rank"), V.queries(s, d).select("query_id", (F.col("query_id") * 100000 + 3).alias("target")), (1, 5, 10, 50, 200), "item"), "pass_rate")


# ---------------------------------------------------------------- text


@query
def t05_timestamps(s, d):
    c = V.table(s, d, "conversations").withColumn("raw", F.format_string("%02d:%02d:%02d,%d", F.col("turn"), F.col("conv_id") % 60, F.col("turn") * 7, F.col("conv_id") % 1000))
    return c.select("conv_id", "turn", F.round(T.parse_timestamp(F.col("raw")), 6).alias("seconds"), T.clock(T.parse_timestamp(F.col("raw"))).alias("clock"), T.short_clock(F.col("turn") * 61.25).alias("short"))


@query
def t07_strip_tags(s, d):
    p = V.table(s, d, "pages")
    return p.select("page_id", F.md5(T.strip_tags(F.col("html"))).alias("text_md5"))


@query
def t20_chunk_number(s, d):
    u = V.table(s, d, "pages")
    return u.select("page_id", T.chunk_number(F.col("url"), 500).alias("chunk"), T.no_match(F.col("url")).alias("no_match"))


@query
def t27_standalone_letter(s, d):
    c = V.table(s, d, "conversations")
    return c.select("conv_id", "turn", T.standalone_letter(F.col("text")).alias("letter"), T.any_letter(F.col("text")).alias("any_letter"))


@query
def t30_slug(s, d):
    return V.table(s, d, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query
def t31_tokens(s, d):
    return V.table(s, d, "pages").select("page_id", T.answer_tokens(F.col("url")).alias("tokens"))


@query
def t32_shorten(s, d):
    return V.table(s, d, "benchmark").select("item_id", T.shorten(F.col("text"), 60).alias("label"), T.search_text(F.col("text"), 80).alias("search"))


@query
def t02_chunk_prompt(s, d):
    c = V.chunk_scores(s, d).where("video_id = query_id")
    line = T.interval_line((F.col("chunk_idx") + 1).cast("int"), F.col("start_sec"), F.col("end_sec"), round_half_away(F.col("score"), 2))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("chunk_idx", line.alias("line")))), lambda x: x["line"])
    return c.groupBy("video_id").agg(F.array_join(lines, "\n").alias("prompt"))


# ---------------------------------------------------------------- filters and sets


@query
def p01_keep_subset(s, d):
    keep = V.table(s, d, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return V.table(s, d, "customer").join(keep, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query
def p05_resume(s, d):
    done = V.table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return V.table(s, d, "customer").join(done, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query
def p11_frames_of_seconds(s, d):
    w = V.windows(s, d).join(V.meta(s, d), "video_id")
    return w.select("video_id", "w_idx", (F.col("t_sec") * F.col("fps")).cast("long").alias("frame"), F.ceil(F.col("t_sec") * 29.97).cast("long").alias("frame_up"))


@query
def o_grouping_sets(s, d):
    li = V.table(s, d, "lineitem")
    return r6(li.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("total"), F.avg("l_discount").alias("discount"), F.stddev_pop("l_quantity").alias("spread")), "total", "discount", "spread")


# ---------------------------------------------------------------- reports


@query
def g02_iou_histogram(s, d):
    return reports.histogram(metrics.best_iou(V.predictions(s, d), V.truths(s, d)), "iou", 20)


@query
def g03_trend(s, d):
    dur = V.meta(s, d).select(F.col("video_id").alias("query_id"), (F.col("total_frames") / F.col("fps")).alias("duration"))
    top = metrics.best_iou(V.predictions(s, d).where("rank = 1"), V.truths(s, d)).join(dur, "query_id")
    return r6(reports.trend(top, "duration", "iou"), "slope", "intercept")


@query
def g05_chunk_durations(s, d):
    c = V.chunks(s, d).join(V.meta(s, d), "video_id").withColumn("sec", (F.col("end_frame") - F.col("start_frame")) / F.col("fps"))
    return r6(c.agg(F.avg("sec").alias("mean"), F.median("sec").alias("median"), F.count("*").alias("n")), "mean", "median")


@query
def g06_examples(s, d):
    top = metrics.best_iou(V.predictions(s, d).where("rank = 1"), V.truths(s, d)).select("query_id", F.round("iou", 6).alias("iou"))
    return reports.examples(top, "iou", "query_id", 2)


@query
def g12_correct_examples(s, d):
    return reports.per_flag(_answers(s, d).select("conv_id", "turn", "correct"), "correct", ["conv_id", "turn"], 3)


@query
def g14_disagreement(s, d):
    c = _answers(s, d)
    a = c.where("role = 'user'").select((F.col("conv_id") * 10 + F.col("turn")).alias("sample_id"), "correct")
    b = c.where("role = 'assistant'").select((F.col("conv_id") * 10 + F.col("turn") - 1).alias("sample_id"), "correct")
    return reports.disagreement(a, b)


@query
def g16_segments(s, d):
    return r6(reports.segments(chunking.boundaries_of(V.chunks(s, d), V.meta(s, d)), V.meta(s, d)), "start_sec", "end_sec")


# ---------------------------------------------------------------- sources


@query
def s02_object_of_objects(s, d):
    return loaders.captions(loaders.captions_json(s, d))


@query
def s03_nested_queries(s, d):
    return loaders.nested_queries(loaders.nested_json(s, d))


@query
def s08_multiple_choice(s, d):
    return loaders.multiple_choice(loaders.choices_json(s, d))


@query
def s15_srt(s, d):
    return loaders.srt(loaders.srt_text(s, d)).withColumn("start_sec", F.round("start_sec", 6)).withColumn("end_sec", F.round("end_sec", 6))


@query
def s16_json_subtitles(s, d):
    return loaders.json_subtitles(loaders.subtitle_json(s, d))


@query
def s05_question_answers(s, d):
    c = V.table(s, d, "conversations")
    q = c.where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.concat(F.lit("c"), F.col("conv_id")).alias("video_name"), F.col("text").alias("question"))
    a = c.where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn") - 1).alias("question_id"), F.col("text").alias("answer"), (F.col("turn") % 9).alias("type"))
    return loaders.question_answers(q, a)


# ---------------------------------------------------------------- plans


@query
def moment_retrieval(s, d):
    """Change points, chunk scores, moments, ranks, recall and mean overlap in one plan."""
    picked = moments.top_gap(V.chunk_scores(s, d).where("video_id = query_id"), 0.06)
    preds = picked.select("query_id", "rank", F.col("start_sec").alias("start"), F.col("end_sec").alias("end"), "score")
    best = metrics.best_iou(preds, V.truths(s, d))
    return r6(best.groupBy("query_id").agg(F.max(F.when(F.col("rank") == 1, F.col("iou"))).alias("top1_iou"), F.max(F.when(F.col("rank") <= 5, F.col("iou"))).alias("top5_iou")), "top1_iou", "top5_iou")


@query
def event_windows(s, d):
    e = V.series(s, d)
    return r6(e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), "total")


@query
def event_sessions(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = V.series(s, d).withColumn("new", F.coalesce((F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w)) > 6 * 3600 * 1_000_000).cast("int"), F.lit(1)))
    e = e.withColumn("session", F.sum("new").over(w))
    return r6(e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "total")
