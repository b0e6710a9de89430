"""Operators on tiny tables."""

import duckdb
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.vectors import round_half_away, rounded
from spanloom.operators import aggregates, frames, joins, metrics, windows
from spanloom.plans import queries
from spanloom.sources import loaders


def test_smoothing(spark):
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate([1, 0, 4, 2, 6, 3])], "k int, i int, v double")
    got = [round(r.smooth, 6) for r in windows.smooth_zero(df, "k", ["i"], "v", 4).orderBy("i").collect()]
    assert got == [0.25, 1.25, 1.75, 3, 3.75, 2.75]
    assert [round(r.smooth, 6) for r in windows.smooth_edge(df, "k", ["i"], "v", 5).orderBy("i").collect()] == [1.4, 1.6, 2.6, 3, 3.6, 3.4]


def test_aggregates(spark):
    rows = [(0, [1.0, 0, 0]), (0, [0.6, 0.8, 0]), (0, [0, 0.6, 0.8])]
    df = spark.createDataFrame([(c, [float(x) for x in e]) for c, e in rows], "c int, emb array<double>")
    want = {"mean": [0.704361, 0.616316, 0.352180], "gem": [0.663415, 0.559137, 0.497238], "coherence_mean": [0.706789, 0.615768, 0.348251], "lse": [0.671198, 0.528903, 0.519380]}
    for method, v in want.items():
        r = aggregates.aggregate(df, ["c"], method).first()
        assert [round(x, 6) for x in r.emb] == v and round(r.coherence, 6) == 0.757188


def test_average_precision(spark):
    p = spark.createDataFrame([(1, k + 1, s, e, 1.0 - k / 10) for k, (s, e) in enumerate([(0.0, 10.0), (1.0, 10.0), (20.0, 32.0), (50.0, 60.0)])], "query_id int, rank int, start double, end double, score double")
    g = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 22.0, 32.0)], "query_id int, gt_idx int, start double, end double")
    assert {r.threshold: round(r.ap, 6) for r in metrics.average_precision(p, g, (0.5, 0.9)).collect()} == {0.5: 0.833333, 0.9: 0.5}


def test_clip_scores(spark):
    p = spark.createDataFrame([(1, 1, 1.0, 5.0, 0.8), (1, 2, 4.0, 7.0, 0.5)], "query_id int, rank int, start double, end double, score double")
    d = spark.createDataFrame([(1, 11.0)], "query_id int, duration double")
    assert [round(r.score, 6) for r in metrics.clip_scores(p, d).orderBy("clip").collect()] == [0.5, 1, 0.625, 0.3125, 0]


def test_text(spark):
    df = spark.createDataFrame([("The answer is B.",), ("A dog, so C",), ("(d)",), ("Because",), ("",)], "x string")
    got = df.select(T.standalone_letter(F.col("x")), T.any_letter(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("B", "B"), ("A", "A"), ("D", "D"), (None, "B"), (None, None)]
    t = spark.createDataFrame([("00:01:02,500",), ("00:00:01.5",), ("3",)], "x string").select(T.parse_timestamp(F.col("x")).alias("s")).collect()
    assert [r.s for r in t] == [62.5, 1.005, 3.0]
    assert spark.range(1).select(T.clock(F.lit(3661.9)), T.clock(F.lit(-4.0))).first() == ("01:01:01", "00:00:00")


def test_chunk_without_window_and_edges(spark):
    w = spark.createDataFrame([(1, k, 2.0 * k) for k in range(4)], "video_id int, w_idx int, t_sec double")
    c = spark.createDataFrame([(1, 0, 0, 60), (1, 1, 60, 75), (1, 2, 75, 90)], "video_id int, chunk_idx int, start_frame long, end_frame long")
    m = spark.createDataFrame([(1, 30.0, 90)], "video_id int, fps double, total_frames long")
    assert sorted(tuple(r) for r in joins.members(w, c, m).collect()) == [(1, 0, 0), (1, 1, 1), (1, 2, 1)]
    assert {r.w_idx: r.chunk_idx for r in joins.windows_to_chunks(w, c, m, 1.0).collect()} == {0: 0, 1: 1, 2: -1, 3: -1}


def test_srt(spark):
    df = spark.createDataFrame([(1, "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i>  there\n\n00:00:03,000 --> 00:00:04,000\nNo number\n\n3\n00:00:05,000 --> 00:00:06,000\n\n")], "video_id int, value string")
    assert [tuple(r)[1:] for r in loaders.srt(df).collect()] == [(1.0, 2.5, "Hello there"), (3.0, 4.0, "No number")]


def test_sources_hold_whole_texts_and_all_turns(spark, tmp_path):
    def text(c, t):
        return f'turn {t} of {c}: "quoted", back\\slash,\n\nblank line, ' + "é long text " * 20 + f"end {c}.{t}"

    rows = [(c, t, ("user", "assistant")[t % 2], text(c, t)) for c, n in ((0, 2), (1, 7), (5, 260)) for t in range(n)]
    spark.createDataFrame([*rows, (1, 7, "user", None)], "conv_id long, turn int, role string, text string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    d, flat = str(tmp_path), {(c, t): " ".join(x.split()) for c, t, _, x in rows}
    q = queries.R

    asked = [r for r in rows if r[2] == "user"]
    got = sorted(tuple(r) for r in q["s03_nested_queries"](spark, d).collect())
    assert got == sorted((f"c{c}_{k}", f"v{c}", f"c{c}", x, t * 3.0, t * 3.0 + 2.5) for k, (c, t, _, x) in enumerate(asked))
    choice = {r.sample_id: r for r in q["s08_multiple_choice"](spark, d).collect()}
    for c, n in ((0, 2), (1, 7), (5, 260)):
        assert choice[str(c)].options == [f"{chr(65 + t)}. {text(c, t)}" for t in range(n)]
        assert choice[str(c)].gt_answer == chr(65 + c % n)
    want = sorted((c, t * 3.0, x) for (c, t), x in flat.items())
    for name in ("s15_srt", "s16_json_subtitles"):
        assert sorted((r.video_id, r.start_sec, r.text) for r in q[name](spark, d).collect()) == want


def test_frame_groups_get_chunks_once_and_vectors_only_if_read(spark):
    """Chunks aren't repeated on every window, and methods without vectors don't have them dealt."""
    rows = [(v, k, 2.0 * k, [float(k == j) for j in range(4)]) for v in (1, 2) for k in range(4)]
    w = spark.createDataFrame(rows, "video_id int, w_idx int, t_sec double, emb array<double>")
    rel = w.crossJoin(spark.createDataFrame([(7,), (8,)], "query_id int")).select("video_id", "query_id", "w_idx", F.when(F.col("query_id") == 7, F.col("w_idx") / 10).otherwise(1 - F.col("w_idx") / 10).alias("score"))
    meta = spark.createDataFrame([(1, 30.0, 240), (2, 30.0, 240)], "video_id int, fps double, total_frames long")
    c = spark.createDataFrame([(1, 0, 0, 120), (1, 1, 120, 240)], "video_id int, chunk_idx int, start_frame long, end_frame long")
    got = frames.select_frames(w, rel, meta, "weighted", 2, 2.0, None, c)
    assert sorted((r.video_id, r.query_id, r.w_idx) for r in got.collect()) == [(1, 7, 1), (1, 7, 3), (1, 8, 0), (1, 8, 2), (2, 7, 1), (2, 7, 2), (2, 8, 0), (2, 8, 2)]
    assert "collect_list" not in got._jdf.queryExecution().optimizedPlan().toString()
    for method in ("constrained", "mmr"):
        plan = frames.select_frames(w, rel, meta, method, 2, 2.0)._jdf.queryExecution().optimizedPlan()
        assert ("emb" in [x.name() for x in (plan.children().head().output().apply(k) for k in range(plan.children().head().output().size()))]) == (method == "mmr")


def test_bracket_reads_running_frames_only(spark):
    """Against plain loops, with points on grid points; no frame shrinks, which would be quadratic in a video."""
    grid = [(v, k, 2.0 * k + v) for v in (1, 2) for k in range(6)]
    points = [(v, x / 2) for v in (1, 2, 3) for x in range(-1, 30, 3)]
    g = spark.createDataFrame(grid, "video_id int, w_idx int, center double")
    p = spark.createDataFrame(points, "video_id int, t double")
    got = joins.bracket(p, g)
    left = {(v, t): max((k for u, k, c in grid if u == v and c <= t), default=None) for v, t in points}
    right = {(v, t): min((k for u, k, c in grid if u == v and c > t), default=None) for v, t in points}
    assert {(r.video_id, r.t): (r.left_idx, r.right_idx) for r in got.collect()} == {k: (left[k], right[k]) for k in left}
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()


def test_rounding_goes_by_the_product_and_keeps_the_sign_of_zero(spark):
    """As DuckDB's round, sign of zero included; in sums, prompts and vectors."""
    values = [-3e-7, 3e-7, -0.0, 0.285, 1.005, -0.285, 0.125, -0.125, 2.5e-7, 0.0078125, -0.0078125, 1e300, -1e305, 123456.7890625]
    df = spark.createDataFrame([(i, x, [x]) for i, x in enumerate(values)], "i int, x double, v array<double>")
    got = df.select("i", round_half_away(F.col("x"), 2).alias("two"), round_half_away(F.col("x")).alias("six"), rounded(F.col("v"))[0].alias("v")).orderBy("i").collect()
    want = duckdb.sql("SELECT " + ", ".join(f"round({x!r}::DOUBLE, 2), round({x!r}::DOUBLE, 6)" for x in values)).fetchall()[0]
    assert [repr(x) for r in got for x in (r.two, r.six)] == [repr(x) for x in want]
    assert [repr(r.v) for r in got] == [repr(r.six) for r in got]
    assert [repr(r.x) for r in queries.r6(df, "x").orderBy("i").collect()] == [repr(r.six) for r in got]
