"""Scenes, refined boundaries, frames inside of windows, samples and run folders against plain loops."""

import math

from pyspark.sql import functions as F

from spanloom.operators import metrics, refine
from spanloom.sources import runs


def plain_interior(start, end, fps, first, last, n):
    """Frames by the definition: each place takes the nearest frame that is left, the earlier on ties."""
    top = max(first, last - 1)
    lo = min(max(math.floor(start * fps), first), top)
    hi = max(lo, min(max(math.ceil(end * fps), first + 1), last) - 1)
    left = list(range(lo, hi + 1))
    if len(left) <= n:
        return left + [hi] * (n - len(left))
    got = []
    for k in range(1, n + 1):
        near = min(left, key=lambda f: (abs(f - (lo + k / (n + 1) * (hi - lo))), f))
        left.remove(near)
        got.append(near)
    return got


def test_interior_frames_against_a_plain_loop(spark):
    rows = [(a / 2, a / 2 + w / 2, 2.0, first, first + size, n) for a in range(3) for w in range(1, 14) for first in (0, 2) for size in (1, 4, 30) for n in range(1, 9)]
    df = spark.createDataFrame(rows, "a double, b double, fps double, first long, last long, n int")
    cols = [F.col(c) for c in df.columns]
    assert all(r.got == plain_interior(*r[:6]) for r in df.select("*", refine.interior_frames(*cols).alias("got")).collect())


def test_scenes(spark):
    rows = [(1, f, s) for f, s in enumerate([9.0, 30.0, 1.0, 40.0, 50.0, None, float("nan"), 27.0])] + [(2, f, 1.0) for f in range(3)]
    got = refine.scenes(spark.createDataFrame(rows, "video_id long, frame long, score double"), 27.0, 3).orderBy("video_id", "scene_idx").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 3), (1, 1, 3, 7), (1, 2, 7, 8), (2, 0, 0, 3)]


def test_refined_takes_the_first_largest_or_the_middle(spark):
    diffs = spark.createDataFrame([(1, 10, 5.0), (1, 11, 9.0), (1, 70, 9.0), (1, 90, None)], "video_id long, frame long, score double")
    meta = spark.createDataFrame([(1, 200)], "video_id long, total_frames long")
    ranges = spark.createDataFrame([(1, 0, 10, 80), (1, 1, 11, 80), (1, 2, 80, 101), (1, 3, 50, 50), (1, 4, 190, 400)], "video_id long, t int, lo long, hi long")
    assert {r.t: r.frame for r in refine.refined(ranges, diffs, meta).collect()} == {0: 11, 1: 70, 2: 90, 3: 50, 4: 295}


def test_samples_and_lists(spark):
    ids = spark.range(30).withColumnRenamed("id", "video_id")
    a, b = (sorted(r.video_id for r in refine.seeded_sample(x, "video_id", 7, 3).collect()) for x in (ids, ids.union(ids).repartition(5)))
    assert a == b and len(a) == 7
    assert refine.seeded_sample(ids, "video_id", 99, 3).count() == 30
    x = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 4, 5, 10)], "x array<int>")
    assert [r.y for r in x.select(refine.spread(F.col("x"), 4).alias("y")).collect()] == [[], [0], [0, 1, 2, 3], [0, 1, 3, 4], [0, 3, 6, 9]]


def test_runs_are_numbered_and_read_again(spark, tmp_path):
    out = str(tmp_path)
    first = runs.new_run(spark, out, "moments", "small", "a note: " + "x" * 60)
    second = runs.new_run(spark, out, "moments", "small")
    assert [p.rsplit("/", 1)[1].split("-")[0] for p in (first, second)] == ["1", "2"]
    runs.save_settings(spark, first, {"k": 1})
    for n in (3, 4):
        runs.save(spark.range(n), first, "results")
    settings, tables = runs.load(spark, first)
    assert settings == {"k": 1} and list(tables) == ["results"] and tables["results"].count() == 4
    assert runs.load(spark, second) == ({}, {})
    left = runs.unfinished(spark.range(6), spark.range(4), "id", spark.range(1))
    assert sorted(r.id for r in left.collect()) == [0, 4, 5]


def test_word_similarity_lists_no_pairs_of_words(spark):
    """Against plain loops, with and without a table; without one no row leaves its task."""
    texts = ["a b b", "b a", "c", "a c", "d d a", "", "e"]
    rows = [(i, x.split(), y.split()) for i, (x, y) in enumerate((x, y) for x in texts for y in texts)]
    pairs = spark.createDataFrame(rows, "id long, answer array<string>, truth array<string>")
    table = {("a", "c"): 0.95, ("c", "a"): 0.95, ("b", "d"): 0.5, ("d", "b"): 0.5, ("a", "d"): 0.92, ("a", "a"): 0.3}
    sim = spark.createDataFrame([(*k, v) for k, v in table.items()], "a string, b string, sim double")
    for known, given in ((table, sim), ({}, None)):
        of = lambda a, b: 1.0 if a == b else known.get((a, b), 0.0) * (1 if known.get((a, b), 0.0) >= 0.9 else 0.1)  # noqa: B023, E731
        side = lambda x, y: math.prod(max(of(a, b) for b in y) for a in x) if x and y else 0.0  # noqa: B023, E731
        want = {i: 1.0 if sorted(x) == sorted(y) else min(side(x, y), side(y, x)) for i, x, y in rows}
        got = {r.id: r.wups for r in metrics.wups(pairs, given, 0.9).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    plan = metrics.wups(pairs, None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
