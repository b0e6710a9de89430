"""DuckDB SQL of further queries: interval joins, moments, greedy selections (as recursive queries), reports and texts."""

from __future__ import annotations

from spanloom.plans.sql import ANSWERS, BASE


def q(sql: str) -> str:
    return f"WITH RECURSIVE {BASE}{sql}"


TALK = """WITH c AS (SELECT conv_id AS video_id, max(turn) + 1 AS n FROM conversations GROUP BY 1),
  ch AS (SELECT video_id, chunk_idx, chunk_idx * 6.0 AS s, least((chunk_idx + 1) * 180, n * 90) / 30.0 AS e FROM c, unnest(range(CAST(ceil(n * 90 / 180.0) AS BIGINT))) AS u(chunk_idx)),
  sub AS (SELECT conv_id AS video_id, turn * 3.0 AS a, turn * 3.0 + 2.5 AS b, text FROM conversations)"""
EDGES = ", b AS (SELECT video_id, start_frame / 30.0 AS t FROM chunks WHERE chunk_idx > 0), g AS (SELECT video_id, w_idx, t_sec + 1.0 AS center FROM windows)"
RANKED = ", items AS (SELECT video_id * 100000 + w_idx AS item, query_id, score FROM rel), placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item) AS rank FROM items)"
FRAMES = "SELECT s.video_id, s.query_id, r.w_idx, round(w.t_sec + 1.0, 6) AS frame_time, least(CAST(trunc((w.t_sec + 1.0) * 30.0) AS BIGINT), m.total_frames - 1) AS frame_index, r.score FROM picked s JOIN rel r ON r.video_id = s.video_id AND r.query_id = s.query_id AND list_contains(s.chosen, r.w_idx) JOIN windows w ON w.video_id = r.video_id AND w.w_idx = r.w_idx JOIN meta m ON m.video_id = r.video_id"
DROP = """, so AS (SELECT *, row_number() OVER w AS r, score - lead(score) OVER w AS g FROM timed WINDOW w AS (PARTITION BY video_id, query_id ORDER BY score DESC, chunk_idx)),
  cutoff AS (SELECT video_id, query_id, coalesce(arg_max(score, struct_pack(a := g, b := -r)) FILTER (WHERE g IS NOT NULL), min(score)) AS c FROM so GROUP BY ALL),
  kept AS (SELECT t.*, chunk_idx - row_number() OVER (PARTITION BY video_id, query_id ORDER BY chunk_idx) AS island FROM timed t JOIN cutoff USING (video_id, query_id) WHERE score >= c),
  found AS (SELECT video_id, query_id, min(chunk_idx) AS k, min(start_sec) AS start_sec, max(end_sec) AS end_sec, max(score) AS score FROM kept GROUP BY video_id, query_id, island)"""


def greedy(score: str, free: str = "true") -> str:
    """Eight windows, one after the other: the best at first, then the greatest of score (of r.score, and far: the similarity to those chosen)."""
    return q(f""", sim AS (SELECT a.video_id, a.w_idx AS x, b.w_idx AS y, list_cosine_similarity(a.emb, b.emb) AS c FROM windows a JOIN windows b USING (video_id)),
  sel AS (SELECT video_id, query_id, 1 AS step, [arg_max(w_idx, struct_pack(a := score, b := -w_idx))] AS chosen FROM rel GROUP BY ALL
    UNION ALL SELECT video_id, query_id, step + 1, list_append(any_value(chosen), arg_max(w, struct_pack(a := sc, b := -w))) FROM (
      SELECT s.video_id, s.query_id, s.step, any_value(s.chosen) AS chosen, r.w_idx AS w, {score} AS sc
      FROM (SELECT *, unnest(chosen) AS x FROM sel WHERE step < 8) s JOIN rel r ON r.video_id = s.video_id AND r.query_id = s.query_id JOIN sim m ON m.video_id = s.video_id AND m.x = s.x AND m.y = r.w_idx
      WHERE NOT list_contains(s.chosen, r.w_idx) AND {free} GROUP BY s.video_id, s.query_id, s.step, r.w_idx, r.score) GROUP BY video_id, query_id, step),
  picked AS (SELECT video_id, query_id, arg_max(chosen, step) AS chosen FROM sel GROUP BY ALL) {FRAMES}""")


SQL: dict[str, str] = {
    "j03_members": q(""", ch AS (SELECT video_id, chunk_idx, s, e FROM (SELECT m.video_id, k AS chunk_idx, CAST(trunc(k * (m.total_frames - 1) / 8.0) AS BIGINT) / 30.0 AS s, (CAST(trunc(k * (m.total_frames - 1) / 8.0) AS BIGINT) + 1) / 30.0 AS e FROM meta m, unnest(range(9)) AS u(k))),
      ins AS (SELECT c.video_id, c.chunk_idx, w.w_idx FROM ch c JOIN windows w ON w.video_id = c.video_id AND w.t_sec >= c.s AND w.t_sec < c.e)
      SELECT * FROM ins UNION ALL SELECT c.video_id, c.chunk_idx, arg_min(w.w_idx, struct_pack(a := abs(w.t_sec - (c.s + c.e) / 2), b := w.w_idx)) FROM ch c JOIN windows w USING (video_id) WHERE NOT EXISTS (SELECT 1 FROM ins i WHERE i.video_id = c.video_id AND i.chunk_idx = c.chunk_idx) GROUP BY 1, 2"""),
    "j04_overlapping_subtitles": f"{TALK} SELECT video_id, chunk_idx, string_agg(text, ' ' ORDER BY a, b, text) AS text FROM (SELECT c.video_id, c.chunk_idx, s.text, min(s.a) AS a, arg_min(s.b, s.a) AS b FROM ch c JOIN sub s ON s.video_id = c.video_id AND s.a <= c.e AND s.b >= c.s GROUP BY ALL) GROUP BY ALL",
    "j06_subtitles_around": f"{TALK} SELECT c.video_id, c.s AS t, string_agg(u.text, ' ' ORDER BY u.a, u.b, u.text) AS text FROM ch c JOIN sub u ON u.video_id = c.video_id AND u.a <= c.s + 3 AND u.b >= c.s - 3 GROUP BY ALL",
    "j07_bracket": q(f"{EDGES} SELECT b.video_id, round(b.t, 6) AS t, (SELECT arg_max(g.w_idx, g.center) FROM g WHERE g.video_id = b.video_id AND g.center <= b.t) AS left_idx, (SELECT arg_min(g.w_idx, g.center) FROM g WHERE g.video_id = b.video_id AND g.center > b.t) AS right_idx FROM b"),
    "j08_nearest": q(f"{EDGES} SELECT DISTINCT b.video_id, round(b.t, 6) AS t, (SELECT arg_min(g.w_idx, struct_pack(a := abs(g.center - b.t), b := g.w_idx)) FROM g WHERE g.video_id = b.video_id) AS w_idx FROM b"),
    "e16_pass_at_k": q(f"{RANKED} SELECT k, round(avg(CASE WHEN rank <= k THEN 1 ELSE 0 END), 6) AS pass_rate FROM placed, (VALUES (1), (5), (10), (50), (200)) v(k) WHERE item = query_id * 100000 + 3 GROUP BY 1"),
    "r12_gallery": q(f"{RANKED} SELECT query_id, item, score, rank FROM placed WHERE rank <= 10"),
    "g03_trend": q(", m AS (SELECT iou, total_frames / 30.0 AS d FROM best JOIN meta ON video_id = query_id WHERE rank = 1) SELECT count(*) AS n, round(CASE WHEN count(*) >= 3 THEN regr_slope(iou, d) END, 6) AS slope, round(CASE WHEN count(*) >= 3 THEN regr_intercept(iou, d) END, 6) AS intercept FROM m"),
    "g06_examples": q(""", t AS (SELECT query_id, round(iou, 6) AS iou FROM best WHERE rank = 1), w AS (SELECT * FROM t ORDER BY iou, query_id LIMIT 2), b AS (SELECT * FROM t WHERE query_id NOT IN (SELECT query_id FROM w) ORDER BY iou DESC, query_id LIMIT 2),
      f AS (SELECT * FROM t WHERE query_id NOT IN (SELECT query_id FROM w UNION ALL SELECT query_id FROM b) ORDER BY query_id LIMIT 2) SELECT *, 'worst' AS kind FROM w UNION ALL SELECT *, 'best' FROM b UNION ALL SELECT *, 'first' FROM f"""),
    "g14_disagreement": f"WITH a AS ({ANSWERS}) SELECT x.s AS sample_id, CASE WHEN x.correct THEN 'only_a' ELSE 'only_b' END AS kind FROM (SELECT conv_id * 10 + turn AS s, correct FROM a WHERE role = 'user') x JOIN (SELECT conv_id * 10 + turn - 1 AS s, correct FROM a WHERE role = 'assistant') y ON x.s = y.s WHERE x.correct <> y.correct",
    "m03_score_drop": q(f"{DROP} SELECT video_id, query_id, start_sec, end_sec, score, row_number() OVER (PARTITION BY video_id, query_id ORDER BY score DESC, k) AS rank FROM found"),
    "m04_diagnostics": q(f"{DROP} SELECT s.*, coalesce(n, 0) AS num_moments FROM (SELECT video_id, query_id, count(*) AS num_chunks, round(avg(score), 9) AS score_mean, round(stddev_pop(score), 9) AS score_std FROM timed GROUP BY ALL) s LEFT JOIN (SELECT video_id, query_id, count(*) AS n FROM found GROUP BY ALL) USING (video_id, query_id)"),
    "e08_clip_scores": q(""", dur AS (SELECT video_id AS query_id, total_frames / 30.0 AS duration FROM meta), clip AS (SELECT query_id, unnest(range(0, greatest(1, CAST(trunc(duration / 2.0) AS BIGINT)))) AS clip FROM dur),
      raw AS (SELECT c.query_id, c.clip, greatest(0.0, coalesce(max(p.score * greatest(0.0, least(p.e, (c.clip + 1) * 2.0) - greatest(p.s, c.clip * 2.0)) / 2.0), 0.0)) AS x FROM clip c LEFT JOIN preds p USING (query_id) GROUP BY ALL)
      SELECT query_id, clip, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE x END, 6) AS score FROM raw WINDOW w AS (PARTITION BY query_id)"""),
    "t05_timestamps": """SELECT conv_id, turn, round(s + ms / 1000.0, 6) AS seconds, printf('%02d:%02d:%02d', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), CAST(s % 60 AS BIGINT)) AS clock,
      printf('%02d:%02d.%d', CAST(floor(t / 600) AS BIGINT), CAST(floor((t % 600) / 10) AS BIGINT), CAST(t % 10 AS BIGINT)) AS short
      FROM (SELECT conv_id, turn, turn * 3600 + (conv_id % 60) * 60 + turn * 7 AS s, conv_id % 1000 AS ms, CAST(round(turn * 61.25::DOUBLE * 10) AS BIGINT) AS t FROM conversations)""",
    "t07_strip_tags": "SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g'))) AS text_md5 FROM pages",
    "t20_chunk_number": "SELECT page_id, CAST(list_filter(list_transform(regexp_extract_all(url, '\\d+'), lambda d: CASE WHEN length(d) <= 9 THEN CAST(d AS INTEGER) END), lambda v: v BETWEEN 1 AND 500)[1] AS INTEGER) AS chunk, false AS no_match FROM pages",
    "t32_shorten": """SELECT item_id, CASE WHEN length(f) > 60 THEN f[1:57] || '...' ELSE f END AS label, trim(trim(trim(text), '"'''))[1:80] AS search FROM (SELECT item_id, text, trim(replace(text, chr(10), ' ')) AS f FROM benchmark)""",
    "f02_mmr": greedy("0.7 * r.score - 0.3 * max(m.c)"),
    "f06_temporal": greedy("r.score * least(min(abs(m.x - m.y)) * 2.0 / ((SELECT total_frames FROM meta e WHERE e.video_id = s.video_id) / 30.0 / 16), 1.0)"),
    "t02_chunk_prompt": q(" SELECT video_id, string_agg(printf('%d. [%.1f-%.1f] score %.2f', CAST(chunk_idx + 1 AS INTEGER), start_sec, end_sec, round(score, 2)), chr(10) ORDER BY chunk_idx) AS prompt FROM timed WHERE video_id = query_id GROUP BY 1"),
}
