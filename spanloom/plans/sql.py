"""DuckDB SQL of the queries that SQL can express."""

BASE = """windows AS (SELECT label AS video_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INTEGER) AS w_idx,
    2.0::DOUBLE * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) AS t_sec, CAST(embedding AS DOUBLE[]) AS emb FROM embeddings),
  meta AS (SELECT label AS video_id, 30.0::DOUBLE AS fps, 60 * count(*) AS total_frames FROM embeddings GROUP BY label),
  sig AS (SELECT video_id, w_idx - 1 AS i, t_sec, list_cosine_similarity(lag(emb) OVER w, emb) AS value FROM windows WINDOW w AS (PARTITION BY video_id ORDER BY w_idx)),
  signal AS (SELECT * FROM sig WHERE value IS NOT NULL),
  low AS (SELECT video_id, i FROM (SELECT *, avg(value) OVER (PARTITION BY video_id) - 1.0 * stddev_pop(value) OVER (PARTITION BY video_id) AS t FROM signal) WHERE value < t),
  cuts AS (SELECT l.video_id, CAST(trunc((a.t_sec + b.t_sec + 2.0) / 2 * 30) AS BIGINT) AS e FROM low l JOIN windows a ON a.video_id = l.video_id AND a.w_idx = l.i JOIN windows b ON b.video_id = l.video_id AND b.w_idx = l.i + 1
           UNION SELECT video_id, total_frames FROM meta),
  chunks AS (SELECT video_id, row_number() OVER w - 1 AS chunk_idx, coalesce(lag(e) OVER w, 0) AS start_frame, e AS end_frame FROM cuts WINDOW w AS (PARTITION BY video_id ORDER BY e)),
  queries AS (SELECT video_id AS query_id, list(x ORDER BY j) AS emb FROM (SELECT video_id, j, avg(emb[j]) AS x FROM windows, unnest(range(1, 65)) AS r(j) GROUP BY ALL) GROUP BY 1),
  members AS (SELECT c.video_id, c.chunk_idx, w.w_idx, w.emb FROM chunks c JOIN windows w ON w.video_id = c.video_id AND w.t_sec >= c.start_frame / 30.0 AND w.t_sec < c.end_frame / 30.0),
  rel AS (SELECT w.video_id, q.query_id, w.w_idx, round(list_cosine_similarity(w.emb, q.emb), 6) AS score FROM windows w, queries q),
  scores AS (SELECT m.video_id, r.query_id, m.chunk_idx, max(r.score) AS score FROM members m JOIN rel r ON r.video_id = m.video_id AND r.w_idx = m.w_idx GROUP BY ALL),
  timed AS (SELECT s.*, c.start_frame / 30.0 AS start_sec, c.end_frame / 30.0 AS end_sec FROM scores s JOIN chunks c USING (video_id, chunk_idx)),
  preds AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_idx) AS rank, start_sec AS s, end_sec AS e, score FROM timed WHERE video_id = query_id),
  gts AS (SELECT query_id, k AS gt_idx, g AS s, g + 12 AS e FROM (SELECT video_id AS query_id, k, 2.0 * ((video_id * 7 + 3) % (total_frames / 60)) * CASE k WHEN 0 THEN 1.0 ELSE 0.5 END AS g FROM meta, (VALUES (0), (1)) v(k))),
  inter AS (SELECT p.query_id, p.rank, g.gt_idx, greatest(0, least(p.e, g.e) - greatest(p.s, g.s)) AS x, p.e - p.s + g.e - g.s AS u FROM preds p JOIN gts g USING (query_id)),
  ious AS (SELECT query_id, rank, gt_idx, CASE WHEN u - x > 0 THEN x / (u - x) ELSE 0 END AS iou FROM inter),
  best AS (SELECT query_id, rank, max(iou) AS iou FROM ious GROUP BY ALL)"""


def q(sql: str, more: str = "") -> str:
    return f"WITH {BASE}{', ' + more if more else ''} {sql}"


SERIES = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
ANSWERS = "SELECT *, coalesce(regexp_extract(upper(b), '[ABCD]') = chr(CAST(65 + conv_id % 4 AS INTEGER)), false) AS correct FROM (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(trim(text), 'The best answer is', ''), 'The correct answer is', ''), 'The answer is', ''), 'The answer', ''), 'The best option is', ''), 'The correct option is', ''), 'Best answer:', ''), 'Best option:', '') AS b FROM conversations)"
AP = """t(threshold) AS (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7)),
  claim AS (SELECT query_id, rank, arg_max(gt_idx, (iou, -gt_idx)) AS g, max(iou) AS iou FROM ious GROUP BY ALL),
  tp AS (SELECT c.*, threshold, CASE WHEN c.iou >= threshold AND c.iou > 0 AND NOT EXISTS (SELECT 1 FROM claim d WHERE d.query_id = c.query_id AND d.g = c.g AND d.rank < c.rank AND d.iou >= threshold) THEN 1 ELSE 0 END AS hit FROM claim c, t),
  pr AS (SELECT *, sum(hit) OVER w / row_number() OVER w AS p FROM tp WINDOW w AS (PARTITION BY query_id, threshold ORDER BY rank)),
  env AS (SELECT *, max(p) OVER (PARTITION BY query_id, threshold ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM pr),
  ap AS (SELECT query_id, threshold, sum(hit * e) / 2 AS ap FROM env GROUP BY ALL)"""
PER_DIM = "flat AS (SELECT video_id, chunk_idx, j, emb[j] AS x FROM members, unnest(range(1, 65)) AS r(j))"
UNIT = """mean AS (SELECT video_id, chunk_idx, j, avg(x) AS m FROM flat GROUP BY ALL), len AS (SELECT video_id, chunk_idx, sqrt(sum(m * m)) AS r FROM mean GROUP BY ALL)"""

SQL: dict[str, str] = {
    "w01_window_grid": q("SELECT video_id, CAST(k AS INTEGER) AS w_idx, k * 3.5::DOUBLE AS start_sec, least((k + 1) * 3.5::DOUBLE, total_frames / fps) AS end_sec FROM meta, unnest(range(0, CAST(ceil(total_frames / fps / 3.5) AS BIGINT))) AS u(k)"),
    "w02_first_interval": q("SELECT video_id, min(d) AS interval FROM (SELECT video_id, w_idx, t_sec - lag(t_sec) OVER (PARTITION BY video_id ORDER BY w_idx) AS d FROM windows) WHERE w_idx = 1 GROUP BY 1"),
    "w03_median_interval": q("SELECT video_id, median(d) AS interval FROM (SELECT video_id, t_sec - lag(t_sec) OVER (PARTITION BY video_id ORDER BY w_idx) AS d FROM windows) WHERE d > 0 GROUP BY 1"),
    "w04_adjacent_cosine": q("SELECT video_id, i, round(t_sec, 6) AS t_sec, round(value, 6) AS value FROM signal"),
    "w05_smooth_zero": "SELECT user_id, event_id, round(s / 4, 6) AS smooth FROM (SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id) AS n, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS s FROM events) WHERE n >= 4",
    "w06_smooth_edge": f"""WITH e AS (SELECT user_id, event_id, value, {SERIES} AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events),
        o AS (SELECT a.user_id, a.event_id, a.value, a.r, a.n, least(5, a.n) AS w, k FROM e a, unnest(range(0, 5)) AS u(k) WHERE k < least(5, a.n)),
        j AS (SELECT o.*, b.value AS v FROM o JOIN e b ON b.user_id = o.user_id AND b.r = least(greatest(o.r - o.w // 2 + o.k, 1), o.n))
        SELECT user_id, event_id, round(CASE WHEN any_value(n) <= 2 THEN any_value(value) ELSE sum(v) / any_value(w) END, 6) AS smooth FROM j GROUP BY user_id, event_id""",
    "w07_islands": f"SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM (SELECT user_id, event_id, r - row_number() OVER (PARTITION BY user_id ORDER BY r) AS g FROM (SELECT *, {SERIES} AS r FROM events) WHERE value > 50) GROUP BY user_id, g",
    "w09_peaks": f"""WITH d AS (SELECT user_id, CAST({SERIES} AS INTEGER) AS idx, abs(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) - value) AS strength FROM events),
        e AS (SELECT *, avg(strength) OVER (PARTITION BY user_id) + 0.75 * stddev_pop(strength) OVER (PARTITION BY user_id) AS t, lag(strength) OVER w AS a, lead(strength) OVER w AS b FROM d WHERE strength IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY idx))
        SELECT user_id, idx, round(strength, 6) AS strength FROM e WHERE strength >= t AND (a IS NULL OR strength >= a) AND (b IS NULL OR strength >= b)""",
    "w15_std_boundaries": q("SELECT * FROM low"),
    "w16_high_boundaries": q("SELECT video_id, i FROM (SELECT *, avg(value) OVER (PARTITION BY video_id) + stddev_pop(value) OVER (PARTITION BY video_id) AS t FROM signal) WHERE value > t"),
    "c02_std_chunks": q("SELECT * FROM chunks"),
    "c08_transitions": q("SELECT video_id, min(t_sec) AS start_sec, max(t_sec) AS end_sec FROM (SELECT *, i - row_number() OVER (PARTITION BY video_id ORDER BY i) AS g FROM signal WHERE value < 0) GROUP BY video_id, g HAVING max(t_sec) - min(t_sec) >= 2"),
    "c11_chunk_vectors": q("SELECT video_id, chunk_idx, list(round(m / CASE WHEN r < 1e-12 THEN 1 ELSE r END, 6) ORDER BY j) AS emb FROM mean JOIN len USING (video_id, chunk_idx) GROUP BY ALL", f"{PER_DIM}, {UNIT}"),
    "c14_uniform_chunks": q("SELECT video_id, CAST(k AS INTEGER) AS chunk_idx, CAST(trunc(k * ((total_frames - 1) / 6)) AS BIGINT) AS start_frame, CAST(trunc(k * ((total_frames - 1) / 6)) AS BIGINT) + 1 AS end_frame FROM meta, unnest(range(0, 7)) AS u(k)"),
    "c15_equal_split": q("SELECT video_id, CAST(k AS INTEGER) AS chunk_idx, CAST(trunc(k * total_frames / 7) AS BIGINT) AS start_frame, CAST(trunc((k + 1) * total_frames / 7) AS BIGINT) AS end_frame FROM meta, unnest(range(0, 7)) AS u(k)"),
    "c16_boundaries": q("SELECT video_id, round(start_frame / 30.0, 6) AS t FROM chunks WHERE chunk_idx > 0"),
    "c19_grouped_chunks": q("SELECT video_id, CAST(chunk_idx // CAST(ceil(n / 4) AS BIGINT) AS INTEGER) AS group_idx, min(start_frame) AS start_frame, max(end_frame) AS end_frame FROM (SELECT *, count(*) OVER (PARTITION BY video_id) AS n FROM chunks) GROUP BY ALL"),
    "j02_windows_to_chunks": q("SELECT w.video_id, w.w_idx, coalesce(max(c.chunk_idx), -1) AS chunk_idx FROM windows w LEFT JOIN chunks c ON c.video_id = w.video_id AND w.t_sec >= c.start_frame / 30.0 AND w.t_sec < c.end_frame / 30.0 GROUP BY ALL"),
    "j05_aligned_subtitles": "WITH n AS (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY 1) SELECT DISTINCT c.conv_id AS video_id, round(turn * 3.0::DOUBLE, 3) AS start_sec, round(turn * 3.0::DOUBLE + 2.5, 3) AS end_sec, text FROM conversations c JOIN n USING (conv_id) WHERE turn * 3.0 <= least(6, n * 3)",
    "a01_mean": q("SELECT video_id, chunk_idx, list(round(m / CASE WHEN r < 1e-12 THEN 1 ELSE r END, 6) ORDER BY j) AS emb, round(any_value(r), 6) AS coherence FROM mean JOIN len USING (video_id, chunk_idx) GROUP BY video_id, chunk_idx", f"{PER_DIM}, {UNIT}"),
    "a06_max_sim": q("SELECT video_id, chunk_idx, list(round(m / (r + 1e-8), 6) ORDER BY j) AS emb, round(any_value(r), 6) AS coherence FROM mean JOIN len USING (video_id, chunk_idx) GROUP BY video_id, chunk_idx", f"{PER_DIM}, {UNIT}"),
    "a02_gem": q(
        "SELECT video_id, chunk_idx, list(round(v / s, 6) ORDER BY j) AS emb, round(any_value(r), 6) AS coherence FROM gem JOIN total USING (video_id, chunk_idx) JOIN len USING (video_id, chunk_idx) GROUP BY video_id, chunk_idx",
        f"{PER_DIM}, {UNIT}, gem AS (SELECT video_id, chunk_idx, j, sign(m) * pow(abs(m), 1 / 3::DOUBLE) AS v FROM (SELECT video_id, chunk_idx, j, avg(sign(x) * pow(abs(x), 3)) AS m FROM flat GROUP BY ALL)), total AS (SELECT video_id, chunk_idx, sqrt(sum(v * v)) AS s FROM gem GROUP BY ALL)",
    ),
    "a04_lse": q(
        "SELECT video_id, chunk_idx, list(round(v / s, 6) ORDER BY j) AS emb, round(any_value(r), 6) AS coherence FROM lse JOIN total USING (video_id, chunk_idx) JOIN len USING (video_id, chunk_idx) GROUP BY video_id, chunk_idx",
        f"{PER_DIM}, {UNIT}, lse AS (SELECT video_id, chunk_idx, j, ln(avg(exp(10 * x))) / 10 AS v FROM flat GROUP BY ALL), total AS (SELECT video_id, chunk_idx, sqrt(sum(v * v)) AS s FROM lse GROUP BY ALL)",
    ),
    "a03_coherence_mean": q(
        "SELECT video_id, chunk_idx, list(round(v / s, 6) ORDER BY j) AS emb, round(any_value(r), 6) AS coherence FROM coh JOIN total USING (video_id, chunk_idx) JOIN len USING (video_id, chunk_idx) GROUP BY video_id, chunk_idx",
        f"""{PER_DIM}, {UNIT}, pairs AS (SELECT a.video_id, a.chunk_idx, a.w_idx, 10 * list_dot_product(a.emb, b.emb) AS l FROM members a JOIN members b USING (video_id, chunk_idx)),
        tops AS (SELECT video_id, chunk_idx, w_idx, max(l) AS m FROM pairs GROUP BY ALL), wts AS (SELECT video_id, chunk_idx, w_idx, sum(exp(l - m)) AS w FROM pairs JOIN tops USING (video_id, chunk_idx, w_idx) GROUP BY ALL),
        coh AS (SELECT m.video_id, m.chunk_idx, j, sum(w * emb[j]) AS v FROM members m JOIN wts USING (video_id, chunk_idx, w_idx), unnest(range(1, 65)) AS r(j) GROUP BY ALL), total AS (SELECT video_id, chunk_idx, sqrt(sum(v * v)) AS s FROM coh GROUP BY ALL)""",
    ),
    "a08_normalize": "SELECT vec_id, list_transform(e, lambda x: round(x / sqrt(list_dot_product(e, e)), 6)) AS unit, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
    "r01_chunk_cosine": q("SELECT v.video_id, q.query_id, v.chunk_idx, round(list_cosine_similarity(v.emb, q.emb), 6) AS score FROM (SELECT video_id, chunk_idx, list(m ORDER BY j) AS emb FROM mean GROUP BY ALL) v, queries q", f"{PER_DIM}, {UNIT}"),
    "r02_max_sim": q("SELECT * FROM scores"),
    "r03_round_robin": q("SELECT video_id, query_id, w_idx, CAST(130 // n + CASE WHEN r <= 130 % n THEN 1 ELSE 0 END AS INTEGER) AS frames FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY score DESC, w_idx) AS r, count(*) OVER (PARTITION BY video_id, query_id) AS n FROM rel)"),
    "r04_neighbours": q("SELECT video_id, query_id, w_idx, step FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY w_idx < b, abs(w_idx - b)) AS step FROM (SELECT *, first_value(w_idx) OVER (PARTITION BY video_id, query_id ORDER BY score DESC, w_idx) AS b FROM rel)) WHERE step <= 8"),
    "r07_ranked_chunks": q("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY score DESC, chunk_idx) AS rank FROM scores) WHERE rank <= 10"),
    "r09_preselected": q("SELECT video_id, query_id, chunk_idx, row_number() OVER (PARTITION BY video_id, query_id ORDER BY chunk_idx) AS position FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY score DESC, chunk_idx) AS rank FROM scores) WHERE rank <= 5"),
    "m02_top_gap": q(
        "SELECT video_id, query_id, min(start_sec) AS start_sec, max(end_sec) AS end_sec, max(score) AS score, true AS is_selected FROM g WHERE keep GROUP BY video_id, query_id, i UNION ALL SELECT video_id, query_id, start_sec, end_sec, score, false FROM k WHERE NOT keep",
        "k AS (SELECT *, score >= max(score) OVER (PARTITION BY video_id, query_id) - 0.06::DOUBLE AS keep FROM timed), g AS (SELECT *, chunk_idx - row_number() OVER (PARTITION BY video_id, query_id ORDER BY chunk_idx) AS i FROM k WHERE keep)",
    ),
    "f05_intra_chunk_greedy": q(
        "SELECT video_id, query_id, w_idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY late, score DESC, w_idx) AS z FROM f) WHERE z <= 8",
        """a AS (SELECT r.*, m.chunk_idx, max(score) OVER (PARTITION BY r.video_id, query_id, m.chunk_idx) AS peak, row_number() OVER (PARTITION BY r.video_id, query_id, m.chunk_idx ORDER BY score DESC, r.w_idx) AS k FROM rel r JOIN members m USING (video_id, w_idx)),
        b AS (SELECT *, dense_rank() OVER (PARTITION BY video_id, query_id ORDER BY peak DESC, chunk_idx) AS place FROM a), c AS (SELECT *, max(place) OVER (PARTITION BY video_id, query_id) AS n FROM b),
        f AS (SELECT *, CASE WHEN k <= CASE WHEN n >= 8 THEN CASE WHEN place <= 8 THEN 1 ELSE 0 END ELSE 8 // n + CASE WHEN place <= 8 % n THEN 1 ELSE 0 END END THEN 0 ELSE 1 END AS late FROM c)""",
    ),
    "f14_uniform_topk": q(
        "SELECT video_id, query_id, w_idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY CASE WHEN w_idx IN (0, (m - 1) // 3, 2 * (m - 1) // 3, m - 1) THEN 0 ELSE 1 END, score DESC, w_idx) AS z FROM (SELECT *, count(*) OVER (PARTITION BY video_id, query_id) AS m FROM rel)) WHERE z <= 8"
    ),
    "f17_middle_frames": q("SELECT video_id, chunk_idx, CAST((start_frame + end_frame) // 2 AS BIGINT) AS frame FROM chunks"),
    "f18_interior_frames": q("SELECT video_id, chunk_idx, CAST(k AS INTEGER) AS k, greatest(start_frame, least(end_frame - 1, CAST(trunc(start_frame + k * (end_frame - start_frame) / 4) AS BIGINT))) AS frame FROM chunks, unnest(range(1, 4)) AS u(k)"),
    "e02_best_iou": q("SELECT query_id, rank, round(iou, 6) AS iou FROM best"),
    "e03_recall": q("SELECT k, threshold, round(avg(h), 6) AS recall FROM (SELECT query_id, k, threshold, max(CASE WHEN rank <= k AND iou >= threshold THEN 1 ELSE 0 END) AS h FROM best, (VALUES (1), (5)) a(k), (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7)) b(threshold) GROUP BY ALL) GROUP BY ALL"),
    "e04_average_precision": q("SELECT query_id, threshold, round(ap, 6) AS ap FROM ap", AP),
    "e05_map": q("SELECT threshold, round(avg(ap), 6) AS map FROM ap GROUP BY 1", AP),
    "e06_mean_iou": q("SELECT round(avg(iou), 6) AS miou FROM best WHERE rank = 1"),
    "e07_binary_ap": "WITH a AS (SELECT user_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events), b AS (SELECT *, sum(y) OVER (PARTITION BY user_id ORDER BY n) / n AS p FROM a), c AS (SELECT *, max(p) OVER (PARTITION BY user_id ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM b) SELECT user_id, round(CASE WHEN sum(y) > 0 THEN sum(y * e) / sum(y) ELSE 0 END, 6) AS ap FROM c GROUP BY 1",
    "e12_macro_accuracy": f"SELECT round(avg(a), 6) AS macro, round(sum(s) / sum(n), 6) AS micro FROM (SELECT role, avg(CAST(correct AS INTEGER)) AS a, count(*) AS n, sum(CAST(correct AS INTEGER)) AS s FROM ({ANSWERS}) GROUP BY 1)",
    "e10_accuracy_breakdown": f"WITH a AS ({ANSWERS}), b AS (SELECT 'all' AS category, 'all' AS value, correct FROM a UNION ALL SELECT 'role', role, correct FROM a UNION ALL SELECT 'turn', CAST(turn AS VARCHAR), correct FROM a) SELECT category, value, count(*) AS n, round(avg(CAST(correct AS INTEGER)), 6) AS accuracy FROM b WHERE trim(coalesce(value, '')) <> '' GROUP BY ALL",
    "t27_standalone_letter": f"SELECT conv_id, turn, nullif(regexp_extract(upper(text), '(?:^|[^A-Za-z0-9_])([ABCD])(?:$|[^A-Za-z0-9_])', 1), '') AS letter, nullif(regexp_extract(upper(b), '[ABCD]'), '') AS any_letter FROM ({ANSWERS})",
    "t30_slug": "SELECT page_id, CASE WHEN coalesce(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), '') = '' THEN 'unknown' ELSE trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') END AS slug FROM pages",
    "t31_tokens": "SELECT page_id, regexp_extract_all(lower(coalesce(url, '')), '[a-z0-9]+') AS tokens FROM pages",
    "p01_keep_subset": "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    "p05_resume": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "p11_frames_of_seconds": q("SELECT video_id, w_idx, CAST(trunc(t_sec * 30) AS BIGINT) AS frame, CAST(ceil(t_sec * 29.97::DOUBLE) AS BIGINT) AS frame_up FROM windows"),
    "o_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice), 6) AS total, round(avg(l_discount), 6) AS discount, round(stddev_pop(l_quantity), 6) AS spread FROM lineitem GROUP BY ALL",
    "g02_iou_histogram": q("SELECT CAST(least(floor(iou * 20), 19) AS INTEGER) AS bin, count(*) AS n FROM best GROUP BY 1"),
    "g05_chunk_durations": q("SELECT round(avg(s), 6) AS mean, round(median(s), 6) AS median, count(*) AS n FROM (SELECT (end_frame - start_frame) / 30.0 AS s FROM chunks)"),
    "g12_correct_examples": f"SELECT conv_id, turn, correct FROM (SELECT *, row_number() OVER (PARTITION BY correct ORDER BY conv_id, turn) AS r FROM ({ANSWERS})) WHERE r <= 3",
    "g16_segments": q("SELECT video_id, round(start_frame / 30.0, 6) AS start_sec, round(end_frame / 30.0, 6) AS end_sec FROM chunks"),
    "s05_question_answers": "SELECT q.conv_id * 100 + q.turn AS question_id, 'v_c' || q.conv_id AS video_id, q.text AS question, a.text AS gt_answer, a.turn % 9 AS answer_type FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 WHERE q.role = 'user' AND a.role = 'assistant'",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "event_sessions": "WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM a) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, round(sum(value), 6) AS total FROM b GROUP BY ALL",
}
