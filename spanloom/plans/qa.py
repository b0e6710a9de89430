"""Queries of the question-answering operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import metrics, qa, reports, scoring
from spanloom.plans import views as V
from spanloom.plans.queries import r6
from spanloom.plans.sql import BASE

R: dict = {}
SQL: dict[str, str] = {}
STANDS = "'(?:^|[^A-Za-z0-9_])([ABCD])(?:$|[^A-Za-z0-9_])'"
LETTER = f"nullif(regexp_extract(upper({{}}), {STANDS}, 1), '')"


def query(sql: str):
    def add(f):
        R[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def q(sql: str) -> str:
    return f"WITH RECURSIVE {BASE} {sql}"


def _talk(s, d):
    """Conversations as answers: a letter is expected, and every fifth row is answered by one."""
    c = V.table(s, d, "conversations")
    said = F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, F.concat(F.lit("("), F.char((F.col("conv_id") + F.col("turn")) % 3 + 65), F.lit(") it is"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", "role", (F.col("conv_id") * 1000 + F.col("turn")).alias("sample_id"), said.alias("said"), F.concat(F.lit("("), F.char(F.col("conv_id") % 4 + 65), F.lit(")")).alias("truth"), "text")


TALK = "(SELECT conv_id, turn, role, conv_id * 1000 + turn AS sample_id, CASE WHEN (conv_id + turn) % 5 = 0 THEN '(' || chr(CAST((conv_id + turn) % 3 + 65 AS INTEGER)) || ') it is' ELSE text END AS said, '(' || chr(CAST(conv_id % 4 + 65 AS INTEGER)) || ')' AS truth, text FROM conversations)"
MATCH = f"coalesce({LETTER.format('said')} = {LETTER.format('truth')}, false)"
MATCHED = f"(SELECT *, {MATCH} AS ok FROM {TALK})"


@query(f"SELECT sample_id, ok AS matched FROM {MATCHED}")
def t28_letter_match(s, d):
    return _talk(s, d).select("sample_id", qa.letter_match(F.col("said"), F.col("truth")).alias("matched"))


@query(f"SELECT round(avg(CASE WHEN said = truth || ' it is' THEN 1 ELSE 0 END), 6) AS accuracy FROM {TALK}")
def t33_exact_match(s, d):
    return r6(qa.exact_match(_talk(s, d).withColumn("full", F.concat("truth", F.lit(" it is"))), "said", "full"), "accuracy")


@query(f"SELECT sample_id, said AS predicted, truth, CASE WHEN turn % 2 = 0 THEN {LETTER.format('said')} END AS predicted_letter, CASE WHEN turn % 2 = 0 THEN {LETTER.format('truth')} END AS truth_letter, coalesce({LETTER.format('said')} = {LETTER.format('truth')}, said = truth, false) AS correct FROM {TALK}")
def t35_result_rows(s, d):
    return qa.result_rows(_talk(s, d), F.col("sample_id"), F.col("said"), F.col("truth"), F.col("turn") % 2 == 0)


@query("SELECT sample_id, state, CASE WHEN state = 'selected' THEN 1.0 END AS score, CASE state WHEN 'no_match' THEN 'no matching chunk' WHEN 'failed' THEN 'no chunk number' END AS reason FROM (SELECT conv_id * 1000 + turn AS sample_id, CASE WHEN conv_id % 7 BETWEEN 1 AND 4 THEN 'selected' WHEN conv_id % 7 = 0 THEN 'no_match' ELSE 'failed' END AS state FROM conversations)")
def t36_selection_rows(s, d):
    return qa.selection_rows(_talk(s, d), F.col("conv_id") % 7, F.lit(4)).select("sample_id", "state", "score", "reason")


@query(f"SELECT metric, round(avg(CAST(ok AS INTEGER)), 6) AS value FROM (SELECT ok, unnest(['Accuracy', 'Accuracy_' || role, 'Accuracy_turn_' || (turn % 3)]) AS metric FROM {MATCHED}) GROUP BY 1")
def e11_accuracy_by_tag(s, d):
    c = _talk(s, d).withColumn("ok", qa.letter_match(F.col("said"), F.col("truth"))).withColumn("tags", F.array("role", F.concat(F.lit("Turn  "), (F.col("turn") % 3).cast("string"))))
    return r6(qa.accuracy_by_tag(c, "ok", "tags"), "value")


@query(f"WITH a AS (SELECT *, conv_id % 3 AS g FROM {MATCHED} WHERE conv_id % 6 <> 0) SELECT metric, round(avg(CAST(ok AS INTEGER)), 6) AS value FROM (SELECT ok, unnest(['Accuracy', 'Accuracy_duration_group_' || g, 'Accuracy_question_category_' || role]) AS metric FROM a) GROUP BY 1")
def e13_accuracy_of_labelled(s, d):
    c = _talk(s, d).withColumn("ok", qa.letter_match(F.col("said"), F.col("truth"))).withColumn("g", F.col("conv_id") % 3).withColumn("given", F.when(F.col("conv_id") % 6 != 0, F.col("truth")).when(F.col("conv_id") % 12 == 0, " "))
    return r6(qa.accuracy_by_group(qa.labelled(c, "given"), "ok", {"g": "Accuracy_duration_group_", "role": "Accuracy_question_category_"}), "value")


DIRECTIONS = """, qq AS (SELECT a.query_id AS x, b.query_id AS y, round(list_cosine_similarity(a.emb, b.emb), 6) AS score FROM queries a, queries b),
  pairs AS (SELECT 'text_to_clip' AS direction, query_id AS asked, video_id * 100000 + w_idx AS item, query_id * 100000 + 3 AS target, score FROM rel
    UNION ALL SELECT 'clip_to_text', video_id * 100000 + w_idx, query_id, video_id, score FROM rel WHERE w_idx = 3
    UNION ALL SELECT 'text_to_video', x, y, x, score FROM qq UNION ALL SELECT 'video_to_text', y, x, y, score FROM qq),
  placed AS (SELECT *, row_number() OVER (PARTITION BY direction, asked ORDER BY score DESC, item) AS rank FROM pairs)
  SELECT direction, k, round(avg(CASE WHEN rank <= k THEN 1 ELSE 0 END), 6) AS pass_rate FROM placed, (VALUES (1), (2), (5)) v(k) WHERE item = target GROUP BY ALL"""


@query(q(DIRECTIONS))
def e17_pass_in_four_directions(s, d):
    w, t = V.windows(s, d), V.queries(s, d)
    clips = w.select((F.col("video_id") * 100000 + F.col("w_idx")).alias("item"), "emb")
    forth = r6(scoring.relevance(clips, t, ["item"]), "score").select(F.col("query_id").alias("asked"), "item", "score")
    whole = r6(scoring.relevance(t.select(F.col("query_id").alias("item"), "emb"), t, ["item"]), "score").select(F.col("query_id").alias("asked"), "item", "score")
    back = lambda x: x.select(F.col("item").alias("asked"), F.col("asked").alias("item"), "score")
    out = None
    for name, pairs, target in (
        ("text_to_clip", forth, F.col("asked") * 100000 + 3), ("clip_to_text", back(forth).where("asked % 100000 = 3"), F.floor(F.col("asked") / 100000)),
        ("text_to_video", whole, F.col("asked")), ("video_to_text", back(whole), F.col("asked")),
    ):
        ranks = scoring.ranked(pairs, ["asked"], "item").withColumnRenamed("asked", "query_id")
        targets = ranks.select("query_id").distinct().withColumn("asked", F.col("query_id")).select("query_id", target.alias("target"))
        got = r6(metrics.pass_at(ranks.select("query_id", "item", "rank"), targets, (1, 2, 5), "item"), "pass_rate").select(F.lit(name).alias("direction"), "k", "pass_rate")
        out = got if out is None else out.unionByName(got)
    return out


@query(q(""", dur AS (SELECT video_id AS query_id, total_frames / 30.0 AS duration FROM meta),
  clip AS (SELECT query_id, unnest(range(0, greatest(1, CAST(trunc(duration / 2.0) AS BIGINT)))) AS clip FROM dur),
  raw AS (SELECT c.query_id, c.clip, greatest(0.0, coalesce(max(p.score * greatest(0.0, least(p.e, (c.clip + 1) * 2.0) - greatest(p.s, c.clip * 2.0)) / 2.0), 0.0)) AS x FROM clip c LEFT JOIN preds p USING (query_id) GROUP BY ALL),
  scored AS (SELECT query_id, clip, round(CASE WHEN max(x) OVER w > min(x) OVER w THEN (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) ELSE x END, 6) AS score FROM raw WINDOW w AS (PARTITION BY query_id)),
  lab AS (SELECT query_id, annotator, clip, (query_id * 3 + clip * 5 + annotator * 2) % 5 AS saliency FROM scored, (VALUES (0), (1), (2)) v(annotator) WHERE clip % 2 = 0),
  y AS (SELECT t AS threshold, query_id, annotator, clip, score, CASE WHEN coalesce(saliency, 0) >= t THEN 1 ELSE 0 END AS y FROM (SELECT * FROM scored, (VALUES (0), (1), (2)) v(annotator), (VALUES (2), (3), (4)) u(t)) s LEFT JOIN lab USING (query_id, annotator, clip)),
  n AS (SELECT *, row_number() OVER (PARTITION BY threshold, query_id, annotator ORDER BY score DESC, clip) AS n FROM y),
  p AS (SELECT *, sum(y) OVER (PARTITION BY threshold, query_id, annotator ORDER BY n) / n AS p FROM n),
  e AS (SELECT *, max(p) OVER (PARTITION BY threshold, query_id, annotator ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM p),
  each AS (SELECT threshold, query_id, annotator, CASE WHEN sum(y) > 0 THEN sum(y * e) / sum(y) ELSE 0 END AS ap, max(CASE WHEN n = 1 THEN y END) AS top FROM e GROUP BY ALL),
  hit AS (SELECT threshold, query_id, max(top) AS hit FROM each GROUP BY ALL)
  SELECT threshold, round(h.hit1, 6) AS hit1, round(m.map, 6) AS map FROM (SELECT threshold, avg(hit) AS hit1 FROM hit GROUP BY 1) h JOIN (SELECT threshold, avg(ap) AS map FROM each GROUP BY 1) m USING (threshold)"""))
def e09_highlights(s, d):
    dur = V.meta(s, d).select(F.col("video_id").alias("query_id"), (F.col("total_frames") / F.col("fps")).alias("duration"))
    clips = r6(metrics.clip_scores(V.predictions(s, d), dur), "score").select("query_id", "clip", "score")
    marks = clips.where("clip % 2 = 0").select("query_id", "clip", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("annotator"))
    marks = marks.withColumn("saliency", (F.col("query_id") * 3 + F.col("clip") * 5 + F.col("annotator") * 2) % 5)
    return r6(qa.highlights(clips, marks), "hit1", "map")


@query("SELECT conv_id, label, min(turn) AS first_position, list(turn ORDER BY turn) AS positions FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'at start' ELSE role END AS label FROM conversations) GROUP BY ALL")
def s04_grouped_windows(s, d):
    raw = F.when(F.col("turn") % 3 == 0, '"at_start"').otherwise(F.concat(F.lit('"'), "role", F.lit('" ')))
    return qa.grouped_windows(V.table(s, d, "conversations"), ["conv_id"], raw, "turn")


@query("SELECT 'video-' || c_custkey AS id, c_name AS text, NULL AS part FROM customer UNION ALL SELECT 'clip-' || s_suppkey, s_name, s_nationkey FROM supplier")
def s07_two_kinds(s, d):
    a = V.table(s, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("text"))
    b = V.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("text"), F.col("s_nationkey").alias("part"))
    return qa.two_kinds(a, b, ("video-", "clip-"))


@query("SELECT conv_id, turn, trim(p[1]) AS question, len(p) - 1 AS n_options, trim(p[2]) AS first_option FROM (SELECT conv_id, turn, regexp_split_to_array('What ' || turn || '? ' || chr(10) || '(A) ' || role || chr(10) || '(B)  none of ' || conv_id, '\\n\\([A-Z]\\) ') AS p FROM conversations)")
def s09_question_options(s, d):
    raw = F.concat(F.lit("What "), F.col("turn").cast("string"), F.lit("? \n(A) "), "role", F.lit("\n(B)  none of "), F.col("conv_id").cast("string"))
    body, options = qa.question_and_options(raw)
    return V.table(s, d, "conversations").select("conv_id", "turn", body.alias("question"), F.size(options).cast("long").alias("n_options"), options[0].alias("first_option"))


@query("SELECT doc_id, source, n_chars FROM documents WHERE lower(lang) = 'en'")
def s10_split_scan(s, d):
    return V.table(s, d, "documents").where(F.lower("lang") == "en").select("doc_id", "source", "n_chars")


@query("SELECT conv_id, turn, CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' END AS letter FROM conversations")
def s11_answer_letter(s, d):
    options = F.array(F.lit(" user"), F.lit("assistant "), F.lit("user"))
    return V.table(s, d, "conversations").select("conv_id", "turn", qa.answer_letter(options, F.concat(F.lit(" "), "role")).alias("letter"))


@query("SELECT o_orderkey, o_custkey, o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS skipped FROM orders")
def j13_surviving_targets(s, d):
    gallery = V.table(s, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return qa.surviving(V.table(s, d, "orders").select("o_orderkey", "o_custkey"), gallery, "o_custkey")


@query("WITH a AS (SELECT page_id, regexp_extract(url, '/([0-9]+)(?:$|[?#])', 1) AS key FROM pages) SELECT page_id, key, d.doc_id AS doc_id FROM a JOIN documents d ON a.key = CAST(d.doc_id AS VARCHAR)")
def j14_sidecar(s, d):
    a = V.table(s, d, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)(?:$|[?#])", 1).alias("key"))
    b = V.table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"))
    return a.join(b, "key").select("page_id", "key", "doc_id")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j16_missing_tolerated(s, d):
    return V.table(s, d, "documents").select("doc_id").join(V.table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query(f"SELECT sample_id FROM {TALK} WHERE conv_id % 6 <> 0")
def p08_labelled(s, d):
    c = _talk(s, d).withColumn("given", F.when(F.col("conv_id") % 6 != 0, F.col("truth")).when(F.col("conv_id") % 12 == 0, " "))
    return qa.labelled(c, "given").select("sample_id")


@query("SELECT event_id FROM events WHERE user_id % 5 <> 0")
def p09_finite(s, d):
    v = F.when(F.col("user_id") % 10 == 0, float("nan")).when(F.col("user_id") % 5 == 0, float("inf")).otherwise(F.col("value"))
    return V.table(s, d, "events").withColumn("v", v).where(~F.isnan("v") & (F.abs("v") < float("inf"))).select("event_id")


@query("SELECT user_id, min(event_id) AS first_event FROM events GROUP BY 1")
def p10_distinct_videos(s, d):
    return V.table(s, d, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"))


@query(q(", m AS (SELECT b.query_id, iou, n FROM best b JOIN (SELECT video_id AS query_id, count(*) AS n FROM chunks GROUP BY 1) USING (query_id) WHERE rank = 1) SELECT count(*) AS n, round(CASE WHEN count(*) >= 3 THEN regr_slope(iou, n) END, 6) AS slope, round(CASE WHEN count(*) >= 3 THEN regr_intercept(iou, n) END, 6) AS intercept FROM m"))
def g04_trend_by_chunks(s, d):
    best = metrics.best_iou(V.predictions(s, d), V.truths(s, d)).where("rank = 1")
    n = V.chunks(s, d).groupBy(F.col("video_id").alias("query_id")).agg(F.count("*").alias("chunks"))
    return r6(reports.trend(best.join(n, "query_id"), "chunks", "iou"), "slope", "intercept")


@query(q(" SELECT query_id, round(iou, 6) AS iou FROM best WHERE rank = 1 ORDER BY iou, query_id LIMIT 5"))
def g07_failures(s, d):
    best = r6(metrics.best_iou(V.predictions(s, d), V.truths(s, d)).where("rank = 1"), "iou")
    return best.orderBy("iou", "query_id").limit(5).select("query_id", "iou")


@query("SELECT user_id, round(CASE WHEN user_id % 4 = 0 THEN 50.0 WHEN user_id % 4 = 1 THEN 60.0 WHEN user_id % 4 = 2 THEN max(value) * 1.05 ELSE 100.0 END, 6) AS duration FROM events GROUP BY user_id")
def g08_duration(s, d):
    e = V.table(s, d, "events").groupBy("user_id").agg(F.max("value").alias("last"))
    k = F.col("user_id") % 4
    return e.select("user_id", F.round(qa.inferred_duration(F.when(k == 0, 50.0).when(k == 1, 0.0), F.when(k == 1, 60.0), F.when(k == 2, F.col("last")).when(k < 2, 7.0)), 6).alias("duration"))


@query(f"SELECT place, sample_id, ok FROM (SELECT *, row_number() OVER (ORDER BY t, ok DESC, sample_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY ok ORDER BY sample_id) AS t FROM {MATCHED})) WHERE place <= 9")
def g13_alternating(s, d):
    c = _talk(s, d).select("sample_id", qa.letter_match(F.col("said"), F.col("truth")).alias("ok"))
    return qa.alternating(c, "ok", ["sample_id"], 9).select("place", "sample_id", "ok")


@query(q(" SELECT query_id, arg_max(chunk_idx, struct_pack(a := score, b := -chunk_idx)) AS chunk_idx, max(score) AS score FROM scores WHERE video_id = query_id GROUP BY 1"))
def r11_top_chunk(s, d):
    c = V.chunk_scores(s, d).where("video_id = query_id")
    return c.groupBy("query_id").agg(F.max_by("chunk_idx", F.struct("score", -F.col("chunk_idx"))).alias("chunk_idx"), F.max("score").alias("score"))


@query("SELECT conv_id AS video_id, string_agg('[' || lpad(CAST(CAST(floor((turn * 3 + 60) / 3600) AS INTEGER) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor((turn * 3 + 60) / 60) AS INTEGER) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((turn * 3 + 60) % 60 AS VARCHAR), 2, '0') || '] ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY 1")
def t10_transcript(s, d):
    return qa.transcript(V.subtitles(s, d), "video_id", "start_sec", "text", 60.0, True)


@query("SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN false WHEN conv_id % 2 = 0 THEN false ELSE true END AS shown, CASE WHEN turn % 2 = 0 THEN 'question' ELSE 'video' END AS source FROM conversations")
def t01_flags_and_sources(s, d):
    c = V.table(s, d, "conversations")
    shown = F.coalesce(F.when(F.col("turn") % 3 == 0, False), F.when(F.col("conv_id") % 2 == 0, False), F.lit(True))
    source = F.coalesce(F.when(F.col("turn") % 2 == 0, "question"), F.lit("video"))
    return c.select("conv_id", "turn", shown.alias("shown"), source.alias("source"))

