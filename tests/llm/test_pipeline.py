"""The pipeline on a small corpus: every stage's decisions, and odd rows."""

import numpy as np

import corpus_pipeline as P


def test_pipeline_stages(spark, tmp_path):
    rng = np.random.default_rng(1)
    pool, rude = [f"word{k}" for k in range(900)], ["gronkle", "blarfed", "snorvix", "quzzlim"]
    say = lambda n: list(rng.choice(pool, n))
    rows, labels = [], []
    for i in range(240):
        w = say(60)
        if i % 4 == 0:
            for k in rng.integers(0, 60, 8):
                w[k] = rude[int(rng.integers(4))]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        labels.append((i, int(i % 4 == 0)))
    item = " ".join(say(30))
    rows += [(1001, " ".join(say(20)) + " " + item, "en", "s1", 0), (1002, rows[1][1], "en", "s1", 0), (1003, None, "en", "s1", 0), (1004, "", None, None, 0), (None, " ".join(say(30)), "en", "s2", 0)]
    lines = "\n".join(" ".join(say(8)) for _ in range(4))
    rows += [(1005, " ".join(say(40)) + "\n" + lines, "en", "s0", 0), (1006, " ".join(say(40)) + "\n" + lines, "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = f"{tmp_path}/{k}"
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == list(P.COLUMNS), name
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if k == 0:
            assert sum(i % 4 == 0 for i in ids if i is not None and i < 240) <= 6 and len([i for i in ids if i is not None and i % 4 and i < 240]) >= 175
        if k == 1:
            assert lines not in docs.where("doc_id = 1006").first().text and lines in docs.where("doc_id = 1005").first().text
        if k == 2:
            assert 1 in ids and 1002 not in ids and None in ids
        if k == 3:
            assert 1001 not in ids and {1003, 1004} <= ids
    mixed = P.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert mixed and all(len(r.text.split()) == r.take_words for r in mixed)
    assert P.STAGES[-1][1](spark, docs.where("false"), str(tmp_path)).count() == 0
