"""The ten operators on small tables with nulls, empty texts, ties, repeated rows, clashing extra columns and no rows, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from spanloom.llm import lm_score, suffix_dedup, tokens, toxicity, vectors
from spanloom.llm.common import Scratch, components
from spanloom.llm.decontaminate import Items, edits, find_leaks, hashed_words
from spanloom.llm.line_dedup import dedup_lines
from spanloom.llm.minhash import near_duplicates
from spanloom.llm.mixing import mix, training_order
from spanloom.llm.queries import op8_mix_sources
from spanloom.llm.url_filter import Automaton, Rule, filter_urls

DOCS = "doc_id long, text string, source string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def corpus():
    rng = np.random.default_rng(3)
    pool = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choice(pool, 60)) for _ in range(12)]
    near = [" ".join(base[0].split()[:30] + ["changed"] + base[0].split()[31:]), " ".join(["new"] + base[1].split())]
    passage = " ".join(rng.choice(pool, 40))
    shared = [f"{base[5]} {passage} end{i}" for i in range(3)]
    texts = [*base, *near, base[0], base[0], *shared, None, "", "  \n ", "one two", "one two", "a b c d e", "é ñ ü Ünï " * 30, "x" * 5000]
    rows = [(i, t, None if i % 5 == 0 else f"s{i % 3}") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, base[0], "s1"), (None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_minhash_against_brute_force(docs, none):
    rows = corpus()
    sets = {}
    for i, t, _ in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert near_duplicates(none).count() == 0


def test_minhash_loose_group_lists_documents(spark, monkeypatch):
    """A loose group whose pairs are candidates but mostly no links: what is kept grows with its documents, not its pairs; of repeated ids each text counts."""
    rng = np.random.default_rng(17)
    base = [f"t{k}" for k in range(300)]
    rows = []
    for i in range(120):  # five to seven words of its own: most pairs share 0.65 to 0.75
        w = list(base)
        for k in rng.choice(300, int(rng.integers(5, 8)), replace=False):
            w[k] = f"own{i}_{k}"
        rows.append((i, " ".join(w), "s"))
    other = [f"u{k}" for k in range(300)]
    rows += [(5, " ".join(other), "s"), (200, " ".join(other[:299] + ["v"]), "s")]
    sets: dict = {}
    for i, t, _ in rows:
        sets.setdefault(i, []).append(shingles(t))
    comp = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and any(100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    for _ in range(20):
        for a, b in pairs:
            comp[a] = comp[b] = min(comp[a], comp[b])
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: (lambda out: (kept.append(out.count() if {"a", "b"} <= set(out.columns) or "others" in out.columns else 0), out)[1])(keep(self, df)))
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == set(comp.items()) and len(set(comp.values())) > 30
    assert 0 < max(kept) <= 4 * len(rows)  # over a thousand listed pairs before


def test_minhash_large_groups(spark):
    """Near copies in a group far over the size of a small node, and a stray that only one of them links."""
    rng = np.random.default_rng(5)
    base = [f"t{k}" for k in range(200)]
    rows = []
    for i in range(300):
        w = list(base)
        w[int(rng.integers(200))] = f"own{i}"
        rows.append((i, " ".join(w), "s"))
    got = near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert {r.component_id for r in got} == {0}


def test_minhash_rows_that_share_an_id_are_one_node(spark):
    """The texts of an id join their components, also over a third document; blank rows keep their id."""
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (7, b, "s"), (7, " ", "s"), (9, "c d e f g", "s")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [(3, 36, 3), (5, 36, 3), (5, 36, 3), (7, 0, 7), (7, 36, 3), (9, 1, 9)]


def test_minhash_pairs_stay_few_in_large_groups(spark, monkeypatch):
    """2,000 near copies make a few pairs for each document, and 600 texts that share a passage but aren't alike make no pair of texts."""
    from spanloom.llm import minhash

    rng = np.random.default_rng(6)
    base, common = [f"t{k}" for k in range(300)], [f"p{k}" for k in range(60)]
    rows = []
    for i in range(2000):
        w = list(base)
        for j in rng.integers(300, size=2):
            w[int(j)] = f"own{i}"
        rows.append((i, " ".join(w), "s"))
    rows += [(5000 + i, " ".join(common + [f"q{i}x{k}" for k in range(60)]), "s") for i in range(600)]
    asked, whole = [], minhash.confirmed

    def counted(pairs, texts, percent):
        asked.append(pairs.count())
        return whole(pairs, texts, percent)

    monkeypatch.setattr(minhash, "confirmed", counted)
    got = near_duplicates(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert {r.component_id for r in got if r.doc_id < 5000} == {0}
    assert all(r.kept for r in got if r.doc_id >= 5000)
    assert sum(asked) <= 3 * 2000


def test_minhash_common_passage_makes_no_rows_of_texts_alike_in_nothing_else(spark, monkeypatch):
    """1,200 texts share a passage and 30 of them have a near copy: branching the nodes of the passage makes rows of those alone, and all copies are found; also where a node is too large for one task."""
    from spanloom.llm import minhash

    common = [f"p{k}" for k in range(60)]
    texts = [[*common, *(f"q{i}x{k}" for k in range(30))] for i in range(1200)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate(texts)] + [(5000 + i, " ".join([*texts[i][:-1], f"new{i}"]), "s") for i in range(0, 1200, 40)]
    made = []

    def counted(whole):
        def run(*args):
            out = whole(*args)
            made.append(out.count())
            return out

        return run

    monkeypatch.setattr(minhash, "FIRST", 0)  # no pair is joined before
    monkeypatch.setattr(minhash, "branch", counted(minhash.branch))
    monkeypatch.setattr(minhash, "descended", counted(getattr(minhash, "descended", None)), raising=False)
    want = {(i, i % 5000) for i, _, _ in rows}
    assert {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()} == want
    assert made and sum(made) <= 60 * 40
    monkeypatch.setattr(minhash, "WHOLE", 600)
    assert {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()} == want


def test_minhash_ignores_clashing_columns_and_reads_long_texts(spark):
    long = " ".join(f"w{k % 5000}x{k // 5000}" for k in range(300_000))
    rows = [(1, long, 1, "x"), (2, long + " end", 2, "y"), (3, "z", 3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component int, node string")
    assert sorted((r.doc_id, r.component_id) for r in near_duplicates(df).collect()) == [(1, 1), (2, 1), (3, 3)]


def brute_lines(rows):
    seen, out = {}, {}
    occurrences = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        at = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        for k in range(len(at) - 2):
            occurrences.append((i, k, tuple(lines[at[k + o]].strip(" \t\n\x0b\f\r") for o in range(3)), at))
    for i, k, w, at in sorted(occurrences, key=lambda x: x[:2]):
        if w in seen:
            out.setdefault(i, set()).update(at[k : k + 3])
        else:
            seen[w] = (i, k)
    return out


def test_line_dedup_against_brute_force(spark, none):
    text = "a\nb\n\nc\nd\nb\nc\nd\nb"
    rows = [(1, text, "s"), (2, "x\nb\nc\n \nd\ny", "s"), (3, "b\nc", "s"), (4, None, "s"), (5, "", "s"), (6, "q\nq\nq\nq\nq", "s"), (7, "z\na\nb\nc", None)]
    gone = brute_lines(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", n_lines int")
    for r in dedup_lines(df).collect():
        lines = (dict((x[0], x[1]) for x in rows)[r.doc_id] or "").split("\n")
        assert r.n_removed == len(gone.get(r.doc_id, ()))
        if r.doc_id != 4:
            assert r.kept_text == "\n".join(x for k, x in enumerate(lines) if k not in gone.get(r.doc_id, ()))
    assert r is not None and dedup_lines(none).count() == 0
    twice = spark.createDataFrame([rows[0], rows[0]], DOCS)
    assert len({tuple(r) for r in dedup_lines(twice).collect()}) == 1


def labelled():
    rng = np.random.default_rng(7)
    plain = [f"plain{k}" for k in range(80)]
    rude = ["gronkle", "blarfed", "snorvix", "quzzlim"]
    rows = []
    for i in range(600):
        w = list(rng.choice(plain, 60))
        y = int(i % 3 == 0)
        if y:
            for k in rng.integers(0, 60, 5):
                w[k] = rude[int(rng.integers(4))]
        rows.append((i, " ".join(w), y))
    return rows


def test_line_dedup_passes_clashing_columns_through(spark):
    """Whatever other columns are called, their values come through; long texts and repeated rows too."""
    names = ["_th", "_id", "_gone", "_lines", "_filled", "_covered", "_removed", "row", "id", "th", "_"]
    text = "a\nb\nc"
    rows = [(1, text, *names), (2, text + "\nd", *names), (2, text + "\nd", *names), (3, "\n".join(f"l{k}" for k in range(50_000)) + "\n" + text, *names)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))).collect()
    assert all([r[c] for c in names] == names for r in got)
    assert [(r.doc_id, r.n_removed) for r in sorted(got, key=lambda r: r.doc_id)] == [(1, 0), (2, 3), (2, 3), (3, 3)]


def test_toxicity_reads_long_labelled_texts_from_end_to_end():
    text = " ".join(f"w{k}" for k in range(100_000))
    got = toxicity.thinned(text).split()
    assert len(got) == toxicity.RUNS * toxicity.RUN and got[0] == "w0" and got[-1] == "w99999"
    assert toxicity.thinned("a  b") == "a  b"


def test_toxicity_learns_and_scores(spark, none):
    rows = labelled()
    d = spark.createDataFrame([(i, t, "s") for i, t, _ in rows] + [(1000, None, "s"), (1001, "", "s"), (None, "plain1 plain2", "s"), (0, rows[0][1], "s")], DOCS)
    y = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (2000, None)], "doc_id long, toxic int")
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    model = toxicity.fit(d, y, (toxicity.F.crc32(toxicity.F.col("doc_id").cast("string").cast("binary")) % 3) != 1)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    truth = {i: y for i, _, y in rows}
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.95
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score
    assert toxicity.score(none, model).count() == 0
    assert toxicity.train([(1, b"only one class", 0)]) == toxicity.CONSTANT


def test_edits_against_plain_dynamic_programming():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 5, rng.integers(0, 14)).astype(np.uint64)
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        d[:, 0] = range(len(a) + 1)
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = min(d[i, j] + (a[i] != b[j]), d[i, j + 1] + 1, d[i + 1, j] + 1)
        assert edits(a, b)[0] == d[-1].min()


def test_decontamination_recall_and_cases(spark, none):
    rng = np.random.default_rng(2)
    pool = [f"w{i}" for i in range(3000)]
    items = [" ".join(rng.choice(pool, 30)) for _ in range(40)]
    known, hits = Items(items, 0.2, 4), 0
    for k, item in enumerate(items):
        w = item.split()
        for p in rng.choice(30, 4, replace=False):
            w[p] = "edited"
        raw = " ".join([*rng.choice(pool, 50), *w, *rng.choice(pool, 50)]).encode()
        hits += (0, k) in known.hits(*hashed_words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    assert hits / len(items) >= 0.95
    d = spark.createDataFrame([(1, "x " + items[3].upper() + " y", "s"), (2, "clean words only", "s"), (3, None, "s"), (4, "", "s"), (1, "x " + items[3] + " y", "s"), (5, "short item", None)], DOCS)
    b = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(90, None), (91, ""), (None, "short item"), (92, "short item")], "item_id long, text string")
    got = sorted(tuple(r)[:3] for r in find_leaks(d, b).collect())
    assert got == [(1, 3, 0), (1, 3, 0), (5, 92, 0)]
    assert find_leaks(none, b).count() == 0 and find_leaks(d, b.where("false")).count() == 0


def test_exact_copies_of_short_items_always_hit():
    rng = np.random.default_rng(16)
    for size in (4, 5, 6):
        items = [" ".join(f"w{i}" for i in rng.integers(0, 10**6, size)) for _ in range(1500)]
        raw = [f"before it {item} and after it".encode() for item in items]
        at = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
        hits = Items(items, 0.2, 1).hits(*hashed_words(np.frombuffer(b"".join(raw), np.uint8), at))
        assert all((k, k) in hits for k in range(len(items)))


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16))
    rows = [(i, (base[i % 6] + rng.normal(size=16) * 0.12).tolist(), i % 2) for i in range(150)]
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 1), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] * 16, 0), (205, rows[1][1], None), (206, [1.0, None] + [0.0] * 14, 0), (207, [2 * x for x in rows[0][1]], 0), (208, [1.0, 2.0], 0), (0, rows[0][1], 0)]
    good = [(i, np.array(v), y) for i, v, y in rows if y is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    n, comp = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    pairs = [(a, b) for a in range(len(good)) for b in range(len(good)) if a != b and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] / np.sqrt((good[a][1] @ good[a][1]) * (good[b][1] @ good[b][1])) >= 0.93]
    for _ in range(len(good)):
        for a, b in pairs:
            x, y = good[a][0], good[b][0]
            comp[x] = comp[y] = min(comp[x], comp[y])
    for a, _ in pairs:
        n[good[a][0]] += 1
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = vectors.near_vectors(df)
    for r in got.collect():
        assert r.component_id == comp[r.vec_id] and r.kept == (comp[r.vec_id] == r.vec_id)
        assert r.n_links == (n[r.vec_id] // 2 if r.vec_id == 0 else n[r.vec_id])
    assert vectors.audit(df.where("vec_id > 0"), got.where("vec_id > 0"), by=7).first().recall >= 0.9
    assert vectors.near_vectors(df.where("false")).count() == 0


def test_graph_search_recall_in_one_shard():
    rng = np.random.default_rng(6)
    v = vectors.unit(rng.normal(size=(60, 32))[rng.integers(0, 60, 1500)] + rng.normal(size=(1500, 32)) * 0.15)
    near = vectors.padded(vectors.graph(v))
    got = {(int(a), int(b)) for x, y in vectors.found(v, near, 0.93) for a, b in zip(x, y, strict=True) if a != b}
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(v @ v.T >= 0.93), strict=True) if a != b}
    assert len(got & want) / max(1, len(want)) >= 0.97


def test_links_between_shards_are_found(spark, monkeypatch):
    """A group of 1,500 different near copies and linked pairs among noise, over many shards and blocks; the audit asks for all links."""
    rng = np.random.default_rng(12)
    at = rng.normal(size=32)
    pair = rng.normal(size=(300, 32))
    v = np.concatenate((at / np.linalg.norm(at) + rng.normal(size=(1500, 32)) * 0.03, pair, pair + rng.normal(size=pair.shape) * 0.3))
    monkeypatch.setattr(vectors, "SHARD", 40)
    monkeypatch.setattr(vectors, "LIMIT", 500)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = np.array([r.n_links for r in vectors.near_vectors(df).orderBy("vec_id").collect()])
    u = vectors.unit(v)
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert got.sum() >= 0.999 * want.sum() and (got <= want).all()
    assert got[1500:].sum() >= 0.99 * want[1500:].sum() > 300  # pairs have no other neighbours in range


def test_shards_are_cut_where_it_saves_work(spark, monkeypatch):
    """Vectors that don't part stay in one shard, groups that do are parted; blocks of a shard meet once, and each vector goes to the pairs of its block alone."""
    rng = np.random.default_rng(23)
    length = float(np.sqrt(2 - 2 * 0.93))
    noise = vectors.unit(rng.normal(size=(3000, 16)))
    held = vectors.shards_of(noise, vectors.centres(noise, 3), vectors.merged(vectors.centres(noise, 3), length), length)
    assert sum(len(x) for x in held) > 1.8 * len(noise)  # of three shards, each vector is in nearly two
    assert len(vectors.fitted(noise, 6000, 3, length)[0]) == 1
    parted = vectors.unit(np.repeat(vectors.unit(rng.normal(size=(8, 16))), 400, axis=0) + rng.normal(size=(3200, 16)) * 0.02)
    assert len(set(vectors.fitted(parted, 20000, 16, length)[1].tolist())) > 1
    v = vectors.unit(np.repeat(rng.normal(size=(40, 16)), 5, axis=0) + rng.normal(size=(200, 16)) * 0.1)
    df = spark.createDataFrame([(i, x.tolist(), "a") for i, x in enumerate(v)], "vec_id long, embedding array<double>, label string")
    there = ((v @ v.T >= 0.93).sum(axis=1) - 1).tolist()
    for limit, pairs in ((200, 200), (100, 200), (70, 400), (45, 800)):  # in 1, 2, 3 and 5 blocks
        monkeypatch.setattr(vectors, "LIMIT", limit)
        rows, keep = [], Scratch.keep
        monkeypatch.setattr(Scratch, "keep", lambda self, d, rows=rows, keep=keep: (lambda out: (rows.append(out.count() if out.columns == ["label", "rep", "n", "root"] else 0), out)[1])(keep(self, d)))
        got = vectors.near_vectors(df).orderBy("vec_id").collect()
        monkeypatch.setattr(Scratch, "keep", keep)
        assert [r.n_links for r in got] == there and max(rows) == pairs


def test_ends_of_links_share_a_shard():
    rng = np.random.default_rng(13)
    a = vectors.unit(rng.normal(size=(4000, 32)))
    b = vectors.unit(a + rng.normal(size=a.shape) * 0.06)
    near = (a * b).sum(axis=1) >= 0.93
    c, length = vectors.centres(a, 100), float(np.sqrt(2 - 2 * 0.93))
    root = vectors.merged(c, length)
    x, y = vectors.shards_of(a, c, root, length), vectors.shards_of(b, c, root, length)
    assert near.sum() > 1000 and all(set(p) & set(q) for p, q, near in zip(x, y, near, strict=True) if near)
    same = vectors.unit(a[0] + rng.normal(size=(50, 32)) * 0.01)
    assert len(set(vectors.merged(same, length))) == 1


def test_tokens_round_trip_and_rules(docs, none):
    encoding, lengths = tokens.encoder(tokens.vocabulary())
    for r, (i, t, _) in zip(sorted(tokens.count_tokens(docs).collect(), key=str), sorted(corpus(), key=str), strict=False):
        assert r.n_bytes == sum(r.section_bytes) and sum(r.section_tokens) == r.n_tokens
    for rule in tokens.RULES:
        ends, borders = np.array([2, 5, 9]), np.array([4, 9])
        assert tokens.allot(ends, borders, rule).tolist() == {"start": [2, 1], "most": [2, 1], "share": [1 + 2 / 3, 1 + 1 / 3]}[rule] or np.allclose(tokens.allot(ends, borders, rule), [1 + 2 / 3, 1 + 1 / 3])
    text = "Hello wörld\nnext line\n"
    ids = encoding.encode_ordinary(text)
    assert lengths[ids].sum() == len(text.encode())
    by_field = tokens.count_tokens(docs, fields=("source", "text")).first()
    assert len(by_field.section_tokens) == 2
    assert tokens.count_tokens(none).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(docs, rule="none")


def test_lm_base_and_score(docs, none):
    F = lm_score.F
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))
    rows = corpus()
    train = [t for i, t, _ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    count: dict = {}
    for t in train:
        for w in [*words(t), None]:
            count[w] = count.get(w, 0) + 1
    total, distinct = sum(count.values()), len(count)
    got = sorted(tuple(r) for r in lm_score.score_texts(docs, learn).select(F.coalesce("doc_id", F.lit(-1)), "n_tokens", "n_known", "train_tokens", F.round("base_score", 6), F.round("score", 4)).collect())
    want = sorted((-1 if i is None else i, len(words(t)) + 1, sum(count.get(w, 0) > 0 for w in [*words(t), None]), total, round(sum(np.log10((count.get(w, 0) + 0.5) / (total + 0.5 * (distinct + 1))) for w in [*words(t), None]), 6)) for i, t, _ in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])
    assert all(np.isfinite(g[5]) and g[5] < 0 for g in got)
    again = sorted(tuple(r) for r in lm_score.score_texts(docs.repartition(3), learn).select(F.coalesce("doc_id", F.lit(-1)), F.round("score", 4)).collect())
    assert again == sorted((g[0], g[5]) for g in got)  # a score doesn't depend on a text's neighbours
    assert lm_score.score_texts(none, learn).count() == 0


def lm_passages(tokens: list[bytes]) -> list[tuple[tuple, int, int]]:
    """(two words, first token after them, end) of the anchors of spelled tokens, which end with the text's end."""
    out = []
    for i in range(1, len(tokens) - 1):
        t = lm_score.Tokens(np.frombuffer(b"".join(tokens[i - 1 : i + 1]), np.uint8), np.array([0, len(b"".join(tokens[i - 1 : i + 1]))]))
        if len(t.anchors()[0]):
            out.append(((tokens[i - 1], tokens[i]), i + 1))
    ends = [x[1] for x in out[1:]] + [len(tokens)] * bool(out)
    return [(w, k, min(e, len(tokens), k + lm_score.PASSAGE)) for (w, k), e in zip(out, ends, strict=True)]


def lm_brute(train: list[bytes], texts: list[bytes]) -> list[float]:
    """log10 probabilities of texts (as bytes) by a plain loop over bits, with counts from train in dictionaries."""
    spell = lambda t: [w + b" " for w in t.lower().split()] + [b"\n"]
    code = lm_score.Code(np.bincount(np.frombuffer(b"".join(b"".join(spell(t)) for t in train), np.uint8), minlength=256))
    path_of = lambda byte: [(int(code.node[p]), int(code.bit[p])) for p in range(code.first[byte], code.first[byte] + code.size[byte])]
    counts, on_from = {}, {}
    for t in train:
        tokens = spell(t)
        for w, lo, hi in lm_passages(tokens):
            own = on_from.setdefault(w, {})
            own[b"".join(tokens[lo:hi])] = own.get(b"".join(tokens[lo:hi]), 0) + 1
    best = {w: max(x.items(), key=lambda z: (z[1], len(z[0]), z[0]))[0] for w, x in on_from.items()}

    def steps(t):
        tokens, past, said, right = spell(t), b"\n\n\n", b"", 0
        starts = {k: best.get(w) for w, k, _ in lm_passages(tokens)}
        for i, w in enumerate(tokens):
            if starts.get(i):
                said, right = starts[i], 0
            for d, byte in enumerate(w):
                three = int.from_bytes(past[-3:], "big") * 2654435761 % 2**32 >> 16 & lm_score.BUCKETS - 1
                yield i, path_of(byte), (past[-2:], three, w[:d]), (path_of(said[right]) if right < len(said) else [], 1 + (right >= lm_score.FAR))
                said, right = (said, right + 1) if right < len(said) and said[right] == byte else (b"", 0)
                past += bytes([byte])

    for t in train:
        for _, path, contexts, _ in steps(t):
            for node, bit in path:
                for k, c in enumerate(contexts):
                    counts.setdefault((k, c, node), [0, 0])[bit] += 1
    out = []
    for t in texts:
        w, total, group, stretch = np.array(lm_score.WEIGHTS, float), 0.0, [], 0

        def refine(w, group):
            for gate, e, v in group:
                w[gate] += lm_score.RATE * e * v

        for i, path, contexts, (guess, run) in steps(t):
            if i // lm_score.STRETCH != stretch:
                refine(w, group)
                group, stretch = [], i // lm_score.STRETCH
            for deep, (node, bit) in enumerate(path):
                if len(group) == lm_score.GROUP:
                    refine(w, group)
                    group = []
                st = []
                for k, c in enumerate(contexts):
                    zero, one = counts.get((k, c, node), (0, 0))
                    st.append(int(lm_score.stretched(np.array([one]), np.array([zero]))[0]))
                follows = deep < len(guess) and guess[:deep] == path[:deep]
                st.append((lm_score.SURE if guess[deep][1] else -lm_score.SURE) if follows else 0)
                gate, v = (st[2] != 0) + 2 * run * follows, np.array(st) / lm_score.SCALE
                e = bit - 1 / (1 + np.exp(-np.clip(v @ w[gate], -12, 12)))
                total += np.log(1 - abs(e))
                group.append((gate, e, v))
        out.append(total / np.log(10))
    return out


def lm_rows():
    rng = np.random.default_rng(14)
    word = lambda: "".join(rng.choice(list("abcdéfg"), int(rng.integers(1, 7))))
    known = [word() for _ in range(120)]
    rows = [(i, " ".join(str(rng.choice(known)) if rng.random() < 0.9 else word() for _ in range(int(rng.integers(1, 60)))), "s") for i in range(40)]
    return rows + [(40, None, "s"), (41, " \n", "s"), (42, max((r[1] for r in rows), key=len) + " and on", "s"), (43, "Zq " * 300, "s"), (44, "x" * 5000, "s"), (45, "y", "s")]


def test_lm_scores_against_a_plain_loop(spark, monkeypatch):
    """Whole scores, with any number of ranges of the vocabulary, and of texts that take several stretches; clashing columns aren't read."""
    rows = lm_rows()
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], DOCS + ", n int, word binary")
    learned = lm_score.F.col("doc_id") % 4 != 1
    train = [(t or "").encode() for i, t, _ in rows if i % 4 != 1]
    for ranges, stretch in ((150_000, 1 << 17), (20, 7)):
        monkeypatch.setattr(lm_score, "STRETCH", stretch)
        monkeypatch.setattr(lm_score, "RANGE", ranges)
        code = lm_score.counted(df.select(lm_score.F.coalesce("text", lm_score.F.lit("")).alias("text"), learned.alias("learn")), 3)
        assert code.where("kind = 0").count() == len({w for _, t, _ in rows for w in words(t)} | {None})
        got = {r.doc_id: r.score for r in lm_score.score_texts(df, learned).collect()}
        if stretch > 7:
            want = lm_brute(train, [(t or "").encode() for _, t, _ in rows])
            assert np.allclose([got[r[0]] for r in rows], want, rtol=1e-4)
    monkeypatch.undo()


def test_lm_passages_are_keys_until_a_text_goes_on_otherwise(spark):
    """Passages are counted without their bytes; texts that share an anchor and go on in several ways get those of the most frequent."""
    rng = np.random.default_rng(8)
    some = [" ".join(rng.choice(["ab", "cde", "f", "ghij", "kl", "mn", "o", "pqrst", "uv", "w", "xyz", "cdf"], 9)) for _ in range(30)]
    rows = [(i, " ".join(str(rng.choice(some)) for _ in range(int(rng.integers(1, 40)))), "s") for i in range(60)]
    learned = lm_score.F.col("doc_id") % 4 != 1
    df = spark.createDataFrame(rows, DOCS)
    passages = lm_score.counted(df.select("text", learned.alias("learn")), 3).where("kind = 3")
    ways = passages.groupBy("h").count()
    assert ways.where("count > 1").count() > 5 and passages.where("word IS NOT NULL").count() == 0
    got = {r.doc_id: r.score for r in lm_score.score_texts(df, learned).collect()}
    want = lm_brute([t.encode() for i, t, _ in rows if i % 4 != 1], [t.encode() for _, t, _ in rows])
    assert np.allclose([got[r[0]] for r in rows], want, rtol=1e-4)


def test_lm_stretches_carry_weights(monkeypatch):
    """A text that takes several stretches against the plain loop, in one process."""
    monkeypatch.setattr(lm_score, "STRETCH", 7)
    texts = [(t or "").encode() for _, t, _ in lm_rows()][:12]
    got = lm_local(texts, texts)[0]
    assert np.allclose(got, np.array(lm_brute(texts, texts)) * np.log(10), rtol=1e-4)


def lm_local(train: list[bytes], texts: list[bytes], extra: tuple[bytes, ...] = ()):
    """(text_costs of texts, (mixer, predictions of spelled words)), without Spark."""
    spell = lambda t: [w + b" " for w in t.lower().split()] + [b"\n"]
    flat = [b"".join(spell(t)) for t in train]
    data = np.frombuffer(b"".join(flat), np.uint8)
    begins = np.cumsum([len(x) for x in flat]) - [len(x) for x in flat]
    code = lm_score.Code(np.bincount(data, minlength=256))
    contexts = lm_score.before(data, begins)
    tables = [lm_score.table_of(*(lambda c, n: (c.astype(np.int64), n))(*lm_score._counts(c.astype(np.uint32) << np.uint32(8) | data)), code, size) for c, size in zip(contexts, (1 << 16, lm_score.BUCKETS), strict=True)]
    mixer = lm_score.Mixer(code, *tables)
    count: dict[bytes, int] = {}
    for t in train:
        for w in spell(t):
            count[w] = count.get(w, 0) + 1
    every = sorted({*count, *extra, *(w for t in texts for w in spell(t))})
    index = {w: k for k, w in enumerate(every)}
    st, at = lm_score.predictions(every, np.array([count.get(w, 0) for w in every]), code)
    raw = b"".join(texts)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    t = lm_score.Tokens(np.frombuffer(raw, np.uint8), offsets)
    spelled = [w for x in texts for w in spell(x)]
    some: dict = {}
    for x in train:
        own = spell(x)
        for w, lo, hi in lm_passages(own):
            h = int(lm_score.Tokens(np.frombuffer(b"".join(w), np.uint8), np.array([0, len(b"".join(w))])).anchors()[0][0])
            some.setdefault(h, {}).setdefault(b"".join(own[lo:hi]), []).append(1)
    best = {h: max(x.items(), key=lambda z: (len(z[1]), len(z[0]), z[0]))[0] for h, x in some.items()}
    table = lambda h, n, st: lm_score.Known(lm_score.pa.table([lm_score.pa.array(h, lm_score.pa.int64()), lm_score.pa.array(n, lm_score.pa.int64()), lm_score.pa.array(st, lm_score.pa.binary())], names=["h", "n", "st"]))
    known = table(t.hash, [count.get(w, 0) for w in spelled], [st[at[k] : at[k + 1]].tobytes() for k in map(index.get, spelled)])
    anchored = table(list(best), [1] * len(best), list(best.values()))
    costs = lm_score.text_costs(t, np.searchsorted(known.hash, t.hash), known, anchored, mixer)
    return costs, (mixer, dict(zip(every, (st[at[k] : at[k + 1]] for k in range(len(every))), strict=True)), anchored)


def test_lm_probabilities_of_next_bytes_sum_to_one(monkeypatch):
    """After prefixes of many lengths (several groups of bits), within words, between them and within passages, the probabilities of all 256 next bytes add up to one."""
    monkeypatch.setattr(lm_score, "EVERY", 3)
    train = [(t or "").encode() for _, t, _ in lm_rows()]
    source = train[42].split()
    words_before = source[:25] + [b"unseen"] + source[20:33]
    in_passage = set()
    for n in (1, 7, 20, 24, 33):
        for part in (b"", source[n][:1], source[n][:2], b"zzz"):
            nexts = [part + bytes([b]) + b" " if b != 32 else part + b" " for b in range(256)]
            lead = [w + b" " for w in words_before[:n]]
            _, (mixer, st, anchored) = lm_local(train, [b" ".join(words_before)], (*nexts, part + b" "))
            total = {}
            for b in (None, *range(256)):
                tail = part if b is None else part + bytes([b])
                word = part + b" " if b is None else nexts[b]
                flat = np.frombuffer(b"".join(lead) + tail, np.uint8)
                trie = np.concatenate([*(st[w] for w in lead), st[word][: mixer.code.size[np.frombuffer(tail, np.uint8)].sum() if tail else 0]])
                t = lm_score.Tokens(np.frombuffer(b"".join(lead), np.uint8), np.array([0, len(b"".join(lead))]))
                at = t.spelled(np.arange(len(t.hash)))[1].copy()
                at[-1] = len(flat)  # instead of the end, an open word
                guess, run = lm_score.passages(t, flat, at, anchored)
                x = mixer.inputs(flat, lm_score.before(flat, np.array([0])), guess, run, trie)
                in_passage |= set(x[-3:, 4].tolist())
                total[b] = float(lm_score.mixed(x, np.array([len(x)]), lm_score.first_weights(1))[0])
            assert abs(sum(np.exp(total[b] - total[None]) for b in range(256)) - 1) < 1e-4
    assert in_passage & {2, 3, 4, 5}


def test_lm_counts_of_ranges_agree():
    """Predictions of a vocabulary in one range and in many, whose borders cut its branches."""
    rng = np.random.default_rng(3)
    every = sorted({b"".join(rng.choice([b"a", b"b", b"th", b"the"], int(rng.integers(1, 9)))) + b" " for _ in range(400)} | {b"\n"})
    n = rng.integers(0, 4, len(every))
    code = lm_score.Code(np.bincount(np.frombuffer(b"".join(every), np.uint8), minlength=256))
    whole, at = lm_score.predictions(every, n, code)
    borders = [every[k][:3] for k in (50, 51, 120, 121, 300)]
    borders = sorted(set(borders))
    part = [lm_score.bisect_right(borders, w) for w in every]
    shared: dict = {b[:d]: np.zeros(256) for b in borders for d in range(len(b))}
    for p in range(len(borders) + 1):
        mine = [k for k in range(len(every)) if part[k] == p]
        for x, v in lm_score.cut([every[k] for k in mine], n[mine], borders[max(0, p - 1) : p + 1]).items():
            shared[x] = shared[x] + v
    for p in range(len(borders) + 1):
        mine = [k for k in range(len(every)) if part[k] == p]
        near = borders[max(0, p - 1) : p + 1]
        if mine:
            got, _ = lm_score.predictions([every[k] for k in mine], n[mine], code, near, {b[:d]: shared[b[:d]] for b in near for d in range(len(b))})
            assert (got == whole[at[mine[0]] : at[mine[-1] + 1]]).all()


def test_lm_texts_of_many_pieces_are_read_in_step(monkeypatch):
    """Texts of several pieces wait for each other and are then refined together, in any number of lanes, with the same scores as alone."""
    texts = [(t or "").encode() for _, t, _ in lm_rows()]
    alone = np.concatenate([lm_local(texts, [t])[0] for t in texts[:44]])
    calls, pieces, refined = [], [], lm_score.refined
    monkeypatch.setattr(lm_score, "LANES", 3)
    monkeypatch.setattr(lm_score, "mixed", lambda x, size, w: pieces.append((x, size)) or np.zeros(len(size)))
    for k in range(0, 44, 4):
        lm_local(texts, texts[k : k + 4])
    monkeypatch.setattr(lm_score, "refined", lambda *a: calls.append(len(a[2])) or refined(*a))
    for held in (1 << 12, sum(int((-(-size // lm_score.GROUP)).sum()) for _, size in pieces) // 2):
        monkeypatch.setattr(lm_score, "HELD", held)
        calls.clear()
        waiting, got = lm_score.Waiting(), []
        for x, size in pieces:
            if not waiting.fits(size):
                got.extend(waiting.scored())
            waiting.add(x, size, lambda gain: gain)
        got.extend(waiting.scored())
        assert np.allclose(np.concatenate(got), alone, rtol=1e-5) and sum(calls) == 44
        assert len(calls) == 1 if held == 1 << 12 else 1 < len(calls) < len(pieces)


def test_lm_long_texts_and_many_flushes_agree(spark, monkeypatch):
    """Scores of a table don't depend on how many texts wait, nor on which are scored by themselves."""
    df = spark.createDataFrame(lm_rows(), DOCS)
    learned = lm_score.F.col("doc_id") % 4 != 1
    want = {r.doc_id: r.score for r in lm_score.score_texts(df, learned).collect()}
    for name, value in (("HELD", 200), ("PIECE", 1 << 10)):
        monkeypatch.setattr(lm_score, name, value)
        got = {r.doc_id: r.score for r in lm_score.score_texts(df, learned).collect()}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-5)


def test_lm_ranges_of_words_and_spans():
    """Ranges of words by their first letters as bisect finds them, and numbers of spans of which some are empty."""
    rng = np.random.default_rng(21)
    every = [bytes(rng.choice([0, 97, 98, 255], int(rng.integers(1, 12))).astype(np.uint8)) + b" " for _ in range(500)] + [b"\n"]
    at = np.concatenate(([0], np.cumsum([len(w) for w in every])))
    flat = np.frombuffer(b"".join(every), np.uint8)
    for borders in ([], [b"a"], sorted({w[:-1] for w in every[:40]} | {every[41], every[42][:8]})):
        assert lm_score.parts_of(flat, at, borders).tolist() == [lm_score.bisect_right(borders, w) for w in every]
    lo = rng.integers(0, 50, 200)
    hi = lo + rng.integers(0, 3, 200)
    assert lm_score.ranges(lo, hi).tolist() == [k for a, b in zip(lo, hi, strict=True) for k in range(a, b)]
    assert len(lm_score.ranges(lo, lo)) == 0


def test_mixing_totals(docs, none):
    rows = mix(docs).collect()
    total = sum(len(words(t)) for _, t, _ in corpus())
    assert abs(sum(r.taken for r in rows) - 1.5 * total) <= 4
    assert all(r.taken <= 2 * r["size"] for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and own[0].source_size == sum(r["size"] for r in own)
    flat = training_order(mix(docs)).collect()
    assert sum(r.take_words for r in flat) == sum(r.taken for r in rows) and all(0 <= r.position <= 1 for r in flat)
    assert mix(none).count() == 0


def test_mixing_query_is_in_training_order(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = op8_mix_sources(docs.sparkSession, str(tmp_path)).collect()
    at = [r.first_position for r in rows]
    some = [x for x in at if x is not None]
    assert len(some) > 10 and at == sorted(some) + [None] * (len(at) - len(some))
    want = mix(docs).collect()
    assert sorted((str(r.doc_id), r["size"], r.taken) for r in rows) == sorted((str(r.doc_id), r["size"], r.taken) for r in want)
    # The targets by bisection of the level, from the texts alone.
    size: dict = {}
    for _, t, s in corpus():
        size[s] = size.get(s, 0) + len(words(t))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        level = (lo + hi) / 2
        lo, hi = (level, hi) if sum(min(2 * size[s], weight[s] * level) for s in names) < 1.5 * sum(size.values()) else (lo, level)
    for r in want:
        assert abs(r.target - min(2 * size[r.source], weight[r.source] * hi)) < 1e-6 * (1 + r.target)


def test_repeats_in_pieces_sorts_little(monkeypatch):
    """Strings of pieces against brute force, and the work of the suffix array: only rows that still have equals are sorted again."""
    rng = np.random.default_rng(12)
    for _ in range(200):
        letters = rng.integers(1, 4)
        texts = [rng.integers(97, 97 + letters, rng.integers(1, 60)).astype(np.uint8) for _ in range(rng.integers(1, 6))]
        texts += [texts[0].copy(), np.full(30, 255, np.uint8)]
        length = int(rng.integers(1, 25))
        want: dict = {}
        for k, t in enumerate(texts):
            for o in range(len(t) - length + 1):
                want.setdefault(t[o : o + length].tobytes(), []).append((k, o))
        got: dict = {}
        for k, o, g in zip(*(x.tolist() for x in suffix_dedup.repeats(texts, length)), strict=True):
            got.setdefault(g, []).append((k, o))
        assert sorted(sorted(x) for x in got.values()) == sorted(x for x in want.values() if len(x) > 1)
    common = rng.integers(97, 123, 30)
    s = np.concatenate([np.concatenate((rng.integers(97, 123, 80), common, rng.integers(97, 123, 80), [256 + k])) for k in range(200)])
    work, sort = [], np.argsort
    monkeypatch.setattr(suffix_dedup.np, "argsort", lambda x, **how: (work.append(len(x)), sort(x, **how))[1])
    suffix_dedup.suffix_array(s, 100)
    assert sum(work) <= 2 * len(s)  # 7 sorts of all rows before


def test_strings_of_hot_grams_are_few(spark, monkeypatch):
    """Pieces around a common passage, each with other text around: their strings that no other piece shares aren't dealt one by one."""
    rng = np.random.default_rng(13)
    word = lambda n: "".join(rng.choice(list("abcdefghijklm "), n))
    common = word(130)
    rows = [(i, word(150) + common + word(150), "s") for i in range(60)]
    rows += [rows[0], rows[0], (None, rows[1][1], "s"), (None, rows[1][1], "s")]
    many, strings = [], suffix_dedup.strings
    monkeypatch.setattr(suffix_dedup, "strings", lambda rows, length: (many.append(strings(rows, length).count()), strings(rows, length))[1])
    monkeypatch.setattr(suffix_dedup, "MOST", 10)
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()
    seen, want = set(), {}
    for i, t in sorted({(-1 if i is None else i, t) for i, t, _ in rows}):
        own = [k for k in range(331) if t[k : k + 100] in seen]
        seen.update(t[k : k + 100] for k in range(331))
        want[i] = len({x for k in own for x in range(k, k + 100)})
    assert want[-1] == 0 and want[1] == 430 and all(want[i] >= 130 for i in range(2, 60))
    assert len(got) == 64 and all(r.n_removed == want[-1 if r.doc_id is None else r.doc_id] for r in got)  # rows that repeat id and text are one occurrence
    assert many and many[0] < 60 * 60  # all strings before


def test_substrings_against_brute_force(spark, none):
    rng = np.random.default_rng(8)
    word = lambda n: "".join(rng.choice(list("abcdé "), n))
    common = word(300)
    rows = [(i, word(150) + common[int(rng.integers(0, 80)) : 300 - int(rng.integers(0, 80))] + word(120), "s") for i in range(12)]
    rows += [(20, "ab" * 200, "s"), (21, None, "s"), (22, "", "s"), (23, word(99), "s"), (24, rows[0][1], "s"), (25, rows[0][1] + "tail", "s"), (26, "z" * 1000, None)]
    seen: set[bytes] = set()
    want = {}
    for i, t, _ in sorted(rows):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            s = b[k : k + 100]
            if s in seen:
                cover[k : k + 100] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        want[i] = (len(b), int(cover.sum()), spans, hashlib.sha256(bytes(x for x, c in zip(b, cover, strict=True) if not c)).hexdigest())
    for most in (suffix_dedup.MOST, 1):  # the second way takes over beyond MOST
        keep, suffix_dedup.MOST = suffix_dedup.MOST, most
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_dedup.dedup_substrings(spark.createDataFrame(rows, DOCS)).collect()}
        suffix_dedup.MOST = keep
        assert got == want
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_transform_borders_against_sorting():
    rng = np.random.default_rng(9)
    for depth in (3, 5, 8):
        pieces = [rng.integers(0, 3, 40).astype(np.uint8) for _ in range(6)]
        piece, offset, group = suffix_dedup.repeats(pieces, depth)
        got = {}
        for p, o, g in zip(piece, offset, group, strict=True):
            got.setdefault(int(g), set()).add((int(p), int(o)))
        want = {}
        for p, x in enumerate(pieces):
            for o in range(len(x) - depth + 1):
                want.setdefault(bytes(x[o : o + depth]), set()).add((p, o))
        assert sorted(map(sorted, got.values())) == sorted(sorted(v) for v in want.values() if len(v) > 1)


def test_url_rules(spark):
    rules = [Rule.of("net/", "block"), Rule.of("example.net/en/", "allow"), Rule.of("org/fr/", "allow")]
    urls = ["http://a.Example.NET/en/x?y", "http://example.net/de", "https://evil.com/foo.net/x", "http://a.net?x", None, "", "no scheme", "http://x.org/fr/1#t", "HTTP://B.NET/", "http://notexample.net/en/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(0, urls[0], "again")], "page_id long, url string, host string")
    got = sorted(tuple(r) for r in filter_urls(df, rules).select("page_id", "host", "path", "rule", "verdict").collect() if r.page_id)
    assert [g[3] for g in got] == ["net/", None, None, None, None, None, "org/fr/", "net/", "net/"]
    assert got[0][4] == "block" and got[1][4] == "allow"
    assert filter_urls(df, rules).where("page_id = 0 AND rule = 'example.net/en/' AND verdict = 'allow' AND host = 'a.example.net' AND path = '/en/x'").count() == 2
    assert filter_urls(df.where("false"), rules).count() == 0


def test_automaton_of_many_words():
    globs = [f"*.host{k}.com/p{k}/**" for k in range(40)] + ["a?c*", "**tail"]
    texts = [b".x.host7.com/p7/q", b".host39.com/p39/", b".a/host3.com/p3/", b"abcz", b"ab/c", b"any/thing tail"]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    hit = Automaton(globs).run(np.frombuffer(b"".join(texts), np.uint8), at)
    assert [np.flatnonzero(h).tolist() for h in hit] == [[7], [39], [], [40], [], [41]]


def test_components_with_several_tasks(spark, monkeypatch):
    from spanloom.llm import common

    monkeypatch.setattr(common, "CONTRACT", 20)
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 99) if k != 49] + [(200, 200)], "a long, b long")
    got = {r.node: r.component for r in components(edges, Scratch(spark, "test")).collect()}
    assert got == {k: 0 if k < 50 else 50 for k in range(100)}
