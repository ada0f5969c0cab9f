"""Operators that compare documents with each other, and the pipeline, against brute force."""

import hashlib
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tellal.llm import common, decontam, fm_index, hot, langid, ngram_join, substring
from tellal.llm.common import in_batches
from tellal.llm.components import components

DOCS = "doc_id long, text string, shard int, node string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made(seed, n=120):
    """Texts with copies, near copies, shared passages and oddities; more columns with clashing names."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rnd.choice(words) for _ in range(60)]
    texts = []
    for k in range(n):
        kind = rnd.random()
        t = [rnd.choice(words) for _ in range(rnd.randint(1, 150))]
        if texts and kind < 0.2:
            t = list(rnd.choice(texts))
        elif texts and kind < 0.55:
            t = list(rnd.choice(texts))
            for _ in range(rnd.randint(1, 4)):
                if t:
                    t[rnd.randrange(len(t))] = rnd.choice(words)
        elif kind < 0.75:
            at = rnd.randint(0, len(t))
            t[at:at] = passage[rnd.randint(0, 5) : rnd.randint(50, 60)]
        texts.append(t)
    rows = [(k, rnd.choice([" ", "\n", "\t "]).join(t), 1, "x") for k, t in enumerate(texts)]
    ids = list(range(n))
    rnd.shuffle(ids)
    rows = [(i, *r[1:]) for i, r in zip(ids, rows)]
    odd = [(1001, None, 1, "x"), (1002, "", 1, "x"), (1003, " \n", 1, "x"), (1004, "ONE two", 1, "x"), (1005, "one TWO", 1, "x"), (1006, "É é", 1, "x"), (1007, "é é", 1, "x")]
    return rows + odd + [rows[3], rows[3]]


def shingles(text, size):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    n = min(size, len(words))
    return {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if n else set()


def brute_components(rows, size, threshold):
    sets = {i: shingles(t, size) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) * threshold.denominator >= threshold.numerator * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("size, threshold", [(3, "9/10"), (5, "8/10"), (2, "1/2")])
@pytest.mark.parametrize("block, hot", [(3000, 20_000), (4, 20_000), (4, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, size, threshold, block, hot):
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = made(size)
    out = ngram_join.similar_components(spark.createDataFrame(rows, DOCS), size, threshold).collect()
    expected = brute_components(rows, size, Fraction(threshold))
    assert len(out) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in out} == expected


def test_a_chain_of_lists_without_links_and_a_shingle_that_all_have(spark, monkeypatch):
    """Sets that share rare shingles along a chain but do not link, and copies among them, in small blocks."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 5)
    monkeypatch.setattr(ngram_join, "HOT", 10)
    rnd = random.Random(13)
    rows = []
    for k in range(90):
        own = [f"a{k}x{j}" for j in range(12)] + [f"a{k + 1}x{j}" for j in range(12)]
        rows.append((k, " ".join(["common line that every text begins with", *own, "and ends with too"]), 1, "x"))
    for k in range(25):
        words = rows[rnd.randrange(90)][1].split()
        words[rnd.randrange(8, 20)] = f"changed{k}"
        rows.append((200 + k, " ".join(words), 1, "x"))
    for size, threshold in ((1, "9/10"), (1, "1/2"), (2, "8/10")):
        out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, DOCS), size, threshold).collect()}
        assert out == brute_components(rows, size, Fraction(threshold))


def templated(n, seed):
    """Texts of one template: each has a word of its own at some place, every tenth one is a near copy
    of the one before it, and every eleventh has a longer text with the template in it."""
    rnd = random.Random(seed)
    base = [f"t{k}" for k in range(42)]
    texts = []
    for k in range(n):
        words = list(base)
        if k % 10 == 9:
            words = [*texts[-1].split(), f"more{k}"]
        else:
            words[rnd.randrange(2, 40)] = f"own{k}"
        if k % 11 == 10:
            words += [f"tail{k}x{j}" for j in range(rnd.randint(1, 12))]
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("block", [7, 4000])
@pytest.mark.parametrize("size, threshold", [(3, "9/10"), (5, "8/10")])
def test_texts_of_one_template(spark, monkeypatch, block, size, threshold):
    """Most do not link; those that do are found in every block."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", block)
    rows = [(3 * k, t, 1, "x") for k, t in enumerate(templated(80, block))]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(spark.createDataFrame(rows, DOCS), size, threshold).collect()}
    assert out == brute_components(rows, size, Fraction(threshold))


def test_positions_spare_the_merge(monkeypatch):
    """Three own shingles before 37 common ones leave no room for an overlap of 38: nothing is merged."""
    known, base = ngram_join.WordHash(), [f"t{k}" for k in range(42)]
    sets = [ngram_join.shingle_set(" ".join([*base[: 2 + k % 38], f"own{k}", *base[3 + k % 38 :]]), 3, known) for k in range(400)]
    monkeypatch.setattr(ngram_join, "merge_skip", None)
    assert ngram_join.search_links(sets, Fraction(9, 10)) == []


def test_lists_on_which_no_set_can_reach_the_overlap_stay_closed(spark):
    """Sets of 40 with room for 37 ask nothing; one with room for 40 meets all that can reach it."""
    schema = "list long, room long, node long, n long, known long, shard long, block int"
    sets = spark.createDataFrame([(k, 3, np.arange(3 * (k // 2), 3 * (k // 2) + 3, dtype=np.uint64).tobytes()) for k in range(8)], "node long, n long, shingles binary")
    for rooms, expected in (([37] * 8, 0), ([40] * 8, 4)):
        rows = [(1, room, k, 40, k, 0, k % 2) for k, room in enumerate(rooms)]
        links = ngram_join.links_on_lists(spark.createDataFrame(rows, schema), sets, Fraction(9, 10)).collect()
        assert len({frozenset(x) for x in links}) == expected and all(a // 2 == b // 2 for a, b in links)


def test_hot_keys_and_joins_on_them(spark, monkeypatch):
    monkeypatch.setattr(hot, "CHUNK", 1000)
    df = spark.range(0, 6000, 1, 3).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") + 10).alias("k"))
    keys = hot.hot_keys(df, lambda batch: batch.column("k").to_numpy().astype(np.uint64), 6000, 900)
    assert keys.tolist() == [7] and hot.among(np.array([6, 7, 8], np.uint64), keys).tolist() == [False, True, False]
    keyed = df.groupBy("k").agg(F.count("*").alias("n")).where("k < 100").withColumn("v", F.col("k") * 2)
    for least in (1, 5000):
        out = hot.left_join(df, keyed, "k", "n", 6000, least)
        assert out.columns == ["k", "v"] and out.count() == 6000
        assert {(r.k, r.v) for r in out.where("k < 200").collect()} == {(k, k * 2 if k < 100 else None) for k in [7, *range(11, 200)] if k == 7 or k % 3 != 1}


def test_merge_skip_counts_what_reaches_the_least():
    rnd = random.Random(14)
    for _ in range(300):
        lists = [sorted(rnd.sample(range(30), rnd.randint(1, 20))) for _ in range(rnd.randint(0, 8))]
        least = rnd.randint(1, 8)
        count = {d: sum(d in x for x in lists) for d in range(30)}
        assert ngram_join.merge_skip(lists, least) == [(d, n) for d, n in sorted(count.items()) if n >= least]


def test_texts_that_share_an_id_and_very_long_ones(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    rows = [(3, "a b c d e f", 1, "x"), (3, "q r s t u v", 1, "x"), (1, "q r s t u v", 1, "x"), (4, long, 1, "x"), (5, long + " end", 1, "x"), (6, "", 1, "x"), (6, None, 1, "x")]
    out = ngram_join.similar_components(spark.createDataFrame(rows, DOCS), 3, "9/10", with_groups=True).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(1, 4, 1), (3, 4, 1), (3, 4, 3), (4, 59_998, 4), (5, 59_999, 4), (6, 0, 6), (6, 0, 6)]
    assert len({r.group for r in out}) == 4 and len({(r.doc_id, r.part) for r in out}) == 7


def test_join_of_nothing(spark):
    assert ngram_join.similar_components(spark.createDataFrame([], DOCS)).count() == 0
    alone = ngram_join.similar_components(spark.createDataFrame([(None, "a b c d e f", 1, "x"), (7, "a b c d e f", 1, "x"), (None, "z", 1, "x")], DOCS)).collect()
    assert sorted(((str(r.doc_id), r.component_id) for r in alone), key=str) == sorted([("7", 7), ("None", 7), ("None", None)], key=str)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("limit", ["0", "300"])
def test_batches_are_bounded_whatever_the_session_says_and_it_stays_so(spark, limit):
    before = spark.conf.get(ARROW_ROWS)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    try:
        spark.conf.set(ARROW_ROWS, limit)
        found = [r.n for r in in_batches(spark.range(0, 2000, 1, 1), sizes, "n long").collect()]
        assert spark.conf.get(ARROW_ROWS) == limit
    finally:
        spark.conf.set(ARROW_ROWS, before)
    assert sum(found) == 2000 and max(found) <= 500


def test_pieces_of_few_bytes(monkeypatch):
    monkeypatch.setattr(common, "BATCH_BYTES", 40_000)
    texts = ["x" * 50_000 if k % 400 == 0 else None if k % 7 == 0 else "y" * (k % 300) for k in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts, pa.string()), pa.array([[k] * (k % 3) for k in range(2000)])], ["id", "t", "a"])
    for whole in (batch, batch.slice(37), batch.slice(5, 100), batch.slice(0, 0)):
        found = list(common.sliced([whole]))
        assert [i for b in found for i in b.column("id").to_pylist()] == whole.column("id").to_pylist()
        assert all(b.num_rows == 1 or b.num_rows <= 500 and sum(len(t or "") for t in b.column("t").to_pylist()) <= 40_000 for b in found)


def test_t_occurrence_links_against_all_pairs():
    rnd = np.random.default_rng(8)
    base = [rnd.choice(300, 60, replace=False) for _ in range(6)]
    sets = []
    for _ in range(80):
        s = base[rnd.integers(6)].copy()
        s[rnd.choice(60, rnd.integers(0, 10), replace=False)] = rnd.choice(1000, 1) + 1000
        sets.append(np.unique(s).astype(np.uint64))
    for threshold in (Fraction(9, 10), Fraction(8, 10), Fraction(1, 2)):
        side = rnd.integers(0, 2, len(sets))
        for sides in (None, side):
            links = ngram_join.search_links(sets, threshold, sides)

            def groups(pairs):
                root = list(range(len(sets)))
                for a, b in pairs:
                    x, y = root[a], root[b]
                    root = [x if r == y else r for r in root]
                return [root.index(r) for r in root]

            full = [(a, b) for a in range(len(sets)) for b in range(a) if (sides is None or sides[a] != sides[b]) and len(np.intersect1d(sets[a], sets[b])) >= threshold * len(np.union1d(sets[a], sets[b]))]
            assert groups(links) == groups(full)


def test_components_of_chains_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(10, 60)] + [(100, k) for k in range(101, 140)] + [(5, 5), (None, 3), (7, None), (201, 200), (200, 201)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {k: 10 for k in range(10, 61)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removals(rows, window):
    texts = {}
    for i, t, *_ in rows:
        texts[i] = WORD.findall(t or "")
    least = {}
    for i, w in texts.items():
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            least[run] = min(least.get(run, i), i)
    out = {}
    for i, w in texts.items():
        gone = {p for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < i for p in range(k, k + window)}
        out[i] = [x for p, x in enumerate(w) if p not in gone], len(w)
    return out


@pytest.mark.parametrize("many", [4000, 12, 3])
@pytest.mark.parametrize("window", [50, 10])
def test_removed_words_are_those_of_brute_force(spark, monkeypatch, many, window):
    monkeypatch.setattr(substring, "HOT", many)
    monkeypatch.setattr(substring, "SHARD_WORDS", 3000)
    rows = made(9)
    docs = spark.createDataFrame(rows, DOCS)
    expected = brute_removals(rows, window)
    out = substring.deduplicate(docs, window, keep=("shard",)).collect()
    assert len(out) == len(rows)
    for r in out:
        kept, n = expected[r.doc_id]
        assert (r.n_words, r.n_removed) == (n, n - len(kept)) and r.kept_sha256 == hashlib.sha256(" ".join(kept).encode()).hexdigest()
        assert WORD.findall(r.text or "") == kept and r.shard == 1
    assert sum(r.n_removed for r in out) > 500


def test_dedup_of_nothing_and_without_ids(spark):
    assert substring.deduplicate(spark.createDataFrame([], DOCS)).count() == 0
    long = " ".join(f"w{k}" for k in range(70))
    out = substring.deduplicate(spark.createDataFrame([(None, long, 1, "x"), (4, long, 1, "x"), (5, long, 1, "x")], DOCS)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in out) == [("4", 0), ("5", 70), ("None", 0)]


def test_anchors_in_blocks(monkeypatch):
    h = np.random.default_rng(3).integers(0, 2**63, 500).astype(np.uint64)
    whole = substring.anchors(h, 50)
    monkeypatch.setattr(substring, "BLOCK", 37)
    parts = substring.anchors(h, 50)
    spread = [np.repeat(a, n) for a, _, n in (whole, parts)]
    assert (spread[0] == spread[1]).all() and len(spread[0]) == 451


def test_a_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT", 20)
    rnd = random.Random(15)
    words = [f"w{k}" for k in range(300)]
    passage = [rnd.choice(words) for _ in range(70)]
    rows = []
    for k in range(150):
        own = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
        at = rnd.randint(0, len(own))
        rows.append((k, " ".join(own[:at] + passage[: rnd.choice([70, 70, 60])] + own[at:]), 1, "x"))
    rows.append((-1, " ".join(["again"] * 3000), 1, "x"))
    rows.append((500, " ".join(["again"] * 200), 1, "x"))
    expected = brute_removals(rows, 50)
    for r in substring.deduplicate(spark.createDataFrame(rows, DOCS)).collect():
        assert WORD.findall(r.text) == expected[r.doc_id][0]


def test_matching_statistics_of_texts_that_the_index_does_not_hold():
    rng = np.random.default_rng(0)

    def having(seqs, x):
        return [j for j, t in enumerate(seqs) if any((t[p : p + len(x)] == x).all() for p in range(len(t) - len(x) + 1))]

    for _ in range(40):
        n, window, letters = int(rng.integers(1, 12)), int(rng.integers(1, 9)), int(rng.integers(1, 7))
        seqs = [rng.integers(0, letters, rng.integers(1, 25)) for _ in range(n)]
        owner = rng.integers(0, 100, n)
        asked = [rng.integers(-1, letters + 2, rng.integers(0, 40)) for _ in range(4)]
        for _ in range(3):
            s = seqs[rng.integers(n)]
            asked.append(np.concatenate([rng.integers(-1, letters + 2, 3), s[rng.integers(0, len(s)) :], s, rng.integers(0, letters, 2)]))
        for s, length, least in zip(asked, *fm_index.ShardIndex(seqs, owner, window).stream(asked)):
            for k in range(len(s)):
                best = next(m for m in range(len(s) - k, -1, -1) if not m or having(seqs, s[k : k + m]))
                assert length[k] == best
                assert least[k] == (min(owner[j] for j in having(seqs, s[k : k + window])) if best >= window else fm_index.NONE)


def test_nearest_smaller_values():
    rng = np.random.default_rng(1)
    for n in (1, 60, 64, 65, 5000):
        values = np.concatenate([[0], rng.integers(0, 9, n), [0]]).astype(np.uint8)
        values[3:-3][: n // 2] = 9
        at, v = rng.integers(0, n + 2, 200), rng.integers(1, 10, 200)
        for back in (True, False):
            found = fm_index.Minima(values).smaller(at, v, back)
            for p, x, f in zip(at, v, found):
                assert f == (max(k for k in range(p + 1) if values[k] < x) if back else min(k for k in range(p, n + 2) if values[k] < x))


def test_pipeline_stage_by_stage(spark):
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    extra = docs.limit(3).withColumn("text", F.lit("123 !!")).withColumn("doc_id", F.col("doc_id") + 10_000)
    docs = docs.unionByName(extra).unionByName(docs.limit(2)).withColumn("rows", F.lit(1)).withColumn("rest", F.lit("r")).withColumn("score", F.lit(0.1))
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data).persist()
        kept[name] = out.collect()
        if name != names[-1]:
            assert out.columns == docs.columns
            before, docs = docs.collect(), out
        if name == "language_id":
            model = langid.fit(spark.createDataFrame(before, out.schema))
            good = {(r.doc_id, r.text) for r in langid.predict(spark.createDataFrame(before, out.schema).withColumn("t", F.struct("text")), model, ("t",)).selectExpr("doc_id", "t.text", "lang_pred", "score").collect() if r.lang_pred != "und" and r.score >= 0.5}
            assert {(r.doc_id, r.text) for r in kept[name]} == good and not any(r.doc_id >= 10_000 for r in kept[name])
        if name == "near_duplicates":
            groups = brute_components([(r.doc_id, r.text) for r in before], 5, Fraction(8, 10))
            assert sorted(r.doc_id for r in kept[name]) == sorted(i for i, (_, c) in groups.items() if i == c)
        if name == "substring_dedup":
            expected = {i: w for i, (w, _) in brute_removals([(r.doc_id, r.text) for r in before], 50).items() if w}
            assert {r.doc_id: WORD.findall(r.text) for r in kept[name]} == expected and all(r.n_chars == len(r.text) for r in kept[name])
        if name == "decontamination":
            flat = lambda s: " ".join(s.lower().split())
            items = [flat(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert {r.doc_id for r in kept[name]} == {r.doc_id for r in before if not any(x in flat(r.text) for x in items)}
    assert {r.doc_id for r in kept["tokens"]} == {r.doc_id for r in kept["decontamination"]}


def test_pipeline_stages_on_odd_rows(spark):
    data = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{data}/documents.parquet").schema
    rows = [(None, "the and of the", "en", "s", 1), (1, None, None, None, None), (2, "", "en", "s", 0), (3, "the and of", "en", "s", 1), (3, "the and of", "en", "s", 1)]
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, frame, data).collect()
