"""Hard negatives, chunked encoding and spelling variants, against plain versions and the library."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tellal.llm import chunked_bpe, hard_negatives, spelling

# 11

VECTORS = "vec_id long, embedding array<float>, label int, uid string, block int"


def plain_negatives(rows, every=50, positives=5, negatives=3, least=50, greatest=95):
    """rows: (vec_id, vector, label). The same by looking at every pair."""
    some = []
    for vec_id, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            bound = int((2**62 / max(1, len(v))) ** 0.5)
            some.append((vec_id, [max(-bound, min(bound, math.floor(256 * x))) for x in v], label))
    order, out = lambda x: (-x[0], x[1] is None, x[1] or 0), []
    for i, (anchor, q, label) in enumerate(some):
        if anchor is None or anchor % every:
            continue
        scored = [(sum(a * b for a, b in zip(q, v)), vec_id, other) for j, (vec_id, v, other) in enumerate(some) if j != i]
        for p, positive, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            there = sorted((s for s in scored if s[2] != label and least * p <= 100 * s[0] <= greatest * p), key=order)
            out += [(anchor, positive, k, s[1], p, s[0]) for k, s in enumerate(there[:negatives], 1)]
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(a, v, label, "x", 1) for a, v, label in rows], VECTORS)
    found = hard_negatives.mine(df, **options)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return [tuple(r) for r in found.collect()]


def ordered(rows):
    return sorted(rows, key=str)


def vectors(seed, n=400, dims=12, labels=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(labels, dims)) * 0.3
    label = rnd.integers(0, labels, n)
    return [(int(k), [float(np.float32(x)) for x in rnd.normal(size=dims) * 0.2 + centres[c]], int(c)) for k, c in enumerate(label)]


@pytest.mark.parametrize("rows,anchors,components", [(8192, 2048, 1 << 22), (64, 7, 300)])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, rows, anchors, components):
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    monkeypatch.setattr(hard_negatives, "COMPONENTS", components)
    made = vectors(1)
    expected = plain_negatives(made, every=10)
    assert len(expected) > 150 and ordered(mined(spark, made, every=10)) == ordered(expected)


def test_negatives_of_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    made = vectors(2, 60, 5)
    made += [(100, None, 1), (150, [0.1] * 5, None), (200, [0.1, None, 0.1, 0.1, 0.1], 1), (250, [inf] * 5, 1), (300, [nan, 0.0, 0.0, 0.0, 0.0], 2)]  # none of these takes part
    made += [(350, [], 0), (400, [0.5] * 9, 1), (450, [1e30, -1e30, 0.0], 2), (None, [0.4] * 5, 1), (None, [0.4] * 5, 1), (500, [0.0] * 5, 1)]
    made += [(550, [0.3] * 5, 1)] * 3 + [(550, [0.2] * 5, 1)] + [(600 + k, [0.25] * 5, 2) for k in range(9)]  # equal rows and ties
    expected = plain_negatives(made)
    assert expected and ordered(mined(spark, made)) == ordered(expected)


def test_negatives_of_little(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.6], 2)]) == [(0, 1, 1, 2, 65536, 39168)]
    assert mined(spark, [(7, [1.0], 1), (8, [1.0], 1), (9, [0.6], 2)]) == []  # no anchor


def test_a_vector_that_a_third_of_the_rows_have(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 32)
    made = vectors(3, 200, 6) + [(1000 + k, [0.3, 0.1, 0.2, 0.0, 0.1, 0.4], k % 2) for k in range(100)]
    assert ordered(mined(spark, made)) == ordered(plain_negatives(made))


def test_a_scan_reads_few_candidates_to_the_end(spark):
    rnd = np.random.default_rng(4)
    x = rnd.normal(size=(4000, 16)) * 10
    x[:, :3] *= 20  # most of a score comes from few dimensions
    labels = np.zeros(len(x), np.int64)
    row = hard_negatives.packed_rows([(np.arange(len(x)), labels, np.full(len(x), -1), np.arange(0, x.size + 1, 16), np.floor(x).astype(np.int64).ravel())], 16, 0)
    block = hard_negatives.Block(row)
    scan, seen = hard_negatives.Scan(block, block), []
    hard_negatives_read = scan.x

    class Watched(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            seen.append(out.shape[-1])
            return out.view(np.ndarray)

    scan.x = hard_negatives_read.view(Watched)
    at, scores = hard_negatives.nearest(scan, block, 7, 5)
    exact = block.x.astype(np.int64).T @ block.x[:, 7].astype(np.int64)
    exact[7] = exact.min()
    assert sorted(scores) == sorted(np.sort(exact)[-5:]) and seen[-1] < len(x) / 10


# 12


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", " ", "  ", "\n", "'", "'l", "'re", "l", "é", "中", "1", "!", "the", "🙂", "\xa0", "<|endoftext|>"]


def made_text(rnd, most=40):
    few = rnd.sample(PARTS, rnd.randint(1, 6))
    return "".join(rnd.choice(few) * rnd.choice([1, 1, 2, 30]) for _ in range(rnd.randint(0, most)))


def stitched(text):
    """What the chunks of a text give, one after the other."""
    ranks, out, entry, most = chunked_bpe.load(chunked_bpe.default_path()), [], 0, 0
    for begin, head, core, part in chunked_bpe.cut(text):
        pieces, over = chunked_bpe.chunk_pieces(part, core)
        assert "".join(pieces) == (part[:over] if core >= 0 else part)
        places = [*itertools.accumulate(map(len, pieces), initial=begin)]
        out += [i for at, piece in zip(places, pieces) if at >= entry for i in ranks.merge(piece.encode())]
        assert entry in places and entry <= begin + head
        entry, most = begin + over, max(most, len(part))
    return out, most


@pytest.mark.parametrize("size", [10, 13, 31, 64])
def test_stitched_chunks_are_the_librarys(monkeypatch, library, size):
    monkeypatch.setattr(chunked_bpe, "CHUNK", size)
    monkeypatch.setattr(chunked_bpe, "OVERLAP", 6)
    rnd = random.Random(size)
    for _ in range(1500):
        text = made_text(rnd)
        assert stitched(text)[0] == library.encode_ordinary(text)


def test_chunks_are_bounded_and_meet_behind_a_run(monkeypatch, library):
    text = "so it's 1234 " * 4000 + "a" * 50_000 + " and on it goes " * 4000
    ids, most = stitched(text)
    assert ids == library.encode_ordinary(text) and most < 50_000 + 3 * chunked_bpe.CHUNK
    assert stitched("word " * 40_000)[1] <= chunked_bpe.CHUNK + 2 * chunked_bpe.OVERLAP
    assert len(list(chunked_bpe.cut("a" * 100_000))) == 1


@pytest.mark.parametrize("letters", ["a", "ab", "abcdehinorst", "中文é"])
@pytest.mark.parametrize("n", [64, 65, 66, 2000])
def test_long_pieces_merge_like_short_ones(library, letters, n):
    ranks, rnd = chunked_bpe.load(chunked_bpe.default_path()), random.Random(n)
    for _ in range(5):
        piece = "".join(rnd.choice(letters) for _ in range(n))
        assert ranks.merge(piece.encode()) == library.encode_ordinary(piece)
        data = piece.encode()[:300]
        assert ranks._merge_short(data) == ranks._merge_long(data)


def test_short_pieces_are_merged_without_making_parts(library):
    class Whole(bytes):
        """Bytes whose slices are counted; parts that are joined would be plain bytes that no slice counts."""

        made = 0

        def __getitem__(self, key):
            Whole.made += 1
            return bytes(self)[key]

    ranks, rnd = chunked_bpe.load(chunked_bpe.default_path()), random.Random(4)
    for _ in range(300):
        text = "".join(rnd.choice("abcdehinorst") for _ in range(rnd.randint(2, 30)))
        ids, Whole.made = library.encode_ordinary(text), 0
        if len(ids) > 1:
            assert ranks._merge_short(Whole(text.encode())) == ids
            assert Whole.made <= len(text) - 1 + 2 * (len(text) - len(ids)) + len(ids) and Whole.made >= len(text) - 1 + len(ids)


@pytest.mark.parametrize("size,overlap", [(1 << 14, 256), (40, 10)])
def test_documents_are_encoded_as_by_the_library(spark, monkeypatch, library, size, overlap):
    monkeypatch.setattr(chunked_bpe, "CHUNK", size)
    monkeypatch.setattr(chunked_bpe, "OVERLAP", overlap)
    rnd = random.Random(9)
    made = ["", None, " ", "\n\n", "é" * 3, "<|endoftext|> a <|endoftext|>", "🙂" * 50, "a" * 40_000, "The end's near, it'll be 1234!  \n x" * 700] + [made_text(rnd, 60) for _ in range(40)]
    rows = [(k, t, "x", 1) for k, t in enumerate(made)] + [(8, made[8], "y", 2), (8, made[8], "y", 2), (None, "no id " * 9000, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, document string, number int")
    found = Counter()
    for r in chunked_bpe.encode_texts(docs).collect():
        found[(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids))] += 1
    expected = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        expected[(doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest(), tuple(ids))] += 1
    assert found == expected
    assert "ids" not in chunked_bpe.encode_texts(docs, keep_ids=False).columns
    assert chunked_bpe.encode_texts(docs.limit(0)).collect() == []


# 13


def plain_variants(rows, one_in=199, least_count=5):
    counts = Counter()
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                k = h % len(run)
                counts[run[:k] + run[k + 1 :] if h % one_in == 0 else run] += 1
            run = ""
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    others = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in others.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(others[w]), n.get(form[w])))
    return out


def variant_rows(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, word string, n int")
    found = spelling.variants(spelling.word_counts(docs, **options))
    assert dict(found.dtypes) == dict(word="string", form="string", root="string", n="bigint", n_near="bigint", form_n="bigint")
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in found.collect()}


@pytest.mark.parametrize("one_in", [199, 3])
def test_variants_are_those_of_all_pairs(spark, one_in):
    rnd = random.Random(one_in)
    base = ["".join(rnd.choice("abcdéñ") for _ in range(rnd.randint(5, 9))) for _ in range(40)]
    rows = []
    for doc_id in range(150):
        words = []
        for _ in range(60):
            w = base[min(int(rnd.paretovariate(0.7)) - 1, len(base) - 1)]
            if rnd.random() < 0.2:
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abé") + w[k:], w[:k] + rnd.choice("abé") + w[k + 1 :]])
            words.append(w.upper() if rnd.random() < 0.1 else w)
        rows.append((doc_id if doc_id % 20 else None, rnd.choice([" ", ", ", "1"]).join(words)))
    rows += [(3, None), (4, ""), (5, "short"), rows[1], rows[1], (6, "longword " * 3000), (7, "longwörd " * 100), (8, "longwöród " * 6)]
    expected = plain_variants(rows, one_in)
    assert len([x for x in expected if x[1]]) > 20 and any(x[1] != x[2] and x[1] for x in expected)
    assert variant_rows(spark, rows, one_in=one_in) == expected


def test_variants_of_nothing(spark):
    assert variant_rows(spark, []) == set()
    assert variant_rows(spark, [(1, None), (2, "five words are not enough")]) == set()


@pytest.mark.parametrize("scheme", [spelling.REPLACED, (2, 2, 4), (2, 3, 1), (1, 2, 2), spelling.INSERTED])
def test_vectors_within_the_distance_share_a_signature(scheme):
    rnd = random.Random(5)
    distance, groups, parts = scheme
    assert len(set(spelling.choices(*scheme))) == len(spelling.choices(*scheme))
    for _ in range(300):
        w = "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 12)))
        k = rnd.randrange(len(w) + 1)
        v = w[:k] + rnd.choice("abz") + w[k + (distance == 2) :]
        a, b = spelling.signatures([w, v], *scheme)
        assert (a == b).any()
    with pytest.raises(ValueError):
        spelling.choices(2, 1, 2)


def test_signatures_keep_most_other_words_apart():
    rnd = random.Random(6)
    words = list({"".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(400)})
    keys = spelling.signatures(words, *spelling.REPLACED)
    met = sum((keys[i] == keys[j]).any() for i in range(len(words)) for j in range(i))
    assert met < len(words) * (len(words) - 1) / 2 / 500


def test_tables_of_words_are_not_sent_to_the_driver(spark):
    words = spark.createDataFrame([("kitaplar", 50), ("kitaplr", 5), ("kitaplara", 6)], "word string, n long")
    found = spelling.variants(words)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in spelling.near_words(words)._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["word"], r["form"]) for r in found.collect()) == [("kitaplar", None), ("kitaplara", "kitaplar"), ("kitaplr", "kitaplar")]
