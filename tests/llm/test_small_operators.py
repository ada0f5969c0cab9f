"""Operators that work row by row or conversation by conversation, against plain versions."""

import hashlib
import math
import random
import re
import textwrap

import numpy as np
import pytest
import regex
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tellal.llm import bpe, chat, decontam, langid, license, quality, token_count, winnow

DOCS = "doc_id long, text string, lang string, extra int"
ODD = ["", None, " ", "\n\n", "é" * 3, "<|endoftext|> a <|endoftext|>", "🙂" * 50, "a" * 40_000, "The end's near, it'll be 1234!  \n x", "The end's near, it'll be 1234!  \n x"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(k, t, None, 1) for k, t in enumerate(ODD)] + [(None, "no id", "en", 1)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


# 10


def test_bpe_is_the_librarys(odd, documents, tokenizer):
    for docs in (odd, documents):
        texts = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in bpe.encode_texts(docs).collect():
            ids = tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_streams_in_any_pieces(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 20)
    model, rnd = bpe.load(bpe.default_path()), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "'l", "'re", "l", "<|endoftext|>", "<|endo", "ftext|>", "é", "中", "1", "!", "the", "🙂", "\xa0"]
    for _ in range(1500):
        few = rnd.sample(parts, rnd.randint(1, 6))
        text = "".join(rnd.choice(few) * rnd.choice([1, 1, 2, 30]) for _ in range(rnd.randint(0, 40)))
        stream, out, k = bpe.StreamEncoder(model), [], 0
        while k < len(text):
            step = rnd.randint(1, 50)
            out += stream.feed(text[k : k + step])
            k += step
        assert out + list(stream.finish()) == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["The end's near, it'll be 1234!  \n x <|endoftext|>\n\n  é中🙂", "a" * 60 + "   b", "<|endo<|endoftext|>ftext|> we're  "])
def test_bpe_of_every_piece_size_is_the_librarys(tokenizer, text):
    model, ids = bpe.load(bpe.default_path()), tokenizer.encode(text, add_special_tokens=False).ids
    for size in range(1, len(text) + 2):
        stream = bpe.StreamEncoder(model)
        out = [i for k in range(0, len(text), size) for i in stream.feed(text[k : k + size])] + list(stream.finish())
        assert out == ids


def test_bpe_emits_while_it_reads_and_holds_little(documents, tokenizer):
    model = bpe.load(bpe.default_path())
    text = max((r.text or "" for r in documents.collect()), key=len) + "long" * 50_000
    stream, n = bpe.StreamEncoder(model), 0
    for k in range(0, len(text), bpe.BLOCK):
        n += len(stream.feed(text[k : k + bpe.BLOCK]))
        assert len(stream.tail) < 2 * bpe.BLOCK and (not stream.stream or len(stream.stream.held) < model.window + model.lookahead)
    assert n > 0.99 * len(tokenizer.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("letters", ["a", "ab", "the", " ", "!", "é", "=-", "etaoins", "abcdefghijklmnopqrstuvwxyz"])
def test_bpe_of_an_unbroken_run(tokenizer, letters, monkeypatch):
    rnd, model = random.Random(2), bpe.load(bpe.default_path())
    text = "".join(rnd.choice(letters) for _ in range(60_000))
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    assert bpe.encode(model, text) == ids
    # no more than a token is merged ahead of what must be held
    monkeypatch.setattr(model, "window", max(map(len, model.bytes_of)))
    assert bpe.encode(model, text) == ids


def test_odd_tables_of_the_row_operators(spark, odd, none):
    """Repeated rows, ids that are null, clashing names and empty tables."""
    clash = odd.unionByName(odd).withColumnsRenamed({"lang": "ids", "extra": "n_tokens"})
    for found in (bpe.encode_texts(clash), token_count.count_edited(clash)):
        assert found.count() == 2 * (len(ODD) + 1)
    assert bpe.encode_texts(none).count() == 0 and token_count.count_edited(none).count() == 0


def test_decoder_waits_for_whole_characters():
    model = bpe.load(bpe.default_path())
    ids, decoder = bpe.encode(model, "🙂é"), bpe.StreamDecoder(model)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == "🙂é"
    half = bpe.StreamDecoder(model)
    assert half.feed(ids[:1]) + half.finish() == "�"


# 1


def test_chat_round_trip(spark):
    rows = [(1, 2, "assistant", "<s>\\l[/INST]"), (1, 1, "user", None), (1, None, None, "x"), (2, 0, "assistant", "[IMAGE 1]\n"), (None, 0, "user", "a"), (1, 2, "assistant", "<s>\\l[/INST]"), (3, 5, "sys\ntem", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat.format_turns(turns)
    for r in segments.collect():
        assert not chat.CONTROL.search(r.segment.replace("<s>", "", 1)[: -len("</s>")].replace("\\", ""))
    out = {r.conv_id: r for r in chat.digest_conversations(segments).collect()}
    expected = "\nx\nuser\n\nassistant\n<s>\\l[/INST]\nassistant\n<s>\\l[/INST]\n"
    assert out[1].turns_sha256 == hashlib.sha256(expected.encode()).hexdigest() and out[1].n_turns == 4
    assert out[1].loss_sha256 == hashlib.sha256(("<s>\\l[/INST]" * 2).encode()).hexdigest() and out[1].loss_chars == 24
    assert out[3].loss_chars == 0 and out[None].n_turns == 1
    whole = {r.conv_id: r for r in chat.conversation_texts(segments).collect()}
    assert [chat.unescape(whole[1].formatted[s.start : s.end]) for s in whole[1].loss_spans] == ["<s>\\l[/INST]"] * 2
    assert out[1].formatted_chars == len(whole[1].formatted)
    assert chat.digest_conversations(chat.format_turns(turns.limit(0))).count() == 0


def test_chat_parts(spark):
    parts = "array(named_struct('type','text','text','see [IMAGE 1]','ref',null,'units',null), named_struct('type','image','text',null,'ref','a.png','units',4), named_struct('type','audio','text',null,'ref','b.wav','units',2), named_struct('type','document','text',null,'ref','c.pdf','units',null))"
    r = chat.format_turns(spark.sql(f"select 1L as conv_id, 0L as turn, 'user' as role, {parts} as parts")).first()
    assert r.segment == "<s>user\nsee \\oIMAGE 1][IMAGE 1][AUDIO 2][DOCUMENT 3]</s>" and [a.ref for a in r.attachments] == ["a.png", "b.wav", "c.pdf"] and r.expanded_tokens == 1024 + 50 + 600


def test_chat_parts_of_other_types_and_numbers_through_a_conversation(spark):
    def part(kind, text=None, ref=None):
        return (kind, text, ref, None)

    rows = [
        (1, 0, "user", [part("text", "a"), part("image", ref="x"), None, part("video", ref="v")]),
        (1, 1, "assistant", [part(None, "b")]),
        (1, 2, "user", [part("audio", ref="y"), part("text", None)]),
        (1, None, "user", [part("image", ref="w")]),
        (2, 0, "user", None),
        (2, 0, "user", []),
        (None, 0, "user", [part("document", ref="z")]),
    ]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}").withColumn("segment", F.lit("clash")).withColumn("first", F.lit("clash"))
    segments = chat.format_turns(turns)
    out = {(r.conv_id, r.turn): r for r in segments.where("conv_id = 1 or conv_id is null").collect()}
    assert out[1, None].segment == "<s>user\n[IMAGE 1]</s>"
    assert out[1, 0].segment == "<s>user\na[IMAGE 2][OTHER 3]</s>" and [(a.kind, a.ref, a.tokens) for a in out[1, 0].attachments] == [("image", "x", 256), ("video", "v", 0)]
    assert out[1, 2].segment == "<s>user\n[AUDIO 4]</s>" and out[None, 0].segment == "<s>user\n[DOCUMENT 1]</s>"
    whole = {r.conv_id: r for r in chat.conversation_texts(segments).collect()}
    assert [a.placeholder for a in whole[1].attachments] == ["[IMAGE 1]", "[IMAGE 2]", "[OTHER 3]", "[AUDIO 4]"] and whole[2].formatted == "<s>user\n</s>" * 2
    assert [whole[1].formatted[x.start : x.end] for x in whole[1].loss_spans] == ["b"]


def test_chat_of_tied_control_strings_long_texts_and_the_sql(spark):
    import duckdb
    import pandas as pd

    from tellal.llm.queries import OP1_SQL

    parts = ["<s>", "</s>", "\\", "[INST]", "[/INST]", "<<SYS>>", "<|x|>", "[IMAGE 3]", "[OTHER 1]", "a", "\n", "<", "[", "é"]
    rnd = random.Random(11)
    rows = [(k % 5, rnd.choice([0, 1, None]), rnd.choice(["user", "assistant", "a<s>b"]), "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 6)))) for k in range(300)]
    rows += [(9, 0, "assistant", "long <s> text " * 100_000), *rows[:3]]
    own = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    schema = "conv_id long, turn long, role string, text string"
    out = chat.digest_conversations(chat.format_turns(spark.createDataFrame(rows + own, schema).withColumn("parts_", F.lit(1)))).collect()
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})  # noqa: F841
    expected = duckdb.sql(OP1_SQL).fetchall()
    assert sorted(map(tuple, out)) == sorted(expected)


# 2, 3


def held_out_accuracy(predicted, truth):
    return sum(predicted[k] == v for k, v in truth.items()) / len(truth)


def test_quality_on_held_out_documents(spark):
    from tellal.llm.queries import op2_compression_quality

    data = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op2_compression_quality(spark, data).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{data}/labels.parquet").collect() if rows[r.doc_id].held_out}
    assert len(rows) == 1000 and held_out_accuracy({k: rows[k].predicted for k in truth}, truth) > 0.9
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_quality_scores_are_those_of_a_plain_version(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.fit(documents, labels)

    def plain(text):
        sizes = []
        for data in (model.good, model.bad):
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            b = text.encode()
            sizes.append(sum(len(c.compress(b[k : k + quality.BLOCK])) for k in range(0, len(b), quality.BLOCK)))
        return 1 / (1 + math.exp(-(model.slope * (sizes[1] - sizes[0]) / sum(sizes) + model.shift)))

    long = "a very long text without an end. " * 20_000
    docs = documents.select("doc_id", "text").limit(40).unionByName(spark.createDataFrame([(None, long), (None, long)], "doc_id long, text string")).withColumn("score", F.lit("clash"))
    out = quality.score(docs, model).collect()
    texts = [r.text for r in docs.collect()]
    assert len(out) == 42 and all(abs(r.score - plain(t)) < 1e-9 for r, t in zip(out, texts) if t and t.strip())


def test_quality_sample_is_bounded_and_takes_slices(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 300)
    rnd = random.Random(12)
    good, bad = ["river bridge council meeting", "report of the harbour"], ["buy now cheap", "click win prize"]
    rows = [(k, " ".join(rnd.choice(good if k % 2 else bad) for _ in range(400))) for k in range(60)]
    docs = spark.createDataFrame(rows * 3 + [(None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1, 0), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels, sample=20)
    assert 0 < len(model.good) <= 20 * 300 and {r.doc_id: r.score > 0.5 for r in quality.score(docs, model).collect() if r.doc_id is not None} == {k: k % 2 == 1 for k in range(60)}


def test_quality_without_labels_or_texts(spark, odd, none):
    labels = spark.createDataFrame([(0, 1), (None, 0)], "doc_id long, quality int")
    model = quality.fit(odd, labels)
    assert {r.score for r in quality.score(odd, model).collect()} == {1.0}
    assert quality.score(none, quality.fit(none, labels.limit(0))).count() == 0


def test_language_on_held_out_documents(spark):
    from tellal.llm.queries import op3_language_id

    data = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in op3_language_id(spark, data).collect()}
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect() if rows[r.doc_id].held_out}
    assert held_out_accuracy({k: rows[k].lang_pred for k in truth}, truth) > 0.98


def test_language_of_odd_texts(spark, odd, none, documents):
    found = {r.doc_id: r for r in langid.predict(odd, langid.fit(documents)).collect()}
    assert [found[k].lang_pred for k in (0, 1, 2, 3, 6)] == ["und"] * 5 and found[0].score == 0 and found[8].lang_pred == "en"
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none)).collect()} == {"und"}


def test_language_scores_are_those_of_a_plain_version(spark, documents):
    model = langid.fit(documents)
    words = {w: dict(zip(model.languages, model.log_words[k].astype(float))) for w, k in model.words.items()}
    grams = {g: dict(zip(model.languages, model.log_grams[k].astype(float))) for g, k in model.grams.items()}

    def plain(text):
        total = dict.fromkeys(model.languages, 0.0)
        found = regex.findall(r"\p{L}+", text.lower())
        for word in found:
            own = dict.fromkeys(model.languages, 0.0)
            if word in words:
                own = words[word]
            else:
                w, p = f" {word} ", 0
                while p < len(w):
                    k = next((k for k in range(langid.LONGEST, 0, -1) if w[p : p + k] in grams and p + k <= len(w)), None)
                    if k:
                        own = {x: own[x] + grams[w[p : p + k]][x] for x in own}
                    p += k or 1
            best = max(own.values())
            total = {x: total[x] + own[x] - best for x in total}
        n = min(len(found), langid.ENOUGH) / len(found)
        total = {x: v * n for x, v in total.items()}
        best = min(x for x in total if total[x] == max(total.values()))
        return best, 1 / sum(math.exp(v - total[best]) for v in total.values())

    docs = documents.select("doc_id", "text").where("length(text) between 1 and 3000").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = langid.predict(docs.unionByName(docs).withColumn("lang_pred", F.lit("clash")), model).collect()
    assert len(rows) == 2 * len(texts)
    for r in rows:
        if regex.search(r"\p{L}", texts[r.doc_id]):
            lang, score = plain(texts[r.doc_id])
            assert r.lang_pred == lang and abs(r.score - score) < 1e-3


def test_numerals_are_no_letters_and_languages_of_long_texts_are_learned(spark, documents):
    rows = [(k, "½ ² Ⅷ ③ 12" if k == 0 else "", None) for k in range(2)]
    model = langid.fit(documents)
    assert [r.lang_pred for r in langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()] == ["und", "und"]
    long = [(9000 + k, "zeta omega kappa " * 10_000, "zz") for k in range(3)]
    lone = [(9100, "solitary", "yy"), (None, "lonely", "xx")]
    more = documents.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(long + lone, "doc_id long, text string, lang string"))
    model = langid.fit(more)
    assert "zz" in model.languages
    english = " ".join(documents.where("lang = 'en' and length(text) > 200").first().text.split()[:6])
    ask = spark.createDataFrame([(1, "zeta omega"), (2, english), (None, long[0][1])], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(ask, model).collect()] == ["zz", "en", "zz"]


# 4


def plain_winnow(text, k=winnow.K, w=winnow.WINDOW):
    h = [int(x) for x in winnow.gram_hashes(winnow.code_points(text), k) & ~winnow.LOW]
    picked = {max(range(s, min(s + w, len(h))), key=lambda p: (-h[p], p)) for s in range(max(1, len(h) - w + 1))}
    return sorted((p, h[p]) for p in picked)


def test_winnowing_is_the_plain_one(monkeypatch):
    monkeypatch.setattr(winnow, "BLOCK", 64)
    rnd = random.Random(3)
    for n in (16, 17, 31, 32, 200, 1000):
        for letters in ("ab", "a", "abcdefgh é"):
            text = "".join(rnd.choice(letters) for _ in range(n))
            hashes, places = winnow.winnow(text)
            assert list(zip(places.tolist(), hashes.tolist())) == plain_winnow(text)


def test_gram_hash_is_of_the_gram_alone():
    text = "abcdefghijklmnopqrstuvwxyz" * 2
    for k in (1, 3, 16, 24):
        h = winnow.gram_hashes(winnow.code_points(text), k)
        assert len(h) == len(text) - k + 1 and h[0] == h[26] and len(set(h[:26].tolist())) == 26


def test_winnowing_shared_passages():
    passage = "".join(random.Random(4).choice("abcdefghijk ") for _ in range(winnow.K + winnow.WINDOW - 1))
    a, b = winnow.winnow("x" * 40 + passage + "y" * 10), winnow.winnow("qrst" + passage + "uvw" * 9)
    assert np.intersect1d(a[0], b[0]).size


@pytest.mark.parametrize("rows_a_range", [2, 3, 1000])
def test_edits_follow_the_order_of_ids(spark, none, documents, rows_a_range):
    docs = documents.select("doc_id", "text").limit(60).unionByName(spark.createDataFrame([(10_000, None), (10_001, ""), (10_002, "x"), (None, "none")], "doc_id long, text string"))
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = {r.doc_id: r for r in winnow.compare_edits(docs, rows_a_range).collect()}
    assert len(out) == len(rows)
    for k, (doc, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        r, own = out[doc], winnow.winnow(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and r.fingerprint == winnow.digest(own) and r.edited_fingerprint == winnow.digest(winnow.winnow(changed))
        assert r.near_next == winnow.likeness(own[0], winnow.winnow(following)[0]) and 0 <= r.near_edited <= 1
    assert winnow.compare_edits(none).count() == 0


# 7


def test_licences(spark, odd, none):
    lines = [(1, "Hello to all who read this text\nReleased under the MIT License.\nbye and come again"), (2, "licensed   UNDER the apache license version 2 0"), (3, "Licensed under nothing at all, really, the version."), (4, None), (5, "")]
    rows = spark.createDataFrame(lines, "doc_id long, text string").withColumn("license", F.lit("clash")).withColumn("size", F.lit(1))
    assert [(r.doc_id, r.line, r.license) for r in license.find_licenses(rows).orderBy("doc_id").collect()] == [(1, 2, "MIT"), (2, 1, "Apache-2.0")]
    assert license.find_licenses(odd).count() == 0 and license.find_licenses(none).count() == 0


def test_licences_of_repeated_rows_and_rows_without_ids(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = spark.createDataFrame([(None, mit), (None, gpl), (7, mit), (7, mit), (8, mit), (8, gpl)], "doc_id long, text string")
    out = sorted((str(r.doc_id), r.line, r.license) for r in license.find_licenses(rows).collect())
    assert out == [("7", 1, "MIT"), ("7", 1, "MIT"), ("8", 1, "GPL-3.0"), ("8", 1, "MIT"), ("None", 1, "GPL-3.0"), ("None", 1, "MIT")]


def brute_passages(text, templates, threshold=0.8):
    def pairs(t):
        w = re.sub(r"[\W_]+", " ", t.lower()).strip().split(" ")
        return [f"{a} {b}" for a, b in zip(w, w[1:])]

    own, found = pairs(text), []
    for name, notice in templates:
        every = pairs(notice)
        known, span = set(every), int(len(every) * (2 - threshold) / threshold + 1e-9)
        for p in range(len(own)):
            if own[p] in known:
                scores = []
                for q in range(p, min(p + span, len(own))):
                    piece = set(own[p : q + 1])
                    if own[q] in known and 2 * len(piece & known) / (len(piece) + len(known)) >= threshold:
                        scores.append((-len(piece & known), -2 * len(piece & known) / (len(piece) + len(known)), name, p + 1, q + 1))
                found += [min(scores)] if scores else []
    kept = []
    for x in sorted(found):
        if not any(x[3] <= y[4] and y[3] <= x[4] for y in kept):
            kept.append(x)
    return sorted((start, last - start + 2, name, round(-dice, 9)) for _, dice, name, start, last in kept)


def test_licences_wrapped_embedded_and_within_a_line(spark, odd, none):
    full = {k: " ".join(t.split()) for k, t in license.TEXTS}
    texts = [
        "MIT License\n\nCopyright (c) 2020 A\n\n" + textwrap.fill(full["MIT"], 80),
        "some words before " + full["MIT"].split(" The above")[0] + " and many words after it " * 30,
        "We thank all who helped. Released under the MIT License. See the site for more.",
        "// " + "\n// ".join(textwrap.wrap(full["Apache-2.0"], 60)) + "\nint main() {}",
        textwrap.fill(full["BSD-2-Clause"], 70) + "\n\n" + textwrap.fill(full["BSD-3-Clause"], 70),
        "Licensed under CC\nBY 4.0. Released under the MIT License. Released under the MIT License.",
        "This program is free software and the license says nothing of the GNU General Public kind",
        textwrap.fill(full["GPL-3.0"], 72) + "\n" + textwrap.fill(full["LGPL-2.1"].replace("useful", "of some use"), 72),
    ]
    rows = [*enumerate(texts), (2, texts[2]), (None, texts[2])]
    out = license.find_passages(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))).collect()
    expected = [(k, *x) for k, t in rows for x in brute_passages(t, license.TEMPLATES + license.TEXTS)]
    assert sorted(((r.doc_id, r.first_word, r.n_words, r.license, round(r.dice, 9)) for r in out), key=str) == sorted(expected, key=str)
    names = {k: [x[2] for x in brute_passages(t, license.TEMPLATES + license.TEXTS)] for k, t in enumerate(texts)}
    assert names == {0: ["MIT"], 1: ["MIT"], 2: ["MIT"], 3: ["Apache-2.0"], 4: ["BSD-2-Clause", "BSD-3-Clause"], 5: ["CC-BY-4.0", "MIT", "MIT"], 6: [], 7: ["GPL-3.0", "LGPL-2.1"]}
    assert license.find_passages(odd).count() == 0 and license.find_passages(none).count() == 0


# 8


def test_edited_counts_are_recounts(monkeypatch, tokenizer):
    monkeypatch.setattr(token_count, "LEAF", 4)
    model, rnd = bpe.load(bpe.default_path()), random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "'", "'ll", "l", "s", "é", "1", "!", "-", "the ", " word", "\t", "<|endoftext|>", "<|endof", "text|>"]
    for _ in range(1500):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 80)))
        tree = token_count.TokenTree(model, text)
        for _ in range(4):
            at, removed, inserted = rnd.randint(0, len(text) + 2), rnd.choice([0, 1, 3, 20]), "".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 4, 40])))
            tree.edit(at, removed, inserted)
            at = min(at, len(text))
            text = text[:at] + inserted + text[at + removed :]
            assert tree.text() == text and tree.count == len(tokenizer.encode(text, add_special_tokens=False).ids)
            assert max(map(len, tree.leaves)) <= 2 * token_count.LEAF


def test_many_insertions_keep_leaves_small_and_edits_local():
    tree = token_count.TokenTree(bpe.load(bpe.default_path()), "one two three. " * 200)
    for k in range(2000):
        tree.edit(100, 0, f" word{k % 7}")
    assert max(map(len, tree.leaves)) <= 2 * token_count.LEAF and tree.encoded < 2000 * 30


def test_edited_counts_of_documents_are_the_librarys(spark, odd, documents, tokenizer):
    for docs in (odd, documents):
        before = {r.doc_id: r.text or "" for r in docs.collect()}
        for r in token_count.count_edited(docs).collect():
            text = before[r.doc_id]
            assert r.n_tokens == len(tokenizer.encode(text, add_special_tokens=False).ids)
            for at, removed, inserted in token_count.sample_edits(text):
                at = min(at, len(text))
                text = text[:at] + inserted + text[at + removed :]
            assert r.n_tokens_edited == len(tokenizer.encode(text, add_special_tokens=False).ids)
            assert r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest() and (r.n_encoded < 60 or r.doc_id == 7)


# 9


def test_leaks_against_brute_force(spark, odd, none):
    data = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    flat = lambda s: " ".join(s.lower().split())
    items = {r.item_id: flat(r.text) for r in bench.collect()}
    expected = {(r.doc_id, k) for r in docs.collect() for k, t in items.items() if t in flat(r.text)}
    found = decontam.find_leaks(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == expected
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(flat(texts[r.doc_id][r.begin : r.end]) == items[r.item_id] for r in found if not r.edits)
    clean = decontam.drop_leaks(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(texts) - {d for d, _ in expected}
    assert decontam.find_leaks(odd, bench).count() == 0 and decontam.find_leaks(none, bench).count() == 0
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 and decontam.drop_leaks(docs, bench.limit(0)).count() == docs.count()


def test_edited_leaks_are_found_and_a_large_benchmark_goes_in_blocks(spark, monkeypatch):
    rnd = random.Random(6)
    bench = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    rows = []
    for k, t in bench:
        s = list(t)
        for _ in range(int(0.06 * len(s))):
            p = rnd.randrange(len(s))
            s[p : p + rnd.randint(0, 1)] = rnd.choice("abcdefgh")
        rows.append((k, "Some words before. " + "".join(s) + " and some after."))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 3000)
    found = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, spark.createDataFrame([*bench, (99, None), (98, ""), (97, "before")], "item_id long, text string")).collect()}
    assert {(k, k) for k, _ in bench} <= found and {d for d, i in found if i == 97} == {k for k, _ in bench}


def test_a_benchmark_item_without_an_id_is_found(spark):
    item = "The committee will publish its findings about the river crossing before the end of the year."
    docs = spark.createDataFrame([(1, f"Before. {item} After."), (2, "Nothing of it."), (3, None), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(None, item), (None, item), (5, item), (6, None)], "item_id long, text string")
    found = sorted((r.doc_id or 0, r.item_id or 0) for r in decontam.find_leaks(docs, bench).collect())
    assert found == [(0, 0), (0, 0), (0, 5), (1, 0), (1, 0), (1, 5)]
    assert sorted(r.doc_id for r in decontam.drop_leaks(docs, bench.where("item_id is null")).collect()) == [2, 3]


def edit_distances(p, t):
    """The least number of edits that turn p into some stretch of t."""
    row = [0] * (len(t) + 1)
    for k, c in enumerate(p):
        now = [k + 1]
        for j, d in enumerate(t):
            now.append(min(row[j + 1] + 1, now[-1] + 1, row[j] + (c != d)))
        row = now
    return min(row)


def test_alignment_is_the_plain_one():
    rnd = random.Random(7)
    for _ in range(400):
        p, t = ("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 20))) for _ in range(2))
        best = edit_distances(p, t)
        found = decontam.align(winnow.code_points(p), winnow.code_points(t), -len(p), len(t) + 1, 4)
        assert (found is None) == (best > 4) and (found is None or found[2] == best == edit_distances(p, t[found[0] : found[1]]) and abs(found[1] - found[0] - len(p)) <= best)
        # within a band nothing better is found, and what lies on its diagonals is
        low = rnd.randint(-3, 10)
        part = decontam.align(winnow.code_points(p), winnow.code_points(t), low, low + 4, 20)
        assert part is None or part[2] >= best
        whole = decontam.align(winnow.code_points(p), winnow.code_points("z" * 7 + p + "zz"), 5, 9, 3)
        assert whole == (7, 7 + len(p), 0)


def test_leaks_are_exactly_what_edit_distances_say(spark):
    rnd = random.Random(16)
    letters = "abcdefgh "
    items = ["".join(rnd.choice(letters) for _ in range(n)).strip() for n in (5, 7, 8, 15, 16, 24, 40, 60, 90, 120, 40)]
    items[-1] = items[6]
    docs = []
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(0, 3)):
            s = list(rnd.choice(items))
            for _ in range(rnd.choice([0, 1, 2, 4, 6, 9])):
                at = rnd.randrange(len(s) + 1)
                s[at : at + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "xy"])
            parts += ["".join(s), "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 30)))]
        docs.append("".join(parts))
    flat = lambda s: " ".join(s.lower().split())
    expected = {(d, i) for d, t in enumerate(docs) for i, p in enumerate(items) if edit_distances(flat(p), flat(t)) <= decontam.allowed(len(flat(p)))}
    rows = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string").withColumn("begin", F.lit("clash"))
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    out = decontam.find_leaks(rows, bench).collect()
    assert {(r.doc_id, r.item_id) for r in out} == expected and len(out) == len(expected)
    for r in out:
        assert edit_distances(flat(items[r.item_id]), flat(docs[r.doc_id][r.begin : r.end])) == r.edits
    clean = decontam.drop_leaks(rows, bench)
    assert clean.columns == rows.columns and {r.doc_id for r in clean.collect()} == set(range(len(docs))) - {d for d, _ in expected}


@pytest.mark.parametrize("n", [300, 598, 599, 600, 601, 602, 1200, 4000])
def test_one_rule_for_items_of_every_length(spark, n):
    rnd = random.Random(n)
    item = "".join(rnd.choice("abcdefghij klmnop") for _ in range(n)).strip("  ")
    item = " ".join(item.split())
    s = list(item)
    for k in rnd.sample(range(len(s)), decontam.allowed(len(s)) // 2):
        s[k] = "z"
    rows = [(1, f"before {item} after"), (2, "before " + item[: 3 * len(item) // 4] + " after"), (3, item[len(item) // 4 :].upper()), (4, "x " + "".join(s) + " y"), (5, "")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.find_leaks(docs, bench).collect()) == [1, 4]
    for excerpt, expected in ((n // 2, [1, 2, 3, 4]), (n, [1, 4]), (10 * n, [1, 4])):
        assert sorted(r.doc_id for r in decontam.find_leaks(docs, bench, excerpt).collect()) == expected
        assert sorted(r.doc_id for r in decontam.drop_leaks(docs, bench, excerpt).collect()) == [d for d in range(1, 6) if d not in expected]


def test_an_excerpt_counts_where_it_is_asked_for(spark):
    rnd = random.Random(17)
    words = ["river", "bridge", "harbour", "council", "winter", "paper", "letter", "seven", "green", "market"]
    long, short = (" ".join(rnd.choice(words) + str(rnd.randrange(100)) for _ in range(n)) for n in (260, 40))
    rows = [(1, "before " + long[300:900] + " after"), (2, long[:300]), (3, short[: len(short) // 2]), (4, "x " + long.upper()), (5, " ".join(words) + "\n" + short), (6, "very long " * 200_000 + short)]
    bench = spark.createDataFrame([(1, long), (2, short), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame(rows + rows[:1], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench, 600).collect()) == [(1, 1), (1, 1), (4, 1), (5, 2), (6, 2)]
    assert sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()) == [(4, 1), (5, 2), (6, 2)]
