"""BPE, range coder, token files, language ID, licence scans and audio against plain versions."""

import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinsift.llm import audio, bpe, language, licenses, rangecoder, tokenfiles
from tests.llm.conftest import SMALL

TEXTS = ["", "  ", "It's I'LL 'S we've", "<|endoftext|>x <|startoftext|> a<|endoftext|>", "İstanbul ΣΑΣ ΟΔΟΣ é x y aaaa aaaaaaa", "ﬁ 12345 \x1c q \x85 z 漢字かな 🎉🎉 ẹ́ ", "a" * 3000, "ß" * 50 + " İ̇", "!?..\"\" x''y “quoted” —dash—"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.public_path())


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]


# ---- BPE ----------------------------------------------------------------------------------------


def test_bpe_equals_the_library(library, small):
    texts = TEXTS + [t for _, t in small]
    own = bpe.Bpe(bpe.public_path())
    for got, text in zip(own.encode([t.encode() for t in texts]), texts, strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want
        assert own.decode(got).decode() == library.decode(want, skip_special_tokens=False)


def test_bpe_with_a_full_cache(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT", 8)
    own = bpe.Bpe(bpe.public_path())
    for text in TEXTS * 2:
        assert np.frombuffer(own.encode([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def equal_to_library(library, texts):
    own, asked = bpe.load(bpe.public_path()), tokenfiles.library(bpe.public_path())
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.array(want.ids, "<u4").tobytes()
        for coder in (own, asked):
            assert coder.encode([text.encode()]) == [ids], ascii(text)


def test_every_letter_as_the_library_has_it(library):
    """Also those that this Python's Unicode and the library's see differently."""
    points = [chr(c) for c in [*range(1, 0x20000), *range(0xE0000, 0xE0200)] if not 0xD800 <= c < 0xE000]
    equal_to_library(library, [" ".join(f"a{c}B {c}{c} e{c}" for c in points[k : k + 500]) for k in range(0, len(points), 500)])


def test_mixed_texts_as_the_library_has_them(library):
    rng = random.Random(5)
    pool = [chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x250, 0xD800), rng.randrange(0xE000, 0x20000)])) for _ in range(2000)]
    pool += ["<|endoftext|>", "<|startoftext|>", "<|", "|>", "\x85", "\xa0", " ", "\n", "'s", "Σ"] * 30
    equal_to_library(library, ["".join(rng.choices(pool, k=rng.randrange(1, 15))) for _ in range(3000)])


@pytest.mark.parametrize("most", [1, 7, 30])
def test_slices_keep_pieces_whole(most):
    text = " ab cde\tf\n\nghijklmnopqrstuvwxyz  é 12 ".encode()
    parts = list(bpe.slices(text, most))
    assert b"".join(parts) == text and [p for part in parts for p in part.split()] == text.split()
    assert all(len(p) <= most or len(p.split()) == 1 for p in parts)


def test_long_texts_are_encoded_in_slices(monkeypatch, library):
    monkeypatch.setattr(bpe, "BATCH", 50)
    text = "It's a naïve text <|endoftext|> of some words, " * 40
    assert bpe.Bpe(bpe.public_path()).encode([text.encode()]) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


def test_bpe_query_columns(odd, odd_rows, empty, library):
    want = Counter()
    for r in odd_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(odd).collect())) == want
    assert bpe.digests(empty).count() == bpe.encode(empty).count() == 0
    assert Counter((r.doc_id, len(r.ids) // 4) for r in bpe.encode(odd).collect()) == Counter(x[:2] for x in want.elements())
    decoded = bpe.decode(bpe.encode(odd)).collect()
    assert Counter((r.doc_id, hashlib.sha256(r.decoded).hexdigest()) for r in decoded) == Counter((x[0], x[3]) for x in want.elements())


def test_merges_out_of_order_are_refused(tmp_path):
    import json

    with open(bpe.public_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "v.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="merge"):
        bpe.Bpe(str(tmp_path / "v.json"))


# ---- range coder and token files ----------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 1000, 9000])
@pytest.mark.parametrize("kind", ["zipf", "uniform", "same", "extreme"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {"zipf": rng.zipf(1.4, n) % 49408, "uniform": rng.integers(0, 49408, n), "same": np.full(n, 7), "extreme": rng.choice([0, 2**31 - 1, 2**32 - 1], n)}[kind]
    assert (rangecoder.decode(rangecoder.encode([ids]))[0] == ids).all()


def test_blocks_do_not_depend_on_each_other():
    rng = np.random.default_rng(0)
    blocks = [rng.zipf(1.3, int(n)) % 5000 for n in rng.integers(1, 4000, 40)]
    side_by_side = rangecoder.encode(blocks)
    assert side_by_side == [rangecoder.encode([b])[0] for b in blocks]
    back = rangecoder.decode(side_by_side[::-1])[::-1]
    assert all((a == b).all() for a, b in zip(back, blocks, strict=True))


def test_one_long_block_needs_no_more_than_itself():
    import tracemalloc

    rng = np.random.default_rng(3)
    short, long = [rng.integers(0, 3000, 2000) for _ in range(40)], rng.integers(0, 3000, 400_000)

    def peak(blocks):
        tracemalloc.start()
        assert all((a == b).all() for a, b in zip(rangecoder.decode(rangecoder.encode(blocks)), blocks, strict=True))
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top

    assert peak([*short, long]) < 1.2 * (peak(short) + peak([long]))


def test_prediction_pays():
    ids = np.tile(np.random.default_rng(1).integers(0, 40000, 50), 400)
    assert len(rangecoder.encode([ids])[0]) < len(ids) * 2 / 6


def test_damage_is_noticed():
    good = rangecoder.encode([np.arange(500)])[0]
    for at in (0, 9, 14, 40, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises((ValueError, zlib.error)):
            rangecoder.decode([bytes(bad)])


def test_token_files(odd, odd_rows, empty, library):
    files = tokenfiles.write(odd, block=300)
    rows = tokenfiles.read(files).collect()
    want = Counter((r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for r in odd_rows)
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    place = 0
    for r in rows:
        assert r.start == place
        place += len(r.ids) // 4
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert tokenfiles.read(tokenfiles.write(empty)).count() == 0


def test_the_library_is_asked_once_for_a_word(monkeypatch):
    """Over batches and tasks: its answers are most of the work."""
    coder = tokenfiles.Library(bpe.public_path())
    asked: Counter = Counter()
    ask = coder.ask
    monkeypatch.setattr(coder, "ask", lambda words: (asked.update(words), ask(words))[1])
    words = ["".join(chr(97 + k // 26**i % 26) for i in range(4)) + "ing" for k in range(150_000)]
    for _ in range(2):
        for a in range(0, len(words), 10_000):
            coder.encode([" ".join(words[a : a + 10_000]).encode()])
    assert len(asked) == len(words) and set(asked.values()) == {1}


def test_known_words_are_bounded(monkeypatch, library):
    monkeypatch.setattr(tokenfiles, "WORDS", 100)
    coder = tokenfiles.Library(bpe.public_path())
    for k in range(40):
        text = " ".join(f"w{chr(97 + (k + j) % 26) * (j + 1)}" for j in range(20))
        assert coder.arrays([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(coder.known) <= 100 + 20 + 10


def test_pieces_are_cut_as_by_the_library(monkeypatch, library):
    rng = random.Random(5)
    settled = [chr(c) for c in [*range(0x250), *range(0x2010, 0x2028)]]
    texts = ["", *TEXTS, "x'll 'S ''s '9 it's\x85it's don't1'd", *("".join(rng.choices(settled, k=40)) for _ in range(300)), *(" ".join("".join(rng.choices("aB9.-'é\xa0İ漢", k=6)) for _ in range(20)) for _ in range(100))]
    coder = tokenfiles.Library(bpe.public_path())
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in coder.arrays([t.encode() for t in texts])] == want
    monkeypatch.setattr(tokenfiles, "TEXT", 7)  # a long text is cut at white space
    assert [coder.arrays([t.encode()])[0].tolist() for t in texts] == want


@pytest.mark.parametrize("n", [5000, 70_000, 140_000])
def test_blocks_of_many_different_ids(n):
    rng = np.random.default_rng(n)
    blocks = [rng.permutation(n), np.repeat(rng.permutation(n // 10), 3), rng.zipf(1.2, 3000) % n]
    assert all((a == b).all() for a, b in zip(rangecoder.decode(rangecoder.encode(blocks)), blocks, strict=True))


# ---- language ID --------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    table = language.pieces(bpe.public_path(language.VOCABULARY))
    rng = np.random.default_rng(0)
    weights = language.normal(rng.random((len(table.names) + 1, 2)))
    number = {p: k for k, p in enumerate(table.names)}
    assert table.longest == max(map(len, number)) > 8

    def logs(word):
        total = [np.zeros(2)]
        for b in range(1, len(word) + 1):
            ways = [total[b - 1] + np.log(language.UNKNOWN)] + [total[a] + np.log(weights[number[word[a:b]]]) for a in range(b) if word[a:b] in number]
            total.append(np.logaddexp.reduce(ways))
        return total[-1]

    words = ["▁the", "▁straße", "▁q", "▁漢字", "▁internationalisation", "▁" + "information" * 5, "▁" + "information" * 9, "▁" + "x" * 700]
    assert language.log_words(words, table, weights) == pytest.approx(np.array([logs(w) for w in words]))
    # expected pieces: each segmentation's pieces weighted by its share, in short and in long words
    for word in ("▁the", "▁" + "information" * 9):
        counts = language.expected([word, "▁a"], np.array([1, 0]), np.array([2.0, 1.0]), table, weights)
        letters = sum(len(p) * c for p, c in zip(table.names, counts[:, 1], strict=False))
        assert letters == pytest.approx(2 * len(word), rel=1e-3) and counts[-1].sum() == 0


def test_letters_of_the_background():
    known = np.array(sorted(map(ord, "▁ab")), np.uint32)
    logs = np.log([0.2, 0.3, 0.5])  # a, b, and the mark
    assert language.log_letters(["▁a", "▁bb", "▁z"], (known, logs, -9.0)) == pytest.approx([np.log(0.5 * 0.2), np.log(0.5 * 0.3 * 0.3), np.log(0.5) - 9])


def test_words_are_letters_with_their_marks():
    assert language.words_of("It's 4 हिन्दी, x9y ́ ÉÉ") == ["▁its", "▁हिन्दी", "▁xy", "▁éé"]


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(docs.filter(~language.held_out()))
    got = language.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(language.held_out()).collect()
    assert got and sum(r.lang == r.lang_pred for r in got) / len(got) >= 0.95
    again = language.fit(docs.filter(~language.held_out()).repartition(5))
    assert again.languages == model.languages and np.allclose(again.weights, model.weights)


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = language.op9_language(spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1


def test_texts_of_no_language_go(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(docs)
    rng = random.Random(2)
    junk = ["qwx zzvk jjqp xkcd vvbq zxzx qqpk", " ".join("".join(rng.choices("qxzjkvwpyg", k=7)) for _ in range(40)), "漢字かな交じり文", "12 34"]
    more = spark.createDataFrame([(900_000 + k, t, None, None, 0) for k, t in enumerate(junk)], docs.schema)
    left = {r.doc_id for r in language.keep(docs.unionByName(more), model).collect()}
    assert not left & set(range(900_000, 900_010))
    lost = [r for r in docs.collect() if r.doc_id not in left and len(r.text.split()) >= 20]
    assert not lost
    scores = {r.doc_id: r.score for r in language.predict(more, model).collect()}
    assert all(s < 0.5 for s in scores.values())


def test_too_many_labels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 3)
    with pytest.raises(ValueError, match="labels"):
        language.fit(spark.createDataFrame([(k, "some text", f"l{k}") for k in range(9)], "doc_id long, text string, lang string"))


def test_texts_without_a_language(spark, odd, odd_rows, empty):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = language.fit(docs, documents=40)
    rows = language.predict(odd, model).collect()
    assert len(rows) == len(odd_rows)
    und = Counter(r.doc_id for r in rows if r.lang_pred == "und")
    assert und == Counter(r[0] for r in odd_rows if not any(c.isalpha() for c in r[1] or ""))
    assert all(0 <= r.score <= 1 for r in rows)
    kept = language.keep(odd, model)
    assert kept.columns == odd.columns and kept.count() <= len(odd_rows) - sum(und.values())
    assert language.predict(empty, model).count() == language.keep(empty, model).count() == 0
    nothing = language.fit(empty)
    assert nothing.languages == [] and {r.lang_pred for r in language.predict(odd, nothing).collect()} == {"und"}
    assert language.keep(odd, nothing).count() == len(odd_rows) - sum(und.values())


# ---- licences -----------------------------------------------------------------------------------


def plain_matches(words, texts, least):
    """Matching statistics from all substrings."""
    known = {tuple(t[a:b]) for t in texts for a in range(len(t)) for b in range(a + 1, len(t) + 1)}
    longest = []
    for end in range(1, len(words) + 1):
        longest.append(next((n for n in range(end, 0, -1) if tuple(words[end - n : end]) in known), 0))
    return [(end + 1 - n, n) for end, n in enumerate(longest) if n >= least and (end + 1 == len(words) or longest[end + 1] <= n)]


def test_automaton_equals_all_substrings():
    rng = np.random.default_rng(2)
    for _ in range(60):
        texts = [rng.integers(0, 4, rng.integers(1, 12)).tolist() for _ in range(3)]
        words = rng.integers(0, 5, 40).tolist()
        automaton = licenses.Automaton(texts)
        got = list(automaton.matches(words, 2))
        assert [(a, n) for a, n, _ in got] == plain_matches(words, texts, 2)
        for a, n, state in got:
            want = {k: e for k, t in enumerate(texts) if (e := {e for e in range(n, len(t) + 1) if t[e - n : e] == words[a : a + n]})}
            assert automaton.ends[state] == want


def test_templates_are_found_even_with_changes():
    scanner = licenses.scanner()
    for label, text in licenses.TEMPLATES:
        _, _, spans = scanner.scan(f"some words before. {text} and after it".encode())
        assert label in {s[0] for s in spans}
        assert all(0 < s[3] <= 1 and s[1] < s[2] for s in spans)
    mit = licenses.TEMPLATES[12][1]
    assert {s[0] for s in scanner.scan(mit.replace("Software", "Thing").encode())[2]} == {"mit"}
    assert scanner.scan(b"the software is provided to the public by the authors of this work")[2] == []


def spans_of(text):
    return {x[0] for x in licenses.scanner().scan(f"Notice. {text} and more".encode())[2]}


@pytest.mark.parametrize("label, text", licenses.TEMPLATES)
def test_templates_get_their_own_label_only(label, text):
    assert spans_of(text) == {label}


CC = "This work is licensed under a Creative Commons Attribution"
FREE = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU"


@pytest.mark.parametrize(
    "text, labels",
    [
        (f"{CC}-NonCommercial 4.0 International License", {"cc-by-nc"}),
        (f"{CC}-ShareAlike 4.0 International License", {"cc-by-sa"}),
        (f"{CC}-NoDerivatives 4.0 International License", {"cc-by-nd"}),
        (f"{CC}-NonCommercial-ShareAlike 3.0 United States License", {"cc-by-nc-sa"}),
        (f"{CC} 3.0 Germany License", {"cc-by"}),
        (f"{CC} License", {"cc-by"}),
        (f"{CC}-Sampling 4.0 International License", set()),
        ("Licensed under CC BY-NC-SA 4.0", {"cc-by-nc-sa"}),
        ("Licensed under CC BY-NC", {"cc-by-nc"}),
        ("This work is licensed under the GNU General Public License, version 2", {"gpl-2.0"}),
        ("This work is licensed under the GNU General Public License, version 7", set()),
        (f"{FREE} Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", {"lgpl-2.1"}),
        (f"{FREE} Other General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", set()),
        ("Licensed under the Apache License, Version 1.1", {"apache-1.1"}),
        ("Licensed under the Apache License, Version 2.0", {"apache-2.0"}),
        ("Licensed under the Apache License of the project", set()),
    ],
)
def test_variants_are_told_apart(text, labels):
    assert spans_of(text) == labels


@pytest.mark.parametrize(
    "text, labels",
    [
        ("GNU Affero General Public License version 3", {"agpl-3.0"}),
        ("GNU Lesser General Public License, version 2.1", {"lgpl-2.1"}),
        ("Eclipse Public License 2.0", {"epl-2.0"}),
        ("Artistic License 2.0", {"artistic-2.0"}),
        ("BSD 3-Clause License", {"bsd-3-clause"}),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("SPDX-License-Identifier: LGPL-3.0", {"lgpl-3.0"}),
        ("Eclipse Public License 3.0", set()),
    ],
)
def test_short_names(text, labels):
    assert spans_of(text) == labels


def test_a_chain_goes_on_after_a_phrase_of_its_own_template():
    """What is put in also stands in the template, at another place."""
    words = licenses.TEMPLATES[9][1].split()
    assert licenses.TEMPLATES[9][0] == "gpl-3.0"
    three = words.index("3")
    for at in set(range(5, len(words) - 5, 3)) - set(range(18, 22)) - {three, three + 1}:  # not inside a deciding passage
        text = " ".join([*words[:at], "see the GNU General Public License first", *words[at:]])
        _, _, spans = licenses.scanner().scan(text.encode())
        assert "gpl-3.0" in {s[0] for s in spans}, at


def test_license_query(spark):
    """Base columns of the whole query against plain ones; score and labels from the spans."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    for r in licenses.op7_licenses(spark, SMALL).collect():
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in docs[r.doc_id] or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        spans = licenses.scanner().scan((docs[r.doc_id] or "").encode())[2]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert r.labels == ",".join(sorted({x for _, x in places} | {s[0] for s in spans}))
        assert r.score == max([0.5 if places else 0.0, *(s[3] for s in spans)])


def test_phrases_equal_plain(spark, odd, odd_rows, empty):
    docs = odd.select("doc_id", "text").union(spark.createDataFrame([(900, "Apache-License, CC BY CC by gnu General public GNU general public license MIT licensed mit LICENSE")], "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = Counter()
    for i, t in rows:
        words = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want[i, len(words), tuple(sorted(places))] += 1
    got = licenses.scan(docs).collect()
    assert Counter((r.doc_id, r.n_words, tuple(sorted((p.start, p.label) for p in r.phrases))) for r in got) == want
    assert licenses.scan(empty).count() == 0


# ---- audio --------------------------------------------------------------------------------------


def test_media_are_stored_and_read_back(odd, odd_rows, empty):
    rows = audio.features(audio.store(odd)).collect()
    want = Counter()
    for r in odd_rows:
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        media = audio.wav(payload)
        with wave.open(io.BytesIO(media)) as f:
            assert (f.getnchannels(), f.getsampwidth(), f.readframes(f.getnframes())) == (1, 1, payload)
        want[r[0], len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()] += 1
    assert Counter(tuple(r[:7]) for r in rows) == want
    by = {}
    for r in rows:
        assert by.setdefault(r.payload_sha256, (r.n_frames, r.tensors)) == (r.n_frames, r.tensors)
    assert audio.features(audio.store(empty)).count() == 0


def test_polyphase_equals_one_output_at_a_time():
    x = np.random.default_rng(0).random(403).astype(np.float32)
    h = audio.polyphase(5, 8)
    wide = (len(h) - 8) // 2
    got = audio.resample(x)
    padded = np.pad(x, (wide, 8 * len(h)))
    for m in range(len(got)):
        assert got[m] == pytest.approx(float(padded[m // 5 * 8 : m // 5 * 8 + len(h)] @ h[:, m % 5]), abs=1e-5)
    assert len(got) == -(-403 // 8) * 5
    tone = np.sin(np.arange(4000) * 0.05)
    assert audio.resample(tone)[200:2000] == pytest.approx(np.sin(np.arange(200, 2000) * 0.05 * 8 / 5), abs=0.02)


def test_log_mel_frames(monkeypatch):
    x = np.random.default_rng(1).standard_normal(5000).astype(np.float32)
    whole, energy = audio.log_mel(x, 10_000)
    window, bank = audio.filterbank(10_000, audio.FRAME, audio.MELS)
    for k in (0, 7, len(whole) - 1):
        part = np.pad(x[k * audio.HOP : k * audio.HOP + audio.FRAME], (0, max(0, k * audio.HOP + audio.FRAME - len(x))))
        assert whole[k] == pytest.approx(np.log((np.abs(np.fft.rfft(part * window)) ** 2) @ bank + 1e-6), abs=0.02)
    monkeypatch.setattr(audio, "STEP", 64)
    assert (audio.log_mel(x, 10_000)[0] == whole).all()


def test_hysteresis_equals_a_loop():
    energy = np.random.default_rng(4).normal(0, 1.5, 500)
    on, runs, level = False, [], energy - np.median(energy)
    for k, e in enumerate(level):
        if not on and e >= 1.5:
            on, start = True, k
        elif on and e < 0.5:
            on = False
            runs.append((start, k))
    assert audio.active(energy) == runs + ([(start, 500)] if on else [])


def test_tensors_have_a_fixed_shape_and_spans():
    frames = np.arange(70 * 24, dtype=np.float32).reshape(70, 24)
    table = pa.ipc.open_stream(audio.tensors(frames, 0.016)).read_all()
    assert table.schema.field("log_mel").type == pa.fixed_shape_tensor(pa.float32(), [32, 24])
    assert table["frames"].to_pylist() == [32, 32, 6] and table["end_s"][2].as_py() == pytest.approx(70 * 0.016)
    back = table["log_mel"].combine_chunks().to_numpy_ndarray().reshape(-1, 24)
    assert (back[:70] == frames).all() and not back[70:].any()


# ---- pipeline -----------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path, library):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    more = spark.createDataFrame([(9000, None, "en", "src1", 0), (9001, "12 34 --", None, None, 8), (9002, "", "en", None, 0)], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    from kinsift.llm import mixing

    rows = {r.doc_id: r for r in docs.collect()}
    last = {}
    for r in rows.values():
        last[r.text] = max(last.get(r.text, -1), r.doc_id)
    texts = [(i, t) for t, i in last.items()]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts if (w := "".join(c.lower() if "A" <= c <= "Z" else c for c in t).split()) and t.strip()}
    near = {i: i for i, _ in texts}  # components of all pairs at 0.8 or more
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and near[a] != near[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                low, high = sorted((near[a], near[b]))
                near = {i: low if c == high else c for i, c in near.items()}
    left = sorted(i for i, c in near.items() if i == c)
    kept = spark.createDataFrame([tuple(rows[i]) for i in left], docs.schema)
    copies = {r.doc_id: r.copies for r in mixing.mix(kept).collect() if r.copies and r["size"]}
    assert Counter(r.doc_id for r in got) == Counter(copies)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(rows[r.doc_id].text, add_special_tokens=False).ids
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert F is not None


def test_token_files_of_tied_ids_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(k % 2 or None, f"text {k % 40} of an id") for k in range(60)], "doc_id long, text string")
    a, b = (sorted(map(str, tokenfiles.read(tokenfiles.write(docs.repartition(n))).collect())) for n in (2, 7))
    assert a == b


def test_long_words_are_summed_in_stretches(monkeypatch):
    """Stretches of any length give what the whole word gives, for any number of languages."""
    import random

    rng = random.Random(2)
    table = language.pieces(language.public_path(language.VOCABULARY))
    weights = language.normal(np.random.default_rng(1).random((len(table.names) + 1, 7)))
    words = ["▁" + "".join(rng.choice("etaoinßé漢q") for _ in range(n)) for n in (65, 300, 1000)]
    whole = language.log_words(words, table, weights)
    for step in (1, 7, 64, 5000):
        assert np.array([language.log_long(w, table, weights, step) for w in words]) == pytest.approx(whole)
    monkeypatch.setattr(language, "LONG", 200)
    monkeypatch.setattr(language, "SUMS", 700)
    assert language.log_words([*words, "▁the"], table, weights)[:3] == pytest.approx(whole)


def test_a_word_of_many_letters_takes_little_memory():
    import tracemalloc

    table = language.pieces(language.public_path(language.VOCABULARY))
    weights = np.full((len(table.names) + 1, 4), 1e-5)
    tracemalloc.start()
    assert np.isfinite(language.log_long("▁" + "nation" * 40_000, table, weights)).all()
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
