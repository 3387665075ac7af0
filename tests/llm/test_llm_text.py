"""Operators on single texts: encoding, language, quality, toxicity, language model."""

import base64
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import regex
import tiktoken

from pyspark.sql import functions as F

from stellwerk.llm import bpe, ctw, langid, quality, toxicity
from stellwerk.llm.batches import text_slices
from stellwerk.llm.shingles import shingle_sets, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD_TEXTS = ["", None, " ", "\n\n\n", "a", "é" * 50, "x" * 5_000, "word " * 3_000, "\x00\x01", "日本語 テキスト", "a\n\n  b\t\tc   ", "it's we'll I'd 'sx 12 345"]


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def long_texts():
    generator = random.Random(3)
    pieces = ["the ", "word", "'s", "'ll", " ", "  ", "\n", "\n\n", "\t", "12", "é", "...", "!", "日本", " x", "'", "-", "\r\n"]
    return ["".join(generator.choices(pieces, k=generator.randint(1, 900))) for _ in range(60)] + ["z" * 700, "a b" * 300 + "q" * 300 + " c d" * 200]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (100, 40), (1000, 10)])
def test_chunked_encoding_is_that_of_the_whole_text(spark, documents, encoding, chunk, overlap):
    texts = [*ODD_TEXTS, *long_texts()]
    rows = [*enumerate(texts), (0, texts[0]), (None, "no id"), (70, texts[14]), (70, texts[14])]
    found = bpe.encode_documents(spark, documents(rows), RANKS, public_tokenizers.PATTERN, chunk, overlap).collect()
    want = Counter()
    for doc_id, text in rows:
        ids = encoding.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want[doc_id, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert Counter(map(tuple, found)) == want


def test_a_safe_boundary_is_one_of_the_whole_text():
    for text in long_texts():
        ends = {m.end() for m in regex.finditer(public_tokenizers.PATTERN, text)}
        cut = text[: len(text) // 2]
        assert set(bpe.safe_boundaries(cut, public_tokenizers.PATTERN, False, False)) <= ends


def test_no_documents(spark, documents):
    empty = documents([(1, "a")]).limit(0)
    assert bpe.encode_documents(spark, empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert langid.identify(spark, empty, langid.train(empty)).count() == 0
    assert quality.classify(spark, empty, quality.train(empty)).count() == 0
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.classify(spark, empty, toxicity.train(spark, empty, labels)).count() == 0
    assert ctw.score(spark, empty, F.lit(True)).count() == 0


def test_words_and_shingles_are_those_of_split():
    texts = ["A b  c\td", "", None, "one", "Éa éA\x1f\x0b x", "x y z x y z", "\n a"]
    _, offsets, data = next(text_slices(pa.array(texts)))
    row, code = words(offsets, data)
    split = [(t or "").encode().lower().split() for t in texts]
    flat = [w for ws in split for w in ws]
    assert row.tolist() == [i for i, ws in enumerate(split) for _ in ws]
    assert len(dict(zip(flat, code))) == len(set(code.tolist())) and dict(zip(flat, code)) == {w: c for w, c in zip(flat, code)}
    ends, _ = shingle_sets(offsets, data, 3)
    sizes = [len({tuple(ws[i : i + 3]) for i in range(max(len(ws) - 2, 1))}) if ws else 0 for ws in split]
    assert np.diff(ends).tolist() == sizes


LANGUAGES = {"aa": "bala fola gim tura", "bb": "zexu qi pyx vuw", "cc": "öl ärgü ßa tüch"}


def language_rows(n=240):
    generator = random.Random(1)
    rows = []
    for i in range(n):
        lang = list(LANGUAGES)[i % 3]
        rows.append((i, " ".join(generator.choices(LANGUAGES[lang].split(), k=generator.randint(5, 40))), lang))
    return rows


def test_language_is_learned_from_the_given_rows(spark, documents):
    rows = language_rows()
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(frame, learn=F.col("doc_id") % 4 != 2, epochs=30)
    assert model.languages == ["aa", "bb", "cc"]
    odd = [(1000 + i, t) for i, t in enumerate([None, "", "123 !!", "BALA FOLA GIM"])]
    found = {r.doc_id: r for r in langid.identify(spark, documents([(i, t) for i, t, _ in rows] + odd), model).collect()}
    held = [(i, lang) for i, _, lang in rows if i % 4 == 2]
    assert sum(found[i].lang_pred == lang for i, lang in held) >= 0.98 * len(held)
    assert [found[1000 + i].lang_pred for i in range(4)] == ["und", "und", "und", "aa"]
    assert [found[1000 + i].score for i in range(3)] == [0, 0, 0] and not any(found[1000 + i].accepted for i in range(3))
    kept = langid.keep_accepted(spark, documents([(i, t) for i, t, _ in rows] + odd), model)
    assert kept.columns == documents([(1, "a")]).columns and {1000, 1001, 1002}.isdisjoint({r.doc_id for r in kept.collect()})
    assert kept.count() >= 0.98 * len(rows)


def test_calibration_rejects_little():
    logits = np.array([[4.0, 0, 0]] * 98 + [[0.2, 0, 0.1]] * 2)
    temperature, threshold = langid.calibrate(logits, np.zeros(100, int))
    assert temperature < 1 and threshold <= 0.5


def test_quality_separates_junk_without_labels(spark, documents):
    generator = random.Random(2)
    vocabulary = ["".join(generator.choices("abcdefgh", k=generator.randint(2, 9))) for _ in range(3000)]
    good = [" ".join(generator.choices(vocabulary, k=80)).capitalize() + "." for _ in range(300)]
    junk = [" ".join(w + generator.choice(["***", "$$$", "###"]) for w in generator.choices(vocabulary, k=60)) for _ in range(25)]
    junk += [" ".join(w.upper() + "!!" for w in generator.choices(vocabulary, k=60)) for _ in range(25)]
    junk += [" ".join(x for w in generator.choices(vocabulary, k=4) for x in [w] * 20) for _ in range(25)]
    rows = [*enumerate(good + junk), (9000, None), (9001, ""), (9002, " \n")]
    found = {r.doc_id: r for r in quality.classify(spark, documents(rows), quality.train(documents(rows))).collect()}
    assert sum(found[i].accepted for i in range(300)) >= 297
    assert sum(found[i].accepted for i in range(300, 375)) <= 3
    assert [(found[i].quality, found[i].accepted) for i in (9000, 9001, 9002)] == [(0, False)] * 3


def test_estimation_finds_the_labellers_accuracies():
    generator = np.random.default_rng(4)
    truth = generator.random(40_000) < 0.2
    errors = [0.02, 0.1, 0.25] + [0.15] * (len(quality.STATISTICS) - 3)
    patterns = np.stack([np.where(generator.random(len(truth)) < e, ~truth, truth) for e in errors], axis=1).astype(int)
    patterns[generator.random(patterns.shape) < 0.1] = quality.ABSTAIN
    distinct, counts = np.unique(patterns, axis=0, return_counts=True)
    tables, share = quality.estimate(distinct, counts)
    assert abs(share - 0.2) < 0.01
    for j, error in enumerate(errors):
        assert abs(tables[j, 1, quality.GOOD] / (1 - tables[j, 1, quality.ABSTAIN]) - error) < 0.02


def test_disguised_words_are_restored():
    plain = "idiot stupid moron trash worthless clown loser look at this the green letter book".split()
    trigrams = Counter()
    for word in plain:
        marked = f"^^{word}$"
        trigrams.update(marked[i : i + 3] for i in range(len(marked) - 2))
    spelling = toxicity.SpellingModel(dict(trigrams))
    cases = {"1d10t": "idiot", "st*pid": "stupid", "i d i o t": "idiot", "s.t.u.p.i.d": "stupid", "mooorooon": "moron", "l0$er": "loser", "tr4sh": "trash", "gree3n": "green"}
    for disguised, word in list(cases.items())[:-1]:
        text = f"see the {disguised}, ok"
        assert toxicity.restored(pa.array([text]), spelling)[0].as_py() == f"see the {word}, ok"
    for text in ["plain words*** here!! 100% of 3,5", "wh$$$ the,### a b c", "", "x" * 200]:
        assert toxicity.restored(pa.array([text]), spelling)[0].as_py() == text
    assert toxicity.restored(pa.array([None, "A"]), spelling).to_pylist() == ["", "a"]


def spelling_of(words):
    trigrams = Counter(f"^^{w}$"[i : i + 3] for w in words.split() for i in range(len(w) + 1))
    return toxicity.SpellingModel(dict(trigrams))


def test_long_disguised_words_are_restored():
    spelling = spelling_of("idiot stupid moron trash worthless pathetic clown loser look at this the green letter book")
    cases = {"idi" + "o" * 30 + "t": "idiot", "st" + "u" * 500_000 + "p1d": "stupid", "l" + "0" * 40 + "ser": "loser", "m o o o r o n": "moron"}
    cases[" ".join("pathetic" + "worthless")] = "pathetic worthless"
    for disguised, word in cases.items():
        assert toxicity.restored(pa.array([f"see {disguised}, ok"]), spelling)[0].as_py().replace(" ", "") == f"see{word},ok".replace(" ", "")
    many = "1d10t" * 20_000
    assert toxicity.restored(pa.array([many]), spelling)[0].as_py() == "idiot" * 20_000


def test_signs_behind_letters_and_among_letters_set_apart_are_read():
    spelling = spelling_of("idiot stupid moron trash worthless pathetic clown loser look at this the green letter book you are né")
    cases = {"idio7": "idiot", "tra5#": "trash", "worthle$$": "worthless", "m 0 r 0 n": "moron", "s t u p 1 d": "stupid", "y o u": "you", "y-0-u": "you"}
    cases |= {"1 d 1 0 7": "idiot", "l0s3r": "loser"}
    rows = [text for disguised in cases for text in (disguised, f"the {disguised}", f"{disguised} book", f"look: {disguised}, letter")]
    want = [text for word in cases.values() for text in (word, f"the {word}", f"{word} book", f"look: {word}, letter")]
    # All rows in one array, so that neighbours touch.
    assert toxicity.restored(pa.array(rows), spelling).to_pylist() == want
    plain = ["this book!", "look at (the letter", "the green***", "1 2 3 4", "a 1 b 2", "3,5 + 4", "look at 100% of this!!"]
    assert toxicity.restored(pa.array(plain), spelling).to_pylist() == plain


def test_every_row_the_expression_would_read_is_found():
    generator = random.Random(8)
    rows = ["".join(generator.choices("aé日𐐀1$!. -,x€", k=generator.randint(0, 9))) for _ in range(20_000)]
    column = pa.array(rows, pa.large_string())
    found = {start + row for start, offsets, data in text_slices(column) for row in toxicity.disguised_rows(offsets, data).tolist()}
    wanted = {i for i, text in enumerate(rows) if any(any(c.isalpha() for c in m[0]) for m in toxicity._DISGUISED.finditer(text))}
    assert wanted <= found


def test_the_spelling_model_counts_all_learned_rows(spark, documents):
    rows = [(i, f"common words {i}") for i in range(9_000)] + [(9_000, "xylograph Ärger"), (9_001, "unlearned"), (9_002, None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, toxic int")
    model = toxicity.train(spark, documents(rows), labels, learn=F.col("doc_id") != 9_001)
    want = Counter()
    for i, text in rows:
        if i != 9_001:
            for word in regex.findall(r"\p{L}+", (text or "").lower()):
                want.update(f"^^{word}$"[k : k + 3] for k in range(len(word) + 1))
    assert model.spelling == want and model.spelling["^^x"] == 1


def test_toxicity_generalises_to_disguised_words(spark, documents):
    generator = random.Random(5)
    vocabulary = ["".join(generator.choices("aeioustlr", k=generator.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(500):
        text = generator.choices(vocabulary, k=30)
        if i % 5 == 0:
            text[generator.randrange(30)] = generator.choice(["moron", "idiot"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 5 == 0)))
    labels += [(3, None), (None, 1), (10, 1), (99999, 1)]
    label_frame = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    odd = [(1000, "you are an 1d10t indeed"), (1001, "what a m o r o n"), (1002, None), (1003, ""), (1004, "he ate riot")]
    frame = documents(rows + odd)
    model = toxicity.train(spark, frame, label_frame, learn=F.col("doc_id") % 4 != 0)
    found = {r.doc_id: r for r in toxicity.classify(spark, frame, model).collect()}
    held = [i for i in range(500) if i % 4 == 0]
    assert all(found[i].predicted == (i % 5 == 0) for i in held)
    assert [found[1000 + i].predicted for i in range(5)] == [1, 1, 0, 0, 0]
    assert all(0 <= r.score <= 1 for r in found.values())


def brute_context_tree(texts, scored, depth):
    """Weighted probabilities by recursion over explicit tree nodes."""
    tables = {}
    for text in texts:
        data = [255] * depth + list(text) + [255]
        for i in range(depth, len(data)):
            for step in range(8):
                prefix, bit = (1 << step) | (data[i] >> (8 - step)), data[i] >> (7 - step) & 1
                for d in range(depth + 1):
                    tables.setdefault((prefix, tuple(data[i - d : i])), [0, 0])[bit] += 1

    def own(node):
        a, b = tables.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    children = {}
    for prefix, context in tables:
        if context:
            children.setdefault((prefix, context[1:]), []).append((prefix, context))
    memo = {}

    def mixed(node):
        if node not in memo:
            if len(node[1]) == depth:
                memo[node] = own(node)
            else:
                memo[node] = math.log(0.5) + np.logaddexp(own(node), sum(mixed(c) for c in children.get(node, [])))
        return memo[node]

    def one(prefix, context, d):
        node = (prefix, context[depth - d :] if d else ())
        a, b = tables.get(node, (0, 0))
        estimate = (b + 0.5) / (a + b + 1)
        if d == depth:
            return estimate
        share = math.exp(own(node) + math.log(0.5) - mixed(node))
        return share * estimate + (1 - share) * one(prefix, context, d + 1)

    total = 0.0
    data = [255] * depth + list(scored) + [255]
    for i in range(depth, len(data)):
        for step in range(8):
            p = one((1 << step) | (data[i] >> (8 - step)), tuple(data[i - depth : i]), 0)
            total += math.log10(p if data[i] >> (7 - step) & 1 else 1 - p)
    return total


@pytest.mark.parametrize("most_shared", [1_000_000, 40, 0])
def test_language_model_against_explicit_trees(spark, documents, most_shared):
    rows = [(i, t) for i, t in enumerate(["the cat sat", "The CAT ran", "a é cat\nsat sat", None, "", "zzz unseen", "the dog sat " * 4])]
    rows += [(2, rows[2][1]), (None, "cat")]
    found = ctw.score(spark, documents(rows), F.col("doc_id") % 3 != 2, most_shared).collect()
    assert len(found) == len(rows)
    learned = [(t or "").encode().lower() for i, t in rows if i is not None and i % 3 != 2]
    counts = Counter(w for t in learned for w in [*t.split(), None])
    total, distinct = sum(counts.values()), len(counts)
    want = Counter()
    for i, text in rows:
        data = (text or "").encode().lower()
        tokens = [*data.split(), None]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        model = brute_context_tree(learned, data, ctw.DEPTH)
        want[i, len(tokens), sum(counts[t] > 0 for t in tokens), total, round(base, 6), round(model, 6)] += 1
    got = Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in found)
    assert got == want


def test_estimates_are_the_same_in_columns_and_arrays(spark):
    pairs = [(0.0, 0.0), (1.0, 0.0), (7.0, 1000.0), (123456.0, 9.0)]
    column = spark.createDataFrame(pairs, "a double, b double").select(ctw.log_kt(F.col("a"), F.col("b"), F.log).alias("v"))
    exact = [math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in pairs]
    assert np.allclose(sorted(r.v for r in column.collect()), sorted(exact), atol=1e-7)
    assert np.allclose(ctw.log_kt(*np.array(pairs).T), exact, atol=1e-7)


def spellings(model, word):
    """Every path through a token's lattice, written out, with its log probability."""
    runs = [(m[1], len(m[0])) for m in regex.finditer(r"(.)\1*", word)]
    tail = max((i + 1 for i, (c, _) in enumerate(runs) if c not in toxicity.LOOK_ALIKES), default=0)
    options = []
    for i, (char, size) in enumerate(runs):
        lengths = [(size, 0.0)] + ([(1, toxicity._SHORTEN), (2, toxicity._SHORTEN)] if size > 2 else [])
        sign = char in toxicity.LOOK_ALIKES
        option = [(letter * n, cost + (toxicity._REPLACE if sign else 0.0)) for letter in (toxicity.LOOK_ALIKES[char] if sign else char) for n, cost in lengths]
        edge = toxicity._keep(char, size) if i == 0 or i >= tail else toxicity._KEEP_SIGN
        options.append(option + ([(char * size, ("kept", edge))] if sign else []))
    for path in itertools.product(*options):
        score, letters, text, behind_sign = 0.0, "", "", False
        for piece, cost in path:
            if isinstance(cost, tuple):
                score += word_score(model, letters) + (toxicity._KEEP_NEXT if behind_sign else cost[1])
                letters, behind_sign = "", True
            else:
                score, letters, behind_sign = score + cost, letters + piece, False
            text += piece
        yield score + word_score(model, letters), text


def word_score(model, letters):
    marked = f"^^{letters}$"
    return sum(model.log(marked[i : i + 2], marked[i + 2]) for i in range(len(marked) - 2)) if letters else 0.0


def test_viterbi_finds_the_likeliest_of_all_spellings():
    grams = Counter()
    for word, n in {"idiot": 30, "moron": 20, "hello": 60, "good": 80, "too": 50, "trash": 9, "ass": 5, "lost": 40, "oil": 7}.items():
        grams.update({f"^^{word}$"[i : i + 3]: n for i in range(len(word) + 1)})
    model = toxicity.SpellingModel(dict(grams))
    generator = random.Random(4)
    words_ = ["1d10t", "m0r0n!!", "hellooo", "g00d", "7ra5h", "@$$", "$a", "l0$7", "too", "!oil!", "tooo0", "+++a"]
    words_ += ["".join(generator.choice("aot01$!lli") for _ in range(generator.randint(2, 6))) for _ in range(150)]
    for word in words_:
        if len(set(word)) < 2 or not any(c.isalpha() for c in word) or regex.search(r"([a-z])\1{3}", word):
            continue
        every = dict((text, max(s for s, t in found if t == text)) for found in [list(spellings(model, word))] for text in {t for _, t in found})
        assert every[model.restore(word)] == pytest.approx(max(every.values())), word


def test_distinct_buckets_by_row():
    generator = np.random.default_rng(2)
    last = np.zeros(1 << 8, np.int32)
    for n in (1, 2, 7):
        row = np.concatenate([np.sort(generator.integers(0, n, size)) for size in (60, 40, 0, 1)]).astype(np.int32)
        bucket = generator.integers(0, 1 << 8, len(row)).astype(np.int32)
        found = {i: sorted(b.tolist()) for i, b in toxicity.distinct_by_row(n, row, bucket, last)}
        assert found == {i: sorted(set(bucket[row == i].tolist())) for i in range(n)}
    assert [len(b) for _, b in toxicity.distinct_by_row(3, np.empty(0, np.int32), np.empty(0, np.int32), last)] == [0, 0, 0]


def test_every_language_is_learned(spark):
    rows = [(i * 3 + j, f"{chr(0x4E00 + 7 * i) * 3} {chr(0x4E03 + 7 * i) * 2}", f"l{i}") for i in range(450) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert len(langid.train(docs, epochs=1).languages) == 450
