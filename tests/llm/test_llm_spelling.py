"""Spelling variants against brute force: the index alone, shards of few words, odd rows, the contract."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex

from stellwerk.llm import spelling
from stellwerk.llm.fm_index import Index
from stellwerk.llm.queries import QUERIES


def one_error(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_pairs(words):
    return {(a, b) for a in words for b in words if one_error(a, b)}


def brute_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            total[low] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def brute_rows(rows):
    words = brute_words(rows)
    near = {w: sorted((-words[b], b) for a, b in brute_pairs(words) if a == w) for w in words}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 2 * words[w] else None for w in words}

    def root(word):
        while form[word]:
            word = form[word]
        return word

    return {(w, n, len(near[w]), form[w], words[form[w]] if form[w] else None, root(w)) for w, n in words.items()}


def made_words(seed, count, alphabet="abcé"):
    r = random.Random(seed)
    return sorted({"".join(r.choice(alphabet) for _ in range(r.randint(5, 9))) for _ in range(count)})


@pytest.mark.parametrize("seed", range(8))
def test_index_finds_each_near_word_once(seed):
    words = made_words(seed, 150) + (["aaaaa" * 20, "aaaaa" * 20 + "a"] if seed % 2 else [])
    letters, ends = spelling._letters(words)
    known = np.unique(letters)
    index = Index(np.searchsorted(known, letters) + 1, ends)
    found, lengths = [], np.diff(ends)
    for side in (1, 0):
        halves = lengths // 2 if side == 1 else lengths - lengths // 2
        query, word = index.near(np.searchsorted(known, letters) + 1, ends, halves, side)
        pairs = [(words[q], words[w]) for q, w in zip(query, word)]
        assert len(pairs) == len(set(pairs))
        for a, b in pairs:
            assert b.startswith(a[: len(a) // 2]) if side == 1 else b.endswith(a[len(a) // 2 :])
        found += pairs
    assert set(found) == brute_pairs(words)


@pytest.mark.parametrize("shard_words, query_words", [(1 << 16, 1 << 18), (40, 25), (1, 3)])
def test_pairs_do_not_depend_on_shards(spark, shard_words, query_words):
    words = made_words(3, 60 if shard_words == 1 else 300)
    frame = spark.createDataFrame([(w, len(w)) for w in words], "word string, n bigint").repartition(3)
    found = [(r.word, r.near) for r in spelling.near_words(frame, shard_words, query_words).collect()]
    assert len(found) == len(set(found)) and set(found) == brute_pairs(words)


def test_half_of_all_words_begin_alike(spark):
    words = sorted({"haupt" + w for w in made_words(5, 200)} | set(made_words(6, 200)))
    frame = spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")
    assert {(r.word, r.near) for r in spelling.near_words(frame, 30, 50).collect()} == brute_pairs(words)


def test_chains_ties_and_odd_rows(spark, documents):
    rows = [(i, "colour " * 40 + "color " * 20 + "coloür colr colour's COLOUR") for i in range(4)]
    rows += [(5, "strasse strasze " * 3), (6, "strasse strassf strassf strassf"), (None, "nullen nullen nullen Nullen"), (8, None), (9, ""), (10, "12 _ œœœ")]
    rows += [(11, "x" * 50_000 + " " + "x" * 49_999), (11, "x" * 50_000), (12, "x" * 50_000), (13, "×÷äöü " * 3)]
    rows += [(i, " ".join(f"wort{a}{b}" for a in "abc" for b in "xyz")) for i in range(20, 400)]
    got = {tuple(r) for r in spelling.variants(documents(rows + rows[:3])).collect()}
    assert got == brute_rows(rows + rows[:3])
    assert spelling.variants(documents(rows).limit(0)).count() == 0
    # A chain of three: each form has at least twice the count.
    chain = [(1, "aaaaab " * 3 + "aaaabb " * 7 + "aaabbb " * 20)]
    assert {tuple(r) for r in spelling.variants(documents(chain)).collect()} == brute_rows(chain)


def test_query_holds_the_contract(spark):
    frame = QUERIES["op13_spelling"](spark, "/root/testdata/sf0.001")
    assert dict(frame.dtypes) == {"word": "string", "n": "bigint", "n_near": "bigint", "form": "string", "form_n": "bigint", "root": "string"}
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert {w: n for w, n, *_ in frame.collect()} == brute_words(rows)
