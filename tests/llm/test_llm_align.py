"""Alignment of two tokenizers against brute force over whole documents."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings, strategies as st

from stellwerk.llm import align
from stellwerk.llm.queries import QUERIES

A = (align.ByteLevel, P.path("byte_bpe_50k.json"))
B = (align.Pieces, P.path("piece_bpe_32k.model"))


def whole(text):
    """Ids and ends of both sides by the libraries alone, over the whole text; None without tokens."""
    if not text:
        return None
    sides = []
    for load in (A, B):
        side = align.loaded(*load)
        ids = side._ids([" " + text])[0]
        at, ends = 0, []
        for i in ids:
            at += len(side.token_bytes[i])
            ends.append(at)
        if b"".join(side.token_bytes[i] for i in ids) != (" " + text).encode():
            return None
        sides.append((ids, ends))
    return sides


def brute_groups(text):
    sides = whole(text)
    if sides is None:
        return []
    common = sorted(set(sides[0][1]) & set(sides[1][1]))
    groups, low = [], 0
    for end in common:
        groups.append(tuple([i for i, e in zip(*side) if low < e <= end] for side in sides))
        low = end
    return groups


def brute_overlaps(text):
    sides = whole(text)
    if sides is None:
        return 0
    spans = [list(zip([0, *ends[:-1]], ends)) for _, ends in sides]
    return sum(1 for s, e in spans[0] for t, f in spans[1] if s < f and t < e)


def brute(rows):
    groups = [brute_groups(text) for _, text in rows]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    held = Counter(pair for link in links for pair in link)
    highest = defaultdict(int)
    for (x, _), n in held.items():
        highest[x] = max(highest[x], n)
    out = []
    for (doc_id, text), g, link in zip(rows, groups, links):
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((
            doc_id, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(link.values()),
            sum(c for p, c in link.items() if held[p] == highest[p[0]]), sum(c * held[p] for p, c in link.items()),
            hashlib.sha256(said.encode()).hexdigest() if g else "", brute_overlaps(text),
        ))
    return Counter(out)


odd = st.text(max_size=30) | st.lists(
    st.sampled_from([" ", "  ", "\n", "\t", " ", "▁", "\x1c", "\u0085", "der", "The", "don't", "'s", "été", "日本語", "👩‍👩‍👧", "1234", "<|endoftext|>", "<s>", "<0x0A>", "\x00", "ﬁ", "é", "."]), max_size=14
).map("".join)


@settings(max_examples=500, deadline=None)
@given(odd.filter(bool))
def test_stretches_are_tokenised_like_the_whole(text):
    cut = align.stretches(" " + text)
    assert "".join(cut) == " " + text and all(part[0] == " " for part in cut)
    if "▁" not in text:
        for load in (A, B):
            side = align.loaded(*load)
            assert [i for ids in side._ids(cut) for i in ids] == side._ids([" " + text])[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(odd.filter(bool), max_size=40))
def test_stretches_encoded_together_have_the_ids_they_have_alone(texts):
    cut = [part for text in texts for part in align.stretches(" " + text)]
    plain = [part.encode() for part in cut]
    base = np.concatenate(([0], np.cumsum(list(map(len, plain)), dtype=np.int64)))
    for load in (A, B):
        side = align.loaded(*load)
        together = side.encode_joined(cut, align._runs(cut), base, b"".join(plain))
        for got, expected in zip(together, side.encode(cut)):
            assert got.tolist() == expected.tolist()


def test_a_block_encodes_many_stretches_at_once(monkeypatch):
    words = [f" word{i}" for i in range(2000)] + [" \nﬁ", "  two"]
    asked = []
    for kind in (align.ByteLevel, align.Pieces):
        monkeypatch.setattr(kind, "_ids", lambda self, texts, ids=kind._ids: (asked.append(len(texts)), ids(self, texts))[1])
    align._block(0, [1], [np.arange(len(words))], words, align.loaded(*A), align.loaded(*B))
    assert sum(asked) < len(words) / 8


@settings(max_examples=150, deadline=None)
@given(st.lists(odd, min_size=1, max_size=6))
def test_overlaps_and_groups_of_a_batch(texts):
    found = align.align([" " + t for t in texts], align.loaded(*A), align.loaded(*B))
    named = align.group_texts(found, align.loaded(*A), align.loaded(*B))
    for i, text in enumerate(texts):
        expected = [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in brute_groups(text)]
        assert [named[g] for g in range(len(named)) if found.group_text[g] == i] == expected
    assert len(found.overlaps) == sum(map(brute_overlaps, texts))


ROWS = [(1, "The cat sat. Der Zug fährt ab"), (2, "The cat sat"), (2, "The cat sat"), (None, "cat cat"), (3, None), (4, ""), (5, "a▁b cat"), (6, " "), (7, "  two\n\nlines \t"), (8, "ab" * 900), (9, "日本語" * 80 + " 👩‍👩‍👧"), (10, "<|endoftext|> </s>")]
ROWS += [(i, f"word{i % 7} straße zwölf {'été ' * (i % 4)}end") for i in range(20, 120)]


@pytest.mark.parametrize("most", [(1 << 21, 1 << 18), (30, 1000), (1, 1)])
def test_corpus_against_brute_force(spark, documents, most):
    frame = align.corpus_digests(documents(ROWS), A, B, most)
    assert Counter(tuple(r) for r in frame.collect()) == brute(ROWS)


def test_documents_are_aligned_alone(spark, documents):
    for r in align.alignments(documents(ROWS), A, B).collect():
        texts = {text for doc_id, text in ROWS if doc_id == r.doc_id}
        (text,) = texts
        sides = whole(text)
        assert (r.a_ids, r.b_ids) == ((sides[0][0], sides[1][0]) if sides else ([], []))
        assert [(g.a, g.b) for g in r.groups] == [(len(a), len(b)) for a, b in brute_groups(text)]
        assert len(r.overlaps) == brute_overlaps(text) == len(set(map(tuple, r.overlaps)))


def test_empty_table(spark, documents):
    assert align.corpus_digests(documents(ROWS).limit(0), A, B).count() == 0


def test_query_holds_the_contract(spark):
    frame = QUERIES["op11_align"](spark, "/root/testdata/sf0.001")
    longs = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    assert frame.dtypes == [*((c, "bigint") for c in longs), ("groups_sha256", "string"), ("n_overlaps", "bigint")]
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    small = [(i, t) for i, t in rows if t is None or len(t) < 1500]
    got = {r.doc_id: r for r in frame.collect()}
    assert len(got) == len(rows)
    for doc_id, text in small:
        groups = brute_groups(text)
        assert (got[doc_id].n_groups, got[doc_id].n_a) == (len(groups), sum(len(a) for a, _ in groups))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=" \n\t\u2003\x1cab", max_size=12).map(" ".__add__))
def test_texts_are_cut_between_characters_that_are_no_white_space(text):
    cuts = [i for i in range(1, len(text) - 1) if text[i] == " " and not text[i - 1].isspace() and not text[i + 1].isspace()]
    assert align.stretches(text) == [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)])]


def test_texts_with_plain_spaces_are_not_searched_by_pattern(monkeypatch):
    monkeypatch.setattr(align, "_UNCLEAN", None)
    assert align.stretches(" some words\nand lines") == [" some", " words\nand", " lines"]
