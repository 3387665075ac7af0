"""Operators that compare or look up: duplicates, decontamination, urls, archives, neighbours, components."""

import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import difference, duck
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stellwerk.llm import ann, components, decontaminate, jaccard, url_filter, warc
from stellwerk.llm.queries import ORACLES, QUERIES, URL_RULES

SF_DIR = "/root/testdata/sf0.001"


# --- near duplicates


def brute_set(text, words):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))} if w else set()


def brute_components(rows, words, similar):
    num, den = similar
    sets = [brute_set(text, words) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and both * den >= num * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def edited(generator, text, vocabulary, edits):
    words = text.split()
    for _ in range(edits):
        at = generator.randrange(len(words))
        words[at : at + 1] = generator.choice([[generator.choice(vocabulary)], [], [words[at], generator.choice(vocabulary)]])
    return " ".join(words)


def duplicate_rows(seed, n=260):
    generator = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40 if seed % 2 else 4000)]
    texts = [" ".join(generator.choices(vocabulary, k=generator.choice([1, 2, 3, 8, 40, 120]))) for _ in range(n // 4)]
    hot = " ".join(generator.choices(vocabulary, k=90))
    shared = " ".join(generator.choices(vocabulary, k=12))
    while len(texts) < n:
        kind = generator.random()
        if kind < 0.3:
            texts.append(edited(generator, hot, vocabulary, generator.randint(0, 6)))
        elif kind < 0.5:
            texts.append(hot)
        elif kind < 0.7:
            texts.append(edited(generator, generator.choice(texts) or "a", vocabulary, generator.randint(0, 3)))
        else:
            texts.append(shared + " " + " ".join(generator.choices(vocabulary, k=generator.randint(0, 50))))
    rows = [(i * 3 + 5, t) for i, t in enumerate(texts)]
    return rows + [(1, None), (2, ""), (4, " \t"), rows[0], (None, texts[1]), (7, hot.upper())]


@pytest.mark.parametrize("seed, words, similar", [(0, 3, (90, 100)), (1, 3, (90, 100)), (2, 5, (80, 100)), (3, 5, (80, 100))])
def test_components_against_all_pairs(spark, documents, seed, words, similar):
    rows = duplicate_rows(seed)
    found = jaccard.near_duplicates(spark, documents(rows), words, similar).collect()
    assert Counter(map(tuple, found)) == brute_components(rows, words, similar)


def test_packed_hashes_are_whole():
    low = np.uint64(0x7A5B) << np.uint64(48) | np.arange(2000, dtype=np.uint64)
    far = np.array([0, 1, (1 << 64) - 1, 1 << 63], np.uint64)
    hashes = np.sort(np.unique(np.concatenate((low, far))))
    batch = jaccard._pack([(hashes, np.zeros(len(hashes), np.uint16)), (hashes[:5], np.ones(5, np.uint16)), (hashes[-1:], np.full(1, 2, np.uint16))], [11, -22, 33], 4)
    back = []
    for row in batch.to_pylist():
        token, key = jaccard._unpack(*list(row.values())[1:])
        assert len(row["keys"]) == 8 * len(set(key.tolist()))
        back += zip(token.view(np.uint64).tolist(), key.tolist())
    assert sorted(back) == sorted([(h, 11) for h in hashes.tolist()] + [(h, -22) for h in hashes[:5].tolist()] + [(hashes[-1].item(), 33)])


@pytest.mark.parametrize("seed, words, similar", [(4, 3, (90, 100)), (5, 5, (80, 100))])
def test_every_link_against_all_pairs(spark, documents, seed, words, similar):
    rows = duplicate_rows(seed, 90)
    sets = [brute_set(text, words) for _, text in rows]
    num, den = similar
    linked = [[i != j and a and b and den * len(a & b) >= num * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    links, counted = jaccard.every_link(documents(rows), words, similar)
    assert Counter((r.doc_id, r.n_shingles, r.n_links) for r in counted.collect()) == Counter((d, len(s), sum(map(bool, row))) for (d, _), s, row in zip(rows, sets, linked))
    different = {frozenset((frozenset(sets[i]), frozenset(sets[j]))) for i, row in enumerate(linked) for j, yes in enumerate(row) if yes and sets[i] != sets[j]}
    assert links.count() == links.distinct().count() == len(different)


def test_one_of_each_group_stays(spark, documents):
    rows = duplicate_rows(3, 120)
    frame = documents(rows)
    kept = jaccard.keep_one(spark, frame, 3, (90, 100))
    want = {d for d, _, c in brute_components(rows, 3, (90, 100)) if d == c or d is None}
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)


def test_no_duplicates_among_nothing(spark, documents):
    assert jaccard.near_duplicates(spark, documents([(1, "a")]).limit(0)).count() == 0
    assert jaccard.keep_one(spark, documents([(1, None), (2, "")])).count() == 2


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 150)] + [(200, 200), (None, 3), (300, 299), (299, 300)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 150)} | {200: 200, 299: 299, 300: 299}
    assert found == want


# --- decontamination


def test_items_are_found_and_nothing_else(spark, documents):
    generator = random.Random(9)
    vocabulary = [f"v{i}" for i in range(300)] + ["the", "of", "and"] * 40
    text = lambda k: " ".join(generator.choices(vocabulary, k=k))
    items = [(i, f"{text(generator.randint(10, 40))}. {text(6)}.") for i in range(120)] + [(500, text(200) + ". " + text(5)), (501, None), (502, "v1 v2"), (503, "")]
    items.append(items[0])
    rows, want = [], set()
    for i in range(150):
        body = text(generator.randint(0, 400))
        if i % 3 == 0:
            item = generator.choice(items[:121])
            cut = generator.randint(0, len(body.split()))
            passage = item[1].upper() if i % 2 else item[1].replace(" ", "\n ")
            body = " ".join([*body.split()[:cut], passage, *body.split()[cut:]])
            want.add((i, item[0]))
        rows.append((i, body))
    rows += [(900, None), (901, ""), (902, "v1 v2"), (903, "v2 v1"), (904, "so V1, v2!")]
    # A short item is held where its words stand in a row.
    want |= {(i, 502) for i, body in rows if re.search(r"\bv1 v2\b", " ".join(re.findall(r"\w+", (body or "").lower())))}
    frame, benchmark = documents(rows), spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(spark, frame, benchmark).collect()}
    assert found == want
    clean = decontaminate.keep_clean(spark, frame, benchmark)
    assert clean.columns == frame.columns and {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in want}
    assert decontaminate.contaminations(spark, frame, benchmark.limit(0)).count() == 0
    assert decontaminate.contaminations(spark, frame.limit(0), benchmark).count() == 0


def test_blocks_lose_nothing_above_the_threshold():
    generator = np.random.default_rng(6)
    names = [f"t{i}" for i in range(200)]
    share = 1 / np.arange(1, 201)
    rows = [(i, " ".join(generator.choice(names, 30, p=share / share.sum())), "", "") for i in range(90)]
    index = decontaminate.build_index(rows)
    passages = [np.unique(generator.choice(len(index.terms), generator.integers(5, 120))) for _ in range(200)]
    owner = np.repeat(np.arange(200), [len(p) for p in passages])
    for threshold in (0.2, 0.5):
        found = set(zip(*(x.tolist() for x in decontaminate.retrieve(index, owner, np.concatenate(passages), 200, threshold)[:2])))
        want = set()
        for p, terms in enumerate(passages):
            which, entry, weight = index.entries.open(terms)
            score = np.bincount(entry, weight, len(index.items))
            want |= {(p, e) for e in np.flatnonzero(score >= threshold)}
        assert found == want


def test_given_question_and_answer_must_both_overlap(spark, documents):
    items = spark.createDataFrame([(1, "who wrote the long red book about stars", "who wrote the long red book about stars", "jane miller the second")], "item_id int, text string, question string, answer string")
    rows = [(1, "so who wrote the long red book about stars"), (2, "who wrote the long red book about stars jane miller the second")]
    assert [r.doc_id for r in decontaminate.contaminations(spark, documents(rows), items).collect()] == [2]


@pytest.mark.parametrize("shard_bytes", [decontaminate.SHARD_BYTES, 100])
def test_items_of_one_id_and_without_id_are_all_found(spark, documents, monkeypatch, shard_bytes):
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard_bytes)
    texts = ["Who wrote the long red book about stars? Jane Miller the second.", "Which river runs past seven old stone mills? The slow green Oder.", "What do nine grey owls eat at night? Mice and small beetles."]
    texts.append("When did the last tram leave the harbour? Long before the storm.")
    items = spark.createDataFrame(list(zip([0, 0, None, None], texts)), "item_id bigint, text string")
    rows = [(i, f"so they asked {text} and then left") for i, text in enumerate(texts)] + [(4, "nothing of all that"), (5, f"{texts[0]} {texts[1]}")]
    found = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminations(spark, documents(rows), items).collect())
    assert found == [(0, 0), (1, 0), (2, None), (3, None), (5, 0), (5, 0)]
    assert [r.doc_id for r in decontaminate.keep_clean(spark, documents(rows), items).collect()] == [4]


BOOKS = ["Who wrote the long red book about stars? Jane Miller the second.", "Which river runs past seven old stone mills? The slow green Oder.", "What do nine grey owls eat at night? Mice and small beetles.", "When did the last tram leave the harbour? Long before the storm.", "Which of the mills by the river burned down first? The third one.", "seven red owls", "Oder", "Who wrote the book about the harbour? The second owl.", "!!", ""]


def test_rows_do_not_depend_on_the_shards(spark, documents, monkeypatch):
    items = spark.createDataFrame([(i % 7, t) for i, t in enumerate(BOOKS)], "item_id bigint, text string")
    rows = [(i, f"they asked {a} and then {b.lower()} of it") for i, (a, b) in enumerate((a, b) for a in BOOKS for b in BOOKS[::3])]
    results = {}
    for shard_bytes in (1 << 20, 60, 1):
        monkeypatch.setattr(decontaminate, "SHARD_BYTES", shard_bytes)
        results[shard_bytes] = sorted(tuple(r) for r in decontaminate.contaminations(spark, documents(rows), items).collect())
    assert len(results[1]) > 50
    assert results[1 << 20] == results[60] == results[1]


def test_scripts_without_spaces(spark, documents):
    chinese, japanese, thai = "哪条河流经过七座古老的石头磨坊？缓慢的绿色奥得河。", "九羽の灰色のフクロウは夜に何を食べますか。ネズミと小さな甲虫です。", "แม่น้ำใดไหลผ่านโรงสีหินเก่าเจ็ดแห่ง"
    items = spark.createDataFrame([(1, chinese), (2, japanese), (3, thai), (4, "奥得")], "item_id bigint, text string")
    rows = [(1, f"昨天他问我{chinese}我不知道。"), (2, "むかし" + japanese), (3, f"เมื่อวาน{thai}ครับ"), (4, "河流经过很多城市，奥地利也得到了。"), (5, "river 奥得 mills"), (6, "ไม่มีอะไร")]
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminations(spark, documents(rows), items).collect()}
    assert found == {(1, 1), (1, 4), (2, 2), (3, 3), (5, 4)}


def test_a_long_text_is_read_in_stretches(monkeypatch):
    monkeypatch.setattr(decontaminate, "SLICE_BYTES", 200)
    index = decontaminate.build_index([(i, t, *decontaminate.question_and_answer(t)) for i, t in enumerate(BOOKS)])
    texts = pa.array([" ".join(["filler words go on"] * 300 + [BOOKS[0]] + ["and on"] * 500 + [BOOKS[5], "x" * 900, BOOKS[3]]), None])
    assert {(m[0], m[1]) for m in decontaminate.matches(index, texts, 0.5, 0.5)} == {(0, 0), (0, 5), (0, 3)}


def test_matching_within_a_full_shard_is_bounded(monkeypatch):
    """Passages that share their words with most of many short items, in pieces: the same as at once."""
    generator = np.random.default_rng(4)
    names = np.array([f"t{i}" for i in range(60)])
    rows = [(i, " ".join(generator.choice(names, 7)), "", "") for i in range(3000)]
    index = decontaminate.build_index(rows)
    passages = [np.unique(generator.choice(60, 25)) for _ in range(40)]
    owner, terms = np.repeat(np.arange(40), [len(p) for p in passages]), np.concatenate(passages)
    at_once = decontaminate.retrieve(index, owner, terms, 40, 0.6)
    monkeypatch.setattr(decontaminate, "OPENED", 500)
    monkeypatch.setattr(decontaminate, "PAIRS", 37)
    pieces = decontaminate.retrieve(index, owner, terms, 40, 0.6)
    key = lambda found: sorted(zip(*(x.tolist() for x in found)))
    assert len(at_once[0]) > 100 and key(pieces) == key(at_once)
    want = {(p, e) for p, own in enumerate(passages) for e in np.flatnonzero(np.bincount(index.entries.open(own)[1], index.entries.open(own)[2], len(index.items)) >= 0.6 - 1e-9)}
    assert set(zip(at_once[0].tolist(), at_once[1].tolist())) == want


# --- urls


def test_urls_are_split_and_ruled(spark):
    urls = {
        1: ("http://Www.Example.ORG/es/1?x", "www.example.org", "/es/1", "example.org/es/", "block"),
        2: ("https://example.org/en/12#a", "example.org", "/en/12", "example.org/en/1", "block"),
        3: ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        4: ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        5: ("x://a.com/fr/", "a.com", "/fr/", "com/fr/", "allow"),
        6: ("x://com/de/z", "com", "/de/z", "com/de/", "block"),
        7: ("x://a.net/de/z", "a.net", "/de/z", None, None),
        8: ("x://a.org", "a.org", "", None, None),
        9: ("x://a.org?/b", "a.org", "", None, None),
        10: (None, "", "", None, None),
        11: ("no separator", "", "", None, None),
        12: ("a://b://c.org/d", "b:", "//c.org/d", None, None),
        13: ("x://É.Org/p", "É.org", "/p", "org/", "allow"),
    }
    frame = spark.createDataFrame([(k, v[0], "rule", "host") for k, v in urls.items()], "page_id bigint, url string, rule string, host string")
    found = {r.page_id: r for r in url_filter.judge(spark, frame.unionByName(frame), URL_RULES).collect()}
    for k, (_, host, path, rule, verdict) in urls.items():
        assert (found[k].host, found[k].path, found[k].rule) == (host, path, rule)
        assert found[k].verdict == verdict if rule else found[k].verdict in ("allow", "block")
    assert url_filter.judge(spark, frame.limit(0), URL_RULES).count() == 0


def test_the_regression_learns_character_patterns(spark):
    rows = [(f"casino{i}.bet" if i % 2 else f"museum{i}.art", f"/p/{i}", i % 2) for i in range(400)]
    labelled = spark.createDataFrame(rows + [("x.y", "/", None)], "host string, path string, label int")
    pages = spark.createDataFrame([(1, "http://casino9999.bet/z"), (2, "http://museum9999.art/z")], "page_id bigint, url string")
    found = {r.page_id: r.verdict for r in url_filter.judge(spark, pages, [], labelled).collect()}
    assert found == {1: "block", 2: "allow"}


# --- archives


def page_rows():
    long = "".join(chr(97 + i % 26) + "é\r\n" for i in range(3000))
    return [
        (1, "http://a/1", "x" * 200), (2, "http://a/2", "x" * 200), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u v\r\nWARC/1.1", None),
        (6, "", ""), (7, "http://a/é", long), (8, "u", long), (9, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\n" * 9),
        (2, "again", "x" * 200), (None, "u", "x" * 200), (10, "u", "0\r\n\r\n" * 50),
    ]


def test_archives_give_back_what_was_written(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x") for r in page_rows()], "page_id bigint, url string, html string, digest string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, segment_chars=1000, records_per_file=7)
    payloads = warc.read_payloads(spark, path)
    assert payloads.filter("NOT intact").count() == 0
    found = Counter(tuple(r)[:5] for r in warc.page_digests(payloads).collect())
    first = {}
    for page_id, _, html in page_rows():
        if page_id is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, page_id), page_id)
    want = Counter()
    for page_id, _, html in page_rows():
        data = (html or "").encode()
        target = first.get(html) if page_id is not None else None
        revisit = target is not None and target != page_id
        want[page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", target if revisit else None] += 1
    assert found == want
    assert {bytes(r.payload) for r in payloads.filter("record_type = 'response'").collect()} == {(h or "").encode() for _, _, h in page_rows()}
    records = warc.read_records(spark, path)
    assert records.filter("record_type = 'continuation'").count() > 5


def test_lost_segments_are_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc" * 2000)], "page_id bigint, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, segment_chars=1000)
    records = warc.read_records(spark, path)
    assert warc.reassembled(records).filter("complete").count() == 1
    for missing in (2, 7):
        assert warc.reassembled(records.filter(f"segment <> {missing}")).filter("complete").count() == 0


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "warc"))
    assert warc.page_digests(warc.read_payloads(spark, str(tmp_path / "warc"))).count() == 0


def test_broken_framing_is_noticed():
    assert warc.unchunked(warc.chunked("a" * 20_000).encode()) == b"a" * 20_000
    assert warc.unchunked(b"5\r\nab") is None and warc.unchunked(b"") is None and warc.unchunked(b"2\r\nabc\r\n0\r\n\r\n") is None


def test_damage_costs_damaged_records_only():
    assert list(warc.parse_archive(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc")) == [(0, None, b"")]
    record = lambda length: b"WARC/1.1\r\nContent-Length: %s\r\n\r\nabc\r\n\r\n" % length
    for broken in (b"x", b"", b"2", b"400", b"-1"):
        read = list(warc.parse_archive(record(b"3") + record(broken) + record(b"3")))
        assert [(f is None, block) for _, f, block in read] == [(False, b"abc"), (True, b""), (False, b"abc")]
        assert read[1][0] == len(record(b"3"))
    whole = gzip.compress(record(b"3")) + gzip.compress(record(b"3"))
    assert warc._gunzip(whole) == record(b"3") * 2 and warc._gunzip(b"plain") == b"plain" and warc._gunzip(b"") == b""
    bad = bytearray(gzip.compress(random.Random(1).randbytes(200_000)))
    bad[150_000:150_100] = bytes(100)
    assert warc._gunzip(bytes(bad) + gzip.compress(record(b"3"))).endswith(record(b"3"))


def test_a_damaged_archive_stops_nothing(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 9) for i in range(40)], "page_id bigint, url string, html string")
    path = str(tmp_path / "warc")
    warc.write_archives(pages.coalesce(1), path, records_per_file=10)
    cut = sorted((tmp_path / "warc").glob("*.gz"))[0]
    cut.write_bytes(gzip.compress(gzip.decompress(cut.read_bytes())[:-30]))
    (cut.parent / f".{cut.name}.crc").unlink()
    records = warc.read_records(spark, path)
    damage = records.filter("record_type = 'damaged'").collect()
    assert len(damage) == 1 and damage[0].target_uri.endswith(cut.name) and damage[0].total_length > 0
    found = warc.page_digests(warc.revisits_checked(warc.read_payloads(spark, path)))
    assert found.count() == 39 and found.filter("intact").count() == 39


def test_revisits_name_records(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id bigint, url string, html string").union(
        spark.createDataFrame([(1, "http://a/1", "x" * 200)] * 2 + [(1, "", "y" * 300), (20, "", "y" * 300)])
    )
    path = str(tmp_path / "warc")
    warc.write_archives(pages, path, segment_chars=1000, records_per_file=7)
    records = warc.read_records(spark, path)
    ids = [r.record_id for r in records.collect()]
    assert len(ids) == len(set(ids))
    named = {r.refers_to for r in records.filter("record_type = 'revisit'").collect()}
    assert named and named <= {r.record_id for r in records.filter("record_type = 'response'").collect()}
    payloads = warc.read_payloads(spark, path)
    assert warc.revisits_checked(payloads).filter("NOT intact").count() == 0
    gone = sorted(named)[0]
    lost = warc.revisits_checked(payloads.filter(F.col("record_id") != gone)).filter("NOT intact").collect()
    assert lost and {r.refers_to for r in lost} == {gone}


# --- neighbours


def vector_rows(n, size, seed):
    generator = np.random.default_rng(seed)
    rows = generator.normal(size=(n, size)) * generator.uniform(0.3, 3, (n, 1))
    rows[: n // 3] = rows[0]
    return [(i, [float(x) for x in v]) for i, v in enumerate(rows.astype(np.float32))]


def exact_neighbours(rows, nearest):
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    result = {}
    for i, v in rows:
        if i % 20 == 0:
            score = vectors @ np.array(v)
            order = np.lexsort((ids, -score))
            result[i] = [(int(ids[j]), score[j]) for j in order if ids[j] != i][:nearest]
    return result


def test_neighbours_against_brute_force(spark):
    rows = vector_rows(3000, 16, 1)
    odd = [(5000, None), (5001, []), (5020, [0.0] * 16), (5040, [float("nan")] + [1.0] * 15), (5060, [None] + [1.0] * 15), (None, [1.0] * 16), rows[1]]
    frame = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("ids", F.lit(1)).withColumn("score", F.lit(2))
    found = {}
    for r in ann.nearest_neighbours(spark, frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = exact_neighbours(rows, 20)
    assert set(found) == set(want)
    by_id = {i: np.array(v) for i, v in rows}
    hits = 0
    for query, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        assert all(abs(by_id[v] @ by_id[query] - s) < 1e-9 for _, v, s in got)
        assert got == sorted(got, key=lambda g: (-g[2], g[1]))
        hits += len({v for _, v, _ in got} & {v for v, _ in want[query]})
    assert hits >= 0.95 * 20 * len(want)
    # Of the vector that a third share, the smallest ids come first.
    assert [v for _, v, _ in found[0]] == [v for v, _ in want[0]]


def test_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (20, [0.0, -1.0]), (21, [1.0, 2.0, 3.0]), (40, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = {}
    for r in ann.nearest_neighbours(spark, frame, F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert {q: [v for _, v in sorted(rs)] for q, rs in found.items()} == {0: [2, 1, 20], 20: [0, 2, 1], 40: [21]}
    assert ann.nearest_neighbours(spark, frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_every_node_of_a_graph_is_reached():
    vectors = np.random.default_rng(2).normal(size=(700, 8)).astype(np.float32)
    graph, entries = ann.build_graph(vectors, degree=8)
    seen, front = set(entries.tolist()), list(entries)
    while front:
        front = [j for i in front for j in graph[i].tolist() if j >= 0 and j not in seen and not seen.add(j)]
    assert len(seen) == 700 and (graph != np.arange(700)[:, None]).all()


# --- the registered queries


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck(SF_DIR), ORACLES[name]) is None


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 11))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
