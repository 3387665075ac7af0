"""Near-duplicate documents: an exact Jaccard join of word shingles with adaptive multi-match prefixes.

Documents with equal shingle sets form a class, and classes are what is compared. All shingles are
ordered from the rarest to the most frequent. Two sets as similar as asked for share at least L
shingles within their first ``n - ceil(s * n) + L`` ones, for any L. Each class picks its L by the
estimated cost: a longer prefix meets more posting entries, but a pair must then meet L times before
it is verified. A pair of classes needs the smaller of the two numbers.

How the order is found: packed blocks of (shingle, class) entries are dealt out by ranges of the shingle's
hash, which are even whatever the texts are. A range's task counts, and returns the entries of shingles
that two or more classes have. A class's other shingles are its own, come first in its order and can
match nothing: most classes end here, because too many of their shingles are their own.

Linking goes in two steps, so that a large group of near copies doesn't become all its pairs. First
each class is verified against one hub that it shares most prefix shingles with. Then only pairs whose
classes are not yet connected are gathered and verified. Connected classes need no further links for
the result, the components.

A null text, or one without words, has an empty set and is linked with nothing; it is its own
component. Rows with a null id take the component of their class, null if no row of it has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stellwerk.llm.batches import mix, release_memory, stored, text_slices
from stellwerk.llm.components import components
from stellwerk.llm.shingles import shingle_sets

WORDS = 5
SIMILAR = (80, 100)
LONGEST = 8
# Shingles in a packed block, and in a range of hashes.
BLOCK = 1 << 20
RANGE = 1 << 20
# Longs of parity bits that a class is compared by before its pairs are gathered.
PARITY = 8


def _class_keys(ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One 64-bit key per set: equal sets have equal keys."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    return mix(total[ends[1:]] - total[ends[:-1]] + np.diff(ends).astype(np.uint64)).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, n, key``: the size of each row's shingle set and the key of its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, key = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for start, offsets, data in text_slices(batch.column("text")):
                ends, hashes = shingle_sets(offsets, data, words)
                n[start : start + len(offsets) - 1] = np.diff(ends)
                key[start : start + len(offsets) - 1] = _class_keys(ends, hashes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(key)], ["doc_id", "n", "key"])
        release_memory()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, key bigint")


def _narrow(steps: np.ndarray) -> tuple[int, bytes]:
    """(bytes a number, the numbers in so many bytes each)."""
    width = max((int(steps.max(initial=0)).bit_length() + 7) // 8, 1)
    return width, np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widened(width: int, data: bytes) -> np.ndarray:
    full = np.zeros((len(data) // width, 8), np.uint8)
    full[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return full.view("<u8").ravel()


def _pack(entries: list[tuple[np.ndarray, np.ndarray]], keys: list[int], bits: int) -> pa.RecordBatch:
    """One row per range: sorted hashes as differences, each entry's place among the row's keys, and the keys.

    A row has the keys of its own entries only, so that what a range gets grows with its shingles.
    """
    hashes, place = (np.concatenate(x) for x in zip(*entries))
    order = np.argsort(hashes)
    hashes, place = hashes[order], place[order]
    found, first = np.unique((hashes >> np.uint64(64 - bits)).astype(np.int64), return_index=True)
    rows: list[tuple] = []
    every = np.array(keys, np.int64)
    for number, a, b in zip(found, first, [*first[1:], len(hashes)]):
        width, steps = _narrow(np.diff(hashes[a:b]))
        met, local = np.unique(place[a:b], return_inverse=True)
        rows.append((number, int(hashes[a].view(np.int64)), width, steps, local.astype(np.uint16).tobytes(), every[met].tobytes()))
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], ["range", "first", "width", "steps", "place", "keys"]
    )


def _unpack(first: int, width: int, steps: bytes, place: bytes, keys: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, class keys) of a row that ``_pack`` made; every hash is whole."""
    hashes = np.concatenate(([np.int64(first).view(np.uint64)], _widened(width, steps)))
    return np.cumsum(hashes, dtype=np.uint64).view(np.int64), np.frombuffer(keys, np.int64)[np.frombuffer(place, np.uint16)]


def shared_shingles(docs: DataFrame, words: int, bits: int) -> DataFrame:
    """``key, token, df`` for each shingle that at least two classes have; ``df`` counts the classes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, keys, seen, held = [], [], set(), 0
        for batch in batches:
            for _, offsets, data in text_slices(batch.column("text")):
                ends, hashes = shingle_sets(offsets, data, words)
                for key, a, b in zip(_class_keys(ends, hashes).tolist(), ends[:-1], ends[1:]):
                    if a == b or key in seen:
                        continue
                    entries.append((hashes[a:b], np.full(b - a, len(keys), np.uint16)))
                    keys.append(key)
                    seen.add(key)
                    held += b - a
                    if held >= BLOCK or len(keys) == 1 << 16:
                        yield _pack(entries, keys, bits)
                        entries, keys, seen, held = [], [], set(), 0
                        release_memory()
        if keys:
            yield _pack(entries, keys, bits)
        release_memory()

    def count(group: pa.Table) -> pa.Table:
        parts = [_unpack(*(value.as_py() for value in row)) for row in zip(*(group.column(c) for c in group.column_names[1:]))]
        token, key = (np.concatenate(x) for x in zip(*parts))
        del parts
        release_memory()
        order = np.argsort(token, kind="stable")
        token, key = token[order], key[order]
        del order
        # Only shingles seen more than once need their classes told apart.
        same = token[1:] == token[:-1]
        often = np.zeros(len(token), bool)
        often[1:] |= same
        often[:-1] |= same
        pairs = np.unique(np.stack([token[often], key[often]], axis=1), axis=0) if often.any() else np.empty((0, 2), np.int64)
        _, where, df = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
        df = df[where] if len(pairs) else np.empty(0, np.int64)
        keep = df > 1
        return pa.table({"key": pairs[keep, 1], "token": pairs[keep, 0], "df": df[keep].astype(np.int64)})

    blocks = docs.select("text").mapInArrow(
        pack, "range int, first bigint, width int, steps binary, place binary, keys binary"
    )
    return blocks.groupBy("range").applyInArrow(count, "key bigint, token bigint, df bigint")


def _ceil_share(n: Column, similar: tuple[int, int]) -> Column:
    """The least overlap that a set of ``n`` can have with a set that similar."""
    num, den = similar
    return F.ceil((n * num) / F.lit(den) - 1e-9)


def prefixes(shared: DataFrame, sizes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """``key, n, own, tokens, parity, entries, need``: classes that can be that similar to another one.

    ``own`` counts the shingles that no other class has. ``entries`` are the prefix's shared shingles with
    the smallest L whose prefix holds them; ``need`` is the class's L.
    """
    by_class = shared.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ordered"))
    rows = by_class.join(sizes, "key").withColumn("own", F.col("n") - F.size("ordered"))
    rows = rows.withColumn("base", F.col("n") - _ceil_share(F.col("n"), similar) + 1).filter("own < base")
    # The k-th shared shingle stands at position own + k and is in the prefix of L from own + k - base + 2 on.
    level = lambda k: F.greatest(F.lit(1), F.col("own") + k - F.col("base") + 2)
    near = F.filter(
        F.transform("ordered", lambda x, k: F.struct(level(k).cast("int").alias("level"), x["df"].alias("df"), x["token"].alias("token"))),
        lambda x: x["level"] <= LONGEST,
    )
    rows = rows.withColumn("near", near)

    def cost(length: int) -> Column:
        met = F.aggregate(
            F.filter("near", lambda x: x["level"] <= length), F.lit(0).cast("bigint"), lambda total, x: total + x["df"] - 1
        )
        # Entries met, and for each pair that meets often enough one verification of about n steps.
        return F.struct((met + met / length * F.col("n") / 16).alias("cost"), F.lit(length).alias("need"))

    tokens = F.transform("ordered", lambda x: x["token"])
    # Tokens are signed: the places come from their lowest bits.
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(t, 3).bitwiseAND(63).cast("int"))
    # For each of 64 * PARITY places, whether an odd number of the shared shingles falls on it.
    parity = [
        F.aggregate(
            F.filter(tokens, lambda t: t.bitwiseAND(PARITY - 1) == k), F.lit(0).cast("bigint"), lambda bits, t: bits.bitwiseXOR(bit(t))
        )
        for k in range(PARITY)
    ]
    best = F.array_min(F.array(*[cost(length) for length in range(1, LONGEST + 1)]))
    return rows.withColumn("need", best["need"]).select(
        "key",
        "n",
        "own",
        "need",
        F.array_sort(tokens).alias("tokens"),
        F.array(*parity).alias("parity"),
        F.filter("near", lambda x: x["level"] <= F.col("need")).alias("entries"),
    )


def _could_link(a: str, b: str, similar: tuple[int, int]) -> Column:
    """By sizes, by how many shingles the two have that are not their own, and by what they don't share.

    What only one of them has is its own shingles and, of the shared ones, at least as many as parity
    bits differ. None of the tests drops a pair that is similar enough.
    """
    num, den = similar
    overlap = f"ceil(({a}.n + {b}.n) * {num} / ({num} + {den}) - 1e-9)"
    differ = " + ".join(f"bit_count({a}.parity[{k}] ^ {b}.parity[{k}])" for k in range(PARITY))
    return (
        F.expr(f"least({a}.n, {b}.n) * {den} >= greatest({a}.n, {b}.n) * {num}")
        & F.expr(f"least({a}.n - {a}.own, {b}.n - {b}.own) >= {overlap}")
        & F.expr(f"{a}.own + {b}.own + {differ} <= {a}.n + {b}.n - 2 * {overlap}")
    )


def verify(pairs: DataFrame, classes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """The pairs (u, v) whose sets are that similar; what two sets share is among their shared shingles."""
    num, den = similar
    sides = [classes.select(F.col("key").alias(k), F.col("n").alias(f"n_{k}"), F.col("tokens").alias(f"tokens_{k}")) for k in "uv"]
    rows = pairs.join(sides[0], "u").join(sides[1], "v")
    both = F.size(F.array_intersect("tokens_u", "tokens_v"))
    return rows.filter(both * den >= (F.col("n_u") + F.col("n_v") - both) * num).select("u", "v")


def _hub_pairs(classes: DataFrame, entries: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """For each class the hub of a prefix shingle that it shares most prefix shingles with.

    A shingle's hub is its class with the fewest own shingles: the likeliest origin of copies.
    """
    first = entries.filter("level = 1").select("token", "key", "n", "own", "parity")
    hubs = first.groupBy("token").agg(F.min(F.struct("own", "key", "n", "parity")).alias("h"), F.count("*").alias("c")).filter("c > 1")
    met = first.alias("a").join(hubs.select("token", "h.*").alias("b"), "token").filter("a.key <> b.key")
    met = met.filter(_could_link("a", "b", similar)).groupBy(F.col("a.key").alias("u"), F.col("b.key").alias("v")).count()
    return met.groupBy("u").agg(F.max(F.struct("count", "v"))["v"].alias("v"))


def _open_pairs(entries: DataFrame, similar: tuple[int, int], every: bool = False) -> DataFrame:
    """Pairs of classes that meet as often as the shorter prefix asks for; unless ``every``, of different components."""
    a, b = entries.alias("a"), entries.alias("b")
    need = F.expr("least(a.need, b.need)")
    met = a.join(b, F.expr("a.token = b.token AND a.key < b.key" + ("" if every else " AND a.root <> b.root")))
    met = met.filter(_could_link("a", "b", similar) & (F.expr("greatest(a.level, b.level)") <= need))
    return (
        met.groupBy(F.col("a.key").alias("u"), F.col("b.key").alias("v"))
        .agg(F.count("*").alias("times"), F.max(need).alias("need"))
        .filter("times >= need")
        .select("u", "v")
    )


def _range_bits(shingles: int) -> int:
    return min(max(int(np.ceil(np.log2(max(shingles, 1) / RANGE))), 4), 20)


def every_link(docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> tuple[DataFrame, DataFrame]:
    """All links: (``u, v``) pairs of classes of different texts, and ``doc_id, key, n_shingles, n_links`` per row.

    ``n_links`` counts the other rows that a row links with, copies of itself included; equal texts are never expanded
    into pairs. Rows with empty sets have no links. The pairs of a group of near copies are its square: use
    ``near_duplicates`` where only the groups are asked for.
    """
    signed = stored(signatures(docs, words), "signatures")
    sizes = stored(signed.filter("n > 0").groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("rows")), "class-sizes")
    shingles = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    classes = stored(prefixes(shared_shingles(docs, words, _range_bits(shingles)), sizes.select("key", "n"), similar), "classes")
    about = ("key", "n", "own", "need", "parity")
    entries = classes.select(*about, F.explode("entries").alias("e")).select(*about, "e.token", "e.level")
    links = stored(verify(_open_pairs(entries, similar, every=True), classes, similar), "every-link")
    sides = links.select(F.col("u").alias("key"), F.col("v").alias("other")).unionByName(links.select(F.col("v").alias("key"), F.col("u").alias("other")))
    met = sides.join(sizes.select(F.col("key").alias("other"), "rows"), "other").groupBy("key").agg(F.sum("rows").alias("met"))
    counted = sizes.join(met, "key", "left").select("key", (F.col("rows") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"))
    joined = signed.withColumn("key", F.when(F.col("n") > 0, F.col("key"))).join(counted, "key", "left")
    return links, joined.select("doc_id", "key", F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def class_links(docs: DataFrame, sizes: DataFrame, shingles: int, words: int, similar: tuple[int, int]) -> DataFrame:
    """``u, v`` (class keys): links that connect the same classes as all links would."""
    classes = stored(prefixes(shared_shingles(docs, words, _range_bits(shingles)), sizes, similar), "classes")
    about = ("key", "n", "own", "need", "parity")
    entries = classes.select(*about, F.explode("entries").alias("e")).select(*about, "e.token", "e.level")
    hub_pairs = stored(_hub_pairs(classes, entries, similar), "hub-pairs")
    first = stored(verify(hub_pairs, classes, similar), "hub-links")
    roots = components(first)
    rooted = entries.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    tried = hub_pairs.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u"))
    rest = _open_pairs(stored(rooted, "entries"), similar).join(tried, ["u", "v"], "left_anti")
    return stored(first.unionByName(verify(rest, classes, similar)), "links")


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``doc_id, text``.

    Two documents link when the intersection of their shingle sets is at least ``similar`` (as a
    fraction) of the union; ``component_id`` is the smallest id reachable by links.
    """
    signed = stored(signatures(docs, words), "signatures")
    classes = stored(
        signed.filter("n > 0").groupBy("key").agg(F.max("n").alias("n"), F.min("doc_id").alias("least")), "class-sizes"
    )
    shingles = signed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = components(class_links(docs, classes.select("key", "n"), shingles, words, similar))
    rooted = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = stored(rooted.join(least, "root").select("key", "component_id"), "members")
    # The side of the documents can be split where very many share one class.
    joined = signed.withColumn("key", F.when(F.col("n") > 0, F.col("key"))).join(members, "key", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame, words: int = WORDS, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest id, all columns kept.

    Rows with empty sets or without an id are kept. Of repeated rows with that id one stays.
    """
    found = near_duplicates(spark, docs, words, similar).filter("doc_id IS NOT NULL")
    by_id = found.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.col("n_shingles") > 0).alias("linked"), F.max(F.expr("n_shingles > 0 AND doc_id = component_id")).alias("stays"), F.count("*").alias("rows")
    )
    # Only ids decide: those whose rows go, and the few whose rows must be looked at together.
    marked = stored(by_id.filter("linked AND (NOT stays OR rows > 1)").select("id", "stays"), "marked")
    rows = docs.select(F.struct("*").alias("doc"))
    on = F.col("doc.doc_id") == F.col("id")
    single = rows.join(marked, on, "left_anti").select("doc.*")
    copy = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("doc.text")))
    repeated = rows.join(marked.filter("stays"), on).withColumn("copy", copy).filter("copy = 1").select("doc.*")
    return single.unionByName(repeated)
