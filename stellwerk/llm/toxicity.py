"""Toxicity of texts: noisy-channel restoration of disguised words, then a linear score.

Disguised words are letters mixed with look-alike digits and signs (in front, inside or behind), three or
more single letters or signs set apart, and letters repeated three times or more. Each is a lattice: a look-alike stands for one of several letters or for
itself and then separates words, a run for one, two or all of its letters, and a gap between
letters set apart is left out or the border of two words. A Viterbi search over the lattice picks the spelling
that channel and character language model (all trigrams of words of all learned texts)
together find likeliest, in time linear in the token's runs, however long it is. One letter again and
again has no word behind it and stays, as does everything else of a text.

The restored text is scored by a logistic regression on hashed character n-grams (present or not).
Which n-grams count is decided over all labelled rows, by the association of their presence with the
label: an n-gram must stand in ``LEAST_TOXIC`` toxic rows, and the ``MOST_FEATURES`` most associated ones
count. The regression's weights are fitted on a bounded sample of ``TRAINING_ROWS``.

A null or empty text has no n-gram and gets the regression's bias as its score. Rows without a label,
or with a null one, are not learned from; of repeated labels of a document the greatest counts. A null
``doc_id`` has no label and a null ``held_out``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stellwerk.llm.batches import text_slices
from stellwerk.llm.linear import fit_logistic, ngram_buckets, sigmoid

BITS = 22
SIZES = (4, 5, 6)
MOST_FEATURES = 2_048
LEAST_TOXIC = 3
# Rows of the sample that the weights are fitted on.
TRAINING_ROWS = 20_000
# Labels up to this many rows are sent to the tasks; beyond it the texts are shuffled to them.
BROADCAST_LABELS = 1_000_000
# Three n-gram sizes at once make many temporary arrays: shorter slices than elsewhere.
_SLICE = 1 << 19
_EMITTED = 1 << 18

# Which letters a sign can stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "*": "aeiou", "€": "e", "£": "l", "(": "c", "#": "h",
}
_SIGNS = "".join(LOOK_ALIKES)
_LETTER, _MARK = r"[^\W\d_]", f"[{re.escape(_SIGNS)}]"
_ANY = rf"(?:{_LETTER}|{_MARK})"
# Three letters or signs set apart; a token of letters and signs, or of letters with a run of three equal ones.
_DISGUISED = re.compile(
    rf"(?<!\w)(?P<apart>(?:{_ANY}[ .\-_]){{2,}}{_ANY})(?!\w)"
    rf"|(?<!{_LETTER})(?<!{_MARK})(?:(?={_LETTER}++{_MARK})|(?={_MARK}++{_LETTER})|(?={_LETTER}*?({_LETTER})\2\2)){_ANY}++"
)
_WORD = re.compile(rf"{_LETTER}+")
# Distinct words and trigrams that a task holds before it passes their counts on.
_MOST_WORDS, _MOST_GRAMS = 200_000, 500_000
_HAS_LETTER = re.compile(_LETTER)
_CLEAN = np.arange(256, dtype=np.uint8)
_CLEAN[[b for b in range(128) if not chr(b).isalnum()]] = 32
_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[b for b in range(256) if b >= 128 or chr(b).isalpha()]] = True
_IS_SIGN = np.zeros(256, bool)
_IS_SIGN[[b for s in _SIGNS for b in s.encode()[-1:]]] = True
# First bytes of letters of two, three and four bytes start here.
_LEADS = np.array([0xC0, 0xE0, 0xF0], np.uint8)
_IS_GAP = np.zeros(256, bool)
_IS_GAP[[ord(c) for c in " .-_"]] = True
# Log costs of the channel: a sign stands for itself (less behind another one, or at the edge of a word
# for punctuation, least for "!", "(" and emphasis of three), a sign stands for a letter, a run is shortened;
# letters set apart are one word at all, and a gap between them is real.
_KEEP_SIGN, _KEEP_NEXT, _KEEP_EDGE, _KEEP_EMPHASIS = -8.0, -2.0, -4.0, -1.0
_REPLACE, _SHORTEN, _APART, _SPLIT = -1.0, -0.5, -5.0, -5.0
_PUNCTUATION, _OFTEN, _EMPHASIS = frozenset("|+*#"), frozenset("!("), frozenset("!|+*(#$")
_BEGIN, _AFTER_SIGN = "^^", "^"
_LONGEST_REMEMBERED = 64


def _keep(sign: str, times: int) -> float:
    """What it costs that signs at the edge of a word stand for themselves."""
    if sign in _OFTEN or (times > 2 and sign in _EMPHASIS):
        return _KEEP_EMPHASIS
    if sign in _PUNCTUATION:
        return _KEEP_EDGE
    return _KEEP_SIGN if sign.isdigit() else _KEEP_SIGN * min(times, 2)


@dataclass
class SpellingModel:
    """Interpolated trigrams of the letters of words."""

    trigrams: dict[str, int]
    bigrams: Counter = field(default_factory=Counter)
    pairs: Counter = field(default_factory=Counter)
    single: Counter = field(default_factory=Counter)
    memo: dict[str, str] = field(default_factory=dict)
    steps: dict[tuple, tuple[float, str]] = field(default_factory=dict)

    def __post_init__(self):
        for gram, n in self.trigrams.items():
            self.pairs[gram[:2]] += n
            self.bigrams[gram[1:]] += n
            self.single[gram[1]] += n
        self.total = sum(self.single.values()) + 1

    def log(self, before: str, letter: str) -> float:
        p3 = self.trigrams.get(before + letter, 0) / (self.pairs[before] + 1)
        p2 = self.bigrams[before[1] + letter] / (self.single[before[1]] + 1)
        p1 = (self.single[letter] + 0.1) / (self.total + 10)
        return math.log(0.7 * p3 + 0.25 * p2 + 0.05 * p1)

    def restore(self, word: str, apart: bool = False) -> str:
        """The likeliest spelling of a disguised word, or of letters set apart by single characters."""
        if not _HAS_LETTER.search(word):
            return word
        if len(word) > _LONGEST_REMEMBERED:
            return self._decode(word, apart)
        if word not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[word] = self._decode(word, apart)
        return self.memo[word]

    def _append(self, state: str, letter: str, length: int) -> tuple[float, str]:
        """(log probability, new state) of ``length`` times a letter; all from the third on are alike."""
        known = self.steps.get((state, letter, length))
        if known is None:
            value, last = 0.0, _BEGIN if state == _AFTER_SIGN else state
            for _ in range(min(length, 3)):
                more = self.log(last, letter)
                value, last = value + more, last[1] + letter
            if length > 3:
                value += (length - 3) * more
            known = value, last
            if len(self.steps) > 1_000_000:
                self.steps.clear()
            self.steps[state, letter, length] = known
        return known

    def _single(self, letter: str) -> float:
        value, state = self._append(_BEGIN, letter, 1)
        return value + self._end(state)

    def _end(self, state: str) -> float:
        return 0.0 if state in (_BEGIN, _AFTER_SIGN) else self._append(state, "$", 1)[0]

    def _decode(self, word: str, apart: bool) -> str:
        if apart:
            runs, gaps = [(c, 1) for c in word[::2]], word[1::2]
        else:
            runs, gaps = [(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", word)], ""
            # One letter again and again has no word behind it.
            if len(runs) == 1:
                return word
        tail = len(runs)
        while tail and runs[tail - 1][0] in LOOK_ALIKES:
            tail -= 1
        # best[i][state]: (log probability, what led there) of the first i runs; the state is the last two
        # letters. What led there is a chain of (chain, piece), so that no spelling is copied.
        best: list[dict] = [{} for _ in range(len(runs) + 1)]
        best[0] = {_BEGIN: (0.0, None)}
        equal_until = 0
        for i, (char, size) in enumerate(runs):
            sign = char in LOOK_ALIKES
            letters = LOOK_ALIKES[char] if sign else char
            channel = _REPLACE if sign else 0.0
            # (runs taken, letters, cost)
            spans = [(1, size, 0.0)]
            if size > 2:
                spans += [(1, 1, _SHORTEN), (1, 2, _SHORTEN)]
            elif apart and i >= equal_until:
                equal_until = i + 1
                while equal_until < len(runs) and runs[equal_until][0] == char:
                    equal_until += 1
                taken = equal_until - i
                if taken > 2:
                    spans += [(taken, length, _SHORTEN) for length in (1, 2)]
            starts = best[i]
            best[i] = {}
            if gaps and i:
                # A gap is kept as the border of two words, or left out.
                starts_with_gap = {state: found for state, found in starts.items() if state != _AFTER_SIGN}
                for state, (score, chain) in starts.items():
                    value, begin = score + self._end(state) + _SPLIT, _AFTER_SIGN if state == _AFTER_SIGN else _BEGIN
                    if value > starts_with_gap.get(begin, (-math.inf,))[0]:
                        starts_with_gap[begin] = (value, (chain, gaps[i - 1]))
                starts = starts_with_gap
            keep = _keep(char, size) if i == 0 or i >= tail else _KEEP_SIGN
            for state, (score, chain) in starts.items():
                if sign:
                    value = score + self._end(state) + (_KEEP_NEXT if state == _AFTER_SIGN else keep)
                    if value > best[i + 1].get(_AFTER_SIGN, (-math.inf,))[0]:
                        best[i + 1][_AFTER_SIGN] = (value, (chain, char * size))
                for taken, length, cost in spans:
                    step = best[i + taken]
                    for letter in letters:
                        more, last = self._append(state, letter, length)
                        value = score + channel + cost + more
                        if value > step.get(last, (-math.inf,))[0]:
                            step[last] = (value, (chain, letter * length))
        value, _, chain = max((score + self._end(state), state, chain) for state, (score, chain) in best[-1].items())
        if apart and value + _APART <= sum(_KEEP_NEXT if c in LOOK_ALIKES else self._single(c) for c, _ in runs):
            return word
        pieces = []
        while chain:
            chain, piece = chain
            pieces.append(piece)
        return "".join(reversed(pieces))


def disguised_rows(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Rows that may hold a disguised word: a sign beside a letter, three equal letters, three letters or signs set apart."""
    n = len(data)
    if n < 2:
        return np.empty(0, np.int64)
    letter, sign = _IS_LETTER[data], _IS_SIGN[data]
    hit = np.zeros(n, bool)
    hit[:-1] |= sign[:-1] & letter[1:]
    hit[:-1] |= letter[:-1] & sign[1:]
    # Three equal letters: byte by byte for ASCII, from their first bytes for longer ones.
    hit[2:] |= letter[2:] & (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    for size, low, high in ((2, 0xC0, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF7)):
        at = np.flatnonzero((data >= low) & (data <= high))
        at = at[at + 3 * size <= n]
        for i in range(2 * size):
            at = at[data[at + i] == data[at + i + size]]
        hit[at] = True
    # The middle one of three set apart lies between two gaps.
    gap = np.flatnonzero(_IS_GAP[data])
    begin, end = gap[:-1], gap[1:]
    size = np.searchsorted(_LEADS, data[np.minimum(begin + 1, n - 1)], "right") + 1
    middle = (end - begin == size + 1) & (begin > 0) & (end < n - 1)
    begin, end = begin[middle], end[middle]
    word = np.concatenate([letter | sign, [False]])
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    # Longer letters beside the gaps are looked at by the expression.
    before = word[begin - 1] & ((data[begin - 1] >= 128) | border[begin - 1] | ~word[begin - 2] | sign[begin - 1])
    after = word[end + 1] & ((data[end + 1] >= 128) | border[end + 2] | ~word[end + 2])
    hit[begin[word[begin + 1] & before & after]] = True
    return np.flatnonzero(np.bincount(np.searchsorted(offsets, np.flatnonzero(hit), "right") - 1))


def restored(texts: pa.Array, spelling: SpellingModel) -> pa.Array:
    """Lower-cased texts with their disguised words restored."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    changed = {}
    for start, offsets, data in text_slices(lower):
        for row in disguised_rows(offsets, data).tolist():
            text = lower[start + row].as_py()
            new = _DISGUISED.sub(lambda m: spelling.restore(m[0], m["apart"] is not None), text)
            if new != text:
                changed[start + row] = new
    if not changed:
        return lower
    rows = np.array(sorted(changed))
    mask = np.zeros(len(lower), bool)
    mask[rows] = True
    return pc.replace_with_mask(lower, pa.array(mask), pa.array([changed[r] for r in rows.tolist()], pa.large_string()))


def _present(texts: pa.Array, spelling: SpellingModel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, bucket) of all n-grams per slice, not yet distinct."""
    for start, offsets, data in text_slices(restored(texts, spelling), _SLICE):
        yield start, len(offsets) - 1, *ngram_buckets(offsets, _CLEAN[data], SIZES, BITS)


def distinct_by_row(n: int, row: np.ndarray, bucket: np.ndarray, last: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct buckets) for each row, without sorting: of equal buckets in a row the last one stays.

    ``row`` is made of ascending runs, one per n-gram size. ``last`` is room for one number per bucket.
    """
    bounds = np.flatnonzero(np.diff(row) < 0) + 1
    runs = [(part, np.searchsorted(of, np.arange(n + 1))) for of, part in zip(np.split(row, bounds), np.split(bucket, bounds))]
    for i in range(n):
        own = np.concatenate([part[ends[i] : ends[i + 1]] for part, ends in runs])
        place = np.arange(len(own), dtype=np.int32)
        last[own] = place
        yield i, own[last[own] == place]


@dataclass(frozen=True)
class ToxicityModel:
    spelling: dict[str, int]
    place: np.ndarray  # bucket -> feature, -1 for none
    weights: np.ndarray
    bias: float


def _sample(rows: DataFrame, most: int, total: int) -> DataFrame:
    part = int((1 << 30) * min(1.0, most / max(total, 1)))
    return rows.filter(F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 30) - 1)) < part)


def count_trigrams(texts: DataFrame) -> dict[str, int]:
    """All trigrams of letters of the words of all rows of ``text``, with marks for begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        total: Counter[str] = Counter()

        def spell() -> None:
            for word, n in words.items():
                marked = f"^^{word}$"
                for i in range(len(marked) - 2):
                    total[marked[i : i + 3]] += n
            words.clear()

        def emitted() -> pa.RecordBatch:
            spell()
            batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["gram", "n"])
            total.clear()
            return batch

        for batch in batches:
            for text in batch.column("text"):
                words.update(_WORD.findall((text.as_py() or "").lower()))
                if len(words) > _MOST_WORDS:
                    spell()
                if len(total) > _MOST_GRAMS:
                    yield emitted()
        yield emitted()

    counted = texts.select("text").mapInArrow(run, "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(counted.column("gram").to_pylist(), counted.column("n").to_pylist()))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> ToxicityModel:
    """Fit on the labelled rows of ``doc_id, text`` for which ``learn`` holds; labels have ``doc_id, toxic``."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    n_labels = known.count()
    rows = docs.select("doc_id", "text")
    if learn is not None:
        rows = rows.filter(learn)
    rows = rows.join(F.broadcast(known) if n_labels <= BROADCAST_LABELS else known, "doc_id").filter("text IS NOT NULL")
    spelling = count_trigrams(rows)
    shared = spark.sparkContext.broadcast(spelling)

    def associate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, seen, docs_of = SpellingModel(shared.value), np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        last = np.zeros(1 << BITS, np.int32)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            for start, n, row, bucket in _present(batch.column("text"), model):
                label = toxic[start : start + n]
                docs_of += np.bincount(label, minlength=2)
                for at, present in distinct_by_row(n, row, bucket, last):
                    seen[label[at], present] += 1
        names = ["bucket", "clean", "toxic"]
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), *(pa.array(docs_of[k : k + 1]) for k in (0, 1))], names)
        for first in range(0, 1 << BITS, _EMITTED):
            part = seen[:, first : first + _EMITTED]
            found = np.flatnonzero(part.any(axis=0))
            counts = part[:, found].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found + first), pa.array(counts[0]), pa.array(counts[1])], names)

    counted = (
        rows.select("text", "toxic")
        .mapInArrow(associate, "bucket bigint, clean bigint, toxic bigint")
        .groupBy("bucket")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter((F.col("bucket") < 0) | (F.col("toxic") >= LEAST_TOXIC))
    )
    bucket, clean, toxic = (c.to_numpy() for c in counted.orderBy("bucket").toArrow().columns)
    place = np.full(1 << BITS, -1, np.int16)
    if len(bucket):
        chosen = bucket[1:][strongest(clean[1:], toxic[1:], int(clean[0]), int(toxic[0]))]
        place[chosen] = np.arange(len(chosen))
    n_features = int(place.max()) + 1
    places = spark.sparkContext.broadcast(place)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SpellingModel(shared.value)
        for batch in batches:
            for start, n, row, bucket in _present(batch.column("text"), model):
                owner, feature = _features(places.value, row, bucket)
                ends = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(start, n), batch.column("toxic").slice(start, n), pa.ListArray.from_arrays(ends, pa.array(feature))],
                    ["doc_id", "toxic", "features"],
                )

    sample = _sample(rows, TRAINING_ROWS, n_labels).mapInArrow(features, "doc_id bigint, toxic boolean, features array<int>")
    fitted = sample.orderBy("doc_id", "toxic", F.size("features")).toArrow().combine_chunks()
    if not fitted.num_rows:
        return ToxicityModel(spelling, place, np.zeros(1, np.float32), 0.0)
    lists = fitted.column("features").combine_chunks()
    row = np.repeat(np.arange(fitted.num_rows), np.diff(lists.offsets.to_numpy()))
    feature = lists.flatten().to_numpy()
    target = fitted.column("toxic").combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)
    weights, bias = fit_logistic(row, feature, np.ones(len(feature)), target, max(n_features, 1), epochs=20, rate=0.2, l2=1e-4)
    return ToxicityModel(spelling, place, weights, bias)


def strongest(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """Places of the n-grams most associated with the toxic label (log likelihood ratio), strongest first."""
    n = n_clean + n_toxic
    seen = clean + toxic
    expected = seen * (n_toxic / max(n, 1))

    def part(observed, expect):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expect, 1e-12)), 0.0)

    ratio = part(toxic, expected) + part(clean, seen - expected)
    ratio += part(n_toxic - toxic, n_toxic - expected) + part(n_clean - clean, n_clean - seen + expected)
    ratio[toxic <= 1.5 * expected] = 0
    order = np.argsort(-ratio, kind="stable")[:MOST_FEATURES]
    return order[ratio[order] > 5]


def _features(place: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature), by row."""
    feature = place[bucket]
    key = np.unique(row[feature >= 0].astype(np.int64) * MOST_FEATURES + feature[feature >= 0])
    return key // MOST_FEATURES, (key % MOST_FEATURES).astype(np.int32)


def classify(spark: SparkSession, docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, predicted`` for every row, by its whole restored text."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        spelling = SpellingModel(fitted.spelling)
        for batch in batches:
            score = np.full(len(batch), float(sigmoid(np.float64(fitted.bias))))
            for start, n, row, bucket in _present(batch.column("text"), spelling):
                owner, feature = _features(fitted.place, row, bucket)
                score[start : start + n] = sigmoid(np.bincount(owner, fitted.weights[feature], n) + fitted.bias)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double, predicted int")
