"""A bidirectional FM-index of a delimited vocabulary in numpy, and the search for words one error away.

The text is ``#word#word#...#``. One index is of the text, one of the text reversed; a pattern is held as an
interval of ranks in both, which are of equal size. A step on one side narrows that side's interval by rank
queries and moves the other one by the number of smaller symbols. All patterns of a call make a step together.
"""

from __future__ import annotations

import numpy as np

# Rows of the table of counts stand this many symbols apart.
_STEP = 128
# Nodes with at most this many suffixes list their next symbols; larger ones try the alphabet.
_FEW = 48


def _suffix_ranks(text: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling, begun with as many symbols as fit into a long."""
    n = len(text)
    padded = np.concatenate((text.astype(np.int64) + 1, np.zeros(16, np.int64)))
    bits = int(padded.max()).bit_length()
    width = min(62 // bits, 16)
    key = np.zeros(n, np.int64)
    for i in range(width):
        key = (key << bits) | padded[i : i + n]
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        if rank[order[-1]] == n - 1:
            return order
        later = np.zeros(n, np.int64)
        if width < n:
            later[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + later
        width *= 2


class Side:
    """Rank queries over the Burrows-Wheeler transform of one direction."""

    def __init__(self, text: np.ndarray, symbols: int):
        n = len(text)
        self.size, self.symbols = n, symbols
        self.places = _suffix_ranks(text)
        self.last = text[self.places - 1]
        # The places of each symbol one after the other; a place's rank here is its mapping.
        self.by_symbol = np.sort(self.last.astype(np.int64) * (n + 1) + np.arange(n))
        blocks = n // _STEP + 1
        filled = np.full(blocks * _STEP, symbols, np.int64)
        filled[:n] = self.last
        counts = np.bincount(np.repeat(np.arange(blocks), _STEP) * (symbols + 1) + filled, minlength=blocks * (symbols + 1))
        counts = counts.reshape(blocks, symbols + 1).cumsum(axis=0)
        before = np.concatenate((np.zeros((1, symbols + 1), np.int64), counts[:-1]))
        # smaller[b, c]: symbols below c in front of block b.
        self.smaller = np.concatenate((np.zeros((blocks, 1), np.int64), before.cumsum(axis=1)), axis=1).astype(np.int32)
        self.window = filled.astype(np.uint8).reshape(blocks, _STEP)

    def mapped(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.by_symbol, symbol * (self.size + 1) + place)

    def below(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many of the first ``place`` symbols are smaller."""
        block, rest = place // _STEP, place % _STEP
        inside = (self.window[block] < symbol[:, None].astype(np.uint8)) & (np.arange(_STEP) < rest[:, None])
        return self.smaller[block, symbol] + inside.sum(axis=1)


class Index:
    """``words`` as arrays of symbols from 1 on, one after the other, with ``ends``; 0 is the delimiter."""

    def __init__(self, symbols: np.ndarray, ends: np.ndarray):
        count = len(ends) - 1
        text = np.zeros(len(symbols) + count + 1, np.int64)
        word = np.repeat(np.arange(count), np.diff(ends))
        text[np.arange(len(symbols)) + word + 1] = symbols
        self.alphabet = int(text.max()) + 1
        self.present = np.unique(text)
        self.sides = (Side(text, self.alphabet), Side(text[::-1].copy(), self.alphabet))
        # The word that begins behind the delimiter at a place of the text.
        self.word_at = np.cumsum(text == 0) - 1

    def exact(self, symbols: np.ndarray, ends: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Match whole strings symbol by symbol towards ``side`` (0: leftwards, from their last symbol, then the
        delimiter). Returns the intervals on the other side, (first rank, size), so that the search can turn."""
        own = self.sides[side]
        n = own.size
        count = len(ends) - 1
        low, other, size = np.zeros(count, np.int64), np.zeros(count, np.int64), np.full(count, n, np.int64)
        lengths = np.diff(ends)
        for step in range(int(lengths.max(initial=0)) + 1):
            at = np.flatnonzero((lengths >= step) & (size > 0))
            if not len(at):
                break
            place = ends[at + 1] - 1 - step if side == 0 else ends[at] + step
            inside = lengths[at] > step
            symbol = np.where(inside, symbols[np.where(inside, place, 0)] if len(symbols) else 0, 0)
            new, stop = own.mapped(symbol, low[at]), own.mapped(symbol, low[at] + size[at])
            other[at] += own.below(symbol, low[at] + size[at]) - own.below(symbol, low[at])
            low[at], size[at] = new, stop - new
        return other, size

    def children(self, low: np.ndarray, size: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(node, symbol, first rank, size) for every symbol that can follow a node towards ``side``."""
        own = self.sides[side]
        few = np.flatnonzero(size <= _FEW)
        node = np.repeat(few, size[few])
        within = np.arange(len(node)) - np.repeat(np.cumsum(size[few]) - size[few], size[few])
        pairs = np.unique(node * self.alphabet + own.last[low[node] + within]) if len(node) else np.empty(0, np.int64)
        many = np.flatnonzero(size > _FEW)
        tried = (np.repeat(many, len(self.present)) * self.alphabet + np.tile(self.present, len(many))).astype(np.int64)
        pairs = np.concatenate((pairs, tried))
        node, symbol = pairs // self.alphabet, pairs % self.alphabet
        new, stop = own.mapped(symbol, low[node]), own.mapped(symbol, low[node] + size[node])
        met = np.flatnonzero(stop > new)
        met = met[np.argsort(node[met], kind="stable")]
        return node[met], symbol[met], new[met], (stop - new)[met]

    def near(self, symbols: np.ndarray, ends: np.ndarray, halves: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for every indexed word that has a query's exact half and, in the rest, exactly one error.

        ``side`` is the one the search goes on to: with 1 the first ``halves`` symbols of a query are
        matched leftwards down to the delimiter and the others to the right of them; with 0 all is mirrored. Every word is reached
        once, since an error in a run of equal symbols is placed at the run's end.
        """
        starts, lengths = ends[:-1], np.diff(ends)
        part_ends = np.concatenate(([0], np.cumsum(halves)))
        within = np.arange(part_ends[-1]) - np.repeat(part_ends[:-1], halves)
        first = np.repeat(starts if side == 1 else ends[1:] - halves, halves)
        low, size = self.exact(symbols[first + within], part_ends, 1 - side)

        def symbol_at(query: np.ndarray, place: np.ndarray) -> np.ndarray:
            """The query's symbol in the order of the search; the delimiter behind its end."""
            inside = place < lengths[query]
            at = starts[query] + place if side == 1 else ends[query + 1] - 1 - place
            return np.where(inside, symbols[np.where(inside, at, 0)], 0)

        query = np.flatnonzero(size > 0)
        place, low, size = halves[query].astype(np.int64), low[query], size[query]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            # Nodes are shared by the queries that begin alike: what follows them is looked up once.
            nodes, where = np.unique(low * np.int64(self.sides[0].size + 1) + size, return_inverse=True)
            node_low, node_size = nodes // (self.sides[0].size + 1), nodes % (self.sides[0].size + 1)
            node, symbol, child_low, child_size = self.children(node_low, node_size, side)
            begin = np.searchsorted(node, np.arange(len(nodes) + 1))
            count = (begin[1:] - begin[:-1])[where]
            owner = np.repeat(np.arange(len(query)), count)
            child = np.repeat(begin[where], count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            wanted = symbol_at(query, place)
            differs = (symbol[child] != wanted[owner]) & (symbol[child] != 0)
            inside = place < lengths[query]
            replaced = np.flatnonzero(differs & inside[owner])
            added = np.flatnonzero(differs)
            dropped = np.flatnonzero(inside & (symbol_at(query, place + 1) != wanted))
            found += self._rest(
                np.concatenate((query[owner[replaced]], query[owner[added]], query[dropped])),
                np.concatenate((place[owner[replaced]] + 1, place[owner[added]], place[dropped] + 1)),
                np.concatenate((child_low[child[replaced]], child_low[child[added]], low[dropped])),
                np.concatenate((child_size[child[replaced]], child_size[child[added]], size[dropped])),
                symbol_at, lengths, side,
            )
            same = np.flatnonzero((symbol[child] == wanted[owner]) & inside[owner])
            query, place, low, size = query[owner[same]], place[owner[same]] + 1, child_low[child[same]], child_size[child[same]]
        pairs = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, np.int64)] * 2
        return pairs[0], pairs[1]

    def _rest(self, query, place, low, size, symbol_at, lengths, side) -> list[tuple[np.ndarray, np.ndarray]]:
        """After the error: match what is left of the queries and the delimiter."""
        own, found = self.sides[side], []
        while len(query):
            symbol = symbol_at(query, place)
            # A node of one suffix has one next symbol, which is known.
            live = np.flatnonzero((size > 1) | (own.last[low] == symbol))
            query, place, low, size, symbol = query[live], place[live], low[live], size[live], symbol[live]
            new, stop = own.mapped(symbol, low), own.mapped(symbol, low + size)
            done = np.flatnonzero((place == lengths[query]) & (stop > new))
            if len(done):
                at = own.places[new[done]]
                # A place in the reversed text is the last one of the match in the text.
                text_place = at if side == 0 else own.size - 1 - at
                found.append((query[done], self.word_at[text_place] - (side == 1)))
            go = np.flatnonzero((place < lengths[query]) & (stop > new))
            query, place, low, size = query[go], place[go] + 1, new[go], (stop - new)[go]
        return found
