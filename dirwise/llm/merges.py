"""Byte-pair merges in rank order over a flat array of symbols, for words of any length.

A word's symbols are places of one array, linked to their neighbours. All places whose
pair has one rank are kept together; a heap holds the ranks that are present. A round
takes the lowest rank, merges its places from left to right, and looks up only the
pairs beside the merged places, so a round costs what it merges and not the word.
"""

from __future__ import annotations

import heapq

import numpy as np

NO_RANK = np.iinfo(np.int64).max


class MergeTable:
    """``keys`` (left * base + right) in order, the rank of each pair and the symbol it becomes. Pairs may share a rank: the leftmost is merged first."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, product: np.ndarray, base: int):
        keys = left.astype(np.int64) * base + right
        order = np.argsort(keys, kind="stable")
        self.base = base
        self.keys, self.rank, self.product = keys[order], rank[order].astype(np.int64), product[order].astype(np.int64)
        # where each rank has one product, that is looked up by rank; where all pairs of a symbol come after those that make it, no merge upsets a round
        by_rank = np.full(int(rank.max()) + 1, -1)
        by_rank[rank] = product
        self.by_rank = by_rank if (by_rank[rank] == product).all() else None
        made = np.full(base, -1)
        np.maximum.at(made, product, rank)
        self.ordered = bool((rank > np.maximum(made[left], made[right])).all())

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the table and rank of each pair; pairs that aren't in it have ``NO_RANK``."""
        keys = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, keys), self.keys.size - 1)
        return at, np.where(self.keys[at] == keys, self.rank[at], NO_RANK)

    def merge_short(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols left of many words that lie one after the other, and each word's number of them.

        Every round merges, in all words at once, the places of each word's lowest rank.
        """
        word = np.repeat(np.arange(sizes.size), sizes)
        by_rank = self.by_rank
        rank = np.full(sym.size, NO_RANK)
        item = np.zeros(sym.size if by_rank is None else 0, np.int64)
        stale = np.flatnonzero(word[1:] == word[:-1])
        done_word, done_sym = [], []
        whole = (sym, sizes.cumsum() - sizes)
        odd: set[int] = set()
        lead = np.full(sizes.size, -1, np.int64)  # the rank a word merged last, where more than one place had it
        while sym.size:
            at, rank[stale] = self.find(sym[stale], sym[stale + 1])
            if by_rank is None:
                item[stale] = at
            if not self.ordered:
                odd.update(word[stale[rank[stale] <= lead[word[stale]]]].tolist())
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, word.size]))
            live = best != NO_RANK
            done_word.append(word[~live])
            done_sym.append(sym[~live])
            sym, word, rank, best = sym[live], word[live], rank[live], best[live]
            item = item[live] if by_rank is None else item
            place = np.flatnonzero(rank == best)
            if not place.size:
                break
            run = np.r_[True, np.diff(place) != 1]  # places that follow each other overlap: every second one merges
            place = place[(place - place[run][np.cumsum(run) - 1]) % 2 == 0]
            product = self.product[item[place]] if by_rank is None else by_rank[rank[place]]
            if not self.ordered:
                # merged beside the next merged place: the pair in between must not come first
                near = np.flatnonzero(np.diff(place) == 2)
                near = near[word[place[near]] == word[place[near] + 2]]
                between = self.find(product[near], sym[place[near] + 2])[1]
                odd.update(word[place[near[between <= rank[place[near]]]]].tolist())
                lead[:] = -1
                again = np.flatnonzero(word[place][1:] == word[place][:-1])
                lead[word[place][again]] = rank[place][again]
            sym[place] = product
            keep, new = np.ones(sym.size, bool), np.zeros(sym.size, bool)
            keep[place + 1] = False
            new[place] = True
            sym, word, rank, new = sym[keep], word[keep], rank[keep], new[keep]
            item = item[keep] if by_rank is None else item
            new[:-1] |= new[1:]  # the pairs that a merged symbol ends or begins
            rank[new] = NO_RANK
            stale = np.flatnonzero(new[:-1] & (word[1:] == word[:-1]))
        word, sym = np.concatenate([*done_word, word[:0]]), np.concatenate([*done_sym, sym[:0]])
        sym, counts = sym[np.argsort(word, kind="stable")], np.bincount(word, minlength=sizes.size)
        if odd:  # a merge made a pair that comes before the rest of its own round: one by one
            parts = np.split(sym, counts.cumsum()[:-1])
            for i in odd:
                parts[i] = self.merge_one(whole[0][whole[1][i] : whole[1][i] + sizes[i]])
            sym, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        return sym, counts

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols left of one word, by rounds over the ranks that are present."""
        sym = symbols.astype(np.int64)
        size = sym.size
        after, before = np.arange(1, size + 1), np.arange(-1, size - 1)
        item, rank = np.zeros(size, np.int64), np.full(size, NO_RANK)
        gone = np.zeros(size, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> int:
            """Look up the pairs that begin at ``at``; the lowest rank found."""
            item[at], found = self.find(sym[at], sym[after[at]])
            rank[at] = found
            at, found = at[found != NO_RANK], found[found != NO_RANK]
            if not at.size:
                return NO_RANK
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cut = np.flatnonzero(np.diff(found)) + 1
            for r, x in zip(found[np.r_[0, cut]].tolist(), np.split(at, cut), strict=True):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(x)
            return int(found[0])

        look(np.arange(size - 1))
        while heap:
            r = heapq.heappop(heap)
            held = places.pop(r)
            at = np.unique(np.concatenate(held))
            at = at[rank[at] == r]
            if not at.size:
                continue
            if at.size > 1:
                run = np.r_[True, after[at[:-1]] != at[1:]]
                at = at[(np.arange(at.size) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
            close = at[:-1][after[after[at[:-1]]] == at[1:]] if at.size > 1 else at[:0]
            if close.size and (self.find(self.product[item[close]], sym[after[after[close]]])[1] <= r).any():
                return self.merge_one(symbols)
            sym[at] = self.product[item[at]]
            eaten = after[at]
            gone[eaten], rank[eaten], rank[at] = True, NO_RANK, NO_RANK
            follow = after[eaten]
            after[at] = follow
            inner = follow < size
            before[follow[inner]] = at[inner]
            left = before[at]
            stale = np.unique(np.concatenate([at[inner], left[left >= 0]]))
            if look(stale) <= r and at.size > 1:
                return self.merge_one(symbols)
        return sym[~gone]

    def merge_one(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols left of one word, place by place: the lowest rank first, of equal ranks the leftmost."""
        sym = symbols.tolist()
        size = len(sym)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        item, rank = (x.tolist() for x in self.find(symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64)))
        item, rank = [*item, 0], [*rank, NO_RANK]
        heap = [(r, i) for i, r in enumerate(rank) if r != NO_RANK]
        heapq.heapify(heap)
        keys, ranks = self.keys, self.rank
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            sym[i] = int(self.product[item[i]])
            eaten = after[i]
            sym[eaten], rank[eaten], rank[i] = -1, NO_RANK, NO_RANK
            after[i] = follow = after[eaten]
            if follow < size:
                before[follow] = i
            for x in (i, before[i]):
                if x >= 0 and after[x] < size:
                    key = sym[x] * self.base + sym[after[x]]
                    at = int(np.searchsorted(keys, key))
                    hit = at < keys.size and int(keys[at]) == key
                    item[x], rank[x] = (at, int(ranks[at])) if hit else (0, NO_RANK)
                    if hit:
                        heapq.heappush(heap, (rank[x], x))
        return np.array([x for x in sym if x >= 0], np.int64)


#: Words of more symbols are merged by themselves, by rounds over ranks.
LONG = 400


def merge_words(table: MergeTable, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of all words, one after the other, and each word's number of them."""
    long = np.flatnonzero(sizes > LONG)
    if not long.size:
        return table.merge_short(sym, sizes)
    starts = sizes.cumsum() - sizes
    is_long = np.repeat(sizes > LONG, sizes)
    short, counts = table.merge_short(sym[~is_long], np.where(sizes > LONG, 0, sizes))
    parts = np.split(short, counts.cumsum()[:-1])
    for i in long:
        parts[i] = table.merge_long(sym[starts[i] : starts[i] + sizes[i]])
    return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
