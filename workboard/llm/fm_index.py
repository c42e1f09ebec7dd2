"""A bidirectional FM-index over a delimited list of words, and searches with one error.

The text is ``#w1#w2#...#wk#``. Two Burrows-Wheeler transforms, of the text and of
its reverse, hold one pattern as two suffix-rank intervals of the same size, so a
match can grow on either side. All searches run side by side in numpy arrays.
"""

from __future__ import annotations

import numpy as np

#: Symbols: 0 ends the text, 1 is the delimiter, letters follow.
STOP, DELIMITER, LETTERS = 0, 1, 2


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling; ``text`` ends in its only smallest symbol."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank * (max(int(rank.max()), n) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, bool)
        fresh[0] = False
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(fresh)
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class _Ranks:
    """How often each symbol stands before a place of a Burrows-Wheeler transform."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.order = suffix_array(text)
        last = text[self.order - 1]
        self.before = np.zeros((len(text) + 1, symbols), np.int32)
        self.before[np.arange(1, len(text) + 1), last] = 1
        np.cumsum(self.before, axis=0, out=self.before)
        total = self.before[-1].astype(np.int64)
        self.first = np.cumsum(total) - total

    def grown(self, lo: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per symbol put in front: new lower rank, size, and how far the other interval's lower rank moves."""
        start = self.before[lo]
        sizes = self.before[lo + size] - start
        return self.first + start, sizes, np.cumsum(sizes, axis=1) - sizes


class BidirectionalIndex:
    def __init__(self, words: list[str]):
        """``words``: distinct, not empty."""
        codes = [np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in words]
        lens = np.array([len(c) for c in codes], np.int64)
        letters, flat = np.unique(np.concatenate(codes), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(lens + 1)])  # of the delimiter before each word
        text = np.full(self.starts[-1] + 2, DELIMITER, np.int64)
        at = np.arange(len(flat)) + np.repeat(np.arange(len(words)), lens) + 1
        text[at] = flat + LETTERS
        text[-1] = STOP
        self.symbols = len(letters) + LETTERS
        self.ahead = _Ranks(text, self.symbols)
        self.back = _Ranks(np.concatenate([text[-2::-1], text[-1:]]), self.symbols)
        self.size = len(text)
        # The words as rows of symbols.
        self.lens = lens
        self.rows = np.zeros((len(words), int(lens.max())), np.int64)
        self.rows[np.repeat(np.arange(len(words)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat + LETTERS

    def _step(self, state, symbol, left: bool):
        """``state`` (lo, rlo, size) with a symbol (an array of them) put on one side."""
        lo, rlo, size = state
        near, far = (lo, rlo) if left else (rlo, lo)
        new, sizes, move = (self.ahead if left else self.back).grown(near, size)
        row = np.arange(len(near))
        near, far, size = new[row, symbol], far + move[row, symbol], sizes[row, symbol].astype(np.int64)
        return (near, far, size) if left else (far, near, size)

    def _branches(self, state, left: bool):
        """Every letter that can be put on one side: places in ``state``, letters, states."""
        lo, rlo, size = state
        near, far = (lo, rlo) if left else (rlo, lo)
        new, sizes, move = (self.ahead if left else self.back).grown(near, size)
        row, letter = np.nonzero(sizes[:, LETTERS:])
        letter += LETTERS
        near, far, size = new[row, letter], far[row] + move[row, letter], sizes[row, letter].astype(np.int64)
        return row, letter, (near, far, size) if left else (far, near, size)

    def near(self, words: np.ndarray, p: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, number of the word found) by one replaced or inserted letter.

        ``words`` are numbers of words. The first ``p`` and the last ``s`` letters are
        matched exactly; the letter replaced stands between them, the one inserted
        before a letter between them (or at the end if ``s`` is 0). It differs from the
        letter after it, so that each pair comes up once.
        """
        out = [self._one_side(words, p, s, left) for left in (False, True)]
        return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])

    def _one_side(self, words, p, s, left: bool):
        query = np.flatnonzero((s > 0) == left)
        if not len(query):
            return query, query
        rows, lens, p, q = self.rows[words[query]], self.lens[words[query]], p[query], (self.lens[words] - s)[query]
        many = len(query)
        # Seen from the side where the match begins: letter k, and the letters [a, b) that may hold the error.
        a, b = (lens - q, lens - p) if left else (p, q)

        def letter(i, k):
            return rows[i, lens[i] - 1 - k] if left else rows[i, k]

        state = tuple(np.full(many, v, np.int64) for v in (0, 0, self.size))
        state = self._step(state, np.full(many, DELIMITER), left)
        who = np.arange(many)
        place = np.zeros(many, np.int64)
        ending = []

        def keep(mask):
            return who[mask], place[mask], tuple(x[mask] for x in state)

        while len(who):
            inside = (place >= a[who]) & (place <= b[who])
            if inside.any():
                i, k, own = keep(inside)
                row, sym, grown = self._branches(own, left)
                i, k = i[row], k[row]
                here = np.where(k < lens[i], letter(i, np.minimum(k, lens[i] - 1)), -1)
                swap = (k < b[i]) & (sym != here)
                if left:  # the letter after the inserted one is the one matched just before
                    after = letter(i, np.maximum(k - 1, 0))
                    insert = (k > a[i]) & (sym != after)
                else:  # before letter k, or behind the last one
                    insert = (sym != here) & ((k < b[i]) | (k == lens[i]))
                for mask, more in ((swap, 1), (insert, 0)):
                    ending.append((i[mask], k[mask] + more, *(x[mask] for x in grown)))
            # An exact match goes on as long as an error can still come.
            who, place, state = keep((place < b[who]) & (place < lens[who]))
            if len(who):
                state = self._step(state, letter(who, place), left)
                place = place + 1
                who, place, state = keep(state[2] > 0)
        none = np.zeros(0, np.int64)
        who, place, *state = (np.concatenate(x) for x in zip((none,) * 5, *ending))
        found_who, found = [none], [none]
        while len(who):
            over = place == lens[who]
            symbol = np.where(over, DELIMITER, letter(who, np.minimum(place, lens[who] - 1)))
            state = self._step(tuple(state), symbol, left)
            hit = over & (state[2] > 0)
            found_who.append(who[hit])
            found.append(np.searchsorted(self.starts, self.ahead.order[state[0][hit]]))
            mask = ~over & (state[2] > 0)
            who, place, state = who[mask], place[mask] + 1, [x[mask] for x in state]
        return query[np.concatenate(found_who)], np.concatenate(found)
