"""Byte-level pair encoding over whole batches of text, in numpy.

Words are cut from the text by comparing the classes of neighbouring code points, equal
words are encoded once, and a word is encoded by speculation and proof: greedy longest
matches propose tokens, a compatibility check tests every adjacent pair of them, and only
the words with a failing pair are merged step by step.  A proposal whose adjacent pairs are
all compatible is what the merges would have given.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from wordloom.llm.points import code_points

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Words up to so many bytes are walked through together, step by step; of a longer one the longest
#: match is sought at every byte at once, and if a pair of it fails it is merged with a heap.
LONG_WORD = 512
#: Words met so far that a worker keeps, with 16 bytes for each.
KEPT_WORDS = 1 << 21

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of every code point, by the library that reads the pattern's classes."""
    table = np.zeros(0x110000, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    text = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for match in regex.finditer(pattern, text):
            table[points[match.start() : match.end()]] = kind
    return table


def word_starts(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether a word of the pattern begins at each code point.

    The pattern: ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
    """
    n = len(points)
    kind = class_table()[points]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white space before a word leaves its run; a blank joins the word.
    after = np.flatnonzero((kind[1:] != SPACE) & (kind[:-1] == SPACE) & ~first[1:]) + 1
    start[after - 1] = True
    start[after[points[after - 1] == 0x20]] = False
    # Contractions.
    quote = np.flatnonzero((points == 0x27) & start)
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first[quote + 1]]
    one = points[quote + 1]
    short = quote[np.isin(one, [ord(c) for c in "stmd"])]
    pair = quote[quote + 2 < n]
    pair = pair[~first[pair + 2]]
    both = points[pair + 1].astype(np.int64) << 21 | points[pair + 2]
    pair = pair[np.isin(both, [ord(a) << 21 | ord(b) for a, b in ("re", "ve", "ll")])]
    for places, length in ((short, 2), (pair, 3)):
        for k in range(1, length):
            start[places + k] = False
        ends = places + length
        start[ends[ends < n]] = True
    return start


def _windows(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; behind the end there are zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(data) + 1,), (1,))


def _chunk(windows: np.ndarray, begin: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next up to eight bytes of stretches that have ``left`` more."""
    mask = np.where(left >= 8, ~np.uint64(0), (np.uint64(1) << (left.astype(np.uint64) % 8 * 8)) - np.uint64(1))
    return windows[begin] & mask


def _keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit key for each stretch of bytes.  Up to seven bytes it is the bytes and their number;
    a longer stretch has a mixture of its length and bytes, with the top bit set, which other
    stretches may share: _same() tells."""
    windows = _windows(data)
    key = np.zeros(len(begin), np.uint64)
    small = size < 8
    key[small] = _chunk(windows, begin[small], size[small]) | size[small].astype(np.uint64) << np.uint64(56)
    todo = np.flatnonzero(~small)
    mixed = size[todo].astype(np.uint64) * _MIX
    at = 0
    while len(todo):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
        mixed = (mixed ^ (mixed >> np.uint64(32))) * _BASE + _chunk(windows, begin[todo] + at, size[todo] - at)
        at += 8
        key[todo] = (mixed ^ (mixed >> np.uint64(31))) | np.uint64(1) << np.uint64(63)
        going = size[todo] > at
        todo, mixed = todo[going], mixed[going]
    return key


def _same(one: np.ndarray, begin_one: np.ndarray, two: np.ndarray, begin_two: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether stretches of equal sizes have equal bytes."""
    windows_one, windows_two = _windows(one), _windows(two)
    same = np.ones(len(size), bool)
    todo = np.arange(len(size))
    at = 0
    while len(todo):
        left = size[todo] - at
        equal = _chunk(windows_one, begin_one[todo] + at, left) == _chunk(windows_two, begin_two[todo] + at, left)
        same[todo[~equal]] = False
        at += 8
        todo = todo[equal & (left > 8)]
    return same


class BytePairEncoder:
    """The merges of one tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        # The file writes bytes as printable characters: printable Latin-1 stands for itself,
        # the other bytes follow from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = model["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        spelled = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if all(c in byte_of for c in token)}
        self.size = max(vocab.values()) + 1
        lengths = np.array([len(spelled.get(i, b"")) for i in range(self.size)])
        self.spelling = np.frombuffer(b"".join(spelled.get(i, b"") for i in range(self.size)), np.uint8)
        self.spelling_at = np.concatenate([[0], np.cumsum(lengths)])
        self.byte_id = np.zeros(256, np.int64)
        for i, spelling in spelled.items():
            if len(spelling) == 1:
                self.byte_id[spelling[0]] = i
        self.left, self.right = np.full(self.size, -1), np.full(self.size, -1)
        self.rank = np.full(self.size, -1)
        left = np.array([vocab[a] for a, _ in merges])
        right = np.array([vocab[b] for _, b in merges])
        made = np.array([vocab[a + b] for a, b in merges])
        self.left[made[::-1]], self.right[made[::-1]] = left[::-1], right[::-1]
        self.rank[made[::-1]] = np.arange(len(merges))[::-1]
        pair = left << 20 | right
        order = np.argsort(pair, kind="stable")
        self.pair, self.pair_made, self.pair_rank = pair[order], made[order], order
        # Spellings by length, for the longest match; only what its own merges give is proposed.
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        self.byte_tables: list[tuple[int, dict[bytes, int]]] = []
        ids = np.array(sorted(spelled))
        size = np.array([len(spelled[i]) for i in ids])
        data = np.frombuffer(b"".join(spelled[i] for i in ids), np.uint8)
        word, token = self._merge(np.repeat(np.arange(len(ids)), size), self.byte_id[data])
        whole = np.bincount(word, minlength=len(ids)) == 1
        whole[word[whole[word]]] = token[whole[word]] == ids[whole]
        for length in sorted(set(size[whole].tolist()), reverse=True):
            here = ids[whole & (size == length)]
            text = np.frombuffer(b"".join(spelled[i] for i in here), np.uint8)
            keys = _keys(text, np.arange(len(here)) * length, np.full(len(here), length))
            if len(np.unique(keys)) < len(keys):  # then keys can't find them
                self.byte_tables.append((length, {spelled[i]: int(i) for i in here}))
                continue
            order = np.argsort(keys)
            self.tables.append((length, keys[order], here[order], text.reshape(-1, length)[order].ravel()))
        self._forget()

    def _forget(self) -> None:
        """Drops the words met so far."""
        self._known = np.zeros(0, np.uint64)
        self._known_at = np.zeros(0, np.int64)
        self._ids: np.ndarray = np.zeros(0, np.int32)
        self._bounds = np.zeros(1, np.int64)
        # The spellings of the words met so far.
        self._data = np.zeros(0, np.uint8)
        self._begin = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of the merge of each pair; rank is large where there is none."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.pair_rank[at], 1 << 30), np.where(hit, self.pair_made[at], -1)

    def _longest(self, data: np.ndarray, at: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token and length of the longest match at each place that has ``left`` bytes."""
        found = self.byte_id[data[at]]
        length = np.ones(len(at), np.int64)
        open_ = np.ones(len(at), bool)
        for token_size, keys, ids, spelled in self.tables:
            if token_size == 1:
                break
            here = np.flatnonzero(open_ & (left >= token_size))
            if not len(here):
                continue
            key = _keys(data, at[here], np.full(len(here), token_size))
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = np.flatnonzero(keys[spot] == key)
            if token_size > 7:
                hit = hit[_same(data, at[here[hit]], spelled, spot[hit] * token_size, np.full(len(hit), token_size))]
            found[here[hit]] = ids[spot[hit]]
            length[here[hit]] = token_size
            open_[here[hit]] = False
        for token_size, table in self.byte_tables:
            for k in np.flatnonzero((length < token_size) & (left >= token_size)):
                token = table.get(data[at[k] : at[k] + token_size].tobytes())
                if token is not None:
                    found[k], length[k] = token, token_size
        return found, length

    def _propose(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches: the words' numbers and the tokens, in order of both."""
        words, tokens, steps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        active = np.flatnonzero(size <= LONG_WORD)
        at, left = begin[active], size[active]
        step = 0
        while len(active):
            found, length = self._longest(data, at, left)
            words.append(active)
            tokens.append(found)
            steps.append(np.full(len(active), step))
            step += 1
            at, left = at + length, left - length
            keep = left > 0
            active, at, left = active[keep], at[keep], left[keep]
        for k in np.flatnonzero(size > LONG_WORD):
            n = int(size[k])
            found, length = self._longest(data, begin[k] + np.arange(n), n - np.arange(n))
            ahead, place, chain = length.tolist(), 0, []
            while place < n:
                chain.append(place)
                place += ahead[place]
            words.append(np.full(len(chain), k))
            tokens.append(found[chain])
            steps.append(np.arange(len(chain)))
        word, token, order = map(np.concatenate, (words, tokens, steps))
        by = np.lexsort((order, word))
        return word[by], token[by]

    def _compatible(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of both tokens gives just the two tokens.

        Both tokens are taken apart again, the later merge first; a merge across the border
        that would have come before what is taken apart is a contradiction.
        """
        good = np.ones(len(one), bool)
        todo = np.arange(len(one))
        a, b = one.copy(), two.copy()
        limit = np.full(len(one), 1 << 30)
        while len(todo):
            rank, _ = self._look(a, b)
            # A merge of equal rank further left comes first, so the border of the right
            # token's own merge is inclusive; that is already in the limit.
            bad = rank < limit
            good[todo[bad]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            from_left = rank_a > rank_b
            ended = np.where(from_left, rank_a, rank_b) < 0
            keep = ~bad & ~ended
            todo, a, b, rank_a, rank_b, from_left = (x[keep] for x in (todo, a, b, rank_a, rank_b, from_left))
            # Taken apart on the left, a merge across the border with the same rank loses,
            # for the left place is merged first; on the right it wins.
            limit = np.where(from_left, rank_a, rank_b + 1)
            a = np.where(from_left, self.right[a], a)
            b = np.where(from_left, b, self.left[b])
        return good

    def _merge(self, word: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging, all words at once: in each round the first best pair of each word."""
        done_word, done_token, done_at = [], [], []
        at = np.arange(len(word))
        while len(word):
            rank = np.full(len(word), 1 << 30)
            made = np.full(len(word), -1)
            if len(word) > 1:
                same = word[1:] == word[:-1]
                r, m = self._look(token[:-1], token[1:])
                rank[:-1] = np.where(same, r, 1 << 30)
                made[:-1] = m
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.concatenate([first, [len(word)]]))
            best = np.minimum.reduceat(rank, first)
            spot = np.flatnonzero(rank == np.repeat(best, size))
            _, leftmost = np.unique(word[spot], return_index=True)
            spot = spot[leftmost]
            going = best < 1 << 30
            spot = spot[going]
            token[spot] = made[spot]
            ended = np.repeat(~going, size)
            done_word.append(word[ended])
            done_token.append(token[ended])
            done_at.append(at[ended])
            keep = ~ended
            keep[spot + 1] = False
            word, token, at = word[keep], token[keep], at[keep]
        if not done_word:
            return word, token
        word, token, at = map(np.concatenate, (done_word, done_token, done_at))
        by = np.argsort(at)
        return word[by], token[by]

    def _merge_long(self, data: np.ndarray) -> np.ndarray:
        """Exact merging of one long word, with a heap of pairs."""
        import heapq

        token = self.byte_id[data].tolist()
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        rank, made = self._look(np.array(token[:-1], np.int64), np.array(token[1:], np.int64))
        heap = [(int(r), i, token[i], token[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, made)) if r < 1 << 30]
        heapq.heapify(heap)
        cache: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                pair = token[i], token[j]
                if pair not in cache:
                    r, m = self._look(np.array([pair[0]]), np.array([pair[1]]))
                    cache[pair] = int(r[0]), int(m[0])
                r, m = cache[pair]
                if r < 1 << 30:
                    heapq.heappush(heap, (r, i, pair[0], pair[1], m))

        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or token[i] != a or j >= n or token[j] != b:
                continue
            token[i], alive[j] = m, False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        return np.array([t for t, live in zip(token, alive) if live])

    def _encode_words(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, one after the other, and their bounds."""
        word, token = self._propose(data, begin, size)
        inside = word[1:] == word[:-1]
        pairs, back = np.unique(token[:-1][inside] << 20 | token[1:][inside], return_inverse=True)
        good = self._compatible(pairs >> 20, pairs & (1 << 20) - 1)[back] if len(pairs) else np.zeros(0, bool)
        wrong = np.unique(word[1:][inside][~good])
        if len(wrong):
            short = wrong[size[wrong] <= LONG_WORD]
            b, s = begin[short], size[short]
            number = np.repeat(np.arange(len(short)), s)
            place = np.arange(len(number)) - np.repeat(np.cumsum(s) - s, s) + np.repeat(b, s)
            fixed_word, fixed_token = self._merge(number, self.byte_id[data[place]])
            keep = ~np.isin(word, wrong)
            words, tokens = [word[keep], short[fixed_word]], [token[keep], fixed_token]
            for k in wrong[size[wrong] > LONG_WORD]:
                tokens.append(self._merge_long(data[begin[k] : begin[k] + size[k]]))
                words.append(np.full(len(tokens[-1]), k))
            word, token = np.concatenate(words), np.concatenate(tokens)
        by = np.argsort(word, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(begin)))])
        return token[by].astype(np.int32), bounds

    def _add(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Encodes words and keeps their ids; the words' numbers."""
        ids, bounds = self._encode_words(data, begin, size)
        number = len(self._bounds) - 1 + np.arange(len(begin))
        self._ids = np.concatenate([self._ids, ids])
        self._bounds = np.concatenate([self._bounds, self._bounds[-1] + bounds[1:]])
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - begin, size)
        self._begin = np.concatenate([self._begin, len(self._data) + np.cumsum(size) - size])
        self._size = np.concatenate([self._size, size])
        self._data = np.concatenate([self._data, data[place]])
        return number

    def _lookup(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each word among the words met so far; new ones are encoded first.  Words
        are the same only if all their bytes are."""
        keys, index, back = np.unique(_keys(data, begin, size), return_index=True, return_inverse=True)
        at = np.searchsorted(self._known, keys)
        hit = np.zeros(len(keys), bool)
        inside = at < len(self._known)
        hit[inside] = self._known[at[inside]] == keys[inside]
        new = np.flatnonzero(~hit)
        if len(new):
            number = self._add(data, begin[index[new]], size[index[new]])
            known = np.concatenate([self._known, keys[new]])
            order = np.argsort(known, kind="stable")
            self._known = known[order]
            self._known_at = np.concatenate([self._known_at, number])[order]
            at = np.searchsorted(self._known, keys)
        word = self._known_at[at][back]
        # Keys of up to seven bytes are the bytes; of longer words the bytes are compared.
        long = np.flatnonzero(size > 7)
        long_word = word[long]
        other = self._size[long_word] != size[long]
        equal = np.flatnonzero(~other)
        other[equal] = ~_same(data, begin[long[equal]], self._data, self._begin[long_word[equal]], size[long[equal]])
        apart = long[other]
        if len(apart):
            word[apart] = self._add(data, begin[apart], size[apart])
        return word

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts, one after the other, and the texts' bounds among them."""
        points, heads, data, bounds = code_points(text)
        if not len(points):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        if len(self._bounds) > KEPT_WORDS or len(self._data) > KEPT_WORDS * 16:  # they are only a cache
            self._forget()
        begin_at = np.flatnonzero(word_starts(points, bounds))
        begin = heads[begin_at]
        size = np.diff(np.concatenate([begin, [len(data)]]))
        word = self._lookup(data, begin, size)
        count = np.diff(self._bounds)[word]
        ends = np.cumsum(count)
        total = int(ends[-1])
        place = np.arange(total) - np.repeat(ends - count - self._bounds[word], count)
        words_before = np.searchsorted(begin_at, bounds)
        return self._ids[place], np.concatenate([[0], ends])[words_before]


    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts, one after the other, and the texts' bounds among them."""
        begin = self.spelling_at[ids]
        size = self.spelling_at[ids + 1] - begin
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(ends[-1]) - np.repeat(ends[:-1] - begin, size)
        return self.spelling[place], ends[bounds]


@lru_cache(maxsize=2)
def encoder(path: str) -> BytePairEncoder:
    """The encoder of a file, kept by each Python worker."""
    return BytePairEncoder(path)
