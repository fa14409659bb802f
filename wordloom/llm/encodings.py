"""Encodings as tables over whole batches of words: bytes of code points and back.

A transformation is a pair (written, read): text that was written in the first encoding and read
in the second.  Undoing it takes runs of characters that the reading can have given as bytes
again.  Words are arrays of code points with bounds; a Python call is made only for words in
which a transformation was found to change something.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Encodings that text may have been written in, and in which it may have been read, by single bytes.
WRITTEN = ["utf-8", "cp1252", "cp1250", "cp1251", "cp1253", "mac_roman", "cp437", "cp850", "koi8_r", "cp866", "iso8859_5", "iso8859_7", "iso8859_2", "cp1254", "cp932", "euc_jp", "euc_kr", "cp949", "gb18030", "big5"]
READ = ["cp1252", "latin_1", "cp1250", "cp1251", "cp1253", "cp1254", "mac_roman", "cp437", "cp850", "cp866", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_7"]
WIDE = {"cp932", "euc_jp", "euc_kr", "cp949", "gb18030", "big5"}
#: Transformations by number.
GRID = [(w, r) for r in READ for w in WRITTEN if w != r]
LOST = "�"
PLANE = 0x10000


def as_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, one after the other, and the texts' bounds."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def as_texts(points: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> list[str]:
    """The texts of numbers ``which``."""
    whole = points.astype("<u4").tobytes().decode("utf-32-le", "replace")
    return [whole[a:b] for a, b in zip(bounds[which].tolist(), bounds[which + 1].tolist())]


@lru_cache(maxsize=None)
def to_byte(codec: str) -> dict[str, int]:
    """The single byte of each character that the reading gives."""
    found = {}
    for value in range(255, -1, -1):
        try:
            found[bytes([value]).decode(codec)] = value
        except UnicodeDecodeError:
            found[chr(value)] = value
    return found


@lru_cache(maxsize=None)
def byte_table(codec: str) -> np.ndarray:
    """to_byte() by code point, -1 for characters that the reading never gives."""
    table = np.full(PLANE + 1, -1, np.int16)
    for char, value in to_byte(codec).items():
        table[ord(char)] = value
    return table


@lru_cache(maxsize=None)
def point_table(codec: str) -> np.ndarray:
    """The code point of each byte in a single-byte encoding; -1 where there is no public one."""
    table = np.full(256, -1, np.int64)
    for value in range(256):
        try:
            char = bytes([value]).decode(codec)
        except UnicodeDecodeError:
            continue
        table[value] = -1 if unicodedata.category(char) in ("Cn", "Co", "Cs") else ord(char)
    return table


@lru_cache(maxsize=None)
def written_table(codec: str) -> tuple[np.ndarray, np.ndarray]:
    """Number of bytes of each code point of plane 0 in an encoding, 0 where it has none, and the bytes
    as one number, the last lowest."""
    size, value = np.zeros(PLANE + 1, np.uint8), np.zeros(PLANE + 1, np.uint32)
    points = [p for p in range(PLANE) if p != 0x0A and not 0xD800 <= p < 0xE000]
    # No encoding has a line feed within a character.
    for point, data in zip(points, "\n".join(map(chr, points)).encode(codec, "ignore").split(b"\n")):
        if 0 < len(data) <= 4:  # longer ones are made-up syllables
            size[point], value[point] = len(data), int.from_bytes(data)
    size[0x0A], value[0x0A] = 1, 0x0A
    return size, value


_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(count: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(count, _BASE, np.uint64)) if count else np.zeros(0, np.uint64)


def _digest(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """64 bits of the bytes of each stretch."""
    size = np.diff(bounds)
    place = np.arange(len(data)) - np.repeat(bounds[:-1], size)
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(int(size.max(initial=0)))[place]
    total = np.concatenate([[np.uint64(0)], np.cumsum(terms, dtype=np.uint64)])
    x = (total[bounds[1:]] - total[bounds[:-1]]) ^ (size.astype(np.uint64) << np.uint64(32))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _joined(word: list[np.ndarray], digest: list[np.ndarray], flag: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """One row for each word and digest, with the flags of all encodings that give it."""
    w, d, f = map(np.concatenate, (word, digest, flag))
    order = np.lexsort((d, w))
    w, d, f = w[order], d[order], f[order]
    if not len(w):
        return w, d.view(np.int64), f
    head = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (d[1:] != d[:-1])]))
    return w[head], d[head].view(np.int64), np.bitwise_or.reduceat(f, head)


def written_bytes(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word, digest of its bytes, and flags of the encodings WRITTEN in which these are its bytes."""
    low = np.minimum(points, PLANE)
    words, digests, flags = [], [], []
    for k, codec in enumerate(WRITTEN):
        size, value = (t[low] for t in written_table(codec))
        if codec == "utf-8":
            size[points >= PLANE] = 4  # told apart from all else by no byte that follows
        missing = np.concatenate([[0], np.cumsum(size == 0)])
        good = (missing[bounds[1:]] == missing[bounds[:-1]]) & (bounds[1:] > bounds[:-1])
        keep = np.repeat(good, np.diff(bounds))
        size, value = size[keep].astype(np.int64), value[keep]
        ends = np.cumsum(size)
        back = np.repeat(ends, size) - 1 - np.arange(ends[-1] if len(ends) else 0)
        data = np.repeat(value, size) >> (8 * back).astype(np.uint32) & np.uint32(0xFF)
        chars = np.concatenate([[0], np.cumsum(np.diff(bounds)[good])])
        found = _digest(data, np.concatenate([[0], ends])[chars])
        words.append(np.flatnonzero(good))
        digests.append(found)
        flags.append(np.full(len(found), 1 << k, np.int64))
    return _joined(words, digests, flags)


def read_bytes(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word, digest of the bytes it stands for, and flags of the readings READ that give it from them."""
    low = np.minimum(points, PLANE)
    words, digests, flags = [], [], []
    for k, codec in enumerate(READ):
        data = byte_table(codec)[low]
        missing = np.concatenate([[0], np.cumsum(data < 0)])
        good = (missing[bounds[1:]] == missing[bounds[:-1]]) & (bounds[1:] > bounds[:-1])
        kept = data[np.repeat(good, np.diff(bounds))]
        found = _digest(kept, np.concatenate([[0], np.cumsum(np.diff(bounds)[good])]))
        words.append(np.flatnonzero(good))
        digests.append(found)
        flags.append(np.full(len(found), 1 << k, np.int64))
    return _joined(words, digests, flags)


@lru_cache(maxsize=None)
def _has_sequence(read: str) -> re.Pattern:
    """A first and a following byte of UTF-8, as the reading shows them."""
    places: dict[int, str] = {v: k for k, v in to_byte(read).items()}
    shown = lambda low, high: "".join(re.escape(places[b]) for b in range(low, high) if b in places)
    return re.compile(f"[{shown(0xC2, 0xF5)}][{shown(0x80, 0xC0)}]")


def undo(word: str, written: str, read: str) -> str | None:
    """The text of which ``word`` is the reading, wholly or in its parts; None where nothing is.

    Runs of characters that the reading can have given are taken as bytes again.  Parts that
    are not what was written stay; if UTF-8 was written, sequences of which bytes are lost
    become replacement characters.
    """
    table = to_byte(read)
    if written == "utf-8" and not _has_sequence(read).search(word):
        return None
    out, changed = [], False
    at, n = 0, len(word)
    while at < n:
        end = at
        while end < n and word[end] in table:
            end += 1
        if end == at:
            out.append(word[at])
            at += 1
            continue
        run, at = word[at:end], end
        made = None
        if not run.isascii():
            data = bytes(table[c] for c in run)
            try:
                made = data.decode(written)
            except UnicodeDecodeError:
                made = _partly_utf8(data, read) if written == "utf-8" else None
        out.append(run if made is None else made)
        changed |= made is not None and made != run
    result = "".join(out)
    return result if changed and not any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in result) else None


_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}|[\xc2-\xf4][\x80-\xbf]{0,2}|[\x80-\xff]")


def _partly_utf8(data: bytes, read: str) -> str | None:
    """Valid sequences decoded, torn ones lost, the rest as it was read."""
    out, whole, at = [], 0, 0
    for match in _SEQUENCE.finditer(data):
        out.append(data[at : match.start()].decode("ascii"))
        part = match.group()
        at = match.end()
        try:
            out.append(part.decode("utf-8"))
            whole += 1
        except UnicodeDecodeError:
            out.append(LOST if len(part) > 1 else part.decode(read, "replace"))
    out.append(data[at:].decode("ascii"))
    return "".join(out) if whole else None


def _by_bytes(points: np.ndarray, bounds: np.ndarray, read: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte of each character, -1 where the reading gives none; first places of runs and the word of
    each character."""
    data = byte_table(read)[np.minimum(points, PLANE)]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = data >= 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | (owner[1:] != owner[:-1])
    return data, begins, owner


def undone(points: np.ndarray, bounds: np.ndarray, written: str, read: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """undo() of all words: numbers of those that change, with their new code points and bounds, and
    whether all runs of theirs with other characters than ASCII were what was written."""
    if not len(points):
        return
    data, begins, owner = _by_bytes(points, bounds, read)
    high = data >= 0x80
    run = np.cumsum(begins) - 1
    if written != "utf-8" and written not in WIDE:
        made = point_table(written)[np.maximum(data, 0)]
        broken = np.zeros(int(run[-1]) + 2, bool)
        broken[run[(data >= 0) & (made < 0)]] = True
        new = np.where((data >= 0) & ~broken[run], made, points)
        which = np.unique(owner[new != points])
        if len(which):
            size = bounds[which + 1] - bounds[which]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - bounds[which], size)
            yield which, new[place].astype(np.uint32), np.concatenate([[0], np.cumsum(size)]), True
        return
    raw = np.where(data >= 0, data, 0).astype(np.uint8).tobytes()
    starts = np.flatnonzero(begins)
    sizes = np.bincount(run[data >= 0], minlength=len(starts))
    some = np.bincount(run[high], minlength=len(starts)) > 0
    if written == "utf-8":
        pair = (data[:-1] >= 0xC2) & (data[:-1] <= 0xF4) & high[1:] & (data[1:] < 0xC0) & (owner[1:] == owner[:-1])
        likely = np.zeros(len(bounds) - 1, bool)
        likely[owner[:-1][pair]] = True
        some &= likely[owner[starts]]
    # Words of one run that is what was written; the others are taken one by one.
    alone = np.bincount(owner[starts], minlength=len(bounds) - 1) == 1
    text, full, parted = [], [], set()
    for start, size, word, single in zip(starts[some].tolist(), sizes[some].tolist(), owner[starts[some]].tolist(), alone[owner[starts[some]]].tolist()):
        try:
            made = raw[start : start + size].decode(written)
        except UnicodeDecodeError:
            if written == "utf-8":
                parted.add(word)
            continue
        if single and size == bounds[word + 1] - bounds[word]:
            if not any(unicodedata.category(c) in ("Cn", "Co", "Cs") for c in made):
                text.append(made)
                full.append(word)
        else:
            parted.add(word)
    if full:
        yield np.array(full), *as_points(text), True
    which = np.array(sorted(parted), np.int64)
    if len(which):
        texts = [undo(t, written, read) for t in as_texts(points, bounds, which)]
        good = [k for k, t in enumerate(texts) if t is not None]
        if good:
            yield which[good], *as_points([texts[k] for k in good]), False


# Whether a text looks like a word.
LIMIT = 0x20000
_LETTER, _SKIP, _MARK, _SIGN, _BAD = 1, 2, 4, 8, 16


@lru_cache(maxsize=1)
def _looks() -> tuple[np.ndarray, ...]:
    """Kind, script, upper and lower case of every code point below LIMIT, which stands for the rest."""
    kind, script = np.zeros(LIMIT + 1, np.uint8), np.zeros(LIMIT + 1, np.uint8)
    upper, lower, edge = (np.zeros(LIMIT + 1, bool) for _ in range(3))
    scripts: dict[str, int] = {"LATIN": 1, "CJK": 2}
    for point in range(LIMIT):
        char = chr(point)
        category = unicodedata.category(char)
        upper[point], lower[point] = char.isupper(), char.islower()
        edge[point] = point in (0x20, 0xA0, 0x3000)
        name = unicodedata.name(char, "?").split(" ")[0] if category[0] in "LM" else ""
        number = scripts.setdefault(name, len(scripts) + 1) if name else 0
        if point < 0x80:
            kind[point], script[point] = (_LETTER, 1) if char.isalpha() else (0, 0)
        elif category[0] == "L" and category != "Lm" and char not in "\xaa\xba":
            kind[point], script[point] = _LETTER, number
        elif category in ("Cf", "Zs") or 0x300 <= point < 0x370 or char in "゙゚":
            kind[point] = _SKIP
        elif category[0] == "M":
            kind[point], script[point] = _MARK, number
        elif category[0] == "N" or char == "ー":
            kind[point] = _SKIP
        else:
            kind[point] = _BAD if category == "Cc" or char == LOST else _SIGN
    kind[LIMIT], script[LIMIT] = _LETTER, 2
    assert len(scripts) < 255
    return kind, script, upper, lower, edge


def sound_words(points: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Whether each text looks like a word: letters of one script (marks, digits, a sign at the end
    and the usual joints besides), capitals only in front or throughout."""
    kinds, scripts, uppers, lowers, edges = _looks()
    count = len(bounds) - 1
    good = np.ones(count, bool)
    if not len(points):
        return good
    low = np.minimum(points, LIMIT)
    kind, script, upper, lower = kinds[low], scripts[low], uppers[low], lowers[low]
    owner = np.repeat(np.arange(count), np.diff(bounds))
    # Blanks at the ends don't count.
    inner = np.flatnonzero(~edges[low])
    last = np.searchsorted(inner, bounds[1:]) - 1
    ends = np.full(count, -1)
    ends[last >= 0] = inner[last[last >= 0]]
    good[owner[(kind == _BAD) | (kind == _SIGN) & (np.arange(len(points)) != ends[owner])]] = False
    some = script > 0
    least, most = np.full(count, 255, np.uint8), np.zeros(count, np.uint8)
    np.minimum.at(least, owner[some], script[some])
    np.maximum.at(most, owner[some], script[some])
    good[most > least] = False
    cased = (upper | lower) & (kind == _LETTER)
    capital = upper & cased
    first = np.zeros(len(points), bool)
    at = np.flatnonzero(cased)
    first[at[np.concatenate([[True], owner[at][1:] != owner[at][:-1]])[: len(at)]]] = True
    cases = np.bincount(owner[cased], minlength=count)
    later = np.bincount(owner[capital & ~first], minlength=count) > 0
    small = np.bincount(owner[cased & ~upper & (points != 0xDF)], minlength=count) > 0
    risen = np.zeros(count, bool)
    risen[owner[:-1][lower[:-1] & upper[1:] & (owner[1:] == owner[:-1])]] = True
    good[(cases > 2) & later & small & risen] = False
    return good


def sound(word: str) -> bool:
    """sound_words() of one word."""
    return bool(sound_words(*as_points([word]))[0])
