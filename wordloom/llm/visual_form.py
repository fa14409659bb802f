"""One consistent form for text that looks the same (problem 2).

Arrow text is copied to code-point arrays.  A lookup table expands every code point to its
decomposed, look-alike-free form (gather by expansion offsets), marks are put into canonical
order and composed run by run over the whole batch, never text by text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.points import code_points, pieces, to_text
from wordloom.runtime import materialize

# Letters of other scripts that look like the letter they stand beside.
LOOK_ALIKES = {
    "Cyrillic": "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ӏl ѵv АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЈJ ЅS ԌG ԚQ ԜW ҮY",
    "Greek": "οo νv ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX",
    "Cyrillic and Greek": "ГΓ ПΠ ФΦ",
    "Armenian": "սu հh օo ոn ցg ՕO ՏS ԼL",
    "Lisu": "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU",
    "Cherokee": "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᏔW ᏃZ",
    "Latin beside ASCII": "ɡg ɑa",
    "Kana": "へヘ",
    "Signs": "µμ",
}
#: Invisible characters that are no format characters (category Cf).
INVISIBLE = [0x034F, 0x180B, 0x180C, 0x180D, 0x180F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
HANGUL, L_BASE, V_BASE, T_BASE = 0xAC00, 0x1100, 0x1161, 0x11A7
LATIN, CYRILLIC, GREEK = 1, 2, 4
#: Code points outside of these stand for themselves: unified Han, private ones and what is unassigned.
TOLD = [(0, 0x3400), (0xA000, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)]


def _compatible(char: str) -> str | None:
    """The same look in other code points: widths, blanks, joined letters, Roman numerals."""
    tag, _, rest = unicodedata.decomposition(char).partition(" ")
    if not tag.startswith("<"):
        return None
    other = "".join(chr(int(x, 16)) for x in rest.split())
    kind = unicodedata.category(char)
    joined = len(other) > 1 and kind[0] == "L" and all(unicodedata.category(c)[0] in "LM" for c in other)
    if tag in ("<wide>", "<narrow>", "<noBreak>") or kind in ("Zs", "Nl") or tag == "<compat>" and joined:
        return other
    return None


@lru_cache(maxsize=1)
def _tables() -> dict[str, np.ndarray]:
    alike = {pair[0]: pair[1] for pairs in LOOK_ALIKES.values() for pair in pairs.split(" ")}
    replaced: dict[int, str] = {}
    combining = np.zeros(0x110000, np.uint8)
    script = np.zeros(0x110000, np.uint8)
    pairs = []
    letters = {b for b in alike.values()}
    for point in (p for low, high in TOLD for p in range(low, high)):
        if HANGUL <= point < HANGUL + 11172:
            continue
        char = chr(point)
        kind = unicodedata.category(char)
        if kind in ("Cn", "Co"):
            continue
        combining[point] = unicodedata.combining(char)
        if kind == "Cf" or point in INVISIBLE:
            replaced[point] = ""
            continue
        if kind == "Zs" or char in "\t\n\r\x0b\x0c\x85":
            replaced[point] = " "
            continue
        canonical = unicodedata.decomposition(char)
        if canonical and canonical[0] != "<" and " " in canonical and unicodedata.normalize("NFC", char) == char:
            pairs.append((*(int(x, 16) for x in canonical.split()), point))
        text = char
        for _ in range(4):
            text = "".join(alike.get(c, _compatible(c) or c) for c in unicodedata.normalize("NFD", text))
        text = unicodedata.normalize("NFD", text)
        if text != char:
            replaced[point] = text
        if kind[0] == "L" and text == char and char not in letters and point < 0x2000:
            name = unicodedata.name(char, "").split(" ")[0]
            script[point] = {"LATIN": LATIN, "CYRILLIC": CYRILLIC, "GREEK": GREEK}.get(name, 0)
    for k in range(11172):
        tail = k % 28
        replaced[HANGUL + k] = chr(L_BASE + k // 588) + chr(V_BASE + k % 588 // 28) + (chr(T_BASE + tail) if tail else "")
    size = np.ones(0x110000, np.int64)
    start = np.arange(0x110000)
    flat = [np.arange(0x110000, dtype=np.uint32)]
    at = 0x110000
    for point, text in replaced.items():
        size[point], start[point] = len(text), at
        flat.append(np.array([ord(c) for c in text], np.uint32))
        at += len(text)
    pairs.sort()
    first, second, made = (np.array(x, np.int64) for x in zip(*pairs))
    tables = {"size": size, "start": start, "flat": np.concatenate(flat), "combining": combining, "script": script}
    tables |= {"pair": first << 21 | second, "made": made}
    # Back to the script of the letters that have no look-alike.
    for name, flag in (("Cyrillic", CYRILLIC), ("Greek", GREEK)):
        back = np.arange(0x110000, dtype=np.uint32)
        for pair in reversed(LOOK_ALIKES[name].split(" ")):
            back[ord(pair[1])] = ord(pair[0])
        if flag == CYRILLIC:
            for pair in LOOK_ALIKES["Cyrillic and Greek"].split(" "):
                back[ord(pair[1])] = ord(pair[0])
        tables[f"back{flag}"] = back
    return tables


def _bounds_after(keep: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(keep)])[bounds]


def _composed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The composition of each pair, or 0."""
    t = _tables()
    key = first.astype(np.int64) << 21 | second.astype(np.int64)
    at = np.minimum(np.searchsorted(t["pair"], key), len(t["pair"]) - 1)
    made = np.where(t["pair"][at] == key, t["made"][at], 0)
    a, b = first.astype(np.int64), second.astype(np.int64)
    lead, vowel, tail = a - L_BASE, b - V_BASE, b - T_BASE
    made = np.where((lead >= 0) & (lead < 19) & (vowel >= 0) & (vowel < 21), HANGUL + (lead * 21 + vowel) * 28, made)
    open_ = (a >= HANGUL) & (a < HANGUL + 11172) & ((a - HANGUL) % 28 == 0)
    return np.where(open_ & (tail > 0) & (tail < 28), a + tail, made)


def _compose(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks in canonical order and composed, within each text."""
    t = _tables()
    n = len(points)
    if not n:
        return points, bounds
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    # Letters with letters, from the left.
    while True:
        start = t["combining"][points] == 0
        can = np.zeros(len(points), bool)
        can[:-1] = start[:-1] & start[1:] & ~first[1 : len(points)]
        spot = np.flatnonzero(can)
        made = _composed(points[spot], points[spot + 1])
        spot, made = spot[made > 0], made[made > 0]
        if not len(spot):
            break
        alone = np.concatenate([[True], np.diff(spot) > 1])
        spot, made = spot[alone], made[alone]
        points = points.copy()
        points[spot] = made
        keep = np.ones(len(points), bool)
        keep[spot + 1] = False
        points, bounds = points[keep], _bounds_after(keep, bounds)
        first = np.zeros(len(points) + 1, bool)
        first[bounds] = True
    n = len(points)
    mark = t["combining"][points]
    if not mark.any():
        return points, bounds
    begins = (mark == 0) | first[:n]
    run = np.cumsum(begins)
    order = np.argsort(run << 8 | mark, kind="stable")
    points, mark = points[order].copy(), mark[order]
    head = np.flatnonzero(begins)
    length = np.diff(np.concatenate([head, [n]]))
    keep = np.ones(n, bool)
    active = np.flatnonzero((length > 1) & (mark[head] == 0))
    last = np.zeros(len(head), np.uint8)
    step = 1
    while len(active):
        at = head[active] + step
        made = _composed(points[head[active]], points[at])
        free = (last[active] == 0) | (last[active] < mark[at])
        good = free & (made > 0)
        points[head[active[good]]] = made[good]
        keep[at[good]] = False
        last[active[~good]] = mark[at[~good]]
        step += 1
        active = active[length[active] > step]
    return points[keep], _bounds_after(keep, bounds)


def consistent_form(text: pa.Array) -> pa.Array:
    """The consistent form of every text; null stays null.

    Widths, joined letters, Roman numerals, blanks (each becomes a space; none at the ends),
    invisible characters, the order and composition of marks and look-alike letters of other
    scripts are evened out.  A text whose other letters are all Cyrillic, or all Greek, gets
    that script's letters, every other text the Latin ones.  Case, marks, superscripts,
    circled, small and subscript signs and letters of one script stay apart.
    """
    t = _tables()
    points, _, _, bounds = code_points(text)
    size = t["size"][points]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) - np.repeat(ends - size - t["start"][points], size)
    points, bounds = t["flat"][place], np.concatenate([[0], ends])[bounds]
    # Spaces at the ends.
    seen = np.flatnonzero(points != 0x20)
    low, high = np.searchsorted(seen, bounds[:-1]), np.searchsorted(seen, bounds[1:])
    keep = np.zeros(total + 1, np.int64)
    full = high > low
    np.add.at(keep, seen[low[full]], 1)
    np.add.at(keep, seen[high[full] - 1] + 1, -1)
    inside = np.cumsum(keep)[:total] > 0
    points, bounds = points[inside], _bounds_after(inside, bounds)
    # One script.
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    scripts = np.zeros(len(bounds) - 1, np.uint8)
    for flag in (LATIN, CYRILLIC, GREEK):
        scripts[row[t["script"][points] == flag]] |= flag
    for flag in (CYRILLIC, GREEK):
        points = np.where(scripts[row] == flag, t[f"back{flag}"][points], points)
    points, bounds = _compose(points, bounds)
    return to_text(points, bounds, np.asarray(text.is_valid()))


def with_form(words: DataFrame, column: str = "word", form: str = "form") -> DataFrame:
    """``words`` with the consistent form of a text column added; one pass, no shuffle."""
    names = words.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(names.index(column))
            parts = [consistent_form(p) for p in pieces(text)]
            made = pa.concat_arrays(parts) if parts else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*names, form])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(run, f"{fields}, `{form}` string")


def _formed(words: DataFrame) -> DataFrame:
    rows = words.select("word_id", "model_id", "word").where("word is not null and model_id is not null")
    return with_form(rows).where("form <> ''")


def _classes(formed: DataFrame) -> DataFrame:
    spelled = formed.groupBy("model_id", "form", "word").agg(F.count("*").alias("n"), F.min("word_id").alias("least"))
    classes = spelled.groupBy("model_id", "form").agg(
        F.count("*").alias("spellings"),
        F.sum("n").alias("rows"),
        F.max_by("least", F.struct(F.col("n"), -F.col("least"))).alias("representative"),
        F.max_by("word", F.struct(F.col("n"), -F.col("least"))).alias("word"),
    )
    return classes.where("spellings > 1")


def look_alike_classes(words: DataFrame) -> DataFrame:
    """model_id, form, spellings, rows, representative, word: the forms that a model has in several
    spellings, with the first word_id of the most frequent spelling (of equally frequent ones the
    least) and that spelling.  One row a class, however many rows it has; rows as in
    same_looking_pairs(), which are joined to it by with_form() where they are wanted.
    """
    return _classes(_formed(words))


def same_looking_pairs(words: DataFrame) -> DataFrame:
    """word_id_a < word_id_b: rows of a model whose words differ but look the same.

    ``words``: word_id (key), model_id, word; other columns are ignored.  A null word, one of
    blanks and invisible characters only, and a null model_id are in no pair; rows with equal
    words are no pair, repeated rows are rows of their own.  Only rows of look_alike_classes()
    are joined; a form that many rows share is split by Spark's skew handling.  All pairs of a
    class come out, so where the classes do, ask for those.
    """
    formed = materialize(_formed(words))
    some = formed.join(_classes(formed).select("model_id", "form"), ["model_id", "form"], "left_semi")
    a = some.select("model_id", "form", F.col("word_id").alias("word_id_a"), F.col("word").alias("word_a"))
    b = some.select("model_id", "form", F.col("word_id").alias("word_id_b"), F.col("word").alias("word_b"))
    pairs = a.join(b, ["model_id", "form"]).where("word_id_a < word_id_b and word_a <> word_b")
    return pairs.select("word_id_a", "word_id_b")
