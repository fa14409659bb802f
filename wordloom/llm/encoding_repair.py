"""Words garbled by a wrong character encoding, found and restored (problem 4).

1. Garbled words are joined with clean near-twins: words with equal ASCII characters, and gaps
   between them that agree as bytes if one is taken in an encoding of writing and the other in
   one of reading.  Each such pair aligns the characters of the gaps and votes, a vote a
   character, for the transformations (encoding it was written in, encoding it was read in)
   that turn the clean ones into the garbled ones.  A greedy cover keeps the transformations
   that explain the votes.
2. Words in which characters were lost are joined with near-twins by their ASCII characters and
   the places of the gaps; their gaps tell readings that lose characters.
3. The learned transformations are undone in all remaining words, by tables over whole batches.
   A result counts if the bigrams of the whole corpus make it far more likely than the word as
   it stands, or, where the word itself looks sound, only if the result occurs as a word.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.encodings import GRID, LOST, READ, WIDE, WRITTEN, as_points, as_texts, read_bytes, sound_words, undone, written_bytes
from wordloom.llm.points import code_points, pieces
from wordloom.llm.visual_form import consistent_form
from wordloom.runtime import materialize

#: A transformation needs so many aligned characters that no better one explains: one proves nothing.
VOTES = 2
#: Gain in log-likelihood, in nats, from which on a result counts by itself.
GAIN = 6.0
#: Steps among which other encodings than UTF-8 are undone; UTF-8 is undone any number of times.
DEPTH = 3

SYMBOLS = 1024


@lru_cache(maxsize=1)
def symbol_tables() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every code point of the plane 0: letters of Latin, Greek and Cyrillic have one
    each, the rest is told apart by kind and block, so there are fewer than SYMBOLS; and for
    each symbol the logarithm of the number of code points that share it."""
    table = np.zeros(0x10000, np.int16)
    shared = np.zeros(SYMBOLS, np.float32)
    own = [*range(0x20, 0x7F), *range(0xA1, 0x250), *range(0x370, 0x460)]
    for k, point in enumerate(own):
        table[point] = k + 1
    at = len(own) + 1
    for low, high in ((0x80, 0xA0), (0xA0, 0xA1), (0x250, 0x300), (0x300, 0x370), (0x460, 0x530), (0x530, 0x590),
                      (0x1100, 0x1200), (0x2000, 0x2010), (0x2010, 0x2030), (0x2030, 0x2070), (0x2070, 0x20A0),
                      (0x20A0, 0x2200), (0x2200, 0x2500), (0x2500, 0x2600), (0x3000, 0x3040), (0x3040, 0x30A0),
                      (0x30A0, 0x3100), (0x3400, 0xA000), (0xA000, 0xAC00), (0xAC00, 0xD7B0), (0xE000, 0xF900),
                      (0xFF00, 0xFF60), (0xFF60, 0xFFF0), (0xFFFD, 0xFFFE)):
        table[low:high] = at
        shared[at] = np.log(high - low)
        at += 1
    table[table == 0] = at
    shared[at] = np.log(0x10000)
    assert at < SYMBOLS - 1
    return table, shared


EDGE = SYMBOLS - 1


def bigram_counts(words: DataFrame) -> np.ndarray:
    """Counts of neighbouring symbols over all rows; SYMBOLS squared at most, by construction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS * SYMBOLS, np.int64)
        for batch in batches:
            for text in pieces(batch.column(0)):
                points, _, _, bounds = code_points(text)
                bounds = bounds[np.concatenate([[True], np.diff(bounds) > 0])]
                mapped = symbol_tables()[0][np.minimum(points, 0xFFFF)].astype(np.int64)
                line = np.insert(mapped, bounds, EDGE)
                total += np.bincount(line[:-1] * SYMBOLS + line[1:], minlength=len(total))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["pair", "n"])

    counted = words.select("word").where("word is not null").mapInArrow(run, "pair long, n long")
    table = np.zeros(SYMBOLS * SYMBOLS, np.float64)
    for row in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[row.pair] = row.n
    return table.reshape(SYMBOLS, SYMBOLS)


def log_chances(counts: np.ndarray) -> np.ndarray:
    """Logarithm of the chance of each symbol after each; unseen pairs back off."""
    back = (counts.sum(0) + 0.1) / (counts.sum() + 0.1 * SYMBOLS)
    weight = 2.0
    # A symbol that many code points share stands for any one of them.
    return np.log((counts + weight * back) / (counts.sum(1, keepdims=True) + weight)).astype(np.float32) - symbol_tables()[1]


def likelihoods(points: np.ndarray, bounds: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Log-likelihood of each text by its bigrams."""
    s = symbol_tables()[0][np.minimum(points, 0xFFFF)].astype(np.int64)
    s = np.insert(np.insert(s, bounds[1:], EDGE), bounds[:-1] + np.arange(len(bounds) - 1), EDGE)
    starts = bounds[:-1] + 2 * np.arange(len(bounds) - 1)
    pair = chances[s[:-1], s[1:]].astype(np.float64)
    pair[starts[1:] - 1] = 0  # from one text to the next
    return np.add.reduceat(pair, starts) if len(starts) else np.zeros(0)


def undoings(words: list[str], learned: list[tuple[str, str]], chances: np.ndarray, fine: np.ndarray) -> list[tuple[int, str, bool]]:
    """Number of the word, text and whether only UTF-8 was undone, of all texts that undoing learned
    transformations gives and that may be an original.

    A result that is unsound may be garbled still.  Undoing UTF-8 shortens a word, so it is repeated
    as long as that is so; other encodings are undone among the first DEPTH steps.  Almost any
    bytes are text in a single-byte encoding, so such a result counts only if it is sound and
    likelier than the word, and is followed only if it is no less likely than what it comes from
    and the word is not ``fine``."""
    points, bounds = as_points(words)
    base = before = likelihoods(points, bounds, chances)
    met: list[set[str]] = [{w} for w in words]
    found: list[tuple[int, str, bool]] = []
    number, strict = np.arange(len(words)), np.ones(len(words), bool)
    depth = 0
    while len(number):
        depth += 1
        following: list[tuple[int, str, bool]] = []
        torn: list[tuple[int, str, bool]] = []
        for written, read in learned:
            if written != "utf-8" and depth > DEPTH:
                continue
            for which, made, cuts, full in undone(points, bounds, written, read):
                of = number[which]
                sound = sound_words(made, cuts)
                if written == "utf-8":
                    keep, utf8 = np.ones(len(which), bool), strict[which]
                else:
                    now = likelihoods(made, cuts, chances)
                    keep = np.where(sound, now > base[of], ~fine[of] & (now >= before[which]))
                    utf8 = np.zeros(len(which), bool)
                at = np.flatnonzero(keep)
                for k, text, own, whole in zip(of[at].tolist(), as_texts(made, cuts, at), utf8[at].tolist(), sound[at].tolist()):
                    if text in met[k]:
                        continue
                    met[k].add(text)
                    if whole or written == "utf-8":
                        found.append((k, text, own))
                    if not whole:
                        (following if full and LOST not in text else torn).append((k, text, own))
        # What was undone in parts or has lost characters is followed only where nothing whole is.
        followed = {k for k, _, _ in following}
        following += [x for x in torn if x[0] not in followed]
        number = np.array([k for k, _, _ in following], np.int64)
        strict = np.array([own for _, _, own in following], bool)
        points, bounds = as_points([text for _, text, _ in following])
        before = likelihoods(points, bounds, chances)
    return found


def judge(words: list[str], fine: np.ndarray, learned: list[tuple[str, str]], chances: np.ndarray) -> list[tuple[int, str, float, bool, bool]]:
    """Possible originals of words: number of the word, text, gain in log-likelihood, whether it counts
    by itself (else only if it occurs as a word), and whether only UTF-8 was undone.  ``fine``:
    whether the word looks sound."""
    found = undoings(words, learned, chances, fine)
    if not found:
        return []
    texts = [text for _, text, _ in found]
    number, utf8 = np.array([k for k, _, _ in found]), np.array([own for _, _, own in found])
    points, bounds = as_points(texts)
    gain = likelihoods(points, bounds, chances) - likelihoods(*as_points(words), chances)[number]
    whole = sound_words(points, bounds)
    raised = sound_words(*as_points([t.upper() for t in texts]))
    lost = np.array([LOST in t for t in texts])
    short = np.array([len(t.strip()) < 2 for t in texts])
    unfit = ~fine[number]
    alone = utf8 & unfit & (raised | lost & (gain > 0))
    other = ~alone & (gain > 0) & whole
    alone |= other & (utf8 | unfit & (gain >= GAIN))
    take = np.flatnonzero((alone | other) & ~(short & ~utf8))
    return [(int(number[k]), texts[k], float(gain[k]), bool(alone[k] and not short[k]), bool(utf8[k])) for k in take]


_GAP = re.compile("[^\x00-\x7f]+")


def anchors(word: Column) -> Column:
    """Key of near-twins: the ASCII characters, with the places of the gaps between them; null where
    there are fewer than three letters."""
    key = F.regexp_replace(word, "[^\\x00-\\x7f]+", "\x00")
    return F.when(F.length(F.regexp_replace(key, "[^A-Za-z]", "")) >= 3, key)


def losses(garbled: str, clean: str) -> bool:
    """Whether some reading loses the characters of the clean word's gaps as the garbled one shows."""
    pairs = list(zip(_GAP.findall(garbled), _GAP.findall(clean)))
    for written in WRITTEN:
        for read in ("utf-8", *READ):
            try:
                if all(c.encode(written).decode(read, "replace") == g for g, c in pairs):
                    return True
            except UnicodeEncodeError:
                break
    return False


def cover(masks: Iterable[tuple[tuple[int, ...], int]], votes: int = VOTES) -> list[tuple[str, str]]:
    """The fewest transformations, taken greedily, that explain the votes; between equals the
    one earlier in GRID.  ``masks``: sets of numbers of transformations, with counts."""
    left = {m: n for m, n in masks if m}
    learned = []
    while left:
        total: dict[int, int] = {}
        for mask, n in left.items():
            for k in mask:
                total[k] = total.get(k, 0) + n
        best = max(total, key=lambda k: (total[k], -k))
        if total[best] < votes:
            break
        learned.append(GRID[best])
        left = {m: n for m, n in left.items() if best not in m}
    return learned


def _numbers(agreed: Iterable[tuple[int, int]]) -> tuple[int, ...]:
    """Numbers in GRID of all pairs of an encoding of writing and one of reading, given as flags."""
    pairs = {(w, r) for written, read in agreed for w in range(len(WRITTEN)) if written >> w & 1 for r in range(len(READ)) if read >> r & 1}
    place = {pair: k for k, pair in enumerate(GRID)}
    return tuple(sorted(place[WRITTEN[w], READ[r]] for w, r in pairs if (WRITTEN[w], READ[r]) in place))


def _mapped(words: DataFrame, make, schema: str) -> DataFrame:
    """``words`` (word and other columns) through ``make``, which gives for code points and bounds row
    numbers and further columns; ``schema``: these columns."""
    names = [*words.columns, *(c.split(" ")[0] for c in schema.split(", "))]
    place = words.columns.index("word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for text in pieces(batch.column(place)):
                part = batch.slice(at, len(text))
                at += len(text)
                points, _, _, bounds = code_points(text)
                rows, *columns = make(points, bounds)
                yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows)).columns, *(pa.array(c) for c in columns)], names)

    fields = ", ".join(f"`{n}` {t}" for n, t in words.dtypes)
    return words.mapInArrow(run, f"{fields}, {schema}")


def learn_transformations(distinct: DataFrame) -> tuple[list[tuple[str, str]], bool, DataFrame]:
    """Learned transformations, whether readings lose characters, and the clean twins of each key of
    anchors by length: key, size, twin.

    ``distinct``: word, n; all of it is read.  Of the pairs only sets of transformation numbers
    come to the driver, of which there are a few hundred, whatever the number of words.
    """
    marked = materialize(
        _mapped(
            distinct.where("word rlike '[^\\x00-\\x7f]' and length(word) > 1"),
            lambda points, bounds: (np.arange(len(bounds) - 1), sound_words(points, bounds)),
            "fine boolean",
        ).withColumn("key", anchors(F.col("word")))
    )
    # Words of one script other than Latin have no anchors, and garbled may even look sound.
    bare = "key is null and word rlike '^[^\\x00-\\x7f]*[\\u00c0-\\u024f][^\\x00-\\x7f]*$'"
    odd = marked.where(f"not fine or ({bare})").where(~F.col("word").contains(LOST)).select("word", "n")
    clean = marked.where("fine and length(word) > 2").select("word", "n")
    garbled = _mapped(odd, read_bytes, "digest long, readings long").withColumnsRenamed({"word": "garbled", "n": "m"})
    written = _mapped(clean, written_bytes, "digest long, writings long")
    pairs = garbled.join(written, "digest").where("n >= m and garbled <> word")
    gaps = F.length(F.regexp_replace("word", "[\\x00-\\x7f]", ""))
    agreed = pairs.groupBy("garbled", "word").agg(
        F.array_sort(F.collect_set(F.struct("writings", "readings"))).alias("agreed"), F.first(gaps).alias("votes")
    )
    counted = agreed.groupBy("agreed").agg(F.sum("votes").alias("votes")).collect()
    votes = [(_numbers([tuple(a) for a in r.agreed]), r.votes) for r in counted]
    twins = materialize(
        marked.where("fine and key is not null").groupBy("key", F.length("word").alias("size")).agg(F.max_by("word", F.struct("n", "word")).alias("twin"))
    )

    def lossy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [losses(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(told, pa.bool_())], ["told"])

    torn = marked.where("key is not null").where(F.col("word").contains(LOST)).join(twins, "key").select("word", "twin")
    told = torn.mapInArrow(lossy, "told boolean").where("told")
    return cover(votes), not told.isEmpty(), twins


def repair_words(words: DataFrame) -> DataFrame:
    """word_id, word and restored of every row whose word is garbled.

    ``words``: word_id (key), word; other columns are ignored.  ``restored`` is null where the
    original can't be told, as where characters were lost and no twin occurs.  Null, empty and
    one-character words and words of ASCII only are not garbled.  Repeated rows come out each;
    the corpus itself is the model, so in an empty table nothing is found.
    """
    spark = words.sparkSession
    rows = words.select("word_id", "word").where("word is not null")
    distinct = materialize(rows.groupBy("word").agg(F.count("*").alias("n")))
    chances = spark.sparkContext.broadcast(log_chances(bigram_counts(rows)))  # 4 MB, always
    learned, lossy, twins = learn_transformations(distinct)
    # Control characters that a learned reading gives for bytes.
    controls = any(read == "latin_1" or written == "utf-8" for written, read in learned)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chances.value
        for batch in batches:
            at = 0
            for text in pieces(batch.column(0)):
                own = batch.column(0).slice(at, len(text)).to_pylist()
                at += len(text)
                forms, _, _, bounds = code_points(consistent_form(text))
                fine = sound_words(forms, bounds)
                out = [
                    (w, "damaged", None, 0.0, True, False)
                    for w in own
                    if lossy and LOST in w or controls and any("\x80" <= c < "\xa0" for c in w)
                ]
                whole = [k for k, w in enumerate(own) if LOST not in w]
                judged = judge([own[k] for k in whole], fine[whole], learned, table)
                out += [(own[whole[k]], "text", t, gain, alone, utf8) for k, t, gain, alone, utf8 in judged]
                stems = {whole[k] for k, *_ in judged}
                out += [(own[k], "stem", own[k][:-1], 0.0, False, False) for k in sorted(stems) if fine[k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, schema.types)], schema=schema)

    schema = pa.schema([("garbled", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("gain", pa.float64()), ("alone", pa.bool_()), ("utf8", pa.bool_())])
    candidates = materialize(
        distinct.where("word rlike '[^\\x00-\\x7f]' and length(word) > 1")
        .select("word")
        .mapInArrow(apply, "garbled string, kind string, text string, gain double, alone boolean, utf8 boolean")
    )
    known = candidates.join(distinct.select(F.col("word").alias("text"), F.lit(True).alias("occurs")), "text", "left")
    twin = (F.col("kind") == "text") & F.col("occurs") & (F.col("utf8") | (F.length("text") > 2))
    own = (F.col("kind") == "text") & F.col("alone") & ~F.col("text").contains(LOST)
    decided = (
        known.groupBy("garbled")
        .agg(
            F.max_by("text", F.when(twin, F.col("gain"))).alias("twin"),
            F.max(F.when(twin, F.col("gain"))).alias("twin_gain"),
            F.max_by("text", F.when(own, F.col("gain"))).alias("own"),
            F.max("alone").alias("alone"),
            F.max(F.when(F.col("kind") == "stem", F.coalesce("occurs", F.lit(False)))).alias("stem"),
        )
        # A word that looks sound has to be unlike its twin; one that is another with a sign
        # at its end is that.
        .where("alone or (twin is not null and (stem is null or (twin_gain > 1.5 and not stem)))")
        .withColumn("key", F.when(F.col("garbled").contains(LOST), anchors(F.col("garbled"))))
        .withColumn("size", F.length("garbled"))
    )
    found = decided.join(twins.withColumnRenamed("twin", "by_key"), ["key", "size"], "left").select(
        F.col("garbled").alias("word"), F.coalesce("twin", "own", "by_key").alias("restored")
    )
    return rows.join(found, "word").select("word_id", "word", "restored")
