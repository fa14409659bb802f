"""Languages of documents and of passages within them (problem 8).

Sentences are compared by a blended-spectrum kernel: the share of letter n-grams (two and
three letters) that two sentences both have.  One-versus-rest kernel ridge regression on
Nyström landmarks is fitted to a bounded sample of labelled documents.  The score of a
sentence is (presence of n-grams x n-grams of landmarks) x coefficients; the second product
is taken once, and batches of sentences are multiplied with it.  Confidences are fitted to how
often a sentence left out of the fit was right at its lead of the first over the second score.
A text without a whole sentence is judged as one, with what confidence that gives; one without
a letter has no language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.points import chunks, code_points

# Names under which a label means a language.
NAMES = {
    "en": "en eng",
    "de": "de ger deu",
    "fr": "fr fre fra",
    "es": "es spa",
    "pt": "pt por",
    "zh": "zh chi zho",
}
#: Labelled documents of each language, and sentences of each, that the classifier is fitted to.
DOCUMENTS, SENTENCES, LANDMARKS = 300, 1500, 60
RIDGE = 1e-2
#: Least letters of a sentence in an alphabet, least words, and least Chinese characters.
LETTERS, WORDS, HAN = 25, 5, 7
#: Least lead of the first over the second score for a sentence to count by itself.
LEAD = 0.25
#: Longest quoted phrase, in characters.
QUOTE = 80

_EXTRA = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
_HAN, _KANA, _OTHER = 60, 61, 62
GRAMS = 1 << 19


@lru_cache(maxsize=1)
def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of each code point, 0 for what is no letter; and whether it is a capital."""
    table = np.zeros(0x110000, np.uint8)
    upper = np.zeros(0x110000, bool)
    for point in (p for p in range(0x3000) if chr(p).isalpha()):
        char = chr(point).lower()[:1]
        place = _EXTRA.find(char)
        table[point] = ord(char) - 96 if "a" <= char <= "z" else 27 + place if place >= 0 else _OTHER
        upper[point] = chr(point) != char
    table[0x3040:0x3100] = _KANA
    table[0x3400:0xA000] = _HAN
    table[0xA000:0xD800] = _OTHER
    table[0x20000:0x32000] = _HAN
    assert len(_EXTRA) + 27 <= _HAN
    return table, upper


@dataclass
class Sentences:
    """Sentences of a batch: document number, bounds in code points of the batch, how many sentences
    each stands for, and for each letter of theirs its symbol, with the sentence it is in."""

    document: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    number: np.ndarray
    symbol: np.ndarray
    owner: np.ndarray


def cut_sentences(points: np.ndarray, bounds: np.ndarray, whole: bool = True) -> Sentences:
    """The sentences that count: no headings, formulas, table rows; quoted phrases are blanked.  With
    ``whole`` a text of which none counts is one piece, which stands for as many sentences as have a
    stop and two words, maybe none."""
    table, capital = _symbols()
    n = len(points)
    plain = table[points]
    symbol = plain.copy()
    space = (points == 0x20) | (points == 0x0A) | (points == 0x0D) | (points == 0x09) | (points == 0xA0)
    following = np.append(points[1:], 0x0A)
    before = np.insert(points[:-1], 0, 0x0A)
    broken = (points == 0x0A) & (before == 0x2D)  # a word broken at the end of a line
    after = np.append(space[1:], True)[:n]
    after[bounds[1:][bounds[1:] > 0] - 1] = True
    stops = np.isin(points, [0x2E, 0x21, 0x3F]) & after
    stops |= np.isin(points, [0x3002, 0xFF01, 0xFF1F, 0xFF1B])
    ends = stops | (points == 0x0A) & ~broken
    # Marks of structure: a tag is blanked and ends what stands before it.
    opened = np.flatnonzero(points == 0x3C)
    closed = np.flatnonzero(points == 0x3E)
    _blank(symbol, opened, closed, 12)
    ends[opened] = True
    _blank(symbol, np.flatnonzero(points == 0x201E), np.flatnonzero((points == 0x201C) | (points == 0x201D)), QUOTE)
    _blank(symbol, np.flatnonzero(points == 0xAB), np.flatnonzero(points == 0xBB), QUOTE)
    starts = np.zeros(n + 1, bool)
    starts[bounds] = True
    starts[1:] |= ends
    segment = np.cumsum(starts[:n]) - 1
    count = int(segment[-1]) + 1 if n else 0
    letter = symbol > 0
    han = symbol >= _HAN
    first = letter & ~np.insert(letter[:-1], 0, False)
    letters = np.bincount(segment[letter], minlength=count)
    chinese = np.bincount(segment[han], minlength=count)
    words = np.bincount(segment[first], minlength=count)
    capitals = np.bincount(segment[letter & capital[points]], minlength=count)
    latin = letters - chinese
    good = (latin >= LETTERS) & (words >= WORDS) & (capitals < 0.5 * latin) | (chinese >= HAN)
    # Foreign names and phrases within Chinese: a character counts as about three letters.
    inside = (chinese >= HAN) & (3 * chinese >= latin)
    letter &= ~(inside[segment] & ~han) if n else letter
    begin = np.flatnonzero(starts[:n])
    end = np.append(begin[1:], n) if count else begin
    document = np.searchsorted(bounds, begin, side="right") - 1
    stands = np.ones(count, np.int64)
    if whole and count:
        seen = np.zeros(len(bounds) - 1, bool)
        seen[document[good]] = True
        spoken = np.bincount(segment[stops], minlength=count) > 0
        spoken &= ((words >= 2) & (capitals < 0.5 * latin)) | (chinese >= 2)
        # All segments of such a text become its first.
        lone = ~seen[document]
        first_of = np.searchsorted(document, document)
        stands = np.where(lone, np.bincount(document, weights=spoken, minlength=len(bounds) - 1).astype(np.int64)[document], 1)
        end = np.where(lone, bounds[1:][document], end)
        lone_at = lone[segment]
        symbol[lone_at], letter[lone_at] = plain[lone_at], plain[lone_at] > 0
        segment = np.where(lone_at, first_of[segment], segment)
        lettered = np.bincount(segment[letter], minlength=count) > 0
        good |= lone & lettered & (first_of == np.arange(count))
    number = np.cumsum(good) - 1
    begin, end, document, stands = begin[good], end[good], document[good], stands[good]
    # Runs of what is no letter become one blank; a word broken at a line's end is joined.
    drop = broken | (points == 0x2D) & (following == 0x0A)
    keep = good[segment] & (letter | np.insert(letter[:-1], 0, True)) & ~drop if n else letter
    return Sentences(document, begin, end, stands, symbol[keep], number[segment[keep]])


def _blank(symbol: np.ndarray, opened: np.ndarray, closed: np.ndarray, most: int) -> None:
    """Blanks what stands between an opening and the next closing mark, if that is near."""
    at = np.searchsorted(closed, opened)
    near = at < len(closed)
    opened, shut = opened[near], closed[at[near]]
    near = shut - opened <= most
    change = np.zeros(len(symbol) + 1, np.int32)
    np.add.at(change, opened[near], 1)
    np.add.at(change, shut[near], -1)
    symbol[np.cumsum(change)[:-1] > 0] = 0


def gram_presence(symbol: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of the presence matrix: first sentence, and row and n-gram of each entry."""
    total = int(owner[-1]) + 1 if len(owner) else 0
    step = 1 << 13
    for low in range(0, total, step):
        a, b = np.searchsorted(owner, [low, low + step])
        s, row = symbol[a:b].astype(np.uint32), (owner[a:b] - low).astype(np.uint32)
        two = row[:-1] == row[1:]
        three = row[:-2] == row[2:]
        pair = s[:-1] << 6 | s[1:]
        keys = np.concatenate([
            (row[:-1] << 19 | pair)[two],
            (row[:-2] << 19 | np.uint32(1 << 18) | pair[:-1] << 6 | s[2:])[three],
        ])
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        yield low, (keys >> 19).astype(np.int32), (keys & np.uint32(GRAMS - 1)).astype(np.int32)


@dataclass
class Classifier:
    languages: list[str]
    weights: np.ndarray  # a row for each n-gram, a column for each language
    bias: np.ndarray
    #: The logit of the confidence, as a line over the lead.
    slope: float = 6.0
    level: float = 0.0
    #: Names of the languages in labels, where they are not NAMES.
    names: dict[str, str] | None = None

    def scores(self, symbol: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
        """Scores of the sentences by language: the sparse matrix of presence times the weights."""
        out = np.zeros((count, len(self.languages)), np.float32)
        for low, row, gram in gram_presence(symbol, owner):
            if len(row):
                head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                norm = np.sqrt(np.diff(np.append(head, len(row)))).astype(np.float32)
                out[low + row[head]] = np.add.reduceat(self.weights[gram], head, axis=0) / norm[:, None]
        return out + self.bias

    def confidence(self, lead: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * lead + self.level, -50, 50)))


def leads(scores: np.ndarray) -> np.ndarray:
    """Lead of the first over the second score."""
    if scores.shape[1] < 2:
        return np.ones(len(scores))
    ordered = np.sort(scores, axis=1)
    return (ordered[:, -1] - ordered[:, -2]).astype(np.float64)


def _line(lead: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logit of being right, by logistic regression with a weak prior on what
    a lead of one gives."""
    x, beta = np.stack([lead, np.ones(len(lead))], 1), np.array([6.0, 0.0])
    prior = np.array([6.0, 0.0])
    for _ in range(25):
        chance = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        slope = x.T @ (chance - right) + 0.1 * (beta - prior)
        bend = (x * (chance * (1 - chance))[:, None]).T @ x + 0.1 * np.eye(2)
        beta = beta - np.linalg.solve(bend, slope)
    return float(max(beta[0], 0.0)), float(beta[1])


def language_of_label(label: Column, languages: dict[str, str] | None = None) -> Column:
    """The language that a label names, in any of its spellings; null for every other label.
    ``languages``: names of each language, NAMES by default."""
    plain = F.regexp_extract(F.lower(F.trim(label)), "^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    names = [(n, language) for language, all_ in (languages or NAMES).items() for n in all_.split(" ")]
    found = F.create_map(*[F.lit(x) for pair in names for x in pair])
    return F.try_element_at(found, plain)


def _sample(documents: DataFrame, languages: dict[str, str] | None) -> DataFrame:
    """At most SENTENCES sentences a language, of at most DOCUMENTS labelled documents."""
    labelled = documents.select("doc_id", language_of_label(F.col("lang"), languages).alias("label"), "text").where(
        "label is not null and text is not null"
    )
    # A bounded draw by hash first, so that no language is sorted as a whole.
    ranked = labelled.groupBy("label").agg(F.count("*").alias("documents"))
    share = F.least(F.lit(1.0), F.lit(4.0 * DOCUMENTS) / F.col("documents"))
    hash_ = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = labelled.join(F.broadcast(ranked), "label").where(hash_ < share)
    order = Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id", F.md5("text"))
    chosen = few.select("label", "doc_id", F.row_number().over(order).alias("at"), "text").where(F.col("at") <= DOCUMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = SENTENCES // DOCUMENTS
        for batch in batches:
            points, _, _, bounds = code_points(batch.column(1))
            cut = cut_sentences(points, bounds)
            # A few sentences spread over each document, whatever its length.
            first = np.searchsorted(cut.document, np.arange(len(bounds) - 1))
            size = np.diff(np.append(first, len(cut.document)))
            pick = sorted({int(f + (s * k // each + k) % s) for f, s in zip(first, size) for k in range(each) if s})
            parts = [cut.symbol[slice(*np.searchsorted(cut.owner, [p, p + 1]))].tobytes() for p in pick]
            labels = [batch.column(0)[int(cut.document[p])].as_py() for p in pick]
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(parts, pa.binary())], ["label", "symbols"])

    return chosen.select("label", "text").mapInArrow(run, "label string, symbols binary")


def fit(documents: DataFrame, languages: dict[str, str] | None = None) -> Classifier | None:
    """The classifier of a corpus, fitted to a bounded sample of its labelled documents, whose
    labels may be wrong here and there: what the first fit contradicts is left out of a second.
    Confidences come from two fits to one half each, tried on the other half; a sentence that
    contradicts its label with a clear lead is taken for a wrong label.  ``languages``: names of
    each language that labels may mean, NAMES by default.  None where no document has a label
    that names one."""
    rows = sorted((r.label, bytes(r.symbols)) for r in _sample(documents, languages).collect())
    told = sorted({label for label, _ in rows})
    if not told:
        return None
    target = np.array([told.index(label) for label, _ in rows])
    classifier = _fit([s for _, s in rows], target, told)
    classifier.names = languages
    symbols = np.frombuffer(b"".join(s for _, s in rows), np.uint8)
    owner = np.repeat(np.arange(len(rows)), [len(s) for _, s in rows])
    scores = classifier.scores(symbols, owner, len(rows))
    agree = scores.argmax(1) == target
    if len(set(target[agree])) < len(told):
        return classifier
    second = _fit([s for (_, s), good in zip(rows, agree) if good], target[agree], told)
    second.names = languages
    half = np.random.default_rng(1).permutation(len(rows)) % 2 == 0
    lead, right = [], []
    for side in (half, ~half):
        learn, tried = np.flatnonzero(agree & side), np.flatnonzero(~side)
        if len(set(target[learn])) < len(told) or not len(tried):
            return second
        own = _fit([rows[k][1] for k in learn], target[learn], told)
        parts = [rows[k][1] for k in tried]
        found = own.scores(np.frombuffer(b"".join(parts), np.uint8), np.repeat(np.arange(len(parts)), [len(p) for p in parts]), len(parts))
        lead.append(leads(found))
        right.append(found.argmax(1) == target[tried])
    ahead, good = np.concatenate(lead), np.concatenate(right)
    kept = good | (ahead < LEAD)
    second.slope, second.level = _line(ahead[kept], good[kept])
    return second


def _fit(sentences: list[bytes], target: np.ndarray, languages: list[str]) -> Classifier:
    rng = np.random.default_rng(0)
    landmarks = np.concatenate(
        [rng.permutation(np.flatnonzero(target == k))[:LANDMARKS] for k in range(len(languages))]
    )
    symbols = np.frombuffer(b"".join(sentences), np.uint8)
    owner = np.repeat(np.arange(len(sentences)), [len(s) for s in sentences])
    blocks = [(row + low, gram) for low, row, gram in gram_presence(symbols, owner)]
    row, gram = (np.concatenate(x) for x in zip(*blocks))
    norm = np.sqrt(np.maximum(np.bincount(row, minlength=len(sentences)), 1))
    # n-grams of landmarks, as a dense matrix over those that any landmark has.
    place = np.full(len(sentences), -1)
    place[landmarks] = np.arange(len(landmarks))
    of_landmark = place[row] >= 0
    grams, at = np.unique(gram[of_landmark], return_inverse=True)
    known = np.zeros((len(grams) + 1, len(landmarks)), np.float32)
    known[at, place[row[of_landmark]]] = 1
    known /= norm[landmarks]
    column = np.full(GRAMS, len(grams))
    column[grams] = np.arange(len(grams))
    kernel = np.zeros((len(sentences), len(landmarks)), np.float32)
    cuts = np.searchsorted(row, np.arange(0, len(sentences) + 512, 512))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            present = np.zeros((min(512, len(sentences) - 512 * k), len(grams) + 1), np.float32)
            present[row[a:b] - 512 * k, column[gram[a:b]]] = 1
            kernel[512 * k : 512 * k + len(present)] = present @ known
    kernel /= norm[:, None]
    inner = kernel[landmarks].astype(np.float64)
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, 1e-3 * max(values[-1], 1e-9)))
    mapped = kernel @ root
    mean = mapped.mean(0)
    wanted = np.where(target[:, None] == np.arange(len(languages)), 1.0, -1.0)
    level = wanted.mean(0)
    centred = mapped - mean
    ridge = centred.T @ centred + RIDGE * len(sentences) / len(landmarks) * np.eye(len(landmarks))
    solution = np.linalg.solve(ridge, centred.T @ (wanted - level))
    weights = np.zeros((GRAMS, len(languages)), np.float32)
    weights[grams] = known[:-1] @ (root @ solution)
    return Classifier(languages, weights, (level - mean @ solution).astype(np.float32))


@dataclass
class Passages:
    document: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    language: np.ndarray
    confidence: np.ndarray
    sentences: np.ndarray


#: Where a very long text may be cut: after a line.
BORDER = regex.compile(r"\n|[.!?]\s|[。！？]")


@dataclass
class Scored:
    """Sentences of texts, with bounds in code points of their text, the number of sentences each
    stands for, and scores by language."""

    document: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    number: np.ndarray
    scores: np.ndarray


def score_sentences(classifier: Classifier, text: pa.Array, starts: list[int]) -> Scored:
    """The sentences of a slice of texts, or of the parts of one very long text."""
    apart = len(starts) > 1 and starts[1] > 0
    # A very long text of which no part has a sentence is judged part by part.
    for whole in (False, True) if apart else (True,):
        found = []
        for k in range(len(text) if apart else 1):
            points, _, _, bounds = code_points(text.slice(k, 1) if apart else text)
            cut = cut_sentences(points, bounds, whole)
            scores = classifier.scores(cut.symbol, cut.owner, len(cut.begin))
            offset = starts[k] if apart else -bounds[cut.document]
            found.append((cut.document, cut.begin + offset, cut.end + offset, cut.number, scores))
        if any(len(x[0]) for x in found):
            break
    return Scored(*(np.concatenate(x) for x in zip(*found)))


def find_passages(cut: Scored, classifier: Classifier) -> Passages:
    """Consecutive sentences of one language.  A sentence whose lead is small goes with the one
    before it, or with the document's first that is sure."""
    count, scores = len(cut.begin), cut.scores
    language = scores.argmax(1) if count else np.zeros(0, np.int64)
    lead = leads(scores)
    sure = lead >= LEAD
    confidence = classifier.confidence(lead)
    # The last sure sentence at or before each, within its document; else the first after it.
    index = np.arange(count)
    last = np.maximum.accumulate(np.where(sure, index, -1)) if count else index
    found = (last >= 0) & (cut.document[last] == cut.document)
    nxt = np.minimum.accumulate(np.where(sure, index, count)[::-1])[::-1] if count else index
    after = (nxt < count) & (cut.document[np.minimum(nxt, count - 1)] == cut.document) if count else index > 0
    source = np.where(found, last, np.where(after, nxt, index))
    language = language[source] if count else language
    new = np.ones(count, bool)
    new[1:] = (cut.document[1:] != cut.document[:-1]) | (language[1:] != language[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, count))
    mean = np.add.reduceat(confidence, head) / size if count else confidence
    number = np.add.reduceat(cut.number, head) if count else size
    return Passages(cut.document[head], cut.begin[head], cut.end[head + size - 1] if count else head, language[head], mean, number)


_BLANK = regex.compile(r"\s*")


def with_letterless(found: Passages, text: list[str | None]) -> Passages:
    """``found`` with a passage of no language for each text that has none but is not blank."""
    seen = set(found.document.tolist())
    rest = [k for k, t in enumerate(text) if k not in seen and t and not _BLANK.fullmatch(t)]
    if not rest:
        return found
    more = np.array(rest)
    order = np.argsort(np.concatenate([found.document, more]), kind="stable")
    none = np.zeros(len(rest), np.int64)
    columns = [
        (found.document, more), (found.begin, none), (found.end, np.array([len(text[k]) for k in rest])),
        (found.language, none - 1), (found.confidence, none.astype(float)), (found.sentences, none),
    ]
    return Passages(*(np.concatenate(c)[order] for c in columns))


def _names(languages: list[str], number: np.ndarray) -> pa.Array:
    """Names of languages by number; null for -1."""
    return pa.array(languages, pa.string()).take(pa.array(np.maximum(number, 0), mask=number < 0))


def passages(documents: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, passage (from 1), begin and end (code points), lang, confidence, sentences.

    ``documents``: doc_id, text, lang; other columns are ignored.  Every text is read as a
    whole and gives a row at least; one without a letter a row of null language and confidence
    0.  Null, empty and blank texts give none.  ``sentences`` is 0 for a text of headings and
    signs only.  A repeated row gives its passages again.  Where no label names a language,
    there is no row.
    """
    columns = "passage int, begin int, end int, lang string, confidence double, sentences int"
    return _apply(documents, classifier, columns, _passage_rows)


def _passage_rows(own: Classifier, found: Passages, ids: pa.Array, labels: pa.Array) -> list:
    first = np.searchsorted(found.document, found.document)
    return [
        ids.take(pa.array(found.document)),
        pa.array(np.arange(len(first)) - first + 1, pa.int32()),
        pa.array(found.begin, pa.int32()),
        pa.array(found.end, pa.int32()),
        _names(own.languages, found.language),
        pa.array(found.confidence, pa.float64()),
        pa.array(found.sentences, pa.int32()),
    ]


def document_languages(documents: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, lang, confidence, sentences and labelled of every language of every document.

    ``labelled`` tells whether the document's label names one of its languages.  See passages().
    """
    columns = "lang string, confidence double, sentences int, labelled boolean, languages int"
    return _apply(documents, classifier, columns, _language_rows)


def _language_rows(own: Classifier, found: Passages, ids: pa.Array, labels: pa.Array) -> list:
    many = len(own.languages) + 1
    key, back = np.unique(found.document * many + found.language + 1, return_inverse=True)
    document, language = key // many, key % many - 1
    sentences = np.bincount(back, weights=found.sentences, minlength=len(key))
    share = np.maximum(found.sentences, 1e-6)
    confidence = np.bincount(back, weights=share * found.confidence, minlength=len(key)) / np.maximum(np.bincount(back, weights=share, minlength=len(key)), 1e-9)
    names = _names(own.languages, language)
    told = np.array([own.languages.index(x) if x in own.languages else -2 for x in labels.to_pylist()], np.int64)
    fits = np.zeros(len(ids), bool)
    np.logical_or.at(fits, document, told[document] == language)
    number = np.bincount(document, minlength=len(ids))
    return [
        ids.take(pa.array(document)),
        names,
        pa.array(confidence, pa.float64()),
        pa.array(sentences.astype(np.int32)),
        pa.array(fits[document]),
        pa.array(number[document].astype(np.int32)),
    ]


def _apply(documents: DataFrame, classifier: Classifier | None, columns: str, rows) -> DataFrame:
    spark = documents.sparkSession
    kind = dict(documents.dtypes)["doc_id"]
    classifier = classifier or fit(documents)
    if classifier is None:
        return spark.createDataFrame([], f"doc_id {kind}, {columns}")
    shared = spark.sparkContext.broadcast(classifier)  # a weight for each n-gram and language, always
    names = ["doc_id", *(c.split(" ")[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, text, starts in chunks(batch.column(1), BORDER):
                count = 1 if len(starts) > 1 and starts[1] > 0 else len(text)
                ids, labels = batch.column(0).slice(first, count), batch.column(2).slice(first, count)
                found = find_passages(score_sentences(own, text, starts), own)
                found = with_letterless(found, text.to_pylist() if count == len(text) else ["".join(text.to_pylist())])
                yield pa.RecordBatch.from_arrays(rows(own, found, ids, labels), names)

    taken = documents.select("doc_id", "text", language_of_label(F.col("lang"), classifier.names).alias("label"))
    return taken.mapInArrow(run, f"doc_id {kind}, {columns}")


def mislabelled_or_mixed(documents: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """doc_id, lang: the languages of the documents with sentences whose label is missing or names
    none of their languages, or that have sentences in several."""
    found = document_languages(documents, classifier)
    return found.where("sentences > 0 and (not labelled or languages > 1)").select("doc_id", "lang")
