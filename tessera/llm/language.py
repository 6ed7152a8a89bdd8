"""Missing or wrong document language labels (problem 9).

A sparse multinomial logistic regression on TF-IDF weights of character
1- to 3-grams, trained by follow-the-regularised-leader with an elastic-net
penalty on a bounded sample of labelled texts, and calibrated by a temperature.
Its score is linear in the grams, so that all sentences of a batch of texts
are scored by one gather of weights and one sum per sentence.  Neighbouring
sentences of one language make a segment.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import reference_key
from . import codepoints

#: The language codes, and the letters that a passage in a further language has at least.
LANGUAGES = ("de", "en", "ja", "ko", "vi", "zh")
PASSAGE_LETTERS = 80

ORDERS, BITS = 3, 16
_SCALE = 16.0
#: A sentence with fewer letters follows its neighbours, as does a short one below the first
#: confidence and any below the second.
WEAK_LETTERS, SHORT_LETTERS, WEAK_CONFIDENCE, LEAST_CONFIDENCE = 8, 20, 0.9, 0.5
#: A run of so many letters of another script starts a sentence of its own.
SCRIPT_RUN = 25
_WIDTH = 8

_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """By character: narrow form, what shows, letter code (0: none), end marks, script class."""
    if _TABLES:
        return _TABLES
    import unicodedata

    _, lower, _, _, _, _ = codepoints.letter_folds()
    narrow = np.arange(codepoints.SIZE, dtype=np.uint32)
    shown = np.ones(codepoints.SIZE, dtype=bool)
    letter = np.zeros(codepoints.SIZE, dtype=bool)
    for c in range(0x30000):
        if 0xD800 <= c < 0xE000:
            continue
        kind = unicodedata.category(chr(c))
        letter[c] = kind[0] == "L"
        shown[c] = kind != "Cf" and not any(a <= c <= b for a, b in codepoints.UNSEEN)
        if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>")):
            narrow[c] = int(unicodedata.decomposition(chr(c)).split()[1], 16)
    code = np.where(letter, lower.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32) | np.uint64(1), 0)
    ends = np.zeros(codepoints.SIZE, dtype=np.int8)
    ends[[ord(c) for c in "\n\r\v\f\x85\u2028\u2029。！？｡|"]] = 2  # end of a sentence wherever they stand
    ends[[ord(c) for c in ".!?…/"]] = 1  # only before a blank
    script = np.zeros(codepoints.SIZE, dtype=np.int8)
    script[letter] = 1
    for a, b, kind in ((0xAC00, 0xD7A3, 2), (0x1100, 0x11FF, 2), (0x3041, 0x30FF, 3), (0x3400, 0x9FFF, 3), (0xF900, 0xFAFF, 3)):
        script[a : b + 1] = np.where(letter[a : b + 1], kind, 0)
    blank = np.zeros(codepoints.SIZE, dtype=bool)
    blank[[ord(c) for c in " \t\n\r\v\f\x85\u00a0\u2028\u2029\u3000"]] = True
    _TABLES.update(narrow=narrow, shown=shown, code=code.astype(np.uint64), ends=ends, script=script, blank=blank)
    return _TABLES


@dataclass
class Sentences:
    """Sentences of a batch: text row, place in the text, letters, and their grams."""

    row: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    letters: np.ndarray
    grams: np.ndarray  # gram bins of all sentences
    first: np.ndarray  # first gram of each sentence
    count: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))


def sentences(chars: np.ndarray, offsets: np.ndarray) -> Sentences:
    """Sentences with at least one letter, in the order of the texts."""
    t = _tables()
    chars = t["narrow"][chars]
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    base = offsets[:-1]
    chars, keep = codepoints.composer().composed(chars, offsets)
    shown = t["shown"][chars] if keep is None else t["shown"][chars] & keep
    place = np.arange(len(chars))
    if not shown.all():
        chars, rows, place = chars[shown], rows[shown], place[shown]
    if not t["code"][chars].any():
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none, none, none, none)
    ends, code = t["ends"][chars], t["code"][chars]
    before_blank = np.append(t["blank"][chars[1:]] | (rows[1:] != rows[:-1]), True)
    slash = chars == ord("/")
    after_blank = np.append(True, t["blank"][chars[:-1]])
    stop = (ends == 2) | ((ends == 1) & before_blank & (~slash | after_blank))
    opens = np.append(True, stop[:-1] | (rows[1:] != rows[:-1]))
    opens |= _script_turns(chars, code, opens, t["script"])
    unit = np.cumsum(opens) - 1
    # Letters, and one blank for whatever stands between two of them.
    is_letter = code != 0
    at = np.flatnonzero(is_letter)
    n_units = int(unit[-1]) + 1
    letters = np.bincount(unit[at], minlength=n_units)
    gap = np.append(True, (np.diff(at) > 1) | (np.diff(unit[at]) > 0))
    pos = np.arange(len(at)) + np.cumsum(gap)
    stream = np.zeros(len(at) + int(gap.sum()) + 1, dtype=np.uint64)
    owner = np.zeros(len(stream), dtype=np.int64)
    stream[pos] = code[at]
    owner[pos] = unit[at]
    blanks = pos[gap] - 1
    owner[blanks] = unit[at[gap]]
    owner[-1] = -1
    grams = _gram_bins(stream)
    ok2 = np.append(owner[1:] == owner[:-1], False)
    ok3 = np.append(ok2[1:] & ok2[:-1], False)
    real = stream != 0
    real[-1] = False
    pick = np.stack([real, ok2 & np.append(real[:-1] | real[1:], False), ok3], axis=1)
    pick[-1] = False
    bins = grams[pick]
    gram_owner = np.repeat(owner, pick.sum(axis=1))
    used = np.flatnonzero(letters)
    count = np.bincount(gram_owner, minlength=n_units)[used]
    unit_start = np.flatnonzero(opens)
    unit_stop = np.append(unit_start[1:], len(chars))
    row = rows[unit_start[used]]
    start = place[unit_start[used]] - base[row]
    finish = place[unit_stop[used] - 1] + 1 - base[row]
    return Sentences(row, start, finish, letters[used], bins, np.cumsum(count) - count, count)


def _script_turns(chars: np.ndarray, code: np.ndarray, opens: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Places where, within a sentence, a long run of letters of another script begins."""
    turns = np.zeros(len(chars), dtype=bool)
    at = np.flatnonzero(code)
    if not len(at):
        return turns
    kind = script[chars[at]]
    unit = np.cumsum(opens)[at]
    head = np.append(True, (kind[1:] != kind[:-1]) | (unit[1:] != unit[:-1]))
    run = np.flatnonzero(head)
    length = np.diff(np.append(run, len(at)))
    long = length >= SCRIPT_RUN
    run, kind, unit = run[long], kind[run[long]], unit[run[long]]
    if len(run) > 1:
        turn = (unit[1:] == unit[:-1]) & (kind[1:] != kind[:-1])
        turns[at[run[1:][turn]]] = True
    return turns


def _gram_bins(stream: np.ndarray) -> np.ndarray:
    """Bins of the 1-, 2- and 3-gram that start at each place of the stream."""
    mix, shift = np.uint64(0xBF58476D1CE4E5B9), np.uint64(64 - BITS)
    out = np.zeros((len(stream), ORDERS), dtype=np.int64)
    value = stream
    for n in range(ORDERS):
        if n:
            value = value[:-1] * np.uint64(0x100000001B3) + stream[n:]
        out[: len(value), n] = (value * mix) >> shift
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # bins x _WIDTH, IDF and scale included
    bias: np.ndarray
    temperature: float = 1.0

    def scores(self, s: Sentences) -> np.ndarray:
        """Uncalibrated scores, sentences x languages: the mean weight of a sentence's grams."""
        k = len(self.languages)
        if not len(s.first):
            return np.zeros((0, k))
        total = np.add.reduceat(self.weights[s.grams], s.first, axis=0)
        return total[:, :k] / s.count[:, None] + self.bias

    def probabilities(self, s: Sentences) -> np.ndarray:
        return _softmax(self.scores(s) / self.temperature)


def _all_sentences(texts: pa.Array) -> Sentences:
    """Sentences of many texts, made slice by slice to keep the working arrays small."""
    parts = []
    for a, b in codepoints.slices(texts, 1 << 18):
        s = sentences(*codepoints.decode(texts[a:b]))
        s.row, s.grams = s.row + a, s.grams.astype(np.int32)
        parts.append(s)
    joined = [np.concatenate([getattr(p, n) for p in parts]) for n in ("row", "start", "stop", "letters", "grams", "count")]
    row, start, stop, letters, grams, count = joined
    return Sentences(row, start, stop, letters, grams, np.cumsum(count) - count, count)


def _scores(model: Model, s: Sentences) -> np.ndarray:
    """Scores of many sentences, in blocks."""
    blocks = []
    for a in range(0, len(s.first), 4096):
        part = slice(a, a + 4096)
        first, count = s.first[part], s.count[part]
        grams = s.grams[first[0] : first[-1] + count[-1]]
        blocks.append(model.scores(Sentences(s.row[part], s.start[part], s.stop[part], s.letters[part], grams, first - first[0], count)))
    return np.concatenate(blocks)


def train(
    texts: list[str],
    labels: list[str],
    epochs: int = 2,
    batch: int = 256,
    alpha: float = 0.4,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.02,
    seed: int = 7,
) -> Model | None:
    """Model of labelled texts, or None without any letter in them.

    Nine tenths of the texts train, one tenth calibrates.  Labels may be wrong
    in part and texts mixed: after a first fit, texts and sentences whose label
    has less than a tenth of the probability are left out, of training and of
    calibration, and the model is fitted again.  Classes weigh the
    same, however frequent.
    """
    languages = tuple(sorted(set(labels)))
    if not languages or not any(texts):
        return None
    s = _all_sentences(pa.array(texts, pa.string()))
    if not len(s.first):
        return None
    target = np.array([languages.index(x) for x in labels])[s.row]
    held = (s.row * 2654435761 % 1000) < 100
    if held.all() or not held.any():
        held[:] = False
    # IDF over the sample's sentences.
    frequency = np.zeros(1 << BITS, dtype=np.int64)
    for a in range(0, len(s.first), 4096):
        count = s.count[a : a + 4096]
        grams = s.grams[s.first[a] : s.first[a] + count.sum()].astype(np.int64)
        pairs = np.unique(np.repeat(np.arange(len(count)), count) << BITS | grams)
        frequency += np.bincount(pairs & ((1 << BITS) - 1), minlength=1 << BITS)
    idf = np.log((1 + len(s.first)) / (1 + frequency))
    use = ~held
    model = None
    for fit in range(2):
        model = _fit(s, target, use, idf, languages, epochs, batch, alpha, beta, l1, l2, seed)
        if fit == 0:
            chance = _softmax(_scores(model, s))
            log_p = np.log(np.maximum(chance, 1e-9)) * s.letters[:, None]
            text = np.zeros((len(texts), len(languages)))
            np.add.at(text, s.row, log_p)
            size = np.maximum(np.bincount(s.row, weights=s.letters, minlength=len(texts)), 1)
            p = _softmax(text / size[:, None])
            own = chance[np.arange(len(target)), target]
            right = (p[s.row, target] >= 0.1) & (own >= 0.1)
            if np.isin(np.arange(len(languages)), target[use & right]).all():
                use &= right
                held &= right
    check = held if held.any() else use
    part = np.flatnonzero(check)
    z, y = _scores(model, s)[part], target[part]
    choices = np.geomspace(0.02, 5, 60)
    loss = [-np.log(np.maximum(_softmax(z / c)[np.arange(len(y)), y], 1e-12)).mean() for c in choices]
    model.temperature = float(choices[int(np.argmin(loss))])
    return model


def _fit(s, target, use, idf, languages, epochs, batch, alpha, beta, l1, l2, seed) -> Model:
    """Follow the regularised leader (proximal), per coordinate, on batches of sentences."""
    k = len(languages)
    z = np.zeros((1 << BITS, k))
    n = np.zeros((1 << BITS, k))
    bias, bias_n = np.zeros(k), np.zeros(k)
    class_size = np.bincount(target[use], minlength=k).astype(float)
    weight = np.where(class_size > 0, class_size.sum() / (k * np.maximum(class_size, 1)), 0)
    rng = np.random.default_rng(seed)
    used = np.flatnonzero(use)

    def leader(z, n):
        shrunk = np.sign(z) * l1 - z
        return np.where(np.abs(z) <= l1, 0.0, shrunk / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        rng.shuffle(used)
        for a in range(0, len(used), batch):
            part = used[a : a + batch]
            count = s.count[part]
            local = np.repeat(np.arange(len(part)), count)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            grams = s.grams[np.repeat(s.first[part], count) + inner]
            feature, back = np.unique(grams, return_inverse=True)
            value = idf[grams] * _SCALE / count[local]
            w = leader(z[feature], n[feature])
            scores = np.stack([np.bincount(local, value * w[back, c], len(part)) for c in range(k)], axis=1) + bias
            error = _softmax(scores)
            error[np.arange(len(part)), target[part]] -= 1
            error *= weight[target[part]][:, None]
            g = np.stack([np.bincount(back, value * error[local, c], len(feature)) for c in range(k)], axis=1)
            g /= np.sqrt(len(part))
            sigma = (np.sqrt(n[feature] + g * g) - np.sqrt(n[feature])) / alpha
            z[feature] += g - sigma * w
            n[feature] += g * g
            gb = error.sum(axis=0) / np.sqrt(len(part))
            bias_n += gb * gb
            bias -= 0.05 * gb / (1 + np.sqrt(bias_n))
    weights = np.zeros((1 << BITS, _WIDTH), dtype=np.float32)
    weights[:, :k] = leader(z, n) * idf[:, None] * _SCALE
    return Model(languages, weights, bias)


def label_code(label):
    """Language code that a label gives: lower case, trimmed, up to the first - or _."""
    return F.regexp_extract(reference_key(label), r"^([^-_]*)", 1)


def fit_model(
    documents: DataFrame, column: str = "text", label: str = "lang", row: str = "doc_id", max_texts: int = 4000
) -> Model | None:
    """Model from a sample of at most ``max_texts`` labelled texts, an equal part per language, chosen by a hash of their ids.

    A language with few labelled texts takes part with all of them, however
    large the corpus is; what it leaves of its part stays unused.  The bound
    keeps the sample on the driver small at any size of the corpus; it concerns
    the training only, never the texts that are labelled.
    """
    labelled = documents.select(F.col(row), F.col(column).alias("text"), label_code(label).alias("code"))
    labelled = labelled.where(F.col("code").isin(*LANGUAGES) & (F.length("text") > 0))
    part = max_texts // len(LANGUAGES)
    counts = {r["code"]: r["n"] for r in labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).collect()}
    scale = 1 << 30
    # Somewhat more than the part passes the hash, and the part's smallest hashes are taken of these.
    limit = F.lit(0)
    for code, n in sorted(counts.items()):
        limit = F.when(F.col("code") == code, F.lit(min(scale, int(scale * (part + 4 * math.sqrt(part) + 4) / n)))).otherwise(limit)
    place = F.pmod(F.xxhash64(row, F.lit("sample")), F.lit(scale))
    sample = labelled.select("text", "code", place.alias("place")).where(F.col("place") < limit).collect()
    chosen, taken = [], dict.fromkeys(counts, 0)
    for r in sorted(sample, key=lambda r: (r["place"], r["code"], r["text"])):
        if taken[r["code"]] < part:
            taken[r["code"]] += 1
            chosen.append(r)
    return train([r["text"] for r in chosen], [r["code"] for r in chosen])


def segment_batch(model: Model, chars: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of a batch: row, start, stop, language index, letters, confidence."""
    s = sentences(chars, offsets)
    if not len(s.row):
        return {}
    p = model.probabilities(s)
    best = p.argmax(axis=1)
    sure = p[np.arange(len(p)), best]
    weak = (s.letters < WEAK_LETTERS) | (sure < LEAST_CONFIDENCE)
    weak |= (s.letters < SHORT_LETTERS) & (sure < WEAK_CONFIDENCE)
    # A weak sentence follows the strong one before it, else the one after it, of the same text.
    order = np.arange(len(best))
    before = np.maximum.accumulate(np.where(weak, -1, order))
    after = np.minimum.accumulate(np.where(weak, len(best), order)[::-1])[::-1]
    near_before = (before >= 0) & (s.row[np.maximum(before, 0)] == s.row)
    last = len(best) - 1
    near_after = (after <= last) & (s.row[np.minimum(after, last)] == s.row)
    lang = np.where(near_before, best[np.maximum(before, 0)], np.where(near_after, best[np.minimum(after, last)], -1))
    lone = lang < 0
    if lone.any():  # texts without a strong sentence: the letters of all sentences decide
        rows = s.row[lone]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        total = np.add.reduceat(np.log(np.maximum(p[lone], 1e-9)) * s.letters[lone][:, None], first, axis=0)
        lang[lone] = np.repeat(total.argmax(axis=1), np.diff(np.append(first, len(rows))))
    counted = np.where(best == lang, s.letters, 0)  # a foreign name lends no letters
    head = np.append(True, (s.row[1:] != s.row[:-1]) | (lang[1:] != lang[:-1]))
    first = np.flatnonzero(head)
    stop = np.append(first[1:], len(lang)) - 1
    all_letters = np.add.reduceat(s.letters, first)
    own = p[np.arange(len(p)), lang] * s.letters
    return {
        "row": s.row[first],
        "start": s.start[first],
        "stop": s.stop[stop],
        "lang": lang[first],
        "letters": np.add.reduceat(counted, first),
        "confidence": np.add.reduceat(own, first) / all_letters,
    }


_SEGMENT = "segment_no int, seg_start int, seg_stop int, lang_code string, letters int, confidence double"


def language_segments(documents: DataFrame, model: Model | None, column: str = "text", row: str = "doc_id") -> DataFrame:
    """row, segment_no, seg_start, seg_stop, lang_code, letters, confidence: neighbouring sentences of one language.

    Places are characters of the text as stored.  Null and blank texts and
    texts without a letter have no segment; without a model none has.
    Repeated rows come out each; texts of any length are read whole.
    """
    kind = documents.schema[row].dataType.simpleString()
    schema = f"{row} {kind}, {_SEGMENT}"
    names = [row, *[x.split()[0] for x in _SEGMENT.split(", ")]]
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        codes = pa.array(model.languages)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in codepoints.slices(texts, 1 << 19):
                seg = segment_batch(model, *codepoints.decode(texts[a:b]))
                if not seg:
                    continue
                r = seg["row"]
                head = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                number = np.arange(len(r)) - np.repeat(head, np.diff(np.append(head, len(r))))
                ints = [pa.array(x.astype(np.int32)) for x in (number, seg["start"], seg["stop"])]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(r + a)), *ints, codes.take(pa.array(seg["lang"])),
                     pa.array(seg["letters"].astype(np.int32)), pa.array(seg["confidence"])],
                    names=names,
                )

    return documents.select(row, column).mapInArrow(run, schema)


def document_languages(segments: DataFrame, row: str = "doc_id", passage: int = PASSAGE_LETTERS) -> DataFrame:
    """row, lang_code, is_main, letters, longest, confidence: the languages a document is written in.

    The main language has most letters (a tie goes to the first code); any
    other counts if one of its segments has ``passage`` letters.
    """
    by = segments.groupBy(row, "lang_code").agg(
        F.sum("letters").alias("letters"),
        F.max("letters").alias("longest"),
        (F.sum(F.col("confidence") * F.col("letters")) / F.greatest(F.sum("letters"), F.lit(1))).alias("confidence"),
    )
    each = F.struct((-F.col("letters")).alias("rank"), "lang_code", "letters", "longest", "confidence")
    main = by.groupBy(row).agg(F.array_sort(F.collect_list(each)).alias("all"))  # one entry per language code
    return (
        main.select(row, F.posexplode("all").alias("place", "v"))
        .select(row, "v.lang_code", (F.col("place") == 0).alias("is_main"), "v.letters", "v.longest", "v.confidence")
        .where(F.col("is_main") | (F.col("longest") >= passage))
    )


def unlabelled_languages(
    documents: DataFrame, languages: DataFrame, label: str = "lang", row: str = "doc_id"
) -> DataFrame:
    """row, lang_code: languages a document is written in but its label does not give."""
    labels = documents.select(row, label_code(label).alias("code"))
    return (
        languages.join(labels, row)
        .where(F.coalesce(F.col("lang_code") != F.col("code"), F.lit(True)))
        .select(row, "lang_code")
        .distinct()
    )
