"""Quality classifier: a weak-label model and a hashed linear scorer.

Heuristic labellers vote on every document (bad, good or nothing); they overlap and err. Expectation-maximisation over
the counts of vote patterns of all documents estimates how often each labeller votes what for bad and for good
documents, and so each pattern's posterior. A linear scorer over hashed words, word stems and style marks is trained on
documents with these posteriors as labels, and then scores all documents. There are two such models, one for low
quality and one for toxic language, since their labellers say nothing about each other's question.

The model is semi-supervised: where annotators have labelled documents, they are one more labeller, which is taken to
call a good text bad next to never; one labeller's word list is learned from labelled toxic documents; and thresholds
spare what annotators call clean. Without any labels the heuristics alone are fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm.common import Remembered, least_hashed, rows_of, saved, table, without, words_of

BUCKETS = 1 << 18
#: Bounds of what is fitted on: labelled rows for stems, stems, rows of each class for a scorer.
LABELLED, STEMS, PER_CLASS = 8_000, 2_000, 2_000
#: Bytes of features of these rows that the driver holds at once for a scorer: rows with the least hash of their id first.
FEATURE_BYTES = 256 << 20
#: Share of annotated clean documents that each threshold spares.
SPARED = 0.999
REMEMBERED_WORDS = 300_000
ENDS = ".,;:!?%#*$&|<>\"'()"
SYMBOLS, CAPITALS = b"#*$%&|<>", bytes(range(65, 91))
#: Plain English insults. One labeller has them all: two with parts of them would agree more than the model assumes.
INSULTS = frozenset("idiot loser moron scum trash dumb jerk clown disgusting pathetic stupid worthless imbecile filth".split())
NOTHING, GOOD, BAD = 0, 1, 2
#: Value of a style feature.
STYLE_WEIGHT = 1.0
#: Sums over the distinct words are divided by this power of their number.
LENGTH_POWER = 0.25
#: Upper bound of how often an annotator calls a good text bad.
ANNOTATOR_ERROR = 0.002
#: Letters of a word's stems.
STEM_LETTERS = (4, 5, 6, 7, 8)
#: Rows that must have a feature for it to have a weight.
MIN_ROWS = 5


def distinct_words(text: str) -> set[str]:
    """In lower case, with their marks; parted by ASCII white space."""
    return {w.decode("utf-8", "surrogatepass") for w in text.lower().encode("utf-8", "surrogatepass").split()}


def stems(word: str) -> list[str]:
    return [word[:n] + "*" for n in STEM_LETTERS if len(word) > n]


def style(text: str) -> tuple[float, ...]:
    """Shares of symbols, capitals, marks per word, bars per word, words like the word before and repeated words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    size, n = max(1, len(raw)), max(1, len(words))
    return (
        (len(raw) - len(raw.translate(None, SYMBOLS))) / size,
        (len(raw) - len(raw.translate(None, CAPITALS))) / size,
        (raw.count(b"!") + raw.count(b"?")) / n,
        raw.count(b"|") / n,
        sum(map(eq, words, words[1:])) / n,
        1.0 - len(set(words)) / n if len(words) >= 20 else 0.0,
    )


#: For each share of style(): above the second a labeller of its own votes bad, else nothing, as a text can be bad in one
#: way alone; one more votes good where all are at or below the first.
QUALITY_LABELLERS = ((0.01, 0.04), (0.12, 0.35), (0.1, 0.5), (0.02, 0.2), (0.05, 0.2), (0.6, 0.9))
STYLE_STEPS = (0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def quality_votes(shares: tuple[float, ...]) -> list[int]:
    pairs = list(zip(shares, QUALITY_LABELLERS, strict=True))
    return [BAD if s > high else NOTHING for s, (_, high) in pairs] + [GOOD if all(s <= low for s, (low, _) in pairs) else NOTHING]


_ENDS, _INSULTS = ENDS.encode(), frozenset(w.encode() for w in INSULTS)
_BLANKS = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")


def _distinct(x: np.ndarray) -> np.ndarray:
    """np.unique, which for many different numbers is faster by sorting."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


class Texts:
    """Many texts at once: their distinct words in lower case, which text has which, and each text's style().

    row and word: pairs of a text and one of its distinct words; n_words: of these for each text.
    """

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass").translate(_BLANKS) for t in texts]
        words, place, ends = words_of(raw)
        full = np.fromiter(map(len, words), np.int64, len(words))[place] > 0
        place, ends = place[full].astype(np.int64), np.r_[0, np.cumsum(full)][ends]
        row = np.repeat(np.arange(len(texts)), np.diff(ends))
        small = [w.lower() if w.isascii() else w.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass") for w in words]
        number = {w: k for k, w in enumerate(dict.fromkeys(small))}
        lower = np.fromiter(map(number.__getitem__, small), np.int64, len(words))
        self.words = list(number)
        count = max(1, len(words))
        own = _distinct(row * count + lower[place])
        self.row, self.word = own // count, own % count
        self.n_words = np.bincount(self.row, minlength=len(texts))
        n = np.maximum(1, np.diff(ends))
        distinct = np.bincount(_distinct(row * count + place) // count, minlength=len(texts))
        again = np.bincount(row[1:][(row[1:] == row[:-1]) & (place[1:] == place[:-1])], minlength=len(texts))
        of = lambda f: np.fromiter(map(f, raw), np.int64, len(raw))
        size = np.maximum(1, of(len))
        self.shares = np.stack(
            [
                of(lambda x: len(x) - len(x.translate(None, SYMBOLS))) / size,
                of(lambda x: len(x) - len(x.translate(None, CAPITALS))) / size,
                of(lambda x: x.count(b"!") + x.count(b"?")) / n,
                of(lambda x: x.count(b"|")) / n,
                again / n,
                np.where(n >= 20, 1.0 - distinct / n, 0.0),
            ],
            axis=1,
        )

    def sums(self, of_word: np.ndarray) -> np.ndarray:
        """For each text the sum over its distinct words."""
        return np.bincount(self.row, weights=of_word[self.word], minlength=len(self.n_words))

    def quality_votes(self) -> np.ndarray:
        low, high = np.array(QUALITY_LABELLERS).T
        bad = np.where(self.shares > high, BAD, NOTHING)
        return np.concatenate([bad, np.where((self.shares <= low).all(axis=1), GOOD, NOTHING)[:, None]], axis=1)

    def toxic_votes(self, marks: WordMarks) -> np.ndarray:
        found = np.fromiter(map(marks.__getitem__, self.words), np.int64, len(self.words))
        hits = self.sums(found >> 40)
        return np.stack([np.where(self.sums(found % (1 << 40)) > 0, BAD, NOTHING), np.where(hits >= 2, BAD, np.where(hits > 0, NOTHING, GOOD))], axis=1)


def _digits(votes_: np.ndarray) -> pa.Array:
    text = (votes_ + 48).astype(np.uint8).tobytes().decode()
    n = votes_.shape[1]
    return pa.array([text[k : k + n] for k in range(0, len(text), n)], pa.string())


class WordMarks(Remembered):
    """For each word in lower case (as bytes), as one number: whether it is an insult, and whether it or a stem of it is in the toxic list."""

    def __init__(self, toxic_stems: frozenset[str]):
        super().__init__(REMEMBERED_WORDS)
        self.toxic_stems, self.stems = toxic_stems, {s.encode("utf-8", "surrogatepass") for s in toxic_stems}

    def __missing__(self, word: bytes) -> int:
        if not self.known(word):
            self.make_room()
            if word.isascii():
                bare = word.strip(_ENDS)
                marked = bare in self.stems or not self.stems.isdisjoint([bare[:n] + b"*" for n in STEM_LETTERS if len(bare) > n])
                self[word] = (bare in _INSULTS) + (marked << 40)
                return self[word]
            bare = word.decode("utf-8", "surrogatepass").strip(ENDS)
            self[word] = (bare in INSULTS) + ((not self.toxic_stems.isdisjoint([bare, *stems(bare)])) << 40)
        return self[word]


def toxic_votes(words: set[str], marks: WordMarks) -> list[int]:
    n = sum([marks[w.encode("utf-8", "surrogatepass")] for w in words])
    hits = n >> 40
    return [BAD if n % (1 << 40) else NOTHING, BAD if hits >= 2 else NOTHING if hits else GOOD]


def bucket(name: str) -> int:
    return crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


def word_features(word: str) -> list[int]:
    """Buckets of the word without its marks, and of its stems."""
    bare = word.strip(ENDS)
    return [bucket(bare), *map(bucket, stems(bare))]


def features(text: str) -> list[int]:
    """The number of distinct words, then the buckets of these and their stems."""
    words = distinct_words(text)
    return [len(words), *sorted(b for w in words for b in word_features(w))]


def style_features(shares: tuple[float, ...], votes: list[int]) -> list[int]:
    """Buckets of the steps that the shares reach and of the text's toxic votes."""
    return [bucket(f"style {k} {sum(s > x for x in STYLE_STEPS)}") for k, s in enumerate(shares)] + [bucket(f"vote {k} {v}") for k, v in enumerate(votes)]


class WordScores(Remembered):
    """For each word in lower case (as bytes) the sums of its features' weights of both models, as one complex number."""

    def __init__(self, weights: np.ndarray):
        super().__init__(REMEMBERED_WORDS)
        self.weights = [complex(q, t) for q, t in weights.tolist()]

    def __missing__(self, word: bytes) -> complex:
        if not self.known(word):
            self.make_room()
            w = self.weights
            if word.isascii():  # word_features() of letters of one byte
                bare = word.strip(_ENDS)
                self[word] = sum([w[crc32(bare[:n] + b"*") % BUCKETS] for n in STEM_LETTERS if len(bare) > n], w[crc32(bare) % BUCKETS])
            else:
                self[word] = sum([w[b] for b in word_features(word.decode("utf-8", "surrogatepass"))], 0j)
        return self[word]

    def of(self, buckets: list[int]) -> complex:
        return sum([self.weights[b] for b in buckets], 0j)


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """votes: a row per pattern, of votes by labeller; counts: documents of each. Gives P(bad) of each pattern, and
    P(vote | bad or not) as (labeller, not bad or bad, vote). Starts from the votes' majority."""
    bad, good = (votes == BAD).sum(axis=1), (votes == GOOD).sum(axis=1)
    p = np.where(bad > 0, 0.5 + 0.45 * np.minimum(1, bad / np.maximum(1, good)), 0.02)
    table_ = np.zeros((votes.shape[1], 2, 3))
    for _ in range(rounds):
        w = np.stack([(1 - p) * counts, p * counts], axis=1)
        for j in range(votes.shape[1]):
            for v in (NOTHING, GOOD, BAD):
                table_[j, :, v] = w[votes[:, j] == v].sum(axis=0)
        table_ += np.array([[1.0, 1.0, 0.1], [1.0, 0.1, 1.0]])  # a labeller is right more often than wrong
        share = table_ / table_.sum(axis=2, keepdims=True)
        said = share[-1, 0, GOOD] + share[-1, 0, BAD]  # annotators come last, and seldom call a good text bad
        share[-1, 0, BAD] = min(share[-1, 0, BAD], ANNOTATOR_ERROR * said)
        share[-1, 0, GOOD] = said - share[-1, 0, BAD]
        prior = np.clip(w.sum(axis=0) / w.sum(), 1e-4, 1)
        log = np.log(prior) + sum(np.log(share[j][:, votes[:, j]]).T for j in range(votes.shape[1]))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        table_[:] = 0
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return new, share


@dataclass
class Scorer:
    """weights: BUCKETS of the text's features and the style's; a score above threshold rejects."""

    weights: np.ndarray
    bias: float
    threshold: float


def train_scorer(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, rounds: int = 250, ridge: float = 1e-5) -> Scorer:
    """Logistic regression. rows: features() and style_features(); label: P(bad) of each row."""
    if not rows or label.min() > 0.5 or label.max() < 0.5:
        return Scorer(np.zeros(BUCKETS, np.float32), -1.0, 0.0)
    index = [np.concatenate([t[1:], s]) for t, s in rows]
    value = np.concatenate([np.r_[np.full(len(t) - 1, max(1, t[0]) ** -LENGTH_POWER, np.float32), np.full(len(s), STYLE_WEIGHT, np.float32)] for t, s in rows])
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in index])
    seen = np.bincount(np.concatenate([np.unique(x) for x in index]), minlength=BUCKETS)
    index = np.concatenate(index)
    kept = seen[index] >= MIN_ROWS  # what few rows have tells these rows apart, not the classes
    index, value, row = index[kept], value[kept], row[kept]
    use = np.where(label > 0.5, 0.5 / max(1, (label > 0.5).sum()), 0.5 / max(1, (label <= 0.5).sum()))
    # Gradient descent with momentum, whose step is from the largest curvature: what many rows say weighs first.
    v = np.ones(BUCKETS)
    for _ in range(8):
        v /= np.linalg.norm(v)
        v = np.bincount(index, weights=value * (np.bincount(row, weights=v[index] * value, minlength=len(rows)) * use)[row], minlength=BUCKETS)
    step = 1 / (0.25 * (1.2 * np.linalg.norm(v) + 1) + ridge)
    w = ahead = np.zeros(BUCKETS)
    b = ahead_b = 0.0
    for k in range(rounds):
        score = np.bincount(row, weights=ahead[index] * value, minlength=len(rows)) + ahead_b
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - label) * use
        new = ahead - step * (np.bincount(index, weights=value * error[row], minlength=BUCKETS) + ridge * ahead)
        new_b = ahead_b - step * error.sum()
        ahead, ahead_b = new + k / (k + 3) * (new - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new, new_b
    return Scorer(w.astype(np.float32), float(b), 0.0)


def _sampled(rows: DataFrame, per_class: int, cls: Column) -> DataFrame:
    """doc_id, cls: of each class of 0, 1, ... those per_class ids with the least hash; so a bounded number of rows."""
    out = None
    for k in (0, 1):
        x = least_hashed(rows.where(cls == k).select("doc_id", F.lit(k).alias("cls")), per_class, "doc_id")
        out = x if out is None else out.unionByName(x)
    return out.groupBy("doc_id").agg(F.max("cls").alias("cls"))


def toxic_stems(docs: DataFrame, labels: DataFrame) -> frozenset[str]:
    """Words and stems in labelled toxic documents and next to never in others, and in so many that chance alone gives
    one in ten million: a labeller's word list. Fitted on at most LABELLED labelled rows; at most STEMS entries."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = saved(_sampled(known, LABELLED // 2, F.col("toxic")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in rows_of(batch, 200):
                found = []
                for t, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = {w.strip(ENDS) for w in distinct_words(t or "")}
                    least = min((crc32(w.encode()) for w in words), default=0)  # alike for near copies, which say no more than one
                    found += [(s, k, least) for s in words.union(*map(stems, words))]
                columns = list(zip(*found, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["stem", "toxic", "least"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("cls").cast("int"))
    of = lambda k: F.count_distinct(F.when(F.col("toxic") == k, F.col("least")))
    counts = texts.mapInArrow(run, "stem string, toxic int, least bigint").groupBy("stem").agg(of(1).alias("bad"), of(0).alias("good"))
    n = {r.cls: r["count"] for r in sample.groupBy("cls").count().collect()}
    if not n.get(1) or not n.get(0):
        return frozenset()
    least = 7 / np.log10((n[0] + n[1]) / n[1])
    rows = counts.where((F.col("bad") >= float(least)) & (F.col("good") <= 0.02 * F.col("bad"))).orderBy(F.desc("bad"), "stem").limit(STEMS).select("stem").collect()
    return frozenset(r.stem for r in rows)


def votes(docs: DataFrame, labels: DataFrame, found: frozenset[str]) -> DataFrame:
    """doc_id, quality and toxic, each the pattern of its labellers' votes in digits, annotators last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordMarks(found)
        for batch in batches:
            for part in rows_of(batch):
                texts = Texts(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), _digits(texts.quality_votes()), _digits(texts.toxic_votes(known))], names=["doc_id", "q", "x"])

    own = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, q string, x string")
    said = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    vote = lambda bad: F.when(bad, str(BAD)).when(~bad, str(GOOD)).otherwise(str(NOTHING))
    return own.join(said, "doc_id", "left").select("doc_id", F.concat("q", vote(F.col("quality") == 0)).alias("quality"), F.concat("x", vote(F.col("toxic") == 1)).alias("toxic"))


@dataclass
class Model:
    quality: Scorer
    toxic: Scorer
    toxic_stems: frozenset[str]
    accuracy: dict[str, list[float]]  # by model: how often each labeller is right, where it votes


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Vote patterns are counted over all documents; the scorers are trained on at most PER_CLASS rows of each class.
    Thresholds are from all documents that annotators call clean.

    Null and empty texts vote like any other; texts of any length are taken whole. Rows that repeat a doc_id share its
    labels, and copies count once in training. A doc_id labelled twice is bad, or toxic, if any of its labels says so;
    null labels say nothing. Without labels the heuristics alone are fitted; without documents the model accepts all.
    Other columns aren't read."""
    model, clean = _fitted(docs, labels)
    return calibrated(model, scored(docs.join(clean, "doc_id", "left_semi"), model))


def calibrated(model: Model, scores: DataFrame) -> Model:
    """Thresholds of model spare all but one in a thousand of the annotated clean documents, whose scores are given. They
    are zero, where the scorers are undecided, if there are none."""
    high = scores.agg(*[F.percentile_approx(c, SPARED, 100_000) for c in ("quality_score", "toxic_score")]).first()
    for head, found in zip((model.quality, model.toxic), high, strict=True):
        head.threshold = max(0.0, found or 0.0)
    return model


def _fitted(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model without thresholds, and the doc_id of what annotators and the label model call clean."""
    found = toxic_stems(docs, labels)
    cast = saved(votes(docs, labels, found))
    accuracy, scorers, clean = {}, [], F.lit(True)
    for head in ("quality", "toxic"):
        patterns = cast.groupBy(head).count().collect()  # at most 3 to the power of the number of labellers
        if not patterns:
            scorers.append(train_scorer([], np.zeros(0)))
            accuracy[head] = []
            continue
        keys = sorted(r[0] for r in patterns)
        counts = {r[0]: r[1] for r in patterns}
        p, share = expectation_maximisation(np.array([[int(c) for c in k] for k in keys]), np.array([counts[k] for k in keys], float))
        accuracy[head] = [float((s[0, GOOD] + s[1, BAD]) / (s[:, GOOD].sum() + s[:, BAD].sum())) for s in share]
        posterior = dict(zip(keys, p.tolist(), strict=True))
        bad = [k for k in keys if posterior[k] > 0.5]
        clean = clean & F.col(head).isin([k for k in keys if posterior[k] < 0.05])
        sample = _sampled(cast, PER_CLASS, F.col(head).isin(bad).cast("int")).join(cast.select("doc_id", head), "doc_id")
        rows = _training_rows(docs, sample.groupBy("doc_id").agg(F.max(head).alias("pattern")), found)
        scorers.append(train_scorer([r[:2] for r in rows], np.array([posterior[r[2]] for r in rows])))
    model = Model(*scorers, found, accuracy)
    said = cast.where(clean & F.col("quality").endswith(str(GOOD)) & F.col("toxic").endswith(str(GOOD)))
    return model, said.select("doc_id").distinct()


def _training_rows(docs: DataFrame, sample: DataFrame, found: frozenset[str]) -> list[tuple[np.ndarray, np.ndarray, str]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordMarks(found)
        for batch in batches:
            for part in rows_of(batch, 200):
                texts = [t or "" for t in part.column(1).to_pylist()]
                packed = [np.asarray(features(t), "<i4").tobytes() for t in texts]
                marks = [np.asarray(style_features(style(t), toxic_votes(distinct_words(t), known)), "<i4").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary()), pa.array(marks, pa.binary()), part.column(2)], names=["doc_id", "words", "style", "pattern"])

    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = saved(texts.mapInArrow(run, f"doc_id {kind}, words binary, style binary, pattern string"))
    before = Window.orderBy(F.xxhash64("doc_id"), "words").rowsBetween(Window.unboundedPreceding, -1)  # over at most 2 * PER_CLASS rows
    rows = made.withColumn("before", F.coalesce(F.sum(F.octet_length("words")).over(before), F.lit(0))).where(F.col("before") < FEATURE_BYTES).collect()
    ints = lambda b: np.frombuffer(b, "<i4")
    own = {(bytes(r.words), bytes(r.style), r.pattern): None for r in sorted(rows, key=lambda r: (r.doc_id, bytes(r.words)))}
    return [(ints(w), ints(s), p) for w, s, p in own]  # copies count once


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, quality_score and toxic_score (log odds of low quality, of toxic language), and
    accepted, false where either is above its threshold. Null and empty texts have no features and are accepted unless
    the style marks of an empty text say otherwise; other columns aren't read."""
    weights = docs.sparkSession.sparkContext.broadcast(np.stack([model.quality.weights, model.toxic.weights], axis=1))
    bias, most = np.array([model.quality.bias, model.toxic.bias]), np.array([model.quality.threshold, model.toxic.threshold])

    found = model.toxic_stems

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score_of, known = WordScores(weights.value), WordMarks(found)
        of_steps = np.array([[score_of.of([bucket(f"style {k} {n}")]) for n in range(len(STYLE_STEPS) + 1)] for k in range(6)])
        of_votes = np.array([[score_of.of([bucket(f"vote {k} {v}")]) for v in (NOTHING, GOOD, BAD)] for k in range(2)])
        for batch in batches:
            for part in rows_of(batch):
                texts = Texts(part.column(1).to_pylist())
                of_word = np.array(list(map(score_of.__getitem__, texts.words)), np.complex128)
                own = (texts.sums(of_word.real) + 1j * texts.sums(of_word.imag)) * np.maximum(1, texts.n_words) ** -LENGTH_POWER
                steps = np.searchsorted(STYLE_STEPS, texts.shares, "left")  # how many steps each share exceeds
                own = own + STYLE_WEIGHT * (of_steps[np.arange(6), steps].sum(axis=1) + of_votes[np.arange(2), texts.toxic_votes(known)].sum(axis=1))
                score = np.stack([own.real, own.imag], axis=1)
                score += bias
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score[:, 0].copy()), pa.array(score[:, 1].copy()), pa.array((score <= most).all(axis=1))], names=["doc_id", "quality_score", "toxic_score", "accepted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, quality_score double, toxic_score double, accepted boolean")


def judged(docs: DataFrame, labels: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """scored() by the model of docs and labels, in one pass for thresholds and verdicts. ids: docs with doc_id replaced
    by what its rows are told apart by, a struct with doc_id in it."""
    model, clean = _fitted(docs, labels)
    scores = saved(scored(docs if ids is None else ids, model).drop("accepted"))
    own = scores.withColumn("_id", F.col("doc_id") if ids is None else F.col("doc_id.doc_id"))
    model = calibrated(model, own.join(clean.select(F.col("doc_id").alias("_id")), "_id", "left_semi"))
    accepted = (F.col("quality_score") <= model.quality.threshold) & (F.col("toxic_score") <= model.toxic.threshold)
    return scores.withColumn("accepted", accepted)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, decided for each text of a doc_id: null ids are ids like others, null texts are
    judged as empty ones, rows that repeat id and text have one verdict, an empty table stays empty, and other columns,
    whatever their names, are kept."""
    ids = docs.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("doc_id"), "text")
    verdict = judged(docs, table(spark, sf_dir, "labels"), ids)
    return without(docs, verdict.where(~F.col("accepted")).select(F.col("doc_id.doc_id").alias("id"), F.col("doc_id.key").alias("key")))
