"""Subject areas of documents: complement naive Bayes, refined by expectation-maximization.

A complement naive Bayes model is trained on the sentences of labelled documents
and refined over those of all documents: the expectation step gives every sentence
a posterior over the subjects (a labelled document's sentences only its own
subjects), the maximization step counts words and pairs of words by these
posteriors.  A document's share of a subject is the mean of its sentences'
posteriors, each sentence weighted by its words and by how much its posterior
tells; one calibrator per subject turns shares into independent posteriors.  The
calibrators are cross-fitted: a labelled document's shares come from a model whose
counts leave its own part of the labelled documents out.

Words are hashed into a fixed number of buckets, so the model has a fixed size
however large the corpus; it is the only thing that reaches the driver.  Python
workers go through a batch in runs of a fixed number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import fold
from citeloom.operators.nested import let
from citeloom.staging import Stage

#: Buckets of the hashed vocabulary: the model is BUCKETS rows of one number per subject.
BUCKETS = 1 << 17
#: Smoothing of the counts.
ALPHA = 0.5
#: Rounds of expectation-maximization.
ROUNDS = 4
#: Labelled documents used for the calibration, at most; more would not move its few coefficients.
CALIBRATE = 20_000
#: Parts of the labelled documents for cross-fitting.
FOLDS = 3
#: Words without any meaning that every document is taken to hold besides its own, so that a text that tells next to nothing has no large share.
SILENT_WORDS = 2.0
#: Words that a Python worker takes at once (documents are not parted): bounds its memory.
RUN = 100_000


def sentences(text: Column) -> Column:
    """array<array<string>>: the words (letters only, three or more) of each sentence or line, marks folded, split words joined."""
    t = F.regexp_replace(text, r"<[^>]{1,40}>|&[a-z]+;", " ")
    t = F.regexp_replace(t, r"(?<=\p{L})-\r?\n-?(?=\p{L})", "")
    parts = F.split(fold(t), r"(?<=[.!?;:])\s+|\n\s*\n|\n#|\f")
    return F.filter(F.transform(parts, lambda s: F.filter(F.split(s, r"[^\p{L}]+"), lambda w: F.length(w) >= 3)), lambda s: F.size(s) > 0)


def _hash(w: Column) -> Column:
    return F.pmod(F.xxhash64(w), F.lit(1 << 31)).cast("int")


def features(text: Column) -> Column:
    """struct<f, n>: hashes of the words, sentence after sentence; how many words each sentence has."""
    return let(sentences(text), lambda s: F.struct(F.transform(F.flatten(s), _hash).alias("f"), F.transform(s, F.size).alias("n")))


#: Frequent words by which a text's language is told, so that a language's common words are not taken
#: for a subject's.  The last class is for all other texts.
LANGUAGES = (
    ("the", "and", "with", "for", "was", "were", "that", "this"),
    ("der", "die", "und", "das", "uber", "sich", "von", "ein", "fur", "zu", "zum", "wie", "sind"),
    ("les", "des", "une", "sur", "est", "dans", "aux", "entre", "cet", "pour"),
    ("los", "las", "una", "sobre", "del", "que", "para", "con", "por", "son"),
)


def language_hashes(spark) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, classes) of the words of ``LANGUAGES``, by hash."""
    words = [(w, c) for c, ws in enumerate(LANGUAGES) for w in ws]
    rows = spark.createDataFrame(words, "w string, c int").select(_hash(F.col("w")).alias("h"), "c").collect()
    rows = sorted({r["h"]: r["c"] for r in rows}.items())
    return np.array([h for h, _ in rows], dtype=np.int32), np.array([c for _, c in rows], dtype=np.int32)


class Run:
    """Some documents of a batch: buckets of their words and pairs of neighbouring words, the sentence of each, the document of each sentence."""

    def __init__(self, rows: slice, words: np.ndarray, sizes: np.ndarray, doc: np.ndarray, buckets: int):
        self.rows, self.words, self.doc = rows, words, doc
        self.docs, self.sentences = rows.stop - rows.start, len(doc)
        of = np.repeat(np.arange(self.sentences, dtype=np.int32), sizes)
        self.word_of = of
        within = np.nonzero(of[1:] == of[:-1])[0]
        w = words.astype(np.uint32)
        two = w[within] * np.uint32(0x9E3779B1) ^ w[within + 1] * np.uint32(0x85EBCA6B)
        two ^= two >> np.uint32(15)
        self.flat = np.concatenate([w % np.uint32(buckets), two % np.uint32(buckets)]).astype(np.int32)
        self.of = np.concatenate([of, of[within]])

    def languages(self, hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The class of ``LANGUAGES`` most of whose words each document has; the number of classes if none."""
        k = len(LANGUAGES)
        at = np.minimum(np.searchsorted(hashes, self.words), len(hashes) - 1)
        known = np.nonzero(hashes[at] == self.words)[0]
        n = np.bincount(self.doc[self.word_of[known]] * k + classes[at[known]], minlength=self.docs * k).reshape(-1, k)
        return np.where(n.any(axis=1), n.argmax(axis=1), k)


def runs(f: pa.Array, n: pa.Array, buckets: int, most: int = RUN) -> Iterator[Run]:
    """The documents of two Arrow columns in runs of at most ``most`` words; a longer document is a run of its own."""
    fo, no = f.offsets.to_numpy(), n.offsets.to_numpy()
    start, rows = 0, len(f)
    while start < rows:
        stop = max(int(np.searchsorted(fo, fo[start] + most, "right")) - 1, start + 1)
        words = f.values[fo[start] : fo[stop]].to_numpy(zero_copy_only=False)
        sizes = n.values[no[start] : no[stop]].to_numpy(zero_copy_only=False)
        if len(words):
            yield Run(slice(start, stop), words, sizes, np.repeat(np.arange(stop - start, dtype=np.int32), np.diff(no[start : stop + 1])), buckets)
        start = stop


def complement_weights(counts: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Complement naive Bayes: minus the log of a word's share outside each subject, centred over the subjects."""
    other = counts.sum(axis=1, keepdims=True) - counts + alpha
    w = -np.log(other / other.sum(axis=0, keepdims=True))
    return (w - w.mean(axis=1, keepdims=True)).astype(np.float32)


def sentence_scores(run: Run, weights: np.ndarray) -> np.ndarray:
    """sentences x subjects: the complement naive Bayes score of each sentence."""
    return np.stack([np.bincount(run.of, weights=w[run.flat], minlength=run.sentences) for w in weights.T], axis=1)


def posteriors(run: Run, weights: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Posterior of each sentence over the subjects that ``allowed`` (sentences x subjects) leaves it.

    The document's mean over its sentences is the prior of each in a second pass,
    so that a phrase found in documents of every kind follows its documents.
    """
    score = np.where(allowed, sentence_scores(run, weights), -np.inf)
    p = _softmax(score)
    mean = np.stack([np.bincount(run.doc, weights=c, minlength=run.docs) for c in p.T], axis=1) / np.maximum(np.bincount(run.doc, minlength=run.docs), 1)[:, None]
    return _softmax(score + 2 * np.log(mean + 0.01)[run.doc])


def _softmax(score: np.ndarray) -> np.ndarray:
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _allowed(masks: np.ndarray, k: int) -> np.ndarray:
    """documents x subjects from bit masks; 0 leaves every subject."""
    a = (masks[:, None] >> np.arange(k)) & 1 == 1
    a[masks == 0] = True
    return a


def count_words(docs: DataFrame, k: int, weights: np.ndarray | None, buckets: int = BUCKETS) -> np.ndarray:
    """(buckets + languages) x (k + languages): words by the posteriors of their sentences, and by the language of their texts.

    The rows below the buckets hold the words of each language by subject.  Without
    weights the labels alone decide.  A task sends its whole table once, so tasks
    are few: four for each core, each reading many parts of the corpus.
    """
    langs = len(LANGUAGES) + 1
    names = [f"c{i}" for i in range(k + langs)]
    columns = None if weights is None else np.asfortranarray(weights)
    hashes, classes = language_hashes(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + langs, buckets + langs))
        for b in batches:
            masks = b.column("labels").to_numpy(zero_copy_only=False)
            for r in runs(b.column("f"), b.column("n"), buckets):
                allowed = _allowed(masks[r.rows], k)[r.doc]
                p = allowed / allowed.sum(axis=1, keepdims=True) if columns is None else posteriors(r, columns, allowed)
                spoken = r.languages(hashes, classes)[r.doc][r.of]
                for i in range(k):
                    share = p[:, i][r.of]
                    total[i, :buckets] += np.bincount(r.flat, weights=share, minlength=buckets)
                    total[i, buckets:] += np.bincount(spoken, weights=share, minlength=langs)
                for i in range(langs):
                    total[k + i, :buckets] += np.bincount(r.flat[spoken == i], minlength=buckets)
        at = np.nonzero(total.any(axis=0))[0].astype(np.int32)
        for i in range(0, len(at), 16_384):
            part = at[i : i + 16_384]
            yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(c[part]) for c in total]], names=["b", *names])

    few = docs.select("f", "n", "labels").coalesce(4 * docs.sparkSession.sparkContext.defaultParallelism)
    rows = few.mapInArrow(run, "b int, " + ", ".join(f"{c} double" for c in names))
    got = rows.groupBy("b").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # the rows of the model
    out = np.zeros((buckets + langs, k + langs))
    if len(got):
        out[got["b"].to_numpy()] = got[names].to_numpy()
    return out


def level(counts: np.ndarray, k: int, buckets: int = BUCKETS) -> np.ndarray:
    """buckets x k: the counts of words by subject as they were if every language were spread over the subjects alike.

    Where the few labelled texts of a language happen to treat one subject, its
    articles and prepositions would speak for that subject.  A word is expected in a
    subject as often as the words of its languages are (the mean of the languages'
    spreads over subjects, by how often each language has the word); its count is
    divided by that expectation and scaled back to the word's total.  A word as
    frequent in each subject as its languages are comes out even.
    """
    by_lang = counts[buckets:, :k]
    spread = (by_lang + 0.02 * by_lang.sum(axis=1, keepdims=True) / k + 1e-6) / (by_lang.sum(axis=1, keepdims=True) * 1.02 + k * 1e-6)
    lang = counts[:buckets, k:]
    expected = (lang / np.maximum(lang.sum(axis=1, keepdims=True), 1e-9)) @ spread
    c = counts[:buckets, :k] / np.maximum(expected * k, 1e-3)
    # the totals stay
    return c * (counts[:buckets, :k].sum(axis=1, keepdims=True) / np.maximum(c.sum(axis=1, keepdims=True), 1e-9))


def shares(run: Run, weights: np.ndarray) -> np.ndarray:
    """documents x subjects: the mean of a document's sentence posteriors.

    A sentence counts by its words times the square of what its posterior tells
    (one minus its entropy); ``SILENT_WORDS`` that tell nothing belong to no subject.
    """
    p = _softmax(sentence_scores(run, weights))
    tells = np.maximum(1 + (p * np.log(p + 1e-12)).sum(axis=1) / np.log(max(p.shape[1], 2)), 0)
    w = np.bincount(run.of, minlength=run.sentences) * tells**2
    total = np.bincount(run.doc, weights=w, minlength=run.docs) + SILENT_WORDS
    return np.stack([np.bincount(run.doc, weights=c * w, minlength=run.docs) for c in p.T], axis=1) / total[:, None]


def document_shares(docs: DataFrame, weights: np.ndarray, keep: list[str]) -> DataFrame:
    """(keep..., i, share): the share of every subject (its number) in each document with any words."""
    columns, k = np.asfortranarray(weights), weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in runs(b.column("f"), b.column("n"), len(columns)):
                x = shares(r, columns)
                at = pa.array(np.repeat(np.arange(r.rows.start, r.rows.stop), k))
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keep], pa.array(np.tile(np.arange(k, dtype=np.int32), r.docs)), pa.array(x.ravel())], names=[*keep, "i", "share"])

    fields = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in keep)
    return docs.select(*keep, "f", "n").mapInArrow(run, fields + "i int, share double")


def log_odds(share: np.ndarray) -> np.ndarray:
    return np.log((share + 0.01) / (1.01 - share))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 30, toward: np.ndarray | None = None) -> np.ndarray:
    """Coefficients by Newton steps, drawn towards ``toward`` (zero if none)."""
    toward = np.zeros(x.shape[1]) if toward is None else toward
    w = toward.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * (w - toward)
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def calibrators(share: np.ndarray, y: np.ndarray) -> np.ndarray:
    """subjects x (intercept, slope): a logistic regression on the log-odds of the share for each subject.

    Each is drawn towards the regression of all subjects together, by as much as two
    labelled documents would: a subject with few labels follows the others.
    """
    x = np.stack([np.ones_like(share), log_odds(share)], axis=-1)
    pooled = fit_logistic(x.reshape(-1, 2), y.ravel().astype(float))
    return np.stack([fit_logistic(x[:, i], y[:, i].astype(float), 2.0, toward=pooled) for i in range(share.shape[1])])


def cross_fitted(known: DataFrame, counts: np.ndarray, weights: np.ndarray, k: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares, labels) of the labelled documents, each fold's by a model whose counts leave the fold out.

    ``counts`` came of the posteriors under ``weights``, so the fold's own counts under
    these are what is taken off.
    """
    total = known.count()
    sample = known if total <= CALIBRATE else known.filter(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int(CALIBRATE / total * (1 << 20)))
    got = []
    for fold in range(FOLDS):
        here = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)) == fold
        rest = np.maximum(counts - count_words(known.filter(here), k, weights, buckets), 0)
        x = document_shares(sample.filter(here), complement_weights(level(rest, k, buckets)), ["labels"]).select("labels", "share").toPandas()
        got.append((x["share"].to_numpy().reshape(-1, k), x["labels"].to_numpy()[::k]))
    return np.concatenate([g[0] for g in got]), _allowed(np.concatenate([g[1] for g in got]), k)


def classify(documents: DataFrame, labels: DataFrame, names: list[str], rounds: int = ROUNDS, buckets: int = BUCKETS, least: float = 0.0) -> DataFrame:
    """(doc_id, subject, p): the posterior of each subject for each document with any words; those below ``least`` left out.

    Null and blank texts and texts without words give no row.  Repeated labels
    count once, labels of unknown documents or subjects do not count.  Repeated
    documents give one row per subject, the largest posterior.  Without labels
    there is no model and the result is empty.
    """
    spark, k = documents.sparkSession, len(names)
    stage = Stage(spark, "subjects")
    bit = F.coalesce(*[F.when(F.col("subject") == s, F.lit(1 << i)) for i, s in enumerate(names)])
    masks = labels.filter(F.col("subject").isin(names)).select("doc_id", bit.alias("bit")).groupBy("doc_id").agg(F.bit_or("bit").cast("long").alias("labels"))
    docs = documents.select("doc_id", features(F.col("text")).alias("x")).select("doc_id", "x.*")
    # filtered after it is written: a filter on the features would compute them twice
    docs = stage.put(docs.join(masks, "doc_id", "left").select("doc_id", "f", "n", F.coalesce("labels", F.lit(0)).alias("labels"))).filter("size(f) > 0")
    known = stage.put(docs.filter("labels > 0"))
    counts = count_words(known, k, None, buckets)
    if not counts.sum():
        return spark.createDataFrame([], "doc_id long, subject string, p double")
    for _ in range(rounds):
        weights = complement_weights(level(counts, k, buckets))
        counts = count_words(docs, k, weights, buckets)
    c = calibrators(*cross_fitted(known, counts, weights, k, buckets))
    found = document_shares(docs, complement_weights(level(counts, k, buckets)), ["doc_id"])
    a, b = (F.get(F.array(*[F.lit(float(x)) for x in c[:, j]]), F.col("i")) for j in (0, 1))
    p = 1 / (1 + F.exp(-(a + b * F.log((F.col("share") + 0.01) / (F.lit(1.01) - F.col("share"))))))
    subject = F.get(F.array(*[F.lit(s) for s in names]), F.col("i"))
    return found.select("doc_id", subject.alias("subject"), p.alias("p")).filter(F.col("p") >= least).groupBy("doc_id", "subject").agg(F.max("p").alias("p"))


def subjects_of(documents: DataFrame, labels: DataFrame, names: list[str], threshold: float = 0.5) -> DataFrame:
    """(doc_id, subject): the subjects whose posterior reaches ``threshold``."""
    return classify(documents, labels, names, least=threshold).select("doc_id", "subject")
