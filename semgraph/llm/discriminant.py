"""Quality score by a regularised quadratic discriminant over document statistics.

Every text becomes a short vector of transformed statistics (logs of sizes, log-odds of shares). Good and
bad labelled documents get a normal density each, with its own covariance, shrunk towards the pooled
covariance of both classes and towards a multiple of the identity. A text's score is the posterior of being good:
the logistic of the difference of the two log-densities, whose Mahalanobis distances use Cholesky factors
that are made once and travel with the function. Class sums are added up over the cluster; no labelled
row reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.llm.common import Queries, free_name, table, texts_of
from semgraph.llm.quality import CAPITALS, DIGITS, FUNCTION_WORDS, SPACE_BYTES, SYMBOLS
from semgraph.session import materialize

QUERIES = Queries()

FREQUENT = frozenset(word.encode() for word in FUNCTION_WORDS)
COUNTS = ("words", "characters", "again", "capitals", "marked", "symbols", "stops", "digits", "frequent", "calls",
          "copied_lines", "lines", "bytes", "packed")
#: Share, of what, and its usual size, which a few pseudo-counts stand for in short texts.
SHARES = (("again", "words", 0.005), ("capitals", "characters", 0.02), ("marked", "words", 0.002),
          ("symbols", "characters", 0.001), ("stops", "words", 0.1), ("digits", "characters", 0.005),
          ("frequent", "words", 0.25), ("calls", "words", 0.005), ("copied_lines", "lines", 0.02), ("packed", "bytes", 0.5))
PSEUDO = 10.0
SIZE = len(SHARES) + 2


def count_text(text: str) -> tuple[int, ...]:
    """The numbers of ``COUNTS``: words, characters in words, words that equal the word before, ASCII capitals,
    words with a symbol, symbols, words that end a sentence, digits, function words, exclamation marks,
    lines equal to an earlier one, lines with a word, bytes, and bytes after compression."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(SPACE_BYTES)]
    held = [len(raw) - len(raw.translate(None, chars)) for chars in (SPACE_BYTES, CAPITALS, SYMBOLS, DIGITS)]
    marked = sum(len(w) != len(w.translate(None, SYMBOLS)) for w in words) if held[2] else 0
    return (len(words), len(text) - held[0], sum(map(eq, words, words[1:])), held[1], marked, held[2],
            sum(w[-1] in b".?:;" for w in words), held[3], sum(map(FREQUENT.__contains__, raw.lower().split())),
            raw.count(b"!"), len(lines) - len(set(lines)), len(lines), len(raw), len(zlib.compress(raw, 1)) - 8)


def transform(counts: np.ndarray) -> np.ndarray:
    """Statistics of rows of ``COUNTS``: log of the number of words, log of their mean length, log-odds of the
    ``SHARES`` with pseudo-counts."""
    c = dict(zip(COUNTS, counts.astype(float).T))
    columns = [np.log1p(c["words"]), np.log((c["characters"] + 5 * PSEUDO) / (c["words"] + PSEUDO))]
    for part, whole, usual in SHARES:
        part, whole = c[part] + PSEUDO * usual, c[whole] + PSEUDO
        columns.append(np.log(part / np.maximum(whole - part, 0.1)))
    return np.stack(columns, axis=1)


def statistics(text: Column) -> Column:
    """``array<double>`` of the ``SIZE`` statistics of a text; a null text counts as empty."""

    @F.arrow_udf("array<double>")
    def stats(column: pa.Array) -> pa.Array:
        counts = np.array([count_text(t or "") for t in texts_of(column)], np.int64).reshape(-1, len(COUNTS))
        return pa.array(list(transform(counts)), pa.list_(pa.float64()))
    return stats.asNondeterministic()(text)


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log-densities' constants of the bad and the good class; without
    them, the same ``prior`` for every text."""

    prior: float
    centre: tuple[np.ndarray, ...] = ()
    factor: tuple[np.ndarray, ...] = ()
    constant: tuple[float, ...] = ()

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not self.centre:
            return np.full(len(rows), self.prior)
        logs = [c - 0.5 * (((rows - m) @ f.T) ** 2).sum(1) for m, f, c in zip(self.centre, self.factor, self.constant)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))


def discriminant(counts: np.ndarray, means: np.ndarray, scatters: np.ndarray, pooling: float, levelling: float) -> Discriminant:
    """From the number, mean and sum of centred products of the bad and the good rows.

    A class covariance is ``(1 - pooling)`` its own and ``pooling`` the pooled one, of which a share ``levelling``
    is replaced by a diagonal of the pooled variances. Without rows of both classes: the smoothed share of good rows."""
    prior = float((counts[1] + 1) / (counts.sum() + 2))
    if not counts.all():
        return Discriminant(prior)
    pooled = scatters.sum(0) / counts.sum()
    level = np.diag(np.maximum(pooled.diagonal(), 1e-6))
    factors, constants = [], []
    for n, scatter in zip(counts, scatters):
        spread = (1 - levelling) * ((1 - pooling) * scatter / n + pooling * pooled) + levelling * level
        lower = np.linalg.cholesky(spread)
        factors.append(np.linalg.inv(lower))
        constants.append(float(np.log(n / counts.sum()) - np.log(lower.diagonal()).sum()))
    return Discriminant(prior, tuple(means), tuple(factors), tuple(constants))


def _added(rows: DataFrame, centre: np.ndarray | None) -> np.ndarray:
    """By class, the number of rows and the sums of ``stats``, or of their products around ``centre``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 1 + (SIZE if centre is None else SIZE * SIZE)))
        for batch in batches:
            good = batch.column("good").to_numpy()
            stats = batch.column("stats").flatten().to_numpy().reshape(-1, SIZE)
            for k in (0, 1):
                own = stats[good == k]
                off = own - centre[k] if centre is not None else own
                total[k] += np.concatenate([[len(own)], off.sum(0) if centre is None else (off.T @ off).ravel()])
        yield pa.record_batch([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["place", "total"])

    found = (rows.mapInArrow(sums, "place int, total double").groupBy("place").agg(F.sum("total").alias("total"))
             .orderBy("place").collect())  # a row per entry
    width = 1 + (SIZE if centre is None else SIZE * SIZE)
    return np.array([r.total for r in found] or [0.0] * (2 * width)).reshape(2, width)


def fit_discriminant(labelled: DataFrame, pooling: float = 0.1, levelling: float = 0.1) -> Discriminant:
    """Discriminant of ``labelled(stats, good)``, ``good`` 0 or 1; all rows count, repeated ones too."""
    first = _added(labelled, None)
    counts = first[:, 0]
    means = first[:, 1:] / np.maximum(counts, 1)[:, None]
    scatters = _added(labelled, means)[:, 1:].reshape(2, SIZE, SIZE)
    return discriminant(counts, means, scatters, pooling, levelling)


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from the fit: the CRC-32 of its decimal id leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, pooling: float = 0.1, levelling: float = 0.1) -> DataFrame:
    """``docs(doc_id, text)`` without ``text``, with ``held_out`` and ``score``, the chance of being good, appended.

    The discriminant is fitted to all documents with a label ``quality`` of 0 or 1 in ``labels(doc_id, quality)``
    that are not ``held_out``. Scores depend on the text alone. Null and empty texts are scored like any other.
    Repeated rows each get a score and, if labelled, count each in the fit, as do repeated labels; rows without
    ``doc_id`` have no label. Without labels of both classes every score is the smoothed share of good labels.
    Columns that have a new one's name stay, the new one gets underscores in front.
    """
    kept = [c for c in docs.columns if c != "text"]
    stats = free_name(docs.columns, "stats")
    counted = materialize(docs.select(*[F.col(f"`{c}`") for c in kept], statistics(F.col("text")).alias(stats)))
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        "doc_id", F.col("quality").alias("good"))
    model = fit_discriminant(counted.select("doc_id", F.col(f"`{stats}`").alias("stats")).join(known, "doc_id").select(
        "stats", F.col("good").cast("int").alias("good")), pooling, levelling)

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        return pa.array(model.score(column.flatten().to_numpy().reshape(-1, SIZE)))

    return counted.select(*[F.col(f"`{c}`") for c in kept], held_out(F.col("doc_id")).alias(free_name(kept, "held_out")),
                          scored(F.col(f"`{stats}`")).alias(free_name(kept, "score")))


@QUERIES.add("op11_quality_discriminant")
def op11(spark, sf):
    scored = score_quality(table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))
