"""Toxicity by a linear classifier that is indifferent to which group a sentence mentions.

Features are the words of the whole text (lower-cased, in all alphabets) and their beginnings of 4
to 9 bytes, present or absent, as 64-bit numbers. Learning takes a bounded sample of labelled rows:

1. Each feature's rows with and without the label are counted; the ``FEATURES`` with the largest
   log-likelihood ratio are kept, and with them every feature of an identity term.
2. In every labelled sentence that names a group, the term is swapped for the others of its kind.
   The score is linear, so a swap moves it by w . (features of the other - features of the term);
   the squared moves of all swaps are added to the loss. Each pair of terms counts once in any
   case, so terms that the sample lacks are level too.

Scores use nothing but the text. Defined cases: a null or empty text scores by the intercept alone;
rows that repeat an id are scored one by one; without labels, or with one class only, every row
gets the share of toxic rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import broadcast_if_small, cut
from waitwright.llm.linear import fit, held_out, labelled_sample, probability
from waitwright.llm.words import SPACED, Words, mix, pieces

#: Terms that may replace each other, by kind and language.
IDENTITIES = {
    "gender en": ("women", "men", "girls", "boys"),
    "gender de": ("frauen", "männer"),
    "gender fr": ("femmes", "hommes"),
    "gender es": ("mujeres", "hombres"),
    "faith en": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    "faith de": ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    "faith fr": ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    "faith es": ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    "origin en": ("africans", "asians", "europeans", "americans", "arabs", "immigrants"),
    "origin de": ("afrikaner", "asiaten", "europäer", "amerikaner", "araber", "einwanderer"),
    "origin fr": ("africains", "asiatiques", "européens", "américains", "arabes", "immigrés"),
    "origin es": ("africanos", "asiáticos", "europeos", "americanos", "árabes", "inmigrantes"),
    "orientation": ("gay", "lesbian", "straight", "bisexual", "queer", "trans"),
    "ability": ("blind", "deaf", "disabled", "autistic"),
}
MOST_LABELLED = 30_000
FEATURES = 1024
BEGINNINGS = (4, 5, 6, 7, 8, 9)
LEAST_ROWS = 4
SWAP_WEIGHT = 1.0
RIDGE = 0.03
THRESHOLD = 0.7
EDGE = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))))


def lowered(column) -> Words:
    return Words(pc.utf8_lower(column), SPACED)


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each word and beginning, repeats included."""
    rows, values = [words.row_of], [mix(words.hashes + np.uint64(1))]
    length = words.ends - words.starts
    for size in BEGINNINGS:
        long = np.flatnonzero(length >= size)
        starts = words.starts[long]
        rows.append(words.row_of[long])
        values.append(mix(words.range_hashes(starts, starts + size) + np.uint64(size)))
    return np.concatenate(rows), np.concatenate(values).view(np.int64)


def distinct(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    fresh = np.r_[True, (np.diff(rows) != 0) | (np.diff(values) != 0)][:len(rows)]
    return rows[fresh], values[fresh]


def term_features(term: str) -> np.ndarray:
    _, values = features(lowered(pa.array([term])))
    return np.unique(values)


def terms_in(text: str) -> list[str]:
    """Identity terms, one entry per sentence and term."""
    known = {term for terms in IDENTITIES.values() for term in terms}
    return [term for sentence in re.split(r"[.!?\n]+", text.lower())
            for term in {w.strip(EDGE) for w in sentence.split()} & known]


@dataclass
class Model:
    values: np.ndarray      # kept features, sorted
    weights: np.ndarray
    intercept: float

    def __post_init__(self):
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.values.view(np.uint64) >> np.uint64(44)] = True

    def entries(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(row, place in ``values``) of kept features, each once a row."""
        rows, values = features(words)
        likely = np.flatnonzero(self.seen[values.view(np.uint64) >> np.uint64(44)])
        rows, values = rows[likely], values[likely]
        place = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
        hit = self.values[place] == values
        return distinct(rows[hit], place[hit])

    def score(self, words: Words) -> np.ndarray:
        return probability(*self.entries(words), len(words.counts), self.weights, self.intercept)


def _choose(sample: DataFrame) -> np.ndarray:
    """The features that tell most about the label, and those of all identity terms."""

    def count(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows, values = distinct(*features(lowered(piece.column("text"))))
                positive = piece.column("label").to_numpy()[rows] > 0
                key, inverse = np.unique(values, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(np.bincount(inverse, positive, len(key))
                                             .astype(np.int64)),
                     pa.array(np.bincount(inverse, ~positive, len(key)).astype(np.int64))],
                    names=["feature", "yes", "no"])

    total = sample.agg(F.sum("label").alias("yes"), F.count("*").alias("n")).first()
    yes, n = float(total["yes"] or 0), float(total["n"])
    counted = sample.mapInArrow(count, "feature long, yes long, no long").groupBy("feature").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no")).filter(
        F.col("yes") + F.col("no") >= LEAST_ROWS)
    share, rows = yes / max(n, 1.0), F.col("yes") + F.col("no")
    gain = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    ratio = gain(F.col("yes"), rows * share) + gain(F.col("no"), rows * (1 - share))
    best = counted.select("feature", F.round(ratio, 6).alias("ratio")).orderBy(
        F.desc("ratio"), "feature").limit(FEATURES).select("feature").toPandas()
    named = [term_features(t) for terms in IDENTITIES.values() for t in terms]
    return np.unique(np.concatenate([best["feature"].to_numpy(np.int64), *named]))


def swap_rows(values: np.ndarray, named: dict[str, int]) -> np.ndarray:
    """One row per ordered pair of a kind: the move of a swap, weighted by its occurrences."""
    out = []
    for terms in IDENTITIES.values():
        spots = {t: np.searchsorted(values, term_features(t)) for t in terms}
        for a in terms:
            for b in terms:
                if a != b:
                    row = np.zeros(len(values))
                    row[spots[b]] += 1
                    row[spots[a]] -= 1
                    times = SWAP_WEIGHT * (1 + named.get(a, 0)) / (len(terms) - 1)
                    out.append(row * np.sqrt(times))
    return np.array(out)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id",
          text: str = "text", most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` labelled rows outside the held-out fold."""
    sample = cut(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(
        broadcast_if_small(cut(labelled_sample(labels, label, most, key))), "id")
        .select("text", "label"))
    kept = Model(_choose(sample), np.zeros(0), 0.0)

    def vectors(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows, places = kept.entries(lowered(piece.column("text")))
                at = np.searchsorted(rows, np.arange(piece.num_rows + 1)).astype(np.int32)
                names = [terms_in(t or "") for t in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [piece.column("label"), pa.ListArray.from_arrays(
                        pa.array(at), pa.array(places.astype(np.int32))),
                     pa.array(names, pa.list_(pa.string()))], names=["label", "places", "names"])

    vectored = cut(sample.mapInArrow(
        vectors, "label int, places array<int>, names array<string>"))
    named = {r["name"]: r["n"] for r in vectored.select(F.explode("names").alias("name")).groupBy(
        "name").agg(F.count("*").alias("n")).collect()}
    # The sample is bounded; a fixed order of its rows makes the fit repeatable.
    table = vectored.select("label", "places").toPandas()
    table = table.iloc[sorted(range(len(table)), key=lambda i: (
        table["label"].iat[i], tuple(table["places"].iat[i])))]
    sizes = np.array([len(x) for x in table["places"]], np.int64)
    rows = np.repeat(np.arange(len(table)), sizes)
    columns = np.concatenate([np.zeros(0, np.int64), *table["places"]]).astype(np.int64)
    weights, intercept = fit(rows, columns, (table["label"].to_numpy() > 0).astype(float),
                             len(kept.values), swap_rows(kept.values, named), RIDGE)
    return Model(kept.values, weights, intercept)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, held_out, score (higher: likelier toxic), predicted (score >= 0.7)."""
    schema = pa.schema([("key", pa.int64()), ("score", pa.float64())])

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays(
                    [piece.column("key"),
                     pa.array(model.score(lowered(piece.column("text"))))], schema=schema)

    scored = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        task, "key long, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
