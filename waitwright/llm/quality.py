"""Document quality: a classifier's evidence, tempered by what its site is known for.

Evidence is the probability of low quality that a logistic classifier gives to a text's shape:
symbols, capitals, repeated words and lines, lengths, each cut into bands. It is learnt from a
bounded sample of labelled rows. Sites form a hierarchy, host over path. Each level's mean evidence
is shrunk toward the level above: (sum + k * mean above) / (n + k), the weight k estimated from
the spread between the groups of that level by moments, so that a site with few rows says little. A
row's posterior odds are its evidence odds times the odds of its path over the global odds, where
path and host are judged by their other rows: the only row of a site has the mean of its host.

Sums are of whole millionths, so results do not depend on the order of rows. Grouping runs on
partial sums; groups return to the rows by broadcast while they are few (measured), else by shuffle.

Defined cases: null hosts and paths are groups of their own; a null or empty text has no words and
is scored by that; rows that repeat an id are judged one by one; without labels, or with labels of
one class, nothing is rejected by evidence alone; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import broadcast_if_small, cut
from waitwright.llm.linear import fit, held_out, labelled_sample, probability
from waitwright.llm.words import SPACED, Words, flat, pieces

MOST_LABELLED = 30_000
BANDS = 24
RIDGE = 0.5
MILLION = 1_000_000
SHAPE = ("log_words", "word_bytes", "symbols", "capitals", "digits", "repeats", "distinct",
         "bars", "marked_words", "shouted_words", "top_word")
MOST_WEIGHT = 1e6
THRESHOLD = 0.5


def _per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.int64)]
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def shape(column) -> np.ndarray:
    """One row per text, one column per name in SHAPE."""
    raw, offsets = flat(column)
    words = Words(column, SPACED)
    n = words.counts.astype(float)
    some, size = np.maximum(n, 1), np.maximum(np.diff(offsets), 1).astype(float)
    ordinary = np.zeros(256, bool)
    ordinary[[*range(9, 14), 32, 39, 44, 45, 46, *range(48, 58), *range(65, 91), *range(97, 123),
              *range(128, 256)]] = True
    hashes, owner = words.hashes, words.row_of
    again = np.r_[False, (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])][:len(hashes)]
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    fresh = np.r_[True, (np.diff(o) != 0) | (h[1:] != h[:-1])][:len(h)]
    runs = np.flatnonzero(fresh)
    top = np.zeros(len(n))
    if len(runs):
        np.maximum.at(top, o[runs], np.diff(np.r_[runs, len(h)]).astype(float))
    in_words = lambda flags: np.add.reduceat(
        np.r_[flags, False].astype(np.int32), words.starts) if len(words.starts) else \
        np.zeros(0, np.int32)
    odd, capital = ~ordinary[raw], (raw >= 65) & (raw <= 90)
    marked = in_words(odd) >= 2
    length = words.ends - words.starts
    shouted = (in_words(capital) >= 2) & (length >= 2)
    return np.column_stack([
        np.log1p(n), _per_row(words.data != 0, offsets) / some, _per_row(odd, offsets) / size, _per_row(capital, offsets) / size,
        _per_row((raw >= 48) & (raw <= 57), offsets) / size, _per_row(again, words.rows) / some,
        _per_row(fresh[np.argsort(order, kind="stable")], words.rows) / some,
        _per_row(raw == 124, offsets) / some, _per_row(marked, words.rows) / some,
        _per_row(shouted, words.rows) / some, top / some])


@dataclass
class Model:
    edges: np.ndarray       # band edges, one row per shape column
    weights: np.ndarray
    intercept: float

    def entries(self, shapes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count, width = shapes.shape
        columns = np.empty((count, width), np.int64)
        for k in range(width):
            columns[:, k] = k * BANDS + np.searchsorted(self.edges[k], shapes[:, k], "right")
        return np.repeat(np.arange(count), width), columns.ravel()

    def low(self, column) -> np.ndarray:
        """Probability of low quality."""
        shapes = shape(column)
        return probability(*self.entries(shapes), len(shapes), self.weights, self.intercept)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id",
          text: str = "text", most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` labelled rows (label 1: good) outside the held-out fold."""
    sample = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(
        broadcast_if_small(cut(labelled_sample(labels, label, most, key))), "id")

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                shapes = shape(piece.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("label"), *(pa.array(c) for c in shapes.T)],
                    names=["label", *SHAPE])

    table = sample.select("text", "label").mapInArrow(
        task, ", ".join(["label int", *(f"{c} double" for c in SHAPE)])).toPandas()
    table = table.sort_values(list(table.columns))
    shapes = table[list(SHAPE)].to_numpy(float)
    low = (table["label"].to_numpy() < 1).astype(float)
    # Edges at quantiles of the low rows and of the others: both ends of a scale are resolved.
    half = BANDS // 2
    at = lambda rows: np.quantile(rows, np.arange(1, half) / half, axis=0) if len(rows) else \
        np.zeros((half - 1, len(SHAPE)))
    edges = np.sort(np.vstack([at(shapes[low > 0]), at(shapes[low == 0])]), axis=0).T
    model = Model(edges, np.zeros(0), 0.0)
    weights, intercept = fit(*model.entries(shapes), low, BANDS * len(SHAPE), ridge=RIDGE)
    return Model(edges, weights, intercept)


def evidence(docs: DataFrame, model: Model, carry: dict[str, Column], text: str = "text",
             most: int = 4 << 20) -> DataFrame:
    """Carried columns of each row and ``low``, its evidence in millionths.

    ``most``: bytes of text that a task looks at together; rows are the same at any size.
    """
    kept = docs.select(*(c.alias(name) for name, c in carry.items()), F.col(text).alias("_text"))
    schema = kept.drop("_text").withColumn("low", F.lit(0).cast("bigint")).schema
    names = list(carry)

    def task(batches):
        for batch in batches:
            for piece in pieces(batch, "_text", most):
                low = np.rint(model.low(piece.column("_text")) * MILLION).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in names), pa.array(low)], names=[*names, "low"])

    return kept.mapInArrow(task, schema)


def _weight(groups: DataFrame) -> float:
    """Prior weight k of a level, by moments: within variance over between variance.

    groups: n, total, squares (of evidence in millionths) per group.
    """
    n, total, square = (F.col(c).cast("double") for c in ("n", "total", "squares"))
    row = groups.agg(
        F.count("*").alias("groups"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"),
        F.sum(total).alias("total"), F.sum(square - total * total / n).alias("within"),
        F.sum(total * total / n).alias("between")).first()
    if not row["groups"] or row["groups"] < 2 or row["n"] <= row["groups"]:
        return MOST_WEIGHT
    within = row["within"] / (row["n"] - row["groups"])
    between = row["between"] - row["total"] ** 2 / row["n"]
    spread = (between - (row["groups"] - 1) * within) / (row["n"] - row["nn"] / row["n"])
    return min(MOST_WEIGHT, max(1.0, round(within / spread, 3))) if spread > 0 else MOST_WEIGHT


@dataclass
class Sites:
    sums: DataFrame         # _host, _path, rows and evidence of both levels
    overall: float
    k_host: float
    k_path: float


def sites(rows: DataFrame) -> Sites:
    """Sums of every host and path of rows (host, path, low), and the weights of both levels."""
    low = F.col("low")
    paths = cut(rows.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum(low).alias("total"), F.sum(low * low).alias("squares")))
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    whole = hosts.agg(F.sum("total"), F.sum("n")).first()
    overall = (whole[0] or 0) / max(whole[1] or 0, 1) / MILLION
    k_host, k_path = _weight(hosts), _weight(paths)
    above = hosts.select(F.col("host").alias("_host"), F.col("n").alias("_host_n"),
                         F.col("total").alias("_host_total"))
    sums = paths.join(broadcast_if_small(above), F.expr("host <=> _host")).select(
        "_host", F.col("path").alias("_path"), "_host_n", "_host_total",
        F.col("n").alias("_path_n"), F.col("total").alias("_path_total"))
    return Sites(cut(sums), overall, k_host, k_path)


def posteriors(rows: DataFrame, known: Sites) -> DataFrame:
    """Rows (host, path, low, ...) with host_mean, path_mean and ``quality`` (0 to 1).

    A row's own evidence is taken out of its site's sums: it counts once, as evidence.
    """
    safe = lambda p: F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    odds = lambda p: F.log(safe(p) / (1 - safe(p)))
    rest = lambda level, k, above: (
        (F.col(f"_{level}_total") - F.col("low")) / MILLION + k * above) / (
        F.col(f"_{level}_n") - 1 + k)
    joined = rows.join(broadcast_if_small(known.sums),
                       F.expr("host <=> _host and path <=> _path"))
    joined = joined.withColumn("host_mean", rest("host", known.k_host, F.lit(known.overall)))
    joined = joined.withColumn("path_mean", rest("path", known.k_path, F.col("host_mean")))
    logit = odds(F.col("low") / MILLION) + odds(F.col("path_mean")) - odds(F.lit(known.overall))
    return joined.withColumn("quality", F.round(1 / (1 + F.exp(logit)), 6)).drop(
        *known.sums.columns)


def _site(host: str, path: str) -> dict[str, Column]:
    return {"host": F.col(f"`{host}`").cast("string"), "path": F.col(f"`{path}`").cast("string")}


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """key, host, path, evidence (of low quality), host_mean, path_mean, quality, keep."""
    model = learn(docs, labels, key=key, text=text)
    rows = cut(evidence(docs, model, {"key": F.col(key), **_site(host, path)}, text))
    return posteriors(rows, sites(rows)).select(
        F.col("key").alias(key), "host", "path", (F.col("low") / MILLION).alias("evidence"),
        F.round("host_mean", 6).alias("host_mean"), F.round("path_mean", 6).alias("path_mean"),
        "quality", (F.col("quality") >= threshold).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             host: str = "source", path: str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    Sites are summed up in one scan over thin rows; a second scan scores the texts again beside
    the whole rows, which is cheaper than writing them out or joining them back.
    """
    model = learn(docs, labels, key=key, text=text)
    known = sites(evidence(docs, model, _site(host, path), text, 1 << 20))
    rows = evidence(docs, model, {
        **_site(host, path), "row": F.struct(*(F.col(f"`{c}`") for c in docs.columns))}, text, 1 << 20)
    return posteriors(rows, known).filter(F.col("quality") >= threshold).select("row.*")
