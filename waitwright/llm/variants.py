"""Spelling variants: asymmetric q-chunks propose word pairs one edit apart, the rest decides.

Of two words one edit apart, the shorter one (of equal lengths: the smaller one) is cut into two
disjoint chunks. The edit lies in one half, so the other chunk comes in the longer word as a gram
of its length, shifted by one code point at most. The half with the edit and its counterpart are
again two words one edit apart, cut into two chunks of which one is preserved, and so on until the
part with the edit has at most three code points (or four times, for words beyond 48). The chunks
preserved on the way are joined as one key, so few words share it however many words there are.

The longer word contributes its positional grams for partners of its own length and of one code
point less; grams that no chunk within shift one can meet are left out. Candidates share the key;
then the chunks are compared as texts and the parts between them must be one edit apart. A pair
that several keys find is reported for the first only, without a shuffle.

A word's form is its near word of largest count (ties: smallest), if ten times as frequent. Counts
rise along forms, so chains end; they are followed by doubling. A form shared by many words is
joined apart.

Defined cases: a null or empty text has no words; a null key is written as nothing before the
colon of the checksum; rows that repeat a key count singly; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import cut
from waitwright.skew import join_unique

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
SLIP = 31
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Distinct words a task holds before it hands their counts on.
HELD = 200_000


def slipped(word: str, checksum: int) -> str:
    """The word, one code point short where the checksum says so."""
    if checksum % SLIP:
        return word
    at = checksum % len(word)
    return word[:at] + word[at + 1:]


def vocabulary(df: DataFrame, key: str = "doc_id", text: str = "text", slips: bool = False,
               least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): lower-cased runs of letters and their occurrences in all texts.

    ``slips`` plants misspellings: a run whose checksum with the row's key is a multiple of 31
    loses a code point in that row.
    """
    run = re.compile(f"[{LETTERS}]{{{least_letters},}}")

    def task(batches):
        held: dict[str, int] = {}
        for batch in batches:
            for id_, data in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{'' if id_ is None else id_}:".encode())
                mine: dict[str, int] = {}
                for word in run.findall((data or b"").translate(LOWER).decode()):
                    mine[word] = mine.get(word, 0) + 1
                for word, n in mine.items():
                    if slips:
                        word = slipped(word, zlib.crc32(word.encode(), start))
                        if len(word) < least_letters:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield counted(held)
                    held = {}
        yield counted(held)

    def counted(held: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
            names=["word", "n"])

    rows = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    return (rows.mapInArrow(task, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count))


def parts_of(length: Column) -> Column:
    """Parts a word of this length is cut into: halves of halves."""
    return (F.when(length <= 6, 2).when(length <= 12, 4).when(length <= 24, 8).otherwise(16))


def _cuts(words: DataFrame, shift: int) -> DataFrame:
    """One row per word and part: all but the part, as a key, for chunk words ``shift`` shorter."""
    size = F.length("word") - shift
    return (
        words.withColumn("size", size).withColumn("parts", parts_of(F.col("size")))
        .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
        .withColumn("low", F.expr("int(part * size div parts)"))
        .withColumn("high", F.expr("int((part + 1) * size div parts)"))
        .withColumn("head", F.expr("left(word, low)"))
        .withColumn("tail", F.expr(f"substring(word, high + {shift} + 1)"))
        .withColumn("key", F.xxhash64("size", "part", "head", "tail")))


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words (word, n) exactly one edit apart, each once."""
    chunks = _cuts(words, 0).select(
        "key", "size", "part", "low", "high", F.col("word").alias("a"), F.col("n").alias("n_a"))
    grams = [_cuts(words, shift).select("key", F.lit(shift).alias("shift"),
                                        F.col("word").alias("b"), F.col("n").alias("n_b"))
             for shift in (0, 1)]
    met = chunks.join(grams[0].unionByName(grams[1]), "key").filter("shift = 1 or a < b")
    first_only = "part = 0 or substring(a, low + 1) <> substring(b, low + shift + 1)"
    middle = ("levenshtein(substring(a, low + 1, high - low), "
              "substring(b, low + 1, high - low + shift)) = 1")
    return met.filter(
        "length(a) + shift = length(b) and left(a, low) = left(b, low)"
        " and substring(a, high + 1) = substring(b, high + shift + 1)"
    ).filter(first_only).filter(middle).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): forms followed to the last one, by doubling."""
    up = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        # Most forms are no variants themselves, so the table of further steps shrinks.
        ends = up.select("root").distinct()
        further = cut(ends.join(up.select(F.col("word").alias("root"), F.col("root").alias("far")),
                                "root"))
        if further.isEmpty():
            return up
        up = cut(join_unique(up, further, ["root"], "left")
                 .select("word", F.coalesce("far", "root").alias("root")))


def groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word (word, n): form, root, n, n_near, form_n."""
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), (-F.col("n_b")).alias("rank"), F.col("b").alias("near")),
        F.struct(F.col("b").alias("word"), (-F.col("n_a")).alias("rank"), F.col("a").alias("near"))
    )).alias("p")).select("p.*")
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct("rank", "near")).alias("best"))
    taken = -F.col("best.rank") >= ratio * F.col("n")
    judged = cut(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(taken, F.col("best.near")).alias("form"),
        F.when(taken, -F.col("best.rank")).alias("form_n")))
    ends = roots(judged.filter("form is not null"))
    return judged.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def find(df: DataFrame, key: str = "doc_id", text: str = "text", slips: bool = False) -> DataFrame:
    """Variant groups of all words of at least seven letters that occur twice."""
    return groups(cut(vocabulary(df, key, text, slips)))
