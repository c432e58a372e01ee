"""Language-model scores from a probabilistic suffix tree, beside a unigram base.

A text is a sequence of words, then one end. The tree reads it as bytes: every word and a space,
then a newline; a newline also stands before the first word. So no word is unknown, and the
probabilities of all texts sum to one.

Learning counts, over all learning rows, each byte with up to ``DEPTH`` bytes before it. A context
is a candidate if it occurs ``LEAST`` times, in a corpus of any size. A candidate stays if its
next-byte distribution diverges from that of its parent (the context less its first byte): count
times Kullback-Leibler divergence of ``GAIN`` nats for each byte seen after it. Parents of
contexts that stay, stay; nothing bounds their number unless ``SHARE`` or ``MOST_STATES`` is set.
Distributions are smoothed towards the parent's, the root's towards
uniform. A byte's probability comes from the longest suffix of what precedes it that is a state.

A tree of at most ``SHIPPED_STATES`` goes to every task. A larger one stays a table: the distinct
byte grams of all rows meet its states by joins, one length after the other. The most frequent
grams, at most 2^21, are then looked up in the scan; the rest of each text is joined by shuffle.
Both ways give the same scores.

The base: sum of log10((c + 0.5) / (N + 0.5 * (V + 1))) over tokens. Words are counted under 64-bit
numbers (``words``). Frequent words, at most 2^20, are looked up in the scan; the rest of each
text is joined with the counts by shuffle.

Defined cases: a null text is empty, and an empty one is only its end; a null id counts as an
empty text in the split; rows that repeat an id are scored and counted one by one; without
learning rows the tree is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waitwright.lineage import cut
from waitwright.llm.words import FACTOR, SPACED, Words, pieces

DEPTH = 6            # at most 6: a gram is one whole number
SHARE = 0.0          # share of all bytes that a context needs as well
MOST_STATES = None   # bound of the states, for callers that want a tree of bounded size
LEAST = 8            # occurrences that a context needs
GAIN = 1.0
WEIGHT = 1.0         # bytes' worth of belief in the parent
FREQUENT = 1 << 20
FREQUENT_GRAMS = 1 << 21
SLOTS = 1 << 23      # places of frequent grams in a task's table
SHIPPED_STATES = 30_000  # plan only
STRETCH = 256        # symbols that are walked in step
MERGE_ROWS = 1 << 20  # counts that wait in a task before they are merged
HELD_ROWS = 1 << 21   # sums that a task holds before it hands them on
SPACE, END = 32, 10


def held_out(key: Column, folds: int = 5) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % folds == 1


def symbols(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, each row closed by END, and where each row begins."""
    lengths = words.ends - words.starts
    inside = words.data != 0
    size = np.add.reduceat(np.r_[lengths + 1, 0], words.rows[:-1]) * (words.counts > 0) \
        if len(words.counts) else np.zeros(0, np.int64)
    firsts = np.r_[0, np.cumsum(size + 1)].astype(np.int64)
    out = np.full(firsts[-1], END, np.uint8)
    is_end = np.zeros(len(out), bool)
    is_end[firsts[1:] - 1] = True
    spaces = np.cumsum(lengths + 1) - 1 + words.row_of
    out[spaces] = SPACE
    free = ~is_end
    free[spaces] = False
    out[free] = words.data[inside]
    return out, firsts


def grams(sequence: np.ndarray, firsts: np.ndarray, depth: int) -> np.ndarray:
    """Each symbol with ``depth`` symbols before it in its row, oldest highest; 0 where none is."""
    out, width = sequence.astype(np.uint64), 1
    while width <= depth:  # the symbols seen so far, and as many before them
        out[width:] |= out[:-width] << np.uint64(8 * width)
        width *= 2
    out &= np.uint64((1 << 8 * (depth + 1)) - 1)
    starts, sizes = firsts[:-1], np.diff(firsts)
    for age in range(depth):  # the first symbols of a row have END and nothing before them
        at, below = starts[sizes > age] + age, 8 * (age + 1)
        out[at] = (out[at] & np.uint64((1 << below) - 1)) | np.uint64(END << below)
    return out


class Tally:
    """Sums of counts by key, kept sorted; new counts wait until there are enough to merge."""

    def __init__(self):
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.waiting = 0

    def add(self, values: np.ndarray) -> None:
        keys, counts = np.unique(values, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts.astype(np.int64))
        self.waiting += len(keys)
        if self.waiting > MERGE_ROWS:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([np.zeros(0, np.uint64), *self.keys])
        counts = np.concatenate([np.zeros(0, np.int64), *self.counts])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        fresh = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][:len(keys)])
        self.keys = [keys[fresh]]
        self.counts = [np.add.reduceat(counts, fresh) if len(fresh) else counts]
        self.waiting = 0
        return self.keys[0], self.counts[0]

    def give(self, kind: int):
        """All sums so far as batches; starts anew."""
        keys, counts = self.merge()
        self.keys, self.counts = [], []
        for a in range(0, len(keys), 1 << 16):
            part = keys[a:a + (1 << 16)].view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), kind, np.int8)), pa.array(part),
                 pa.array(counts[a:a + (1 << 16)])], names=["kind", "key", "n"])


def count_all(df: DataFrame, depth: int) -> DataFrame:
    """(kind, key, n): kind 0 words by number, 1 byte grams, 2 the number of rows (key 0).

    Tasks sum up what they read before it is shuffled, in bounded memory.
    """

    def task(batches):
        tallies = [Tally() for _ in range(3)]
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                words = Words(piece.column("text"), SPACED)
                sequence, firsts = symbols(words)
                for tally, values in zip(tallies, (
                        words.hashes, grams(sequence, firsts, depth),
                        np.zeros(piece.num_rows, np.uint64))):
                    tally.add(values)
            for kind, tally in enumerate(tallies):
                if sum(map(len, tally.keys)) > HELD_ROWS:
                    yield from tally.give(kind)
        for kind, tally in enumerate(tallies):
            yield from tally.give(kind)

    return df.mapInArrow(task, "kind byte, key long, n long").groupBy("kind", "key").agg(
        F.sum("n").alias("n"))


def contexts(counted: DataFrame, depth: int = DEPTH, share: float = SHARE, least: int = LEAST,
             gain: float = GAIN) -> DataFrame:
    """(length, context, symbol, n, total) of the states; the root has length 0 and context 0."""
    context = F.shiftright("gram", 8)
    level, by_gram = counted.filter("kind = 1").select(F.col("key").alias("gram"), "n"), None
    for d in range(depth, -1, -1):
        if d < depth:
            level = cut(level.groupBy(F.col("gram").bitwiseAND((1 << 8 * (d + 1)) - 1)
                                      .alias("gram")).agg(F.sum("n").alias("n")))
        # The first bytes of a row have fewer before them.
        full = level.filter(F.shiftright("gram", 8 * d) > 0).select(
            F.lit(d).alias("length"), "gram", "n")
        by_gram = full if by_gram is None else by_gram.unionByName(full)
    totals = by_gram.groupBy("length", context.alias("context")).agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"))
    whole = totals.filter("length = 0").agg(F.sum("total")).first()[0] or 0
    large = cut(totals.filter((F.col("length") == 0)
                              | (F.col("total") >= max(float(least), share * whole))))
    rows = cut(by_gram.withColumn("context", context).join(
        large, ["length", "context"]).select(
        "length", "context", F.col("gram").bitwiseAND(255).alias("symbol"), "n", "total", "kinds"))
    mask = F.element_at(F.array(*(F.lit((1 << 8 * d) - 1) for d in range(depth + 1))),
                        F.col("length"))
    parent = rows.select((F.col("length") + 1).alias("length"), F.col("context").alias("parent"),
                         "symbol", (F.col("n") / F.col("total")).alias("expected"))
    test = rows.filter("length > 0").withColumn("parent", F.col("context").bitwiseAND(mask)).join(
        parent, ["length", "parent", "symbol"], "left")
    kept = test.groupBy("length", "context", "kinds").agg(F.sum(
        F.col("n") * F.log(F.col("n") / F.col("total") / F.col("expected"))).alias("nats")).filter(
        F.col("nats") >= gain * F.col("kinds"))
    suffix = F.explode(F.sequence(F.lit(1), F.col("length")))
    closed = kept.select("context", suffix.alias("length")).select(
        "length", F.expr("context & (shiftleft(1L, 8 * length) - 1)").alias("context")).distinct()
    sized = cut(closed.join(large.select("length", "context", "total"), ["length", "context"]))
    if MOST_STATES is not None:
        share = max(share, least / max(whole, 1))
        while sized.filter(F.col("total") >= share * whole).count() > MOST_STATES:
            share *= 2
    # A suffix is as frequent as the whole at least, so what is left still has all its parents.
    states = sized.filter(F.col("total") >= share * whole).select("length", "context")
    columns = ["length", "context", "symbol", "n", "total"]
    return rows.filter("length = 0").select(columns).unionByName(
        rows.join(states, ["length", "context"], "left_semi").select(columns))


def gram_scores(states: DataFrame, grams_: DataFrame, depth: int = DEPTH,
                weight: float = WEIGHT) -> DataFrame:
    """(key, score): log10 probability of the last byte of each gram, by its longest state.

    One length after the other: a suffix of a state is a state, so what a gram had at the length
    before is its parent's probability, and stays where the longer context is no state.
    """
    wanted = [grams_.select(F.col("key").alias("gram"))]
    for d in range(depth - 1, -1, -1):
        wanted.append(cut(wanted[-1].select(
            F.col("gram").bitwiseAND((1 << 8 * (d + 1)) - 1).alias("gram")).distinct()))
    below = None
    for d, near in enumerate(reversed(wanted)):
        rows = states.filter(F.col("length") == d)
        seen = rows.select(
            F.shiftleft("context", 8).bitwiseOR(F.col("symbol")).alias("gram"), "n")
        sizes = rows.groupBy("context").agg(F.first("total").alias("total"))
        if below is None:
            near = near.withColumn("p", F.lit(1 / 256))
        else:
            near = near.withColumn(
                "shorter", F.col("gram").bitwiseAND((1 << 8 * d) - 1)).join(below, "shorter")
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise(
            (F.coalesce("n", F.lit(0)) + weight * F.col("p")) / (F.col("total") + weight))
        below = cut(near.withColumn("context", F.shiftright("gram", 8))
                    .join(sizes, "context", "left").join(seen, "gram", "left")
                    .select(F.col("gram").alias("shorter"), p.alias("p")))
    return below.select(F.col("shorter").alias("key"), F.log10("p").alias("score"))


def most_frequent(answers: DataFrame, most: int) -> DataFrame:
    """The grams that occur more often than some number, so that at most ``most`` remain."""
    step = F.floor(F.log2("n") * 8)
    sizes = sorted(answers.groupBy(step.alias("step")).count().collect(), reverse=True)
    left, least = most, None
    for r in sizes:
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return answers.filter(F.lit(False) if least is None else step >= least)


class Grams:
    """Scores of frequent grams by slots; of grams that share a slot the most frequent has it."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray, counts: np.ndarray):
        order = np.argsort(counts, kind="stable")  # of equal slots the last one stays
        self.keys, self.scores = keys[order], scores[order].astype(np.float32)
        self.slots = None

    def __getstate__(self):
        return self.keys, self.scores, None

    def __setstate__(self, state):
        self.keys, self.scores, self.slots = state

    @staticmethod
    def _slot(values: np.ndarray) -> np.ndarray:
        shift = np.uint64(64 - (SLOTS.bit_length() - 1))
        return ((values * FACTOR) >> shift).astype(np.int64)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score of each value, 0 where there is none, and whether there is one."""
        if self.slots is None:
            at = self._slot(self.keys)
            keys, scores = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.float32)
            keys[at], scores[at] = self.keys, self.scores
            self.slots, self.keys, self.scores = (keys, scores), None, None
        keys, scores = self.slots
        at = self._slot(values)
        found = keys[at] == values
        return np.where(found, scores[at], np.float32(0)).astype(np.float64), found


class Tree:
    """States of the tree and the automaton that finds the longest one at each symbol."""

    def __init__(self, length, context, symbol, n, weight: float = WEIGHT):
        order = np.lexsort((symbol, context, length))
        length, context, symbol, n = (np.asarray(x)[order] for x in (length, context, symbol, n))
        used = np.unique(np.r_[symbol, SPACE, END]).astype(np.int64)
        self.rank = np.full(256, len(used), np.int64)   # one more rank for bytes never seen
        self.rank[used] = np.arange(len(used))
        self.width = len(used) + 1
        unseen = 256 - len(used)
        uniform = np.full(self.width, 1 / 256)
        uniform[-1] = unseen / 256
        state: dict[tuple[int, int], int] = {(0, 0): 0}
        bounds = np.flatnonzero(np.r_[True, (np.diff(length) != 0) | (np.diff(context) != 0), True]) \
            if len(n) else np.zeros(1, np.int64)
        table = np.tile(uniform, (len(bounds), 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            d, c = int(length[a]), int(context[a])
            prior = uniform if d == 0 else table[state[d - 1, c & ((1 << 8 * (d - 1)) - 1)]]
            row = prior * weight
            row[self.rank[symbol[a:b]]] += n[a:b]
            at = state.setdefault((d, c), len(state))
            table[at] = row / row.sum()
        self.states = state
        # A byte never seen has its share of the last rank.
        table[:, -1] /= max(unseen, 1)
        self.logs = np.log10(table).astype(np.float32)
        self.depth = max(d for d, _ in state)
        self._automaton()

    def _automaton(self) -> None:
        children: list[dict[int, int]] = [{}]
        best, rank = [0], self.rank
        texts = sorted(c.to_bytes(d, "big") for d, c in self.states if d)
        for text in texts:
            node = 0
            for byte in text:
                r = int(rank[byte])
                if r not in children[node]:
                    children[node][r] = len(children)
                    children.append({})
                    best.append(-1)
                node = children[node][r]
            best[node] = self.states[len(text), int.from_bytes(text, "big")]
        self.goto = np.zeros((len(children), self.width), np.int32)
        fail = np.zeros(len(children), np.int64)
        level = [0]
        while level:
            deeper = []
            for node in level:
                for r, child in children[node].items():
                    fail[child] = self.goto[fail[node], r] if node else 0
                    if best[child] < 0:
                        best[child] = best[fail[child]]
                    deeper.append(child)
                if node:
                    self.goto[node] = self.goto[fail[node]]
                for r, child in children[node].items():
                    self.goto[node, r] = child
            level = deeper
        self.best = np.array(best, np.int32)

    def score(self, sequence: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol of a joined sequence (rows closed by END).

        Stretches of the sequence are walked side by side, each led in by as many symbols as the
        longest state has; no state looks further back, and none past the start of a row.
        """
        depth = self.depth
        count = -(-len(sequence) // STRETCH)
        padded = np.full(depth + count * STRETCH, END, np.uint8)
        padded[depth:depth + len(sequence)] = sequence
        ranks = self.rank[padded].astype(np.int32)
        goto, logs, width = self.goto.ravel(), self.logs.ravel(), self.width
        starts = np.arange(count) * STRETCH
        state = np.zeros(count, np.int32)
        out = np.empty((STRETCH, count))
        for k in range(depth + STRETCH):
            symbol = ranks[starts + k]
            if k >= depth:
                out[k - depth] = logs[self.best[state] * width + symbol]
            state = goto[state * width + symbol]
        return out.T.ravel()[:len(sequence)]


def as_tree(states: DataFrame) -> Tree:
    rows = states.select("length", "context", "symbol", "n").toArrow()
    return Tree(*(c.to_numpy().astype(np.int64) for c in rows.columns))


def fit(counted: DataFrame, **settings) -> Tree:
    """Tree of the counts, on the driver: for small corpora or with ``MOST_STATES``."""
    return as_tree(contexts(counted, **settings))


def _rare(owner: np.ndarray, values: np.ndarray, size: int) -> tuple[pa.Array, pa.Array]:
    """Of each row the distinct values and how often it has them."""
    counted = pa.table({"o": owner, "v": values}).group_by(["o", "v"]).aggregate(
        [([], "count_all")]).sort_by("o")
    at = pa.array(np.searchsorted(counted["o"].to_numpy(), np.arange(size + 1)).astype(np.int32))
    return (pa.ListArray.from_arrays(at, counted["v"].combine_chunks()),
            pa.ListArray.from_arrays(at, counted["count_all"].combine_chunks().cast(pa.int32())))


def scores(df: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, learnt, n_tokens, n_known, train_tokens, base_score, score."""
    spark = df.sparkSession
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"), learn.alias("learnt"))
    depth = DEPTH
    counted = cut(count_all(source.filter("learnt").select("text"), depth))
    states = cut(contexts(counted))
    answers = None
    if states.select("length", "context").distinct().count() <= SHIPPED_STATES:
        model = as_tree(states)
    else:
        others = count_all(source.filter(~F.coalesce("learnt", F.lit(False))).select("text"), depth)
        every = cut(counted.unionByName(others).filter("kind = 1").groupBy("key").agg(
            F.sum("n").alias("n")))
        answers = cut(gram_scores(states, every, depth).join(every, "key"))
        often = most_frequent(answers, FREQUENT_GRAMS).select("key", "score", "n").toArrow()
        model = Grams(often["key"].to_numpy().view(np.uint64), often["score"].to_numpy(),
                      often["n"].to_numpy())
        del often
    counts = counted.filter("kind = 0").select(F.col("key").alias("word"), F.col("n").alias("c"))
    rows = counted.filter("kind = 2").agg(F.sum("n")).first()[0] or 0
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total, distinct = (total or 0) + rows, distinct + (rows > 0)
    divisor = total + 0.5 * (distinct + 1)
    least = max(1.0, total / FREQUENT)   # no more than FREQUENT words occur so often
    head = counts.filter(F.col("c") >= least).toArrow().sort_by("word")
    shipped = spark.sparkContext.broadcast((
        head["word"].to_numpy(), np.log10((head["c"].to_numpy() + 0.5) / divisor),
        model))
    end = float(np.log10((rows + 0.5) / divisor))
    schema = pa.schema([
        ("row", pa.int64()), ("key", pa.int64()), ("learnt", pa.bool_()), ("n_tokens", pa.int64()),
        ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
        ("words", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())),
        ("grams", pa.list_(pa.int64())), ("gram_times", pa.list_(pa.int32()))])

    def task(batches):
        words_at, logs, model = shipped.value
        for batch in batches:
            for piece in pieces(batch, "text", 2 << 20):
                words = Words(piece.column("text"), SPACED)
                sequence, firsts = symbols(words)
                rare_grams = pa.nulls(piece.num_rows, schema.field("grams").type), \
                    pa.nulls(piece.num_rows, schema.field("gram_times").type)
                if isinstance(model, Tree):
                    each = model.score(sequence)
                else:
                    values = grams(sequence, firsts, depth)
                    each, hit = model.find(values)
                    owner = np.repeat(np.arange(piece.num_rows), np.diff(firsts))
                    rare_grams = _rare(owner[~hit], values[~hit].view(np.int64), piece.num_rows)
                score = np.add.reduceat(each, firsts[:-1])
                hashes, owner = words.hashes.view(np.int64), words.row_of
                near = np.minimum(np.searchsorted(words_at, hashes), max(len(words_at) - 1, 0))
                known = words_at[near] == hashes if len(words_at) else np.zeros(len(hashes), bool)
                size = piece.num_rows
                base = end + np.bincount(owner[known], logs[near[known]], size)
                rare_words = _rare(owner[~known], hashes[~known], size)
                yield pa.RecordBatch.from_arrays([
                    piece.column("row"), piece.column("key"), piece.column("learnt"),
                    pa.array(words.counts.astype(np.int64) + 1),
                    pa.array(np.bincount(owner[known], minlength=size) + int(rows > 0)),
                    pa.array(base), pa.array(score), *rare_words, *rare_grams], schema=schema)

    scored = cut(source.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        task, "row long, key long, learnt boolean, n_tokens long, known long, base double, "
              "score double, words array<long>, times array<int>, grams array<long>, gram_times array<int>"))
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select(
        "row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = rare.join(counts.filter(F.col("c") < least), "word", "left")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.5) / F.lit(divisor))
    rest = found.groupBy("row").agg(
        F.sum(F.col("times") * log).alias("rest"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"))
    texts = scored.drop("words", "times", "grams", "gram_times").join(rest, "row", "left")
    score = F.col("score")
    if answers is not None:
        rare = scored.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("g"))
        tail = rare.select("row", F.col("g.grams").alias("key"),
                           F.col("g.gram_times").alias("times")).join(
            answers.select("key", F.col("score").alias("each")), "key").groupBy("row").agg(
            F.sum(F.col("times") * F.col("each")).alias("tail"))
        texts = texts.join(tail, "row", "left")
        score = score + F.coalesce("tail", F.lit(0.0))
    return texts.select(
        F.col("key").alias(key), "learnt", "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"),
        score.alias("score"))
