"""Interleave sources by target weights with Pfair scheduling, in DataFrame operations only.

Each source is cut into blocks of ``block_chars`` characters. Weights are rounded to q/Q by
largest remainder. Block j (from 0) of a source with weight w may start at slot floor(j/w) and
must be placed before slot ceil((j+1)/w); in every slot the released block with the earliest
deadline goes first (then the one with the larger weight, then the smaller name). Shares then
never differ from the target q/Q by a block or more, in any prefix.

The period Q follows from the weights: it is the number of slots until every source has been
played once, at most ``most_slots``; so in a stream of at most that many slots no weight is
rounded up by more than a block in all, and in a longer one weights below 1/most_slots count as
that. The schedule repeats every Q slots, and blocks find their slot by division.

Schedules have two levels. A source of at least 1/64 of the weight, and every one of up to 64
sources, is a pool of its own; the others share pools of about 64, which are scheduled like
sources and hand their slots on by the same rule. A pool is one row of Q steps, so no row holds
all sources, however many there are. A source in a shared pool may differ by one block plus its
share of the pool.

The order within a source is pseudo-random but fixed: by a digest of the id (of the text where the
id is null), then the id. Running lengths come from three levels, so no source is ever in one task.
The stream ends when every source has been played through once; sources with too little text for
their share are played again, as often as the stream needs (``epoch``), unless ``max_epochs`` says
otherwise. Every row is placed at least once, none is dropped.

Defined cases: a null source is a source of its own; a source without a given weight has the
least one; a null or empty text counts as one character, so it too has a place; rows that repeat an
id keep their number of rows, in the order of their text; an empty table gives an empty result;
input columns sit in a struct meanwhile, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waitwright.lineage import broadcast_if_small, cut
from waitwright.skew import join_unique

MOST_SLOTS = 8192
BLOCK_CHARS = 65_536
CHUNK_ROWS = 512
CHUNKS = 4096       # chunks that are summed in one task
EXPONENT = 0.9
POOL = 64           # sources scheduled in one row


def digest32(value: Column) -> Column:
    """First 32 bits of the MD5 of a value's text; null counts as an empty text."""
    return F.conv(F.left(F.md5(F.coalesce(value.cast("string"), F.lit(""))), F.lit(8)), 16, 10
                  ).cast("bigint")


def apportion(shares: DataFrame, by: str, name: str) -> DataFrame:
    """Adds q (slots of ``period``, one at least) and _i (number by falling q) within ``by``."""
    group = Window.partitionBy(by)
    ideal = F.col("raw") / F.sum("raw").over(group) * (F.col("period") - F.count("*").over(group))
    rest = group.orderBy(F.desc(F.round(F.col("ideal") - F.floor("ideal"), 9)), name)
    return (
        shares.withColumn("ideal", ideal).withColumn("base", F.floor("ideal") + 1)
        .withColumn("left", F.col("period") - F.sum("base").over(group))
        .withColumn("q", F.col("base") + (F.row_number().over(rest) <= F.col("left"))
                    .cast("bigint"))
        .withColumn("_i", F.row_number().over(group.orderBy(F.desc("q"), name)) - 1)
        .drop("ideal", "base", "left"))


def weigh(sizes: DataFrame, weights: dict[str, float] | None, most_slots: int, block_chars: int
          ) -> tuple[DataFrame, DataFrame]:
    """Sources (_s, chars, rows, blocks, pool, q, period, _i) and pools (the same with raw).

    Without ``weights`` a source's share is its size to the power 0.9, which lifts small sources
    a little. Only totals reach the driver.
    """
    if weights is None:
        raw = F.pow(F.col("chars").cast("double"), F.lit(EXPONENT))
    else:
        pairs = [F.lit(x) for name, weight in weights.items() for x in ("s" + name, float(weight))]
        raw = F.coalesce(F.try_element_at(F.create_map(*pairs), "_s"), F.lit(0.0)) if pairs else \
            F.lit(0.0)
    listed = cut(sizes.withColumn("raw", raw))
    total, count = listed.agg(F.coalesce(F.nullif(F.sum("raw"), F.lit(0.0)), F.lit(1.0)),
                              F.count("*")).first()
    listed = listed.withColumn("raw", F.greatest("raw", F.lit(total / most_slots)))
    alone = (F.col("raw") >= F.lit(total / POOL)) if count > POOL else F.lit(True)
    shared = F.concat(F.lit("p"), F.pmod(F.xxhash64("_s"), F.lit(-(-count // POOL) or 1))
                      .cast("string"))
    listed = (
        listed.withColumn("blocks", F.ceil(F.col("chars") / F.lit(block_chars)).cast("bigint"))
        .withColumn("need", F.ceil(F.round(F.col("chars") * F.lit(total)
                                           / (F.lit(float(block_chars)) * F.col("raw")), 6)))
        .withColumn("pool", F.when(alone, F.col("_s")).otherwise(shared)))
    # One row per pool: at most 64 and one for every 64 sources.
    slots, pools = listed.agg(F.max("need"), F.count_distinct("pool")).first()
    period = max(4 * pools, min(int(slots or 1), most_slots))
    outer = cut(apportion(listed.groupBy("pool").agg(F.sum("raw").alias("raw"),
                                                     F.count("*").alias("members"))
                          .withColumns({"period": F.lit(period).cast("bigint"), "all": F.lit(0)}),
                          "all", "pool"))
    inner = cut(apportion(
        listed.withColumn("members", F.count("*").over(Window.partitionBy("pool")))
        .withColumn("period", F.when(F.col("members") == 1, 1).otherwise(8 * F.col("members"))
                    .cast("bigint")), "pool", "_s"))
    return inner, outer


def period_of(shares: DataFrame, by: str = "period") -> DataFrame:
    """(by, _i, _nth, _slot): one period of each group of shares, earliest deadline first."""
    listed = shares.groupBy(*dict.fromkeys((by, "period"))).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_i", "q"))), lambda t: t["q"])
        .alias("quota"))
    begin = F.struct(F.transform("quota", lambda q: F.lit(0).cast("bigint")).alias("done"),
                     F.array().cast("array<int>").alias("picks"))

    def step(state: Column, slot: Column) -> Column:
        options = F.zip_with(state["done"], F.col("quota"), lambda n, q: F.when(
            F.floor(n * F.col("period") / q) <= slot, F.ceil((n + 1) * F.col("period") / q)))
        # Sources are numbered by falling weight, then name: the first of equal deadlines wins.
        best = (F.array_position(options, F.array_min(options)) - 1).cast("int")
        return F.struct(
            F.transform(state["done"], lambda n, i: n + (i == best).cast("bigint")).alias("done"),
            F.concat(state["picks"], F.array(best)).alias("picks"))

    picks = listed.select(by, F.posexplode(F.aggregate(
        F.sequence(F.lit(0).cast("bigint"), F.col("period") - 1), begin, step)["picks"])
        .alias("_slot", "_i"))
    nth = F.row_number().over(Window.partitionBy(by, "_i").orderBy("_slot")) - 1
    return picks.select(by, "_i", nth.cast("bigint").alias("_nth"), F.col("_slot").cast("bigint"))


def running_starts(chunked: DataFrame, by: str) -> DataFrame:
    """(by, _c, _before): characters of a source before each of its chunks."""
    per_chunk = chunked.groupBy(by, "_c").agg(F.sum("_n").alias("chars")).withColumn(
        "_b", F.floor(F.col("_c") / F.lit(CHUNKS)))
    before = lambda *keys: (Window.partitionBy(*keys[:-1]).orderBy(keys[-1])
                            .rowsBetween(Window.unboundedPreceding, -1))
    bands = per_chunk.groupBy(by, "_b").agg(F.sum("chars").alias("band"))
    bands = bands.select(by, "_b", F.coalesce(F.sum("band").over(before(by, "_b")), F.lit(0))
                         .alias("_ahead"))
    within = F.coalesce(F.sum("chars").over(before(by, "_b", "_c")), F.lit(0))
    return per_chunk.select(by, "_b", "_c", within.alias("_within")).join(bands, [by, "_b"]).select(
        by, "_c", (F.col("_ahead") + F.col("_within")).alias("_before"))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS,
        most_slots: int = MOST_SLOTS, max_epochs: int | None = None,
        carry: tuple[str, ...] | None = None) -> DataFrame:
    """Columns ``carry`` (default: all) of each row, once per epoch, and how it was scheduled.

    Result: ``row`` (struct of the carried columns), ``epoch``, ``block`` (in the source's
    stream), ``slot``, ``start`` (characters before the row in its source). Order by slot, start
    and epoch for the mixed stream.
    """
    carried = df.columns if carry is None else carry
    name = F.col(source).cast("string")
    order_by = F.coalesce(F.col(key).cast("string"), F.col(text))
    rows = df.select(
        F.struct(*(F.col(f"`{c}`") for c in carried)).alias("row"),
        F.when(name.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), name)).alias("_s"),
        F.col(key).alias("_k"),
        F.greatest(F.lit(1), F.length(F.coalesce(F.col(text), F.lit("")))).cast("bigint")
        .alias("_n"), digest32(order_by).alias("_h"), F.xxhash64(text).alias("_t"))
    sizes = rows.groupBy("_s").agg(F.sum("_n").alias("chars"), F.count("*").alias("rows"))
    inner, outer = weigh(sizes, weights, most_slots, block_chars)
    slots = outer.select("pool", F.col("q").alias("pool_q"), F.col("period").alias("pool_period"),
                         F.col("_i").alias("_pool"))
    # Slots of a pool until the source has been played, then slots of the stream.
    played_by = F.ceil(F.ceil(F.col("blocks") * F.col("period") / F.col("q"))
                       * F.col("pool_period") / F.col("pool_q"))
    sources = cut(inner.join(slots, "pool"))
    horizon = int(sources.agg(F.max(played_by)).first()[0] or 0)
    known = sources.select("_s", "_i", "_pool", "pool", "rows", "blocks", "q", "period", "pool_q",
                           "pool_period", (F.col("members") > 1).alias("shared"))
    chunks = F.greatest(F.lit(1), F.ceil(F.col("rows") / CHUNK_ROWS)).cast("bigint")
    chunked = join_unique(rows, known, ["_s"], "inner").withColumn(
        "_c", F.floor(F.col("_h") * chunks / F.lit(float(1 << 32))))
    inside = (Window.partitionBy("_s", "_c").orderBy("_h", "_k", "_t")
              .rowsBetween(Window.unboundedPreceding, -1))
    within = chunked.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    placed = within.join(running_starts(chunked, "_s"), ["_s", "_c"]).withColumn(
        "start", F.col("_before") + F.col("_in"))
    turns = F.ceil(F.lit(horizon) * F.col("pool_q") / F.col("pool_period")) + 1
    epochs = F.ceil((turns * F.col("q") / F.col("period") + 1) / F.col("blocks")) + 1
    if max_epochs is not None:
        epochs = F.least(F.lit(max_epochs), epochs)
    played = (
        placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs.cast("int") - 1)))
        .withColumn("block", F.col("epoch") * F.col("blocks")
                    + F.floor(F.col("start") / F.lit(block_chars)))
        .withColumn("_nth", F.col("block") % F.col("q")))
    kept = ["row", "epoch", "block", "start", "pool_q", "pool_period", "_pool"]
    turn = (F.floor(F.col("block") / F.col("q")) * F.col("period") + F.col("_slot")).alias("turn")
    alone = played.filter("not shared").select(*kept, F.col("block").alias("turn"))
    in_pools = broadcast_if_small(cut(period_of(inner.filter("members > 1"), "pool")))
    together = played.filter("shared").join(in_pools, ["pool", "_i", "_nth"]).select(*kept, turn)
    # One row per slot of the outer period.
    outer_slots = broadcast_if_small(cut(period_of(outer).select(
        F.col("_i").alias("_pool"), F.col("_nth").alias("_turn"), "_slot")))
    return (
        alone.unionByName(together).withColumn("_turn", F.col("turn") % F.col("pool_q"))
        .join(outer_slots, ["_pool", "_turn"])
        .withColumn("slot", F.floor(F.col("turn") / F.col("pool_q")) * F.col("pool_period")
                    + F.col("_slot"))
        .filter(F.col("slot") < F.lit(horizon)).select("row", "epoch", "block", "slot", "start"))
