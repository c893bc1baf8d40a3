"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame and SQL operations only.

A document's size is its number of words. Each source's documents are dealt by hash into `blocks` blocks. The mix takes whole passes
over a source and, in a last pass, blocks in a permuted order until the source's target is met; in the block where it is met,
documents in a permuted order; of the document where it is met, as many words as are missing. How many blocks of each source every
output shard gets is decided by a tree over the shards: each node deals its quotas to its two sides as draws without replacement
would. A shard then holds its own, disjoint stretch of each source's permuted blocks, ordered by hash.

The tree works on a table with a row for each block and pass of a source (never documents), split over tasks; neither sources nor shards
are looped over on the driver. Words are counted once, and texts move once, to their shards. Rows of one document id in the block
where a source's target is met are put in order by one task (hashes and sizes, equal rows as one). Null text has size 0; such documents are in the result with nothing taken. Null source is a source of its own, the
last one. Repeated rows are documents of their own: where the last pass stops among rows of one id, source and text, it takes some of
them whole, one in part and the others not. An empty table gives no rows. Reruns give the same mix: all draws follow from `seed` and
the data. Other columns are ignored or carried, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, new_folder, sent, written
from tessera.llm.textstats import word_count
from tessera.operators.training import numbered

WEIGHTS = (1, 2, 3)
CAP = 3
#: The block in which a target is met is cut into 2**SLICE_BITS slices before its rows are put in order.
SLICE_BITS = 12


def _named(blocks: int, seed: int) -> list[Column]:
    """skey (the source, nulls apart), block, draw (order within a block) and the two keys that name a row by id, source and text."""
    whole = ["doc_id", "source", "text"]
    return [
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("skey"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(blocks)).cast("int").alias("block"),
        F.xxhash64(F.lit(seed + 1), F.col("doc_id")).alias("draw"),
        F.xxhash64(*whole).alias("k1"),
        F.xxhash64(F.lit(1), *whole).alias("k2"),
    ]


def sized(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """A row for each row of docs: its names, doc_id and size."""
    return docs.select("doc_id", *_named(blocks, seed), word_count(F.col("text")).alias("size"))


def source_targets(blocks: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """skey, source_size, weight, target of each source.

    A source stops at its cap where the level (what is left for a unit of weight) gives it more. The level only rises as sources stop,
    so it alone is carried from round to round; a round is one aggregate over the sources, and the last one stops none.
    """
    sizes = blocks.groupBy("skey").agg(F.sum("words").alias("source_size"))
    # null (empty key) last, the others by code point
    ranked = numbered(sizes.withColumn("last", F.col("skey") == ""), "last", "skey")
    weight = F.get(F.array(*[F.lit(w).cast("long") for w in weights]), F.pmod("number", F.lit(len(weights))))
    ranked = written(ranked.select("skey", "source_size", weight.alias("weight")), "weights")
    most, level, stopped = cap * F.col("source_size"), 0.0, -1
    while True:
        stops = F.lit(level) * F.col("weight") > most
        left = F.sum(F.when(stops, F.col("source_size") - most).otherwise(F.col("source_size")))
        share = F.sum(F.when(~stops, F.col("weight")))
        now = ranked.agg((left / share).alias("level"), F.count_if(stops).alias("n")).first()
        if now["n"] == stopped or now["level"] is None:
            break
        level, stopped = now["level"], now["n"]
    return ranked.withColumn("target", F.least(F.lit(level) * F.col("weight"), most.cast("double")))


def _leaf(place: Column, draws: Column, shards: int) -> Column:
    """The shard whose leaf holds a place among all draws: from the root down, a node's left half of its shards gets the first part of its
    places, in proportion to its shards (rounded down)."""
    depth = (shards - 1).bit_length()
    root = F.struct(F.lit(0).cast("long").alias("first"), draws.cast("long").alias("n"), F.lit(0).cast("long").alias("shard"), F.lit(shards).cast("long").alias("k"))

    def down(node: Column, _: Column) -> Column:
        near = F.floor(node["k"] / 2)
        n = F.floor(node["n"] * near / node["k"])
        left = place < node["first"] + n
        to_left = F.struct(node["first"].alias("first"), n.alias("n"), node["shard"].alias("shard"), near.alias("k"))
        to_right = F.struct((node["first"] + n).alias("first"), (node["n"] - n).alias("n"), (node["shard"] + near).alias("shard"), (node["k"] - near).alias("k"))
        return F.when(node["k"] == 1, node).when(left, to_left).otherwise(to_right)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, down, lambda node: node["shard"]).cast("int") if depth else F.lit(0)


def split_quotas(draws: DataFrame, shards: int, seed: int) -> DataFrame:
    """draws (skey, number: a row for each block and pass that a source gives) with `shard`, which gets so many blocks of the source.

    All draws are put in an order by hash, and the places are split down a binary tree over the shards. What a node holds is thus in
    random order, and its left side takes the first part of it: its counts of sources are a multivariate hypergeometric draw from its
    node's, and quotas are exact. Places are found by ranges; no task holds all draws, and the driver none.
    """
    lots = draws.select("skey", F.col("number").alias("item"), F.xxhash64(F.lit(seed), "skey", "number").alias("lot"))
    mixed = numbered(lots, "lot", "skey", "item")
    whole = mixed.agg(F.count(F.lit(1)).alias("whole"))
    dealt = mixed.crossJoin(F.broadcast(whole)).select("skey", "item", _leaf(F.col("number"), F.col("whole"), shards).alias("shard"))
    return dealt.withColumnRenamed("item", "number")


def placements(table: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """A row for each block of the sized table: skey, block, turn (its place in the source's permutation), words, last (words that the last
    pass takes), passes, source_size, target; in the block where the target is met also the rows (cut_draw, cut_k1, cut_k2) at which it
    is met, how many of these are taken whole (cut_whole) and how many words of the next one (cut_words)."""
    totals = written(table.groupBy("skey", "block").agg(F.sum("size").alias("words")), "blocks")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    targets = source_targets(totals, weights, cap).withColumn("passes", passes).withColumn("rest", F.floor("target").cast("long") - F.col("passes") * F.col("source_size"))
    source = Window.partitionBy("skey").orderBy("turn", "block")
    ahead = F.coalesce(F.sum("words").over(source.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    permuted = totals.join(targets, "skey").withColumn("turn", F.xxhash64(F.lit(seed + 2), "skey", "block")).select("*", ahead.alias("ahead"), (F.row_number().over(source) - 1).alias("place"))
    last = F.greatest(F.lit(0), F.least("words", F.col("rest") - F.col("ahead"))).cast("long")
    permuted = written(permuted.select("skey", "block", F.col("place").alias("turn"), "words", last.alias("last"), "passes", "source_size", "target"), "permuted")
    # One block of each source is cut, in one slice of its draws: only the slice's rows are put in order, equal ones as one.
    cut = permuted.filter("last > 0 and last < words").select("skey", "block", "last")
    inner = table.join(sent(cut), ["skey", "block"]).filter("size > 0").groupBy("skey", "block", "last", "draw", "k1", "k2", "size").agg(F.count(F.lit(1)).alias("n"))
    inner = written(inner.withColumn("slice", F.shiftright("draw", 64 - SLICE_BITS)), "cut-blocks")
    before = Window.partitionBy("skey", "block").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = inner.groupBy("skey", "block", "last", "slice").agg(F.sum(F.col("size") * F.col("n")).alias("held"))
    slices = slices.withColumn("missing", F.col("last") - F.coalesce(F.sum("held").over(before), F.lit(0))).filter("missing > 0 and missing <= held")
    inside = Window.partitionBy("skey", "block").orderBy("draw", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    within = inner.join(sent(written(slices.select("skey", "block", "slice", "missing"), "cut-slices")), ["skey", "block", "slice"])
    within = within.withColumn("over", F.col("missing") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    met = within.filter("over > 0 and over <= size * n").select("skey", "block", *[F.col(c).alias(f"cut_{c}") for c in ("draw", "k1", "k2")], F.expr("over div size").alias("cut_whole"), F.expr("over % size").alias("cut_words"))
    return written(permuted.join(met, ["skey", "block"], "left"), "placements")


def dealt(table: DataFrame, shards: int, seed: int) -> DataFrame:
    """table with `homes`: for each pass that takes the block, the shard that gets it.

    A source's shards, in order, stand against its blocks in the order of passes and turns: both are at most blocks times (cap + 1)
    rows of a source, whatever its size.
    """
    copies = F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))).alias("copy")
    draws = table.select("skey", "block", "turn", "passes", "last", copies).filter("copy < passes or last > 0")
    number = lambda *order: F.row_number().over(Window.partitionBy("skey").orderBy(*order))
    draws = written(draws.select("skey", "block", "copy", number("copy", "turn").alias("number")), "draws")
    quotas = split_quotas(draws.select("skey", "number"), shards, seed)
    quotas = quotas.select("skey", "shard", number("shard", "number").alias("number"))
    homes = draws.join(quotas, ["skey", "number"]).groupBy("skey", "block").agg(F.collect_list(F.struct("copy", "shard")).alias("homes"))
    return written(table.join(homes, ["skey", "block"]), "dealt")


def shards_of(docs: DataFrame, table: DataFrame, shards: int, blocks: int, seed: int) -> DataFrame:
    """The mixture by the placements in table; see mix."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", *_named(blocks, seed))
    rows = rows.filter(F.col("text").rlike(f"[^{SPACE}]")).drop("text").join(sent(dealt(table, shards, seed + 3)), ["skey", "block"])
    at, cut = F.struct("draw", "k1", "k2"), F.struct(F.col("cut_draw").alias("draw"), F.col("cut_k1").alias("k1"), F.col("cut_k2").alias("k2"))
    met = F.coalesce(at == cut, F.lit(False))
    # The last pass takes whole blocks, and of the block that it cuts the rows before the cut.
    home, last = F.col("home"), F.col("home.copy") == F.col("passes")
    takes = ~last | (F.col("last") >= F.col("words")) | ((F.col("last") > 0) & (at < cut))
    name = ["doc_id", "k1", "k2"]
    whole = rows.filter(~met).withColumn("home", F.explode("homes")).filter(takes).select(*name, home, F.lit(None).cast("long").alias("cut"), "row")
    # Of the rows at the cut (one id, source and text a source), each different one is taken as often as it is there.
    some = rows.filter(met).withColumn("json", F.to_json("row")).groupBy(*name, "passes", "cut_whole", "cut_words", "json").agg(F.first("row").alias("row"), F.first("homes").alias("homes"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("k1", "k2").orderBy("json").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumn("before", before).withColumn("home", F.explode("homes"))
    places = F.sequence(F.lit(0).cast("long"), F.when(last, F.least(F.col("n"), F.col("cut_whole") + 1 - F.col("before"))).otherwise(F.col("n")) - 1)
    some = some.filter(~last | (F.col("before") <= F.col("cut_whole"))).withColumn("place", F.explode(places))
    part = F.when(last & (F.col("before") + F.col("place") == F.col("cut_whole")), F.col("cut_words"))
    some = some.select(*name, home, part.alias("cut"), "row").filter("cut is null or cut > 0")
    place = F.xxhash64(F.lit(seed + 4), "doc_id", "home.copy")
    out = whole.unionByName(some).select("home.shard", place.alias("place"), *name, F.col("home.copy").alias("copy"), "cut", "row")
    return out.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "k1", "k2")


def mix(docs: DataFrame, shards: int = 16, blocks: int = 512, seed: int = 11) -> DataFrame:
    """The mixture itself: a row for each time a document is taken, with shard, copy, cut and row (the columns of docs).

    cut is null where the document is taken whole, else the number of its words that are taken. Rows of a shard come together, in an
    order by hash; task i holds shard i.
    """
    table = written(sized(docs, blocks, seed), "sized")
    return shards_of(docs, placements(table, seed), shards, blocks, seed)


def mix_report(docs: DataFrame, blocks: int = 512, seed: int = 11, shards: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs: what the shards of the mixture, written with their texts, hold of it.

    Without a number of shards there are as many as shuffle partitions.
    """
    docs = docs.select("doc_id", "source", "text")
    shards = shards or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    table = written(sized(docs, blocks, seed), "sized")
    plan = placements(table, seed)
    mixture = written(shards_of(docs, plan, shards, blocks, seed), "mixture")
    draws = mixture.groupBy("k1", "k2").agg(F.count_if(F.col("cut").isNull()).alias("whole"), F.coalesce(F.sum("cut"), F.lit(0)).alias("words"))
    sources = written(plan.select("skey", "source_size", "target").distinct(), "sources")
    # Equal rows share what is taken of them: each as many whole copies, some one more, and one the part.
    rows = table.groupBy("doc_id", "skey", "k1", "k2", "size").agg(F.count(F.lit(1)).alias("n")).join(draws, ["k1", "k2"], "left").na.fill(0, ["whole", "words"])
    rows = rows.withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    more = F.expr("whole % n")
    copies = F.expr("whole div n") + F.when(F.col("place") < more, 1).otherwise(0)
    taken = copies * F.col("size") + F.when(F.col("place") == more, F.col("words")).otherwise(0)
    return rows.join(sent(sources), "skey").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
