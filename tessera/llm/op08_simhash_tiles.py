"""SimHash near-dedup by tiled exact comparison.

A text's fingerprint has the majority of each bit over the XXH64 hashes of its 3-word shingles. Fingerprints within `RADIUS` = 3 bits
are linked. As three differing bits leave two of five stretches of bits unchanged, only fingerprints that share two stretches (about 25
bits, ten ways) are compared. A key with more than TILE fingerprints is cut into tiles by population count, and by hash where one
count alone fills several; a pair of tiles is a unit of work of its own, and pairs whose population counts differ beyond the radius
are left out before anything is shuffled. A unit compares all of one tile with all of the other, once, by numpy exclusive-or and bit
counts; each tile meets itself in one more unit. No pair within the radius is left out, and equal fingerprints are one.

A unit hands on a spanning forest of the links that it finds, not all pairs. Components follow by label propagation with pointer
jumping over written tables, which go when the next round has replaced them.

Null text counts as empty; texts without a word have fingerprint zero, which is linked like any other. Repeated rows get a row each.
A null doc_id is never the smallest unless a component has no other. An empty table gives no rows; other columns are ignored, or
carried by `representatives`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discarded, matched, sent, small_batches, text_groups, words_of, written

RADIUS = 3
#: Fingerprints in a tile, and rows that are compared at a time within a pair of tiles.
TILE = 2048
BLOCK = 256
#: Stretches of bits (first bit, number); three differing bits leave at least two of the five unchanged.
STRETCHES = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))


def fingerprints(data: np.ndarray, offsets: np.ndarray, width: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit fingerprint of each text."""
    starts, ends, firsts = words_of(data, offsets)
    n = len(offsets) - 1
    out = np.zeros(n, np.uint64)
    if not len(starts):
        return out
    upper = (data >= 65) & (data <= 90)
    low = np.where(upper, data + np.uint8(32), data)
    # The words with one space after each: a shingle is a range of bytes of this.
    lengths = ends - starts
    to = np.cumsum(lengths + 1) - lengths - 1
    spaced = np.full(int(lengths.sum()) + len(lengths), 32, dtype=np.uint8)
    index = np.repeat(starts - to, lengths + 1) + np.arange(len(spaced))
    solid = np.ones(len(spaced), dtype=bool)
    solid[to + lengths] = False
    spaced[solid] = low[index[solid]]
    raw = spaced.tobytes()
    counts = np.diff(firsts)
    shingles = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.repeat(firsts[:-1] - (np.cumsum(shingles) - shingles), shingles) + np.arange(int(shingles.sum()))
    last = np.minimum(at + width - 1, np.repeat(firsts[1:] - 1, shingles))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], seed) for a, b in zip(to[at].tolist(), (to[last] + lengths[last]).tolist(), strict=True)), np.uint64, len(at))
    edges = np.cumsum(shingles) - shingles
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    some = shingles > 0
    sums = np.add.reduceat(bits, edges[some], axis=0, dtype=np.int32)
    out[some] = np.packbits(2 * sums > shingles[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [fingerprints(data, offsets) for _, _, data, offsets in text_groups(batch)]
        found = np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(found)], names=["doc_id", "k1", "k2", "fp"])


def forest(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that it is connected to by the links left[i] - right[i]."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        label = label[label]
        if (label == before).all():
            break
    return label


def compared(x: np.ndarray, y: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of the pairs within the radius; y None: pairs within x. Stretches of too different counts are skipped."""
    inner = y is None
    xo = np.argsort(np.bitwise_count(x), kind="stable")
    yo = xo if inner else np.argsort(np.bitwise_count(y), kind="stable")
    xs, ys = x[xo], x[xo] if inner else y[yo]
    ones, other = np.bitwise_count(xs).astype(np.int64), np.bitwise_count(ys).astype(np.int64)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(xs), BLOCK):
        b = min(a + BLOCK, len(xs))
        low, high = np.searchsorted(other, ones[a] - radius), np.searchsorted(other, ones[b - 1] + radius, "right")
        low = max(low, a) if inner else low
        i, j = np.nonzero(np.bitwise_count(xs[a:b, None] ^ ys[None, low:high]) <= radius)
        own = (j + low > i + a) if inner else slice(None)
        left.append(xo[i[own] + a])
        right.append(yo[j[own] + low])
    return np.concatenate(left), np.concatenate(right)


def _small_units(keys: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys, all runs at once: each row is compared with the k-th one after it, for all k."""
    left, right, k = [], [], 1
    alive = np.arange(len(keys))
    while True:
        alive = alive[alive + k < len(keys)]
        alive = alive[keys[alive] == keys[alive + k]]
        if not len(alive):
            break
        near = alive[np.bitwise_count(prints[alive] ^ prints[alive + k]) <= radius]
        left.append(near)
        right.append(near + k)
        k += 1
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _links(radius: int, small: int = 48):
    def work(keys: np.ndarray, sides: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(keys)) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
        few = np.repeat((ends - starts <= small) & (sides[starts] == 0), ends - starts)
        i, j = _small_units(keys[few], prints[few], radius)
        a, b = [prints[few][i]], [prints[few][j]]
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if few[s]:
                continue
            x = prints[s:e]
            if sides[s] == 0:
                left, right = compared(x, None, radius)
            else:  # a pair of tiles: side 1, then side 2
                m = int(np.searchsorted(sides[s:e], 2))
                left, right = compared(x[:m], x[m:], radius)
                right = right + m
            root = forest(left, right, len(x))
            own = root != np.arange(len(x))
            a.append(x[own])
            b.append(x[root[own]])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].view(np.int64) if len(pairs) else np.zeros(0, np.int64)) for k in range(2)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of unit and side; the unit that a batch ends in waits for the next one."""
        held = np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.uint64)
        for batch in batches:
            new = np.asarray(batch.column("unit")), np.asarray(batch.column("side")), np.asarray(batch.column("fp")).view(np.uint64)
            held = tuple(np.concatenate(x) for x in zip(held, new, strict=True))
            whole = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            if whole:
                yield work(*(x[:whole] for x in held))
                held = tuple(x[whole:] for x in held)
        if len(held[0]):
            yield work(*held)

    return run


def keyed(prints: DataFrame) -> DataFrame:
    """fp, key, ones: a row for each of the ten pairs of stretches; key holds the pair's number and its bits."""
    bits = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1)) for a, n in STRETCHES]
    pairs = [F.lit(k << 32).cast("long").bitwiseOR(F.shiftleft(bits[i], 16)).bitwiseOR(bits[j]) for k, (i, j) in enumerate(combinations(range(len(bits)), 2))]
    return prints.select("fp", F.bit_count("fp").alias("ones"), F.explode(F.array(*pairs)).alias("key"))


def tiles_of(full: DataFrame, tile: int) -> DataFrame:
    """key, ones, first, parts of keys with more than a tile's rows: a population count's rows are in tile `first`, or dealt by hash to
    `parts` tiles from it on. full: key, ones, n."""
    upto = Window.partitionBy("key").orderBy("ones").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.ceil(F.col("n") / tile).cast("int")
    # Counts that fill tiles of their own begin a new one; the others share tiles with their neighbours.
    rows = full.withColumn("parts", parts).withColumn("room", F.when(parts > 1, parts * tile).otherwise(F.col("n")))
    ahead = F.coalesce(F.sum("room").over(upto), F.lit(0))
    bigs = F.coalesce(F.sum(F.when(F.col("parts") > 1, 2).otherwise(0)).over(upto), F.lit(0)) + F.when(F.col("parts") > 1, 1).otherwise(0)
    return rows.select("key", "ones", (F.floor(ahead / tile) + bigs).cast("int").alias("first"), "parts")


def units_of(rows: DataFrame, radius: int, tile: int) -> DataFrame:
    """fp, unit, side: rows (fp, ones, key) dealt to units of work. Side 0: a unit of one tile, compared within; 1 and 2: a pair of tiles."""
    full = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > tile).select("key"), "full-keys")
    if full.isEmpty():
        return rows.select("fp", F.xxhash64("key").alias("unit"), F.lit(0).cast("byte").alias("side"))
    full = sent(full)
    laid = written(tiles_of(rows.join(full, "key", "left_semi").groupBy("key", "ones").agg(F.count(F.lit(1)).alias("n")), tile), "tiles")
    spans = laid.select("key", "ones", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("tile"))
    spans = written(spans.groupBy("key", "tile").agg(F.min("ones").alias("low"), F.max("ones").alias("high")), "tile-spans")
    a, b = spans.alias("a"), spans.alias("b")
    near = (F.col("a.key") == F.col("b.key")) & (F.col("a.tile") < F.col("b.tile")) & (F.col("b.low") <= F.col("a.high") + radius) & (F.col("a.low") <= F.col("b.high") + radius)
    pairs = a.join(b, near).select("a.key", F.col("a.tile").alias("t1"), F.col("b.tile").alias("t2"))
    pairs = pairs.select("key", "t1", "t2", F.explode(F.array(F.struct(F.col("t1").alias("tile"), F.lit(1).alias("side")), F.struct(F.col("t2").alias("tile"), F.lit(2).alias("side")))).alias("x")).select("key", "x.tile", "x.side", "t1", "t2")
    alone = spans.select("key", "tile", F.lit(0).alias("side"), F.col("tile").alias("t1"), F.col("tile").alias("t2"))
    places = written(alone.unionByName(pairs).select("key", "tile", F.col("side").cast("byte").alias("side"), F.xxhash64("key", "t1", "t2").alias("unit")), "tile-pairs")
    crowded = rows.join(sent(laid), ["key", "ones"]).select("fp", "key", (F.col("first") + F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int").alias("tile"))
    crowded = crowded.join(sent(places), ["key", "tile"]).select("fp", "unit", "side")
    plain = rows.join(full, "key", "left_anti").select("fp", F.xxhash64("key").alias("unit"), F.lit(0).cast("byte").alias("side"))
    return plain.unionByName(crowded)


def near_links(prints: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: links of distinct fingerprints (fp) that connect all that lie within the radius of each other."""
    spark = prints.sparkSession
    if radius > 3:
        raise ValueError("two of five stretches are unchanged only up to three differing bits")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = units_of(keyed(prints), radius, tile).repartition(n, "unit").sortWithinPartitions("unit", "side")
    return dealt.mapInArrow(_links(radius), "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the least node that each node (column node) is connected to by links (a, b).

    Rounds of taking the least label among neighbours, then the label's label, until nothing changes; rounds grow with the logarithm of
    the longest chain. Only labels that have moved are looked up, so a giant component's label is sent, not joined by.
    """
    links = links.filter("a <> b")
    links = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(links.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        offer = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        least = written(labels.join(offer, "node").select("node", F.col("label").alias("old"), F.least("label", "offer").alias("label")), "least")
        named = least.select(F.col("label").alias("node")).distinct()
        moved = written(least.join(named, "node", "left_semi").filter("label <> node").select(F.col("node").alias("label"), F.col("label").alias("jump")), "moved")
        after = written(least.join(sent(moved), "label", "left").select("node", "old", F.coalesce("jump", "label").alias("label")), "labels")
        discarded(labels, least, moved)
        labels = after
        if labels.filter("label <> old").isEmpty():
            discarded(links)
            return nodes.join(labels.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def _row_keys() -> list[Column]:
    """Two hashes that, with doc_id, name a row by its text."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2")]


def _order() -> Column:
    """The order in which a component's rows are first."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")


def labelled(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, k1, k2, fp and `first` (the component's first row, see _order) for each row of docs (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", *_row_keys())
    with small_batches(docs.sparkSession):
        rows = written(texts.mapInArrow(_fingerprint_rows, "doc_id long, k1 long, k2 long, fp long"), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min(_order()).alias("first")), "distinct-fingerprints")
    with small_batches(docs.sparkSession):
        links = written(near_links(prints.select("fp"), radius, tile), "found-links")
    labels = components(prints.select(F.col("fp").alias("node")), links).withColumnRenamed("node", "fp")
    labels = written(labels.join(prints, "fp"), "components")
    firsts = labels.groupBy("label").agg(F.min("first").alias("first"))
    return rows.join(written(labels.drop("first").join(firsts, "label").select("fp", "first"), "firsts"), "fp")


def near_groups(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of docs (doc_id, text)."""
    rows = labelled(docs, radius, tile)
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def representatives(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of docs for each component: of those with the smallest doc_id the one with the least hash of its text.

    Null doc_ids come last. Of several rows with one id and text the one with the least JSON of its columns stays.
    """
    columns = docs.columns
    name = F.xxhash64("doc_id", "k1", "k2")  # beside k1 and k2, as a null can't be joined by
    rows = labelled(docs.select("doc_id", "text"), radius, tile).withColumn("stays", _order() == F.col("first")).groupBy("k1", "k2", name.alias("k3")).agg(F.bool_or("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    rows = written(rows.filter(~F.col("stays") | (F.col("n") > 1)), "near-copies")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *_row_keys()).select("row", "k1", "k2", name.alias("k3"))
    names = ["k1", "k2", "k3"]
    left = whole.join(sent(rows.select(*names)), names, "left_anti").select("row.*")
    again = rows.filter("stays").select(*names)
    if again.isEmpty():
        return left
    once = matched(whole, written(again, "repeated-rows"), names).groupBy(*names).agg(F.min_by("row", F.to_json("row")).alias("row"))
    return left.unionByName(once.select("row.*"))
