"""A prefix trie of conversations by polynomial rolling fingerprints.

Each turn (role, text) has a 128-bit number. A conversation's fingerprint at depth d is the sum of turn i times base to the i, modulo 2**64,
for two bases, so that numpy scans give all prefixes of a sorted run of turns at once, and a prefix can be exchanged (`rebuilt`) by arithmetic
on sums. Prefixes of one depth and fingerprint are a group of candidates:

* Turns: numbers that recur are compared by role and text; contents that differ from their number's representative get a number of their own.
* Prefixes: each member is compared with its group's representative turn by turn, from the deepest up: equal fingerprints after equal ones
  before mean equal last turns (the bases are odd), so that a group is one node if all its members come from one group. Members that come
  from another one are split off, with all that follows them, until no group is left to be split.

Roll-ups need no walk over the tree. The smallest member of a node stands for it; a conversation stands for its nodes from some depth on
(`_first`). A node's leaves, children and saved words are then sums over its members of terms that follow from that depth and prefix sums.

Turns are sorted by range, not by conversation: a conversation may lie in many partitions, of which each hands on its count and sums, a row
for each partition and conversation that crosses its bounds. Node keys are pre-aggregated, tables are written before joins that meet hot ones.
Identifiers of conversations that end in a node are joined in pieces of PIECE numbers, and hashed piece after piece by a stream.

Null role and text are empty. Turns are ordered by turn (null first), equal ones by their numbers; repeated rows are turns of their own. Rows
without a conversation are ignored, so are other columns. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BASES, WORD, discarded, matched, powers, small_batches, written

#: A conversation takes up to HEAD - 1 turns from the first of each FAMILY.
FAMILY, HEAD = 20, 4
PIECE = 4096
NODE = ["_depth", "_p", "_q"]


def numbered(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """_conv, _turn, _role, _text, _words and the number (_a, _b) of each turn; bits under 64 make numbers collide."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("_conv"), F.col("turn").alias("_turn"), role.alias("_role"), text.alias("_text"))
    cut = lambda x: x if bits >= 64 else x.bitwiseAND(F.lit((1 << bits) - 1))
    return rows.withColumns({"_a": cut(F.xxhash64("_role", "_text")), "_b": cut(F.xxhash64(F.lit(1), "_text", "_role")), "_words": F.regexp_count("_text", F.lit(WORD)).cast("long")})


def verified_numbers(turns: DataFrame) -> DataFrame:
    """turns with numbers that are equal for equal contents only. Contents are compared where a number recurs, each once a number."""
    while True:
        recurring = written(turns.groupBy("_a", "_b").agg(F.count("*").alias("_n")).filter("_n > 1").select("_a", "_b"), "trie-recurring")
        contents = matched(turns.select("_a", "_b", "_role", "_text"), recurring, ["_a", "_b"]).groupBy("_a", "_b", "_role", "_text").agg(F.lit(1).alias("_one"))
        first = contents.groupBy("_a", "_b").agg(F.count("*").alias("_n"), F.min(F.struct("_role", "_text")).alias("_kept")).filter("_n > 1")
        others = written(contents.join(first, ["_a", "_b"]).filter(F.struct("_role", "_text") != F.col("_kept")).select("_a", "_b", "_role", "_text"), "trie-clashes")
        discarded(recurring)
        if others.isEmpty():
            discarded(others)
            return turns
        again = others.select("*", F.lit(True).alias("_other"))
        turns = turns.join(again, ["_a", "_b", "_role", "_text"], "left")
        anew = {c: F.when(F.col("_other"), F.xxhash64(F.lit(i), "_a", "_text", "_role", "_b")).otherwise(F.col(c)) for i, c in enumerate(("_a", "_b"))}
        turns = turns.withColumns(anew).drop("_other")


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _sums(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _longs(batch, name).view(np.uint64)


SCAN = "_conv long, _part int, _rank long, _sa long, _sb long, _sw long, _a long, _b long, _words long"


def scan(turns: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """Ranks and prefix sums of turns that are sorted by conversation, as far as a partition sees them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, (0, np.uint64(0), np.uint64(0), 0)
        for batch in batches:
            conv = _longs(batch, "_conv")
            if not len(conv):
                continue
            begins = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            run_of = np.repeat(np.arange(len(begins)), np.diff(np.r_[begins, len(conv)]))
            goes_on = (run_of == 0) & (conv[0] == last)  # the first run may have begun in an earlier batch
            rank = np.arange(len(conv)) - begins[run_of] + 1 + np.where(goes_on, held[0], 0)
            sums = []
            for name, base, before in (("_a", bases[0], held[1]), ("_b", bases[1], held[2])):
                up = np.cumsum(_sums(batch, name) * powers(base, int(rank.max()) + 1)[0][rank], dtype=np.uint64)
                start = np.r_[np.uint64(0), up][begins][run_of]
                sums.append(up - start + np.where(goes_on, before, np.uint64(0)))
            total = np.cumsum(_longs(batch, "_words"))
            words = total - np.r_[0, total][begins][run_of] + np.where(goes_on, held[3], 0)
            last, held = conv[-1], (int(rank[-1]), sums[0][-1], sums[1][-1], int(words[-1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv), pa.array(np.full(len(conv), part, np.int32)), pa.array(rank), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)), pa.array(words), *(batch.column(c) for c in ("_a", "_b", "_words"))],
                names=["_conv", "_part", "_rank", "_sa", "_sb", "_sw", "_a", "_b", "_words"],
            )

    return turns.mapInArrow(run, SCAN)


def prefix_sums(turns: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """Rank and prefix sums of each turn in its conversation, wherever its rows lie."""
    spread = turns.select("_conv", "_turn", "_a", "_b", "_words").withColumn("_row", F.monotonically_increasing_id())
    order = ["_conv", "_turn", "_a", "_b", "_row"]
    ranges = written(scan(spread.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row"), bases), "trie-ranges")
    crossing = ranges.groupBy("_conv").agg(F.min("_part").alias("_from"), F.max("_part").alias("_to")).filter("_from < _to").select("_conv")
    # At most a row for each bound of two partitions, then two for each partition.
    parts = ranges.join(F.broadcast(crossing), "_conv", "left_semi").groupBy("_conv", "_part").agg(*[F.max_by(c, "_rank").alias(c) for c in ("_sa", "_sb", "_sw")], F.max("_rank").alias("_rank"))

    def offsets(rows: pd.DataFrame) -> pd.DataFrame:
        out, n, sums, words = [], 0, [0, 0], 0
        for x in rows.sort_values("_part").itertuples(index=False):
            out.append((x[0], x[1], n, *(s - (s >> 63 << 64) for s in sums), words))
            sums = [(s + pow(base, n, 1 << 64) * int(own)) % (1 << 64) for s, base, own in zip(sums, bases, (x[2], x[3]), strict=True)]
            n, words = n + int(x[5]), words + int(x[4])
        return pd.DataFrame(out, columns=["_conv", "_part", "_n0", "_a0", "_b0", "_w0"])

    before = parts.groupBy("_conv").applyInPandas(offsets, "_conv long, _part int, _n0 long, _a0 long, _b0 long, _w0 long")

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = _longs(batch, "_n0")
            distinct, place = np.unique(n, return_inverse=True)
            values = {"_rank": _longs(batch, "_rank") + n, "_sw": _longs(batch, "_sw") + _longs(batch, "_w0")}
            for name, base, zero in (("_sa", bases[0], "_a0"), ("_sb", bases[1], "_b0")):
                factor = np.array([pow(base, int(x), 1 << 64) for x in distinct], np.uint64)[place]
                values[name] = (_sums(batch, zero) + factor * _sums(batch, name)).view(np.int64)
            names = ["_conv", "_rank", "_sa", "_sb", "_sw", "_a", "_b", "_words"]
            yield pa.RecordBatch.from_arrays([pa.array(values[c]) if c in values else batch.column(c) for c in names], names=names)

    rows = ranges.join(F.broadcast(before), ["_conv", "_part"], "left").fillna(0, ["_n0", "_a0", "_b0", "_w0"])
    out = written(rows.mapInArrow(shifted, SCAN.replace(" _part int,", "")), "trie-sums")
    discarded(ranges)
    return out


def rebuilt(sums: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """Every prefix of every rebuilt conversation, the empty one too: _conv, _depth, _p, _q, those of the prefix before (_pp, _pq), the words
    before its last turn (_before), and the conversation's turns and words (_len, _total).

    A conversation has the first crc32(id) % HEAD turns of its family's first one, then its own after as many.
    """
    heads = [(k, c) for k in range(1, HEAD) for c in ("_sa", "_sb", "_sw")]
    own = sums.groupBy("_conv").agg(F.max("_rank").alias("_n"), F.max("_sw").alias("_w"), *[F.sum(F.when(F.col("_rank") == k, F.col(c))).alias(f"{c}{k}") for k, c in heads])
    own = written(own, "trie-heads")
    base = own.select(F.col("_conv").alias("_base"), F.col("_n").alias("_base_n"), *[F.col(f"{c}{k}").alias(f"_base{c}{k}") for k, c in heads])
    h = F.crc32(F.col("_conv").cast("string").cast("binary")) % HEAD
    both = own.withColumns({"_h": h, "_base": F.col("_conv") - F.col("_conv") % FAMILY}).join(base, "_base", "left")

    def at(prefix: str, c: str, k: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(1, HEAD):
            out = F.when(k == i, F.col(f"{prefix}{c}{i}")).otherwise(out)
        return out

    taken, skipped = F.least(F.col("_h"), F.coalesce("_base_n", F.lit(0))), F.least("_h", "_n")
    both = both.withColumns({"_l": taken, "_skip": skipped})
    both = both.withColumns({f"_l{c}": at("_base", c, F.col("_l")) for c in ("_sa", "_sb", "_sw")} | {f"_h{c}": at("", c, F.col("_skip")) for c in ("_sa", "_sb", "_sw")})
    both = both.withColumns({"_len": F.col("_l") + F.col("_n") - F.col("_skip"), "_total": F.col("_l_sw") + F.col("_w") - F.col("_h_sw")})
    plans = written(both, "trie-plans")
    zero = F.lit(0).cast("long")
    b = lambda c, k: F.col(f"_base{c}{k}") if k else zero
    steps = [F.struct(zero.alias("_depth"), zero.alias("_p"), zero.alias("_q"), zero.alias("_pp"), zero.alias("_pq"), zero.alias("_before"))]
    steps += [F.when(F.col("_l") >= k, F.struct(F.lit(k).cast("long").alias("_depth"), b("_sa", k).alias("_p"), b("_sb", k).alias("_q"), b("_sa", k - 1).alias("_pp"), b("_sb", k - 1).alias("_pq"), b("_sw", k - 1).alias("_before"))) for k in range(1, HEAD)]
    first = plans.select("_conv", "_len", "_total", F.inline(F.array_compact(F.array(*steps))))
    schema = "_conv long, _len long, _total long, _depth long, _p long, _q long, _pp long, _pq long, _before long"

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, h, taken = (_longs(batch, c) for c in ("_rank", "_h", "_l"))
            out = []
            for own, number, base in (("_sa", "_a", bases[0]), ("_sb", "_b", bases[1])):
                up, down = powers(base, int(rank.max(initial=0)) + HEAD)
                until = _sums(batch, own)
                for s in (until, until - _sums(batch, number) * up[rank]):
                    out.append((_sums(batch, f"_l{own}") + (s - _sums(batch, f"_h{own}")) * down[h - taken]).view(np.int64))
            words = _longs(batch, "_l_sw") + _longs(batch, "_sw") - _longs(batch, "_words") - _longs(batch, "_h_sw")
            columns = [batch.column("_conv"), batch.column("_len"), batch.column("_total"), pa.array(taken + rank - h), *(pa.array(out[i]) for i in (0, 2, 1, 3)), pa.array(words)]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    joined = sums.join(plans.select("_conv", "_h", "_l", "_len", "_total", *[f"_{s}{c}" for s in "lh" for c in ("_sa", "_sb", "_sw")]), "_conv").filter("_rank > _h")
    out = written(first.unionByName(joined.mapInArrow(follow, schema)), "trie-prefixes")
    discarded(own, plans)
    return out


def verified_prefixes(prefixes: DataFrame) -> DataFrame:
    """prefixes with fingerprints that are equal for equal prefixes only: members that come from another group than the representative are split off."""
    while True:
        mixed = prefixes.groupBy(*NODE).agg(F.min("_pp").alias("_x"), F.max("_pp").alias("_y"), F.min("_pq").alias("_z"), F.max("_pq").alias("_t"))
        mixed = written(mixed.filter("_x < _y OR _z < _t").select(*NODE), "trie-mixed")
        if mixed.isEmpty():
            discarded(mixed)
            return prefixes
        classes = prefixes.join(mixed, NODE).groupBy(*NODE, "_pp", "_pq").agg(F.min("_conv").alias("_rep"))
        first = classes.groupBy(*NODE).agg(F.min("_rep").alias("_kept"))
        split = written(classes.join(first, NODE).filter("_rep > _kept").select(*NODE, "_pp", "_pq"), "trie-split")
        # What follows a split in a conversation differs by it too: exclusive-or with the numbers of all splits up to a depth.
        number = [F.xxhash64(F.lit(i), *NODE, "_pp", "_pq").alias(c) for i, c in enumerate(("_u", "_v"))]
        marks = prefixes.join(split, [*NODE, "_pp", "_pq"]).groupBy("_conv").agg(F.collect_list(F.struct("_depth", *number)).alias("_marks"))

        def upto(c: str, mark: str, least: int) -> Column:
            own = F.filter(F.coalesce("_marks", F.array()), lambda m: m["_depth"] <= F.col("_depth") - least)
            return F.aggregate(own, F.col(c), lambda x, m: x.bitwiseXOR(m[mark]))

        changed = {"_p": upto("_p", "_u", 0), "_q": upto("_q", "_v", 0), "_pp": upto("_pp", "_u", 1), "_pq": upto("_pq", "_v", 1)}
        again = written(prefixes.join(marks, "_conv", "left").select(*[changed.get(c, F.col(c)).alias(c) for c in prefixes.columns]), "trie-prefixes")
        discarded(prefixes, mixed, split)
        prefixes = again


def end_hashes(prefixes: DataFrame) -> DataFrame:
    """The SHA-256 of the ascending, comma-joined ids of the conversations that end in a node."""
    piece = F.floor(F.col("_conv") / PIECE).cast("long")
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("_conv")), lambda x: x.cast("string")), ",")
    pieces = prefixes.filter("_depth = _len").groupBy(*NODE, piece.alias("_piece")).agg(ids.alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in (*NODE, "_ids")), strict=True))
        done: list[tuple] = []
        for key, own in groupby(rows, key=lambda x: x[:3]):
            digest = hashlib.sha256()
            for i, x in enumerate(own):
                digest.update((b"," if i else b"") + x[3].encode())
            done.append((*key, digest.hexdigest()))
            if len(done) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*NODE, "ends_sha256"])
                done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=[*NODE, "ends_sha256"])

    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "_piece").mapInArrow(run, "_depth long, _p long, _q long, ends_sha256 string")


def trie(conversations: DataFrame, bits: int = 64, bases: tuple[int, int] = BASES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of each node, from the root (depth 0) on.

    conv_id is the smallest member; saved_tokens is the sum, over the node and all below it, of the members but one times the words of the
    node's last text: what is saved if each node's last turn is read once.
    """
    with small_batches(conversations.sparkSession):
        sums = prefix_sums(verified_numbers(numbered(conversations, bits)), bases)
        prefixes = verified_prefixes(rebuilt(sums, bases))
        discarded(sums)
        nodes = prefixes.groupBy(*NODE).agg(F.min("_conv").alias("_rep"), F.max("_len").alias("_longest"), F.min("_before").alias("_before"))
        nodes = written(nodes, "trie-nodes")
        ends = written(end_hashes(prefixes), "trie-ends")
    stands = nodes.groupBy(F.col("_rep").alias("_conv")).agg(F.min("_depth").alias("_first"), F.min("_before").alias("_first_before"), F.max(F.col("_longest") == F.col("_depth")).alias("_leaf"))
    stands = written(stands, "trie-representatives")
    # A conversation that stands for no node would from the depth after its last.
    rows = prefixes.join(stands, "_conv", "left").withColumns({"_first": F.coalesce("_first", F.col("_len") + 1), "_first_before": F.coalesce("_first_before", "_total")})
    below = F.when(F.col("_depth") < F.col("_first"), F.col("_first_before") - F.col("_before")).otherwise(0)
    out = rows.groupBy(*NODE).agg(
        F.min("_conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.count(F.when((F.col("_len") > F.col("_depth")) & (F.col("_first") <= F.col("_depth") + 1), True)).alias("n_children"),
        F.count(F.when(F.col("_leaf"), True)).alias("n_leaves"),
        F.sum(below).alias("saved_tokens"),
        F.min("_pp").alias("_pp"),
        F.min("_pq").alias("_pq"),
    )
    above = nodes.select((F.col("_depth") + 1).alias("_depth"), F.col("_p").alias("_pp"), F.col("_q").alias("_pq"), F.col("_rep").alias("parent_conv_id"))
    out = out.join(above, ["_depth", "_pp", "_pq"], "left").join(ends, NODE, "left")
    return out.select("conv_id", F.col("_depth").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
