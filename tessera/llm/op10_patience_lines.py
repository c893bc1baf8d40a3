"""Line dedup by pairwise alignment of overlapping documents.

1. Lines are hashed, and from each line that has a word on, the lines up to `least_words` words as one unit (a line of so many words is a
   unit alone; shorter ones go with those after them). For each unit's hash the document with the smallest doc_id that holds it is its owner.
2. A document is paired with the owner of each of its shared units, however many documents hold it: at most one pair a unit, never
   all with all. Where `rare` is given, only with the owners of its units found in at most `rare` documents, and of its rarest ones.
3. Each pair's line hashes are aligned by patience diff: lines that are unique in both and in the same order are anchors, stretches
   between anchors are treated alike, equal lines next to an anchor join its block. An owner's lines are sent once for each LOT of its
   documents, so that what moves is linear in the documents, however long an owner with a frequent line is.
4. Aligned blocks of at least `least_words` words go from the later document, once each line's letters are found equal to those of the
   earlier document's line: a collision of hashes can't remove a line. Pairs are judged on the input, not on what is left.

Every block that may be removed starts a unit at its first line with a word, so no block is missed for having short lines only.

Null text counts as empty. Lines end at a line feed only. Rows with a null doc_id are neither earlier nor later and keep their
lines. Rows with equal doc_id are not paired with each other. Documents stay, if without lines. Rows of one id and text are treated
alike. An empty table gives no rows; other columns are carried, their names don't matter.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BASES, matched, range_hashes, small_batches, text_groups, word_hashes, words_of, written

LEAST_WORDS = 5
#: Documents that meet an owner at a time.
LOT = 256


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Matching places of a and b, ascending in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if in_a[x] == 1}
        common = [(place[x], j) for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and x in place]
        # The longest run of common lines that ascends in a too.
        tops: list[int] = []
        heads: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(common):
            at = bisect.bisect_left(tops, i)
            tops[at : at + 1] = [i]
            heads[at : at + 1] = [k]
            back.append(heads[at - 1] if at else -1)
        chain, k = [], heads[-1] if heads else -1
        while k >= 0:
            chain.append(common[k])
            k = back[k]
        for i, j in chain:
            out.append((i, j))
            todo.append((i + 1, a1, j + 1, b1))
            a1, b1 = i, j
        if chain:
            todo.append((a0, a1, b0, b1))
    return sorted(out)


def aligned_lines(earlier: list[int], later: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """Lines (in the later document, in the earlier one) in aligned common blocks of at least `least` words."""
    out: list[tuple[int, int]] = []
    block: list[tuple[int, int]] = []
    last = (-2, -2)
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k, _ in block) >= least:
                out += block
            block = []
        block.append((j, i))
        last = (i, j)
    return out


def line_hashes(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Of several texts: the index of each text's first line (plus the total), the lines' hashes and numbers of words, the index of each
    text's first unit (plus the total) and the units' hashes."""
    feeds = np.flatnonzero(data == 10)
    ends = np.sort(np.concatenate([feeds, offsets[1:]]))
    owner = np.concatenate([np.searchsorted(offsets, feeds, "right") - 1, np.arange(len(offsets) - 1)])
    owner = np.sort(owner)
    begins = np.empty_like(ends)
    begins[0] = 0
    begins[1:] = ends[:-1] + 1
    firsts = np.searchsorted(owner, np.arange(len(offsets)))
    begins[firsts[:-1]] = offsets[:-1]
    hashes = word_hashes(data, begins, ends) if len(data) else np.zeros(len(ends), np.uint64)
    starts, _, _ = words_of(data, offsets)
    upto = np.concatenate([np.searchsorted(starts, begins), [len(starts)]])  # words before each line
    words = np.diff(upto)
    heads = np.flatnonzero(words)
    tails = np.searchsorted(upto, upto[heads] + least)  # the first line by whose begin so many words have passed
    within = tails <= firsts[owner[heads] + 1]
    heads, tails = heads[within], tails[within]
    units = range_hashes(hashes, heads, tails, BASES[1]) if len(heads) else np.zeros(0, np.uint64)
    return firsts, hashes, words, np.searchsorted(owner[heads], np.arange(len(offsets))), units


def _hash_rows(least: int):
    names = ["doc_id", "k1", "k2", "lines", "words", "units"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in text_groups(batch):
                firsts, hashes, words, edges, units = line_hashes(data, offsets, least)
                lists = [(firsts, hashes.view(np.int64)), (firsts, words.astype(np.int32)), (edges, units.view(np.int64))]
                arrays = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for at, x in lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i:j] for c in names[:3]), *arrays], names=names)

    return run


def _align(least: int):
    """Of rows in order of owner and lot, the owner's own row first: the owner's lines are held while its lot's documents go by."""
    pairs = pa.list_(pa.struct([("j", pa.int32()), ("i", pa.int32())]))
    names = ["k1", "k2", "e1", "e2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        for batch in batches:
            own, lines, words = batch.column("own").to_pylist(), batch.column("lines"), batch.column("words")
            rows = []
            for at, first in enumerate(own):
                if first:
                    held = lines[at].as_py()
                else:
                    rows.append([{"j": j, "i": i} for j, i in aligned_lines(held, lines[at].as_py(), words[at].as_py(), least)])
            later = pa.array([not x for x in own], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(later) for c in names), pa.array(rows, pairs)], names=[*names, "pairs"])

    return run


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def _keys(first: str, second: str) -> list[Column]:
    """Two hashes that name a row by id and text: equal rows are treated alike."""
    return [F.xxhash64("doc_id", "text").alias(first), F.xxhash64(F.lit(1), "doc_id", "text").alias(second)]


def common_lines(docs: DataFrame, rare: int | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """k1, k2 of each row that may lose lines, e1, e2 of an earlier one and pairs (j, i): lines of the two with equal hashes in blocks."""
    texts = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", *_keys("k1", "k2"))
    with small_batches(docs.sparkSession):
        rows = written(texts.mapInArrow(_hash_rows(least_words), "doc_id long, k1 long, k2 long, lines array<long>, words array<int>, units array<long>"), "line-hashes")
        units = rows.select("doc_id", "k1", "k2", F.explode(F.array_distinct("units")).alias("unit"))
        shared = units.groupBy("unit").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        # Written, so that both sides of the join are dealt out anew and a frequent unit's rows can be split over tasks.
        shared = written(shared.filter("owner.doc_id < last").select("unit", "owner", "n"), "shared-units")
        found = units.join(shared, "unit").filter("owner.doc_id < doc_id").select("k1", "k2", "n", F.col("owner.k1").alias("e1"), F.col("owner.k2").alias("e2"))
        if rare is not None:
            found = found.groupBy("k1", "k2").agg(F.min("n").alias("least"), F.collect_set(F.struct("n", "e1", "e2")).alias("owners"))
            chosen = F.filter("owners", lambda x: x["n"] <= F.greatest(F.lit(rare), F.col("least")))
            found = found.select("k1", "k2", F.inline(chosen)).drop("n")
        pairs = written(found.distinct(), "line-pairs")
        once = written(rows.dropDuplicates(["k1", "k2"]).select("k1", "k2", "lines", "words"), "line-hashes-once")
        # An owner's lines go once to each lot of LOT of its documents, not to each of them.
        lots = written(pairs.groupBy("e1", "e2").agg(F.ceil(F.count(F.lit(1)) / LOT).cast("int").alias("lots")), "line-lots")
        own = lots.join(once.select(F.col("k1").alias("e1"), F.col("k2").alias("e2"), "lines"), ["e1", "e2"]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
        own = own.select(*[F.lit(None).cast(t).alias(c) for c, t in (("k1", "long"), ("k2", "long"))], "e1", "e2", "lot", F.lit(True).alias("own"), "lines", F.array().cast("array<int>").alias("words"))
        later = pairs.join(lots, ["e1", "e2"]).withColumn("lot", F.pmod(F.xxhash64("k1", "k2"), F.col("lots")).cast("int"))
        later = later.join(once, ["k1", "k2"]).select("k1", "k2", "e1", "e2", "lot", F.lit(False).alias("own"), "lines", "words")
        dealt = own.unionByName(later).repartition("e1", "e2", "lot").sortWithinPartitions("e1", "e2", "lot", F.col("own").desc())
        claims = dealt.mapInArrow(_align(least_words), "k1 long, k2 long, e1 long, e2 long, pairs array<struct<j:int,i:int>>")
        return written(claims.filter("size(pairs) > 0"), "line-claims")


def without_common_lines(docs: DataFrame, rare: int | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """row (the columns of docs, with the text that is left), n_lines and n_removed of each row of docs."""
    claims = common_lines(docs, rare, least_words)
    claimed = claims.select("k1", "k2", "e1", "e2", F.inline("pairs"))
    # The letters of the earlier documents' lines: only those that are claimed move.
    wanted = written(claimed.groupBy("e1", "e2").agg(F.collect_set("i").alias("wanted")), "wanted-lines")
    owners = matched(docs.select(*_keys("e1", "e2"), _lines().alias("lines")), wanted, ["e1", "e2"]).dropDuplicates(["e1", "e2"])
    line = F.transform("wanted", lambda i: F.struct(i.alias("i"), F.get("lines", i).alias("line")))
    letters = written(owners.select("e1", "e2", F.inline(line)), "claimed-lines")
    numbered = F.concat(F.col("j").cast("string"), F.lit(":"), "line")
    gone = claimed.join(letters, ["e1", "e2", "i"]).groupBy("k1", "k2").agg(F.collect_set(numbered).alias("gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_keys("k1", "k2"), F.size(_lines()).cast("long").alias("n_lines"))
    # Texts meet their lines by shuffle at every size: what goes grows with the documents.
    rows = rows.join(gone.hint("merge"), ["k1", "k2"], "left")
    # Numbered lines that are equal to claimed ones go; the rest keep their order.
    text = F.col("row")["text"]
    own = F.transform(F.split(text, "\n", -1), lambda x, j: F.concat(j.cast("string"), F.lit(":"), x))
    kept = rows.withColumn("kept", F.when(F.col("gone").isNotNull(), F.array_except(own, "gone")))
    left = F.when(F.col("kept").isNull(), text).otherwise(F.array_join(F.transform("kept", lambda x: F.regexp_replace(x, "^[0-9]+:", "")), "\n"))
    removed = F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines") - F.size("kept")).cast("long")
    return kept.select(F.col("row").withField("text", left).alias("row"), "n_lines", removed.alias("n_removed"))


def line_digest(docs: DataFrame, rare: int | None = None, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of each row."""
    rows = without_common_lines(docs.select("doc_id", "text"), rare, least_words)
    return rows.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("row.text", F.lit("")), 256).alias("kept_sha256"))
