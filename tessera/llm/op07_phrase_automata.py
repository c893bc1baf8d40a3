"""Substring dedup with repeated-phrase automata.

Removes each word that lies in a window of WINDOW consecutive words whose word sequence also starts in a document with a smaller doc_id.

1. Anchors. The least hash of the ANCHOR-word shingles in a window is the window's anchor (winnowing): equal windows have equal anchors.
   Runs of windows with one anchor are segments. Only anchors that occur in two documents can belong to a recurring window.
2. Confirming recurring passages. Segments with a recurring anchor are grouped by content; where an anchor has several contents, the
   windows of each distinct content are compared, so that every window knows the first document (and place) that it starts in. Runs
   of a document's windows that follow one another in the same earlier document are passages.
3. Automata. Each passage's text is read from the earlier document. Passages are dealt out to the documents that may hold them; each
   task compiles its shard of distinct passages into Aho-Corasick automata of bounded size and streams its documents through them.
   Only words of located occurrences, compared letter by letter, are removed: a collision of hashes can't remove a word.

Long passages are cut into pieces of PIECE windows (neighbours overlap by WINDOW - 1 words), which bounds an automaton's patterns.

Null text has no words. Null doc_ids are neither earlier nor later than others: nothing is removed from them or for them. Rows with
the same doc_id don't make each other's words go; each of them is judged against smaller doc_ids. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BASES, GROUP_BYTES, matched, range_hashes, sent, small_batches, text_groups, word_hashes, words_of, written

WINDOW = 50
ANCHOR = 10
PIECE = 500
#: Letters of patterns in an automaton, at about 100 bytes of memory each.
AUTOMATON_LETTERS = 600_000


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of several texts, and the index of each text's first word (plus the total)."""
    starts, ends, firsts = words_of(data, offsets)
    return (word_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), firsts


def segments(hashes: np.ndarray, firsts: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """text, anchor, content hash, first and last window (places in the text) of each segment."""
    n = len(hashes)
    empty = np.zeros(0, np.int64)
    if n < window:
        return empty, empty, empty, empty, empty
    at = np.arange(n - anchor + 1)
    least = range_hashes(hashes, at, at + anchor, BASES[1])
    span, width = window - anchor + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    least = np.minimum(least[: n - window + 1], least[span - width : span - width + n - window + 1])
    text = np.searchsorted(firsts, np.arange(n), "right") - 1
    whole = text[: n - window + 1] == text[window - 1 :]
    places = np.flatnonzero(whole)
    if not len(places):
        return empty, empty, empty, empty, empty
    key, owner = least[places], text[places]
    change = np.ones(len(places), dtype=bool)
    change[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(change)
    end = np.append(begin[1:], len(places)) - 1
    content = range_hashes(hashes, places[begin], places[end] + window, BASES[0])
    base = firsts[owner[begin]]
    return owner[begin], key[begin].view(np.int64), content.view(np.int64), places[begin] - base, places[end] - base


_SEGMENT = "doc_id long, anchor long, content long, p0 int, p1 int"


def _segment_rows(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column("doc_id"))
            for first, _, data, offsets in text_groups(batch):
                text, key, content, p0, p1 = segments(*_words(data, offsets), window, anchor)
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + text]), pa.array(key), pa.array(content), pa.array(p0, pa.int32()), pa.array(p1, pa.int32())], names=["doc_id", "anchor", "content", "p0", "p1"])

    return run


def _window_rows(window: int):
    """The windows of chosen segments (column picks) of each document: two hashes, document, place, and segment's key."""
    names = ["w1", "w2", "doc_id", "pos", "anchor", "content", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, picks = batch.column("doc_id").to_pylist(), batch.column("picks").to_pylist()
            for first, end, data, offsets in text_groups(batch):
                hashes, firsts = _words(data, offsets)
                rows = [(firsts[i - first] + x["p0"], firsts[i - first], x["p1"] - x["p0"] + 1, ids[i], x["anchor"], x["content"]) for i in range(first, end) for x in picks[i]]
                if not rows:
                    continue
                at, base, n, doc, key, content = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = np.repeat(at, n) + k
                pair = [range_hashes(hashes, start, start + window, b).view(np.int64) for b in BASES]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*pair, np.repeat(doc, n), start - np.repeat(base, n), np.repeat(key, n), np.repeat(content, n), k)], names=names)

    return run


def _run_rows(window: int, piece: int):
    """Passages of each document: (start, owner, owner_start, windows), from its segments in order of place."""
    out = pa.list_(pa.struct([("start", pa.int64()), ("owner", pa.int64()), ("owner_start", pa.int64()), ("windows", pa.int64())]))

    def passages(doc: int, held: list[dict]) -> list[dict]:
        runs: list[list[int]] = []
        for x in sorted(held, key=lambda x: x["p0"]):
            changed = {y["k"]: (y["owner"], y["owner_pos"]) for y in x["earlier"] or []}
            for k in range(x["p1"] - x["p0"] + 1):
                owner, pos = changed.get(k, (x["least"], x["least_p0"] + k))
                if owner < doc:
                    at = x["p0"] + k
                    last = runs[-1] if runs else None
                    if last and last[0] + last[3] == at and last[1] == owner and last[2] + last[3] == pos and last[3] < piece:
                        last[3] += 1
                    else:
                        runs.append([at, owner, pos, 1])
        return [dict(zip(("start", "owner", "owner_start", "windows"), r, strict=True)) for r in runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [passages(d, s) for d, s in zip(ids, batch.column("held").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, out)], names=["doc_id", "runs"])

    return run


def _pattern_rows(window: int):
    """The text of each wanted passage: its words, joined by one space. A much quoted owner's come in several batches."""
    names = ["owner", "owner_start", "windows", "pattern"]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, letters = [], 0
            for doc, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                words = (text or "").encode().split()
                for x in wanted:
                    part = words[x["owner_start"] : x["owner_start"] + x["windows"] + window - 1]
                    if len(part) == x["windows"] + window - 1:  # else another row with the owner's id
                        rows.append((doc, x["owner_start"], x["windows"], b" ".join(part).decode()))
                        letters += len(rows[-1][3])
                    if letters > GROUP_BYTES:
                        yield batch_of(rows)
                        rows, letters = [], 0
            yield batch_of(rows)

    return run


def compiled(patterns: dict[str, int]) -> ahocorasick.Automaton:
    """patterns: words of a passage joined by a space -> the smallest document that it is from."""
    automaton = ahocorasick.Automaton()
    for text, owner in patterns.items():
        automaton.add_word(f" {text} ", (owner, text.count(" ") + 1))
    automaton.make_automaton()
    return automaton


def located(automaton: ahocorasick.Automaton, doc_id: int, words: list[str]) -> np.ndarray:
    """For each word whether an occurrence of a passage from a document before doc_id covers it."""
    spaces = np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))])
    change = np.zeros(len(words) + 1, np.int64)
    found = [(end, n) for end, (owner, n) in automaton.iter(f" {' '.join(words)} ") if owner < doc_id]
    if found:
        end, n = np.array(found).T
        last = np.searchsorted(spaces, end)
        np.add.at(change, last - n, 1)
        np.add.at(change, last, -1)
    return np.cumsum(change[:-1]) > 0


def _kept_rows(letters: int, full: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_text" if full else "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            ids, texts, found = (batch.column(c) for c in ("doc_id", "text", "patterns"))
            size, removed, kept = [0] * n, [0] * n, [""] * n
            waiting: list[tuple[int, list[str]]] = []
            patterns: dict[str, int] = {}
            held = 0

            def stream() -> None:
                if not waiting:
                    return
                automaton = compiled(patterns)
                for i, words in waiting:
                    gone = located(automaton, ids[i].as_py(), words)
                    removed[i] = int(gone.sum())
                    kept[i] = done(" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).encode())

            done = (lambda x: x.decode()) if full else (lambda x: hashlib.sha256(x).hexdigest())
            for i in range(n):
                words = (texts[i].as_py() or "").encode().split()
                size[i] = len(words)
                own = found[i].as_py()
                if not own:
                    kept[i] = done(b" ".join(words))
                    continue
                waiting.append((i, [w.decode() for w in words]))
                for x in own:
                    if x["pattern"] not in patterns:
                        held += len(x["pattern"])
                    patterns[x["pattern"]] = min(x["owner"], patterns.get(x["pattern"], x["owner"]))
                if held > letters:
                    stream()
                    waiting, patterns, held = [], {}, 0
            stream()
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=names)

    return run


def passages(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, piece: int = PIECE) -> DataFrame:
    """doc_id and runs: array of (start, owner, owner_start, windows), for each document that has any."""
    rows = written(texts.filter("doc_id is not null").mapInArrow(_segment_rows(window, anchor), _SEGMENT), "segments")
    recurring = rows.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("anchor")
    rows = written(rows.join(sent(written(recurring, "recurring-anchors")), "anchor", "left_semi"), "recurring-segments")
    least = F.min(F.struct("doc_id", "p0", "p1")).alias("least")
    contents = written(rows.groupBy("anchor", "content").agg(least).select("anchor", "content", "least.*"), "contents")
    several = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor")
    # Where they are few they are sent: an anchor with many contents then isn't one task's.
    picks = contents.join(sent(written(several, "anchors-of-several")), "anchor", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("p0", "p1", "anchor", "content")).alias("picks"))
    window_schema = "w1 long, w2 long, doc_id long, pos long, anchor long, content long, k long"
    windows = written(matched(texts, written(picks, "picks"), "doc_id").mapInArrow(_window_rows(window), window_schema), "windows")
    # Only windows that start in several documents are of use; written, so that a frequent window's rows can be split over tasks.
    starts = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "pos")).alias("start"), F.max("doc_id").alias("last"))
    starts = written(starts.filter("start.doc_id < last").drop("last"), "starts")
    changed = windows.join(starts, ["w1", "w2"]).filter("start.doc_id < doc_id").groupBy("anchor", "content").agg(F.collect_list(F.struct("k", F.col("start.doc_id").alias("owner"), F.col("start.pos").alias("owner_pos"))).alias("earlier"))
    known = contents.join(changed, ["anchor", "content"], "left").select("anchor", "content", F.col("doc_id").alias("least"), F.col("p0").alias("least_p0"), "earlier")
    held = rows.join(known, ["anchor", "content"]).filter((F.col("least") < F.col("doc_id")) | F.col("earlier").isNotNull())
    held = held.groupBy("doc_id").agg(F.collect_list(F.struct("p0", "p1", "least", "least_p0", "earlier")).alias("held"))
    return written(held.mapInArrow(_run_rows(window, piece), "doc_id long, runs array<struct<start:long,owner:long,owner_start:long,windows:long>>").filter("size(runs) > 0"), "passages")


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, piece: int = PIECE, letters: int = AUTOMATON_LETTERS, full: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (full: kept_text) for each row of docs (doc_id, text)."""
    with small_batches(docs.sparkSession):
        return _without_repeats(docs, window, anchor, piece, letters, full)


def _without_repeats(docs: DataFrame, window: int, anchor: int, piece: int, letters: int, full: bool) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    runs = passages(texts, window, anchor, piece).select("doc_id", F.explode("runs").alias("run")).select("doc_id", "run.owner", "run.owner_start", "run.windows")
    wanted = runs.groupBy(F.col("owner").alias("doc_id")).agg(F.collect_set(F.struct("owner_start", "windows")).alias("wanted"))
    patterns = matched(texts, written(wanted, "wanted"), "doc_id").mapInArrow(_pattern_rows(window), "owner long, owner_start long, windows long, pattern string")
    own = runs.distinct().join(written(patterns, "patterns"), ["owner", "owner_start", "windows"]).groupBy("doc_id").agg(F.collect_list(F.struct("owner", "pattern")).alias("patterns"))
    schema = "doc_id long, n_words long, n_removed long, " + ("kept_text string" if full else "kept_sha256 string")
    return written(texts.join(own, "doc_id", "left").mapInArrow(_kept_rows(letters, full), schema), "kept")
