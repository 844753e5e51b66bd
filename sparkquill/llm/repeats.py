"""Repeated substrings by a prefix-free parse of the corpus.

The corpus is parsed where a rolling hash of K bytes triggers: where it is the least one of 2**LOG_SPAN neighbouring
positions, so that every string of ``length`` bytes holds its own trigger, at the same place in each of its copies. A
position belongs to the trigger of the string that starts there. What all strings of one trigger share is its phrase; the
distinct phrases are the dictionary, their sequence is the parse.

A suffix of the corpus is the rest of its phrase up to the trigger and then the rest of the parse from there, so its place
in corpus order follows from two orders: of the dictionary's left parts and of the parse's right parts. A position is
repeated if a neighbour in corpus order shares ``length`` bytes with it.

1. Dictionary: phrases are counted. One that stands once rules out all of its positions; equal surroundings of a phrase
   are one entry, and repeated as a whole. Of equal ones in an Arrow batch one alone is counted, for all of them, so that
   a passage in a third of all documents is a few rows where it is counted. A phrase that has SEVERAL surroundings in one
   batch surely isn't alone: its rows meet by surroundings only, spread evenly, and one row for the batch tells the others.
2. Order: for each other phrase, the left parts are sorted backwards and the right parts forwards, each with the common
   lengths of neighbours; together they give the ties of every position of the phrase at depth ``length``. Texts meet
   phrases by a join on the row; entries of a phrase are sorted in one task up to ``group`` of them (about 350 bytes each).
3. Phrases with more entries, as of a passage in very many different surroundings, are refined instead by counts of hashed
   strings: first of runs of STEP positions, then of single ones. Each count is a sum that is combined before it is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.llm.common import RollingHash, chunks, cut, each, mix64, segments, texts, unzipped, zipped

#: Bytes hashed by a trigger, and positions of which a trigger is the least; K + SPAN - 1 must not exceed the length.
K, LOG_SPAN, STEP = 16, 7, 8
#: Bytes of text in one numpy pass, phrases that are looked through for equal ones together, and how many surroundings of a
#: phrase among these make it one that isn't counted as a whole.
CHUNK, TOGETHER, SEVERAL = 1 << 17, 200_000, 16
_C = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _runs(hasher: RollingHash, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of positions starts[d] <= i <= ends[d] - length of data: (d, trigger, first, last) of each trigger's run of positions."""
    hasher.load(data)
    n = len(data) - K + 1
    bits = np.uint64(24)
    key = mix64(hasher.windows(K)) >> bits << bits
    key |= np.arange(n, dtype=np.uint64)
    for level in range(LOG_SPAN):
        key = np.minimum(key[: len(key) - (1 << level)], key[1 << level :])
    triggers = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    counts = np.maximum(ends - length + 1 - starts, 0)
    kept = np.flatnonzero(counts)
    doc = np.repeat(kept, counts[kept])
    if not len(doc):
        return (np.zeros(0, np.int64),) * 4
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts[kept]) - counts[kept], counts[kept]) + starts[doc]
    trigger = triggers[at]
    first = np.flatnonzero(np.concatenate([[True], (trigger[1:] != trigger[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([first[1:], [len(doc)]]) - 1
    return doc[first], trigger[first], at[first], at[last]


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first byte, starts, ends, rows): rows of up to CHUNK bytes together; longer rows in overlapping pieces."""
    for first, last in chunks(offsets, CHUNK):
        if offsets[last] - offsets[first] <= CHUNK:
            yield first, offsets[first:last], offsets[first + 1 : last + 1]
        else:
            for start in range(offsets[first], max(offsets[first] + 1, offsets[last] - length + 1), CHUNK):
                yield first, np.array([start]), np.array([min(offsets[last], start + CHUNK + length - 1)])


def _place(first: np.ndarray, trigger: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (first.astype(np.int64) << 14) | ((trigger - first) << 7) | (last - first)


def _phrases(length: int):
    """A row for each occurrence of a phrase: key (rows meet by it), core, span (its surroundings), place (rid, place), weight and sure
    (the phrase has several surroundings).

    Of equal occurrences in a batch the first counts for all; the others are known to be repeated, and go under a key of
    their own, so that they are spread evenly rather than sent where their phrase is counted. So do the occurrences of phrases
    with SEVERAL surroundings in the batch; a row without a place (-1) says so under the phrase's own key."""

    def combined(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cores, spans, rids, places = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((spans, cores))
        cores, spans, rids, places = (x[order] for x in (cores, spans, rids, places))
        new = np.concatenate([[True], cores[1:] != cores[:-1]])
        heads = np.concatenate([[True], spans[1:] != spans[:-1]]) | new
        weights = np.full(len(spans), 2, np.int32)  # what follows its like is repeated, and needs no counting
        weights[heads] = np.minimum(np.diff(np.concatenate([np.flatnonzero(heads), [len(spans)]])), 2)
        first = np.flatnonzero(new)
        entries = np.add.reduceat(heads, first)
        sure = np.repeat(entries >= SEVERAL, np.diff(np.concatenate([first, [len(cores)]])))
        keys = np.where(sure, mix64(cores + spans * _C[1]), cores)
        keys = np.where(heads, keys, mix64(rids.view(np.uint64) * _C[0] + places.view(np.uint64)))
        told = first[entries >= SEVERAL]
        n = len(told)
        columns = ((keys.view(np.int64), cores[told].view(np.int64)), (cores.view(np.int64), cores[told].view(np.int64)), (spans.view(np.int64), np.zeros(n, np.int64)), (rids, np.zeros(n, np.int64)), (places, np.full(n, -1)), (weights, np.zeros(n, np.int32)), ((sure & heads).astype(np.int32), np.ones(n, np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], ["key", "core", "span", "rid", "place", "weight", "sure"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash()
        core = length + 1 - (1 << LOG_SPAN)
        for batch in each(batches):
            data, offsets = texts(batch.column(1))
            rows = batch.column(0).to_numpy()
            found, n = [], 0
            for row, starts, ends in _pieces(offsets, length):
                if (ends - starts).max() < length:
                    continue
                base = starts[0]
                doc, trigger, first, last = _runs(hasher, data[base : ends[-1]], starts - base, ends - base, length)
                span = mix64(hasher.of(first, last + length) + _C[0] * (trigger - first).astype(np.uint64) + _C[1] * (last - first).astype(np.uint64))
                shift = base - offsets[row + doc]
                found.append((hasher.of(trigger, trigger + core), span, rows[row + doc], _place(first + shift, trigger + shift, last + shift)))
                n += len(doc)
                if n >= TOGETHER:
                    yield combined(found)
                    found, n = [], 0
            if found:
                yield combined(found)

    return run


def _contexts(length: int):
    """Of (rid, text, todo of (core, place)): the bytes of each place's strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in each(batches):
            for r in range(batch.num_rows):
                text = unzipped(batch.column(1), r)
                core, place = (batch.column(2)[r].values.field(k) for k in range(2))
                first = place.to_numpy() >> 14
                found = [text[i : i + n].tobytes() for i, n in zip(first.tolist(), ((place.to_numpy() & 127) + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([core, pa.array(np.repeat(batch.column(0)[r].as_py(), len(place))), place, pa.array(found, pa.binary())], ["core", "rid", "place", "bytes"])

    return run


def _ranks(rows: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of byte rows by core and then lexicographically, and for each in order the bytes it shares with the one before (-1: another core)."""
    keyed = np.concatenate([core.astype(">u8").view(np.uint8).reshape(len(core), 8), rows], axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"S{keyed.shape[1]}").reshape(-1), kind="stable")
    differ = keyed[order[1:]] != keyed[order[:-1]]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), keyed.shape[1])
    return order, np.concatenate([[-1], np.where(shared < 8, -1, shared - 8)])


def repeated_positions(core: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> np.ndarray:
    """For entries of phrases (bytes before the trigger, bytes from it on): which strings of left[-l:] + right[: length - l] another
    entry of the same core has too, as a matrix over l and entries. A string exists where both parts are that long."""
    n, most = len(core), 1 << LOG_SPAN
    sizes = np.array([[len(x) for x in left], [len(x) for x in right]])
    backward, forward = np.zeros((n, most), np.uint8), np.zeros((n, length), np.uint8)
    for k in range(n):
        backward[k, : sizes[0, k]] = np.frombuffer(left[k], np.uint8)[::-1]
        forward[k, : sizes[1, k]] = np.frombuffer(right[k], np.uint8)
    orders = [_ranks(rows, core) for rows in (backward, forward)]
    out = np.zeros((most, n), bool)
    height = max(1, (1 << 19) // n)
    for first in range(0, most, height):
        depth = np.arange(first, min(most, first + height))[:, None]
        ids = []
        for (order, shared), least in zip(orders, (depth, length - depth), strict=True):
            classes = np.empty((len(depth), n), np.int64)
            classes[:, order] = np.cumsum(shared[None, :] < least, axis=1)
            ids.append(classes)
        key = ids[0] * (n + 1) + ids[1]
        missing = (depth > sizes[0][None, :]) | (length - depth > sizes[1][None, :])
        key[missing] = -1 - np.broadcast_to(np.arange(n), key.shape)[missing]  # alone
        order = np.argsort(key, axis=1)
        ranked = np.take_along_axis(key, order, axis=1)
        ties = np.zeros(key.shape, bool)
        same = ranked[:, 1:] == ranked[:, :-1]
        ties[:, 1:] |= same
        ties[:, :-1] |= same
        np.put_along_axis(out[first : first + height], order, ties, axis=1)
    return out


def _merge(length: int, size: int = 2_048):
    """Marks the repeated positions of all entries of each core, from batches in which equal cores follow each other."""

    def marked(entries: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(entries).combine_chunks()
        place = rows.column("place").to_numpy()
        first, before, last = place >> 14, place >> 7 & 127, place & 127
        found = [x.as_py() for x in rows.column("bytes")]
        ties = repeated_positions(rows.column("core").to_numpy(), [x[:k] for x, k in zip(found, before.tolist(), strict=True)], [x[k:] for x, k in zip(found, before.tolist(), strict=True)], length)
        ties &= np.arange(len(ties))[:, None] >= (before - last)[None, :]  # no positions past the run of the trigger
        steps = np.diff(np.pad(ties.T, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        entry, low = np.nonzero(steps == 1)
        high = np.nonzero(steps == -1)[1] - 1
        rid = rows.column("rid").to_numpy()[entry]
        at = first[entry] + before[entry]
        return pa.RecordBatch.from_arrays([pa.array(rid), pa.array((at - high).astype(np.int32)), pa.array((at - low).astype(np.int32))], ["rid", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for table in segments(batches, "core"):
            if n and n + table.num_rows > size:
                yield marked(held)
                held, n = [], 0
            held.append(table)
            n += table.num_rows
        if held:
            yield marked(held)

    return run


def _steps(length: int):
    """Runs of up to STEP positions before their trigger: the bytes they share, all their bytes, and each one's string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = RollingHash()
        for batch in each(batches):
            for r in range(batch.num_rows):
                text = unzipped(batch.column(1), r)
                place = np.sort(batch.column(2)[r].values.to_numpy())
                first = place >> 14
                trigger, last = first + (place >> 7 & 127), first + (place & 127)
                at = 0
                while at < len(first):
                    base = first[at]
                    to = max(at + 1, int(np.searchsorted(first, base + CHUNK)))
                    hasher.load(text[base : last[to - 1] + length])
                    t, a, b = (x[at:to] - base for x in (trigger, first, last))
                    least, most = (t - b) // STEP, (t - a) // STEP
                    n = most - least + 1
                    which = np.repeat(np.arange(len(t)), n)
                    q = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + least[which]
                    high, low = t[which] - STEP * q, t[which] - STEP * q - STEP + 1
                    core = mix64(hasher.of(high, low + length) + _C[0])
                    i0, i1 = np.maximum(low, a[which]), np.minimum(high, b[which])
                    single = np.minimum(i0[:, None] + np.arange(STEP)[None, :], i1[:, None]).reshape(-1)
                    strings = hasher.of(single, single + length)
                    span = mix64(hasher.of(i0, i1 + length) + _C[1] * (i1 - i0).astype(np.uint64))
                    k = len(which)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(core.view(np.int64)), pa.array(span.view(np.int64)), pa.array(np.repeat(batch.column(0)[r].as_py(), k)), pa.array((i0 + base).astype(np.int32)), pa.array((i1 + base).astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(0, STEP * k + 1, STEP), pa.int32()), pa.array(strings.view(np.int64)))],
                        ["core", "span", "rid", "first", "last", "strings"],
                    )
                    at = to

    return run


def _undecided(phrases: DataFrame) -> DataFrame:
    """phrases without those that stand once: (core, rid, place, n, goes_on); n: the weight of the span; goes_on: this row stands for its span among several."""
    key, span = Window.partitionBy("key"), Window.partitionBy("key", "span")
    rows = phrases.repartition("key").select("*", F.sum("weight").over(span).alias("n"), F.row_number().over(span.orderBy("rid")).alias("k"))
    rows = rows.withColumn("several", (F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).over(key) > 1) | (F.max("sure").over(key) == 1))
    return rows.where("place >= 0").select("core", "rid", "place", "n", ((F.col("k") == 1) & F.col("several")).alias("goes_on")).where("n > 1 OR goes_on")


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, as maximal ones."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[new], end[np.concatenate([new[1:], [len(start)]]) - 1]


def repeated_spans(docs: DataFrame, length: int = 200, group: int = 32_768) -> DataFrame:
    """(rid, spans): for each row of docs (rid, text) that has any, the [start, end) byte spans whose strings of length bytes
    also start elsewhere, in the same text or another. rid may repeat only for equal texts. Spans may overlap and abut."""
    phrases = docs.mapInArrow(_phrases(length), "key long, core long, span long, rid long, place long, weight int, sure int")
    phrases = cut(_undecided(phrases))
    first = F.shiftright("place", 14)
    marks = phrases.where("n > 1").select("rid", first.cast("int").alias("first"), (first + F.col("place").bitwiseAND(127)).cast("int").alias("last"))
    packed = zipped(docs).dropDuplicates(["rid"])
    open_ = phrases.where("goes_on").select("core", "rid", "place")
    many = open_.groupBy("core").agg(F.count("*").alias("entries")).where(F.col("entries") > group).select("core", F.lit(True).alias("many"))
    large = None
    many = cut(many)
    if not many.isEmpty():
        open_ = cut(open_.join(many, "core", "left"))
        large, open_ = open_.where("many").select("rid", "place"), open_.where("many IS NULL")
    todo = open_.groupBy("rid").agg(F.collect_set(F.struct("core", "place")).alias("todo"))
    contexts = packed.join(todo, "rid").select("rid", "text", "todo").mapInArrow(_contexts(length), "core long, rid long, place long, bytes binary")
    ordered = contexts.repartition("core").sortWithinPartitions("core").mapInArrow(_merge(length), "rid long, first int, last int")
    marks = marks.unionByName(ordered)
    if large is not None:
        marks = marks.unionByName(_refined(packed, large, length))
    return marks.groupBy("rid").agg(F.collect_set(F.struct(F.col("first").alias("start"), (F.col("last") + length).alias("end"))).alias("spans"))


def _refined(packed: DataFrame, large: DataFrame, length: int) -> DataFrame:
    """(rid, first, last): the repeated positions of phrases with very many entries."""
    todo = large.groupBy("rid").agg(F.collect_set("place").alias("todo"))
    steps = packed.join(todo, "rid").select("rid", "text", "todo")
    steps = steps.mapInArrow(_steps(length), "core long, span long, rid long, first int, last int, strings array<long>")
    spans = steps.groupBy("core", "span").agg(F.count("*").alias("n"), F.min(F.struct("rid", "first")).alias("stands"))
    cores = spans.groupBy("core").agg((F.count("*") > 1).alias("several"))
    spans = spans.join(cores, "core").where("n > 1 OR several").select("core", "span", "n", "several", "stands")
    steps = steps.join(spans, ["core", "span"]).withColumn("goes_on", F.col("several") & (F.struct("rid", "first") == F.col("stands")))
    single = steps.where("goes_on").select("rid", F.posexplode("strings").alias("k", "string"), "first", "last").where("first + k <= last").select("rid", (F.col("first") + F.col("k")).alias("first"), "string")
    known = single.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    single = single.join(known, "string").select("rid", "first", F.col("first").alias("last"))
    return steps.where("n > 1").select("rid", "first", "last").unionByName(single)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in each(batches):
        size, removed, spans, shas = [], [], [], []
        for r in range(batch.num_rows):
            text = unzipped(batch.column(1), r).tobytes()
            size.append(len(text))
            todo = batch.column(2)[r]
            start = end = np.zeros(0, np.int64)
            if todo.is_valid:
                start, end = merge_spans(*(todo.values.field(k).to_numpy() for k in range(2)))
            sha, at = hashlib.sha256(), 0
            for s, e in zip(start.tolist(), end.tolist(), strict=True):
                sha.update(text[at:s])
                at = e
            sha.update(text[at:])
            removed.append(int((end - start).sum()))
            spans.append(len(start))
            shas.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in each(batches):
        out = []
        for r in range(batch.num_rows):
            text, todo = unzipped(batch.column(1), r), batch.column(2)[r]
            if todo.is_valid:
                start, end = merge_spans(*(todo.values.field(k).to_numpy() for k in range(2)))
                keep = np.ones(len(text), bool)
                for s, e in zip(start.tolist(), end.tolist(), strict=True):
                    while s < e and text[s] & 0xC0 == 0x80:  # spans end between characters
                        s += 1
                    while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
                        e -= 1
                    keep[s:e] = False
                text = text[keep]
            out.append(text.tobytes().decode())
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3, batch.num_columns)), pa.array(out, pa.string())], [*batch.schema.names[3:], "__cleaned"])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__rid", F.xxhash64(F.col("doc_id"), F.col("text")))


def remove_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """docs (doc_id, text, ...) with every repeated span cut out of its text; the same rows and columns.

    A character that a span covers in part stays. Null texts stay null; texts shorter than length never change; a text
    that is repeated as a whole becomes empty.
    """
    columns = docs.columns
    rows = _keyed(docs)
    spans = repeated_spans(rows.select(F.col("__rid").alias("rid"), F.coalesce("text", F.lit("")).alias("text")), length)
    packed = rows.select("__rid", "text", F.struct(*[docs[c] for c in columns if c != "text"]).alias("__row"))
    kind = packed.schema["__row"].dataType.simpleString()
    joined = zipped(packed).join(spans, F.col("__rid") == F.col("rid"), "left")
    packed = joined.select("__rid", "text", "spans", "__row", F.col("text").isNull().alias("__null"))
    cleaned = packed.mapInArrow(_clean, f"__row {kind}, __null boolean, __cleaned string")
    return cleaned.select(*[F.when(~F.col("__null"), F.col("__cleaned")).alias("text") if c == "text" else F.col("__row").getField(c).alias(c) for c in columns])


def repeat_digest(docs: DataFrame, length: int = 200, group: int = 32_768) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay.

    Null text counts as empty. Rows that repeat id and text are copies of each other, so they are removed whole if long
    enough. Further columns are ignored; an empty table gives an empty result.
    """
    rows = _keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    spans = repeated_spans(rows.select(F.col("__rid").alias("rid"), "text"), length, group)
    joined = zipped(rows).join(spans, F.col("__rid") == F.col("rid"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
