"""Operator 9, removal of repeated 50-byte strings with suffix arrays over shards.

A byte goes if it is covered by a string of ``width`` bytes that also starts in a document with a smaller doc_id.
Strings that are equal must meet in one shard without moving all text. Each window of ``width`` bytes is keyed by
the least hash of its 16-byte grams, which equal windows share, and neighbouring windows of one key form a run of some 18.
Keys that only one document has are dropped. Of runs with equal content all but those of the smallest document
go whole. Of the others, where different runs share a key, a window has 16 bytes more on one side of its gram at least, and
equal windows have them on the same side; so only runs that share a side with a run of another document are brought together
with their bytes by key. Each shard of them gets a suffix array by induced sorting, its permuted common prefixes tell which windows are equal, and the
least document of each such set wins. So an exact copy costs one row a run, and only the edges of repeated
stretches are sorted. A key that very many runs share is dealt again by the least hash of 32-byte grams, and at
last of whole windows, so no shard outgrows a task.

Runs count as equal if a 64-bit hash of their bytes and the 64-bit key agree; what suffix arrays decide is compared by its bytes.

Defined results: null text is empty; matches never cross documents; rows with a null doc_id are neither changed nor
matched; rows of one doc_id don't match each other; repeated rows (id and text) are looked at once and each cut alike; texts under
``width`` bytes stay; very long texts are cut into runs like others; an empty table gives no rows; other columns pass through or are
ignored, and none can clash with the operator's own, which have names of their own.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import private, read_table, slices, stored, text_bytes
from .suffix_array import common_prefixes, suffix_array

WIDTH = 50
GRAMS = (16, 32, 50)  # bytes in a gram, by level
LONGEST = 64  # windows in a run
SIDE = 16  # bytes beside a gram that tell its runs apart
SIDES = 1 << 12  # values of a side
SHARD = 1 << 20
CROWD = 1 << 12  # runs of one key beyond which they are dealt again by longer grams
RUN = "m bigint, doc_id bigint, th bigint, at int, content binary"
SPANS = "doc_id bigint, th bigint, start bigint, length bigint"


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()


def gram_hashes(eight: np.ndarray, grams: int, gram: int = GRAMS[0]) -> np.ndarray:
    """Hashes of the first `grams` grams, of 16 bytes at least."""
    least = _mixed(eight[:grams] * np.uint64(0x9E3779B97F4A7C15) ^ eight[gram - 8 : gram - 8 + grams] * np.uint64(0xC2B2AE3D27D4EB4F))
    for k in range(8, gram - 8, 8):  # what lies between the first and the last eight
        least = _mixed(least * np.uint64(0x9E3779B97F4A7C15) ^ eight[k : k + grams] * np.uint64(0xC2B2AE3D27D4EB4F))
    return least


def least_hashes(least: np.ndarray, width: int = WIDTH, gram: int = GRAMS[0]) -> np.ndarray:
    """For each window the least hash of its grams."""
    wanted, reach = width - gram + 1, 1
    while reach < wanted:
        step = min(reach, wanted - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least


def window_keys(raw: np.ndarray, width: int = WIDTH, gram: int = GRAMS[0]) -> np.ndarray:
    """For each window of raw, the least hash of its grams, of 16 bytes at least."""
    return least_hashes(gram_hashes(_eights(raw), len(raw) - gram + 1, gram), width, gram)


def run_sides(eight: np.ndarray, hashes: np.ndarray, keys: np.ndarray, first: np.ndarray, n: np.ndarray, width: int = WIDTH, gram: int = GRAMS[0]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (1 to SIDES - 1) of the SIDE bytes left and right of each run's gram, 0 where no window needs that side.

    A window's gram is its leftmost one of the least hash, so equal windows have it at the same place. With SIDE bytes of the
    window before it, the left side counts for that window, else the right one: equal windows are in runs that agree in one.
    Both are 0 if windows of the run have their grams at different places: such a run may have a window in common with any.
    """
    slack = width - gram
    if slack < 2 * SIDE - 1:
        return np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
    own = keys[first]
    place = first + slack  # a key under that of the window before has come with the last gram, and there only
    open_ = np.flatnonzero((first == 0) | (own >= keys[np.maximum(first, 1) - 1]))
    for k in range(slack):
        hit = hashes[first[open_] + k] == own[open_]
        place[open_[hit]] = first[open_[hit]] + k
        open_ = open_[~hit]
    last = first + n - 1
    one = place >= last

    def side(wanted: np.ndarray, at: int) -> np.ndarray:
        out = np.zeros(len(first), np.int64)
        p = place[wanted] + at
        out[wanted] = (_mixed(eight[p] * np.uint64(0x9E3779B97F4A7C15) ^ eight[p + SIDE - 8] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(16)) % np.uint64(SIDES - 1) + np.uint64(1)
        return out

    return side(np.flatnonzero(one & (place - first >= SIDE)), -SIDE), side(np.flatnonzero(one & (place - last < SIDE)), gram)


def window_runs(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAMS[0], key: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, key) of every run; rows are raw[offsets[i]:offsets[i+1]], key their window_keys if known."""
    none = np.zeros(0, np.int64)
    if len(raw) < width:
        return none, none, none, none
    key = window_keys(raw, width, gram) if key is None else key
    row = np.searchsorted(offsets, np.arange(len(key)), side="right") - 1
    at = np.flatnonzero(np.arange(len(key)) + width <= offsets[row + 1])
    if not len(at):
        return none, none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (key[at[1:]] != key[at[:-1]]) | (row[at[1:]] != row[at[:-1]])
    start = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    start = np.flatnonzero(within % LONGEST == 0)
    first = at[start]
    return row[first], first - offsets[row[first]], np.diff(np.append(start, len(at))), key[first].view(np.int64)


class Seen:
    """Contents met in several documents of this task, and the least of these: the map side of the aggregation.

    A run whose content a smaller document of the task holds goes whole, whatever other tasks find, so it needn't
    meet the runs of its key. A passage or text that very many documents share so sends a few rows a task. Contents are
    equal when both their hash and their key are: of a mixture and the hash that is mixed in, the key follows.
    """

    def __init__(self, most: int = 1 << 18):
        self.mixed, self.content, self.doc, self.most = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), most

    def copies(self, key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which runs are sure to go; remembers contents of more than one document."""
        mixed = content ^ key * np.int64(-7046029254386353131)
        order = np.lexsort((doc, content, mixed))
        own, whole, docs = mixed[order], content[order], doc[order]
        start = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (whole[1:] != whole[:-1]))))
        size = np.diff(np.append(start, len(own)))
        least = docs[start]
        at = np.minimum(np.searchsorted(self.mixed, own[start]), max(0, len(self.mixed) - 1))
        held = (self.mixed[at] == own[start]) & (self.content[at] == whole[start]) if len(self.mixed) else np.zeros(len(start), bool)
        before = np.where(held, self.doc[at] if len(self.doc) else least, least)
        gone = np.empty(len(own), bool)
        gone[order] = docs > np.repeat(np.minimum(least, before), size)
        several = held | (docs[start + size - 1] > least)
        mixed, first = np.unique(np.concatenate([own[start][several], self.mixed]), return_index=True)
        self.content = np.concatenate([whole[start][several], self.content])[first]
        self.doc = np.concatenate([np.minimum(least, before)[several], self.doc])[first]
        self.mixed = mixed
        if len(mixed) > self.most:  # forgetting costs rows, not results
            self.mixed, self.content, self.doc = (np.zeros(0, np.int64) for _ in range(3))
        return gone


class Once:
    """Rows of this task whose id and text were met before: a row that is repeated very often sends its runs once a task."""

    def __init__(self, most: int = 1 << 18):
        self.met: set[tuple[int, int]] = set()
        self.most = most

    def new(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        if len(self.met) > self.most:  # forgetting costs rows, not results
            self.met.clear()
        fresh = []
        for pair in zip(batch.column("doc_id").to_pylist(), batch.column("th").to_pylist()):
            fresh.append(pair not in self.met)
            self.met.add(pair)
        return batch if all(fresh) else batch.filter(pa.array(fresh))


def _runs(batches, width: int):
    seen, once = Seen(), Once()
    for whole in batches:
        for batch in slices(once.new(whole), "text"):
            raw, offsets = text_bytes(batch.column("text"))
            if len(raw) < width:
                continue
            eight = _eights(raw)
            hashes = gram_hashes(eight, len(raw) - GRAMS[0] + 1)
            keys = least_hashes(hashes, width)
            row, at, n, key = window_runs(raw, offsets, width, key=keys)
            if not len(row):
                continue
            data, first = raw.tobytes(), at + offsets[row]
            left, right = run_sides(eight, hashes, keys, first, n, width)
            digest = xxhash.xxh64_intdigest
            content = np.array([digest(data[a:b]) for a, b in zip(first.tolist(), (first + n + width - 1).tolist())], np.uint64).view(np.int64)
            doc = batch.column("doc_id").to_numpy()[row]
            gone = seen.copies(key, content, doc)
            # runs that are settled are spread by a key of their own
            key = np.where(gone, content ^ (doc * 0x1000003 + at) * np.int64(-7046029254386353131), key)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.array(doc), batch.column("th").take(pa.array(row)), pa.array((((at * 64 + n - 1) * SIDES + left) * SIDES + right) * 2 + gone)], names=["m", "sh", "doc_id", "th", "place"])


def _content(batches, width: int):
    """The bytes of each wanted run, from its document's text."""
    for whole in batches:
        for batch in slices(whole, "text"):
            raw, offsets = text_bytes(batch.column("text"))
            data, runs = raw.tobytes(), batch.column("runs")
            row = np.repeat(np.arange(batch.num_rows), np.asarray(runs.value_lengths()))
            fields = runs.flatten()
            at, n = fields.field("at").to_numpy(), fields.field("n").to_numpy()
            first = at + offsets[row]
            parts = [data[a:b] for a, b in zip(first.tolist(), (first + n + width - 1).tolist())]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([fields.field("m"), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(at), pa.array(parts, pa.binary()), fields.field("crowded")], names=["m", "doc_id", "th", "at", "content", "crowded"])


def _dealt_again(batches, width: int, gram: int):
    """Runs of crowded keys cut where the least hash of longer grams changes, under their old and new key, with their bytes."""
    for whole in batches:
        for batch in slices(whole, "content", 1 << 20):
            raw, offsets = text_bytes(batch.column("content"))
            row, at, n, key = window_runs(raw, offsets, width, gram)
            if not len(row):
                continue
            data, first = raw.tobytes(), at + offsets[row]
            parts = [data[a:b] for a, b in zip(first.tolist(), (first + n + width - 1).tolist())]
            content = np.array([xxhash.xxh64_intdigest(p) for p in parts], np.uint64).view(np.int64)
            old = batch.column("m").to_numpy()[row]
            take = pa.array(row)
            place = batch.column("at").to_numpy().astype(np.int32)[row] + at.astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key ^ old * np.int64(-7046029254386353131)), pa.array(content), batch.column("doc_id").take(take), batch.column("th").take(take), pa.array(place), pa.array(parts, pa.binary())], names=["m", "sh", "doc_id", "th", "at", "content"])


def shard_spans(parts: list[bytes], docs: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first window, windows) of maximal runs of windows that also lie in a part of a smaller document."""
    size = np.array([len(p) for p in parts])
    start = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    text = np.zeros(int(start[-1] + size[-1]) + 2, np.int16)
    flat = np.frombuffer(b"".join(parts), np.uint8)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(parts)), size)] = flat.astype(np.int16) + 2
    text[start + size] = 1  # parts end by a mark of their own
    text[-1] = 0
    own = np.repeat(np.arange(len(parts)), size - width + 1)
    at = np.arange(len(own)) - np.repeat(np.cumsum(size - width + 1) - (size - width + 1), size - width + 1) + start[own]
    valid = np.full(len(text), -1, np.int64)
    valid[at] = own
    order = suffix_array(text, 258, 64)
    order = order[valid[order] >= 0]
    alike = common_prefixes(text, order, width)[order] >= width
    group = np.flatnonzero(~alike)
    doc = docs[valid[order]]
    least = np.repeat(np.minimum.reduceat(doc, group), np.diff(np.append(group, len(order))))
    gone = np.zeros(len(text), bool)
    gone[order[least < doc]] = True
    gone = gone[at]
    new = gone.copy()
    new[1:] &= ~gone[:-1] | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    last = gone.copy()
    last[:-1] &= ~gone[1:] | (own[1:] != own[:-1])
    return own[first], at[first] - start[own[first]], np.flatnonzero(last) - first + 1


def _shards(batches, width: int):
    """Of rows sorted by m: spans of each shard of whole keys."""
    held: list[pa.RecordBatch] = []
    size = 0

    def spans(table: pa.Table):
        docs = table["doc_id"].to_numpy()
        part, first, n = shard_spans(table["content"].to_pylist(), docs, width)
        took = table.select(["doc_id", "th", "at"]).take(pa.array(part))
        return pa.RecordBatch.from_arrays([took["doc_id"].combine_chunks(), took["th"].combine_chunks(), pa.array(took["at"].to_numpy().astype(np.int64) + first), pa.array(n + width - 1)], names=["doc_id", "th", "start", "length"])

    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= 2 * SHARD:
            table = pa.Table.from_batches(held)
            key = table["m"].to_numpy()
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on
            ends = np.cumsum(pc.binary_length(table["content"]).to_numpy())
            at = 0
            while at < whole:  # whole keys of about a shard
                upto = min(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SHARD)), whole - 1)
                upto = min(int(np.searchsorted(key, key[upto], side="right")), whole)
                yield spans(table.slice(at, upto - at))
                at = upto
            held, size = table.slice(whole).to_batches(), table.slice(whole).nbytes
    if held and sum(b.num_rows for b in held):
        yield spans(pa.Table.from_batches(held))


def _copies(rows: DataFrame, length, width: int) -> DataFrame:
    return rows.select("doc_id", "th", F.col("at").cast("bigint").alias("start"), (length + (width - 1)).cast("bigint").alias("length"))


def _sorted_edges(runs: DataFrame, width: int) -> DataFrame:
    """Spans of runs (RUN) by suffix arrays, shard by shard of whole keys."""
    return runs.repartition("m").sortWithinPartitions("m").mapInArrow(lambda it: _shards(it, width), SPANS)


def _crowded(runs: DataFrame, width: int, crowd: int, level: int) -> list[DataFrame]:
    """Spans of runs (RUN) of crowded keys, dealt again by longer grams until no key is crowded.

    Here very many runs may be equal, so they are counted with partial aggregation and not in windows. The last
    grams are as long as a window: then all runs of a key are equal, and nothing is left to sort.
    """
    dealt = stored(runs.mapInArrow(lambda it: _dealt_again(it, width, min(GRAMS[level], width)), "m bigint, sh bigint, doc_id bigint, th bigint, at int, content binary"), f"dealt{level}")
    alike = stored(dealt.groupBy("m", "sh").agg(F.min("doc_id").alias("own"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")), f"alike{level}")
    keys = alike.groupBy("m").agg(F.min("own").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("contents"), F.sum("n").alias("runs"))
    seen = dealt.join(alike.select("m", "sh", "own"), ["m", "sh"])
    copies = _copies(seen.filter("doc_id > own"), F.octet_length("content") - (width - 1), width)
    last = level + 1 == len(GRAMS)
    met = keys.filter("contents > 1 and lo < hi").select("m", (F.lit(not last) & (F.col("runs") > crowd)).alias("crowded"))
    left = stored(seen.filter("doc_id = own").join(met, "m").select("m", "doc_id", "th", "at", "content", "crowded"), f"left{level}")
    again = left.filter("crowded").drop("crowded")
    out = [copies, _sorted_edges(left.filter("not crowded").drop("crowded"), width)]
    return out if last or again.isEmpty() else out + _crowded(again, width, crowd, level + 1)


def _met(runs: DataFrame, crowd: int) -> DataFrame:
    """Runs that go whole (copy), and those that may have a window in common with a different run of another document."""
    alike, met = Window.partitionBy("m", "sh"), Window.partitionBy("m")
    left, right = F.shiftright("place", 13).bitwiseAND(SIDES - 1), F.shiftright("place", 1).bitwiseAND(SIDES - 1)
    seen = runs.withColumn("own", F.min("doc_id").over(alike))
    seen = seen.withColumn("lo", F.min("doc_id").over(met)).withColumn("hi", F.max("doc_id").over(met)).withColumn("several", F.min("sh").over(met) != F.max("sh").over(met)).withColumn("wild", F.min(F.greatest(left, right)).over(met) == 0)
    copy = (F.col("place") % 2 == 1) | (F.col("doc_id") > F.col("own"))
    seen = seen.filter(copy | ((F.col("lo") < F.col("hi")) & F.col("several")))
    seen = seen.select("m", "doc_id", "th", F.shiftright("place", 31).cast("int").alias("at"), (F.shiftright("place", 25).bitwiseAND(63) + 1).cast("int").alias("n"), copy.alias("copy"), "wild", left.alias("left"), right.alias("right"))
    other = F.when(~F.col("copy"), F.col("doc_id"))  # what a copy has, the run that it is a copy of has
    for side in ("left", "right"):
        beside = Window.partitionBy("m", side)
        seen = seen.withColumn(f"by_{side}", (F.col(side) > 0) & (F.min(other).over(beside) < F.max(other).over(beside)))
    seen = seen.filter("copy or wild or by_left or by_right")
    return seen.select(F.when(~F.col("copy"), F.col("m")).alias("m"), "doc_id", "th", "at", "n", "copy", (F.count(other).over(met) > crowd).alias("crowded"))


def repeated_spans(docs: DataFrame, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """(doc_id, th, start, length) in bytes of stretches to remove, which may overlap; th is xxhash64 of the text.

    Keys of more than `crowd` runs would outgrow a shard; their runs are dealt again by longer grams.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= width))
    runs = rows.mapInArrow(lambda it: _runs(it, width), "m bigint, sh bigint, doc_id bigint, th bigint, place bigint")
    kept = stored(_met(runs, crowd), "runs")
    wanted = kept.filter("not copy").groupBy(F.col("doc_id").alias("of"), F.col("th").alias("of_th")).agg(F.collect_set(F.struct("m", "at", "n", "crowded")).alias("runs"))
    own = rows.join(wanted, (rows.doc_id == F.col("of")) & (rows.th == F.col("of_th"))).select("doc_id", "th", "text", "runs")
    content = stored(own.mapInArrow(lambda it: _content(it, width), f"{RUN}, crowded boolean"), "content")  # texts move once, and are gone before their runs move
    edges = [_sorted_edges(content.filter("not crowded").drop("crowded"), width)]
    crowds = content.filter("crowded").drop("crowded")
    if not crowds.isEmpty():
        edges += _crowded(crowds, width, crowd, 1)
    return _copies(kept.filter("copy"), F.col("n"), width).unionByName(stored(reduce(DataFrame.unionByName, edges), "edges"))


def remaining(text: str | None, starts, lengths) -> tuple[bytes, int, int]:
    """What is left, bytes removed and maximal removed runs."""
    raw = (text or "").encode()
    if starts is None or not len(starts):
        return raw, 0, 0
    left, at, spans = [], 0, 0
    end = -1
    for a, b in sorted(zip(starts, (a + n for a, n in zip(starts, lengths)))):
        if a > end:
            left.append(raw[max(at, 0) : a])
            spans += 1
            end = b
        else:
            end = max(end, b)
        at = end
    left.append(raw[at:])
    kept = b"".join(left)
    return kept, len(raw) - len(kept), spans


def with_spans(docs: DataFrame, keep: list[str], width: int = WIDTH, crowd: int = CROWD) -> tuple[DataFrame, str]:
    """docs' columns `keep`, text, and an array of (start, length) of what to remove (null where nothing); and that array's name.

    Rows that are repeated get one set of spans, however often they come.
    """
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    of, of_text, spans, own_id, own_text = private(rows.columns, "of", "of_text", "spans", "own_id", "own_text")
    found = repeated_spans(docs, width, crowd).groupBy(F.col("doc_id").alias(of), F.col("th").alias(of_text)).agg(F.collect_set(F.struct("start", "length")).alias(spans))
    keyed = rows.withColumns({own_id: F.col("doc_id").cast("bigint"), own_text: F.xxhash64("text")})
    joined = keyed.join(found, (F.col(own_id) == F.col(of)) & (F.col(own_text) == F.col(of_text)), "left")
    return joined.select(*rows.columns, spans), spans


def _left(batch: pa.RecordBatch, spans: str) -> list[tuple[bytes, int, int]]:
    return [remaining(t, [x["start"] for x in own or ()], [x["length"] for x in own or ()]) for t, own in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist())]


def digest(docs: DataFrame, width: int = WIDTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    found, spans = with_spans(docs, ["doc_id"], width, crowd)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                out = [[len(kept) + gone, gone, runs, hashlib.sha256(kept).hexdigest()] for kept, gone, runs in _left(batch, spans)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(zip(*out), [pa.int64()] * 3 + [pa.string()]))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with the repeated bytes taken out of text (and of a character, all its bytes), and n_chars to match where there is such a column."""
    found, spans = with_spans(docs, docs.columns, width)
    names, schema = docs.columns, docs.schema

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                kept = [left.decode(errors="ignore") if ok else None for ok, (left, _, _) in zip(batch.column("text").is_valid().to_pylist(), _left(batch, spans))]
                columns = {c: batch.column(c) for c in names} | {"text": pa.array(kept, pa.string())}
                if "n_chars" in columns:
                    columns["n_chars"] = pa.array([None if t is None else len(t) for t in kept]).cast(columns["n_chars"].type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return found.mapInArrow(run, schema)


def op9_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return digest(read_table(spark, sf_dir, "documents"))
