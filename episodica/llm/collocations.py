"""Phrase collocation mining: bucket counts of the next length in each pass, and Apriori pruning, before phrases are counted exactly.

Pass k reads the texts once. It counts, by their words, those phrases of k words that can still be frequent: both their parts of
k-1 words were found frequent (Apriori) and their hash falls in a bucket that was full enough in the pass before (PCY). Beside
them it counts the buckets of all phrases of k+1 words made of two such phrases (DHP), for the pass after. What is broadcast are
two bitmaps of `buckets` bits, whatever the size of the input; bucket counts stop at the threshold, so a task holds one byte a
bucket. Both filters only err towards keeping a phrase; counts are sums over phrases by their words, so results are exact at any
size: more text than buckets only makes the filters keep more.

Defined results: a null text is empty and a null language `und`; empty texts add nothing; very long texts are read whole, cut for
memory at bytes that end a piece; every one of repeated rows counts; ties in score go to the larger count and then to the lesser
phrase; an empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored, text_bytes

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
INSIDE = 80  # per cent of its occurrences that lie in one longer candidate
TOP = 2000
BUCKETS = 1 << 24  # a power of two: bytes of a task, bits of a bitmap
BLOCK = 1 << 18  # buckets that are added up together
STEP = 4 << 20  # text bytes looked at together

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK, BREAK = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = BLANK
KIND[[*b".,;:!?\n\x0b\x0c\r"]] = BREAK
PARTS = "lang string, phrase string, n long, block int, counts binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _longer(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    return _mixed(h * np.uint64(0xD6E8FEB86659FD93) + word)


def _word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang))


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(bytes, offsets of texts, language of each text) of about STEP bytes; longer texts are cut where a piece ends."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column(0))
        langs = batch.column(1).fill_null("und")
        bounds, owner = [], []
        for k, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            while end - begin > STEP:
                ends = np.flatnonzero(KIND[raw[begin + STEP : end]] == BREAK)
                if not len(ends):
                    break
                bounds.append(begin + STEP + int(ends[0]) + 1)
                owner.append(k)
                begin = bounds[-1]
            bounds.append(end)
            owner.append(k)
        at, own, first = np.array([0, *bounds]), np.array(owner, np.int64), 0
        while first < len(own):
            last = max(first + 1, int(np.searchsorted(at, at[first] + STEP, side="right")) - 1)
            yield raw[at[first] : at[last]], at[first : last + 1] - at[first], langs.take(pa.array(own[first:last]))
            first = last


class Texts:
    """The words of some texts: for each occurrence its type (language and word, numbered) and its piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: pa.Array):
        kind = KIND[raw]
        inside = kind == 0
        begins = offsets[:-1][np.diff(offsets) > 0]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        starts[begins] = inside[begins]
        place = np.flatnonzero(starts)
        text = np.searchsorted(offsets, place, side="right") - 1
        self.piece = np.cumsum(kind == BREAK, dtype=np.int64)[place] + text
        kept = LOWER[raw[inside]]
        bounds = np.append(np.cumsum(inside, dtype=np.int64)[place] - 1, len(kept))
        words = pa.Array.from_buffers(pa.large_binary(), len(place), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
        spoken = langs.dictionary_encode()
        size = max(1, len(words.dictionary))
        pair = np.asarray(spoken.indices, np.int64)[text] * size + np.asarray(words.indices, np.int64)
        types, self.ids = np.unique(pair, return_inverse=True)
        self.word, self.lang = words.dictionary.take(pa.array(types % size)), spoken.dictionary.take(pa.array(types // size))
        seeds = {x: xxhash.xxh64_intdigest(x.encode()) for x in spoken.dictionary.to_pylist()}
        self.hashes = np.array([xxhash.xxh64_intdigest(w, seeds[x]) for w, x in zip(self.word.to_pylist(), self.lang.to_pylist())], np.uint64)

    def phrases(self, length: int) -> np.ndarray:
        """Which occurrences begin that many words of one piece."""
        n = len(self.ids) - length + 1
        return self.piece[:n] == self.piece[length - 1 :] if n > 0 else np.zeros(0, bool)

    def hashed(self, length: int) -> np.ndarray:
        word = self.hashes[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        h = word
        for k in range(1, length):
            h = _longer(h[: max(0, len(word) - k)], word[k:])
        return h

    def counted(self, begins: np.ndarray, length: int) -> pa.RecordBatch:
        """Language, words and count of the different phrases that begin there."""
        key, size = self.ids[begins].astype(np.int64), len(self.word)
        for k in range(1, length):
            _, key = np.unique(key * size + self.ids[begins + k], return_inverse=True)
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        parts = [self.word.take(pa.array(self.ids[begins[first] + k])).cast(pa.large_string()) for k in range(length)]
        joined = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        lang = self.lang.take(pa.array(self.ids[begins[first]]))
        return _rows(lang=lang.cast(pa.string()), phrase=joined.cast(pa.string()), n=pa.array(n, pa.int64()))


def _rows(**columns: pa.Array) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "block": pa.int32(), "counts": pa.binary()}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in kinds.items()], names=list(kinds))


class Buckets:
    """Counts of buckets that stop at the threshold: sums of such counts reach it exactly when the true sums do."""

    def __init__(self, n: int, least: int):
        self.least = least
        self.counts = np.zeros(n, next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if 2 * least <= np.iinfo(t).max))

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique(hashes & np.uint64(len(self.counts) - 1), return_counts=True)
        self.counts[at] = np.minimum(self.counts[at] + np.minimum(n, self.least), self.least)

    def blocks(self, block: int) -> Iterator[pa.RecordBatch]:
        for k in range(0, len(self.counts), block):
            if (own := self.counts[k : k + block]).any():
                yield _rows(block=pa.array([k // block], pa.int32()), counts=pa.array([zstandard.compress(own.tobytes(), 1)], pa.binary()))


def _held(bits: np.ndarray | None) -> np.ndarray | None:
    return None if bits is None else np.unpackbits(bits).astype(bool)


def _pass(length: int, full, frequent, buckets: int, block: int, least: int, longest: int):
    """Rows of PARTS: exact counts of phrases of this length that may be frequent, and buckets of the next length."""

    def run(batches):
        allowed, parts = _held(full and full.value), _held(frequent and frequent.value)
        mask, next_ones = np.uint64(buckets - 1), Buckets(buckets, least) if length < longest else None
        for raw, offsets, langs in _steps(batches):
            texts = Texts(raw, offsets, langs)
            likely = texts.phrases(length)
            if parts is not None:
                of_part = parts[texts.hashed(length - 1) & mask]
                likely = likely & of_part[:-1] & of_part[1:] if len(likely) else likely
            if allowed is not None:
                likely &= allowed[texts.hashed(length) & mask]
            begins = np.flatnonzero(likely)
            if not len(begins):
                continue
            yield texts.counted(begins, length)
            if next_ones:
                two = texts.phrases(length + 1)
                next_ones.add(texts.hashed(length + 1)[two & likely[:-1] & likely[1:]])
        if next_ones:
            yield from next_ones.blocks(block)

    return run


def _added(block: int, least: int, bits: bool):
    """Blocks of counts added up, a block of buckets at a time in memory for each of the partition's; bits: which are full."""

    def run(batches):
        held: dict[int, Buckets] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = held.setdefault(k, Buckets(block, least))
                own.counts = np.minimum(own.counts + np.frombuffer(zstandard.decompress(data), own.counts.dtype), least).astype(own.counts.dtype)
        for k, own in held.items():
            data = np.packbits(own.counts >= least).tobytes() if bits else zstandard.compress(own.counts.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["block", "counts"])

    return run


def _bitmap(parts: DataFrame, buckets: int, block: int, least: int, tag: str) -> np.ndarray:
    """The full buckets, as packed bits on the driver: `buckets` / 8 bytes. Blocks are added in two levels, so no task gets all tasks' blocks."""
    kind = "block int, counts binary"
    own = parts.filter("block is not null").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(32)).alias("part"))
    once = own.repartition("block", "part").select("block", "counts").mapInArrow(_added(block, least, False), kind)
    whole = stored(once.repartition("block").mapInArrow(_added(block, least, True), kind), tag)
    out = np.zeros(buckets // 8, np.uint8)
    for row in whole.toLocalIterator():
        out[row["block"] * block // 8 : (row["block"] + 1) * block // 8] = np.frombuffer(row["counts"], np.uint8)
    return out


def _marked(buckets: int, block: int, least: int):
    """Buckets of phrases that are frequent, marked full."""

    def run(batches):
        own = Buckets(buckets, least)
        for batch in batches:
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = [np.array([_word_hash(lang.encode(), w)], np.uint64) for w in phrase.encode().split(b" ")]
                h = hashes[0]
                for w in hashes[1:]:
                    h = _longer(h, w)
                own.counts[int(h[0]) & (buckets - 1)] = least
        yield from own.blocks(block)

    return run


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[list[DataFrame], DataFrame]:
    """Tables (lang, phrase, n) of the phrases of 1 to `longest` words met `least` times or more, and (lang, n) of all words."""
    if buckets & (buckets - 1) or buckets < 8:
        raise ValueError("buckets must be a power of two, 8 at least")
    spark, block = docs.sparkSession, min(BLOCK, buckets)
    texts, found, full, frequent, words = docs.select("text", "lang"), [], None, None, None
    for length in range(1, longest + 1):
        parts = stored(texts.mapInArrow(_pass(length, full, frequent, buckets, block, least, longest), PARTS), f"phrases-{length}")
        counted = parts.filter("block is null").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        if length == 1:
            words = parts.filter("block is null").groupBy("lang").agg(F.sum("n").alias("n"))
        found.append(stored(counted.filter(F.col("n") >= least), f"frequent-{length}"))
        if length < longest:
            marks = found[-1].select("lang", "phrase").mapInArrow(_marked(buckets, block, least), PARTS)
            full, frequent = (spark.sparkContext.broadcast(_bitmap(x, buckets, block, least, "bitmap")) for x in (parts, marks))
    return found, words


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, inside: int = INSIDE, top: int = TOP, buckets: int = BUCKETS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` candidates.

    A candidate is met least times or more and has its lowest-scoring cut; those of whose occurrences `inside` per cent or more lie in
    one longer candidate are left out. Ranks come in two steps, so that no task gets all candidates of a language.
    """
    found, words = frequent_phrases(docs, least, longest, buckets)
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    own = F.split("phrase", " ")
    candidates = every.filter(F.instr("phrase", " ") > 0).select("lang", "phrase", F.col("n").alias("a"), own.alias("words"), F.size(own).alias("size"))
    joined = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", joined(F.lit(1), F.col("k")).alias("left"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    part = lambda side, n: every.select("lang", F.col("phrase").alias(side), F.col("n").alias(n))
    both = cuts.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"])
    score = F.expr("cast(2000000 as decimal(38,0)) * a div (cast(l as decimal(38,0)) + r)").alias("score")
    lowest = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("cut"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("words", i, m), " "))))
    around = candidates.filter("size > 2").select("lang", "a", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    free = F.col("around").isNull() | (F.lit(100).cast("decimal(38,0)") * F.col("around") < F.lit(inside) * F.col("a").cast("decimal(38,0)"))
    left = lowest.join(around, ["lang", "phrase"], "left").filter(free).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = left.withColumn("place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


#: The same question by plain counting.
SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
lists as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
places as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from lists),
sized as (select lang, ws, i, unnest([1, 2, 3, 4]) as k from places),
grams as (select lang, k, array_to_string(ws[i : i + k - 1], ' ') as phrase from sized where i + k - 1 <= len(ws)),
counts as (select lang, k, phrase, count(*) as a from grams group by lang, k, phrase),
totals as (select lang, sum(a)::bigint as n from counts where k = 1 group by lang),
candidates as (select lang, phrase, k as size, a, string_split(phrase, ' ') as ws from counts where k > 1 and a >= 30),
cuts as (select lang, phrase, size, a, ws, unnest(range(1, size)) as k from candidates),
scored as (
  select c.lang, c.phrase, c.a, c.k, f.a as l, g.a as r, (2000000::hugeint * c.a) // (f.a::hugeint + g.a) as score
  from cuts c join counts f on f.lang = c.lang and f.phrase = array_to_string(c.ws[1 : c.k], ' ')
  join counts g on g.lang = c.lang and g.phrase = array_to_string(c.ws[c.k + 1 : c.size], ' ')),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
begins as (select lang, a, ws, size, unnest(range(1, size)) as i from candidates where size > 2),
inner_ones as (select lang, a, ws, size, i, unnest(range(2, size)) as m from begins),
around as (select lang, array_to_string(ws[i : i + m - 1], ' ') as phrase, max(a) as most from inner_ones where i + m - 1 <= size group by 1, 2),
kept as (select w.* from lowest w left join around o on o.lang = w.lang and o.phrase = w.phrase where o.most is null or 100 * o.most < 80 * w.a),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select r.lang, rank::bigint as rank, r.phrase, r.a::bigint as a, r.l::bigint as l, r.r::bigint as r, t.n, r.score::bigint as score
from ranked r join totals t on t.lang = r.lang where rank <= 2000
"""
