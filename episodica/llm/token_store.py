"""Operator 10, token ids in binary shards with a shared zstandard dictionary.

Each document's ids (the end id included) are serialized as little-endian integers of 2 or 4 bytes and
compressed on their own, with one dictionary trained on serialized documents, so a short document is read
by decompressing its frame alone. Layout of a shard:

    magic ETOKS001 | frames | index: doc_id int64[n], null flag uint8[n], n_tokens uint64[n], frame offset uint64[n+1]
    trailer: uint64 n, uint64 index position, uint32 width, uint32 crc32 of the index, 32 bytes SHA-256 of the
    dictionary, magic ETOKE001

The dictionary lies beside the shards in a file named by its hash; readers refuse another one. It is trained
on at most ``sample`` documents (a parameter), whose ids are picked first; with too few for training the shards use none.

Documents are range-partitioned and sorted by doc_id, so shards ascend by partition and number. A task writes
under a name of its own, and only shards in the manifest, which Spark commits, count; a retried task
leaves an unlisted file.

Defined results: null text is empty; null ids come first; repeated rows are stored each, rows of one id side by side in any order, over
several shards where they are many; very long texts are frames like others; an empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, of_ids, read_table, slices
from .tokens import END_ID, Encoder, encoder, vocabulary_path

START, STOP = b"ETOKS001", b"ETOKE001"
TRAILER = struct.Struct("<QQII32s8s")
SHARD_BYTES = 64 << 20
DICTIONARY_BYTES = 1 << 16
MANIFEST = "path string, part int, number int, n_docs bigint, n_tokens bigint"


def train_dictionary(ids: list[np.ndarray], width: int, size: int = DICTIONARY_BYTES) -> bytes:
    """Of serialized id arrays; where they are too few to train on they are the dictionary's content themselves, longest last, up to its size."""
    samples = [x.astype(f"<u{width}").tobytes() for x in ids]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sorted(set(samples), key=lambda x: (len(x), x)))[-size:]


def _options(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


class ShardWriter:
    def __init__(self, stream, dictionary: bytes, width: int, level: int = 3):
        self.stream, self.width, self.hash = stream, width, hashlib.sha256(dictionary).digest()
        self.pack = zstandard.ZstdCompressor(level=level, **_options(dictionary)).compress
        self.ids, self.sizes, self.offsets = [], [], [len(START)]
        stream.write(START)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        frame = self.pack(ids.astype(f"<u{self.width}").tobytes())
        self.stream.write(frame)
        self.ids.append(doc_id)
        self.sizes.append(len(ids))
        self.offsets.append(self.offsets[-1] + len(frame))

    def close(self) -> None:
        index = b"".join([np.array([x or 0 for x in self.ids], "<i8").tobytes(), bytes(x is None for x in self.ids), np.array(self.sizes, "<u8").tobytes(), np.array(self.offsets, "<u8").tobytes()])
        self.stream.write(index)
        self.stream.write(TRAILER.pack(len(self.ids), self.offsets[-1], self.width, zlib.crc32(index), self.hash, STOP))
        self.stream.close()


class ShardReader:
    """Random access to the documents of a shard, by their place in it."""

    def __init__(self, file, dictionary: bytes):
        self.file = file
        end = file.size()
        n, at, self.width, crc, digest, magic = TRAILER.unpack(self._read(end - TRAILER.size, TRAILER.size))
        if magic != STOP or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard, or written with another dictionary")
        index = self._read(at, end - TRAILER.size - at)
        if zlib.crc32(index) != crc:
            raise ValueError("the shard's index is damaged")
        ids, none = np.frombuffer(index, "<i8", n), np.frombuffer(index, "u1", n, 8 * n)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, none)]
        self.sizes = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(index, "<u8", n + 1, 17 * n).astype(np.int64)
        self.unpack = zstandard.ZstdDecompressor(**_options(dictionary)).decompress

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def _ids(self, frame, k: int) -> np.ndarray:
        return np.frombuffer(self.unpack(frame, max_output_size=max(1, int(self.sizes[k]) * self.width)), f"<u{self.width}").astype("<u4")

    def document(self, k: int) -> np.ndarray:
        return self._ids(self._read(int(self.offsets[k]), int(self.offsets[k + 1] - self.offsets[k])), k)

    def scan(self, block: int = 4 << 20):
        """(doc_id, ids) of every document, reading some MB at a time."""
        k = 0
        while k < len(self):
            end = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + block, side="right")) - 1)
            raw = self._read(int(self.offsets[k]), int(self.offsets[end] - self.offsets[k]))
            for j in range(k, end):
                yield self.doc_ids[j], self._ids(raw[self.offsets[j] - self.offsets[k] : self.offsets[j + 1] - self.offsets[k]], j)
            k = end


def _open(folder: str):
    store, path = pafs.FileSystem.from_uri(folder)
    return store, path


def _width(path: str) -> int:
    return 2 if Encoder(path).tokenizer.get_vocab_size() <= 1 << 16 else 4


def encode_documents(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID, sample: int = 1000, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write docs' ids to shards in the folder; the manifest, a row per shard."""
    spark, path = docs.sparkSession, path or vocabulary_path()
    width = _width(path)
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    picked = source.filter("doc_id is not null and text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).distinct()
    texts = [r["text"] for r in sorted(of_ids(source, picked).collect(), key=lambda r: r["doc_id"])]
    ids, offsets = Encoder(path, end_id).encode(pa.array(texts, pa.string()))
    dictionary = train_dictionary([ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])], width)
    store, place = _open(folder)
    store.create_dir(place, recursive=True)
    with store.open_output_stream(f"{place}/{hashlib.sha256(dictionary).hexdigest()}.zdict") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)

    def run(batches):
        store, place = _open(folder)
        part, number, writer, name, encode = TaskContext.get().partitionId(), 0, None, "", encoder(path, end_id).encode

        def done():
            writer.close()
            return pa.RecordBatch.from_pydict({"path": [name], "part": pa.array([part], pa.int32()), "number": pa.array([number], pa.int32()), "n_docs": [len(writer.ids)], "n_tokens": [sum(writer.sizes)]})

        for whole in batches:
            for batch in slices(whole, "text"):
                ids, offsets = encode(batch.column("text"))
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    if writer is None:
                        name = f"shard-{part:06d}-{number:04d}-{uuid.uuid4().hex}.tok"
                        writer = ShardWriter(store.open_output_stream(f"{place}/{name}"), shared.value, width)
                    writer.add(doc_id, ids[a:b])
                    if writer.offsets[-1] >= shard_bytes:
                        yield done()
                        writer, number = None, number + 1
        if writer is not None:
            yield done()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id, equal ones too, may span several ranges
    keyed = source.withColumns({"head": F.substring("text", 1, 40), "spread": F.rand(7)})
    ordered = keyed.repartitionByRange(parts, "doc_id", "head", "spread").sortWithinPartitions("doc_id", "text").select("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and the ids, if wanted) of every stored document."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    store, place = _open(folder)
    (held,) = [x.path for x in store.get_file_info(pafs.FileSelector(place)) if x.path.endswith(".zdict")]
    with store.open_input_stream(held) as f:
        shared = spark.sparkContext.broadcast(f.read())
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        store, place = _open(folder)
        for batch in batches:
            for name, at in zip(*(batch.column(c).to_pylist() for c in ("path", "base"))):
                with store.open_input_file(f"{place}/{name}") as f:
                    rows = []
                    for doc_id, ids in ShardReader(f, shared.value).scan():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids)) + ((ids.astype(np.int64),) if with_ids else ()))
                        at += len(ids)
                        if len(rows) == 2000:
                            yield _batch(rows, names)
                            rows = []
                    if rows:
                        yield _batch(rows, names)

    spread = shards.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=names)


def op10_token_store(spark, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    encode_documents(read_table(spark, sf_dir, "documents"), folder)
    return read_documents(spark, folder)
