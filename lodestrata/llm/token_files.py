"""Token ids in binary files with a shared zstandard dictionary.

A dictionary is trained on the serialized ids of at most `max_sample` documents of at most `max_sample_chars` code
points, chosen by hash of their id (the documented bound). Documents are dealt by range of doc_id, encoded, each
compressed on its own with that dictionary, and packed into shards of about `shard_bytes`. A shard is one binary value:

    magic "LTOK", version u32, id width u32 (2 or 4), 0 u32, sha256 of the dictionary (32 bytes), documents u64, ids u64,
    doc_id i64 each, number of ids u64 each, offset of each frame and of the end u64, frames

so one document is read by its offset alone (`Shard.ids`). Shards and the dictionary are written by Spark as Parquet
tables `shards` and `dictionary` under one folder, which gives the commit of tasks and any file system Spark knows.

Texts are encoded by the tokenizers library's model: each distinct match of the vocabulary's own pattern once by a
process, as no token crosses matches; `matches` finds them for many texts at once.

Null texts count as empty and have the end id alone. A null doc_id is stored as the smallest 64-bit integer and comes
first. Rows with one doc_id stand side by side, in order of length. Other columns are ignored. Strings of
the vocabulary's added tokens in a text become those tokens, as in the library's plain encode: such texts go through it.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .matches import Recent, encode_texts
from .storage import partitions, shared_folder
from .wordbatch import chunks, keep

#: Bytes that a generation of known matches may take, about, and bytes of text that are encoded together.
CACHE_WORDS, TEXT_BYTES = 64 << 20, 4 << 20
END = 0
LEVEL = 3
SHARD_BYTES = 4 << 20
MAX_SAMPLE, MAX_SAMPLE_CHARS, DICTIONARY_BYTES = 1500, 20_000, 64 << 10
NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4sIII32sQQ")
RESULT = "part int, seq int, doc_id long, local long, n_tokens long, ids_crc32 long"


#: A character for each byte, as in byte-level vocabularies: printable ones of Latin-1 stand for themselves, the others take those from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTERS = np.arange(256, dtype="<u4")
_LETTERS[sorted(set(range(256)) - _PRINTABLE)] = np.arange(256, 256 + 256 - len(_PRINTABLE))


class Encoder:
    """The tokenizers library behind a cache of matches."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.normalizer is not None or not isinstance(self.tokenizer.pre_tokenizer, ByteLevel):
            raise ValueError("a byte-level vocabulary is needed")
        self.merge = self.tokenizer.model.tokenize
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.words = Recent(CACHE_WORDS)

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Ids of each match: the library's model merges its letters."""
        letters = _LETTERS[np.frombuffer(b"".join(words), np.uint8)].tobytes().decode("utf-32-le")
        at = [0, *accumulate(map(len, words))]
        ids: list[int] = []
        ends = [0]
        for a, b in zip(at, at[1:], strict=False):
            ids += [t.id for t in self.merge(letters[a:b])]
            ends.append(len(ids) * self.width)
        raw = np.array(ids, f"<u{self.width}").tobytes()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def _ids(self, words: list[bytes]) -> list[bytes]:
        new = self.words.unknown(words)
        self.words.learn(new, self._merged(new))
        return list(map(self.words.__getitem__, words))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Ids of each text, little-endian and self.width bytes each; strings of added tokens are ordinary text."""
        return encode_texts(data, offsets, self.width, self._ids)

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """As encode(), but strings of added tokens are those tokens."""
        out, raw = self.encode(data, offsets), data.tobytes()
        for d in self._with_added(raw, offsets):
            text = raw[offsets[d] : offsets[d + 1]].decode()
            out[d] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, f"<u{self.width}").tobytes()
        return out

    def _with_added(self, raw: bytes, offsets: np.ndarray) -> set[int]:
        """Texts that contain an added token."""
        found: set[int] = set()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                d = int(np.searchsorted(offsets, at, side="right")) - 1
                inside = at + len(token) <= offsets[d + 1]
                if inside:
                    found.add(d)
                at = raw.find(token, int(offsets[d + 1]) if inside else at + 1)
        return found


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    keep("tokens", _encoders.clear)
    return _encoders[path]


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


class Shard:
    """A shard's index, and its documents on demand."""

    def __init__(self, blob: bytes, dictionary: bytes):
        magic, version, self.width, _, digest, n, self.n_tokens = _HEAD.unpack_from(blob)
        if magic != b"LTOK" or version != 1:
            raise ValueError("not a shard of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("another dictionary is needed")
        at = _HEAD.size
        self.doc_ids = np.frombuffer(blob, "<i8", n, at)
        self.counts = np.frombuffer(blob, "<u8", n, at + 8 * n)
        self.offsets = np.frombuffer(blob, "<u8", n + 1, at + 16 * n)
        self.frames = memoryview(blob)[at + 24 * n + 8 :]
        self.reader = zstandard.ZstdDecompressor(dict_data=dictionary_of(dictionary))

    def ids(self, i: int) -> np.ndarray:
        """All ids of the i-th document, the end id too."""
        raw = self.reader.decompress(self.frames[int(self.offsets[i]) : int(self.offsets[i + 1])], max_output_size=int(self.counts[i]) * self.width)
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")


def pack(doc_ids: list[int], counts: list[int], frames: list[bytes], width: int, dictionary: bytes) -> bytes:
    offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).astype("<u8")
    head = _HEAD.pack(b"LTOK", 1, width, 0, hashlib.sha256(dictionary).digest(), len(frames), sum(counts))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<u8").tobytes(), offsets.tobytes(), *frames])


def _serialized(path: str):
    def run(batches):
        code = encoder(path)
        for batch in batches:
            ids = [i for _, _, data, offsets in chunks(batch.column(0), TEXT_BYTES, owner="tokens") for i in code.plain(data, offsets)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    return run


def train(docs: DataFrame, path: str, *, max_sample: int = MAX_SAMPLE, max_sample_chars: int = MAX_SAMPLE_CHARS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for short documents; without enough text, none (no bytes)."""
    n = docs.count()
    share = min(1.0, (2 * max_sample + 20) / n) if n else 0.0
    h = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1))
    some = docs.where(h <= F.lit(int(share * (1 << 30)))).where(F.length("text").between(1, max_sample_chars)).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_sample)
    samples = sorted(bytes(r[0]) for r in some.select("text").mapInArrow(_serialized(path), "ids binary").collect())
    total = sum(map(len, samples))
    if len(samples) < 20 or total < 20_000:
        return b""
    try:
        return zstandard.train_dictionary(min(size, total // 4), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _pack_partition(path: str, dictionary: bytes, width: int, shard_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        code, end = encoder(path), END.to_bytes(width, "little")
        writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary_of(dictionary))
        doc_ids: list[int] = []
        counts: list[int] = []
        frames: list[bytes] = []
        held = 0

        def flush():
            nonlocal seq, held
            blob = pack(doc_ids, counts, frames, width, dictionary)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([sum(counts)], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "n_tokens", "shard"])
            seq, held = seq + 1, 0
            doc_ids.clear(), counts.clear(), frames.clear()
            return out

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for first, last, data, offsets in chunks(batch.column(1), TEXT_BYTES, owner="tokens"):
                for doc_id, got in zip(ids[first:last], code.plain(data, offsets), strict=True):
                    got += end
                    doc_ids.append(NO_ID if doc_id is None else doc_id)
                    counts.append(len(got) // width)
                    frames.append(writer.compress(got))
                    held += len(frames[-1]) + 24
                    if held >= shard_bytes:
                        yield flush()
        if frames:
            yield flush()

    return run


def write(docs: DataFrame, folder: str, *, path: str | None = None, shard_bytes: int = SHARD_BYTES, **sample) -> None:
    """Writes the ids of docs (doc_id, text) as shards and their dictionary under folder, in ascending doc_id order."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    width = encoder(path).width
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    dictionary = train(rows, path, **sample)
    spark = docs.sparkSession
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), bytearray(dictionary))], "hash string, dictionary binary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    # texts are dealt before they are encoded: dealing by range reads its input twice
    size = rows.agg(F.sum(F.octet_length("text"))).head()[0]
    # rows that share a doc_id are dealt by their text, so no id is one task; in its order they come by length
    by = [F.col("doc_id").asc_nulls_first(), F.length("text").asc(), F.xxhash64("text").asc()]
    dealt = rows.repartitionByRange(partitions(rows, size), *by).sortWithinPartitions(*by, "text")
    shards = dealt.mapInArrow(_pack_partition(path, dictionary, width, shard_bytes), "part int, seq int, n_tokens long, shard binary")
    shards.write.mode("overwrite").option("compression", "none").parquet(f"{folder}/shards")


def _read(dictionary: bytes):
    def run(batches):
        for batch in batches:
            for part, seq, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(blob.as_buffer().to_pybytes(), dictionary)
                n = len(shard.doc_ids)
                crc = [zlib.crc32(shard.ids(i)) for i in range(n)]
                counts = shard.counts.astype(np.int64)
                doc_id = pa.array(shard.doc_ids, mask=shard.doc_ids == NO_ID)
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), doc_id, pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])

    return run


def read_digest(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files."""
    dictionary = bytes(spark.read.parquet(f"{folder}/dictionary").head()["dictionary"])
    shards = spark.read.parquet(f"{folder}/shards")
    # starts follow the order of ranges: one number for each range in one window, the shards of a range in another
    each = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    base = each.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("base"))
    own = F.coalesce(F.sum("n_tokens").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    starts = shards.select("part", "seq", own.alias("own")).join(base, F.col("part") == F.col("p")).select("part", "seq", (F.col("base") + F.col("own")).alias("before"))
    rows = shards.select("part", "seq", "shard").mapInArrow(_read(dictionary), RESULT).join(starts, ["part", "seq"])
    return rows.select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, **options) -> DataFrame:
    """The round trip, through a folder of its own beside the checkpoints."""
    spark = docs.sparkSession
    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, **options)
    return read_digest(spark, folder)
