"""Token ids in fixed-width bit packs, in global document order.

A pack is one binary value and holds whole documents (little endian)::

    magic "GSBP", u16 version, u16 bits per id, u32 ids per block,
    u32 documents, u64 ids, u32 blocks
    i64 document key, u8 key present, u64 id count     one array after the other
    u64 block offset in the payload                    one per block, and the end
    payload: per block, its ids at ``bits`` bits each, padded to whole bytes

``bits`` is the least width that holds the vocabulary.  Any block is found by
its offset and unpacked with numpy alone, so a reader fetches ids ``a..b``
without touching the rest.  Packs are rows of a Parquet dataset: Spark's own
committer then decides which task attempt counts, on any file system.

Cases: a null or empty text has only the end id; a null key sorts first and
comes back as null; rows with equal keys follow each other in text order, each
with its own ids; an empty table gives an empty file.  A document is never cut,
so a pack is as large as ``PACK_IDS`` ids or one document.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldsieve.durable import new_folder
from goldsieve.llm.word_tokens import WordEncoder

BLOCK_IDS = 8192
PACK_IDS = 1 << 20
_MAGIC = b"GSBP"
_HEAD = struct.Struct("<4sHHIIQI")
PACKS = "shard int, pack int, first_id bigint, n_ids bigint, payload binary"


def id_bits(vocabulary: int) -> int:
    """The least number of bits for ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    wide = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    flags = np.unpackbits(wide, axis=1, bitorder="little")[:, :bits]
    return np.packbits(flags.ravel(), bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, count: int, bits: int) -> np.ndarray:
    flags = np.unpackbits(
        np.frombuffer(data, np.uint8), count=count * bits, bitorder="little"
    ).reshape(count, bits)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :bits] = flags
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def build_pack(keys: list[int | None], counts: list[int], ids: np.ndarray, bits: int) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    blocks = [pack_bits(ids[at : at + BLOCK_IDS], bits) for at in range(0, len(ids), BLOCK_IDS)]
    offsets = np.zeros(len(blocks) + 1, "<u8")
    np.cumsum([len(block) for block in blocks], out=offsets[1:])
    return b"".join(
        (
            _HEAD.pack(_MAGIC, 1, bits, BLOCK_IDS, len(keys), len(ids), len(blocks)),
            np.array([key or 0 for key in keys], "<i8").tobytes(),
            np.array([key is not None for key in keys], np.uint8).tobytes(),
            np.array(counts, "<u8").tobytes(),
            offsets.tobytes(),
            *blocks,
        )
    )


class Pack:
    """Reader of one pack; ``ids`` unpacks only the blocks it needs."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block_ids, docs, self.n_ids, blocks = _HEAD.unpack_from(data)
        if magic != _MAGIC or version != 1:
            raise ValueError("not a token pack")
        at = _HEAD.size
        keys = np.frombuffer(data, "<i8", docs, at)
        present = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.keys = [int(key) if there else None for key, there in zip(keys, present)]
        self.counts = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self._offsets = np.frombuffer(data, "<u8", blocks + 1, at + 17 * docs).astype(np.int64)
        self._payload = memoryview(data)[at + 17 * docs + 8 * (blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // self.block_ids, (stop - 1) // self.block_ids
        parts = [
            unpack_bits(
                self._payload[self._offsets[n] : self._offsets[n + 1]],
                min(self.block_ids, self.n_ids - n * self.block_ids),
                self.bits,
            )
            for n in range(first, last + 1)
        ]
        skip = first * self.block_ids
        return np.concatenate(parts)[start - skip : stop - skip]


    def checks(self) -> list[int]:
        """crc32 of each document's ids as u32; every block is unpacked once."""
        found, at = [0] * len(self.keys), 0
        starts = (np.cumsum(self.counts) - self.counts).tolist()
        counts = self.counts.tolist()
        for low in range(0, self.n_ids, self.block_ids):
            ids = self.ids(low, min(low + self.block_ids, self.n_ids))
            while at < len(counts) and starts[at] < low + len(ids):
                end = starts[at] + counts[at]
                part = ids[max(0, starts[at] - low) : end - low]
                found[at] = zlib.crc32(part, found[at])
                if end > low + len(ids):
                    break
                at += 1
        return found


def write_packs(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs(doc_id, text)`` and write packs ordered by ``doc_id``.

    The texts are dealt by key range before they are encoded, so nothing is
    tokenised for sampling and each text moves once.  ``shard`` is the range's
    number; ``first_id`` counts within the shard.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer)
        bits, end = id_bits(encoder.vocabulary), np.array([end_id], "<u4").tobytes()
        shard, pack, first, size = TaskContext.get().partitionId(), 0, 0, 0
        keys: list[int | None] = []
        counts: list[int] = []
        parts: list[bytes] = []

        def flush() -> pa.RecordBatch:
            data = build_pack(keys, counts, np.frombuffer(b"".join(parts), "<u4"), bits)
            columns = [[shard], [pack], [first], [size], [data]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                ["shard", "pack", "first_id", "n_ids", "payload"],
            )

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encoder.encode(text.as_py() or "") + end
                if size and size + len(raw) // 4 > PACK_IDS:
                    yield flush()
                    pack, first, size = pack + 1, first + size, 0
                    keys.clear(), counts.clear(), parts.clear()
                keys.append(key)
                counts.append(len(raw) // 4)
                parts.append(raw)
                size += len(raw) // 4
        if keys:
            yield flush()

    ordered = (
        docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(encode, PACKS).write.parquet(path)


def read_packs(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the packs at ``path``.

    ``start`` is global.  It needs the id count of each earlier shard: one row
    per write task meets in one window, however large the corpus.
    """
    packs = spark.read.schema(PACKS).parquet(path)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, first, data in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            ):
                pack = Pack(data.as_py())
                starts = np.cumsum(pack.counts) - pack.counts
                checks = pack.checks()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pack.keys, pa.int64()),
                        pa.array([shard] * len(checks), pa.int32()),
                        pa.array(starts + first, pa.int64()),
                        pa.array(pack.counts, pa.int64()),
                        pa.array(checks, pa.int64()),
                    ],
                    ["doc_id", "shard", "at", "n_tokens", "ids_crc32"],
                )

    rows = packs.select("shard", "first_id", "payload").mapInArrow(
        unpack, "doc_id bigint, shard int, at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    shards = packs.groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).selectExpr(
        "shard", "sum(n_ids) OVER (ORDER BY shard) - n_ids AS before"
    )
    return rows.join(F.broadcast(shards), "shard").select(
        "doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def packed_tokens(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as packs in the shared folder and read them back."""
    path = new_folder(docs.sparkSession, "packs")
    write_packs(docs, path, tokenizer, end_id)
    return read_packs(docs.sparkSession, path)
