"""Token ids in a bit-plane file format.

Ids of a run of whole documents form a chunk. A chunk is cut into blocks of
``BLOCK`` ids; a block is transposed into one plane per used bit, so that the
high bits, which seldom change, compress to almost nothing, and each plane is
compressed with zstandard. A chunk is a row of a Parquet table, so that any
store Spark can write keeps it and task retries leave no half files; the chunk
index, a second small table, gives each chunk's place in the whole sequence.

Payload of a chunk: for each block a header of two little-endian 32-bit numbers
(ids, planes), one 32-bit length for each plane, then the planes, lowest bit first.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import q
from ..session import scratch_path
from .common import Memo

BLOCK = 65_536
#: A chunk ends with the document that brings it to this many ids.
CHUNK_IDS = 262_144
LEVEL = 3
END_ID = 2
#: Pieces of text whose ids a worker remembers.
REMEMBER = 600_000


def pack_block(ids: np.ndarray, compressor: zstandard.ZstdCompressor) -> bytes:
    """One block of unsigned 32-bit ids as bit planes."""
    planes = int(ids.max(initial=0)).bit_length()
    bits = np.unpackbits(ids.astype("<u4").view("u1").reshape(-1, 4), axis=1, bitorder="little", count=planes)
    rows = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    parts = [compressor.compress(row.tobytes()) for row in rows]
    return struct.pack(f"<II{planes}I", len(ids), planes, *map(len, parts)) + b"".join(parts)


def unpack_chunk(payload: bytes) -> np.ndarray:
    """All ids of a chunk, in order."""
    expand, at, out = zstandard.ZstdDecompressor(), 0, []
    while at < len(payload):
        count, planes = struct.unpack_from("<II", payload, at)
        lengths = struct.unpack_from(f"<{planes}I", payload, at + 8)
        at += 8 + 4 * planes
        bits = np.zeros((count, 32), dtype="u1")
        for plane, length in enumerate(lengths):
            raw = np.frombuffer(expand.decompress(payload[at : at + length]), dtype="u1")
            bits[:, plane] = np.unpackbits(raw, bitorder="little", count=count)
            at += length
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, dtype="u4")


def pack_chunk(ids: np.ndarray) -> bytes:
    compressor = zstandard.ZstdCompressor(level=LEVEL)
    return b"".join(pack_block(ids[a : a + BLOCK], compressor) for a in range(0, len(ids), BLOCK))


#: How byte-level tokenizers part a text, written out for texts up to U+00FF.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PARTS = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)


def _byte_names() -> dict[int, str]:
    """Byte-level name of each byte: printable ones name themselves, the others follow U+00FF in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(256 + i) for i, b in enumerate(others)}


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of texts, remembered for their parts.

    A byte-level tokenizer first parts a text by a fixed pattern and then merges
    bytes inside each part. Parts of letters up to U+00FF are cut here and go to the
    merging model alone; what stands between blanks with other letters goes to the
    whole tokenizer, which always parts a text before a blank or line end that
    something else than white space follows. Texts for another kind of tokenizer are
    encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # A special token's name inside a text is ordinary text.
        self._tokenizer.encode_special_tokens = True
        self._merge = self._tokenizer.model.tokenize
        self._names = _byte_names()
        self._known = Memo(self._part, REMEMBER)
        plan = json.loads(self._tokenizer.to_str())
        first = plan["pre_tokenizer"] or {}
        self._parted = plan["normalizer"] is None and (
            first.get("type"), first.get("use_regex"), first.get("add_prefix_space")
        ) == ("ByteLevel", True, False)

    @staticmethod
    def pieces(text: str) -> list[str]:
        out = [""]
        for mark, line in zip(["", *["\n"] * text.count("\n")], text.split("\n")):
            for part in line.split(" "):
                if part and mark and not part[0].isspace():
                    out.append(mark + part)
                else:  # a run of white space is cut before its last character only
                    out[-1] += mark + part
                mark = " "
        return out

    def parts(self, text: str) -> list[str]:
        """Stretches of the text that are encoded on their own."""
        if not self._parted:
            return [text]
        if _is_latin(text):
            return PARTS.findall(text)
        return [part for piece in self.pieces(text) for part in (PARTS.findall(piece) if _is_latin(piece) else [piece])]

    def _part(self, part: str) -> bytes:
        if self._parted and _is_latin(part):
            named = part.encode().decode("latin-1").translate(self._names)
            ids = [token.id for token in self._merge(named)]
        else:
            ids = self._tokenizer.encode(part, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        self._known.claim()
        parts = self.parts(text) if text else []
        return np.frombuffer(b"".join(map(self._known.__getitem__, parts)), dtype="<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file, where the driver has it or as shipped by :func:`write_ids`."""
    if path not in _encoders:
        _encoders[path] = Encoder(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)))
    return _encoders[path]


_CHUNKS = "part int, chunk int, n_ids long, docs array<struct<doc_id:bigint,n_tokens:bigint>>, payload binary"


def _chunks(rows: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk = TaskContext.get().partitionId(), 0
        docs: list[tuple] = []
        held: list[np.ndarray] = []
        size = 0
        end = np.array([end_id], dtype="<u4")

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            kinds = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64())]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()), pa.array([chunk], pa.int32()), pa.array([len(ids)], pa.int64()),
                    pa.array([[{"doc_id": d, "n_tokens": n} for d, n in docs]], pa.list_(pa.struct(kinds))),
                    pa.array([pack_chunk(ids)], pa.binary()),
                ],
                ["part", "chunk", "n_ids", "docs", "payload"],
            )

        encode = encoder(vocabulary).encode
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py())
                held += [ids, end]
                docs.append((doc, len(ids) + 1))
                size += len(ids) + 1
                if size >= CHUNK_IDS:
                    yield flush()
                    docs, held, size, chunk = [], [], 0, chunk + 1
        if docs:
            yield flush()

    return rows.mapInArrow(run, _CHUNKS)


def write_ids(
    df: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text"
) -> None:
    """Write all texts' ids, each followed by ``end_id``, in ascending id order.

    Null and empty texts give the end id alone. Rows without id come first; rows
    that share an id follow each other, ordered by a hash of their text. An empty table
    gives an empty file. The texts are sorted before they are encoded: one pass
    encodes, packs and writes.
    """
    spark = df.sparkSession
    rows = df.select(q(id_column).cast("long").alias("doc_id"), q(text_column).alias("text"))
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The hash parts rows that share an id, or have none, over several tasks.
    keys = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(wide, *keys).sortWithinPartitions(*keys, "text")
    spark.sparkContext.addFile(vocabulary)
    _chunks(ordered, vocabulary, end_id).write.parquet(f"{path}/chunks")
    sizes = spark.read.parquet(f"{path}/chunks").select("part", "chunk", "n_ids", F.size("docs").alias("n_docs"))
    # One row for each sorted part comes to the driver: as many as the sort had partitions.
    totals = sorted(tuple(r) for r in sizes.groupBy("part").agg(F.sum("n_ids")).collect())
    offsets, total = {}, 0
    for part, n in totals:
        offsets[part] = total
        total += n
    starts = spark.createDataFrame(list(offsets.items()), "part int, first long")
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    index = sizes.join(starts, "part").select("part", "chunk", (F.col("first") + before).alias("start"), "n_ids", "n_docs")
    index.write.parquet(f"{path}/index")


def read_ids(spark: SparkSession, path: str, keep_ids: bool = True) -> DataFrame:
    """Documents of a file: ``doc_id, start, n_tokens, ids_crc32`` and, unless
    declined, ``ids`` (array of longs)."""
    chunks = spark.read.parquet(f"{path}/chunks").select("part", "chunk", "docs", "payload")
    index = spark.read.parquet(f"{path}/index").select("part", "chunk", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, payload, at in zip(*[batch.column(c).to_pylist() for c in ("docs", "payload", "start")]):
                ids = unpack_chunk(payload)
                ends = np.cumsum([d["n_tokens"] for d in docs])
                cuts = list(zip([0, *ends[:-1]], ends))
                out = [
                    pa.array([d["doc_id"] for d in docs], pa.int64()),
                    pa.array([at + int(a) for a, _ in cuts], pa.int64()),
                    pa.array([int(b - a) for a, b in cuts], pa.int64()),
                    pa.array([zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in cuts], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array([ids[a:b].astype("i8") for a, b in cuts], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if keep_ids else "")
    return chunks.join(index, ["part", "chunk"]).select("docs", "payload", "start").mapInArrow(run, schema)


def token_file(df: DataFrame, vocabulary: str, **columns: str) -> DataFrame:
    """Write the ids to a new file in the shared folder and read the documents back."""
    path = scratch_path(df.sparkSession, "ids")
    write_ids(df, path, vocabulary, **columns)
    return read_ids(df.sparkSession, path, keep_ids=False)
