"""Token-id output by fixed-width bit packing.

A file holds the ids of a run of documents, each id in the fewest bits that the vocabulary needs:

    8 bytes   magic "TOKPACK1"
    4 x u32   bits per id, documents, ids, ids per block
    u64[]     byte offset of each block in the payload (one more than there are blocks)
    i64[]     document ids (the least 64-bit integer: null)
    u64[]     index of each document's first id (one more than there are documents)
    payload   blocks, each packed on its own, least significant bit first

All numbers are little-endian. Blocks unpack independently with numpy, so a document or a range of
ids is read without the rest. ``write`` deals documents to files in ascending (doc_id, text) order
and stores each file as one binary cell of a table in the shared folder, so that Spark commits
whole files and lost tasks leave nothing behind; ``export`` writes the same bytes as plain files.

Null texts count as empty, null ids come first; repeated rows are stored each, and an empty table
gives no files. Only id and text are read, so other columns and their names do not matter. A text
longer than a file's share makes a file of its own.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAGIC = b"TOKPACK1"
BLOCK_IDS = 1 << 16
FILE_IDS = 2_000_000
NULL_ID = -(2**63)
STORE = 300_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in ``bits`` bits each, least significant first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from the one numbered ``start``."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count, start * bits // 8).astype(np.uint32)
    first = start * bits
    raw = np.frombuffer(data, np.uint8)[first // 8 : (first + count * bits + 7) // 8]
    flat = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + count * bits].reshape(count, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def build(doc_ids: list[int], ids: np.ndarray, lengths: list[int], bits: int) -> bytes:
    blocks = [pack(ids[i : i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    starts = np.cumsum([0, *lengths], dtype="<u8")
    head = MAGIC + struct.pack("<4I", bits, len(doc_ids), len(ids), BLOCK_IDS)
    return b"".join([head, offsets.tobytes(), np.array(doc_ids, "<i8").tobytes(), starts.tobytes(), *blocks])


class TokenFile:
    """Random access to one file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.bits, self.n_docs, self.n_ids, self.block = struct.unpack_from("<4I", data, 8)
        n_blocks, at = -(-self.n_ids // self.block), 24
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at)
        at += 8 * (n_blocks + 1)
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at)
        self.payload = memoryview(data)[at + 8 * (self.n_docs + 1) :]

    def ids(self, start: int, count: int) -> np.ndarray:
        out = []
        while count:
            k, inner = divmod(start, self.block)
            n = min(count, self.block - inner)
            out.append(unpack(self.payload[int(self.offsets[k]) : int(self.offsets[k + 1])], self.bits, inner, n))
            start, count = start + n, count - n
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1] - self.starts[k]))


# the normalizer and pre-tokenizer of the one kind of file that is encoded piece by piece (fixed values of that format)
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# letters, numbers and white space below U+0180, where NFC changes nothing and every lower case is one letter (but for U+0130)
_L, _N, _S = "a-zªµºß-öø-ÿ\u0100-\u017f", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BEYOND = re.compile("[\u0130\u0180-\U0010ffff]")
#: Characters that are cut into pieces at once; longer texts are cut at a space, which no piece crosses.
RUN_CHARS = 1 << 20
_ENCODERS: dict[str, tuple] = {}


def _byte_symbols() -> dict[int, int]:
    """Byte-level symbols: visible Latin-1 characters stand for themselves, the other bytes for U+0100 onwards."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


class _Kept(dict):
    """Packed ids by piece, worked out when first asked for; emptied when full."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= STORE:
            self.clear()
        ids = self.ids_of(piece)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self[piece] = packed
        return packed


def _runs(text: str) -> Iterator[str]:
    lo = 0
    while len(text) - lo > RUN_CHARS:
        hi = text.find(" ", lo + RUN_CHARS)
        if hi < 0:
            break
        yield text[lo:hi]
        lo = hi
    yield text[lo:] if lo else text


def encoder(path: str):
    """(vocabulary size, encode): encode gives a text's ids as little-endian unsigned 32-bit integers.

    With the normalizer and pre-tokenizer known above no piece crosses white space, so each distinct
    piece goes through the model once a worker: texts below U+0180 are lower-cased and cut by the same
    pattern here; of other texts, and of those that spell an added token, whole words go through the
    library. Any other file's texts go through the library whole."""
    if path in _ENCODERS:
        return _ENCODERS[path]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    whole = lambda text: tok.encode(text, add_special_tokens=False).ids
    conf = json.loads(tok.to_str())
    added = [t for t in conf["added_tokens"] or []]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not re.search(r"\s", t["content"]) for t in added)
    if conf["normalizer"] == KNOWN_NORMALIZER and conf["pre_tokenizer"] == KNOWN_SPLIT and not conf["model"].get("dropout") and plain:
        symbols, model = _byte_symbols(), tok.model.tokenize
        special = re.compile("|".join(re.escape(t["content"]) for t in added) or r"(?!)")
        word = _Kept(whole)

        def by_model(piece: str) -> list[int]:
            return [t.id for t in model(piece.encode().decode("latin-1").translate(symbols))]

        piece = _Kept(by_model)

        def encode(text: str) -> bytes:
            out = []
            for run in _runs(text):
                if _BEYOND.search(run) or special.search(run):
                    out.extend(map(word.__getitem__, _WORD.findall(run)))
                else:
                    out.extend(map(piece.__getitem__, _PIECE.findall(run.lower())))
            return b"".join(out)
    else:

        def encode(text: str) -> bytes:
            return np.array(whole(text), "<u4").tobytes()

    _ENCODERS[path] = tok.get_vocab_size(with_added_tokens=True), encode
    return _ENCODERS[path]


_WORD = re.compile(r"[^\t-\r ]+")


FILE_SCHEMA = "shard int, part int, n_docs long, n_ids long, content binary"


def write(docs: DataFrame, tokenizer: str, end_id: int | None = 2, partitions: int | None = None) -> DataFrame:
    """The files' table: (shard, part) in ascending order hold documents in ascending order.

    ``tokenizer`` is a file for the tokenizers library that is installed on every node."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        vocabulary, encode = encoder(tokenizer)
        bits, shard, part = bits_for(vocabulary), TaskContext.get().partitionId(), 0
        names, ids, lengths, total = [], [], [], 0
        end = b"" if end_id is None else struct.pack("<I", end_id)

        def file() -> pa.RecordBatch:
            body = build(names, np.frombuffer(b"".join(ids), "<u4"), lengths, bits)
            cols = [[shard], [part], [len(names)], [total], [body]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["shard", "part", "n_docs", "n_ids", "content"])

        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                one = encode(text.as_py()) + end
                names.append(NULL_ID if name is None else name)
                ids.append(one)
                lengths.append(len(one) // 4)
                total += len(one) // 4
                if total >= FILE_IDS:
                    yield file()
                    names, ids, lengths, total, part = [], [], [], 0, part + 1
        if names:
            yield file()

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.repartitionByRange(n, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return d.mapInArrow(run, FILE_SCHEMA)


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the files' bytes."""
    at = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    heads = files.select("shard", "part", "n_ids").withColumn("base", F.coalesce(F.sum("n_ids").over(at), F.lit(0)))  # a row per file
    placed = files.select("shard", "part", "content").join(heads.select("shard", "part", "base"), ["shard", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, base in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                f = TokenFile(content.as_py())
                crc = [zlib.crc32(f.document(k).astype("<u4").tobytes()) for k in range(f.n_docs)]
                names = pa.array([None if x == NULL_ID else x for x in f.doc_ids.tolist()], pa.int64())
                starts = f.starts.astype(np.int64)
                cols = [names, pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("content", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def export(files: DataFrame, folder: str) -> None:
    """Write each file's bytes as ``folder/shard-part.tok`` on a file system that pyarrow knows."""

    def run(rows) -> None:
        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(folder)
        for r in rows:
            name = f"{top}/{r.shard:06d}-{r.part:06d}.tok"
            with where.open_output_stream(f"{name}.tmp") as out:
                out.write(bytes(r.content))
            where.move(f"{name}.tmp", name)

    files.foreachPartition(run)


__all__ = ["TokenFile", "bits_for", "build", "export", "pack", "read", "unpack", "write"]
