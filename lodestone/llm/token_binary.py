"""Token ids of a corpus in a binary format of bit or byte planes.

Documents are dealt to shards by ranges of their id and sorted inside each, so that the shards in order hold the
corpus in ascending id order. A shard file is

    b"LSTI" version block_ids planes        header (4 x 4 bytes)
    plane plane plane ...                   each block of ids transposed into planes, each plane one zstandard frame
    index                                   one zstandard frame of JSON: for each block the id count and the plane lengths;
                                            for each document its id and its number of ids (delta coded)
    len(index) b"LSTX"                      trailer (8 + 4 bytes)

A task writes a file name of its own and reports it; only reported files count, so a task that is run again after
an executor was lost leaves at worst a file that nothing points to.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .scratch import materialize

BLOCK_IDS = 1 << 16
#: Bytes of text that a shard takes at most (a longer single text makes a larger one); text worth a shard of its own.
SHARD_BYTES, LEAST_SHARD_BYTES = 1 << 27, 1 << 20
MAGIC, END = b"LSTI", b"LSTX"
#: The published split of byte-level BPE, letters and digits together: the places where it cuts are places where the
#: tokenizer cuts too, so pieces can be encoded one by one.
_PIECE = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W_]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s")
#: Characters whose classes Python and the tokenizer might see differently; texts with any go to the tokenizer whole.
_ODD = r"[^\x00-\x1b\x20-\x{24f}]"
#: A space before white space or the end; without one the tokenizer cuts before every space.
_LOOSE = r" (?:[\t-\r \x{85}\x{a0}]|\z)"
#: Entries that a worker keeps of each kind, and their longest length; others are encoded each time.
_CACHE_ENTRIES, _CACHE_LENGTH = 500_000, 40


class _Pieces(dict):
    """Ids of the pieces of the split, as little-endian 32-bit bytes; frequent pieces come early and are kept."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        raw = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = dict.fromkeys(raw)
        # The published byte alphabet: printable bytes stand for themselves, the others for the code points from 256 on.
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}

    def __missing__(self, piece: str) -> bytes:
        if piece.lstrip(" ").isalpha():  # one piece for the tokenizer too: its model is asked directly
            word = piece.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.tokenizer.model.tokenize(word)]
        else:
            ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < _CACHE_ENTRIES // 5 and len(piece) <= _CACHE_LENGTH:
            self[piece] = packed
        return packed


class _Words(dict):
    """Ids of a space and the characters up to the next space; words are kept as they come."""

    def __init__(self, pieces: _Pieces):
        self.pieces, self.tokenize, self.alphabet = pieces, pieces.tokenizer.model.tokenize, pieces.alphabet
        self.ends = {e: pieces[e] for e in ",.;:?!"}

    def __missing__(self, word: str) -> bytes:
        if word.isalpha():
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            ids = [t.id for t in self.tokenize(self.alphabet[32] + shown)]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        elif (end := self.ends.get(word[-1:])) is not None and (stem := word[:-1]).isalpha():
            packed = self[stem] + end
        else:
            packed = b"".join(map(self.pieces.__getitem__, _PIECE.findall(" " + word)))
        if len(self) < _CACHE_ENTRIES and len(word) <= _CACHE_LENGTH:
            self[word] = packed
        return packed


class Encoder:
    """Ids of whole texts, as little-endian 32-bit bytes: those of ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings of the vocabulary's added tokens, which the tokenizer takes out of a text before it splits the rest.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = _Pieces(self.tokenizer)
        self.words = _Words(self.pieces)

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Texts are cut at spaces; each distinct word of the batch is looked up once and its ids are dealt by index."""
        whole = pc.match_substring_regex(texts, _ODD)
        for x in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        loose = pc.and_not(pc.match_substring_regex(texts, _LOOSE), whole)
        out: list[bytes] = [b""] * len(texts)
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, "<u4").tobytes()
        for k in np.flatnonzero(loose.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self._by_pieces(texts[k].as_py())
        plain = np.flatnonzero(pc.invert(pc.or_(whole, loose)).to_numpy(zero_copy_only=False))
        if not len(plain):
            return out
        cut = pc.split_pattern(texts.take(pa.array(plain)), " ")
        first = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        parts = cut.flatten()
        heads = np.zeros(len(parts), bool)
        heads[first[:-1]] = True  # no space stands before a text's first word
        found = parts.filter(pa.array(~heads)).dictionary_encode()
        table = [*map(self.words.__getitem__, found.dictionary.to_numpy(zero_copy_only=False).tolist()), *map(self._by_pieces, parts.filter(pa.array(heads)).to_pylist())]
        code = np.empty(len(parts), np.int64)
        code[~heads] = found.indices.to_numpy(zero_copy_only=False)
        code[heads] = len(found.dictionary) + np.arange(len(plain))
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        at, _ = K.spans_to_index((np.cumsum(size) - size)[code], size[code])
        ids = np.frombuffer(b"".join(table), "<u4")[at]
        edge = np.r_[0, np.cumsum(size[code])][first]
        for k, lo, hi in zip(plain.tolist(), edge[:-1].tolist(), edge[1:].tolist()):
            out[k] = ids[lo:hi].tobytes()
        return out

    def _by_pieces(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(text)))


_encoders: dict[str, Encoder] = {}


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else "file://" + uri)


def pack_block(ids: np.ndarray, planes: str) -> list[bytes]:
    rows = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if planes == "bit":
        rows = np.concatenate([np.packbits(np.unpackbits(r[:, None], axis=1, bitorder="little").T, axis=1) for r in rows])
    squeeze = zstandard.ZstdCompressor(level=1)
    return [squeeze.compress(r.tobytes()) for r in rows]


def unpack_block(frames: list[bytes], count: int, planes: str) -> np.ndarray:
    loosen = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(loosen.decompress(f), np.uint8) for f in frames]
    if planes == "bit":
        bits = np.stack([np.unpackbits(r, count=count) for r in rows]).reshape(4, 8, count)
        rows = [np.packbits(b.T, axis=1, bitorder="little")[:, 0] for b in bits]
    return np.ascontiguousarray(np.stack(rows).T).view("<u4")[:, 0] if count else np.zeros(0, "<u4")


class ShardWriter:
    def __init__(self, out, planes: str, block_ids: int):
        self.out, self.planes, self.block_ids = out, planes, block_ids
        self.held = bytearray()
        self.index: dict = {"planes": planes, "block_ids": block_ids, "blocks": [], "ids": [], "counts": []}
        self.n_ids = 0
        out.write(MAGIC + struct.pack("<III", 1, block_ids, planes == "bit"))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.index["ids"].append(doc_id)
        self.index["counts"].append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held += ids
        size = 4 * self.block_ids
        if len(self.held) >= size:
            whole = len(self.held) // size * size
            for lo in range(0, whole, size):
                self._block(bytes(self.held[lo : lo + size]))
            del self.held[:whole]

    def _block(self, raw: bytes) -> None:
        frames = pack_block(np.frombuffer(raw, "<u4"), self.planes)
        self.index["blocks"].append([len(raw) // 4, *map(len, frames)])
        self.out.write(b"".join(frames))

    def close(self) -> None:
        if self.held:
            self._block(bytes(self.held))
        packed = zstandard.ZstdCompressor(level=3).compress(json.dumps(self.index, separators=(",", ":")).encode())
        self.out.write(packed + struct.pack("<Q", len(packed)) + END)
        self.out.close()


def read_shard(file) -> Iterator[tuple[int | None, bytes]]:
    """(document id, its ids as bytes) in the order written, from a file that can seek; one block is read and unpacked at a time."""
    size = file.seek(0, 2)
    file.seek(max(0, size - 12))
    end = file.read(12)
    file.seek(0)
    if size < 28 or file.read(4) != MAGIC or end[-4:] != END:
        raise ValueError("not a token shard, or cut short")
    (length,) = struct.unpack("<Q", end[:8])
    file.seek(size - 12 - length)
    index = json.loads(zstandard.ZstdDecompressor().decompress(file.read(length)))
    file.seek(16)
    blocks, held = iter(index["blocks"]), bytearray()
    for doc_id, count in zip(index["ids"], index["counts"]):
        while len(held) < 4 * count:
            n, *lengths = next(blocks)
            held += unpack_block([file.read(x) for x in lengths], n, index["planes"]).tobytes()
        yield doc_id, bytes(held[: 4 * count])
        del held[: 4 * count]


def _shard_count(texts: Column, rows: DataFrame, shard_bytes: int) -> int:
    """Shards of at most about ``shard_bytes`` of text, and of smaller ones as many as keep the cores busy."""
    total = rows.agg(F.sum(F.octet_length(texts))).first()[0] or 0
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(total / shard_bytes), min(4 * cores, math.ceil(total / LEAST_SHARD_BYTES)))


def write_token_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", planes: str = "byte", block_ids: int = BLOCK_IDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode every text, append ``end_id``, write shards to ``folder``; returns shard, path, n_docs, n_ids.

    Null texts are empty (the end id alone). Strings of the vocabulary's added tokens become these tokens. Rows go in
    ascending order of id, null ids first, rows of equal id by a hash of the text, so that one id's rows are spread
    over shards too; repeated rows are written as often as they come. Other columns are ignored. An empty table gives
    no shard.
    """
    if planes not in ("byte", "bit"):
        raise ValueError("planes: byte or bit")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(_shard_count(F.col("text"), rows, shard_bytes), *order).sortWithinPartitions(*order, "text")
    end = struct.pack("<I", end_id)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, writer, n_docs, path = TaskContext.get().partitionId(), None, 0, ""
        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        for batch in batches:
            for lo in range(0, batch.num_rows, K.BATCH_ROWS):
                if writer is None:
                    system, root = _open_fs(folder)
                    system.create_dir(root, recursive=True)
                    name = f"shard-{number:06d}-{uuid.uuid4().hex}.ids"
                    path = f"{folder}/{name}"
                    writer = ShardWriter(system.open_output_stream(f"{root}/{name}"), planes, block_ids)
                ids = batch.column(0).slice(lo, K.BATCH_ROWS).to_pylist()
                for i, raw in zip(ids, encoder.encode(batch.column(1).slice(lo, K.BATCH_ROWS))):
                    writer.add(i, raw + end)
                n_docs += len(ids)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([path]), pa.array([n_docs], pa.int64()), pa.array([writer.n_ids], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    return materialize(K.map_batches(rows, shard, "shard int, path string, n_docs long, n_ids long"), "shards")


def read_token_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, on request, ids."""
    n = max(1, shards.count())
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, at = _open_fs(path)
                file = system.open_input_file(at)
                ids, starts, counts, sums, values = [], [], [], [], []

                def packed() -> pa.RecordBatch:
                    cols = [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
                    return pa.RecordBatch.from_arrays([*cols, pa.array(values, pa.list_(pa.int64()))] if with_ids else cols, names)

                for doc_id, own in read_shard(file):
                    ids.append(doc_id)
                    starts.append(start)
                    counts.append(len(own) // 4)
                    sums.append(zlib.crc32(own))
                    if with_ids:
                        values.append(np.frombuffer(own, "<u4").astype(np.int64))
                    start += len(own) // 4
                    if len(ids) == 2000:
                        yield packed()
                        ids, starts, counts, sums, values = [], [], [], [], []
                file.close()
                yield packed()

    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    todo = shards.withColumn("start", before).repartition(n, "shard").select("path", "start")
    return K.map_batches(todo, read, schema)
