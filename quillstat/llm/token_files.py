"""Token ids in binary files: one zstandard frame a document under a shared dictionary, and an index of offsets."""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, textscan

MAGIC = b"QSTOKEN1"
#: magic, SHA-256 of the dictionary (of no bytes if there is none), bytes an id takes.
HEAD = struct.Struct("<8s32sI")
#: documents, offset of the index, checksum of the index, magic.
FOOT = struct.Struct("<QQI8s")
#: One entry a document: its id (0 if it has none), whether it has one, where its frame begins and ends, ids in it.
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("at", "<u8"), ("end", "<u8"), ("n", "<u8")])

#: Bytes of frames after which a task begins another file.
FILE_BYTES = 64 << 20
#: The dictionary's size, and the sample it is trained on: so many documents at most, of so many characters at most,
#: taken in the order of a hash of the text. It serves short documents; every document is compressed with it.
DICT_BYTES = 64 << 10
DICT_DOCS = 2048
DICT_CHARS = 4096
LEVEL = 3
#: Units whose ids a task remembers, texts or units handed to the tokenizer together, bytes of text scanned together.
MEMORY = 1 << 20
AT_ONCE = 4096
SCAN_BYTES = 1 << 20

_UNIT_GAP = np.zeros(256, bool)
_UNIT_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True


class Units:
    """Byte bounds of the units that a pre-tokenizer which splits at white space and between letters and marks never joins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, marks: bool):
        solid = ~_UNIT_GAP[data]
        new = np.zeros(len(data) + 1, bool)
        new[offsets] = True
        new[1:-1] |= ~solid[:-1]
        if marks and len(data):
            letter, mark = _LETTER[data], _MARK[data]
            new[1:-1] |= (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
        begins = solid & new[:-1]
        ends = np.empty_like(solid)
        ends[-1:] = solid[-1:]
        ends[:-1] = solid[:-1] & (new[1:-1] | ~solid[1:])
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.starts, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    out = []
    for base in (0xBF58476D1CE4E5B9, pow(0xBF58476D1CE4E5B9, -1, 1 << 64)):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=2)
def encoder(path: str, by_unit: bool) -> Encoder:
    """An encoder that the tasks of one worker process share, with the units it remembers."""
    return Encoder(path, by_unit)


class Encoder:
    """Ids of whole texts by a tokenizer of the ``tokenizers`` library, without special tokens added.

    ``by_unit`` fits tokenizers that drop white space, take A-Z for a-z, and always split at white space and between
    ASCII letters and ``. , ; : ! ?`` before they merge. Texts repeat such units, so each distinct one is encoded once
    and remembered by a 64-bit hash (up to ``MEMORY`` of them); ids of a text are those of its units in order. Texts
    in which the opening of a special token stands are split at white space alone, their case kept.
    """

    def __init__(self, path: str, by_unit: bool = False, special: bytes = b"<|"):
        from tokenizers import Tokenizer

        self.tokenizer, self.by_unit, self.special = Tokenizer.from_file(path), by_unit, special
        self.powers = _powers(SCAN_BYTES + 2)
        self.forget()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids in each)."""
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a in range(0, len(texts), AT_ONCE):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts[a : a + AT_ONCE], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat.append(np.fromiter((i for one in ids for i in one), np.uint32, int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)

    def forget(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.bounds, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: np.ndarray, texts: list[str]) -> None:
        flat, sizes = self._ids(texts)
        at = len(self.bounds) - 1 + np.arange(len(keys))
        self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(sizes)))
        self.flat = np.concatenate((self.flat, flat))
        self.keys, self.at = np.concatenate((self.keys, keys)), np.concatenate((self.at, at))
        order = np.argsort(self.keys)
        self.keys, self.at = self.keys[order], self.at[order]

    def _hashes(self, data: np.ndarray, units: Units) -> np.ndarray:
        """A 64-bit hash of each unit: a polynomial in its bytes, mixed."""
        up, down = self.powers if len(data) < len(self.powers[0]) else _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(textscan._BYTE[data] * up[: len(data)], out=total[1:])
        return textscan.mix((total[units.ends] - total[units.starts]) * down[units.starts])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of the slice in a row, offsets between texts)."""
        if not self.by_unit:
            whole, at = data.tobytes(), offsets.tolist()
            ids, sizes = self._ids([whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)])
            return ids, np.concatenate(([0], np.cumsum(sizes)))
        plain = self.special not in data.tobytes()
        if plain:
            data = textscan._LOWER[data]
        units = Units(data, offsets, plain)
        if not len(units.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        distinct, where, back = np.unique(self._hashes(data, units), return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > MEMORY:
            self.forget()
        place = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[place] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            whole = data.tobytes()
            texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(units.starts[where[new]].tolist(), units.ends[where[new]].tolist(), strict=True)]
            self._learn(distinct[new], texts)
        entry = self.at[np.searchsorted(self.keys, distinct)][back]
        begin, size = self.bounds[entry], self.bounds[entry + 1] - self.bounds[entry]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(begin - total[:-1], size) + np.arange(total[-1])]
        return ids, total[units.first]


def _encoded(column, encoder: Encoder, end_id: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its ids with the end id) of each text of an Arrow column."""
    for i, j, data, offsets in textscan.slices(column, SCAN_BYTES):
        ids, bounds = encoder.encode(data, offsets)
        for k in range(j - i):
            one = ids[bounds[k] : bounds[k + 1]]
            yield i + k, one if end_id is None else np.append(one, np.uint32(end_id))


def train_dictionary(docs: DataFrame, tokenizer: str, width: int = 4, text_col: str = "text", end_id: int | None = None, by_unit: bool = False) -> bytes:
    """A shared dictionary from the serialized id arrays of a bounded sample: DICT_DOCS texts of DICT_CHARS characters at most.

    Texts go in by the order of their MD5, each distinct one once, so the dictionary doesn't depend on partitions; of large
    tables only a share by another hash is ordered, 16 * DICT_DOCS rows or so. Where there are too few for training, the
    dictionary is empty and frames stand alone.
    """
    share = min(1.0, 16 * DICT_DOCS / max(1, docs.count()))
    some = F.pmod(F.xxhash64(text_col), F.lit(1 << 30)) < int(share * (1 << 30))
    short = docs.filter(F.length(text_col).between(1, DICT_CHARS) & some).select(F.md5(text_col).alias("h"), F.col(text_col).alias("text"))
    sample = short.distinct().orderBy("h", "text").limit(DICT_DOCS)

    def serialize(batches):
        own = encoder(tokenizer, by_unit)
        for b in batches:
            out = [ids.astype(f"<u{width}").tobytes() for _, ids in _encoded(b.column(0), own, end_id)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    samples = sorted({bytes(r[0]) for r in sample.select("text").mapInArrow(serialize, "ids binary").collect()})
    if len(samples) < 64:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes, level: int = LEVEL):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)


def _decompressor(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


class Writer:
    """Writes one file of frames; its name is new each time, so a task that runs again harms nothing."""

    def __init__(self, folder: str, part: int, dictionary_hash: bytes, width: int):
        self.path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.ids"
        system, inner = fs.FileSystem.from_uri(self.path)
        self.out, self.at, self.entries = system.open_output_stream(inner), HEAD.size, []
        self.out.write(HEAD.pack(MAGIC, dictionary_hash, width))

    def add(self, doc_id: int | None, n: int, frame: bytes) -> None:
        self.out.write(frame)
        self.entries.append((doc_id or 0, doc_id is not None, self.at, self.at + len(frame), n))
        self.at += len(frame)

    def close(self) -> dict:
        index = np.array(self.entries, ENTRY)
        raw = index.tobytes()
        self.out.write(raw)
        self.out.write(FOOT.pack(len(index), self.at, zlib.crc32(raw), MAGIC))
        self.out.close()
        known = index["doc_id"][index["has_id"] == 1]
        return {
            "path": self.path, "docs": len(index), "ids": int(index["n"].sum()), "bytes": self.at + len(raw) + FOOT.size,
            "first_id": int(known[0]) if len(known) else None, "last_id": int(known[-1]) if len(known) else None,
        }


class Reader:
    """Reads a file back: the whole of it in pieces, or single documents by their place in the index."""

    def __init__(self, path: str, dictionary: bytes):
        system, inner = fs.FileSystem.from_uri(path)
        self.file = system.open_input_file(inner)
        magic, digest, self.width = HEAD.unpack(self.file.read_at(HEAD.size, 0))
        n, at, check, end = FOOT.unpack(self.file.read_at(FOOT.size, self.file.size() - FOOT.size))
        raw = self.file.read_at(n * ENTRY.itemsize, at)
        if magic != MAGIC or end != MAGIC or zlib.crc32(raw) != check:
            raise ValueError(f"{path} is no whole file of token ids")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.index, self.open = np.frombuffer(raw, ENTRY), _decompressor(dictionary)

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.open.decompress(frame), f"<u{self.width}")

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document: one read of its frame."""
        e = self.index[k]
        return self.ids(self.file.read_at(int(e["end"] - e["at"]), int(e["at"])))

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents with this id."""
        lost = int((self.index["has_id"] == 0).sum())
        known = self.index["doc_id"][lost:]
        return list(range(lost + int(np.searchsorted(known, doc_id)), lost + int(np.searchsorted(known, doc_id, "right"))))

    def all(self, piece: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of all documents in order, read about ``piece`` bytes at a time."""
        k, n = 0, len(self.index)
        while k < n:
            j = max(k + 1, int(np.searchsorted(self.index["end"], self.index["at"][k] + np.uint64(piece), "right")))
            base, end = int(self.index["at"][k]), int(self.index["end"][j - 1])
            data = self.file.read_at(end - base, base)
            for e in range(k, j):
                yield e, self.ids(data[int(self.index["at"][e]) - base : int(self.index["end"][e]) - base])
            k = j

    def close(self) -> None:
        self.file.close()


class TokenFiles:
    """Files written by write_token_files(): ``folder``, the dictionary, and ``manifest`` (one row a file, in order)."""

    def __init__(self, folder: str, dictionary: bytes, manifest: DataFrame):
        self.folder, self.dictionary, self.manifest = folder, dictionary, manifest

    def read(self) -> DataFrame:
        """(doc_id, file_no, place, start in the file, n_tokens, ids_crc32) of every document, read from the files."""
        dictionary = self.manifest.sparkSession.sparkContext.broadcast(self.dictionary)  # DICT_BYTES at most

        def scan(batches):
            for b in batches:
                for no, path in zip(b.column("file_no").to_pylist(), b.column("path").to_pylist(), strict=True):
                    reader = Reader(path, dictionary.value)
                    x, sums = reader.index, np.zeros(len(reader.index), np.uint32)
                    sizes = np.zeros(len(x), np.int64)
                    for k, ids in reader.all():
                        sizes[k], sums[k] = len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())
                    reader.close()
                    start = np.cumsum(sizes) - sizes
                    for a in range(0, len(x), 1 << 16):
                        z = min(len(x), a + (1 << 16))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(x["doc_id"][a:z], mask=x["has_id"][a:z] == 0), pa.array(np.full(z - a, no, np.int64)), pa.array(np.arange(a, z)),
                                pa.array(start[a:z]), pa.array(sizes[a:z]), pa.array(sums[a:z].astype(np.int64)),
                            ],
                            ["doc_id", "file_no", "place", "local", "n_tokens", "ids_crc32"],
                        )

        files = self.manifest.select("file_no", "path").repartition(max(1, common.shuffle_width(self.manifest.sparkSession)), "file_no")
        rows = files.mapInArrow(scan, "doc_id long, file_no long, place long, local long, n_tokens long, ids_crc32 long")
        return rows.join(F.broadcast(self.manifest.select("file_no", "before")), "file_no") if self._few() else rows.join(self.manifest.select("file_no", "before"), "file_no")

    def _few(self) -> bool:
        return common.few(self.manifest)

    def fetch(self, doc_ids: list[int]) -> DataFrame:
        """(doc_id, ids) of the documents with these ids: only files that may hold one are opened, only their frames are read."""
        dictionary, wanted = self.dictionary, sorted(set(doc_ids))
        near = F.exists(F.array(*[F.lit(i).cast("bigint") for i in wanted]), lambda i: i.between(F.col("first_id"), F.col("last_id"))) if wanted else F.lit(False)

        def pick(batches):
            for b in batches:
                for path in b.column(0).to_pylist():
                    reader = Reader(path, dictionary)
                    found = [(i, reader.document(k).astype(np.int64)) for i in wanted for k in reader.find(i)]
                    reader.close()
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

        return self.manifest.filter(near).select("path").mapInArrow(pick, "doc_id long, ids array<long>")


def write_token_files(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None,
    file_bytes: int = FILE_BYTES, vocabulary: int = 1 << 32, by_unit: bool = False,
) -> TokenFiles:
    """Encodes every whole text and writes its ids, in ascending order of ids of documents, as files in the shared folder.

    A file is a head (with the SHA-256 of the dictionary), one zstandard frame a document, the index (id, frame
    bounds, number of ids) and a foot. The dictionary lies beside the files as ``dictionary-<sha256>``. Ids are
    stored in 2 bytes if ``vocabulary`` is at most 65,536, else in 4. ``by_unit``: see Encoder.

    Tasks encode and compress where documents are read; frames are written once, then dealt by ranges of
    document ids, and each task writes the files of its range. Ranges also cut through rows with one id. Names of
    files are new for each attempt, and the manifest, which Spark commits, lists those of the attempts that counted.
    The folder must be one that Arrow's file systems can write (a mounted path, ``file://``, ``hdfs://``, ``s3://``).

    A null text counts as empty (its frame holds the end id alone, if there is one), rows without an id come first,
    rows that repeat an id follow each other by number of ids, then a hash of the frame. A text of any length is one frame. Other columns are ignored,
    whatever their names; an empty table gives no files.
    """
    common.need_integers(docs, id_col)
    spark, width = docs.sparkSession, 2 if vocabulary <= 1 << 16 else 4
    dictionary = train_dictionary(docs, tokenizer, width, text_col, end_id, by_unit)
    digest = hashlib.sha256(dictionary).digest()
    folder = f"{common.shared_dir(spark)}/quillstat/ids-{uuid.uuid4().hex}"
    system, inner = fs.FileSystem.from_uri(folder)
    system.create_dir(inner, recursive=True)
    with system.open_output_stream(f"{inner}/dictionary-{digest.hex()}") as out:
        out.write(dictionary)
    shared = spark.sparkContext.broadcast(dictionary)  # DICT_BYTES at most

    def compress(batches):
        own, packer = encoder(tokenizer, by_unit), _compressor(shared.value)
        for b in batches:
            sizes, frames, held, begin = [], [], 0, 0
            for k, ids in _encoded(b.column("text"), own, end_id):
                if width == 2 and len(ids) and ids.max() >= 1 << 16:
                    raise ValueError(f"id {ids.max()} is beyond the stated vocabulary")
                sizes.append(len(ids))
                frames.append(packer.compress(ids.astype(f"<u{width}").tobytes()))
                held += len(frames[-1])
                if held > 2 << 20 or k + 1 == b.num_rows:
                    part = b.column("doc_id").slice(begin, k + 1 - begin)
                    yield pa.RecordBatch.from_arrays([part, pa.array(sizes, pa.int64()), pa.array(frames, pa.binary())], ["doc_id", "n", "frame"])
                    sizes, frames, held, begin = [], [], 0, k + 1

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    frames, frames_path = common.materialize(rows.mapInArrow(compress, "doc_id long, n long, frame binary"), "frames")

    def write(batches):
        from pyspark import TaskContext

        part, writer, made = TaskContext.get().partitionId(), None, []
        for b in batches:
            for i, n, frame in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("frame").to_pylist(), strict=True):
                if writer and writer.at >= file_bytes:
                    made.append(writer.close())
                    writer = None
                writer = writer or Writer(folder, part, digest, width)
                writer.add(i, n, frame)
        if writer:
            made.append(writer.close())
        for k, m in enumerate(made):
            yield pa.RecordBatch.from_pylist(
                [m | {"part": part, "k": k}],
                pa.schema([("part", pa.int64()), ("k", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]),
            )

    # Keys of ranges are sampled to the driver, so frames take part by a hash.
    order = ["doc_id", "n", F.xxhash64("frame"), "frame"]
    dealt = frames.withColumn("read", F.monotonically_increasing_id()).repartitionByRange(max(2 * common.shuffle_width(spark), 8), "doc_id", "n", F.xxhash64("frame"), "read")
    dealt = dealt.drop("read").sortWithinPartitions(*order)
    made = dealt.mapInArrow(write, "part long, k long, path string, docs long, ids long, bytes long, first_id long, last_id long")
    made, _ = common.materialize(made, "manifest")
    common.discard(spark, frames_path)
    alone = common.few(made)
    made = common.running(made.withColumn("one", F.lit(1)), ["part", "k"], {"before": "ids", "file_no": "one"}, alone, "files")
    manifest, _ = common.materialize(made.select(F.col("file_no").cast("bigint"), "path", "docs", "ids", "bytes", F.col("before").cast("bigint"), "first_id", "last_id"), "manifest")
    return TokenFiles(folder, dictionary, manifest)


def op12_token_files(spark, sf_dir: str) -> DataFrame:
    """All documents as token files of a public vocabulary, read back: where each one's ids stand, and their checksum."""
    import public_tokenizers

    files = write_token_files(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408, by_unit=True)
    return files.read().select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
