"""Length-delimited binary records of token ids, with a separate offset index.

A record is: length (8 bytes), masked checksum of those 8 bytes (4), payload, masked checksum of the
payload (4); all little-endian. The payload is the document's id (8 bytes, signed) and its token ids as
unsigned 16- or 32-bit integers. The checksum is CRC-32, rotated and offset so that checksums of data
that holds checksums stay strong. The index beside a file has four 64-bit integers per record: id,
offset, length of the payload, number of tokens; a reader may take records in any order by it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, shared_dir, ship
from .wordhash import U64, _spans, hash_spans, mix, plain, text_chunks

#: Words, and ids of words, remembered per worker; beyond either the memory starts anew.
CACHE_WORDS, CACHE_IDS = 1_500_000, 20_000_000
#: Marks that end a word of letters.
MARKS = ".,;:!?"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Stands for a null id, which sorts first.
NULL_ID = -(1 << 63)
_MASK_DELTA = 0xA282EAD8


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int = 0) -> tuple[bytes, int]:
    """The payload at an offset and the next record's offset; raises ValueError on damage."""
    head = data[at : at + 8]
    if len(head) < 8 or len(data) < at + 16:
        raise ValueError(f"cut-off record at {at}")
    (n,) = struct.unpack("<Q", head)
    if struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"damaged length at {at}")
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or len(data) < at + 16 + n:
        raise ValueError(f"cut-off record at {at}")
    if struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged payload at {at}")
    return payload, at + 16 + n


class WordEncoder:
    """Encodes texts with a `tokenizers` file whose normalizer lowers case and whose pre-tokenizer drops
    white space, so a text's ids are those of its words in a row.

    Words are never Python objects unless they are new. A word is named by two 64-bit hashes of its bytes
    with A-Z lowered, without one mark of MARKS at its end if a letter of A-Z stands before it (the
    pre-tokenizer parts them there); its ids are kept in a hash table of NumPy arrays. New words go through
    the library: words of Latin letters 1,000 to a text, told apart by the tokens that end a word, all
    others one by one. Words with "<" may be special tokens, so their names keep capitals."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.limit = cache_words
        self.slots = 1 << (4 * cache_words - 1).bit_length() - 1
        self.mark_id = np.full(256, -1, dtype=np.int64)
        # Only a lower-casing tokenizer that parts marks from letters may use the short names.
        self.short = all(self._one("Aé" + m) == self._one("aé") + self._one(m) and len(self._one(m)) == 1 for m in MARKS)
        if self.short:
            self.mark_id[[ord(m) for m in MARKS]] = [self._one(m)[0] for m in MARKS]
        self._clear()

    def _clear(self) -> None:
        self.key, self.check = np.zeros(self.slots, dtype=np.uint64), np.zeros(self.slots, dtype=np.uint64)
        self.at, self.size = np.zeros(self.slots, dtype=np.int64), np.zeros(self.slots, dtype=np.int32)
        self.pool, self.used, self.held = np.zeros(1 << 16, dtype=self.kind), 0, 0

    def _one(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _find(self, h: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Slots of names, -1 for those that aren't there."""
        slot = (h & U64(self.slots - 1)).astype(np.int64)
        k = self.key[slot]
        open_ = np.flatnonzero((k != h) | (self.check[slot] != c))
        while len(open_):
            at = slot[open_]
            empty = self.key[at] == 0
            same = (self.key[at] == h[open_]) & (self.check[at] == c[open_])
            slot[open_[empty]] = -1
            open_ = open_[~empty & ~same]
            slot[open_] = (slot[open_] + 1) & (self.slots - 1)
        return slot

    def _keep(self, h: np.ndarray, c: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """Enters distinct names that aren't there, with their words' ids in a row and the ids' numbers."""
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(flat)] = flat
        begin = self.used + np.cumsum(size) - size
        self.used += len(flat)
        self.held += len(h)
        at, open_ = (h & U64(self.slots - 1)).astype(np.int64), np.arange(len(h))
        while len(open_):
            free = open_[self.key[at[open_]] == 0]
            self.key[at[free]] = h[free]
            won = free[self.key[at[free]] == h[free]]
            self.check[at[won]], self.at[at[won]], self.size[at[won]] = c[won], begin[won], size[won]
            lost = np.ones(len(h), dtype=bool)
            lost[won] = False
            open_ = open_[lost[open_]]
            at[open_] = (at[open_] + 1) & (self.slots - 1)

    def _each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids in a row and their numbers by word."""
        flat, size = [], []
        for at in range(0, len(words), 10_000):
            for x in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in words[at : at + 10_000]], add_special_tokens=False):
                ids = x.ids
                flat += ids
                size.append(len(ids))
        return np.array(flat, dtype=self.kind), np.array(size, dtype=np.int64)

    def _joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of letters, 1,000 to a text."""
        out = []
        parts = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        for part, x in zip(parts, self.tokenizer.encode_batch_fast([b" ".join(p).decode("utf-8") for p in parts], add_special_tokens=False)):
            ids = np.array(x.ids, dtype=self.kind)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            whole = len(ends) == len(part) and ends[-1] == len(ids)
            out.append((ids, np.diff(ends, prepend=0)) if whole else self._each(part))
        return np.concatenate([x for x, _ in out]), np.concatenate([n for _, n in out])

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray, c: np.ndarray) -> None:
        """The words of some ranges of bytes, whose names must differ."""
        before = np.concatenate([[0], data[:-1]]).astype(np.uint8) if len(data) else data
        latin = _LETTER[data] | (data == 0xC3) | ((before == 0xC3) & (data != 0x97) & (data != 0xB7))
        other = np.concatenate([[0], np.cumsum(~latin)])
        whole = other[end] == other[start]
        raw = data.tobytes()
        for pick, encode in ((np.flatnonzero(whole), self._joined), (np.flatnonzero(~whole), self._each)):
            if len(pick):
                self._keep(h[pick], c[pick], *encode([raw[a:b] for a, b in zip(start[pick].tolist(), end[pick].tolist())]))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a string array without nulls, in a row, and their bounds."""
        if len(column) == 0 or column.buffers()[1] is None:
            return np.zeros(0, self.kind), np.zeros(len(column) + 1, dtype=np.int64)
        data, off, start, end = _spans(column)
        first = np.searchsorted(start, off)
        mark = np.where((end - start > 1) & _LETTER[data[end - 2]], self.mark_id[data[end - 1]], -1) if len(end) else np.zeros(0, np.int64)
        end = end - (mark >= 0)
        h, c = (hash_spans(data, start, end, lower=self.short, second=s) for s in (False, True))
        signs = np.flatnonzero(data == ord("<"))
        if len(signs):
            odd = np.unique(np.searchsorted(start, signs, "right") - 1)
            h[odd] = mix(hash_spans(data, start, end)[odd] + U64(1))
        h |= (h == 0).astype(np.uint64)
        slot = self._find(h, c)
        fresh = False
        while len(missing := np.flatnonzero(slot < 0)):
            new = missing[np.unique(h[missing], return_index=True)[1]]
            if not fresh and self.held and (self.held + len(new) > self.limit or self.used > CACHE_IDS):
                self._clear()
                slot[:], fresh = -1, True
                continue
            if self.held + len(new) > self.slots // 2:  # more words in this chunk than the table is made for
                self.slots, fresh = 1 << (4 * len(new)).bit_length(), True
                self._clear()
                slot[:] = -1
                continue
            self._learn(data, start[new], end[new], h[new], c[new])
            slot[missing] = self._find(h[missing], c[missing])
        size = self.size[slot].astype(np.int64)
        marked = mark >= 0
        ends = np.cumsum(size + marked)
        core = np.cumsum(size)
        at = np.arange(core[-1] if len(core) else 0)
        out = np.empty(ends[-1] if len(ends) else 0, dtype=self.kind)
        from_ = at + np.repeat(self.at[slot] - (core - size), size)
        out[at + np.repeat(np.cumsum(marked) - marked, size)] = self.pool[from_]
        out[ends[marked] - 1] = mark[marked]
        return out, np.concatenate([[0], ends])[first]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class _Writer:
    """One file and its index, written under another name and moved when whole, so that a repeated task
    replaces a file by an equal one and no half file is ever seen."""

    def __init__(self, filesystem, folder: str, shard: int):
        self.fs, self.path, self.tag, self.shard = filesystem, f"{folder}/shard-{shard:06d}", uuid.uuid4().hex, shard
        self.file = self.fs.open_output_stream(f"{self.path}.{self.tag}", buffer_size=1 << 20)
        self.at, self.index, self.tokens = 0, [], 0

    def add(self, ident: int, ids: bytes, width: int) -> None:
        record = frame(struct.pack("<q", ident) + ids)
        self.file.write(record)
        n = len(ids) // width
        self.index.append((ident, self.at, len(ids) + 8, n))
        self.at += len(record)
        self.tokens += n

    def close(self) -> tuple:
        self.file.close()
        with self.fs.open_output_stream(f"{self.path}.idx.{self.tag}") as f:
            f.write(np.array(self.index, dtype="<i8").tobytes())
        self.fs.move(f"{self.path}.idx.{self.tag}", f"{self.path}.idx")
        self.fs.move(f"{self.path}.{self.tag}", f"{self.path}.rec")
        return self.shard, len(self.index), self.tokens


def _write(uri: str, tokenizer: str, end_id: int):
    """One file per partition, named by the partition's number: the ranges and the order inside them are
    fixed before the tasks start, so a repeated task writes the same file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], dtype=enc.kind).tobytes()
        filesystem, folder = pafs.FileSystem.from_uri(uri)
        filesystem.create_dir(folder, recursive=True)
        writer = None
        for batch in batches:
            ids, text = batch.column(0).to_pylist(), plain(batch.column(1))
            for a, b in text_chunks(text):
                flat, bounds = enc.encode(text.slice(a, b - a))
                width = flat.itemsize
                raw, at = flat.tobytes(), (bounds * width).tolist()
                for i in range(b - a):
                    if writer is None:
                        writer = _Writer(filesystem, folder, TaskContext.get().partitionId())
                    writer.add(ids[a + i], raw[at[i] : at[i + 1]] + end, width)
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in writer.close()], names=["shard", "docs", "tokens"])

    return run


def _read(uri: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, folder = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for shard, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                path = f"{folder}/shard-{shard:06d}"
                with filesystem.open_input_stream(f"{path}.idx") as f:
                    index = np.frombuffer(f.read(), dtype="<i8").reshape(-1, 4)
                out = []
                with filesystem.open_input_file(f"{path}.rec") as f:
                    for ident, at, length, n in index.tolist():
                        f.seek(at)
                        payload, _ = unframe(f.read(length + 16))
                        ids = np.frombuffer(payload, dtype=f"<u{width}", offset=8)
                        if struct.unpack_from("<q", payload)[0] != ident or len(ids) != n:
                            raise ValueError(f"{path}: index and record at {at} differ")
                        out.append((ident, start, n, zlib.crc32(ids.astype("<u4").tobytes())))
                        start += n
                        if len(out) == 10_000:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["id", "start", "n_tokens", "ids_crc32"])

    return run


def write_records(df: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[str, list[tuple[int, int, int]], int]:
    """Encodes df's texts and writes them in ascending id order (null first; equal ids by their texts'
    hashes) as files that are ranges of ids. Returns the folder's URI, (shard, documents, tokens) per file,
    and the ids' width. A null text has only the end id. An empty table writes no files. The folder must be
    on storage that driver and executors share; by default it is a new one in the shared folder."""
    from tokenizers import Tokenizer

    spark = df.sparkSession
    ship(spark)
    uri = folder or f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    uri = uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1)
    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size() <= 1 << 16 else 4
    docs = df.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID)).alias("id"), F.col(f"`{text_col}`").alias("text"))
    # Spark samples the ranges; the hash parts rows of one id, however many there are.
    order = [F.col("id"), F.xxhash64("text")]
    docs = docs.repartitionByRange(2 * partitions(spark), *order).sortWithinPartitions(*order)
    # One row per file comes back.
    done = docs.mapInArrow(_write(uri, tokenizer, end_id), "shard bigint, docs bigint, tokens bigint").collect()
    return uri, sorted(tuple(r) for r in done), width


def read_records(spark, uri: str, files: list[tuple[int, int, int]], width: int, id_col: str = "doc_id") -> DataFrame:
    """One row per record of the files: id, start (tokens before it in file order), n_tokens, ids_crc32.
    Checksums and the index are verified; damage raises an error."""
    starts, total = [], 0
    for shard, _, tokens in files:
        starts.append((shard, total))
        total += tokens
    table = spark.createDataFrame(starts, "shard bigint, start bigint").repartition(max(1, min(len(starts), partitions(spark))))
    out = table.mapInArrow(_read(uri, width), "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed("id", id_col)
