"""Byte-level BPE encoding and decoding with recursive DuckDB queries, one database per worker.

Texts are split by the tokenizer's pattern. Distinct new pieces become token-position rows; a recursive
query joins each row's pair with the merge table and contracts every word's leftmost pair of minimum rank
until none is left. Decoding joins ids with the vocabulary and aggregates the bytes in order.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .wordhash import plain, text_chunks

#: Pieces remembered per worker; beyond it the memory starts anew.
CACHE_PIECES = 1_000_000
#: Bytes of text taken at once: more give larger queries, of which each round builds tables anew.
CHUNK = 1 << 22
#: Bytes of new pieces in one recursive query, and tokens in one decoding query.
QUERY_BYTES, QUERY_TOKENS = 1_200_000, 1_000_000


def _class(prefix: str) -> str:
    """A regular expression's character set of all code points whose category starts with prefix."""
    spans, start = [], None
    for c in range(sys.maxunicode + 2):
        inside = c <= sys.maxunicode and unicodedata.category(chr(c)).startswith(prefix)
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            spans.append((start, c - 1))
            start = None
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in spans)


#: The one pattern that `quick_splitter` knows.
QUICK_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_QUICK = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def splitter(pattern: str):
    """A function from text to the pattern's matches. `re` lacks \\p, so classes are written out in full,
    which is slow. Its own \\w, \\d and \\s differ from letters, decimal digits and white space in a few
    characters only: numbers that aren't decimal digits, and the controls 28 to 31. A text without those
    takes a pattern of built-in classes; with them, the full one."""
    full = _full(pattern).findall
    if pattern != QUICK_PATTERN:
        return full
    odd = {chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("No", "Nl")} | set("\x1c\x1d\x1e\x1f")
    # Whatever else the built-in classes see otherwise than the categories, by definition none.
    for c in map(chr, range(sys.maxunicode + 1)):
        kind = unicodedata.category(c)[0]
        if (c.isalnum() != (kind in "LN")) or (c.isdecimal() != (unicodedata.category(c) == "Nd")):
            odd.add(c)
    quick = _QUICK.findall

    def split(text: str) -> list[str]:
        if text.isascii():
            return full(text) if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text else quick(text)
        return quick(text) if odd.isdisjoint(text) else full(text)

    return split


def _full(pattern: str) -> re.Pattern:
    """The pattern for `re`: its letter and number classes written out, white space as Unicode has it."""
    space = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{_class('L')}{_class('N')}]")
    out = out.replace(r"\p{L}", f"[{_class('L')}]").replace(r"\p{N}", f"[{_class('N')}]")
    return re.compile(out.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: One row per token: id is word * 2**32 + place of its first byte; nid and ntok are the id and token to its
#: right. A round looks up every pair of the words still open and takes each word's pairs of minimum rank:
#: the leftmost, and where `safe` says that the merged token is in no pair of lower rank, so that the
#: others are next in turn, every second one of each run of overlapping pairs. Their right rows are
#: dropped and neighbours mended; a word without a pair passes once as done.
CONTRACT = """
WITH RECURSIVE t(id, tok, nid, ntok, done) AS (
  SELECT id, tok, nid, ntok, false FROM seed
  UNION ALL
  (WITH r AS MATERIALIZED (
     SELECT t.id, t.tok, t.nid, t.ntok, m.merged, m.safe FROM t LEFT JOIN merges m
     ON m.ab = CAST(t.tok AS UBIGINT) * 4294967296 + CAST(t.ntok AS UBIGINT) WHERE NOT t.done),
   g AS MATERIALIZED (SELECT id >> 32 AS word, min((CAST(merged AS BIGINT) << 32) + (id & 4294967295)) AS best FROM r GROUP BY 1),
   s AS MATERIALIZED (SELECT r.*, g.best FROM r JOIN g ON g.word = r.id >> 32),
   c AS MATERIALIZED (SELECT id, nid, merged FROM s WHERE merged = best >> 32 AND (safe OR id & 4294967295 = best & 4294967295)),
   e AS MATERIALIZED (SELECT c.id, c.nid, c.merged, q.id IS NOT NULL AS follows FROM c LEFT JOIN c q ON q.nid = c.id),
   f AS (SELECT id, nid, merged, CASE WHEN lag(nid) OVER (ORDER BY id) IS DISTINCT FROM id THEN 1 ELSE 0 END AS head FROM e WHERE follows),
   n AS (SELECT id, nid, merged, sum(head) OVER (ORDER BY id) AS run FROM f),
   p AS (SELECT id, nid, merged, row_number() OVER (PARTITION BY run ORDER BY id) AS place FROM n),
   k AS MATERIALIZED (SELECT x.id AS at, x.merged, x.nid AS gone, r.nid, r.ntok
     FROM (SELECT id, nid, merged FROM e WHERE NOT follows UNION ALL SELECT id, nid, merged FROM p WHERE place % 2 = 0) x JOIN r ON r.id = x.nid),
   m AS (SELECT s.id, coalesce(k.merged, s.tok) AS tok, CASE WHEN k.at IS NULL THEN s.nid ELSE k.nid END AS nid, CASE WHEN k.at IS NULL THEN s.ntok ELSE k.ntok END AS ntok, s.best IS NULL AS done
     FROM s LEFT JOIN k ON k.at = s.id ANTI JOIN k z ON z.gone = s.id)
   SELECT m.id, m.tok, m.nid, coalesce(k.merged, m.ntok), m.done FROM m LEFT JOIN k ON k.at = m.nid)
)
SELECT id >> 32 AS word, tok FROM t WHERE done ORDER BY id
"""


class BytePairs:
    """Encoder and decoder of one vocabulary, with its own in-memory database of one thread."""

    def __init__(self, path: str, pattern: str, cache_pieces: int = CACHE_PIECES):
        import duckdb

        self.ranks = read_ranks(path)
        self.split = splitter(pattern)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        a, b, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    a.append(left)
                    b.append(right)
                    merged.append(rank)
        self.con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        pair = (np.array(a, dtype=np.uint64) << np.uint64(32)) | np.array(b, dtype=np.uint64)
        # A merged token that is itself in a pair of lower rank could change whose turn it is.
        lower = {x for p, q, m in zip(a, b, merged) for x in (p, q) if m < x}
        self._table("merges", ab=pair, merged=pa.array(merged, pa.int32()), safe=np.array([m not in lower for m in merged], dtype=bool))
        self._table("vocab", tok=pa.array(list(self.ranks.values()), pa.int32()), part=pa.array(list(self.ranks), pa.binary()))
        self.known: dict[str, bytes] = {}
        self.limit = cache_pieces

    def _table(self, name: str, **columns) -> None:
        self.con.register("arrow_in", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM arrow_in")
        self.con.unregister("arrow_in")

    def contract(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian 32-bit integers."""
        size = np.array([len(p) for p in pieces])
        begin = np.cumsum(size) - size
        ident = np.repeat((np.arange(len(pieces)) << 32) - begin, size) + np.arange(size.sum())
        tok = self.bytes[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        last = np.zeros(len(tok), dtype=bool)
        last[begin + size - 1] = True
        self._table("seed", id=ident, tok=tok, nid=np.where(last, -1, ident + 1), ntok=pa.array(np.append(tok[1:], 0).astype(np.int32), mask=last))
        got = self.con.sql(CONTRACT).to_arrow_table()
        raw = got["tok"].to_numpy().astype("<u4").tobytes()
        ends = (np.searchsorted(got["word"].to_numpy(), np.arange(len(pieces) + 1)) * 4).tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:])]

    def learn(self, pieces: list[str]) -> None:
        block, held = [], 0
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.known[p] = whole.to_bytes(4, "little")
            else:
                block.append((p, raw))
                held += len(raw)
                if held >= QUERY_BYTES:
                    self.known.update(zip([a for a, _ in block], self.contract([b for _, b in block])))
                    block, held = [], 0
        if block:
            self.known.update(zip([a for a, _ in block], self.contract([b for _, b in block])))

    def encode(self, texts: list[str]) -> list[bytes]:
        pieces = [self.split(t) for t in texts]
        distinct = set().union(*pieces) if pieces else set()
        new = distinct.difference(self.known)
        if len(new) + len(self.known) > self.limit:
            self.known, new = {}, distinct
        self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, p)) for p in pieces]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each sequence of ids, aggregated in order."""
        out: list[bytes] = [b""] * len(ids)
        block, held = [], 0
        for d, x in enumerate(ids):
            block.append(d)
            held += len(x) // 4
            if held >= QUERY_TOKENS or d == len(ids) - 1:
                self._decode(ids, block, out)
                block, held = [], 0
        return out

    def _decode(self, ids: list[bytes], block: list[int], out: list[bytes]) -> None:
        size = np.array([len(ids[d]) // 4 for d in block])
        tok = np.frombuffer(b"".join(ids[d] for d in block), dtype="<u4").astype(np.int32)
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
        self._table("asked", doc=np.repeat(np.array(block, dtype=np.int32), size), pos=pos.astype(np.int32), tok=tok)
        got = self.con.sql("SELECT doc, list(part ORDER BY pos) AS parts FROM asked JOIN vocab USING (tok) GROUP BY doc").to_arrow_table()
        parts = got["parts"].combine_chunks()
        flat, at = parts.values, parts.offsets.to_numpy()
        ends = _binary_offsets(flat)
        data = memoryview(flat.buffers()[2]) if flat.buffers()[2] is not None else b""
        for k, d in enumerate(got["doc"].to_pylist()):
            out[d] = bytes(data[ends[at[k]] : ends[at[k + 1]]])


def _binary_offsets(a: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_binary(a.type) else np.int32
    return np.frombuffer(a.buffers()[1], dtype=kind)[a.offset : a.offset + len(a) + 1]


_CODERS: dict[tuple[str, str], BytePairs] = {}


def coder(path: str, pattern: str) -> BytePairs:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = BytePairs(path, pattern)
    return _CODERS[path, pattern]


def _run(path: str, pattern: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bp = coder(path, pattern)
        for batch in batches:
            text = plain(batch.column(1))
            for a, b in text_chunks(text, CHUNK):
                ids = bp.encode(text.slice(a, b - a).to_pylist())
                columns = [batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if digests:
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in ids]))
                    columns.append(pa.array([hashlib.sha256(x).hexdigest() for x in bp.decode(ids)]))
                else:
                    columns.append(pa.array(ids, pa.binary()))
                    columns.append(pa.array(bp.decode(ids), pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "c", "d"])

    return run


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per row of df: id, n_tokens, ids and decoded (binary: 32-bit little-endian ids, bytes), or
    with digests ids_sha256 and decoded_sha256 instead.

    Pattern matches are encoded separately, a match in the vocabulary as one token, without special
    tokens. A null text counts as empty and has no ids. Decoding gives back the text's UTF-8 bytes. Null
    ids and repeated rows are kept; an empty table gives no rows; other columns are left out. Nothing is
    shuffled: a worker keeps the pieces it has met in a bounded memory.
    """
    ship(df.sparkSession)
    kind = dict(df.dtypes)[id_col]
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    typed = "string" if digests else "binary"
    out = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(
        _run(path, pattern, digests), f"id {kind}, n bigint, c {typed}, d {typed}"
    )
    return out.toDF(id_col, "n_tokens", *names)
