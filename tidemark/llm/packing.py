"""Token-id rows by best-fit-decreasing packing.

Texts are tokenised by a public byte-level BPE vocabulary, ended by an end-of-text id, and cut into
pieces of at most `length` ids; no id is lost. The pieces of a block of documents are packed longest
first, each into the open row with the least room that still holds it, found by a segment tree over
room sizes. Every task packs its own documents, so nothing is shuffled and a lost task is run again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import read_table, ship
from tidemark.llm.textops import give_back

LENGTH = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Word pattern of that vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256
#: Pieces are packed together in blocks of about this many ids, which bounds a task's memory.
BLOCK_IDS = 2_000_000
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("pack", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


class RoomTree:
    """Counts of open rows by room; the least room of at least n that has a row is found in O(log length)."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)

    def change(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def successor(self, n: int) -> int | None:
        i = n + self.leaves
        if self.count[i]:
            return n
        while i > 1:
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Places of the pieces in each row. Longest first (ties: first come); into the fullest row that holds it."""
    tree, open_rows, rows = RoomTree(length), {}, []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        room = tree.successor(sizes[i])
        if room is None:
            at, room = len(rows), length
            rows.append([])
        else:
            at = open_rows[room].pop()
            tree.change(room, -1)
        rows[at].append(i)
        left = room - sizes[i]
        if left:
            open_rows.setdefault(left, []).append(at)
            tree.change(left, 1)
    return rows


def _pack(length: int, path: str, batches) -> Iterator[pa.RecordBatch]:
    code = encoder(path)
    kind = np.uint16 if code.n_vocab <= 65535 else np.uint32

    task = TaskContext.get()
    base, n_rows = (task.partitionId() if task else 0) << 32, 0

    def rows(pieces):
        nonlocal n_rows
        out = {x: [] for x in ("pack_id", "ids", "cu_seqlens", "position_resets", "doc_ids", "doc_offsets", "n_ids")}
        for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
            ids = np.full(length, END, kind)
            cut = np.cumsum([0] + [len(pieces[i][2]) for i in row])
            for i, at in zip(row, cut, strict=False):
                ids[at : at + len(pieces[i][2])] = pieces[i][2]
            out["pack_id"].append(base + n_rows)
            n_rows += 1
            out["ids"].append(ids.astype("<u4").tobytes() if kind is np.uint32 else ids.astype("<u2").tobytes())
            out["cu_seqlens"].append(cut.astype(np.int32))
            out["position_resets"].append(cut[:-1].astype(np.int32))
            out["doc_ids"].append([pieces[i][0] for i in row])
            out["doc_offsets"].append([pieces[i][1] for i in row])
            out["n_ids"].append(int(cut[-1]))
        types = [pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32()]
        arrays = [pa.array(v, t) for v, t in zip(out.values(), types, strict=True)]
        for a in range(0, len(arrays[0]), 1000):
            yield pa.RecordBatch.from_arrays([x.slice(a, 1000) for x in arrays], list(out))

    pieces, size = [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = np.array([*code.encode_ordinary(text.as_py() or ""), END], kind)
            pieces += [(key, a, ids[a : a + length]) for a in range(0, len(ids), length)]
            size += len(ids)
            if size >= BLOCK_IDS:
                yield from rows(pieces)
                pieces, size = [], 0
                give_back()
    if pieces:
        yield from rows(pieces)
    give_back()


PACKED = "pack_id long, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, doc_offsets array<long>, n_ids int"


def pack(docs: DataFrame, length: int = LENGTH, path: str = VOCABULARY, key: str = "doc_id") -> DataFrame:
    """Rows of exactly `length` ids.

    pack_id: the input partition and the row's number in it; ids: little-endian uint16 (uint32 for a larger
    vocabulary), filled up with the end id; cu_seqlens: where each piece begins, and the end of the
    last; position_resets: where position ids begin again at 0; doc_ids, doc_offsets: the document of
    each piece and its place in that document's ids; n_ids: ids before the filling.

    Null and empty texts are one end id. Repeated rows are packed each. A null key stays null. An
    empty table gives no rows. Only `key` and `text` are read, so other columns cannot clash.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _pack(length, path, it), PACKED)


def position_ids(cu_seqlens, length: int) -> np.ndarray:
    """0, 1, 2 ... from each reset on; the filling counts as a piece."""
    start = np.zeros(length, np.int64)
    for c in cu_seqlens:
        if c < length:
            start[c:] = c
    return np.arange(length) - start


def unpack(rows, kind: str = "<u2") -> dict:
    """Texts' ids by document, from (ids, cu_seqlens, doc_ids, doc_offsets) rows: the inverse of packing. kind: `<u4` for a larger vocabulary."""
    parts: dict = {}
    for ids, cu, keys, offsets in rows:
        ids = np.frombuffer(ids, kind)
        for k, o, a, b in zip(keys, offsets, cu[:-1], cu[1:], strict=True):
            parts.setdefault(k, []).append((o, ids[a:b]))
    return {k: np.concatenate([x for _, x in sorted(v, key=lambda y: y[0])]) for k, v in parts.items()}


def write_packed(packed: DataFrame, path: str) -> None:
    """Packed id matrices with their segment lengths and resets, as Parquet below `path`."""
    packed.write.parquet(path)


def op3_pack_tokens(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
