"""Packing token sequences into windows of equal capacity by multiway Karmarkar-Karp differencing.

A document's whole windows stand alone; what is left of it is cut into pieces of at most PIECE tokens. The pieces of a
block are spread over k = ceil(tokens / capacity) windows: each begins as a partial partition that has it in one of k
slots; the two partial partitions of the largest imbalance are merged again and again, the fullest slots of one with
the emptiest of the other, until one partition is left, whose slots are nearly equal. If its fullest slot exceeds the
capacity, k rises by one and the block is spread anew. Slots that are empty on both sides cost nothing.

Blocks are cut from the rows of one partition in their order, so nothing is shuffled and memory is bounded by a block
and one document. Padding is a fraction of one window in each block.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.shared import only, sparing

CAPACITY = 2048
PIECE = 512
WINDOWS = 384  # of a block


def spread(sizes: np.ndarray, k: int) -> np.ndarray:
    """The slot (0 to k - 1) of each size in a k-way partition with nearly equal sums, by largest differencing."""
    n = len(sizes)
    if n == 0 or k == 1:
        return np.zeros(n, np.int64)
    # a partial partition: the sums of its filled slots, falling; the nodes below hold which slots were put together
    sums: list = [np.array([s], np.int64) for s in sizes]
    merges: list = [None] * n
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        x, y = sums[a], sums[b]
        over = max(0, len(x) + len(y) - k)  # so many slots are filled on both sides
        total = np.concatenate([x, y[: len(y) - over]])
        if over:
            total[len(x) - over :][:over] = x[len(x) - over :] + y[len(y) - over :][::-1]
        order = np.argsort(-total, kind="stable")
        merges.append((a, b, over, order))
        total = total[order]
        sums.append(total)
        sums[a] = sums[b] = None
        low = int(total[-1]) if len(total) == k else 0
        heapq.heappush(heap, (low - int(total[0]), len(merges) - 1))
    slot = np.empty(n, np.int64)
    todo = [(len(merges) - 1, np.arange(len(sums[-1])))]
    while todo:
        node, where = todo.pop()
        if merges[node] is None:
            slot[node] = where[0]
            continue
        a, b, over, order = merges[node]
        before = np.empty(len(order), np.int64)
        before[order] = where
        nx = _filled(merges, a)
        todo.append((a, before[:nx]))
        rest = before[nx:]
        todo.append((b, np.concatenate([rest, before[nx - over : nx][::-1]]) if over else rest))
    return slot


def _filled(merges: list, node: int) -> int:
    return 1 if merges[node] is None else len(merges[node][3])


def windows(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Slots of sizes in as few windows as differencing finds room in, and their number."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        slot = spread(sizes, k)
        if np.bincount(slot, sizes, k).max(initial=0) <= capacity:
            return slot, k
        k += 1


class _Block:
    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.pieces: list[tuple] = []
        self.tokens = 0

    def whole(self, piece: tuple) -> tuple:
        self.next_id += 1
        return (*piece, self.next_id - 1, 0)

    def flush(self) -> list[tuple]:
        if not self.pieces:
            return []
        sizes = np.array([p[2] for p in self.pieces], np.int64)
        slot, k = windows(sizes, self.capacity)
        order = np.argsort(slot, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[0], np.cumsum(np.bincount(slot, sizes, k).astype(np.int64))])
        out = []
        for i, end in zip(order.tolist(), ends.tolist(), strict=True):
            out.append((*self.pieces[i], self.next_id + int(slot[i]), end - int(sizes[i]) - int(first[slot[i]])))
        self.next_id += k
        self.pieces, self.tokens = [], 0
        return out


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = ", ".join(f"{c} long" for c in COLUMNS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(COLUMNS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], COLUMNS)


PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed: byte-level BPE's word pieces


def _encoder(vocabulary: str):
    """A function from a text to its ids, for the contents of a tokenizers file.

    Where that file is plain byte-level BPE whose ids rise with its merges, tiktoken gives the same ids from the same
    vocabulary several times as fast; any other file goes to tokenizers itself, and so does a text that holds one of
    the file's added tokens.
    """
    held: list = []  # the file's own tokenizer, once it is needed

    def exact(text: str) -> np.ndarray:
        if not held:
            from tokenizers import Tokenizer

            held.append(Tokenizer.from_str(vocabulary))
        return np.array(held[0].encode(text, add_special_tokens=False).ids, np.uint32)

    spec = json.loads(vocabulary)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model.get("merges", [])]
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ids = [model["vocab"].get(m, -1) for m in merged]
    plain = model.get("type") == "BPE" and split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    plain = plain and spec.get("normalizer") is None and not model.get("ignore_merges") and ids == sorted(ids) and min(ids, default=0) == 256
    plain = plain and len(merged) + 256 == len(set(model["vocab"]) - special)
    if plain:
        import tiktoken

        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        fast = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        added = sorted(special)
        return lambda text: exact(text) if any(t in text for t in added) else np.array(fast.encode_ordinary(text), np.uint32)
    return exact


def _pack(vocabulary, capacity: int, end_id: int):
    def pack(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = _encoder(vocabulary.value)
        block = _Block(capacity, TaskContext.get().partitionId() << 40)
        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for begin in range(0, len(names), 64):
                rows = []
                for name, text in zip(names[begin : begin + 64], texts[begin : begin + 64].to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    n, at = len(ids), 0
                    while at < n:
                        size = capacity if n - at >= capacity else min(min(PIECE, capacity), n - at)
                        piece = (name, at, size, zlib.crc32(ids[at : at + size].tobytes()), n)
                        if size == capacity:
                            rows.append(block.whole(piece))
                        else:
                            block.pieces.append(piece)
                            block.tokens += size
                        at += size
                    if block.tokens >= WINDOWS * capacity:
                        rows += block.flush()
                yield _batch(rows)
        yield _batch(block.flush())

    return pack


def packed(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """The pieces of every document (doc_id, text) in sequences of at most capacity tokens.

    A null text counts as empty, and an empty one is its end id alone. Repeated rows are packed once each. Sequence
    ids are unique and ascend within an input partition, with gaps between partitions. An empty table gives no rows;
    other columns are ignored. tokenizer_path is read on the driver.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return docs.mapInArrow(sparing(_pack(vocabulary, capacity, end_id)), SCHEMA)
