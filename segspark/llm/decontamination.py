"""Benchmark decontamination by pigeonhole edit matching over words.

An item of m words may differ from a passage by ``floor(error_rate * m)`` word edits
(insertions, deletions, replacements).  Cut into one piece more than that, at least one
piece of a matching item stands unchanged in the passage.  Documents are searched for
the pieces with vectorised window hashes; around each hit the item is verified with
Myers' bit-parallel distance against the stretch that it could cover.

Words are runs of letters, digits and non-ASCII characters, all in lower case.  Items are
written to the shared folder in blocks of about ``block_bytes`` of text.  A task reads
documents once, in stretches of about ``CHUNK_BYTES``, and holds one block after another
against each stretch, so memory is bounded and nothing passes through the driver, however
many items there are.

Defined results: one row per document row and item that matches, with the smallest
distance and the first place that has it; null and empty texts and items match nothing;
an item of fewer than ``1 / error_rate`` words must stand unchanged; rows that repeat a
document or an item give repeated rows; empty tables give an empty result; further columns
don't enter the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm._scratch import scratch_path, text_slices
from segspark.llm._words import NON_ALNUM, Words, window_hashes

ERROR_RATE = 0.2
#: Text of the items in one block; what a task holds of it is a small multiple.
BLOCK_BYTES = 4 << 20
#: Text of the documents that a task holds the blocks against at a time.
CHUNK_BYTES = 4 << 20
#: Words of a piece that are looked up; a longer piece can only stand where these do.
PIECE = 8
_TABLE = 1 << 22


class Myers:
    """Bit-parallel edit distance of one pattern of words to the ends of stretches of a text."""

    def __init__(self, pattern: list[int]):
        self.m, self.masks = len(pattern), {}
        for i, w in enumerate(pattern):
            self.masks[w] = self.masks.get(w, 0) | 1 << i
        self.top, self.full = 1 << (self.m - 1), (1 << self.m) - 1

    def best(self, text: list[int], anchored: bool = False) -> tuple[int, int]:
        """The smallest distance to a stretch of ``text`` and the first place where such a
        stretch ends; ``anchored``: only stretches that begin where the text begins."""
        vp, vn, score = self.full, 0, self.m
        least, end = score, 0
        for j, w in enumerate(text, 1):
            eq = self.masks.get(w, 0)
            x = eq | vn
            d0 = ((((x & vp) + vp) ^ vp) | x) & self.full
            hn, hp = vp & d0, (vn | ~(vp | d0)) & self.full
            score += bool(hp & self.top) - bool(hn & self.top)
            hp = hp << 1 | anchored
            vn = hp & d0 & self.full
            vp = (hn << 1 | ~(hp | d0)) & self.full
            if score < least:
                least, end = score, j
        return least, end


def edit_budget(m: int, error_rate: float = ERROR_RATE) -> int:
    return int(np.floor(error_rate * m + 1e-9))


class ItemBlock:
    """The items of one block, ready for search."""

    def __init__(self, ids: list, texts: pa.Array, error_rate: float = ERROR_RATE):
        self.items, self.patterns, self._myers = [], [], {}
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for first, _, data, offsets in text_slices(pc.utf8_lower(texts)):
            words = Words(data, offsets, NON_ALNUM)
            for i, (begin, m) in enumerate(zip(words.first.tolist(), words.counts.tolist())):
                if not m:
                    continue
                k, at = edit_budget(m, error_rate), len(self.items)
                self.items.append((ids[first + i], m, k))
                self.patterns.append(words.hashes[begin : begin + m])
                cuts = [m * j // (k + 1) for j in range(k + 2)]
                for lo, hi in zip(cuts, cuts[1:]):
                    pieces.setdefault(min(hi - lo, PIECE), []).append((at, lo))
        self.m, self.k = (np.array([x[i] for x in self.items], np.int64) for i in (1, 2))
        base = np.concatenate(([0], np.cumsum(self.m)))
        whole = Words.__new__(Words)
        whole.hashes = np.concatenate([*self.patterns, np.empty(0, np.uint64)])
        whole.text = np.repeat(np.arange(len(self.items)), self.m)
        self.pieces = {}
        for size, found in pieces.items():
            item, offset = np.array(found, np.int64).T
            keys = window_hashes(whole, size)[0][base[item] + offset]
            order = np.argsort(keys, kind="stable")
            keys, item, offset = keys[order], item[order], offset[order]
            table = np.zeros(_TABLE, bool)
            table[keys & np.uint64(_TABLE - 1)] = True
            self.pieces[size] = (keys, item, offset, table)

    def myers(self, item: int) -> tuple[Myers, Myers]:
        """The matchers of an item, forward and backward; made when it is first hit."""
        if item not in self._myers:
            pattern = self.patterns[item].tolist()
            self._myers[item] = Myers(pattern), Myers(pattern[::-1])
        return self._myers[item]

    def search(self, words: Words, windows: dict) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, end word) of all matches in a slice of texts;
        ``windows`` keeps the slice's window hashes for the next block."""
        found = []
        for size, (keys, item, offset, table) in self.pieces.items():
            if size not in windows:
                windows[size] = window_hashes(words, size)
            hashes, whole = windows[size]
            at = np.flatnonzero(table[hashes & np.uint64(_TABLE - 1)] & whole)
            lo = np.searchsorted(keys, hashes[at], "left")
            n = np.searchsorted(keys, hashes[at], "right") - lo
            which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            at = np.repeat(at, n)
            found.append((words.text[at], item[which], at - offset[which]))
        if not found or not sum(len(x[0]) for x in found):
            return
        text, item, start = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((start, item, text))
        text, item, start = text[order], item[order], start[order]
        m, k = self.m, self.k
        lo = np.maximum(start - k[item], words.first[text])
        hi = np.minimum(start + m[item] + k[item], words.first[text + 1])
        i, n = 0, len(text)
        while i < n:
            t, x = int(text[i]), int(item[i])
            best = None
            while i < n and text[i] == t and item[i] == x:  # stretches that touch are verified as one
                a, b = int(lo[i]), int(hi[i])
                i += 1
                while i < n and text[i] == t and item[i] == x and lo[i] <= b:
                    b = max(b, int(hi[i]))
                    i += 1
                distance, end = self.myers(x)[0].best(words.hashes[a:b].tolist())
                if distance <= k[x] and (best is None or distance < best[0]):
                    best = (distance, a, a + end)
            if best:
                distance, a, end = best
                _, back = self.myers(x)[1].best(words.hashes[a:end][::-1].tolist(), anchored=True)
                yield t, x, distance, end - back - int(words.first[t]), end - int(words.first[t])


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[str, int]:
    """Write the rows (item_id, text) of ``items`` in blocks of about ``block_bytes`` of text;
    the folder and the number of blocks."""
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks, path = -(-total // block_bytes), scratch_path(items.sparkSession, "items")
    if blocks:
        block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block")
        items.filter("text <> ''").select("item_id", "text", block).repartition(min(blocks, 1024), "block").write.partitionBy("block").parquet(path)
    return path, blocks


@lru_cache(maxsize=1)
def _load(path: str, block: int, error_rate: float) -> ItemBlock | None:
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(f"{path}/block={block}")
    if store.get_file_info(root).type == fs.FileType.NotFound:
        return None
    table = pq.read_table(root, filesystem=store, columns=["item_id", "text"], partitioning=None)
    return ItemBlock(table["item_id"].to_pylist(), table["text"], error_rate)


def _chunks(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[list[tuple[int, pa.RecordBatch, int, Words]]]:
    """Batches with the words of their texts (column ``at``): number, batch, first row, words;
    about CHUNK_BYTES at a time."""
    held, size = [], 0
    for number, batch in enumerate(batches):
        for lo, _, data, offsets in text_slices(pc.utf8_lower(batch.column(at))):
            held.append((number, batch, lo, Words(data, offsets, NON_ALNUM)))
            size += len(data)
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _hits(chunk: list, path: str, blocks: int, error_rate: float) -> Iterator[tuple[int, ItemBlock, list]]:
    """Slices of a chunk and the matches of a block in them, block by block."""
    windows = [{} for _ in chunk]
    for number in range(blocks):
        block = _load(path, number, error_rate)
        for i, (*_, words) in enumerate(chunk) if block else ():
            hits = list(block.search(words, windows[i]))
            if blocks == 1:
                windows[i].clear()
            if hits:
                yield i, block, hits


def decontaminate(docs: DataFrame, items: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, distance, first_word, end_word`` of every item found in a document."""
    path, blocks = item_blocks(items, block_bytes)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, 1):
            for i, block, hits in _hits(chunk, path, blocks, error_rate):
                _, batch, lo, _ = chunk[i]
                text, item, distance, first, end = zip(*hits)
                ids = batch.column(0).take(pa.array([lo + t for t in text]))
                names = pa.array([block.items[x][0] for x in item])
                yield pa.RecordBatch.from_arrays([ids, names, pa.array(distance, pa.int32()), pa.array(first, pa.int64()), pa.array(end, pa.int64())], names=["doc_id", "item_id", "distance", "first_word", "end_word"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(items.dtypes)['item_id']}, distance int, first_word long, end_word long"
    return docs.select("doc_id", "text").mapInArrow(search, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns and unmoved."""
    path, blocks = item_blocks(items, block_bytes)
    at = docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_batch, keep = None, None  # a batch's rows can spread over chunks
        for chunk in _chunks(batches, at):
            hit: dict[int, list[int]] = {}
            for i, _, hits in _hits(chunk, path, blocks, error_rate):
                number, _, lo, _ = chunk[i]
                hit.setdefault(number, []).extend(lo + t for t, *_ in hits)
            for number, batch in {number: batch for number, batch, *_ in chunk}.items():
                if open_batch is not None and open_batch[0] != number:
                    yield open_batch[1].filter(pa.array(keep))
                    open_batch = None
                if open_batch is None:
                    open_batch, keep = (number, batch), np.ones(batch.num_rows, bool)
                keep[hit.get(number, [])] = False
        if open_batch is not None:
            yield open_batch[1].filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
