"""Operator 13: ranked lexical search over K2-treaps of the term-document grid.

A score is a sum over the item's terms of an impact that depends on term and document alone:
``w * ((1000000000 * tf) div (1000 * tf + 20 * m))``, see :func:`weights` and :func:`impacts`. So the
grid of terms (rows) and documents (columns) holds impacts, and a K2-treap keeps it: a quadtree whose
empty cells are left out. A cell is four bits, one per quadrant that isn't empty; counting bits finds
its children in the next level; and every cell has the greatest impact below it.

For one item the paths of its rows go down the tree jointly. A state is a range of documents with one
cell per row; the sum of the cells' maxima bounds the score of every document in the range. The range
of the greatest bound is opened first, halves that can't reach the k-th best score found so far are
left, and the search ends when no open range can. Ranges of one parent batch are opened together, so
the steps are array operations; the order of opening changes the work, never the result.

The job: a first pass over all texts counts terms and writes, in chunks of documents, the places of
the items' terms; the corpus counts come from these. A second pass reads chunks, joins them to shards
of about SHARD_DOCS documents, builds one treap per shard, searches all items in it and keeps k
documents an item; the best of all shards remain. Shards are runs of rows, so no key is hot, nothing
is exchanged but k rows per item and shard. Items are taken in blocks of BLOCK_BYTES of text: the
terms of one block are what a task gets from the driver.

Cases: a null or empty text has no terms; such documents are found for nothing and not counted, such
items have no result; rows of documents that repeat a doc_id, and repeated rows, are documents of
their own; a null doc_id comes after all others of its score; items that share an item_id are one item
with the terms of all; items with a null item_id are one item, too; other columns are ignored; an
empty table gives an empty result. Impacts are 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlight.llm.common import Hasher, slices, split_words, text_bytes
from wardlight.session import scratch_path

K = 50
SHARD_DOCS = 1 << 14
CHUNK_DOCS = 1 << 12
BLOCK_BYTES = 4 << 20
OPEN_AT_ONCE = 256
RESULT = "item int, doc_id long, score long"

# Fixed value: what lies between terms.
_APART = np.zeros(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _APART[_a:_b + 1] = True
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
# _CHILD[bits, quadrant]: how many children come before that of the quadrant; -1 if it is empty
_CHILD = np.array([[bin(b & ((1 << q) - 1)).count("1") if b >> q & 1 else -1 for q in range(4)] for b in range(16)], np.int64)
_ONES = np.array([bin(b).count("1") for b in range(16)], np.int64)


def terms_of(text: str | None) -> list[str]:
    """The terms of a text, A-Z lower-cased."""
    return _TERM.findall((text or "").translate(_LOWER))


class Terms:
    """Sorted terms, found by two independent 64-bit hashes of their bytes."""

    def __init__(self, terms: list[str]):
        self.terms = sorted(terms)
        raw = [t.encode() for t in self.terms]
        buf = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        starts = ends - np.array([len(r) for r in raw], np.int64)
        first, second = (Hasher(s).words(buf, starts, ends, False) for s in (101, 102))
        self.row = np.argsort(first).astype(np.int32)
        self.first, self.second = first[self.row], second[self.row]


def postings(terms: Terms, buf: np.ndarray, offs: np.ndarray, hashers: tuple[Hasher, Hasher]) -> tuple[np.ndarray, ...]:
    """Of some texts: number of terms of each, and row, document, tf where one of ``terms`` occurs."""
    starts, ends, counts = split_words(buf, offs, _APART)
    words = hashers[0].words(buf, starts, ends, True)
    at = np.minimum(np.searchsorted(terms.first, words), max(len(terms.first) - 1, 0))
    hit = np.flatnonzero(terms.first[at] == words) if len(terms.first) else np.zeros(0, np.int64)
    hit = hit[hashers[1].words(buf, starts[hit], ends[hit], True) == terms.second[at[hit]]]
    doc = np.repeat(np.arange(len(counts)), counts)[hit]
    key, tf = np.unique(doc.astype(np.uint64) << np.uint64(32) | terms.row[at[hit]].astype(np.uint64), return_counts=True)
    return counts, (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32), tf.astype(np.uint32)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def impacts(w: np.ndarray, tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a score that a term of weight w gives a document of n terms in which it occurs tf
    times, in a corpus of n_docs documents and n_terms terms."""
    tf = tf.astype(np.int64)
    m = 50 + 50 * n.astype(np.int64) * n_docs // max(n_terms, 1)
    return w * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Treap:
    """K2-treap of points (row, column, impact > 0); every (row, column) at most once."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, impact: np.ndarray):
        def bits(v: np.ndarray) -> int:
            return int(v.max(initial=0)).bit_length()

        self.height = max(bits(rows), bits(columns))
        # the shorter side is stretched, so rows part as early as columns do
        self.row_shift, self.column_shift = self.height - bits(rows), self.height - bits(columns)
        r, c = rows.astype(np.uint64) << np.uint64(self.row_shift), columns.astype(np.uint64) << np.uint64(self.column_shift)
        key = np.zeros(len(r), np.uint64)
        for b in range(self.height):
            one = np.uint64(1)
            key |= (r >> np.uint64(b) & one) << np.uint64(2 * b + 1) | (c >> np.uint64(b) & one) << np.uint64(2 * b)
        order = np.argsort(key)
        key, best = key[order], impact[order]
        self.cells, self.first, self.best = [], [], [best]
        for _ in range(self.height):
            parent = key >> np.uint64(2)
            new = np.flatnonzero(np.diff(parent, prepend=parent[:1] + np.uint64(1))) if len(parent) else np.zeros(0, np.int64)
            cell = np.add.reduceat(np.uint8(1) << (key & np.uint64(3)).astype(np.uint8), new) if len(new) else np.zeros(0, np.uint8)
            best = np.maximum.reduceat(best, new) if len(new) else best
            ones = _ONES[cell]
            self.cells.append(cell.astype(np.uint8))
            self.first.append(np.cumsum(ones) - ones)          # rank: children before the cell's own
            self.best.append(best)
            key = parent[new]
        for level in (self.cells, self.first, self.best):
            level.reverse()

    def top(self, rows: np.ndarray, k: int, at_once: int = OPEN_AT_ONCE) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the k greatest sums over ``rows`` above 0, ties to smaller columns."""
        found_c, found_s, bar = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        if not len(self.best[0]) or not len(rows):
            return found_c, found_s
        path = rows.astype(np.int64) << self.row_shift
        root = np.zeros((1, len(rows)), np.int64)
        # batches of ranges of one level, best bound first: (-bound, -level, number, bounds, columns, cells)
        number = 0
        heap = [(-int(self.best[0][0]) * len(rows), 0, 0, np.array([int(self.best[0][0]) * len(rows)]), np.zeros(1, np.int64), root)]
        while heap and -heap[0][0] >= bar:
            _, level, _, bounds, columns, cells = heapq.heappop(heap)
            level = -level
            if level == self.height:
                found_c = np.concatenate([found_c, columns >> self.column_shift])
                found_s = np.concatenate([found_s, bounds])
                if len(found_s) > k:
                    keep = np.lexsort((found_c, -found_s))[:k]
                    found_c, found_s = found_c[keep], found_s[keep]
                if len(found_s) == k:
                    bar = max(bar, int(found_s.min()))
                continue
            live = int(np.searchsorted(-bounds, -bar, "right"))
            take = min(live, at_once)
            if take < live:
                number += 1
                heapq.heappush(heap, (-int(bounds[take]), -level, number, bounds[take:live], columns[take:live], cells[take:live]))
            cells, columns = cells[:take], columns[:take]
            down = path >> self.height - level - 1 & 1
            code = np.where(cells >= 0, self.cells[level][cells], 0)
            start = self.first[level][cells]
            best = self.best[level + 1]
            halves = []
            for half in (0, 1):
                place = _CHILD[code, 2 * down + half]
                child = np.where(place >= 0, start + place, -1)
                halves.append((child, np.where(place >= 0, best[child], 0).sum(1), 2 * columns + half))
            cells, bounds, columns = (np.concatenate([halves[0][i], halves[1][i]]) for i in range(3))
            order = np.argsort(-bounds, kind="stable")
            order = order[:int(np.searchsorted(-bounds[order], -bar, "right"))]
            if len(order):
                number += 1
                heapq.heappush(heap, (-int(bounds[order[0]]), -level - 1, number, bounds[order], columns[order], cells[order]))
        keep = np.lexsort((found_c, -found_s))
        return found_c[keep], found_s[keep]


_CHUNK = pa.schema([("docs", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("rows", pa.binary()),
                    ("columns", pa.binary()), ("counts", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
CHUNK = "docs binary, known binary, sizes binary, rows binary, columns binary, counts binary, n_docs long, n_terms long"


def write_postings(docs: DataFrame, terms: Terms, path: str, chunk_docs: int = CHUNK_DOCS) -> None:
    """Chunks of documents: their ids and sizes where one of ``terms`` occurs, where and how often, and
    the counts of all documents and terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers = Hasher(101), Hasher(102)
        held: list[tuple] = []
        n_docs = n_terms = waiting = 0

        def chunk() -> pa.RecordBatch:
            blobs = [np.concatenate([h[i] for h in held]).tobytes() if held else b"" for i in range(6)]
            return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs]
                                              + [pa.array([n_docs], pa.int64()), pa.array([n_terms], pa.int64())], schema=_CHUNK)

        for batch in batches:
            buf, offs = text_bytes(batch["text"])
            ids = batch["doc_id"]
            for i, j in slices(offs):
                counts, rows, columns, tf = postings(terms, buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i], hashers)
                n_docs, n_terms = n_docs + int((counts > 0).sum()), n_terms + int(counts.sum())
                used, columns = np.unique(columns, return_inverse=True)
                some = ids.slice(i, j - i)
                held.append((some.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")[used],
                             some.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)[used],
                             counts[used].astype("<u4"), rows, (columns + waiting).astype(np.uint32), tf))
                waiting += len(used)
                if waiting >= chunk_docs:
                    yield chunk()
                    held, n_docs, n_terms, waiting = [], 0, 0, 0
        if n_docs:
            yield chunk()

    docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CHUNK).write.parquet(path)


def document_counts(chunks: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each of the block's terms occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            for raw in batch["rows"].to_pylist():
                total += np.bincount(np.frombuffer(raw, np.uint32), minlength=n_terms)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some.astype(np.int32), "n": total[some]})

    out = np.zeros(n_terms, np.int64)
    for term, n in chunks.select("rows").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def search_chunks(chunks: DataFrame, queries: list[np.ndarray], w: np.ndarray, n_docs: int, n_terms: int, k: int,
                  shard_docs: int = SHARD_DOCS) -> DataFrame:
    """item (number in ``queries``), doc_id, score: the k best documents of each shard."""
    by_weight = np.empty(len(w), np.int64)
    by_weight[np.argsort(-w, kind="stable")] = np.arange(len(w))   # rows of like weight lie side by side

    def search(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0] + [len(h[0]) for h in held])
        ids, known, sizes, rows, tf = (np.concatenate([h[i] for h in held]) for i in (0, 1, 2, 3, 5))
        columns = np.concatenate([h[4] + np.uint32(b) for h, b in zip(held, base)])
        order = np.lexsort((ids, known == 0))                      # columns in the order of doc_id, null last
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        impact = impacts(w[rows], tf, sizes[columns], n_docs, n_terms)
        some = impact > 0
        present, local = np.unique(by_weight[rows[some]], return_inverse=True)
        treap = Treap(local, place[columns[some]], impact[some])
        for item, query in enumerate(queries):
            wanted = by_weight[query]
            at = np.minimum(np.searchsorted(present, wanted), max(len(present) - 1, 0))
            found, scores = treap.top(at[present[at] == wanted] if len(present) else at[:0], k)
            if len(found):
                docs = order[found]
                yield pa.RecordBatch.from_pydict({"item": np.full(len(found), item, np.int32),
                                                  "doc_id": pa.array(ids[docs], pa.int64(), mask=known[docs] == 0), "score": scores})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        waiting = 0
        kinds = ("<i8", np.uint8, "<u4", "<u4", "<u4", "<u4")
        for batch in batches:
            for row in range(batch.num_rows):
                held.append(tuple(np.frombuffer(batch[c][row].as_py(), t) for c, t in
                                  zip(("docs", "known", "sizes", "rows", "columns", "counts"), kinds)))
                waiting += len(held[-1][0])
                if waiting >= shard_docs:
                    yield from search(held)
                    held, waiting = [], 0
        if held:
            yield from search(held)

    return chunks.select("docs", "known", "sizes", "rows", "columns", "counts").mapInArrow(run, RESULT)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, set[str]]]]:
    """Items as (item_id, distinct terms), in blocks of about ``block_bytes`` of text."""
    block: list[tuple[int | None, set[str]]] = []
    size = 0
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id").toLocalIterator():
        if block and block[-1][0] == row["item_id"]:
            block[-1][1].update(terms_of(row["text"]))
        else:
            if size >= block_bytes:
                yield block
                block, size = [], 0
            block.append((row["item_id"], set(terms_of(row["text"]))))
        size += len(row["text"] or "")
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = K, shard_docs: int = SHARD_DOCS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents with a score above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, block_bytes):
        terms = Terms(sorted(set().union(*(t for _, t in block))))
        number = {t: i for i, t in enumerate(terms.terms)}
        queries = [np.array(sorted(number[t] for t in own), np.int64) for _, own in block]
        path = scratch_path(spark, "postings")
        write_postings(docs, terms, path)
        chunks = spark.read.parquet(path)
        n_docs, n_terms = chunks.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        w = weights(document_counts(chunks, len(number)), n_docs)
        best = search_chunks(chunks, queries, w, n_docs, n_terms, k, shard_docs)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, b[0]) for i, b in enumerate(block)], "item int, item_id long")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
