"""Operator 9: benchmark items in documents, by pigeonhole edit matching.

Words are runs of ASCII letters, digits and non-ASCII bytes, A-Z lower-cased, so case, punctuation and
line breaks don't hide a leak. In scripts without spaces (Chinese, Japanese, Thai, Lao, Burmese, Khmer)
every character is a word, and their punctuation stands between words. An item of m words may differ by k = m // 5 words (inserted, deleted
or replaced; none below ten words). It is split into k + 1 pieces of nearly equal length: wherever it
occurs with at most k errors, one piece occurs unchanged. Piece hits are found by hashed word windows
of the few piece lengths; around every hit, the least edit distance of the item to any run of the
document's words is computed by Myers' bit-parallel automaton.

Benchmark items are bounded query data: they go to the tasks in parts of at most ITEM_BYTES of text,
each part one narrow pass over the documents. Nothing of the documents is shuffled or collected.

Cases: an item that is null or has no word matches nothing; a short one matches exactly; a null or empty
document matches nothing; items of equal text are all reported; a document row is reported once per
item, with its first place of least distance; repeated document rows are all reported; empty tables
give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import Hasher, release, slices, split_words, text_bytes

ERRORS_PER_WORD = 5        # one error allowed for so many words
ITEM_BYTES = 4 << 20
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SEED = 31
# Code points of scripts without spaces, and of the punctuation of East Asian text.
_ALONE = np.array([(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3031, 0x3035),
                   (0x303B, 0x303C), (0x3041, 0x30FA), (0x30FC, 0x312F), (0x31A0, 0x31BF), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
                   (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)])
_MARKS = np.array([(0x3000, 0x3004), (0x3008, 0x3020), (0x302A, 0x3030), (0x3036, 0x303A), (0x303D, 0x303F), (0x30FB, 0x30FB),
                   (0xFE10, 0xFE1F), (0xFE30, 0xFE4F), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)])


def _within(codes: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ranges[:, 0], codes, "right") - 1
    return (at >= 0) & (codes <= ranges[np.maximum(at, 0), 1])


def item_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words of each row."""
    lead = np.flatnonzero(buf >= 0xE0)                     # characters of three and four bytes
    lead = lead[(buf[lead] != 0xE2) & (buf[lead] <= 0xF3)]
    if not len(lead):
        return split_words(buf, offs, _APART)
    four = buf[lead] >= 0xF0
    one, two, three, last = (buf[np.minimum(lead + i, len(buf) - 1)].astype(np.int64) for i in range(4))
    code = np.where(four, (one & 7) << 18 | (two & 63) << 12 | (three & 63) << 6 | last & 63,
                    (one & 15) << 12 | (two & 63) << 6 | three & 63)
    size = 3 + four
    mark, alone = _within(code, _MARKS), _within(code, _ALONE)
    word = ~_APART[buf]
    for i in range(4):
        word[lead[mark & (size > i)] + i] = False
    cut = np.zeros(len(buf) + 1, bool)                     # places where a word can't go on
    cut[offs] = cut[lead[alone]] = cut[lead[alone] + size[alone]] = True
    first, final = word.copy(), word.copy()
    first[1:] &= ~word[:-1] | cut[1:-1]
    final[:-1] &= ~word[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(final) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offs))


def error_budget(words: int) -> int:
    return words // ERRORS_PER_WORD if words >= 2 * ERRORS_PER_WORD else 0


def least_distance(masks: dict[int, int], m: int, text: list[int], k: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any run of ``text``, if at most k, and the run's end.

    ``masks`` has a bit mask of the pattern's places for each of its words; the columns of the
    distance matrix are kept as bits of vertical steps up and down.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, None
    for at, word in enumerate(text):
        same = masks.get(word, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right_up = down | (full & ~(diagonal | up))
        right_down = up & diagonal
        if right_up & top:
            score += 1
        elif right_down & top:
            score -= 1
        right_up = right_up << 1 & full
        right_down = right_down << 1 & full
        up = right_down | (full & ~(diagonal | right_up))
        down = right_up & diagonal
        if score <= k and (best is None or score < best[0]):
            best = score, at + 1
    return best


class ItemIndex:
    """The pieces of some items, and their places in the items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.hasher = Hasher(_SEED)
        self.items: list[tuple[int, int, int, dict[int, int]]] = []       # id, words, budget, masks
        self.pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            raw = text.encode()
            buf, offs = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
            starts, ends, _ = item_words(buf, offs)
            words = self.hasher.words(buf, starts, ends, True)
            m = len(words)
            if not m:
                continue
            masks: dict[int, int] = defaultdict(int)
            for i, w in enumerate(words.tolist()):
                masks[w] |= 1 << i
            k = error_budget(m)
            cuts = [m * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                piece = int(self.hasher.windows(words[a:b], b - a)[0])
                self.pieces[b - a][piece].append((len(self.items), a))
            self.items.append((item_id, m, k, dict(masks)))
        self.pieces = {n: dict(p) for n, p in self.pieces.items()}
        self.sorted = {n: np.sort(np.fromiter(p, np.uint64, len(p))) for n, p in self.pieces.items()}

    def matches(self, buf: np.ndarray, offs: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, distance, words of the row up to the match's end, words of the item)."""
        starts, ends, counts = item_words(buf, offs)
        words = self.hasher.words(buf, starts, ends, True)
        row_end = np.cumsum(counts)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for n, known in self.sorted.items():
            windows = self.hasher.windows(words, n)
            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, windows), len(known) - 1)] == windows)
            row = np.searchsorted(row_end, hit, "right")
            inside = hit + n <= row_end[row]
            for at, r, h in zip(hit[inside].tolist(), row[inside].tolist(), windows[hit[inside]].tolist()):
                first, last = int(row_end[r] - counts[r]), int(row_end[r])
                for item, place in self.pieces[n][h]:
                    _, m, k, _ = self.items[item]
                    spans[r, item].append((max(first, at - place - k), min(last, at - place + m + k)))
        out = []
        for (r, item), runs in spans.items():
            item_id, m, k, masks = self.items[item]
            best, done = None, -1
            runs.sort()
            joined = [list(runs[0])]
            for a, b in runs[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], b)
                else:
                    joined.append([a, b])
            for a, b in joined:
                got = least_distance(masks, m, words[a:b].tolist(), k)
                if got and (best is None or got[0] < best):
                    best, done = got[0], a + got[1] - int(row_end[r] - counts[r])
            if best is not None:
                out.append((r, item_id, best, done, m))
        return out


def _item_parts(items: DataFrame, item_column: str) -> Iterator[list[tuple[int, str]]]:
    """The items, about ITEM_BYTES of text at a time."""
    items = items.where(F.col("text").isNotNull()).select(F.col(item_column).cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-total // ITEM_BYTES))
    for p in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).collect()
        yield [(r["item_id"], r["text"]) for r in some]


def _batch_matches(index: ItemIndex, batch: pa.RecordBatch) -> list[tuple[int, int, int, int, int]]:
    buf, offs = text_bytes(batch["text"])
    return [(f[0] + i, *f[1:]) for i, j in slices(offs) for f in index.matches(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i])]


def find_items(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", item_column: str = "item_id") -> DataFrame:
    """``id_column``, item_id, distance, end_word (words of the document up to the match's end),
    item_words: one row per document row and item that it holds."""
    rows = docs.select(F.col(id_column).alias("id"), "text")
    schema = docs.select(F.col(id_column).alias("id")).schema.add("item_id", "long").add("distance", "integer") \
        .add("end_word", "long").add("item_words", "integer")
    out = None
    for listed in _item_parts(items, item_column):

        def run(batches: Iterator[pa.RecordBatch], listed: list = listed) -> Iterator[pa.RecordBatch]:
            release()
            index = ItemIndex(listed)
            for batch in batches:
                found = _batch_matches(index, batch)
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(pa.array([f[0] for f in found], pa.int64())),
                     *(pa.array([f[k] for f in found], t) for k, t in
                       ((1, pa.int64()), (2, pa.int32()), (3, pa.int64()), (4, pa.int32())))],
                    ["id", "item_id", "distance", "end_word", "item_words"])

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("id", id_column)


def without_items(docs: DataFrame, items: DataFrame, item_column: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    for listed in _item_parts(items, item_column):

        def run(batches: Iterator[pa.RecordBatch], listed: list = listed) -> Iterator[pa.RecordBatch]:
            release()
            index = ItemIndex(listed)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in _batch_matches(index, batch)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
