"""Ranked lexical search (op 13)."""

import math
import random
import re
from collections import Counter

import numpy as np

from wardlight.llm import ranked_search as rs

from .util import SCHEMA, corpus, frame

TERM = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_treap_equals_dense_sums():
    rng = np.random.default_rng(5)
    for n_rows, n_columns, fill, top in ((1, 1, 1.0, 3), (7, 300, 0.2, 4), (300, 9, 0.5, 1000), (40, 2000, 0.05, 3), (64, 64, 0.0, 2)):
        grid = np.where(rng.random((n_rows, n_columns)) < fill, rng.integers(1, top, (n_rows, n_columns)), 0)
        rows, columns = np.nonzero(grid)
        shuffled = rng.permutation(len(rows))
        treap = rs.Treap(rows[shuffled], columns[shuffled], grid[rows, columns][shuffled])
        for _ in range(20):
            wanted = rng.choice(n_rows, rng.integers(0, min(n_rows, 12) + 1), replace=False)
            wanted = wanted[np.isin(wanted, rows)]
            total = grid[wanted].sum(0)
            best = np.lexsort((np.arange(n_columns), -total))[:7]
            best = best[total[best] > 0]
            for at_once in (1, 5, 512):
                got, scores = treap.top(wanted, 7, at_once)
                assert got.tolist() == best.tolist() and scores.tolist() == total[best].tolist()


def test_search_opens_a_part_of_the_grid():
    """With one document far ahead, the ranges without it stay closed."""
    rng = np.random.default_rng(6)
    grid = rng.integers(1, 10, (4, 4096))
    grid[:, 1234] = 1000
    rows, columns = np.nonzero(grid)
    treap = rs.Treap(rows, columns, grid[rows, columns])
    opened = 0
    real = rs._CHILD

    class Counting:
        def __getitem__(self, key):
            nonlocal opened
            opened += key[0].shape[0]
            return real[key]

    rs._CHILD = Counting()
    try:
        found, _ = treap.top(np.arange(4), 1, 1)
    finally:
        rs._CHILD = real
    assert found.tolist() == [1234] and opened <= 2 * 2 * treap.height


def expected(docs, items, k):
    found = [Counter(terms(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(f) for f in found), sum(sum(f.values()) for f in found)
    df = Counter(t for f in found for t in f)
    queries = {}
    for i, t in items:
        queries.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in queries.items():
        scores = []
        for (d, _), f in zip(docs, found):
            m = 100 - 50 + 50 * sum(f.values()) * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * f[t] // (1000 * f[t] + 20 * m)) for t in own if f[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_search_equals_plain_ranking(spark):
    rows = corpus()
    rnd = random.Random(3)
    rows += [rows[5], (None, rows[6][1], *rows[0][2:]), (3, "other text of the id", *rows[0][2:])]
    rows += [(9000 + i, "the the same tie", *rows[0][2:]) for i in range(70)]
    items = [(i, " ".join(rnd.sample((rnd.choice(rows)[1] or "x").split() or ["y"], 1) * 3 + terms(rnd.choice(rows)[1])[:20])) for i in range(25)]
    items += [(1, items[1][1]), (2, "a second text, of item TWO"), (100, None), (101, ""), (102, "?!"), (103, "The TIE"), (None, "no id at all"),
              (104, "日本語 one Two"), (105, "nowhere-to-be-found")]
    docs = [(r[0], r[1]) for r in rows]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, score int").repartition(2)
    want = in_order(expected(docs, items, 9))
    for shard_docs, block in ((1 << 14, 4 << 20), (20, 200)):
        got = [tuple(r) for r in rs.search(frame(spark, rows), table, 9, shard_docs, block).select("item_id", "rank", "doc_id", "score").collect()]
        assert in_order(got) == want
    none = spark.createDataFrame([], SCHEMA)
    assert rs.search(none, table).count() == 0
    assert rs.search(frame(spark, rows), table.limit(0)).count() == 0


def test_long_text_is_counted_whole(spark):
    long = " ".join(["w%d" % (i % 50) for i in range(200_000)]) + " needle"
    docs = [(1, long), (2, "needle"), (3, None)]
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame([(7, "needle w3")], "item_id long, text string")
    got = [tuple(r) for r in rs.search(frame_, items).select("item_id", "rank", "doc_id", "score").collect()]
    assert in_order(got) == in_order(expected(docs, [(7, "needle w3")], 50))
