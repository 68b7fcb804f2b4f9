"""N-gram Jaccard join (op 3), substring dedup (op 5), the sketches and components under them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from wardlight.llm import ngram_join, substring_dedup, window_counts
from wardlight.llm.common import split_words, text_bytes
from wardlight.llm.components import components

from .util import SCHEMA, corpus, frame, words


def brute_components(rows, width=5, percent=80):
    sets = {}
    for r in rows:
        w = words(r[1], lower=True)
        sets[r[0]] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {d: d for d in sets}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d
    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), root(d)) for d in sets)


def brute_removal(rows, width=13):
    first = {}
    for r in rows:
        w = words(r[1])
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            if r[0] is not None:
                first[key] = min(first.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w = words(r[1])
        lost = [False] * len(w)
        for i in range(len(w) - width + 1):
            if r[0] is not None and first[tuple(w[i:i + width])] < r[0]:
                lost[i:i + width] = [True] * width
        out.append((str(r[0]), len(w), sum(lost), b" ".join(x for x, l in zip(w, lost) if not l).decode()))
    return sorted(out)


def test_split_words_is_the_contract_pattern():
    texts = [r[1] for r in corpus()]
    buf, offs = text_bytes(pa.array(texts))
    starts, ends, counts = split_words(buf, offs)
    got, at = [bytes(buf[a:b]) for a, b in zip(starts, ends)], 0
    for t, n in zip(texts, counts.tolist()):
        assert got[at:at + n] == words(t)
        at += n


def test_estimates_are_never_too_low(spark):
    rnd = np.random.default_rng(2)
    layout = window_counts.Layout(6 * 2000, 4000)
    layout.bits = 9                                       # crowded on purpose
    rows = [(int(i), int(v), int(i % layout.blocks)) for i, v in enumerate(rnd.integers(0, 600, 2000))]
    blocks = spark.createDataFrame(rows, "i long, v long, block int")

    def of(t):
        return t["v"].to_numpy().astype(np.uint64)
    marks = window_counts.merged_orders(window_counts.partial_sketches(blocks, layout, of)).toArrow()
    true = np.bincount([r[1] for r in rows])
    for b in range(layout.blocks):
        mine = np.array([r[1] for r in rows if r[2] == b], np.uint64)
        got = window_counts.estimated_orders(mine, layout, marks.filter(pa.compute.equal(marks["block"], b)))
        assert (got >= np.log2(true[mine]).astype(int)).all()


@pytest.mark.parametrize("seed", [32, 0])
def test_components_of_near_copies(spark, seed):
    rows = corpus(seed=seed)
    if not seed:
        rows = [r for r in rows if len(r[1] or "") < 1200][40:]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted(tuple(g) for g in got) == brute_components(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_families(spark, seed):
    """Copies of copies, cut and edited with few words, so that copies share what their first text
    lacks; texts made of shared passages; ids in any order."""
    rnd = random.Random(seed)
    few = [f"w{i}" for i in range(6)]
    passages = [[f"p{k}x{i}" for i in range(25)] for k in range(4)]
    texts = []
    for f in range(4):
        family = [[f"f{f}x{i}" for i in range(rnd.choice([24, 60, 90]))]]
        for _ in range(24):
            copy = list(rnd.choice(family))
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = rnd.choice(few)
            if rnd.random() < 0.3:
                at = rnd.randrange(len(copy))
                copy[at:at + rnd.randint(1, 4)] = rnd.choices(few, k=rnd.randint(0, 3))
            family.append(copy)
        texts += family
    for _ in range(25):
        texts.append(sum(rnd.sample(passages, rnd.randint(1, 4)), []) + rnd.choices(few, k=rnd.randint(0, 12)))
    ids = rnd.sample(range(1000), len(texts))
    rows = [(d, " ".join(t), *[None] * 11) for d, t in zip(ids, texts)]
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert sorted(tuple(g) for g in got) == brute_components(rows)


def test_near_duplicates_odd_rows(spark):
    rows = corpus(n=5)
    odd = [rows[0], (None, rows[0][1], *rows[0][2:]), (None, None, *rows[0][2:])]
    got = ngram_join.near_duplicates(frame(spark, rows + odd)).collect()
    assert len(got) == len(rows) + 3
    assert sorted({tuple(g) for g in got if g["doc_id"] is not None}) == brute_components(rows)
    assert all(g["component_id"] is None for g in got if g["doc_id"] is None)
    assert ngram_join.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_links_of_ids_with_different_texts(spark):
    """An id on a third of the rows: every class of equal texts takes part, with all links of the id."""
    rnd = random.Random(8)
    texts = [" ".join(f"t{rnd.randrange(500)}" for _ in range(60)) for _ in range(12)]
    near = [t + " end" for t in texts]
    rest = [None] * 11
    rows = [(5, t, *rest) for t in texts[:6]] * 2 + [(7 + i, t, *rest) for i, t in enumerate(texts)]
    rows += [(40 + i, t, *rest) for i, t in enumerate(near)] + [(5, "", *rest), (3, near[11], *rest), (None, texts[0], *rest)]
    up = {}
    for i in range(12):
        up[7 + i] = up[40 + i] = 5 if i < 6 else 3 if i == 11 else 7 + i
    got = ngram_join.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(g["component_id"] == {5: 5, 3: 3, None: None, **up}[g["doc_id"]] for g in got)


def test_classes_whose_smallest_id_is_the_same(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    for first, second in ((a, b), (b, a)):                 # one of the two has the greater signature
        rows = [(5, first), (5, second), (7, second), (9, second + " end"), (11, first + " end"), (13, "x y z")]
        got = ngram_join.near_duplicates(frame(spark, [(*r, *[None] * 11) for r in rows])).collect()
        assert sorted((g["doc_id"], g["component_id"]) for g in got) == [(5, 5), (5, 5), (7, 5), (9, 5), (11, 5), (13, 13)]


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(5, 5), (300, 7), (7, 300)]
    rnd.shuffle(edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in [7, *range(200, 260), 300]}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("blocks", [1, 40])
def test_removed_words_equal_brute_force(spark, monkeypatch, blocks):
    rows = corpus()
    rows += [rows[2], (None, rows[2][1], *rows[0][2:])]
    monkeypatch.setattr(window_counts.text_blocks, "__defaults__", (max(1, sum(len((r[1] or "").encode()) for r in rows) // blocks),))
    got = substring_dedup.remove_repeats(frame(spark, rows), carried=["doc_id", "block"]).collect()
    assert sorted((str(g["doc_id"]), g["n_words"], g["n_removed"], g["kept"]) for g in got) == brute_removal(rows)
    assert all(g["carried"]["doc_id"] == g["doc_id"] and g["carried"]["block"] == 1 for g in got)


def test_layout_of_what_stays(spark):
    p = " ".join(f"w{i}" for i in range(13))
    rows = [(1, f"a\n\n{p}\tz", *[None] * 11), (2, f"x  y\n{p}\n q\n", *[None] * 11), (3, None, *[None] * 11)]
    got = {g["doc_id"]: g["kept"] for g in substring_dedup.remove_repeats(frame(spark, rows), layout=True).collect()}
    assert got == {1: rows[0][1], 2: "x  y\n q", 3: None}
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
