"""Methods against plain restatements: k-d cuts (op 2), the template tree (op 6), samples (ops 7, 8), early closing (op 10)."""

import random
import time
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from wardlight.llm import bpe_fst, byte_cnn, kd_shards, language_crf, top_k, url_templates

from .util import SCHEMA, corpus, frame

SMALL = "/root/testdata/sf0.001"


def plain_cuts(rows, shards, first=0):
    """Shard of each (keys, size, i) row by recursive cuts at weighted quantiles of the widest key."""
    if shards == 1 or not rows:
        return {i: first for _, _, i in rows}
    spread = [(max(r[0][d] for r in rows) >> 24) - (min(r[0][d] for r in rows) >> 24) for d in range(len(rows[0][0]))]
    dim = spread.index(max(spread))
    target, upto, cut = sum(r[1] for r in rows) * (shards // 2) / shards, 0, None
    by_key = Counter()
    for keys, size, _ in rows:
        by_key[keys[dim]] += size
    for key in sorted(by_key):
        before, upto = upto, upto + by_key[key]
        if upto >= target:
            cut = key if upto - target <= target - before else key - 1
            break
    left, right = [r for r in rows if r[0][dim] <= cut], [r for r in rows if r[0][dim] > cut]
    return {**plain_cuts(left, shards // 2, first), **plain_cuts(right, shards - shards // 2, first + shards // 2)}


def test_cuts_equal_plain_tree(spark):
    for seed, shards in ((1, 8), (2, 5)):
        rows = corpus(seed=seed) + corpus(seed=seed)[:10]
        meta = kd_shards.shard_metadata(frame(spark, rows).withColumn("lang", F.expr("if(doc_id % 3 = 0, 'a', 'b')")), ["doc_id", "size", "lang"])
        meta = meta.checkpoint()
        found = [r.asDict() for r in kd_shards.kd_assign(meta, shards).collect()]
        keyed = [((r["k0"], r["k1"], r["k2"]), r["size"], (r["doc_id"], r["tie"])) for r in meta.collect()]
        assert Counter((r["doc_id"], r["tie"], r["shard"]) for r in found) == Counter((*i, s) for i, s in plain_cuts(keyed, shards).items())


def test_shards_do_not_depend_on_the_layout(spark):
    rows = corpus(seed=3)
    rows += rows[:40] + [rows[5]] * 90
    got = []
    for parts in (1, 7):
        docs = spark.createDataFrame(random.Random(parts).sample(rows, len(rows)), SCHEMA).repartition(parts)
        got.append(Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in kd_shards.kd_shards(docs, ["doc_id", "size", "lang"], 6).collect()))
    assert got[0] == got[1]


def plain_templates(paths, min_pages, weight, prior):
    """template and purity of each (host, segments) from its (pages, labelled, blocked)."""
    name = {key: "" for key in paths}
    for level in range(max((len(s) for _, s in paths), default=0)):
        child, node = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
        for (host, seg), counts in paths.items():
            if len(seg) > level:
                for i in range(3):
                    child[host, name[host, seg], seg[level]][i] += counts[i]
                node[host, name[host, seg]][0] += counts[1]
                node[host, name[host, seg]][1] += counts[2]
        called = {}
        for (host, at, s), (pages, labelled, blocked) in child.items():
            n, b = node[host, at]
            share = b / n if n else 0
            differs = n > 0 and (blocked - labelled * share) ** 2 > 3.84 * labelled * share * (1 - share)
            if pages >= min_pages and (labelled == 0 or differs):
                called[host, at, s] = s
            else:
                called[host, at, s] = "*" if labelled else "<few>"
        name = {(host, seg): name[host, seg] + ("/" + called[host, name[host, seg], seg[level]] if len(seg) > level else "") for host, seg in paths}
    total = defaultdict(lambda: [0, 0])
    for (host, seg), counts in paths.items():
        total[host, name[host, seg]][0] += counts[1]
        total[host, name[host, seg]][1] += counts[2]
    return {key: (t, (total[key[0], t][1] + weight * prior) / (total[key[0], t][0] + weight)) for key, t in name.items()}


def test_templates_equal_plain_tree(spark):
    rnd, paths = random.Random(4), {}
    for host in "hg":
        for _ in range(150):
            seg = tuple(rnd.choice("abcdef") if k else rnd.choice("xyz") for k in range(rnd.randint(1, 4)))
            labelled = rnd.choice([0, 0, 1, 3, 6])
            paths[host, seg] = (labelled + rnd.randint(1, 4), labelled, labelled if seg[0] == "x" or "c" in seg else rnd.randint(0, labelled // 3))
    table = spark.createDataFrame([(h, list(s), *c) for (h, s), c in paths.items()], "host string, segments array<string>, pages long, labelled long, blocked long")
    got = {(r["host"], tuple(r["segments"])): (r["template"], r["purity"]) for r in url_templates.path_templates(table, 5, 4.0, 0.25).collect()}
    want = plain_templates(paths, 5, 4.0, 0.25)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-9 for k in want) and len({v[0] for v in got.values()}) > 8


def test_deep_paths_end(spark):
    urls = ["https://deep.net/es/" + "/".join(f"s{i}x{k}" for i in range(12)) for k in range(5)] + ["http://a.org/1/2/3/4/5/6/7/8/9"]
    start = time.time()
    got = url_templates.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), [("net/es/", "block")]).collect()
    assert time.time() - start < 60 and [g["verdict"] for g in sorted(got, key=lambda g: g["page_id"])] == ["block"] * 5 + ["allow"]


def test_an_id_on_most_rows_is_still_learned(spark):
    """Rows that share an id are told apart by their texts; a label of equal rows only has one row to learn."""
    for own in (1, 2, 3, 4):
        rows = [(own, f"mot numéro {i % 500}", "fr", *[None] * 10) for i in range(2000)] + [(900 + i, f"word number {i}", "en", *[None] * 10) for i in range(50)]
        rows += [(5000, "μία λέξη", "el", *[None] * 10)] * 300
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        texts, labels = language_crf.language_sample(docs, 100)
        count, out = Counter(labels), {r[0] for r in docs.where(byte_cnn.held_out(F.col("doc_id"))).select("doc_id").distinct().collect()}
        assert count["fr"] == (0 if own in out else 100) and count["en"] == sum(900 + i not in out for i in range(50))
        assert count["el"] == (0 if 5000 in out else 1) and len(set(texts)) == len(texts)
        marks = spark.createDataFrame([(own, 1)] + [(900 + i, 0) for i in range(50)], "doc_id long, quality int")
        _, y = byte_cnn.labelled_sample(docs, marks, "quality", 60)
        assert Counter(y.tolist())[1] == (0 if own in out else 60) and Counter(y.tolist())[0] == count["en"]
        other, same = language_crf.language_sample(docs.repartition(5), 100)
        assert (texts, labels) == (other, same)


def test_some_queries_close_early_on_the_embeddings(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()
    values = np.floor(64 * np.array([r["embedding"] for r in rows], float)).astype(np.int64)
    lists = np.argsort(values, axis=0, kind="stable")
    queries = values[::20]
    some = top_k.aggregate_block(queries, values, lists, 20)
    closed = [s for s in some if len(s) < len(values)]
    assert len(closed) > len(queries) / 2
    for q, s in zip(queries, some):
        score = values @ q
        assert set(np.flatnonzero(score > np.sort(score)[-20])) <= set(s.tolist()) and len(s) >= 20


def test_packed_states_come_back():
    for base, places in ((-1, [(0, ())]), (7, [(3, None), (0, (5, 6)), (2**31 - 1, ())]), (-2, [(9, (1,))])):
        assert bpe_fst._unpacked(bpe_fst._packed(base, places)) == (base, places)


def test_long_pieces_are_not_kept():
    import public_tokenizers as P
    pieces = bpe_fst.Pieces(bpe_fst.read_ranks(P.path("byte_bpe_50k.tiktoken")), P.PATTERN)
    pieces.encode("x" * 5000 + " short " + "y" * 65)
    assert max(map(len, pieces)) <= bpe_fst.LONG_PIECE and " short" in pieces
