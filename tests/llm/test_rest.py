"""K-d shards (op 2), URL templates (op 6), decontamination (op 9), exact top-k (op 10), the pipeline."""

import random
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from wardlight.llm import decontaminate, kd_shards, top_k, url_templates
from wardlight.llm.queries import URL_RULES

from .util import SCHEMA, corpus, frame

SMALL = "/root/testdata/sf0.001"


def test_kd_shards_are_even_and_numbered(spark):
    rows = [(i, "x" * (i % 50), "en" if i % 3 else None, "hot" if i % 3 else f"s{i % 7}", 0, *[None] * 8) for i in range(3000)]
    got = kd_shards.kd_shards(frame(spark, rows), ["doc_id", "size", "lang", "source"], shards=24).collect()
    size, slots = defaultdict(int), defaultdict(list)
    for g in got:
        t = "x" * (g["doc_id"] % 50)
        assert g["size"] == len(t) + 8 and g["text_crc32"] == zlib.crc32(t.encode())
        size[g["shard"]] += g["size"]
        slots[g["shard"]].append(g["slot"])
    assert sorted(size) == list(range(24)) and max(size.values()) - min(size.values()) <= 3 * 58
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_kd_shards_by_target_bytes_and_odd_rows(spark):
    rows = corpus(n=5)
    rows += [rows[0]] * 50 + [(None, None, None, None, *rows[0][4:])]
    got = kd_shards.kd_shards(frame(spark, rows), ["doc_id", "lang", "n"], target_bytes=20_000).collect()
    assert len(got) == len(rows) and 2 <= len({g["shard"] for g in got}) <= 24
    few = kd_shards.kd_shards(frame(spark, rows[:3]), ["doc_id"], shards=24).collect()
    assert len(few) == 3 and len({(g["shard"], g["slot"]) for g in few}) == 3
    assert kd_shards.kd_shards(spark.createDataFrame([], SCHEMA), ["doc_id", "source"], shards=24).count() == 0


def test_slots_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(kd_shards, "SLOT_ROWS", 10)
    got = kd_shards.kd_shards(frame(spark, corpus()), ["doc_id"], shards=2).collect()
    for s in (0, 1):
        own = sorted(g["slot"] for g in got if g["shard"] == s)
        assert own == list(range(len(own)))


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:end], rest[end:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_rules_and_urls(spark):
    urls = ["https://Example.COM/en/1", "http://www.example.com/en/x", "http://a.www.example.com/en/", "https://notexample.com/en/1",
            "https://x.net/es/1?y#z", "https://x.net/fr", "https://com", "https://com/", "ftp://net/es/", "a://b://net/es/", "no scheme",
            "", None, "://", "https://x.org/en/\n1", "https://ÄB.com/Q"] * 2
    rows = [(i, u, 1, "h") for i, u in enumerate(urls)] + [(None, urls[0], 1, "h")]
    got = url_templates.filter_urls(spark.createDataFrame(rows, "page_id long, url string, segments int, host string"), URL_RULES).collect()
    assert len(got) == len(rows)
    for g in got:
        host, path = plain_url(urls[g["page_id"] or 0])
        fits = []
        for rule, verdict in URL_RULES:
            name, _, prefix = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + prefix):
                fits.append((len(rule), rule, verdict))
        assert (g["host"], g["path"]) == (host, path)
        assert g["rule"] == (max(fits)[1] if fits else None) and g["verdict"] in ("allow", "block")
        assert not fits or g["verdict"] == max(fits)[2]
    empty = url_templates.filter_urls(spark.createDataFrame([], "page_id long, url string"), URL_RULES)
    assert empty.count() == 0


def test_templates_reject_by_labelled_purity(spark):
    rules = [("bad.org/x/0", "block"), ("bad.org/x/1", "block"), ("bad.org/y/0", "allow")]
    urls = [f"http://bad.org/{s}/{i}" for s in "xyz" for i in range(40)] + [f"http://bad.org/w/{i}" for i in range(3)]
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {urls[g["page_id"]]: g for g in url_templates.filter_urls(rows, rules, min_pages=5).collect()}
    assert {got[f"http://bad.org/{s}/39"]["verdict"] for s in "yz"} == {"allow"} and got["http://bad.org/w/2"]["template"].startswith("/<few>")
    assert got["http://bad.org/x/39"]["verdict"] == "block" and got["http://bad.org/x/39"]["rule"] is None
    assert got["http://bad.org/x/39"]["purity"] == (got["http://bad.org/x/0"]["purity"])


def plain_distance(p, t):
    prev = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        cur = [i]
        for j, d in enumerate(t, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev)


def test_bit_parallel_distance():
    rnd = random.Random(1)
    for _ in range(1500):
        p, t = rnd.choices(range(4), k=rnd.randint(1, 80)), rnd.choices(range(4), k=rnd.randint(0, 90))
        masks = defaultdict(int)
        for i, w in enumerate(p):
            masks[w] |= 1 << i
        got, want = decontaminate.least_distance(masks, len(p), t, len(p) - 1), plain_distance(p, t)
        assert (got[0] if got else None) == (want if want < len(p) else None)


def test_leaks_within_the_budget(spark, monkeypatch):
    rnd = random.Random(2)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([6, 10, 25, 50])))) for i in range(20)] + [(90, None), (91, ""), (92, "too short")]
    docs, want = [], set()
    for d in range(120):
        item, text = items[rnd.randrange(20)]
        w = text.split()
        for _ in range(rnd.randint(0, 14)):
            at = rnd.randrange(len(w))
            w[at:at + 1] = rnd.choice([[], ["new"], [w[at], "more"]])
        body = rnd.choices(vocab, k=60) + [x.upper() + "," for x in w] + rnd.choices(vocab, k=60)
        docs.append((d, "\n".join(body), *[None] * 11))
        for i, t in items[:20]:
            p = t.split()
            k, best = decontaminate.error_budget(len(p)), plain_distance(p, [x.lower().strip(",") for x in body])
            if best <= k:
                want.add((d, i, best))
    docs += [(500, None, *[None] * 11), (501, "", *[None] * 11)]
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    for size in (1 << 20, 300):                            # one part, several parts
        monkeypatch.setattr(decontaminate, "ITEM_BYTES", size)
        found = decontaminate.find_items(frame(spark, docs), table).collect()
        assert {(f["doc_id"], f["item_id"], f["distance"]) for f in found} == want and len(found) == len(want)
        left = decontaminate.without_items(frame(spark, docs), table)
        assert {r["doc_id"] for r in left.collect()} == {d[0] for d in docs} - {w[0] for w in want}
    assert decontaminate.find_items(frame(spark, docs), table.limit(0)).count() == 0
    assert decontaminate.find_items(spark.createDataFrame([], SCHEMA), table).count() == 0


def plain_item_words(text):
    import regex
    script = r"[\p{Han}\p{Hiragana}\p{Katakana}\u30FC\p{Thai}\p{Lao}\p{Khmer}]"
    return [w.lower() for w in regex.findall(script + r"|(?:(?!" + script + r")[A-Za-z0-9éßя한😀“])+", text)]


def test_words_of_scripts_without_spaces():
    texts = ["日本語のテキスト、カタカナー。", "", "abcé日x1本。「я한」 ß", "ภาษาไทย ok", "😀a𠀀b", "“A”日", "plain ascii", "x", "本"]
    for some in (texts, texts[6:7], texts[:1], [texts[4]], ["", "本", "", "語"]):
        raw = [t.replace("”", " ").encode() for t in some]
        buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        starts, ends, counts = decontaminate.item_words(buf, offs)
        got = [bytes(buf[a:b]).decode().lower() for a, b in zip(starts, ends)]
        want = [plain_item_words(r.decode()) for r in raw]
        assert got == [w for ws in want for w in ws] and counts.tolist() == [len(w) for w in want]


def test_short_items_and_items_without_spaces(spark):
    items = [(1, "人工智能正在改变我们的生活方式。"), (2, "ภาษาไทยไม่มีช่องว่าง"), (3, "Tiny Item"), (4, "?!"), (5, "東京タワー")]
    docs = [(1, "前言：人工智能正在改变我们的生活方式，结束"), (2, "前言人工智慧正在改变我们的生活方式结束"), (3, "xภาษาไทยไม่มีช่องว่างy"), (4, "a tiny, item b"),
            (5, "tiny little item"), (6, "昨日、東京タワーへ行った"), (7, "東京のタワー"), (8, "完全に別の文章です"), (9, "?!"), (10, "人工智能")]
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = frame(spark, [(*d, *[None] * 11) for d in docs])
    got = {(f["doc_id"], f["item_id"], f["distance"]) for f in decontaminate.find_items(rows, table).collect()}
    assert got == {(1, 1, 0), (2, 1, 1), (3, 2, 0), (4, 3, 0), (6, 5, 0)}
    assert {r["doc_id"] for r in decontaminate.without_items(rows, table).collect()} == {5, 7, 8, 9, 10}


def test_top_k_equals_all_scores(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(6).round(1).tolist(), i) for i in range(400)] + [(1000 + i, [0.5, 0.25], 0) for i in range(60)]
    rows += [(2001, None, 0), (2000, [1.0, float("nan")], 0), (2020, [float("inf")], 0), (2040, [None, 1.0], 0), (None, [1.0], 0), (2060, [], 0), (20, rows[20][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    used = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            used.setdefault(i, []).append(np.pad(np.floor(64 * np.array(v)), (0, 6 - len(v))).astype(int))
    want = []
    for q in used:
        if q % 20 == 0:
            scores = sorted((-int(used[q][0] @ v), i) for i, vs in used.items() if i != q for v in vs)[:20]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    for block in (16384, 50):
        monkeypatch.setattr(top_k, "VECTOR_BLOCK", block)
        got = top_k.top_k(table, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).collect()
        assert sorted(tuple(g) for g in got) == sorted(want)
    assert top_k.top_k(table.limit(0), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20).count() == 0


def test_top_k_of_an_id_on_a_third_of_the_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(20, [9.0 + x, 9.0, 9.0]) for x in rng.random(1000).round(2).tolist()]
    rows += [(21 + i % 1500, v) for i, v in enumerate(rng.random((2000, 3)).round(2).tolist())] + [(7, [8.0, 8.0, 8.0])] * 30
    whole = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v in rows]
    query = min((tuple(v) for i, v in whole if i == 20))
    want = sorted((-int(np.array(query) @ v), i) for i, v in whole if i != 20)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (20, 40):
        got = top_k.top_k(table, "vec_id", "embedding", F.col("vec_id") == 20, k).collect()
        assert sorted(tuple(g) for g in got) == [(20, r + 1, i, -s) for r, (s, i) in enumerate(want[:k])]


def test_bounds_leave_out_the_own_id():
    rng = np.random.default_rng(7)
    values, ids = rng.integers(-5, 6, (4000, 3)), np.arange(4000)
    values[:1500], ids[:1500] = 60, 9                      # the query's own rows are the best
    lists = np.argsort(values, axis=0, kind="stable")
    some = top_k.aggregate_block(np.array([[1, 2, 3]]), values, lists, 10, asks=np.array([9]), ids=ids)[0]
    score = np.where(ids == 9, -10**6, values @ np.array([1, 2, 3]))
    assert set(np.flatnonzero(score > np.sort(score)[-10])) <= set(some.tolist()) and not (ids[some] == 9).any() and len(some) >= 10


def test_bounds_close_before_the_lists_end():
    rng = np.random.default_rng(5)
    values = rng.integers(-5, 6, (4000, 3))
    values[:30] = 60                                       # clear winners
    lists = np.argsort(values, axis=0, kind="stable")
    some = top_k.aggregate_block(np.array([[1, 2, 3], [3, -1, 0]]), values, lists, 10, depths=(0.05, 1.0))
    for q, s in zip(([1, 2, 3], [3, -1, 0]), some):
        score = values @ np.array(q)
        assert set(np.flatnonzero(score >= np.sort(score)[-10])) <= set(s.tolist())
    assert len(some[0]) < 4000


def test_pipeline_stages(spark):
    import corpus_pipeline as c
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("block", F.lit(1))
    leak = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    made = [(90_000, "so it goes: " + leak, "en", "s", 0, 1), (90_001, None, "en", "s", 0, 1), (90_002, "123 456", None, None, None, 1),
            (None, rows[0]["text"], "en", "s", 0, 1), (90_003, rows[0]["text"], "en", "s", 0, 1)]
    docs = docs.unionByName(spark.createDataFrame(made, docs.schema))
    seen = {}
    for name, stage in c.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, SMALL).collect(), stage(spark, before, SMALL).schema)
        seen[name] = docs
        if name != "token_ids":
            assert docs.columns == before.columns
    kept = {n: {r["doc_id"] for r in d.collect()} for n, d in seen.items()}
    assert not {90_001, 90_002} & kept["language_id"] and len(kept["language_id"]) >= 0.95 * len(rows)
    assert 90_003 not in kept["near_duplicates"] and None in kept["near_duplicates"] and rows[0]["doc_id"] in kept["near_duplicates"]
    assert kept["repeated_passages"] == kept["near_duplicates"]
    assert 90_000 not in kept["decontamination"]
    texts = {r["doc_id"]: r["text"] for r in seen["decontamination"].collect()}
    import hashlib
    for r in seen["token_ids"].collect():
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() and len(r["ids"]) == 4 * r["n_tokens"]
    nothing = spark.createDataFrame([], SCHEMA)
    for _, stage in c.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0
