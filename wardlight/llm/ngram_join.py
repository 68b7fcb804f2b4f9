"""Operator 3: near duplicates by an n-gram Jaccard join with vertically partitioned sets.

A document's set is its distinct 5-word shingles. Two documents link when the Jaccard similarity of
their sets is at least the threshold. The steps, each of which loses no link:

1. Equal sets (by a 128-bit signature) are one class with a number of its own; the row of its
   smallest doc_id stands for it.
2. Sharded count-min sketches (window_counts) estimate shingle counts, never too low. A shingle of
   one document can't be shared, so a document that hasn't enough other shingles has no partner, and
   the global order is (estimated count, hash): rare shingles first.
   The counts are then taken again over the classes alone: of a near copy, the shingles that its
   edits made are its own, and r, the number of the others, bounds its overlap with any set.
3. Two linked sets share a shingle among their first n - ceil(threshold * n) + 1. Those shingles
   give candidate pairs. In a group that shares one, a lead, the document with the fewest shingles of
   its own, is paired with the others. With its links and overlaps known, the rest is paired as far as it
   lies in different components and its overlaps with the lead allow a link; near copies of the lead
   that only link through shingles it lacks are grouped by those. So a group of many near copies costs
   little more than one pair a copy.
4. Sets are cut into fragments at fixed places of the hash order. Per candidate pair and fragment the
   overlap is counted separately; the sum per pair decides.
5. Components of the links between classes; those that hold the same doc_id are one. A component is
   named by its smallest doc_id.

Words are runs of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. Cases: a text of fewer
than five words has its whole sequence as its one shingle; a null or empty text has the empty set
and links with nothing; a row with a null doc_id gets a null component; rows that repeat a doc_id
with the same text are one; with different texts, the doc_id has the links of all its rows, and they
all get its component; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import Hasher, mix64, release, slices, split_words, text_bytes
from wardlight.llm.components import components
from wardlight.llm.window_counts import Layout, estimated_orders, merged_orders, partial_sketches, text_blocks
from wardlight.session import checkpoint_root, scratch_path

WIDTH = 5
PERCENT = 80
FRAGMENTS = 4
_SEED = 21


@functools.lru_cache(maxsize=1)
def _hasher() -> Hasher:
    return Hasher(_SEED)


def _sets(table: pa.Table, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    buf, offs = text_bytes(table["text"])
    out, hasher = [], _hasher()
    for i, j in slices(offs):
        part, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        starts, ends, counts = split_words(part, o)
        words = hasher.words(part, starts, ends, True)
        full, at = hasher.windows(words, width), 0
        for n in counts.tolist():
            if n >= width:
                out.append(np.unique(full[at:at + n - width + 1]))
            elif n:
                out.append(mix64(hasher.windows(words[at:at + n], n) + np.uint64(n)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += n
    return out


def _need(n: int, percent: int) -> int:
    """Least overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def _ordered(tokens: np.ndarray, orders: np.ndarray, n: int, percent: int) -> tuple[bytes | None, int]:
    """The shingles estimated to be shared, rare ones first, and the length of their prefix; None if
    they are too few for any partner."""
    some, need = np.flatnonzero(orders), _need(n, percent)
    if not n or len(some) < need:
        return None, 0
    some = some[np.lexsort((tokens[some], orders[some]))]
    return tokens[some].tobytes(), len(some) - need + 1


def _described(blocks: DataFrame, marks: DataFrame, layout: Layout, width: int, percent: int) -> DataFrame:
    """Per row: doc_id, set size, signature, and the shared shingles of rows that may have a partner."""

    def run(table: pa.Table, got: pa.Table) -> pa.Table:
        release()
        sets = _sets(table, width)
        orders = estimated_orders(np.concatenate(sets) if sets else np.zeros(0, np.uint64), layout, got)
        sigs, shared, at = [], [], 0
        for s in sets:
            sig = np.array([np.sum(mix64(s ^ np.uint64(1))), np.sum(mix64(s + np.uint64(7)) ^ s)], np.uint64)
            sigs.append(sig.tobytes() if len(s) else None)
            shared.append(_ordered(s, orders[at:at + len(s)], len(s), percent)[0])
            at += len(s)
        return pa.table({"doc_id": table["doc_id"], "n": pa.array([len(s) for s in sets], pa.int64()),
                         "sig": pa.array(sigs, pa.binary()), "shared": pa.array(shared, pa.binary())})

    return (blocks.groupBy("block").cogroup(marks.groupBy("block"))
            .applyInArrow(run, "doc_id long, n long, sig binary, shared binary"))


def _recounted(sets: DataFrame, percent: int) -> DataFrame:
    """``sets`` (doc, n, shared; one per class) with counts over the classes that are left: without
    the sets that are now too small, and with k, the length of the prefix."""
    tokens = sets.agg(F.sum(F.octet_length("shared") / 8)).first()[0] or 0
    layout = Layout(int(tokens) * 6)
    blocks = sets.select("doc", "n", "shared", F.pmod(F.xxhash64("doc"), F.lit(layout.blocks)).cast("int").alias("block"))

    def every(table: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(table["shared"].to_pylist()), np.uint64)

    def run(table: pa.Table, got: pa.Table) -> pa.Table:
        release()
        orders, at, out = estimated_orders(every(table), layout, got), 0, []
        for doc, n, raw in zip(*(table[c].to_pylist() for c in ("doc", "n", "shared"))):
            t = np.frombuffer(raw, np.uint64)
            shared, k = _ordered(t, orders[at:at + len(t)], n, percent)
            at += len(t)
            if shared is not None:
                out.append((doc, n, k, shared))
        return pa.table({c: pa.array([o[i] for o in out], t) for i, (c, t) in enumerate(
            (("doc", pa.int64()), ("n", pa.int64()), ("k", pa.int32()), ("shared", pa.binary())))})

    marks = merged_orders(partial_sketches(blocks, layout, every))
    return (blocks.groupBy("block").cogroup(marks.groupBy("block"))
            .applyInArrow(run, "doc long, n long, k int, shared binary"))


def _prefixes(sets: DataFrame) -> DataFrame:
    """doc, n, r (the number of shared shingles), token: one row per prefix shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                doc, n, k, shared = (batch.slice(i, 512)[c].to_pylist() for c in ("doc", "n", "k", "shared"))
                yield pa.RecordBatch.from_pydict({
                    "doc": pa.array(np.repeat(doc, k), pa.int64()), "n": pa.array(np.repeat(n, k), pa.int64()),
                    "r": pa.array(np.repeat([len(s) // 8 for s in shared], k), pa.int64()),
                    "token": np.concatenate([np.frombuffer(s, np.int64, m) for s, m in zip(shared, k)])})

    return sets.select("doc", "n", "k", "shared").mapInArrow(run, "doc long, n long, r long, token long")


def _fragments(sets: DataFrame, fragments: int) -> DataFrame:
    """doc, n, fragment, part: the sorted shingles of each non-empty fragment of a set."""
    edges = np.array([(i << 64) // fragments for i in range(1, fragments)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                out: dict[str, list] = {"doc": [], "n": [], "fragment": [], "part": []}
                for doc, n, shared in zip(*(batch.slice(i, 512)[c].to_pylist() for c in ("doc", "n", "shared"))):
                    tokens = np.sort(np.frombuffer(shared, np.uint64))
                    for f, part in enumerate(np.split(tokens, np.searchsorted(tokens, edges))):
                        if len(part):
                            for c, v in zip(out, (doc, n, f, part.tobytes())):
                                out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("doc", pa.int64()), ("n", pa.int64()),
                                                                 ("fragment", pa.int32()), ("part", pa.binary())]))

    return sets.mapInArrow(run, "doc long, n long, fragment int, part binary")


def _overlaps(pairs: DataFrame) -> DataFrame:
    """a, b, na, nb and the overlap of two fragments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = []
            for x, y in zip(batch["part_a"].to_pylist(), batch["part_b"].to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both.append(int((p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum()))
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("a", "b", "na", "nb")] + [pa.array(both, pa.int64())],
                                             ["a", "b", "na", "nb", "both"])

    return pairs.select("a", "b", "na", "nb", "part_a", "part_b").mapInArrow(run, "a long, b long, na long, nb long, both long")


def overlaps_of(pairs: DataFrame, sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """a, b, na, nb, both of the pairs (a, b): partial overlaps per fragment, summed per pair."""
    cut = _fragments(sets, fragments)
    left = cut.select(F.col("doc").alias("a"), F.col("n").alias("na"), "fragment", F.col("part").alias("part_a"))
    right = cut.select(F.col("doc").alias("b"), F.col("n").alias("nb"), "fragment", F.col("part").alias("part_b"))
    partial = _overlaps(pairs.join(right, "b").join(left, ["a", "fragment"]))
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("both").alias("both"))


def _similar(overlaps: DataFrame, percent: int) -> DataFrame:
    return overlaps.where(F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent).select("a", "b")


def _can_link(na: Column, ra: Column, nb: Column, rb: Column, percent: int) -> Column:
    """Whether sets of na and nb shingles, of which ra and rb are shared with any set, can be similar:
    the sizes fit, and the overlap that is needed is not more than either can have."""
    return ((F.least(na, nb) * 100 >= F.greatest(na, nb) * percent)
            & (F.least(ra, rb) * (100 + percent) >= (na + nb) * percent))


def _one_per_member_set(rows: DataFrame) -> DataFrame:
    """Of the tokens that the very same documents share (near copies share long runs), one; of
    tokens that one document has, none."""
    groups = rows.groupBy("token").agg(F.count("*").alias("members"), F.sum(F.xxhash64("doc").cast("decimal(20,0)")).alias("s1"),
                                       F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("s2")).where("members > 1")
    return rows.join(groups.groupBy("members", "s1", "s2").agg(F.min("token").alias("token")).select("token"), "token")


def _shared_prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """doc, n, r, token of the prefix shingles that several documents have, without documents that
    can't link with the smallest set there."""
    rows = _prefixes(sets)
    least = rows.groupBy("token").agg(F.min("n").alias("least"), F.count("*").alias("members")).where("members > 1")
    other = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    rows = rows.join(least, "token").where(F.col("r") * (100 + percent) >= (F.col("n") + other) * percent).drop("least", "members")
    return _one_per_member_set(rows)


def _off_lead(pairs: DataFrame, sets: DataFrame, fragments: int = FRAGMENTS) -> DataFrame:
    """p, doc, token: for the pairs (p, doc), the shared shingles of doc that p doesn't have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, tokens = [], [np.zeros(0, np.uint64)]
            for x, y in zip(batch["part_p"].to_pylist(), batch["part"].to_pylist()):
                tokens.append(np.setdiff1d(np.frombuffer(y, np.uint64), np.frombuffer(x or b"", np.uint64), True))
                docs.append(len(tokens[-1]))
            at = np.repeat(np.arange(batch.num_rows), docs)
            yield pa.RecordBatch.from_arrays([batch["p"].take(pa.array(at)), batch["doc"].take(pa.array(at)),
                                              pa.array(np.concatenate(tokens).view(np.int64))], ["p", "doc", "token"])

    cut = _fragments(sets, fragments).drop("n")
    left = cut.select(F.col("doc").alias("p"), "fragment", F.col("part").alias("part_p"))
    return (pairs.join(cut, "doc").join(left, ["p", "fragment"], "left").select("p", "doc", "part_p", "part")
            .mapInArrow(run, "p long, doc long, token long"))


def _seen_from_lead(live: DataFrame, overlaps: DataFrame, comp: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows (doc, n, r, i, far, token, off) of ``live`` that can still link across components, given
    every document's overlap i with its group's lead p.

    Sets x and y have at most min(i_x, i_y) shingles of p in common, and at most min(r_x - i_x,
    r_y - i_y) others. A document of the lead's component can only link with one outside of it, so it
    is held against the greatest values outside; the others against the greatest of all. Where the
    shingles of p are not enough for a link, the two must share one that p lacks: near copies that
    lie too far from p are then grouped by those (``off``), which few documents have. A document with
    more of them than twice its prefix is no near copy of p: it is ``far`` and stays in its group.
    """
    rows = live.where(F.col("doc") != F.col("lead.doc")).select("doc", "n", "r", "token", F.col("lead.doc").alias("p"))
    rows = rows.join(overlaps.select(F.col("a").alias("p"), F.col("b").alias("doc"), F.col("both").alias("i")), ["p", "doc"])
    rows = rows.join(comp, "doc", "left").join(comp.select(F.col("doc").alias("p"), F.col("comp").alias("pc")), "p", "left")
    far = F.col("r") - F.col("i") > 2 * (F.col("r") - F.ceil(F.col("n") * percent / 100) + 1)
    rows = rows.withColumn("out", F.coalesce("comp", "doc") != F.coalesce("pc", "p")).withColumn("far", far) \
        .withColumn("off_p", F.col("r") - F.col("i"))
    most = rows.groupBy("token").agg(
        F.min("n").alias("least"), *[f(c).alias(f"{c}_all") for c, f in (("i", F.max), ("off_p", F.max), ("far", F.bool_or))],
        *[f(F.when(F.col("out"), F.col(c))).alias(f"{c}_out") for c, f in (("i", F.max), ("off_p", F.max), ("far", F.bool_or))])
    rows = rows.join(most.where("i_out is not null"), "token")

    def partner(c: str) -> Column:
        return F.when(F.col("out"), F.col(c + "_all")).otherwise(F.col(c + "_out"))

    enough = (F.col("n") + F.greatest("least", F.ceil(F.col("n") * percent / 100))) * percent
    on_p = F.least("i", partner("i"))
    rows = rows.where((on_p + F.least("off_p", partner("off_p"))) * (100 + percent) >= enough)
    rows = rows.withColumn("stays", F.col("far") | partner("far") | (on_p * (100 + percent) >= enough)).checkpoint()
    near = rows.where("not far").select("p", "doc", "n", "r", "i").distinct()
    off = _off_lead(near.select("p", "doc"), sets).join(near, ["p", "doc"]) \
        .select("doc", "n", "r", "i", F.lit(False).alias("far"), F.xxhash64("p", "token").alias("token"), F.lit(True).alias("off"))
    stay = rows.where("stays").select("doc", "n", "r", "i", "far", "token", F.lit(False).alias("off"))
    return _one_per_member_set(stay).unionByName(_one_per_member_set(off))


def _left_pairs(rows: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """(a, b), once each, of the documents that share a token of ``rows``, lie in different components
    and whose own bounds allow a link. Most of a group lies in one component; only what lies outside of
    it is held against the others."""
    named = rows.join(comp, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    parts = named.groupBy("token", "comp").agg(F.count("*").alias("c"))
    main = parts.groupBy("token").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).where("comps > 1")
    live = named.join(main.drop("comps"), "token")

    def side(end: str) -> list[Column]:
        return [F.col(c).alias(c + end) for c in ("doc", "n", "r", "i", "far", "comp")]

    one = live.where("comp != main").select("token", "off", "main", *side("a"))
    two = live.select("token", *side("b"))
    na, ra, ia, nb, rb, ib = (F.col(c) for c in ("na", "ra", "ia", "nb", "rb", "ib"))
    reach = F.least(ia, ib) + F.when(F.col("off") | F.col("fara") | F.col("farb"), F.least(ra - ia, rb - ib)).otherwise(0)
    can = ((F.col("compa") != F.col("compb")) & ((F.col("compb") == F.col("main")) | (F.col("doca") < F.col("docb")))
           & _can_link(na, ra, nb, rb, percent) & (reach * (100 + percent) >= (na + nb) * percent))
    pairs = one.join(two, (one["token"] == two["token"]) & can)
    return pairs.select(F.least("doca", "docb").alias("a"), F.greatest("doca", "docb").alias("b")).distinct()


def similar_links(sets: DataFrame, percent: int) -> DataFrame:
    """Enough links between ``sets`` (doc, n, k, shared) to connect every similar pair.

    First each token's group is paired with its lead, the document with the fewest shingles of its own:
    of near copies that is the one they were made from. What the leads' overlaps leave possible across
    components is then paired by each two documents' own bounds.
    """
    spark = sets.sparkSession
    checkpoint_root(spark)
    path = scratch_path(spark, "prefixes")
    _shared_prefixes(sets, percent).write.parquet(path)
    rows = spark.read.parquet(path)
    leads = rows.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("r")).alias("own"), "doc")).alias("lead")).checkpoint()
    live = rows.join(leads, "token")
    first = live.where(F.col("doc") != F.col("lead.doc")).select(F.col("lead.doc").alias("a"), F.col("doc").alias("b")).distinct()
    overlaps = overlaps_of(first, sets).checkpoint()
    links = _similar(overlaps, percent)
    comp = components(links).select(F.col("node").alias("doc"), F.col("component").alias("comp"))
    rest = _seen_from_lead(live, overlaps, comp, sets, percent).checkpoint()
    pairs = _left_pairs(rest, comp, percent)
    for one, two in (("a", "b"), ("b", "a")):
        pairs = pairs.join(overlaps.select(F.col(one).alias("a"), F.col(two).alias("b")), ["a", "b"], "left_anti")
    return links.unionByName(_similar(overlaps_of(pairs.checkpoint(), sets), percent))


def _components_of_ids(members: DataFrame) -> DataFrame:
    """doc_id, component_id (the smallest doc_id it reaches) from ``members`` (doc_id, root): the
    components of the classes that hold a doc_id are one."""
    members = members.distinct().checkpoint()
    ids = members.groupBy("doc_id").agg(F.min("root").alias("node"), F.max("root").alias("most"))
    several = ids.where("node != most").select("doc_id", "node")
    same = components(members.join(several, "doc_id").select(F.col("node").alias("a"), F.col("root").alias("b")))
    ids = ids.join(same, "node", "left").select("doc_id", F.coalesce("component", "node").alias("top"))
    return ids.join(ids.groupBy("top").agg(F.min("doc_id").alias("component_id")), "top").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    blocks, layout = text_blocks(docs, [])
    marks = merged_orders(partial_sketches(
        blocks, layout, lambda t: np.concatenate([np.zeros(0, np.uint64), *_sets(t, width)])))
    path = scratch_path(spark, "shingles")
    _described(blocks, marks, layout, width, percent).write.parquet(path)
    rows = spark.read.parquet(path)
    path, counted, numbered = (scratch_path(spark, name) for name in ("sets", "counted", "classes"))
    (rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"))
         .withColumn("node", F.monotonically_increasing_id()).write.parquet(numbered))    # written once, so the numbers stay
    classes = spark.read.parquet(numbered)
    (rows.where("shared is not null").join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "sig"])
         .select(F.col("node").alias("doc"), "n", "shared").dropDuplicates(["doc"]).write.parquet(path))
    _recounted(spark.read.parquet(path), percent).write.parquet(counted)
    comp = components(similar_links(spark.read.parquet(counted), percent))
    members = (rows.where("sig is not null and doc_id is not null").select("doc_id", "sig").join(classes, "sig").join(comp, "node", "left")
               .select("doc_id", F.coalesce("component", "node").alias("root")))
    return (rows.select("doc_id", F.col("n").alias("n_shingles")).join(_components_of_ids(members), "doc_id", "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))
