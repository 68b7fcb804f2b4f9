"""Operator 2: sharding by a k-d tree over document metadata.

Every node that stands for k > 1 shards is cut at the weighted quantile floor(k/2)/k of its bytes,
along the metadata dimension whose values spread widest in it, until a node is one shard of about
the target bytes. All nodes of a level are cut together, and each quantile is found by counting:
weights per bin of the key range, then bins of the bin that holds the quantile, down to one key. The
tables that meet on the driver have one row per node.

A key is 24 bits of the scaled dimension and 24 bits of a hash of the row, so a cut falls inside a
value that a third of all rows share as well as between values.

Cases: a null text has size 8 and the crc of an empty text; null metadata sort first; a table with
fewer rows than shards leaves some shards empty; repeated rows are rows of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlight.session import checkpoint_root

_VALUE_BITS, _TIE_BITS, _BIN_BITS = 24, 24, 12
SLOT_ROWS = 50_000         # rows numbered together


def _scaled(name: str, kind: str) -> Column:
    """A dimension as a number: text by hash (its values only need to be apart), null as null."""
    c = F.col(name)
    return (F.pmod(F.xxhash64(c), F.lit(1 << 30)) if kind == "string" else c).cast("double")


def shard_metadata(docs: DataFrame, dimensions: list[str]) -> DataFrame:
    """doc_id, size, text_crc32 and one 48-bit key k<i> per dimension, written down once.

    ``dimensions`` are columns of ``docs``, or ``size`` for the logarithm of the size.
    """
    kinds = dict(docs.dtypes)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[(F.log2(F.octet_length(text) + 8) if d == "size" else _scaled(d, kinds[d])).alias(f"d{i}")
          for i, d in enumerate(dimensions)])
    checkpoint_root(docs.sparkSession)
    # ties are broken by what a row holds and, among equal rows, by a number: not by where it is read
    held = base.columns
    base = base.groupBy(*held).agg(F.count("*").alias("copies")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    base = base.withColumn("tie", F.pmod(F.xxhash64(*held, "copy"), F.lit(1 << _TIE_BITS))).drop("copies", "copy").checkpoint()
    ends = base.agg(*[f(f"d{i}").alias(f"{n}{i}") for i in range(len(dimensions))
                      for n, f in (("lo", F.min), ("hi", F.max))]).first()

    def key(i: int) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None or hi <= lo:
            return F.col("tie")
        at = F.floor((F.col(f"d{i}") - lo) / (hi - lo) * ((1 << _VALUE_BITS) - 1))
        return F.shiftleft(F.coalesce(at, F.lit(0)).cast("long"), _TIE_BITS) + F.col("tie")

    return base.select("doc_id", "size", "text_crc32", "tie",
                       *[key(i).alias(f"k{i}") for i in range(len(dimensions))])


def _quantiles(rows: DataFrame, nodes: dict[int, dict]) -> dict[int, int]:
    """Per node the greatest key that goes left; ``nodes``: id -> dim, lo, hi, target."""
    spark, done = rows.sparkSession, {}
    open_ = {n: dict(x, below=0) for n, x in nodes.items()}
    while open_:
        table = []
        for n, x in open_.items():
            bits = max(0, (x["hi"] - x["lo"]).bit_length() - _BIN_BITS)
            table.append((n, x["dim"], x["lo"], x["hi"], bits, float(x["target"] - x["below"])))
        spans = F.broadcast(spark.createDataFrame(table, "node int, dim int, lo long, hi long, bits int, want double"))
        inside = (rows.join(spans, "node").withColumn("key", _pick(rows, F.col("dim")))
                  .where(F.col("key").between(F.col("lo"), F.col("hi"))))
        bins = inside.groupBy("node", "want", F.call_function("shiftright", F.col("key") - F.col("lo"), F.col("bits")).alias("bin")) \
            .agg(F.sum("size").alias("w"))
        run = bins.withColumn("upto", F.sum("w").over(Window.partitionBy("node").orderBy("bin")))
        got = {r["node"]: r["at"] for r in run.groupBy("node").agg(
            F.coalesce(F.min(F.when(F.col("upto") >= F.col("want"), F.struct("bin", "upto", "w"))),
                       F.max(F.struct("bin", "upto", "w"))).alias("at")).collect()}
        bits_of = {t[0]: t[4] for t in table}
        for n, x in list(open_.items()):
            at, bits = got[n], bits_of[n]
            lo = x["lo"] + (at["bin"] << bits)
            if bits == 0:
                want, before = x["target"] - x["below"], at["upto"] - at["w"]
                done[n] = lo if at["upto"] - want <= want - before else lo - 1
                del open_[n]
            else:
                x["below"] += at["upto"] - at["w"]
                x["hi"] = min(x["hi"], lo + (1 << bits) - 1)
                x["lo"] = lo
    return done


def _pick(rows: DataFrame, dim: Column) -> Column:
    keys = [c for c in rows.columns if c[0] == "k" and c[1:].isdigit()]
    out = F.col(keys[0])
    for i, k in enumerate(keys[1:], 1):
        out = F.when(dim == i, F.col(k)).otherwise(out)
    return out


def kd_assign(meta: DataFrame, shards: int) -> DataFrame:
    """``meta`` with its leaf as ``shard`` (0 to shards - 1, in the tree's order)."""
    spark = meta.sparkSession
    keys = [c for c in meta.columns if c[0] == "k" and c[1:].isdigit()]
    rows = meta.withColumn("node", F.lit(0))
    span = {0: (0, shards)}                     # node -> first shard, shards
    while any(k > 1 for _, k in span.values()):
        stats = rows.groupBy("node").agg(F.sum("size").alias("w"), *[
            f(k).alias(f"{n}{i}") for i, k in enumerate(keys) for n, f in (("lo", F.min), ("hi", F.max))]).collect()
        todo = {}
        for s in stats:
            k = span[s["node"]][1]
            if k > 1:
                dim = max(range(len(keys)), key=lambda i: (s[f"hi{i}"] >> _TIE_BITS) - (s[f"lo{i}"] >> _TIE_BITS))
                todo[s["node"]] = {"dim": dim, "lo": s[f"lo{dim}"], "hi": s[f"hi{dim}"], "target": s["w"] * (k // 2) / k}
        if not todo:
            break
        cuts = _quantiles(rows, todo)
        fresh, table = {}, []
        for n, (first, k) in span.items():
            if n in cuts:
                left, right = len(fresh), len(fresh) + 1
                fresh[left], fresh[right] = (first, k // 2), (first + k // 2, k - k // 2)
                table.append((n, todo[n]["dim"], cuts[n], left, right))
            elif k == 1:
                table.append((n, 0, -1, len(fresh), len(fresh)))
                fresh[len(fresh)] = (first, k)
        moves = F.broadcast(spark.createDataFrame(table, "node int, dim int, cut long, l int, r int"))
        rows = rows.join(moves, "node").withColumn(
            "node", F.when(_pick(rows, F.col("dim")) <= F.col("cut"), F.col("l")).otherwise(F.col("r"))) \
            .drop("dim", "cut", "l", "r").checkpoint()
        span = fresh
    leaves = F.broadcast(spark.createDataFrame([(n, f) for n, (f, _) in span.items()], "node int, shard int"))
    return rows.join(leaves, "node").drop("node", *keys)


def with_slots(rows: DataFrame) -> DataFrame:
    """A gapless number from 0 for each row of a shard.

    Rows are numbered inside (shard, hash bucket) pairs of about SLOT_ROWS, to which the counts of
    the buckets before are added, so no task holds a shard.
    """
    n = rows.groupBy("shard").count().agg(F.max("count")).first()[0] or 0
    buckets = max(1, -(-n // SLOT_ROWS))
    rows = rows.withColumn("bucket", F.pmod(F.col("tie"), F.lit(buckets)).cast("int"))
    before = rows.groupBy("shard", "bucket").count().select(
        "shard", "bucket",
        (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("before"))
    inner = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("tie", "doc_id", "text_crc32"))
    return (rows.withColumn("rn", inner).join(before, ["shard", "bucket"])
            .withColumn("slot", F.col("before") + F.col("rn") - 1).drop("before", "rn", "bucket", "tie"))


def kd_shards(docs: DataFrame, dimensions: list[str], shards: int | None = None,
              target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot; give the shard count or the target bytes of a leaf."""
    meta = shard_metadata(docs, dimensions)
    if shards is None:
        total = meta.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    return with_slots(kd_assign(meta, shards))
