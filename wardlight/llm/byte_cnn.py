"""Operator 7: document quality by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of WIDTH bytes slide over the whole document by STRIDE. Chunks are
pairs of neighbouring blocks of BLOCK bytes, so each overlaps the next by half. A filter's greatest
response in a chunk is one feature of it; a hidden layer reads them, its units are averaged and
maximised over the chunks, and one logistic unit makes the probability.

It is trained by Adam on a bounded sample (SAMPLE rows per label with the smallest hashes of
id and text; of a longer text, a window of SAMPLE_BYTES chosen by hash) on the driver; the model is 20 kB.
Scoring is one narrow pass over the whole texts.

Cases: a null or empty text is a document of zero bytes and gets a score like any other; without
labelled rows of both labels, every score is the share of label 1 (0.5 without any); repeated rows
are scored alike; labels of repeated ids all count; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import hash_sample, release, sample_hash, sampled_texts, slices, text_bytes, text_window, whole_characters

EMBED, WIDTH, STRIDE, BLOCK, FILTERS, HIDDEN = 8, 8, 2, 256, 32, 16
SAMPLE, SAMPLE_BYTES = 1200, 16_384
STEPS, BATCH, RATE = 900, 32, 3e-3
_SPAN = 1 << 16            # filter places computed at once


def _padded(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows set apart by at least WIDTH zero bytes and filled up to whole blocks; blocks per row."""
    length = np.diff(offs)
    blocks = -(-(length + WIDTH) // BLOCK)
    out = np.zeros(int(blocks.sum()) * BLOCK + WIDTH, np.uint8)
    head = (np.cumsum(blocks) - blocks) * BLOCK
    out[np.arange(len(buf)) + np.repeat(head - offs[:-1], length)] = buf
    return out, blocks


class ByteCnn:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)

        def start(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) * (2 / shape[0]) ** 0.5).astype(np.float32)

        self.p = {"embed": rng.standard_normal((256, EMBED)).astype(np.float32) * np.float32(0.5),
                  "filter": start(WIDTH * EMBED, FILTERS), "fbias": np.zeros(FILTERS, np.float32),
                  "hidden": start(FILTERS, HIDDEN), "hbias": np.zeros(HIDDEN, np.float32),
                  "out": start(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32)}
        self.constant: float | None = None

    def _responses(self, data: np.ndarray, where: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Greatest filter responses of each block, and the places of them."""
        per = BLOCK // STRIDE
        n = (len(data) - WIDTH) // STRIDE
        tops, places = [], []
        for at in range(0, n, _SPAN):
            m = min(_SPAN, n - at)
            emb = self.p["embed"][data[at * STRIDE:(at + m) * STRIDE + WIDTH]]
            view = np.lib.stride_tricks.as_strided(
                emb, (m, WIDTH * EMBED), (STRIDE * EMBED * emb.itemsize, emb.itemsize), writeable=False)
            conv = (np.ascontiguousarray(view) @ self.p["filter"]).reshape(m // per, per, FILTERS)
            if where:
                best = conv.argmax(1)
                tops.append(np.take_along_axis(conv, best[:, None], 1)[:, 0])
                places.append((best + (at + np.arange(m // per) * per)[:, None]) * STRIDE)
            else:
                tops.append(conv.max(1))
        return np.concatenate(tops), np.concatenate(places) if where else None

    @staticmethod
    def _chunks(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and second block of every chunk, and chunks per row."""
        count = np.maximum(blocks - 1, 1)
        first = np.arange(int(count.sum())) + np.repeat(np.cumsum(blocks) - blocks - (np.cumsum(count) - count), count)
        last = np.repeat(np.cumsum(blocks) - 1, count)
        return first, np.minimum(first + 1, last), count

    def _forward(self, buf: np.ndarray, offs: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        data, blocks = _padded(buf, offs)
        top, place = self._responses(data, keep)
        one, two, count = self._chunks(blocks)
        pooled = np.maximum(top[one], top[two]) + self.p["fbias"]
        pool = np.maximum(pooled, 0)
        hid = np.maximum(pool @ self.p["hidden"] + self.p["hbias"], 0)
        head = np.cumsum(count) - count
        mean = np.add.reduceat(hid, head) / count[:, None].astype(np.float32)
        most = np.maximum.reduceat(hid, head)
        both = np.concatenate([mean, most], 1)
        logit = both @ self.p["out"] + self.p["bias"]
        return logit, dict(data=data, top=top, place=place, one=one, two=two, count=count, pool=pool, hid=hid, most=most, both=both) if keep else {}

    def _gradients(self, buf: np.ndarray, offs: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        logit, s = self._forward(buf, offs, True)
        d = ((1 / (1 + np.exp(-logit)) - labels) / len(labels)).astype(np.float32)
        g = {"out": s["both"].T @ d, "bias": np.array([d.sum()], np.float32)}
        row = np.repeat(np.arange(len(labels)), s["count"])
        dboth = d[:, None] * self.p["out"]
        dhid = (dboth[:, :HIDDEN] / s["count"][:, None])[row] + dboth[:, HIDDEN:][row] * (s["hid"] == s["most"][row])
        dhid *= s["hid"] > 0
        g["hidden"], g["hbias"] = s["pool"].T @ dhid, dhid.sum(0)
        dpool = dhid @ self.p["hidden"].T * (s["pool"] > 0)
        g["fbias"] = dpool.sum(0)
        # Only the place of the greatest response of a chunk carries a filter's gradient.
        second = s["top"][s["two"]] > s["top"][s["one"]]
        place = np.where(second, s["place"][s["two"]], s["place"][s["one"]])
        chunk, f = np.nonzero(dpool)
        at, value = place[chunk, f], dpool[chunk, f]
        seen = s["data"][at[:, None] + np.arange(WIDTH)]
        x = self.p["embed"][seen].reshape(len(at), -1)
        g["filter"] = np.zeros_like(self.p["filter"])
        g["embed"] = np.zeros_like(self.p["embed"])
        for k in range(FILTERS):
            mine = f == k
            g["filter"][:, k] = value[mine] @ x[mine]
        back = (value[:, None] * self.p["filter"].T[f]).reshape(-1, EMBED)
        for e in range(EMBED):
            g["embed"][:, e] = np.bincount(seen.ravel(), back[:, e], 256)
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int = STEPS, seed: int = 3) -> ByteCnn:
        """Adam on batches of which half have label 1, so few labels weigh like many."""
        if len(set(labels.tolist())) < 2:
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for step in range(1, steps + 1):
            some = np.concatenate([rng.choice(np.flatnonzero(labels == y), BATCH // 2) for y in (0, 1)])
            raw = [texts[i] for i in some]
            offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
            rate = RATE * min(1.0, step / 20) * (1 - 0.9 * step / steps)
            for k, g in self._gradients(np.frombuffer(b"".join(raw), np.uint8), offs, labels[some]).items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(offs) - 1, self.constant)
        return 1 / (1 + np.exp(-self._forward(buf, offs)[0].astype(np.float64)))


def held_out(id_column: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; null ids are held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int = SAMPLE,
                    longest: int = SAMPLE_BYTES) -> tuple[list[bytes], np.ndarray]:
    """``per_label`` training rows of each label, all if there are fewer: those with the smallest hashes of
    id and text. Texts are only exchanged once they are chosen."""
    marks = labels.select(F.col("doc_id").alias("key"), F.col(label).alias("label")).where("label in (0, 1)")
    own = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).withColumn("hash", sample_hash(F.col("doc_id"), F.col("text")))
    chosen = hash_sample(own.select(F.col("doc_id").alias("key"), "hash").join(marks, "key"), per_label)
    rows = sampled_texts(own.select("hash", text_window(F.col("text"), F.col("doc_id"), longest).alias("text")), chosen).collect()
    return [whole_characters(r["text"]) for r in rows], np.array([r["label"] for r in rows], np.float32)


def score_documents(docs: DataFrame, model: ByteCnn) -> DataFrame:
    """doc_id and score of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            buf, offs = text_bytes(batch["text"])
            found = [model.scores(buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]) for i, j in slices(offs)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate([np.zeros(0), *found]), pa.float64())],
                                             ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = ByteCnn().fit(*labelled_sample(docs, labels, label))
    return score_documents(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))
