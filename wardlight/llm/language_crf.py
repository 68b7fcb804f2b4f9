"""Operator 8: language of every word by a linear-chain conditional random field.

Words are runs of ASCII letters and non-ASCII bytes, A-Z lower-cased. A word's features are its byte
2-grams and 3-grams, its first and last two and three bytes, and itself (the lexicon); each is hashed
to a weight per language. Transitions between neighbouring words are learned with them, on sequences
that switch between training documents of different languages. Forward-backward gives each word's
distribution; a document's language is the one with the greatest sum over its words, and its score
is that sum over the number of words.

Long texts are not read word by word: the words of a chunk are one transition matrix (a product), the
chunks of a document are chained by these, and all chunks of a batch then go forward and backward at
once. That is forward-backward of the whole text, for texts of any length.

The model is fitted on the driver on a bounded sample: per language SAMPLE rows with the smallest
hashes of id and text; of a longer text, a window of SAMPLE_BYTES chosen by hash. It is 2 MB for four languages.

Cases: a null text or one without a letter is ``und`` with score 0; a text whose letters are all
outside the words' bytes can't occur (other scripts are non-ASCII bytes); rows without a language
are not learned from; a null id is held out; without training rows all is ``und``; repeated rows
are labelled alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.byte_cnn import held_out
from wardlight.llm.common import hash_sample, mix64, release, sample_hash, sampled_texts, slices, split_words, text_bytes, text_window, whole_characters

BUCKETS = 1 << 17
SAMPLE, SAMPLE_BYTES = 400, 16_384
FIT_BYTES = 1 << 18        # text whose features are made at once while fitting
CHUNK = 64                 # words of a chunk
SEQUENCE, SPAN = 128, 24   # words of a training sequence, mean words between switches
EPOCHS, BATCH, RATE = 3, 128, 0.3
UNKNOWN = "und"

_APART = np.ones(256, bool)
_APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    return (mix64(code ^ np.uint64(kind << 56)) >> np.uint64(40)).astype(np.int32) & (BUCKETS - 1)


def word_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature buckets of all bytes (2-gram, 3-gram that end there; a word's first byte stands for
    itself), the head of each word among them, and five features of each word."""
    length = ends - starts
    head = np.cumsum(length) - length
    at = np.arange(int(length.sum())) + np.repeat(starts - head, length)
    c = _LOWER[buf[at]]
    back = np.arange(len(c)) - np.repeat(head, length)
    one = np.zeros(len(c), np.uint64)
    one[1:] = c[:-1]
    one[back < 1] = 1
    two = np.zeros(len(c), np.uint64)
    two[2:] = c[:-2]
    two[back < 2] = 1
    pair = c | one << np.uint64(8)
    triple = pair | two << np.uint64(16)
    grams = np.stack([_bucket(pair, 1), _bucket(triple, 2)], 1)
    tail = head + length - 1
    power = np.multiply.accumulate(np.full(int(length.max(initial=1)), 0x9E3779B97F4A7C15, np.uint64))
    whole = np.add.reduceat((c + np.uint64(7)) * power[back], head) if len(head) else np.zeros(0, np.uint64)
    second, third = np.minimum(head + 1, tail), np.minimum(head + 2, tail)
    words = np.stack([_bucket(pair[second], 3), _bucket(triple[third], 4), _bucket(pair[tail], 5),
                      _bucket(triple[tail], 6), _bucket(whole, 7)], 1)
    return grams, head, words


class LanguageCrf:
    def __init__(self, languages: list[str]):
        self.languages = languages
        n = len(languages)
        self.weight = np.zeros((BUCKETS, n), np.float32)
        self.transition = np.zeros((n, n))
        self.start = np.zeros(n)

    def emissions(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-potential of every word and language."""
        if not len(starts):
            return np.zeros((0, len(self.languages)))
        grams, head, words = word_features(buf, starts, ends)
        of_bytes = self.weight[grams[:, 0]]
        of_bytes += self.weight[grams[:, 1]]
        out = np.add.reduceat(of_bytes, head, axis=0)
        for k in range(words.shape[1]):
            out += self.weight[words[:, k]]
        return out.astype(np.float64)

    def posteriors(self, emission: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Distribution of each word, given all words of its row: forward-backward over chunks."""
        n = emission.shape[1]
        step = np.exp(self.transition)
        e = np.exp(emission - emission.max(1, keepdims=True, initial=-np.inf))
        per = -(-counts // CHUNK)
        chunks = int(per.sum())
        if not chunks:
            return e
        order = np.arange(chunks) - np.repeat(np.cumsum(per) - per, per)         # place within the row
        first = np.repeat(np.cumsum(counts) - counts, per) + order * CHUNK
        size = np.minimum(np.repeat(counts, per) - order * CHUNK, CHUNK)
        place = np.minimum(first[:, None] + np.arange(CHUNK), len(e) - 1)
        inside = np.arange(CHUNK) < size[:, None]
        pot = np.where(inside[:, :, None], e[place], 1.0)                          # chunk, word, language
        # What a chunk does to a message: the product of its (transition, potential) steps.
        whole = np.broadcast_to(np.eye(n), (chunks, n, n)).copy()
        for t in range(CHUNK):
            moved = whole @ step * pot[:, t, None, :]
            moved /= moved.max((1, 2), keepdims=True)
            whole = np.where(inside[:, t, None, None], moved, whole)
        # Messages at the chunks' borders, one chunk of every row at a time. A row's first word has
        # the start weights in place of a transition: the message before it is solved for that.
        into, back = np.ones((chunks, n)), np.ones((chunks, n))
        last = np.repeat(per, per) - 1
        by_order = np.argsort(order, kind="stable")
        edges = np.searchsorted(order[by_order], np.arange(int(per.max()) + 1))
        begin = np.linalg.lstsq(step.T, np.exp(self.start), rcond=None)[0]
        into[order == 0] = begin
        for k in range(1, int(per.max())):
            here = by_order[edges[k]:edges[k + 1]]
            m = np.einsum("ci,cij->cj", into[here - 1], whole[here - 1])
            into[here] = m / np.abs(m).max(1, keepdims=True)
        for k in range(int(per.max()) - 2, -1, -1):
            here = by_order[edges[k]:edges[k + 1]]
            here = here[last[here] > k]
            m = np.einsum("cij,cj->ci", whole[here + 1], back[here + 1])
            back[here] = m / m.max(1, keepdims=True)
        forward = np.empty_like(pot)
        f = into
        for t in range(CHUNK):
            moved = f @ step * pot[:, t]
            moved /= moved.max(1, keepdims=True)
            f = np.where(inside[:, t, None], moved, f)
            forward[:, t] = f
        b = back
        for t in range(CHUNK - 1, -1, -1):
            forward[:, t] *= b
            moved = (pot[:, t] * b) @ step.T
            moved /= moved.max(1, keepdims=True)
            b = np.where(inside[:, t, None], moved, b)
        out = forward[inside]
        return out / out.sum(1, keepdims=True)

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 5) -> LanguageCrf:
        n = len(self.languages)
        if n < 2 or not texts:
            return self
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        buf = np.frombuffer(b"".join(texts), np.uint8)
        found, bytes_so_far = [], 0
        for i, j in slices(offs, FIT_BYTES):              # what features are made of takes 100 times their text
            part = buf[offs[i]:offs[j]]
            starts, ends, counts = split_words(part, offs[i:j + 1] - offs[i], _APART)
            if len(starts):
                grams, head, words = word_features(part, starts, ends)
                found.append((grams.astype(np.int32), head + bytes_so_far, words.astype(np.int32), counts))
                bytes_so_far += len(grams)
            else:
                found.append((np.zeros((0, 2), np.int32), np.zeros(0, np.int64), np.zeros((0, 5), np.int32), counts))
        grams, head, words, counts = (np.concatenate([f[k] for f in found]) for k in range(4))
        del found
        if not len(head):
            return self
        size = np.diff(np.append(head, len(grams)))
        word_label = np.repeat(labels, counts)
        rng, seen = np.random.default_rng(seed), np.full(self.weight.shape, 1e-3)
        seen_step, seen_start = np.full((n, n), 1e-3), np.full(n, 1e-3)
        for _ in range(EPOCHS):
            order = self._switching(counts, rng)
            whole = len(order) // SEQUENCE * SEQUENCE
            if not whole:
                order, length = order, len(order)
            else:
                order, length = order[:whole], SEQUENCE
            for batch in np.array_split(order.reshape(-1, length), max(1, len(order) // length // BATCH)):
                ids = batch.ravel()
                n_bytes = size[ids]
                at = np.arange(int(n_bytes.sum())) + np.repeat(head[ids] - (np.cumsum(n_bytes) - n_bytes), n_bytes)
                bucket = np.concatenate([grams[at].T.ravel(), words[ids].T.ravel()])
                local = np.repeat(np.arange(len(ids)), n_bytes)
                owner = np.concatenate([local, local, np.tile(np.arange(len(ids)), words.shape[1])])
                emission = np.stack([np.bincount(owner, self.weight[bucket, y], len(ids)) for y in range(n)], 1)
                gold = word_label[ids].reshape(batch.shape)
                d, d_step, d_start = self._gradient(emission.reshape(*batch.shape, n), gold)
                d = d.reshape(-1, n)[owner]
                g = np.stack([np.bincount(bucket, d[:, y], BUCKETS) for y in range(n)], 1) / len(batch)
                for param, grad, past in ((self.weight, g, seen), (self.transition, d_step / len(batch), seen_step),
                                          (self.start, d_start / len(batch), seen_start)):
                    past += grad * grad
                    param += (RATE * grad / np.sqrt(past)).astype(param.dtype)
        return self

    @staticmethod
    def _switching(counts: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Word indices of a text that switches between the documents every SPAN words or so."""
        spans, at = [], np.cumsum(counts) - counts
        for first, n in zip(at.tolist(), counts.tolist()):
            while n > 0:
                m = min(n, int(rng.geometric(1 / SPAN)))
                spans.append((first, m))
                first, n = first + m, n - m
        return np.concatenate([np.zeros(0, np.int64), *(np.arange(a, a + m) for a, m in (spans[i] for i in rng.permutation(len(spans))))])

    def _gradient(self, emission: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Observed minus expected counts of labels, transitions and first labels."""
        rows, length, n = emission.shape
        step, e = np.exp(self.transition), np.exp(emission - emission.max(2, keepdims=True))
        f, b = np.empty_like(e), np.empty_like(e)
        f[:, 0] = e[:, 0] * np.exp(self.start)
        f[:, 0] /= f[:, 0].sum(1, keepdims=True)
        for t in range(1, length):
            f[:, t] = f[:, t - 1] @ step * e[:, t]
            f[:, t] /= f[:, t].sum(1, keepdims=True)
        b[:, -1] = 1
        for t in range(length - 1, 0, -1):
            b[:, t - 1] = (e[:, t] * b[:, t]) @ step.T
            b[:, t - 1] /= b[:, t - 1].sum(1, keepdims=True)
        post = f * b
        post /= post.sum(2, keepdims=True)
        right = np.eye(n)[gold]
        pair = f[:, :-1, :, None] * step * (e[:, 1:] * b[:, 1:])[:, :, None, :]
        pair /= pair.sum((2, 3), keepdims=True)
        d_step = np.einsum("rti,rtj->ij", right[:, :-1], right[:, 1:]) - pair.sum((0, 1))
        return right - post, d_step, (right[:, 0] - post[:, 0]).sum(0)


def language_sample(docs: DataFrame, per_language: int = SAMPLE, longest: int = SAMPLE_BYTES) -> tuple[list[bytes], list[str]]:
    """``per_language`` training rows of each language, all if there are fewer: those with the smallest
    hashes of id and text. Texts are only exchanged once they are chosen."""
    own = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).withColumn(
        "hash", sample_hash(F.col("doc_id"), F.col("text")))
    chosen = hash_sample(own.select(F.col("lang").alias("label"), "hash"), per_language)
    rows = sampled_texts(own.select("hash", text_window(F.col("text"), F.col("doc_id"), longest).alias("text")), chosen).collect()
    return [whole_characters(r["text"]) for r in rows], [r["label"] for r in rows]


def train(docs: DataFrame) -> LanguageCrf:
    texts, labels = language_sample(docs)
    languages = sorted(set(labels))
    model = LanguageCrf(languages).fit(texts, np.array([languages.index(x) for x in labels], np.int64))
    release()
    return model


def label_documents(docs: DataFrame, model: LanguageCrf, carried: list[str], with_text: bool = False) -> DataFrame:
    """The ``carried`` columns as one struct, lang_pred, score, and words: the number of words per
    language label; ``with_text``: the text too, which then needn't be carried."""
    text = ["text"] if with_text else []
    schema = docs.select(F.struct(*carried).alias("carried"), *text, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"),
                         F.array(F.struct(F.lit("").alias("lang"), F.lit(0).cast("long").alias("n"))).alias("words")).schema
    names = np.array([*model.languages, UNKNOWN])
    n = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        release()
        letter = regex.compile(r"\p{L}")
        for batch in batches:
            buf, offs = text_bytes(batch["text"])
            has = np.array([bool(t) and letter.search(t) is not None for t in batch["text"].to_pylist()], bool)
            best, score, words = [], [], []
            for i, j in slices(offs):
                part, o = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
                starts, ends, counts = split_words(part, o, _APART)
                total, label = np.zeros((j - i, n + 1)), np.zeros((j - i, n), np.int64)
                if n:
                    post = model.posteriors(model.emissions(part, starts, ends), counts)
                    row = np.repeat(np.arange(j - i), counts)
                    for y in range(n):
                        total[:, y] = np.bincount(row, post[:, y], j - i)
                    np.add.at(label, (row, post.argmax(1)), 1)
                known = has[i:j] & (counts > 0) & (n > 0)
                best.append(np.where(known, total.argmax(1), n))
                score.append(np.where(known, np.minimum(total.max(1) / np.maximum(counts, 1), 1), 0.0))
                words += [[{"lang": x, "n": k} for x, k in zip(model.languages, r) if k] for r in label.tolist()]
            z = np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch["carried"], *(batch[c] for c in text), pa.array(names[np.concatenate([z.astype(int), *best])].tolist(), pa.string()),
                 pa.array(np.concatenate([z, *score]), pa.float64()),
                 pa.array(words, pa.list_(pa.struct([("lang", pa.string()), ("n", pa.int64())])))],
                ["carried", *text, "lang_pred", "score", "words"])

    return docs.select(F.struct(*carried).alias("carried"), "text").mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, words, learned from the documents that are not held out."""
    found = label_documents(docs, train(docs), ["doc_id"])
    return found.select("carried.doc_id", held_out(F.col("carried.doc_id")).alias("held_out"), "lang_pred", "score", "words")
