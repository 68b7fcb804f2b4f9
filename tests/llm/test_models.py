"""Byte CNN (op 7) and language CRF (op 8)."""

import zlib

import numpy as np

from wardlight.llm import byte_cnn, language_crf

from .util import SCHEMA, corpus, frame

MID = "/root/testdata/sf0.01"


def test_cnn_gradients_are_right():
    model = byte_cnn.ByteCnn()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    rng = np.random.default_rng(1)
    raw = [rng.integers(32, 127, n).astype(np.uint8).tobytes() for n in (0, 5, 300, 900)]
    offs, buf = np.concatenate([[0], np.cumsum([len(r) for r in raw])]), np.frombuffer(b"".join(raw), np.uint8)
    y = np.array([0, 1, 1, 0.0])

    def loss():
        z = model._forward(buf, offs)[0]
        return float(np.mean(np.logaddexp(0, z) - y * z))
    grads = model._gradients(buf, offs, y)
    for name, g in grads.items():
        flat = model.p[name].reshape(-1)
        for i in np.argsort(-np.abs(g.reshape(-1)))[:3]:
            old, eps = flat[i], 1e-6
            flat[i] = old + eps
            up = loss()
            flat[i] = old - eps
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 1e-4 * max(1, abs(g.reshape(-1)[i])), name


def test_quality_on_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{MID}/documents.parquet"), spark.read.parquet(f"{MID}/labels.parquet")
    got = byte_cnn.quality(docs, labels).join(labels, "doc_id").collect()
    assert all(g["held_out"] == (zlib.crc32(str(g["doc_id"]).encode()) % 5 == 0) for g in got)
    assert all(0 <= g["score"] <= 1 and g["predicted"] == (g["score"] >= 0.3) for g in got)
    held = [g for g in got if g["held_out"]]
    assert np.mean([g["predicted"] == g["quality"] for g in held]) > 0.9


def test_quality_odd_rows(spark):
    rows = corpus(n=5)
    rows += [rows[0], (None, "null id", *rows[0][2:])]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(3, 1, None), (10, 0, None), (17, None, 1), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0), labels.where("quality = 1")):
        got = byte_cnn.quality(docs, some).collect()
        assert len(got) == len(rows) and all(g["score"] is not None for g in got)
    assert byte_cnn.quality(spark.createDataFrame([], SCHEMA), labels).count() == 0


def brute_posteriors(model, emission):
    step, e = np.exp(model.transition), np.exp(emission)
    f, b = e.copy(), np.ones_like(e)
    f[0] *= np.exp(model.start)
    for t in range(1, len(e)):
        f[t] = f[t - 1] @ step * e[t]
        f[t] /= f[t].sum()
    for t in range(len(e) - 2, -1, -1):
        b[t] = step @ (e[t + 1] * b[t + 1])
        b[t] /= b[t].sum()
    return f * b / (f * b).sum(1, keepdims=True)


def test_chunked_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    model = language_crf.LanguageCrf(["a", "b", "c"])
    model.transition, model.start = rng.standard_normal((3, 3)), rng.standard_normal(3)
    counts = np.array([0, 1, 63, 64, 65, 0, 300, 2])
    emission = 3 * rng.standard_normal((counts.sum(), 3))
    got, at = model.posteriors(emission, counts), 0
    for n in counts:
        if n:
            assert np.allclose(got[at:at + n], brute_posteriors(model, emission[at:at + n]))
        at += n


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    got = language_crf.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [g for g in got if g["held_out"]]
    assert np.mean([g["lang_pred"] == g["lang"] for g in held]) > 0.97


def test_code_switched_words(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = language_crf.train(docs)
    one = {r["lang"]: " ".join(r["text"].split()[:60]) for r in docs.where("octet_length(text) between 1500 and 4000").collect()}
    rows = [(1, one["en"] + " " + one["fr"], *[None] * 11)]
    got = language_crf.label_documents(frame(spark, rows), model, ["doc_id"]).collect()[0]
    words = {w["lang"]: w["n"] for w in got["words"]}
    assert words["en"] > 30 and words["fr"] > 30


def test_language_odd_rows(spark):
    rows = corpus(n=5)
    rows += [rows[0], (None, "null id", *rows[0][2:])]
    got = language_crf.identify(frame(spark, rows)).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for g in got:
        letters = g["doc_id"] is None or any(c.isalpha() for c in texts[g["doc_id"]] or "")
        assert (g["lang_pred"] == "en" and g["score"] > 0) if letters else (g["lang_pred"] == "und" and g["score"] == 0)
    unlabelled = [(*r[:2], None, *r[3:]) for r in rows]
    assert {g["lang_pred"] for g in language_crf.identify(frame(spark, unlabelled)).collect()} == {"und"}
    assert language_crf.identify(spark.createDataFrame([], SCHEMA)).count() == 0


def long_documents(n=24):
    """Texts over SAMPLE_BYTES, in two languages, with characters of several bytes."""
    vocab = {"fr": "été où garçon maison très forêt", "el": "και είναι θάλασσα μέρα νύχτα"}
    rng = np.random.default_rng(9)
    return [(i, " ".join(rng.choice(vocab[lang].split(), 6000 + i)), lang, *[None] * 10) for i, lang in enumerate(["fr", "el"] * (n // 2))]


def test_long_texts_are_learned_from(spark):
    rows = long_documents()
    assert min(len(r[1].encode()) for r in rows) > language_crf.SAMPLE_BYTES
    docs = frame(spark, rows)
    got = {g["doc_id"]: g for g in language_crf.identify(docs).collect()}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows)
    texts, labels = language_crf.language_sample(docs)
    assert set(labels) == {"fr", "el"} and all(language_crf.SAMPLE_BYTES - 8 < len(t) <= language_crf.SAMPLE_BYTES for t in texts)
    whole = {r[2]: [x[1].encode() for x in rows if x[2] == r[2]] for r in rows}
    assert all(any(t in x for x in whole[y]) for t, y in zip(texts, labels))
    assert any(not x.startswith(t) for t, y in zip(texts, labels) for x in whole[y] if t in x)


def test_quality_of_long_texts(spark):
    rows = long_documents()
    labels = spark.createDataFrame([(r[0], int(r[2] == "fr")) for r in rows], "doc_id long, quality int")
    texts, y = byte_cnn.labelled_sample(frame(spark, rows), labels, "quality")
    assert set(y.tolist()) == {0, 1} and max(map(len, texts)) <= byte_cnn.SAMPLE_BYTES
    model = byte_cnn.ByteCnn().fit(texts, y, steps=20)
    scores = {g["doc_id"]: g["score"] for g in byte_cnn.score_documents(frame(spark, rows), model).collect()}
    assert len(set(scores.values())) > 2
