"""Rows that the operators must survive, and plain re-statements of their contracts."""

from __future__ import annotations

import random
import re

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, block int, shard int, token long, "
          "carried string, id long, n long, component string, score string")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    raw = (text or "").encode()
    if lower:
        raw = raw.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    return WORD.findall(raw)


def corpus(seed=1, n=60):
    """Documents with exact and near copies, shared passages, nulls, empty and long texts."""
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdeéßñ") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    passage = " ".join(rnd.choices(vocab, k=30))
    texts = []
    for _ in range(n):
        texts.append(" ".join(rnd.choices(vocab, k=rnd.choice([3, 12, 40, 120]))))
    base = " ".join(rnd.choices(vocab, k=150)).split()
    for i in range(30):                                   # near copies, some too far from the first
        copy = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 8])):
            copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0].upper(), texts[1] + "\n" + passage, passage + "\t" + texts[2], passage, passage]
    texts += [None, "", "   \n\t ", "x", "one two", "ONE two", "1 2 3", "!!! ???", "日本語 текст 한국어", "a b\x0bc\x0cd", "😀" * 50]
    texts.append(" ".join(rnd.choices(vocab, k=20_000)))
    texts.append("".join(rnd.choices("abc", k=30_000)))   # one very long word
    return [(7 * i + 3, t, "en", "s", len(t or ""), 1, 2, 3, "c", 4, 5, "x", "y") for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
