"""Columns of the caller's that are named like something inside come back as they were; scores by a plain forward pass."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tarnlight.llm import decontaminate, mixing, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [(i, " ".join(f"w{(i * 7 + k) % 50}" for k in range(5 + i % 40)), "en", f"src{i % 3}", 0) for i in range(40)] + [(40, None, None, None, None)]


def _clashing(df, names):
    return df.withColumns({c: F.lit("mine") for c in names})


def test_mixture_keeps_all_columns(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    names = ("epochs", "last_key", "last_tie", "grp", "key", "tie", "weight", "budget", "available", "row", "id", "range", "left", "r", "w", "_lang")
    plain, got = (sorted(map(tuple, mixing.mixture(d).select("doc_id", "epoch", "n_tokens", "domain").collect()), key=str) for d in (docs, _clashing(docs, names)))
    assert got == plain and len(plain) > 20
    out = mixing.mixture(_clashing(docs, names))
    assert out.columns == [*docs.columns, *names, "domain", "n_tokens", "epoch"]
    assert out.where(" or ".join(f"{c} <> 'mine'" for c in names)).count() == 0


@pytest.mark.parametrize("remove", ["documents", "spans"])
def test_decontaminate_keeps_all_columns(spark, remove):
    docs = _clashing(spark.createDataFrame(ROWS, DOCS), ("_match", "match", "items", "spans"))
    bench = spark.createDataFrame([(1, ROWS[20][1])], "item_id long, text string")
    out = decontaminate.decontaminate(docs, bench, remove=remove)
    assert out.columns == docs.columns and out.where("_match = 'mine' and match = 'mine'").count() == (len(ROWS) if remove == "spans" else out.count())
    assert out.where("doc_id = 20").count() == (remove == "spans")


def test_reject_keeps_all_columns(spark):
    docs = _clashing(spark.createDataFrame(ROWS, DOCS), ("_toxicity", "h", "toxic", "score"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    out = toxicity.reject(docs, labels)
    assert out.columns == docs.columns and out.where("_toxicity = 'mine' and h = 'mine'").count() == len(ROWS)


def test_sample_is_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 3200)
    docs = spark.createDataFrame([(i, "x" * (10_000 if i % 10 == 1 else 100)) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    got = toxicity.labelled_sample(docs, labels).collect()
    assert len(got) == 32 and max(len(r.text) for r in got) == 100


def _plain_score(net, text):
    """The network by loops over single numbers: words, characters, both passes, attention, the worst window, calibration."""
    w = {k: v.astype(float).tolist() for k, v in net.weights.items()}
    hidden = len(w["Uf"])
    sig = lambda x: 1 / (1 + math.exp(-x))
    dot = lambda row, matrix, a, b: [sum(x * matrix[i][j] for i, x in enumerate(row)) for j in range(a, b)]

    def enter(word):
        marked, known = b"<" + word + b">", []
        for i in range(len(marked) - 3):
            code = int.from_bytes(marked[i : i + 4], "little")
            slot = (code * 2654435761 % 2**32) >> (32 - toxicity.SLOT_BITS)
            if net.gram_codes[slot] == code and net.gram_numbers[slot]:
                known.append(w["C"][net.gram_numbers[slot]])
        mean = [sum(c[j] for c in known) / len(known) if known else 0.0 for j in range(len(w["C"][0]))]
        x = w["E"][net.words.get(word, 0)] + mean
        return [a + b for a, b in zip(dot(x, w["W"], 0, 6 * hidden), w["g"], strict=True)]

    def one_way(gates, u):
        h, out = [0.0] * hidden, []
        for g in gates:
            z = [sig(a + b) for a, b in zip(g[:hidden], dot(h, u, 0, hidden), strict=True)]
            r = [sig(a + b) for a, b in zip(g[hidden : 2 * hidden], dot(h, u, hidden, 2 * hidden), strict=True)]
            c = [math.tanh(a + b) for a, b in zip(g[2 * hidden :], dot([a * b for a, b in zip(r, h, strict=True)], u, 2 * hidden, 3 * hidden), strict=True)]
            h = [(1 - a) * b + a * x for a, b, x in zip(z, h, c, strict=True)]
            out.append(h)
        return out

    words = text.lower().split()
    gates = [enter(x) for x in words]
    best = -math.inf
    for at in [0] if len(words) <= toxicity.WINDOW else [*range(0, len(words) - toxicity.WINDOW, toxicity.STRIDE), len(words) - toxicity.WINDOW]:
        part = gates[at : at + toxicity.WINDOW]
        states = [a + b for a, b in zip(one_way([g[: 3 * hidden] for g in part], w["Uf"]), one_way([g[3 * hidden :] for g in part[::-1]], w["Ub"])[::-1], strict=True)]
        pull = [math.exp(sum(math.tanh(x) * y for x, y in zip(dot(s, w["A"], 0, hidden), w["a"], strict=True))) for s in states]
        pooled = [sum(p * s[j] for p, s in zip(pull, states, strict=True)) / sum(pull) for j in range(2 * hidden)]
        best = max(best, sum(x * y for x, y in zip(pooled, w["o"], strict=True)) + w["b"][0])
    return sig(w["p"][0] * best + w["p"][1])


def test_scores_equal_a_plain_forward_pass(monkeypatch):
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    monkeypatch.setattr(toxicity, "STEPS", 10)
    rng = random.Random(1)
    some = ["scum", "clown", "trash", "thé", "of", "a", "haeder", "onblesh", "x"]
    make = lambda n, bad: " ".join(rng.choice(some[:3] if bad and rng.random() < 0.3 else some[3:]) for _ in range(n)).encode()
    texts = [make(rng.randrange(5, 60), k % 3 == 0) for k in range(60)]
    net = toxicity.train(texts, [int(k % 3 == 0) for k in range(60)])
    held = [make(n, n % 2) for n in (1, 7, toxicity.WINDOW, toxicity.WINDOW + 1, 2 * toxicity.WINDOW + 3)] + [b"Never-seen WORDS \xc3\xa9\xc3\xa9"]
    assert toxicity.scores(net, held) == pytest.approx([_plain_score(net, t) for t in held], abs=2e-4)
    assert len({round(x, 3) for x in toxicity.scores(net, held)}) > 3
