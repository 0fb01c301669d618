"""Quality rules, target resampling and hard negatives against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarnlight.llm import hard_negatives, quality_rules, target_resampling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
REPEATED = "one two three four five six seven " * 9_000
ODD = [
    (0, None, "en", "src1", 0), (1, "", "en", "src1", 0), (2, "  \n \x0b", None, "src2", 3), (3, "one two", "de", None, 3), (3, "one two", "de", None, 3),
    (4, "Ünïcode ŝtrings 😀 a|b <c>\n#\n#\n \n#", "fr", "src0", 0), (5, REPEATED, "en", "src0", 0), (6, "a b c a b c\r\na b c a b c\r\nx", "en", "src0", 0), (None, "a b c d", "en", "src0", 0),
    (7, " ".join(f"w{i}" for i in range(60_000)), "en", "src0", 0), (8, "x" * 300_000, "en", "src0", 0),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# op11


def slow_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    hit = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    base = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), base


def test_quality_measures_match_brute_force(spark, texts, odd):
    cases = [(i, t) for i, t in texts] + [(1_000_000 + k, r[1]) for k, r in enumerate(ODD)]
    docs = spark.createDataFrame(cases, "doc_id long, text string")
    judged = quality_rules.judge(docs).select("doc_id", "measures.*", "failed")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r.doc_id: (*[r[n] for n in names], "too_short" in r.failed or "repetitive" in r.failed) for r in judged.collect()}
    assert got == {i: slow_rules(t) for i, t in cases}


def test_quality_query_and_verdict(spark):
    rows = quality_rules.query(spark, SF).collect()
    assert all(r.kept == (r.failed == "") and not (r.base_failed and r.kept) for r in rows)
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    long = [r for r in rows if not r.base_failed and r.doc_id in quality]
    assert [r.doc_id for r in long if r.kept != (quality[r.doc_id] == 1)] == []


def test_quality_rules_are_a_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a b c"), (3, None)], "doc_id long, text string")
    table = (quality_rules.Rule("two", "n_words", 2, 2), quality_rules.Rule("any", "symbol_ratio", None, None))
    assert {r.doc_id: r.failed for r in quality_rules.judge(docs, table).collect()} == {1: [], 2: ["two"], 3: ["two"]}
    assert [r.doc_id for r in quality_rules.keep(docs, table).collect()] == [1]
    assert quality_rules.keep(docs, ()).count() == 3


def test_quality_stop_words_and_lines(spark):
    docs = spark.createDataFrame([(1, "The, of? and thee"), (2, "- a\n* b\n• c\nd"), (3, "so...\nthen…\nend"), (4, "1 2 é")], "doc_id long, text string")
    m = {r.doc_id: r.measures for r in quality_rules.judge(docs).collect()}
    assert m[1].stop_word_ratio == 0.75 and m[2].bullet_line_ratio == 0.75 and m[3].ellipsis_line_ratio == 2 / 3 and m[4].alphabetic_ratio == 1 / 3


def test_quality_odd_rows_clashes_and_empty(odd, empty):
    clash = odd.withColumns({c: F.lit("mine") for c in ("measures", "failed", "row", "t", "_words", "_lines", "_grams", "n_words")})
    out = quality_rules.judge(clash)
    assert out.columns == [*clash.columns, "measures_", "failed_"] and out.where("measures = 'mine' and t = 'mine' and row = 'mine'").count() == len(ODD)
    kept = quality_rules.keep(clash)
    assert kept.columns == clash.columns
    assert quality_rules.judge(empty).count() == 0


# op12


def slow_features(text):
    w = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())
    return len(w), [zlib.crc32(b" ".join(w[i : i + n])) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def slow_resampling(docs, target):
    feats = [slow_features(t) for _, t in docs]
    s, t = Counter(b for _, f in feats for b in f), Counter(b for x in target for b in slow_features(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for (i, _), (n, f) in zip(docs, feats, strict=True):
        weight = sum(gain[b] for b in f)
        noise = None if i is None else math.floor(-1000 * math.log(-math.log((int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296)))
        out.append([i, n, len(f), weight, None if noise is None else weight + noise, None])
    able = sorted((r for r in out if r[1] >= 20 and r[4] is not None), key=lambda r: (-r[4], r[0]))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def test_target_resampling_matches_brute_force(spark, texts):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = target_resampling.query(spark, SF).collect()
    assert got[0].asDict().keys() == {"doc_id", "n_features", "weight", "score", "rank"}
    want = slow_resampling(texts, target)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got), key=str) == sorted(((i, n, w, s, k) for i, _, n, w, s, k in want), key=str)
    assert sum(r["rank"] is not None for r in got) == 5 * sum(n >= 20 for _, n, *_ in want) // 100


def test_target_resampling_odd_rows(spark, odd, empty):
    target = spark.createDataFrame([(1, None), (2, "one two three"), (3, "Ünïcode")], "item_id long, text string")
    got = target_resampling.resample(odd, target)
    rows = sorted(((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()), key=str)
    assert rows == slow_resampling([r[:2] for r in ODD], [None, "one two three", "Ünïcode"])
    assert target_resampling.resample(empty, target).count() == 0
    assert target_resampling.resample(odd, target.limit(0)).count() == len(ODD)


def test_target_resampling_ties_repeats_and_percent(spark):
    docs = spark.createDataFrame([(i // 2, "a " * 20) for i in range(40)], "doc_id long, text string")
    out = target_resampling.resample(docs, docs.limit(0), percent=50).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, 21))
    assert [r.doc_id for r in out] == sorted((r.doc_id for r in out), key=lambda i: [-r.score for r in out if r.doc_id == i][0])


@pytest.mark.parametrize("size", [1, 60, 4 << 20])
def test_target_features_do_not_depend_on_slices(size, texts, monkeypatch):
    monkeypatch.setattr(target_resampling, "_SLICE", size)
    some = pa.array([t for _, t in texts[:40]] + [None, "", "a", "a b", "x" * 70_000, "é " * 5])
    got = []
    for part in target_resampling._slices(some):
        n, doc, bucket = target_resampling.features(part)
        got += [(int(n[k]), sorted(bucket[doc == k].tolist())) for k in range(len(part))]
    assert got == [(n, sorted(f)) for n, f in map(slow_features, some.to_pylist())]


def test_target_weights_keep_columns(odd):
    clash = odd.withColumns({c: F.lit("mine") for c in ("n_words", "n_features", "weight", "row", "t", "a", "b", "c")})
    out = target_resampling.weighed(clash, np.zeros(10_000, np.int64))
    assert out.columns == [c for c in clash.columns if c != "text"] + ["n_words_", "n_features_", "weight_"]
    assert out.where("n_words = 'mine' and row = 'mine' and c = 'mine'").count() == len(ODD)
    assert target_resampling.weighed(odd.select("text"), np.zeros(10_000, np.int64)).count() == len(ODD)


# op13


def slow_negatives(rows, rule=hard_negatives.Rule()):
    good = [(i, [math.floor(256 * x) for x in v], b) for i, v, b in rows if None not in (i, v, b) and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a, b in (r for r in good if r[0] % 50 == 0):
        score = sorted(((-sum(x * y for x, y in zip(a, v, strict=False)), j, c) for j, v, c in good))
        for s, j, _ in [r for r in score if r[2] == b and r[1] != i][: rule.positives]:
            fits = [(t, k) for t, k, c in score if c != b and rule.least * -s <= 100 * -t <= rule.most * -s]
            out += [(i, j, n + 1, k, -s, -t) for n, (t, k) in enumerate(fits[: rule.negatives])]
    return sorted(out)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int") if rows is not None else spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 50 == 0, **more).collect())


def test_hard_negatives_match_sql(spark):
    with duckdb.connect() as con:
        con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
        assert sorted(tuple(r) for r in hard_negatives.query(spark, SF).collect()) == sorted(con.sql(hard_negatives.SQL).fetchall())


@pytest.mark.parametrize("scale", [0.01, 1.0, 50.0, 400_000.0])
def test_hard_negatives_match_brute_force_with_ties(spark, scale, monkeypatch):
    monkeypatch.setattr(hard_negatives, "_ROWS", 37)
    monkeypatch.setattr(hard_negatives, "BLOCK_ANCHORS", 3)
    rng = random.Random(5)
    # few values, so that many scores are equal, and copies of whole rows
    rows = [(i, [float(np.float32(scale * rng.choice([-1, -0.5, 0, 0.5, 1, 1]))) for _ in range(6)], rng.randrange(3)) for i in range(400)]
    rows += [(i + 400, rows[i][1], rows[i][2]) for i in range(100)]
    assert mined(spark, rows) == slow_negatives(rows)
    rule = hard_negatives.Rule(2, 7, 10, 100)
    assert mined(spark, rows, rule=rule) == slow_negatives(rows, rule)


def test_hard_negatives_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [0.75, 0.5], 2), (3, [nan, 1.0], 1), (4, [inf, 1.0], 2), (5, [None, 1.0], 2), (6, None, 2), (7, [0.5, 0.5], None), (None, [0.75, 0.5], 2)]
    rows += [(8, [], 2), (9, [0.75], 3), (10, [0.75, 0.25, 9.0], 4), (2, [0.75, 0.5], 2), (50, [-1.0, -1.0], 5), (100, [0.0, 0.0], 6), (101, [0.0, 0.0], 6), (150, [1.0, 1.0], 9)]
    got = mined(spark, rows)
    assert got == slow_negatives(rows) and {r[0] for r in got} == {0, 100}
    assert mined(spark, [*rows, (11, [1e30, 1.0], 2)]) == got  # its scores would not fit
    assert mined(spark, None) == []
    assert mined(spark, [(None, None, None), (1, [1.0], 1)]) == []


def test_packed_scores_are_exact():
    rng = np.random.default_rng(3)
    for top in (1, 300, 1 << 14, 1 << 29):
        a, x = (rng.integers(-top, top + 1, (n, 5)) for n in (7, 31))
        packed = hard_negatives.Packed(x, hard_negatives._norm(a))
        assert packed.fields >= (3 if top <= 300 else 1)
        assert packed.scores(a).tolist() == [[sum(p * q for p, q in zip(r, s, strict=True)) for s in x.tolist()] for r in a.tolist()]
