"""What the Python workers of the pipeline's stages hold at once, and what they give back."""

import weakref

import numpy as np
import pyarrow as pa

from tarnlight.llm import simhash, text

DOCS = "doc_id long, text string"


def test_a_task_of_the_near_duplicate_stage_has_one_python_worker(spark, monkeypatch):
    """Each iterator of batches in a stage's plan is one more worker a task, with its own copy of the texts."""
    plans, write = {}, simhash.materialize

    def seen(df, tag, **more):
        plans[tag] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, tag, **more)

    monkeypatch.setattr(simhash, "materialize", seen)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], DOCS)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert plans["shingles"].count("ArrowEvalPython") == 1


def test_pieces_are_all_texts_in_order_and_bounded():
    texts = ["", None, "ü" * 30, "b" * 99, "c" * 100, "d" * 250, None, "e", "f" * 98]
    for kind in (pa.string(), pa.large_string()):
        found = list(text.pieces(pa.array(["cut off", *texts], kind).slice(1), 100))
        assert [t for part in found for t in part] == [(t or "").encode() for t in texts]
        assert all(part and (sum(map(len, part)) < 100 or len(part) == 1) for part in found)
        assert list(text.pieces(pa.array([], kind))) == []


def test_memory_is_given_back_when_nothing_holds_it(monkeypatch):
    held, alive = [], []
    monkeypatch.setattr(text, "release", lambda: alive.append([x() is not None for x in held]))

    def made(batches):
        block = np.zeros(10)
        held.append(weakref.ref(block))
        for batch in batches:
            held.append(weakref.ref(batch))
            yield batch.sum() + block.sum()

    assert list(text.freed(made(np.ones(k) for k in (1, 2, 3)))) == [1, 2, 3]
    assert alive == [[False] * 4]
