import hashlib
import random

import numpy as np
import pytest

from gradus.llm.repeats import WINDOW, cut, segments, without_repeats


def brute(rows):
    raw = [((d if d is not None else -(2**63)), (t or "").encode()) for d, t in rows]
    first = {}
    for d, t in raw:
        for i in range(len(t) - WINDOW + 1):
            w = t[i : i + WINDOW]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - WINDOW + 1):
            if first[t[i : i + WINDOW]] < d:
                gone[i : i + WINDOW] = b"\1" * WINDOW
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return sorted(out)


def results(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, kind long, raw string")
    got = without_repeats(df, text_back=False).collect()
    assert not got or set(got[0].asDict()) == {"doc_id", "kind", "raw", "n_bytes", "n_removed", "n_spans", "kept"}
    return sorted((r.doc_id if r.doc_id is not None else -(2**63), r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    shared = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s))
            parts.append(rng.choice([s, s[a:], s[:a], " ".join(word() for _ in range(8))]))
        rows.append((rng.randint(0, n), " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed, 120)
    assert results(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long = "all of this text stands in several of the documents, word for word and letter for letter"
    rows = [(3, long), (1, None), (2, ""), (None, long), (None, "x" + long), (5, long + long), (5, long + long), (4, "a" * 300), (9, "b" + "a" * 200 + "c"), (8, "ha " * 90), (7, "ha " * 40), (6, long[:49]), (10, long[:50])]
    assert results(spark, rows) == brute(rows)
    assert results(spark, [(1, "only one")]) == brute([(1, "only one")])


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_text_comes_back_without_broken_characters(spark):
    long = "é" * 40
    got = without_repeats(spark.createDataFrame([(1, long), (2, "start " + long + " end")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.kept for r in got} == {1: long, 2: "start  end"}


def test_segments_hold_every_window_once():
    rng = np.random.default_rng(3)
    buf = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 30, 30, 1000, 1050, 5000])
    s = segments(buf, offsets)
    seen = sorted((d, p + i) for d, p, n in zip(s["doc"], s["pos"], s["len"]) for i in range(n - WINDOW + 1))
    assert seen == [(d, i) for d in range(5) for i in range(offsets[d + 1] - offsets[d] - WINDOW + 1)]


def test_cut_merges():
    assert cut(b"0123456789", np.array([4, 1, 2]), np.array([2, 2, 2])) == (b"06789"[:1] + b"6789", 5, 1)
    assert cut(b"abc", np.array([], int), np.array([], int)) == (b"abc", 0, 0)


def test_everything_spills(spark, monkeypatch):
    from gradus.llm import induced

    rows = corpus(3, 120)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(induced, "BLOCK", 1 << 9)
    got = without_repeats(df, text_back=False, part_bytes=1 << 30, memory=64).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got) == brute(rows)
    got = without_repeats(df, text_back=False, part_bytes=100).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got) == brute(rows)
