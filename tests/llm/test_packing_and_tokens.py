import zlib
from functools import cache

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gradus.llm.packing import differencing, pack, windows
from gradus.llm.sstable import TableReader, encode_and_read, open_uri, write_shards

DOCS = [
    (5, "  a  b\n\nc \n d, it's 12!"), (1, None), (2, ""), (3, "Émile's DON'T stop. Ünïcode — “quotes”"), (3, "again\nlines.\nNext"),
    (9, "word, " * 9000), (None, "no id"), (7, "日本語 テスト a\x1cb \x1c c tail  "), (8, "see <|endoftext|> here\n"), (4, "x" * 5000 + ". y   z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*d, 0, 1) for d in DOCS]
    return spark.createDataFrame(rows, "doc_id long, text string, start long, sequence_id long")


@cache
def tokenizer(name):
    return Tokenizer.from_file(P.path(name))


def ids_of(name, text, end):
    return np.array([*tokenizer(name).encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_pack_covers_every_id_once(docs):
    rows = pack(docs, P.path("word_bpe_49k.json")).collect()
    want = sorted(((d, ids_of("word_bpe_49k.json", t, 2)) for d, t in DOCS), key=lambda x: (x[0] is None, x[0] or 0, len(x[1])))
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert len(got) == len(want)
    for d, ids in want:
        at = 0
        for r in sorted(got[d, len(ids)], key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_pack_empty_table(docs):
    assert pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_differencing_is_near_even_and_windows_hold():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 900, 500)]
    parts = differencing(sizes, 60)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(500)) and max(sums) - min(sums) <= 0.005 * max(sums)
    assert len(windows([3, 3, 3], 4)) == 3  # two would overflow
    assert windows([], 4) == [] and len(windows([4096] * 5, 4096)) == 5
    assert sum(len(p) for p in windows([7] * 1000, 4096)) == 1000


def test_little_padding():
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in np.minimum(rng.lognormal(6.3, 1, 3000).astype(int) + 1, 4095)]
    assert len(windows(sizes, 4096)) <= 1.01 * sum(sizes) / 4096


def test_shards_round_trip(spark, docs):
    got = encode_and_read(spark, docs, P.path("byte_bpe_50k.json")).collect()
    at, want = 0, []
    for d, t in sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode())):
        ids = ids_of("byte_bpe_50k.json", t, 0)
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert encode_and_read(spark, docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_lookup(spark, tmp_path):
    many = spark.range(0, 3000, 3).selectExpr("id as doc_id", "concat('text number ', id, repeat(' more', int(id % 50))) as text")
    shards = write_shards(many, f"file://{tmp_path}", P.path("byte_bpe_50k.json"), 0, shards=2).collect()
    found, missing = 0, 0
    for s in shards:
        with open_uri(s.path, "r") as f:
            table = TableReader(f)
            assert table.n_docs == s.n_docs and len(table.blocks) > 1
            for d in range(0, 3000, 3):
                if hits := table.get(d):
                    assert list(hits[0]) == list(ids_of("byte_bpe_50k.json", f"text number {d}" + " more" * (d % 50), 0))
                    found += 1
            missing += sum(bool(table.get(d)) for d in range(1, 3000, 3))
    assert found == 1000 and missing == 0
