import corpus_pipeline
from gradus.llm import forest, mixing, repeats, toxicity

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            rows = out.collect()
            docs = spark.createDataFrame(rows, out.schema)
            counts.append((name, len(rows)))
        else:
            pieces = out.collect()
    assert counts[0][1] < 200 and counts[1][1] < counts[0][1] and counts[2][1] == counts[1][1]
    assert len({(p.sequence_id, p.offset) for p in pieces}) == len(pieces)
    assert {p.doc_id for p in pieces} == {r.doc_id for r in docs.collect()}


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0


def test_stages_call_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "packing"]
    assert all((toxicity, forest, repeats, mixing))


def test_repeats_stage_keeps_own_columns(spark):
    long = "all of this text stands in several of the documents, word for word and letter for letter"
    docs = spark.createDataFrame([(1, long, "k1", 7), (2, "x " + long, "k2", 8)], "doc_id long, text string, kept string, n_bytes int")
    out = corpus_pipeline.drop_repeats(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == [(1, long, "k1", 7), (2, "x ", "k2", 8)]
