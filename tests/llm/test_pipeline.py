import corpus_pipeline
import pytest
from tests.llm.fixtures import edge_rows, table, words
from tests.llm.test_dedup import closed, fingerprint

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's rows, each run on what the one before wrote."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs.collect())
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, docs, SF)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert left.columns == docs.columns, name
        left.write.parquet(str(folder / str(n)))
        docs = spark.read.parquet(str(folder / str(n)))
        out.append(docs.collect())
    return out


def test_classifier_drops_only_what_it_rejects(spark, stages):
    from phraseforge.llm.queries import queries

    verdict = {r["doc_id"]: r["predicted"] for r in queries()["op4_quality_classifier"](spark, SF).collect()}
    assert sorted(r["doc_id"] for r in stages[1]) == sorted(d for d, p in verdict.items() if p)
    assert 0 < len(stages[1]) < len(stages[0])


def test_exact_stage_keeps_the_largest_id_of_each_text(stages):
    keep = {}
    for r in stages[1]:
        keep[r["text"]] = max(keep.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(keep.values())


def test_near_stage_keeps_one_of_each_group(stages):
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in stages[2]}
    ids = sorted(fps)
    group = closed([(i, i) for i in ids] + [(i, j) for i in ids for j in ids if i < j and (fps[i] ^ fps[j]).bit_count() <= 4])
    assert sorted(r["doc_id"] for r in stages[3]) == sorted(set(group.values()))


def test_mixing_stage_meets_the_targets(spark, stages):
    from phraseforge.llm import mixing

    size, got = {}, {}
    for r in stages[3]:
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
    for r in stages[4]:
        got[r["source"]] = got.get(r["source"], 0) + len(words(r["text"]))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    target = {r["source"]: r["target"] for r in mixing.plan(spark.createDataFrame([tuple(r) for r in stages[3]], schema)).collect()}
    assert all(abs(got.get(s, 0) - t) <= 0.5 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6


def test_last_stage_encodes_every_row(stages):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], library.encode(r["text"])) for r in stages[4])
    assert sorted((r["doc_id"], r["ids"]) for r in stages[5]) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in stages[5])


def test_run_is_the_stages_in_order(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r["doc_id"], r["ids"]) for r in got.collect()) == sorted((r["doc_id"], r["ids"]) for r in stages[5])


def test_stages_on_nulls_repeats_and_clashing_columns(spark, tmp_path):
    """Every stage on what the one before kept: columns come through, no text appears from nowhere,
    rows without an id are kept by their texts, and an empty table stays empty."""
    rows = edge_rows() + [(None, f"row without an id number {i} and some words of its own {i * i}", None, None) for i in range(3)]
    rows += [(None, rows[-1][1], None, None)]
    for given in (table(spark, rows, "score,row,key,size,keep_id"), table(spark, rows).limit(0)):
        docs, texts = given, {r["text"] or "" for r in given.collect()}
        for n, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            out = stage(spark, docs, SF)
            assert out.columns == given.columns, name
            out.write.parquet(f"{tmp_path}/{len(texts)}-{n}")
            docs = spark.read.parquet(f"{tmp_path}/{len(texts)}-{n}")
            left = [r["text"] or "" for r in docs.collect()]
            if n < 3:
                assert set(left) <= texts, name
            if n in (1, 2):
                assert len(left) == len(set(left)), name
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert last.columns == ["doc_id", "source", "n_tokens", "ids"] and last.count() == docs.count()
        if texts:
            near = [r["text"] for r in corpus_pipeline.drop_near_copies(spark, given, SF).collect() if r["doc_id"] is None]
            assert len(set(near)) >= 3
