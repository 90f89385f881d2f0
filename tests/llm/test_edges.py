"""Empty tables, odd rows and clashing columns: no operator fails, and each answers as its docstring says."""
import pytest
from data import SCHEMA, odd_rows

import corpus_pipeline
from tidemark.llm import bpe, hamming, jaccard, licences, mixing, neighbours, parsing, personal, token_files, toxicity

SPEC = token_files.tokenizer_spec()
FIELD = personal.ChainCRF.blank()
ON_DOCUMENTS = {
    "jaccard": jaccard.jaccard_components,
    "licences": licences.licence_scan,
    "mix_plan": mixing.mix_plan,
    "mix": mixing.mix,
    "personal": lambda d: personal.find_personal(d, personal.digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", FIELD),
    "toxicity": lambda d: toxicity.toxicity(d, toxicity.TextCNN()),
    "bpe": lambda d: bpe.encode(d, SPEC, bpe.digests(SPEC), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"),
    "passages": lambda d: parsing.dedupe_passages(d, parsing.digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"),
}


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_empty(spark, name):
    assert ON_DOCUMENTS[name](spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("name", [n for n in ON_DOCUMENTS if n != "mix"])
def test_a_row_for_every_row(spark, name):
    rows = odd_rows(40)
    got = ON_DOCUMENTS[name](spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)


def test_mix_rows(spark):
    docs = spark.createDataFrame(odd_rows(40), SCHEMA)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect() if r["size"]}
    got = mixing.mix(docs)
    assert got.columns == docs.columns
    n = {}
    for r in got.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    rows = [r for r in odd_rows(40) if r[1] and r[1].strip()]
    assert n == {i: c * sum(r[0] == i for r in rows) for i, c in plan.items() if c}


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], SCHEMA), str(tmp_path / "t"), SPEC)
    assert token_files.read_tokens(spark, str(tmp_path / "t")).collect() == []


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert neighbours.near_duplicates(empty).collect() == []
    codes = hamming.binary_codes(empty)
    assert hamming.hamming_search(codes, codes).collect() == []
    blank = spark.createDataFrame([(1, None, 1), (2, None, None)], "vec_id long, embedding array<float>, label int")
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in neighbours.near_duplicates(blank).collect()} == {(1, 0, 1, True), (2, 0, 2, True)}


def test_no_labels(spark):
    docs = spark.createDataFrame(odd_rows(16), SCHEMA)
    model = toxicity.train_model(docs, spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    assert model is None and {r.score for r in toxicity.toxicity(docs, model).collect()} == {0.0}


def test_pipeline_stages(spark):
    """Each stage against a plain version on its own input."""
    from data import components, counted, jaccard_links, words
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "personal_data", "source_mix", "bpe"]
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == docs.columns and clean.count() <= docs.count()
    one = corpus_pipeline.drop_near_copies(spark, docs, folder)
    sets, links = jaccard_links([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, c in components(links, sets).items() if i == c)
    field = personal.train_field()
    hidden = {r.doc_id: r for r in corpus_pipeline.redact(spark, docs, folder).collect()}
    for r in docs.collect():
        (_, spans), = personal.all_spans([r.text], field)
        assert hidden[r.doc_id].text == personal.redacted(r.text, spans) and hidden[r.doc_id].n_chars == len(hidden[r.doc_id].text)
        assert not personal.base_spans(hidden[r.doc_id].text)
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    plan = {r.doc_id: r.copies for r in mixing.mix_plan(docs).collect()}
    assert counted((r.doc_id,) for r in mixed.collect()) == {(i,): c for i, c in plan.items() if c}
    assert mixed.columns == docs.columns and all(words(r.text) for r in mixed.collect())
