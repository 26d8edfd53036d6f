"""The pipeline's stages against plain versions of their decisions."""

import hashlib

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from panelark.llm import decontamination, jaccard, language_id, secrets
from tests.llm.test_jaccard import plain as plain_components

FOLDER = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    steps = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER).cache()
        sizes.append(out.count())
        steps[name] = (docs, out)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and out.schema == docs.schema
        docs = out
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]

    before, after = steps["language"]
    rows = language_id.with_language(before, language_id.fit(before)).collect()
    want = {r.doc_id for r in rows if r._lang != "und" and (r._score >= language_id.MIN_SCORE or len(r.text) < language_id.JUDGED_CHARS)}
    assert {r.doc_id for r in after.collect()} == want

    before, after = steps["near duplicates"]
    groups = plain_components([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == [i for i, _, c in groups if i == c]

    before, after = steps["decontamination"]
    found = decontamination.leaks(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    gone = {r.doc_id for r in found.collect()}
    assert gone and {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - gone

    before, after = steps["secrets"]
    texts = {r.doc_id: r.text for r in before.collect()}
    spans = {r.doc_id: r.spans for r in secrets.report(before, secrets.fit(secrets.labelled_samples(before))).collect()}
    assert any(spans.values())
    for r in after.collect():
        text, at, out = texts[r.doc_id], 0, ""
        for _, start, end in (s.split(":") for s in spans[r.doc_id].split(",") if s):
            if int(start) >= at:
                out += text[at : int(start)] + "<secret>"
            at = max(at, int(end))
        assert r.text == out + text[at:] and r.n_chars == len(r.text)

    before, after = steps["tokens"]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    whole = contract.queries()["pipeline"](spark, FOLDER)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after.collect()))


def test_registered():
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "decontamination", "secrets", "tokens"]


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).collect() == []
    assert jaccard.stage(spark, docs.limit(0), FOLDER).columns == docs.columns
