import pytest

from siltstone.llm import langid, mixing, pieces, simhash

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_against_brute_force(spark):
    from test_operators import ascii_lower, brute_components, brute_fingerprint, corpus

    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(corpus(7, 50))]
    rows += [(100 + i, f"the quick brown fox number {i} jumps over the lazy dog and runs away from me {i * i}", "en", "s1", 9) for i in range(20)]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, lang string, source string, n_chars long")
    own = {r[0]: r[1] for r in rows}
    first = pipeline.identify_language(spark, docs, "")
    assert first.columns == docs.columns
    accepted = {r.doc_id for r in first.collect()}
    model = langid.train(docs)
    assert accepted == {r.doc_id for r in langid.identify(docs, model).collect() if r.lang_pred != "und" and r.score >= langid.MIN_SCORE}
    second = pipeline.drop_exact_copies(spark, first, "")
    groups = {}
    for i in accepted:
        groups.setdefault(ascii_lower(own[i]), []).append(i)
    kept = sorted(max(g) for g in groups.values())
    assert second.columns == docs.columns and sorted(r.doc_id for r in second.collect()) == kept
    third = pipeline.drop_near_copies(spark, second, "")
    want = sorted(set(brute_components(kept, {i: brute_fingerprint(own[i]) for i in kept}).values()))
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == want
    fourth = pipeline.mix_sources(spark, third, "")
    copies = {r.doc_id: r.copies for r in mixing.mix(third).collect()}
    assert fourth.columns == docs.columns and sorted(r.doc_id for r in fourth.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    last = pipeline.encode(spark, fourth, "")
    assert last.count() == fourth.count() and last.filter("NOT round_trip").count() == 0
    back = {(r.doc_id, r.text) for r in pieces.decode_documents(last).collect()}
    assert back == {(r.doc_id, r.text) for r in fourth.collect()}


def test_run_and_empty(spark, tmp_path):
    from pyspark.sql import functions as F

    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.filter(F.size("ids") != F.col("n_tokens")).count() == 0
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
    assert len(pipeline.STAGES) == 5 and simhash.BITS == 3
