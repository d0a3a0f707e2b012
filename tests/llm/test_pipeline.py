"""The pipeline's stages: contracts of each, and the whole against a plain composition."""

import corpus_pipeline
from cinderloom.llm import quality, toxicity
from cinderloom.llm.common import table
from tests.llm.test_operators import brute_links, brute_removed, check_packing, without


def test_stages_and_run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_classifier", "toxicity", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
    before = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}
    again = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in again)


def test_run_equals_brute_force(spark, sf_dir):
    """The fitted models' decisions row by row, all lines against all, all documents against all."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.fit(docs, labels)
    keys = {i: model.importance(t or "") + quality.gumbel(i, t or "", 7) for i, t in rows.items()}
    k = sum(model.importance(t or "") >= model.cut for t in rows.values())
    kept = {i: rows[i] for i in sorted(rows, key=lambda i: -keys[i])[:k]}
    left = docs.where(docs.doc_id.isin(list(kept)))
    judge = toxicity.fit(left, labels)
    kept = {i: t for i, t in kept.items() if judge.probability(*judge.segments(t or "")) < 0.3}
    removed = brute_removed(kept)
    kept = {i: without(t, removed.get(i, [])) for i, t in kept.items()}
    kept = {i: t for i, t in kept.items() if i not in removed or t.strip()}
    order = sorted(kept)
    groups = brute_links([kept[i] for i in order])
    final = {i: kept[i] for at, i in enumerate(order) if groups[at][1] in (None, at)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(final)
    names = {i: n for n, i in enumerate(sorted(final))}
    rename = [type("Piece", (), {**r.asDict(), "doc_id": names[r.doc_id]}) for r in got]
    assert check_packing(rename, [final[i] for i in sorted(final)], 2048) <= -(-sum(r.length for r in got) // 2048) * 1.05 + 1


def test_empty_input(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
