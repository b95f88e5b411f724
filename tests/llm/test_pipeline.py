import re

import corpus_pipeline
from opsframe.llm import bagminhash, packing, pii, quality
from test_bagminhash import classes_by_hand
from test_packing import pieces_by_hand
from test_pii import spans_by_hand


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "personal_data", "packing"]


def test_each_stage_against_brute_force(spark, sf_dir, docs, tmp_path):
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in kept.collect()}
        kept_now = stage(spark, kept, sf_dir)
        kept_now.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        after = kept.collect()
        if name != "packing":
            assert kept.columns == docs.columns
        if name == "quality":
            model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
            assert {r.doc_id for r in after} == {i for i, s in scores.items() if s >= 0.5}
            assert all(before[r.doc_id] == r for r in after)
        elif name == "near_dedup":
            classes = classes_by_hand([(r.doc_id, r.text) for r in before.values()])
            assert sorted(r.doc_id for r in after) == sorted({c for _, c in classes})
            assert all(before[r.doc_id] == r for r in after)
        elif name == "personal_data":
            assert len(after) == len(before)
            for r in after:
                text = before[r.doc_id].text
                assert not spans_by_hand(r.text)
                assert (r.text == text) == (not re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", r.text))
                assert r.n_chars == len(r.text) if r.text != text else before[r.doc_id].n_chars
        else:
            assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after} == set(
                pieces_by_hand([(r.doc_id, r.text) for r in before.values()], packing.CAPACITY))
    assert corpus_pipeline.run(spark, sf_dir).count() == len(after)


def test_odd_tables(spark, sf_dir, odd, none):
    for df in (none, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, df, sf_dir).count() == 0
    kept = corpus_pipeline.keep_one_of_each(spark, odd, sf_dir).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == sorted(
        [(False, i) for i in (1, 3, 4, 6, 7, 8, 9, 11)] + [(True, 0)])
    masked = {r.doc_id: r for r in corpus_pipeline.mask_personal_data(spark, odd, sf_dir).collect()}
    assert masked[11].text == "mail me at [EMAIL] or [PHONE] now" and masked[11].n_chars == len(masked[11].text)
    assert masked[3].text is None and masked[1].n_chars == 1
    assert bagminhash.near_duplicates(odd).count() == odd.count() and pii.fit(none) == pii.Model()
