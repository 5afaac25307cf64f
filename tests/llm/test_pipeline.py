import brute

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, now = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == columns
        now = now.persist()
        kept[name] = [(r.doc_id, r.text) for r in now.collect()]
    whole = {r.doc_id: r.text for r in docs.collect()}
    good = kept["quality rules"]
    assert all(not brute.quality(t)[5] for _, t in good)
    found = brute.copies(good)
    assert sorted(kept["exact dedup"]) == sorted((i, whole[i]) for i in found if found[i][2])
    prints = sorted((i, brute.simhash(t)) for i, t in kept["exact dedup"])
    comps = brute.linked(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert sorted(i for i, _ in kept["simhash near-dedup"]) == sorted(set(comps.values()))
    mixed = sum(len(brute.words(t)) for _, t in kept["mixing sources"])
    size = sum(len(brute.words(t)) for _, t in kept["simhash near-dedup"])
    assert abs(mixed / (1.5 * size) - 1) < 0.05
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF).collect()
    assert len({r.sequence_id for r in packed}) <= -(-sum(r.length for r in packed) // 2048) + 1


def test_run_on_an_empty_table(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
