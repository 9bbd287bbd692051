import pyarrow.parquet as pq

import corpus_pipeline
from tessella.llm import minhash, mixing, store, toxicity

from .test_decontaminate import brute as leaks
from .test_minhash import brute as groups
from .test_shards import whole

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    texts = dict(zip(t["doc_id"], t["text"], strict=True))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = store.written(stage(spark, docs, SF), name)
        seen.append(docs)
        if name != "sharding":
            assert docs.columns == columns
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    raw = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(toxicity.training_rows(raw, spark.read.parquet(f"{SF}/labels.parquet")))
    assert set(ids[0]) == {r.doc_id for r in toxicity.score(raw, model).collect() if not r.predicted}
    kept = {r[0] for r in groups({i: texts[i] for i in ids[0]}, 5, 80) if r[3]}
    assert set(ids[1]) == kept
    items = list(zip(*pq.read_table(f"{SF}/benchmark.parquet", columns=["item_id", "text"]).to_pydict().values(), strict=True))
    found = {d for d, _ in leaks([(i, texts[i]) for i in ids[1] if len(texts[i]) < 20_000], items)}
    assert {i for i in ids[2] if len(texts[i]) < 20_000} == {i for i in ids[1] if len(texts[i]) < 20_000} - found
    assert sorted(ids[3]) == sorted(ids[2]) == sorted(ids[4]) and ids[3] != sorted(ids[3])
    last = seen[4].collect()
    assert all(r.text == texts[r.doc_id] for r in last)
    whole(last, 1)
    files = seen[3].select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    in_order = [r.doc_id for r in sorted(files, key=lambda r: (r.file_name, r.row_index))]
    assert [r.doc_id for r in sorted(last, key=lambda r: r.slot)] == in_order
    mixed = mixing.mix(seen[2]).collect()
    assert in_order == [r.doc_id for r in sorted(mixed, key=lambda r: (r.mix_slot, r.mix_rank))]


def test_no_labels_no_items(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "a b", "en", "s", 3), (2, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 3
    assert minhash.DEPTH >= 1
