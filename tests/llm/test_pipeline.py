"""The pipeline on a folder of small tables."""

import corpus_pipeline
from opinara.llm import packing


def test_stages(spark, tmp_path):
    long = "the quick brown fox jumps over the lazy dog while many small birds sing in old trees near a quiet river today"
    leak = "What colour is the sky above the northern hills in early winter before the snow begins to fall? Mostly a pale grey blue."
    docs = [(k, f"clean text number {k} with words about things", "en", "s", 1) for k in range(60)]
    docs += [(100 + k, f"clean text number {k} with words about things vile fool", "en", "s", 1) for k in range(60)]
    docs += [(200, long, "en", "s", 1), (201, long, "en", "s", 1), (202, f"{long} again", "en", "s", 1), (203, f"Some words first. {leak} And more words follow.", "en", "s", 1), (204, "write to me@mail.example.com now please my dear old friend", "en", "s", 1), (205, None, None, None, None), (206, "", None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k >= 100)) for k in [*range(60), *range(100, 160)]], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {r["doc_id"] for r in rows}
    assert kept == {*range(60), 200, 204, 205, 206}
    mail = [t for r in sorted((r for r in rows if r["doc_id"] == 204), key=lambda r: r["start"]) for t in r["tokens"]]
    assert mail == [*packing.encode("write to <EMAIL> now please my dear old friend", packing.paths()[0]), packing.END]
    assert [r["tokens"] for r in rows if r["doc_id"] == 205] == [[packing.END]]
