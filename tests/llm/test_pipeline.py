import brute
import corpus_pipeline as cp
from mnemoscope.llm.toxicity import toxicity
from test_decontaminate import plain_coverage, plain_words
from test_near_dedup import plain_classes


def seeds(text):
    words = plain_words(text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def collected(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_on_table(spark, small, tmp_path):
    """Each stage against a plain version on what the stage before kept."""
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), {}
    for i, (name, stage) in enumerate(cp.STAGES):
        before = collected(docs)
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        after = kept[name] = collected(docs)
        assert len(after) == docs.count()
        if name == "toxicity":
            score = collected(toxicity(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")))
            assert set(after) == {d for d in before if not score[d].predicted}
        elif name == "line dedup":
            want = brute.line_dedup([(d, r.text) for d, r in before.items()])
            assert {d: r.text for d, r in after.items()} == {d: w[2] for d, w in want.items()}
            assert all(r.n_chars == len(r.text) for d, r in after.items() if want[d][1])
        elif name == "MinHash near-dedup":
            classes = plain_classes([(d, r.text) for d, r in before.items()])
            assert set(after) == set(classes.values())
        elif name == "benchmark decontamination":
            items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
            gone = set(before) - set(after)
            assert gone and all(max(plain_coverage(before[d].text, x) for x in items) >= 0.5 for d in gone)
            runs = [(x, seeds(x)) for x in items]
            for d in after:
                own = seeds(after[d].text)
                assert all(plain_coverage(after[d].text, x) < 0.5 for x, r in runs if own & r)
        if i < len(cp.STAGES) - 1:
            assert docs.columns == list(cp.COLUMNS)
    assert set(kept["packing"]) == set(kept["benchmark decontamination"])


def test_run_and_odd_rows(spark, small, tmp_path):
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = [(1, None, "en", "a", 0), (2, "", None, None, 0), (3, "same words in both of these texts", "en", "b", 33), (4, "same words in both of these texts", "en", "b", 33), (None, "own words here", "en", "b", 14), (5, "long " * 40_000, "en", "b", 200_000)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(r.doc_id or 0 for r in cp.run(spark, str(tmp_path)).collect())
    assert got == [0, 1, 3, 5]
    made.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
