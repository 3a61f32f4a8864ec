"""The pipeline: each stage on what its predecessor kept."""


def test_stages(spark, tmp_path):
    import random

    import corpus_pipeline

    r = random.Random(2)
    words = "the and of that with this from have which not are".split()
    make = lambda: "\n".join(" ".join(r.choice(words) + r.choice("abcdef") for _ in range(12)) for _ in range(5))
    texts = [make() for _ in range(40)]
    texts += [texts[0], texts[1].replace("\n", " "), "12345", None, "x\n" + "\n".join(texts[2].split("\n")[1:])]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({x["doc_id"] for x in docs.select("doc_id").collect()})
        assert docs.columns == columns or k == len(corpus_pipeline.STAGES) - 1
    assert kept[0] == set(range(45)) - {42, 43}
    assert kept[1] == kept[0] - {40}
    assert 41 not in kept[2] and set(range(40)) <= kept[2]
    assert all(x["round_trip"] for x in docs.collect())
    assert kept[4] == kept[3]
