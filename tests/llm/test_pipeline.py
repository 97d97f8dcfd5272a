"""The pipeline against a plain version of its stages."""

import random

import corpus_pipeline
from skysift.llm import qgram_leaks, quality_rules
from tests.llm.test_documents import linked, prose


def test_run_equals_plain_stages(spark, tmp_path):
    rng = random.Random(21)
    base = prose(rng, 100)
    item = prose(rng, 40)
    rows = [(i, prose(rng, 80)) for i in range(10)]
    rows += [(10, base), (11, base), (12, base + " one more"), (13, None), (14, "short"), (15, prose(rng, 30) + " " + item + " " + prose(rng, 30))]
    rows += [(16, prose(rng, 60) + " password=abcdef123456 end"), (17, "### " * 100), (12, base + " one more")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")

    kept = {r["doc_id"] for r in quality_rules.op7(docs).where("kept").collect()}
    left = {i: t for i, t in rows if i in kept}
    groups = linked(list(left.items()))
    left = {i: t for i, t in left.items() if groups[i][1] == i}
    index = qgram_leaks.Index([(1, item)])
    left = {i: t for i, t in left.items() if not index.search(t)}
    assert set(left) == {*range(10), 10, 16}

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert set(got) == set(left)
    from skysift.llm.bpe_chunks import Encoder, default_tokenizer

    e = Encoder(default_tokenizer())
    for i, t in left.items():
        t = t.replace("password=abcdef123456", "[SECRET]")
        ids, _ = next(iter(e.batch([t])))
        assert got[i]["n_tokens"] == len(b" ".join(ids).split())
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, d)
        assert tuple(stage.columns) == corpus_pipeline.COLUMNS
