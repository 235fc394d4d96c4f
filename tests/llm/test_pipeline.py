"""The stages one after another, each against brute force on its own input."""

import random
import re

import corpus_pipeline as pipeline
from sparkseries.llm import language, mixing

from .test_corpus_operators import brute_components, raw, repeats


def test_stages(spark, rows, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, columns)
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language", "near_copies", "repeated_strings", "source_mix", "packing"]
    model = language.learn(docs)
    seen = {"": docs.collect()}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
    assert sorted(map(str, seen["language"])) == sorted(str(r) for r in seen[""] if model.predict(r.text)[0] != "und" and model.predict(r.text)[1] >= 0.5)
    parts = brute_components(seen["language"])
    assert sorted(r.doc_id for r in seen["near_copies"]) == sorted(i for i, (_, _, kept) in parts.items() if kept)
    before = sorted(seen["near_copies"], key=lambda r: r.doc_id)
    left = [bytes(b for b, x in zip(raw(r.text), c, strict=True) if not x).decode("utf-8", "ignore") for r, c in zip(before, repeats([raw(r.text) for r in before]), strict=True)]
    after = sorted(seen["repeated_strings"], key=lambda r: r.doc_id)
    assert [r.text for r in after] == left and [r.n_chars for r in after] == [len(t) for t in left]
    words = lambda rs: sum(len(re.findall(mixing.WORD.encode(), raw(r.text))) for r in rs)
    assert 0.5 * words(after) < words(seen["source_mix"]) <= words(after)
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["source_mix"]}


def test_run_over_a_table(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() > 0


def test_repeated_passages_shorter_than_the_strings_go(spark, tmp_path):
    """Passages of 51 to 58 words and fewer than 400 bytes go from two documents that share them; what stands beside them, and one of 45 words, stays."""
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows, want = [], {}
    for n in (51, 52, 55, 58, 45):
        passage = words(n)
        assert len(passage) < 400
        for _ in range(2):
            before, after = words(90), words(90)
            want[len(rows)] = f"{before} {after}" if n > 50 else f"{before} {passage} {after}"
            rows.append((len(rows), f"{before} {passage} {after}", "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = pipeline.repeated_strings(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id: " ".join(r.text.split()) for r in out} == want and all(r.n_chars == len(r.text) for r in out)
