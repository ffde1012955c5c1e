"""The pipeline, stage by stage, against brute force on a small corpus."""

from __future__ import annotations

import importlib.util
import random
from pathlib import Path

import public_tokenizers
import pytest

from tellwise.llm.bpe import encoding
from tellwise.llm.decontaminate import words
from tellwise.llm.toxicity import toxicity_scores

pytestmark = pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline here")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(3, 8))) for _ in range(500)]

    def line(n):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    items = [line(30) for _ in range(3)]
    rows = []
    for i in range(150):
        lines = [line(rnd.randint(5, 30)) for _ in range(rnd.randint(1, 5))]
        if i % 3 == 0:
            lines.append("what a vexatious blatherer and pillock you are " + line(4))
        if i % 10 == 1:
            lines.insert(0, items[i % 3])
        if i % 10 == 2 and rows:
            lines[0] = rnd.choice(rows)[1].split("\n")[0]
        if i % 10 == 4 and rows:
            lines = rnd.choice(rows)[1].split("\n")
            lines[-1] = " ".join(lines[-1].split(" ")[:-1] + ["zzz"])
        rows.append((i, "\n".join(lines)))
    rows += [(150, None), (151, "")]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def _load(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_stages_decide_as_brute_force_does(spark, folder, tmp_path):
    from corpus_pipeline import STAGES, run

    lines, join = _load("test_line_dedup"), _load("test_ngram_join")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        result = stage(spark, docs, folder)
        if name != "byte_bpe":
            assert result.columns == columns
            result.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            results[name] = before, {r.doc_id: r.text for r in docs.collect()}
        else:
            results[name] = before, {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in result.collect()}

    before, after = results["toxicity"]
    scores = {r.doc_id: r.score for r in toxicity_scores(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert after == {d: t for d, t in before if scores[d] < 0.5}
    assert not any("pillock" in (t or "") for t in after.values()) and 90 <= len(after) <= 110
    before, after = results["line_dedup"]
    gone = dict(lines.brute(before))
    assert {d: t or "" for d, t in after.items()} == {d: "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone[d]) for d, t in before}
    before, after = results["ngram_join"]
    assert sorted(after) == sorted({r[1] for r in join.brute(before)})
    before, after = results["decontamination"]
    items = [words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + 13]) for w in items for i in range(len(w) - 12)}

    def dirty(text):
        w = words(text)
        hit = {p for i in range(len(w) - 12) if tuple(w[i:i + 13]) in windows for p in range(i, i + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert after == {d: t for d, t in before if not dirty(t)} and len(after) < len(before)
    before, after = results["byte_bpe"]
    tokenizer = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert {d: n for d, (n, _) in after.items()} == {d: len(tokenizer.encode_ordinary(t or "")) for d, t in before}
    assert {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in run(spark, folder).collect()} == after


def test_empty_tables_and_nulls(spark, tmp_path):
    from corpus_pipeline import run

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    for folder, rows in (("a", [(i, "you pillock" if i % 2 else f"a quiet garden {i} by the river {i * 7}", None, None, None) for i in range(100)] + [(None, None, None, None, None), (200, "", "", "", 0)]), ("b", [])):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{folder}/benchmark.parquet")
    kept = run(spark, f"{tmp_path}/a").collect()
    assert {r.doc_id for r in kept} & set(range(1, 100, 2)) == set() and 45 <= len(kept) <= 52
    assert run(spark, f"{tmp_path}/b").collect() == []
