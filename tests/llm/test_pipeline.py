"""The pipeline's stages on a small corpus, each against what it must keep."""

import random

import pytest

import corpus_pipeline
from dueward.llm.common import stored
from tests.llm.conftest import CLASHES

QUESTION = "Yesterday the old farmer bought twelve apples and later sold five of the apples to a neighbour for seven coins each"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents by kind: clean, toxic, copy, near copy, leak, odd."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows, labels = [], []
    for i in range(200):
        t = text(60)
        if i % 4 == 0:
            for _ in range(4):
                t += " " + rng.choice(("nastyword", "vileone", "badbadbad")) + " " + rng.choice(vocabulary)
        rows.append((i, t, "en", f"src{i % 3}"))
        labels.append((i, 0, int(i % 4 == 0)))
    clean = [r for r in rows if r[0] % 4]
    rows += [(300 + k, clean[k][1].replace(" ", "  "), "en", "src0") for k in range(5)]
    long = text(3_000)
    rows += [(400, long, "en", "src1"), (401, long + " end", "en", "src1")]
    rows += [(500, f"{text(30)} {QUESTION} {text(30)}", "en", None), (501, f"{text(30)} {QUESTION.upper()} {text(5)}", "en", "src2")]
    rows += [(600, None, "en", "src2"), (601, "", None, None), (None, text(20), "en", "src0")]
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "length(text) AS n_chars", *(f"'x' AS `{c}`" for c in CLASHES))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {r[0]: r for r in rows}


def test_every_stage_keeps_what_it_must(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [set(rows)]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, folder))
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    toxic = {i for i in range(200) if i % 4 == 0}
    assert kept[0] - kept[1] == toxic
    assert kept[1] - kept[2] == {300, 301, 302, 303, 304, 601}
    assert kept[2] - kept[3] == {401}
    assert kept[3] - kept[4] == {500, 501}
    assert kept[4] == kept[5]
    mixed = docs.select("size", "source", "taken", "target", "text").collect()
    assert all(r["size"] == len((r.text or "").split()) and r.taken <= 2 * r["size"] for r in mixed)
    for source in {r.source for r in mixed}:
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1


def test_run_equals_the_stages_and_empty_tables_pass(spark, corpus, tmp_path):
    folder, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() == 200 - 50 + 1 + 1 + 1
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_are_decided_one_by_one(spark, tmp_path):
    """Rows without an id, and rows that share one, have results of their own."""
    schema = "doc_id long, text string, lang string, source string"
    words = lambda k, n: " ".join(f"w{(k * 31 + j * j) % 97}x{k}" for j in range(n))
    rows = [(None, f"{words(1, 30)} {QUESTION}"), (None, words(2, 40)), (7, f"{words(3, 30)} {QUESTION}"), (7, words(4, 11)), (7, words(5, 23)),
            (9, words(6, 12)), (8, words(6, 12)), (None, words(6, 12)), (None, words(2, 40)), (11, None)]
    spark.createDataFrame([(i, t, "en", f"s{k % 2}") for k, (i, t) in enumerate(rows)], schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    texts = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    want = lambda kept: sorted((str(rows[k][0]), str(rows[k][1])) for k in kept)
    folder = str(tmp_path)
    assert texts(corpus_pipeline.exact_dedup(spark, docs, folder)) == want((0, 1, 2, 3, 4, 6, 9))
    assert texts(corpus_pipeline.near_dedup(spark, docs, folder)) == want((0, 1, 2, 3, 4, 6, 9))
    assert texts(corpus_pipeline.drop_contaminated(spark, docs, folder)) == want((1, 3, 4, 5, 6, 7, 8, 9))
    mixed = corpus_pipeline.mix(spark, docs, folder).collect()
    assert len(mixed) == len(rows) and all(r["size"] == len((r.text or "").split()) and r.taken <= 2 * r["size"] for r in mixed)
    for source in ("s0", "s1"):
        own = [r for r in mixed if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and sum(r["size"] for r in own) == own[0].source_size
    again = corpus_pipeline.mix(spark, stored(docs.repartition(3)), folder).collect()
    key = lambda r: (str(r.doc_id), str(r.text), r.source, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, mixed))
