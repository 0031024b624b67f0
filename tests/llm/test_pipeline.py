"""The pipeline against plain Python on small tables with planted cases."""

from __future__ import annotations

import random

import pytest

from tests.llm.test_words import brute_components, brute_decontaminate

P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    import tiktoken

    r = random.Random(9)
    vocabulary = [f"w{i}x" for i in range(500)]
    rows, toxic = [], {}
    for i in range(300):
        words = [r.choice(vocabulary) for _ in range(40)]
        toxic[i] = int(i % 5 == 0)
        if toxic[i]:
            for k in (3, 9, 17):
                words[k] = r.choice(["idiot", "moron", "scum"])
        rows.append([i, " ".join(words)])
    rows.append([300, rows[1][1]])
    rows.append([301, rows[2][1] + " tail"])
    rows.append([302, " ".join(rows[3][1].split()[:20]) + " password=abcdef123456 end"])
    item = " ".join(r.choice(vocabulary) for _ in range(15))
    rows.append([303, "before " + item + " after"])
    rows += [[304, None], [305, ""]]
    docs = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    got = {x.doc_id: (x.n_tokens, x.ids) for x in pipeline.run(spark, str(tmp_path)).collect()}

    kept = [(i, t) for i, t in rows if not toxic.get(i)]
    heads = brute_components(kept)
    kept = [(i, t) for i, t in kept if heads[i][1] == i]
    found = brute_decontaminate(kept, [(1, item)])
    kept = [(i, t) for i, t in kept if not found[i][1]]
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=pipeline.bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: coder.encode_ordinary((t or "").replace("password=abcdef123456", "[secret]")) for i, t in kept}
    assert got == {i: (len(ids), ids) for i, ids in want.items()}
    assert 300 not in got and 301 not in got and 303 not in got and 302 in got


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, "a b c", "en", None, 5), (2, "a b c", None, "s", 5), (None, "z", "en", "s", 1)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.dtypes == docs.dtypes, name
    assert sorted((r.doc_id or 0) for r in at.collect()) == [0, 1]


def test_near_copies_of_five_words_and_shared_ids(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(500)]
    near = [f"x{i}" if i % 45 == 2 and i < 495 else w for i, w in enumerate(words)]
    assert sum(a != b for a, b in zip(words, near, strict=True)) == 11  # 2.2 %
    other, more = ([f"{c}{i}" for i in range(60)] for c in "yz")
    rows = [(10, " ".join(words)), (11, " ".join(near)), (10, " ".join(other)), (9, " ".join([*other, "tail"])), (10, " ".join(more)), (10, " ".join(more)), (12, " ".join(more)), (13, " ".join([*more, "tail"])), (13, "alone")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((x.doc_id, x.text) for x in pipeline.drop_near_copies(spark, docs, "").collect())
    assert got == sorted([rows[0], rows[3], rows[4], rows[8]])


def test_pipeline_of_odd_tables(spark, tmp_path):
    """No documents; and columns named as stages name their own, no source, null and repeated rows, one very long text."""
    schema = "doc_id long, text string, node string, rest string, key string, score double"
    long = " ".join(f"w{i}" for i in range(60_000)) + " token=abcdefgh12345"
    rows = [(1, None, "n", "r", "k", 1.0), (2, "", None, None, None, None), (2, "", None, None, None, None), (3, long, "n", "r", "k", 2.0), (None, "no id here", "n", "r", "k", 3.0)]
    for folder, given in (("none", []), ("odd", rows)):
        path = f"{tmp_path}/{folder}"
        docs = spark.createDataFrame(given, schema)
        docs.write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
        at = spark.read.parquet(f"{path}/documents.parquet")
        for name, stage in pipeline.STAGES[:-1]:
            at = stage(spark, at, path)
            assert at.dtypes == docs.dtypes, name
        got = sorted((tuple(r) for r in at.collect()), key=str)
        want = {(i, t and t.replace("token=abcdefgh12345", "[secret]"), *more) for i, t, *more in given}
        assert got == sorted(want, key=str)  # the repeated row once
        assert len(pipeline.run(spark, path).collect()) == len(want)
