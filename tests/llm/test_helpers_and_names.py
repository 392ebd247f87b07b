"""Helper columns never meet columns of the caller; bitmaps lose no row; the pipeline runs end to end."""

import random

from pyspark.sql import functions as F

from quarry.llm import common, line_dedup

CLASH = ["__th", "__cls", "__runs", "__lines", "__units", "__cut", "__id", "__of", "__keep", "__text", "__at", "__row",
         "__tox_text", "__units_cut", "__may", "__rth", "_TH", "bits"]


def test_bitmap_finds_every_hash(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    bits = common.HashBitmap(keys, "h", "t-bits")
    marked = bits.mark(spark.range(30_000).withColumn("block", F.lit("mine")), F.xxhash64("id"), "may").where("may")
    got = {r.id for r in marked.collect()}
    assert set(range(3000)) <= got and len(got) < 4500 and marked.columns == ["id", "block", "may"]
    assert common.HashBitmap(keys.limit(0), "h", "t-bits").mark(spark.range(5), F.xxhash64("id"), "may").where("may").count() == 0


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, __TH int, __th_ int")
    assert common.free_names(df, "__th", "x", "x") == ["__th__", "x", "x_"]


def test_stages_keep_clashing_columns_and_pipeline_runs(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    passage, item = say(80), say(30)
    texts = [say(60) for _ in range(40)]
    texts += [texts[0], texts[1] + " extra", f"{say(40)} {passage}.\n{say(30)}", f"{say(35)}.\n{passage} {say(45)}", say(20) + " " + item, None, ""]
    rows = [(i, t, "en", rng.choice("ab"), len(t or ""), *(f"{c}{i}" for c in CLASH)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                               + ", ".join(f"`{c}` string" for c in CLASH))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.materialize(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == df.columns
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before), name
        # every stage leaves the caller's other columns as they were
        assert all(tuple(after[i][c] for c in CLASH) == tuple(f"{c}{i}" for c in CLASH) for i in after), name
    # copy 40 and the leaked 44 go, 41 keeps what it adds; of the passage told twice one telling stays
    assert set(range(47)) - set(after) == {40, 44} and len(after[41].text) < len(texts[41]) and after[41].text.endswith("extra")
    assert passage in after[42].text and passage not in after[43].text and after[43].n_chars == len(after[43].text)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(after)


def test_lines_and_passages_equal_their_plain_meaning(spark):
    """Line windows against a plain dictionary of windows, with the two-step count and the bitmap between."""
    rng = random.Random(2)
    lines = [f"line {i} of some length to count" for i in range(40)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 12)))) for i in range(150)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    seen, want = set(), {}
    for i, t in rows:
        part = t.split("\n")
        gone = set()
        for k in range(len(part) - 2):
            w = tuple(part[k:k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        want[i] = ("\n".join(x for k, x in enumerate(part) if k not in gone), len(gone))
    assert {i: (r.text, r.n_removed) for i, r in got.items()} == want


def test_batch_limits_of_the_session_stay(spark):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(rows), spark.conf.get(size)
    try:
        spark.conf.unset(size)
        spark.conf.set(rows, "777")
        common.small_batches(spark)
        assert spark.conf.get(rows) == "777" and spark.conf.get(size) == "4194304b"
    finally:
        spark.conf.set(rows, before[0]), spark.conf.set(size, before[1])
