"""The stages on a small table whose rejected and changed rows are known."""

import random

import corpus_pipeline


def test_stages_and_whole_run(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    text = lambda n=80: " ".join(word() for _ in range(n))
    item = text(40)
    rows, toxic, copies, leaked = [], set(), set(), set()
    for i in range(240):
        body = text()
        if i % 4 == 0:
            toxic.add(i)
            body = f"{body} grubworm {text(10)}"
        elif i % 40 == 1:
            body = f"{body} {item} {text(5)}"
            leaked.add(i)
        rows.append([i, body, "en", "s", len(body)])
    for i in range(240, 252):
        original = rows[2 + 4 * (i - 240)]
        rows.append([i, original[1] + " more", "en", "s", 0])
        copies.add(i)
    rows += [[300, None, "en", None, None], [301, "", None, "s", 0], [302, "Write to me@x.org now", "en", "s", 21], [None, "no id here", "en", "s", 10]]
    rows += [[303, "again", "en", "s", 5]] * 2
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] in toxic)) for r in rows if r[0] is not None and r[0] < 240], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS), name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = [r[0] for r in rows if r[0] not in toxic | copies | leaked]
    assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 if i is not None else -1 for i in kept)
    texts = {r.doc_id: r.text for r in got}
    assert texts[302] == "Write to [EMAIL] now" and texts[None] == "no id here" and texts[300] == texts[301] == ""
    assert all(len(r.ids) > 0 for r in got if r.text)
