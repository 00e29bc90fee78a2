"""The pipeline's stages one after another, against plain Python where the tools differ."""

import re

import corpus_pipeline


def _through(spark, docs, stages):
    out = []
    for _, stage in stages:
        docs = stage(spark, docs, "")
        out.append(docs)
    return out


def test_stages(spark):
    def prose(k, n=60):
        return " ".join(f"{'abcdefghij'[(i * (7 + k) + k) % 10]}word{(i * i * (3 + k) + k) % 997}x" for i in range(n))

    passage = prose(50, 55)
    secret = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'
    rows = [
        (1, prose(1)), (2, prose(2) + "\n" + passage), (3, prose(3) + "\n" + passage + "\n" + prose(4)),
        (4, prose(1)), (5, prose(6, 80).replace(" ", "### ")), (6, "too short"),
        (7, prose(7) + " " + secret), (8, prose(8, 90)), (9, prose(8, 90) + " extra"), (10, None),
    ]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    quality, lines, near, secrets, packed = (
        [df.collect() for df in _through(spark, docs, corpus_pipeline.STAGES)]
    )
    ids = lambda rows: sorted(r.doc_id for r in rows)
    assert ids(quality) == [1, 2, 3, 4, 7, 8, 9]
    assert ids(lines) == [1, 2, 3, 7, 8, 9]  # all of 4 is a copy of 1
    text = {r.doc_id: r.text for r in lines}
    assert text[2].endswith(passage) and text[3] == prose(3) + "\n" + prose(4)
    assert ids(near) == [1, 2, 3, 7, 8]
    assert ids(secrets) == ids(near)
    clean = {r.doc_id: r.text for r in secrets}
    assert clean[7] == prose(7) + ' [SECRET]"' and not re.search("24be64", str(clean))
    assert all(r.n_chars == len(r.text) for r in [*lines, *secrets])
    assert {r.doc_id for r in packed} == set(ids(near))


def test_columns_with_names_of_the_operators(spark):
    def prose(k, n=60):
        return " ".join(f"{'abcdefghij'[(i * (7 + k) + k) % 10]}word{(i * i * (3 + k) + k) % 997}x" for i in range(n))

    secret = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, prose(1)), (2, prose(1)), (3, "too short"), (4, prose(7) + f' token = "{secret}"')]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t), True, 5, [], [], "b") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_deleted int,"
        " all_spans array<struct<kind:string,rank:int,start:int,end:int>>, base_spans array<string>, body string",
    )
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, "")
    deduped = stages["line dedup"](spark, docs, "")
    clean = stages["secret scans"](spark, docs, "")
    assert kept.columns == deduped.columns == clean.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 4]
    assert sorted(r.doc_id for r in deduped.collect()) == [1, 3, 4]
    rows = clean.collect()
    assert secret not in str(rows) and "[SECRET]" in str(rows)
    assert all(r["kept"] and r.n_deleted == 5 and r.all_spans == [] and r.body == "b" for r in rows)


def test_no_documents(spark):
    docs = spark.createDataFrame(
        [], "doc_id long, text string, lang string, source string, n_chars long"
    )
    assert all(df.count() == 0 for df in _through(spark, docs, corpus_pipeline.STAGES))


def test_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    packed = corpus_pipeline.run(spark, sf_dir)
    assert packed.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "line dedup", "n-gram Jaccard join", "secret scans", "packing",
    ]
