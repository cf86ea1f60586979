import corpus_pipeline as C
from tests.llm import samples
from veriflate.llm import minhash, quality
from veriflate.llm.common import store


def tables(spark, tmp_path, pairs):
    samples.frame(spark, pairs).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1) for i, _ in pairs if i is not None and i % 2], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages(spark, tmp_path):
    rng = samples.random.Random(7)
    pairs = samples.odd() + samples.texts(5, 200) + [(900, "mail me at someone@mail.example.com " + " ".join(samples.words(rng, 40)))]
    where = tables(spark, tmp_path, pairs)
    docs = spark.read.parquet(where + "/documents.parquet")
    seen = {}
    for name, stage in C.STAGES:
        before, docs = docs, store(stage(spark, docs, where), name)
        seen[name] = [r.asDict() for r in docs.collect()]
        if name != "packing":
            assert tuple(docs.columns) == C.COLUMNS
        if name == "quality":
            judged = {r.doc_id: r.kept for r in quality.judge(before, spark.read.parquet(where + "/labels.parquet")).collect()}
            assert {r["doc_id"] for r in seen[name]} == {i for i, k in judged.items() if k}
        if name == "near_duplicates":
            kept = {r.doc_id for r in minhash.near_duplicates(before).collect() if r.kept}
            assert {r["doc_id"] for r in seen[name]} == kept
    text = {r["doc_id"]: r for r in seen["personal_data"]}
    assert text[900]["text"].startswith("mail me at <email> ") and text[900]["n_chars"] == len(text[900]["text"])
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["mixing"]}


def test_run_and_empty(spark, tmp_path):
    where = tables(spark, tmp_path, [])
    assert C.run(spark, where).count() == 0


def test_run_is_its_stages_one_after_the_other(spark, tmp_path):
    rng = samples.random.Random(8)
    a, b, c = (" ".join(samples.words(rng, 60)) for _ in range(3))
    # One id has several texts; copies of them have ids of their own.
    pairs = samples.texts(9, 60) + [(903, a), (905, a), (905, b), (909, b), (None, c), (None, None), (910, c)]
    where = tables(spark, tmp_path, pairs)
    docs = spark.read.parquet(where + "/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        docs = store(stage(spark, docs, where), name)
        if name == "near_duplicates":
            texts = [(r.doc_id, r.text) for r in docs.collect()]
    # 903, 905 and 909 are one group, of which the smallest id stays.
    assert (903, a) in texts and not {905, 909} & {i for i, _ in texts}
    # Rows without an id are no copies of others.
    assert (None, c) in texts and (910, c) in texts
    want = sorted(map(str, docs.select("doc_id", "text").collect()))
    whole = {}
    for r in C.run(spark, where).collect():
        whole.setdefault(r.doc_id, []).append(r)
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert set(whole) == set(ids) and len(want) == len(ids)
    for i, pieces in whole.items():
        # Each time a document comes, its pieces cover it once.
        if i is not None:
            assert sum(p.length for p in pieces) == ids.count(i) * pieces[0].doc_tokens
    sequences = {}
    for pieces in whole.values():
        for p in pieces:
            sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
