import public_tokenizers
import sentencepiece

from tarnwave.llm import common

from .test_near_dedup import brute


def test_stages_on_the_small_table(spark, sf):
    import corpus_pipeline

    docs = common.table(spark, sf, "documents")
    before, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.staged(stage(spark, before, sf), name)
        seen[name] = (before, after)
        if name != "sentencepiece":
            assert after.columns == docs.columns
        before = after
    near_in, near_out = ([tuple(r) for r in x.select("doc_id", "text").collect()] for x in seen["near_dedup"])
    assert {d for d, _ in near_out} == {r[0] for r in brute(near_in) if r[3]}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(tuple(r) for r in seen["sentencepiece"][0].select("doc_id", "text").collect())
    coded = seen["sentencepiece"][1].collect()
    assert {r["doc_id"]: r["ids"] for r in coded} == {d: library.encode(t, add_bos=True, add_eos=True) for d, t in texts.items()}
    assert "@" not in "".join(texts.values()) or seen["pii"][1].count() == seen["pii"][0].count()
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select("doc_id", "ids_sha256").collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in coded)


def test_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    from .fixtures import frame, odd_rows, prose

    rows = [*odd_rows(), (20, prose(20, 40) + " joe.b@mail.example.org " + prose(21, 30)), (21, prose(22, 60) + " " + prose(700, 40)), (22, prose(20, 40) + " joe.b@mail.example.org " + prose(21, 29))]
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, prose(700, 40)), (2, None), (3, "")], "item_id long, text string")
    for name, docs in (("odd", rows), ("none", [])):
        sf = str(tmp_path / name)
        frame(spark, docs).write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        items.write.parquet(f"{sf}/benchmark.parquet")
        got = corpus_pipeline.run(spark, sf).collect()
        if not docs:
            assert got == []
            continue
        # gone: 8 copies 1, 22 is near 20, 21 holds a benchmark item; the copy of 1's own row is one row
        assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 5, 6, 7, 9, 10, 20]
        text = {r["doc_id"]: r["decoded"] for r in got}
        assert "[EMAIL]" in text[20] and "@" not in text[20] and text[2] == text[3] == ""


def test_rejected_and_kept(spark, tmp_path):
    """Toxic documents and leaks go, near copies leave one, personal data is masked, clean documents stay as they are."""
    import corpus_pipeline

    from .fixtures import prose

    item = prose(900, 30)
    docs = [(i, prose(i, 60)) for i in range(300)]
    docs += [(300 + i, f"{prose(300 + i, 40)} vilewort grimsot {prose(600 + i, 20)}") for i in range(150)]
    docs += [(500 + i, prose(7, 60) + f" x{i}") for i in range(5)] + [(600 + i, f"{prose(800 + i, 20)} {item} {prose(850 + i, 20)}") for i in range(5)]
    docs += [(700, prose(950, 30) + " 10.20.30.40 " + prose(951, 30))]
    sf = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 300)) for i in range(450)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r["doc_id"]: r["decoded"] for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(got) == {*range(300), 700}
    assert all(got[i] == t for i, t in docs[:300]) and "10.20.30.40" not in got[700] and "[IP]" in got[700]
