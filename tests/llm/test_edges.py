"""Every operator on odd rows, extra columns and empty tables: nothing breaks, and rows are as the docstrings say."""

import public_tokenizers
import pytest

from tarnwave.llm import decontaminate, licenses, media, near_dedup, pii, piece_codec, quality, repeats, token_counts, toxicity

from .fixtures import frame, odd_rows, prose

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")


def tagger():
    rows = [(prose(i, 60) + (" vile" if i % 2 else ""), bool(i % 2)) for i in range(300)]
    return toxicity.train([t for t, _ in rows], [b for _, b in rows], toxicity.ToxicityRules())


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 0), (6, 0, 1), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


ONE_ROW_EACH = {
    "pii": lambda s, d: pii.find_pii(d),
    "tokens": lambda s, d: token_counts.prefix_counts(d, WORDS, 100),
    "media": lambda s, d: media.store_media(d),
    "near": lambda s, d: near_dedup.near_groups(d),
    "toxicity": lambda s, d: toxicity.score_toxicity(d, tagger()),
    "quality": lambda s, d: quality.score_quality(d, labels(s), "host", "path"),
    "repeats": lambda s, d: repeats.without_repeats(d),
    "pieces": lambda s, d: piece_codec.encode_texts(d, PIECES),
}


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_one_row_for_each(spark, name):
    rows = odd_rows()
    got = ONE_ROW_EACH[name](spark, frame(spark, rows)).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r["doc_id"] for r in got), key=key) == sorted((i for i, _ in rows), key=key)


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_empty_table(spark, name):
    assert ONE_ROW_EACH[name](spark, frame(spark, [])).collect() == []


def test_searches_on_odd_rows_and_empty_tables(spark):
    odd, none = frame(spark, odd_rows()), frame(spark, [])
    items = spark.createDataFrame([(1, prose(1, 80)), (2, None), (3, ""), (4, "x"), (None, prose(2, 40)), (1, prose(1, 80))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(odd, items).collect()}
    assert {(1, 1), (8, 1), (5, 4), (None, None)} <= got
    assert decontaminate.find_leaks(none, items).collect() == []
    assert decontaminate.find_leaks(odd, items.limit(0)).collect() == []
    assert licenses.scan_licenses(odd).collect() == []
    assert licenses.scan_licenses(none).collect() == []


STAGES = {
    "toxicity": lambda s, d: toxicity.filter_toxic(d, tagger(), 0.7),
    "near": lambda s, d: near_dedup.one_of_each(d),
    "leaks": lambda s, d: decontaminate.without_leaks(d, s.createDataFrame([(1, prose(11, 60))], "item_id long, text string")),
    "pii": lambda s, d: pii.redact(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns(spark, name):
    docs = frame(spark, odd_rows())
    out = STAGES[name](spark, docs)
    assert out.columns == docs.columns
    assert set(out.select("doc_id").distinct().toPandas()["doc_id"].dropna().astype(int)) >= {2, 3, 4, 6, 7, 9, 10}
    assert STAGES[name](spark, frame(spark, [])).collect() == []
