import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwave.llm.piece_codec import PieceCodec, encode_texts
from tarnwave.llm.token_counts import PrefixCounter, prefix_counts, tokens_at

from .fixtures import frame, odd_rows, prose

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXT = st.text(st.sampled_from("abtheinr'sdllvm .\n1é²́Σß日🙂▁<|>\x85\x1e"), max_size=60)
codec, counter = PieceCodec(PIECES), PrefixCounter(WORDS)
library, words = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_pieces_equal_the_library(texts):
    ids, n = codec.encode(texts)
    own = np.split(ids, np.cumsum(n)[:-1]) if texts else []
    for t, x in zip(texts, own, strict=True):
        assert x.tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert codec.decode(x) == library.decode(x.tolist())


def test_long_words_without_spaces():
    r = random.Random(3)
    texts = ["".join(r.choices("ethnias", k=4000)), "a" * 3000, " " * 70, "日本" * 500]
    ids, n = codec.encode(texts)
    for t, x in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert x.tolist() == library.encode(t, add_bos=True, add_eos=True)


def test_piece_table(spark):
    got = {r["doc_id"]: r for r in encode_texts(frame(spark, odd_rows()[:7]), PIECES).collect()}
    assert got[2]["ids"] == [1, 2] and got[3]["decoded"] == "" and got[6]["decoded"] == prose(9, 30_000)
    assert got[1]["ids_sha256"] == hashlib.sha256(np.array(library.encode(prose(1, 80), add_bos=True, add_eos=True), "<u4").tobytes()).hexdigest()


@settings(max_examples=100, deadline=None)
@given(TEXT)
def test_every_prefix(text):
    table, n, tokens = counter.tables([text])
    low = counter.cut(text)[0]
    assert tokens[0] == len(words.encode(text, add_special_tokens=False).ids)
    if not any(s in text for s in counter.special):
        assert len(low) == n[0]
        assert table.tolist() == [len(words.encode(low[:i], add_special_tokens=False).ids) for i in range(1, len(low) + 1)]


def test_special_strings_count_once():
    assert counter.tables(["a<|endoftext|>b"])[2][0] == len(words.encode("a<|endoftext|>b", add_special_tokens=False).ids) == 3


def test_budget_answers(spark):
    text = prose(5, 300)
    got = prefix_counts(frame(spark, [(1, text), (2, None)]), WORDS, 100).withColumn("half", tokens_at(F.col("prefix_tokens"), F.lit(500))).orderBy("doc_id").collect()
    table = got[0]["prefix_tokens"]
    assert got[0]["n_tokens"] == table[-1] and got[0]["half"] == table[499]
    assert got[0]["fits"] == max(i + 1 for i, c in enumerate(table) if c <= 100)
    assert (got[1]["n_tokens"], got[1]["fits"], got[1]["half"]) == (0, 0, 0)
