import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewater.llm import tokens


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(tokens.vocabulary_path())


TEXTS = [
    None, "", " ", "\n", "  two  spaces ", "don't we'll I'VE 's !'s ?'re", "<|endoftext|> ordinary", "a  b　c  d\x85e\x1cf", "遅れて届いた行は次の集計で加算されます。",
    "é́ 😀👩‍👩‍👧 ½Ⅳ", "x" * 70_000, "中" * 20_000, " " * 5_000 + "end", "0x1f2e3d 1,234.5e-9 snake_case CamelCase\t\ttab\r\n", "'" * 300, "​​zero", "�﻿", "अ आ कतार भरी है",
]


@pytest.mark.parametrize("text", TEXTS)
def test_cases(enc, text):
    assert enc.encode(text) == enc.plain.encode_ordinary(text or "")


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet=" \n\t' 　\x85\x1casdtrevml12.,!-é中😀", max_size=30))
def test_any_text(enc, text):
    text = text.encode("utf-8", "ignore").decode()
    assert enc.encode(text) == enc.plain.encode_ordinary(text)


def test_cuts_are_used_and_a_full_cache_is_no_matter(enc, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    text = "The write buffer of beacon-gateway rejected 56,195 rows. " * 50
    data = text.encode()
    import numpy as np

    assert len(enc.cuts(np.frombuffer(data, dtype=np.uint8))) > 500
    assert enc.encode(text) == enc.plain.encode_ordinary(text)


def test_sliced_arrays_with_nulls(enc):
    a = pa.array(["drop", None, "a b", "", "c"]).slice(1, 3)
    assert enc.encode_lists(a).to_pylist() == [[], enc.encode("a b"), []] and enc.encode_sizes(a).tolist() == [0, 2, 0]


def test_column(spark, monkeypatch):
    rows = [(i, t, "k", 0) for i, t in enumerate(TEXTS)] + [(None, "no key", "k", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string, ids int").repartition(3)
    got = {r.doc_id: r.ids for r in tokens.encode_column(df, "doc_id", "text").collect()}
    hf = Tokenizer.from_file(tokens.vocabulary_path("byte_bpe_50k.json"))
    hf.encode_special_tokens = True
    assert got == {i: hf.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    sizes = {r.doc_id: r.n_tokens for r in tokens.count_column(df, "doc_id", "text").collect()}
    assert sizes == {k: len(v) for k, v in got.items()}
    assert "Exchange" not in tokens.encode_column(spark.range(1).selectExpr("id", "'x' t"), "id", "t")._jdf.queryExecution().executedPlan().toString()


def test_empty(spark):
    assert tokens.encode_column(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0
