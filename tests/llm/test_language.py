import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strataloom.llm import language as L

SAMPLES = "/root/testdata/sf0.001/language_samples.parquet"


@pytest.fixture(scope="module")
def samples():
    return pd.read_parquet(SAMPLES)


@pytest.fixture(scope="module")
def model(samples):
    return L.Model(samples.text.tolist(), samples.lang.tolist())


def test_held_out(samples):
    half = np.random.default_rng(0).random(len(samples)) < 0.5
    m = L.Model(samples.text[half].tolist(), samples.lang[half].tolist())
    got = L.segment_batch(m, samples.text[~half].tolist())
    right = [len(g) == 1 and g[0][2] == lang for g, lang in zip(got, samples.lang[~half])]
    assert np.mean(right) >= 0.98


def test_mixed_texts(samples, model):
    rng = np.random.default_rng(1)
    rows = [samples.sample(3, random_state=int(s)) for s in rng.integers(1, 1000, 60)]
    bad = 0
    for r in rows:
        got = L.segment_batch(model, [" ".join(r.text)])[0]
        want = [x for i, x in enumerate(r.lang) if i == 0 or x != r.lang.iloc[i - 1]]
        bad += [g[2] for g in got] != want
        assert got[0][0] == 0 and got[-1][1] == len(" ".join(r.text))
        assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(got, got[1:]))
    assert bad <= 2


def test_single_terms_make_no_segment(model):
    text = "共用的檔案庫已經遺失每一段提到cold storage的文字。頁面索引正在比對cold storage的文字。"
    assert [s[2] for s in L.segment_batch(model, [text])[0]] == ["zh-tw"]


def test_code_and_odd_texts(model):
    texts = ["```\n# keep the page order of every note once\n```\n", "   ", "", "123 456", "😀", "İİİ iii", "a" * 30000]
    got = L.segment_batch(model, texts)
    assert got[0] == [] and got[1] == [] and got[3] == []
    for t, g in zip(texts, got):
        assert not g or g[-1][1] == len(t)


def test_labels(spark):
    want = {
        "en": "en", "EN": "en", "en-US": "en", "en_GB": "en", "eng": "en", "english": "en", "English": "en", "Deutsch": "de", "ger": "de", "deu": "de", "fre": "fr", "français": "fr",
        "zh-TW": "zh-tw", "zh_Hant": "zh-tw", "zh-Hant-TW": "zh-tw", "繁體中文": "zh-tw", "日本語": "ja", "jpn": "ja", " pt-BR ": "pt", "dut": "nl",
        "??": None, "": None, "none": None, "n/a": None, "mul": None, "und": None, "sql": None, "python": None, "default": None, "text/plain": None, "xx": None, "-": None, "unknown": None, "auto": None,
    }
    df = spark.createDataFrame([(k,) for k in want] + [(None,)], "l string")
    got = {r["l"]: r["c"] for r in df.withColumn("c", L.label_language(F.col("l"))).collect()}
    assert got == {**want, None: None}


def test_frames(spark, model, samples):
    rows = [("a", samples.text[0], 1), ("b", None, 2), ("c", "", 3), ("d", " \n", 4), ("a", samples.text[0], 1)]
    df = spark.createDataFrame(rows, "chunk_uid string, content string, seg_no int")
    got = L.segments(df, "chunk_uid", "content", model).collect()
    assert [r["chunk_uid"] for r in got] == ["a", "a"]
    assert L.segments(df.where("false"), "chunk_uid", "content", model).collect() == []
