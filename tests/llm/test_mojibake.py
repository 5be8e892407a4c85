import numpy as np
import pandas as pd
import pytest

from strataloom.llm import mojibake as M

SAMPLES = "/root/testdata/sf0.001/language_samples.parquet"
SCHEMA = "doc_id bigint, text string, source string, source_type string, key int, chain string"


@pytest.fixture(scope="module")
def samples():
    return pd.read_parquet(SAMPLES)


def garble(text, wrong, right="utf-8"):
    raw = text.encode(right)
    if wrong == "cp1252":
        return "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in raw)
    return raw.decode(wrong)


def restore(spark, rows, samples):
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)
    s = spark.createDataFrame(samples[["text"]])
    return {r["doc_id"]: r["restored"] for r in M.restore(df, "doc_id", "text", "source", "source_type", s).collect()}


def test_restores(spark, samples):
    by = samples.groupby("lang").text.apply(list)
    rows, want = [], {}

    def add(text, shown):
        rows.append((len(rows), shown, "s1", "note"))
        want[len(rows) - 1] = text if shown != text else None

    for lang, kinds in {"fr": ["cp1252", "mac_roman", "cp850"], "de": ["cp1252", "cp850"], "zh-tw": ["cp1252"], "ja": ["cp1252"], "ru": ["cp1252"], "pl": ["cp1252"], "es": ["cp1252"]}.items():
        for i, wrong in enumerate(kinds * 6):
            t = by[lang][i]
            add(t, garble(t, wrong))
    for t in by["es"][20:30]:
        add(t, garble(garble(t, "cp1252"), "cp1252"))
    for t in by["zh-tw"][20:28]:
        add(t, garble(t, "cp1252", "cp950"))
    for t in by["ru"][20:28]:
        add(t, garble(t, "cp1252", "cp1251"))
    for lang in by.index:
        for t in by[lang][30:40]:
            add(t, t)
    got = restore(spark, rows, samples)
    damaged = {k: v for k, v in want.items() if v is not None}
    assert set(got) <= set(damaged)
    assert sum(got.get(k) == v for k, v in damaged.items()) >= 0.97 * len(damaged)


def test_in_places(spark, samples):
    de = samples[samples.lang == "de"].text.tolist()
    rows = [(i, f"Q: {garble(de[i], 'cp1252')}\nA: {de[i + 1]}", "s", "qa") for i in range(10)]
    got = restore(spark, rows, samples)
    want = {i: f"Q: {de[i]}\nA: {de[i + 1]}" for i in range(10) if rows[i][1] != f"Q: {de[i]}\nA: {de[i + 1]}"}
    assert got == want


def test_lost_clean_and_odd(spark, samples):
    rows = [(1, "caf�", "a", None), (2, None, None, None), (3, "", None, "x"), (4, "  ", "a", "x"), (5, "plain", "a", "x"), (6, "a → b 🔥 №", None, None), (7, "É" * 40000, "a", "x")]
    got = restore(spark, rows, samples)
    assert got[1] is None and not {2, 3, 4, 5, 6} & set(got)
    assert restore(spark, [], samples) == {}


def test_odd_characters_elsewhere_hide_no_step(samples):
    model = M.CharModel(samples.text.tolist())
    tree = "src\n├── app\n│   ├── io\n│   └── ui\n└── docs\n"
    fr = "Le café est ouvert."
    shown = fr.replace("é", garble("é", "cp1252"))
    assert M.chains(tree + fr, model) == []
    name = M.chains(tree + shown, model)[0][0]
    assert M.undo_chain(tree + shown, name, model) == tree + fr


def test_other_odd_characters_outnumber_the_garbled(samples):
    model = M.CharModel(samples.text.tolist())
    fr = "Le café est ouvert. "
    for more in ("Le ⌠ est ⌡ ou ≡ ou ∙ ou ≈.", "Also Γ, Σ, Φ, Θ, Ω, δ."):
        shown = fr.replace("é", garble("é", "cp1252")) + more
        names = [n for n, _ in M.chains(shown, model)]
        assert M.undo_chain(shown, names[0], model) == fr + more


def test_weak_evidence_is_pooled(spark):
    rows = [("k1", "a", "f", "cp850>cp1252", 4.0), ("k2", "b", "f", "cp1250>cp1252", 4.0)] + [(f"s{i}", "a", "f", "cp850>cp1252", 80.0) for i in range(5)]
    ev = spark.createDataFrame(rows, "key string, source string, field string, chain string, gain double")
    sizes = spark.createDataFrame([("a", "f", 20), ("b", "f", 20)], "source string, field string, n bigint")
    got = {r["key"]: r["chain"] for r in M.posterior(ev, sizes).collect()}
    assert got["k1"] == "cp850>cp1252" and got["k2"] == "none"


def test_sources_with_only_weak_records(spark):
    rows = [(f"w{i}", "a", "f", "cp850>cp1252", 12.0) for i in range(30)] + [("x", "b", "f", "cp850>cp1252", 12.0)]
    ev = spark.createDataFrame(rows, "key string, source string, field string, chain string, gain double")
    sizes = spark.createDataFrame([("a", "f", 60), ("b", "f", 2000)], "source string, field string, n bigint")
    got = {r["key"]: r["chain"] for r in M.posterior(ev, sizes).collect()}
    assert {got[f"w{i}"] for i in range(30)} == {"cp850>cp1252"} and got["x"] == "none"


def test_replacement_characters(spark, samples):
    """Beside a letter one says that characters were lost; one that stands alone does so only where its source is full of them."""
    clean = samples[samples.lang == "en"].text.tolist()
    rows = [(1, "We met in a caf�.", "a", "note"), (2, "The sign � stands for what can't be shown.", "b", "note")]
    rows += [(100 + i, t, "b", "note") for i, t in enumerate(clean)]
    rows += [(200 + i, t + " � and so on.", "c", "note") for i, t in enumerate(clean[:30])]
    got = restore(spark, rows, samples)
    assert got[1] is None and 2 not in got
    assert {k for k in got if k >= 200} == {200 + i for i in range(30)} and not any(got[k] for k in got if k >= 200)
    assert not any(100 <= k < 200 for k in got)


def test_all_samples_count(spark, samples, monkeypatch):
    many = [f"{chr(0x4E00 + i)}{i}" for i in range(2500)]
    made, init = [], M.CharModel.__init__
    monkeypatch.setattr(M.CharModel, "__init__", lambda self, *a, **k: (init(self, *a, **k), made.append(self))[0])
    restore(spark, [(1, "Déjà vu.", "a", "note")], pd.DataFrame({"text": [*many, None]}))
    begins = np.array([ord(t[0]) for t in many])
    assert np.isfinite(made[0].both[made[0]._at(np.full(len(begins), 10), begins)]).all()
    own = M.CharModel(many)
    assert np.allclose(own.one, made[0].one) and np.array_equal(np.isfinite(own.both), np.isfinite(made[0].both))
