import pytest

from strataloom.operators import packed as P


def items(spark, fields, least=1):
    # a corpus in which values are known, as their code lengths need one
    common = ["alpha, beta, gamma", "alpha;beta", "beta|gamma|delta", '["alpha", "delta"]', "delta\nalpha", '"tips, tricks";alpha', "['tips, tricks', 'beta']", "call graph, alpha"] * 5
    rows = [(f"k{i}", f, "x", i) for i, f in enumerate(fields)] + [(f"z{i}", c, "x", i) for i, c in enumerate(common)]
    df = spark.createDataFrame(rows, "chunk_uid string, tags string, item string, pos int")
    got = P.unpack(df, "chunk_uid", ["tags"], least).where("chunk_uid like 'k%'").collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["chunk_uid"], r["pos"])):
        out.setdefault(int(r["chunk_uid"][1:]), []).append(r["item"])
    return [out.get(i, []) for i in range(len(fields))]


CASES = [
    ("alpha,beta", ["alpha", "beta"]),
    (",alpha,, beta ,", ["alpha", "beta"]),
    ("alpha;  beta ;alpha", ["alpha", "beta", "alpha"]),
    ('"tips, tricks"; alpha', ["tips, tricks", "alpha"]),
    ('alpha, "the ""gold"" set, old"', ["alpha", 'the "gold" set, old']),
    ('alpha|"the \\"gold\\" set, old"', ["alpha", 'the "gold" set, old']),
    ('["alpha", "ci/cd", "d\\u00e9j\\u00e0"]', ["alpha", "ci/cd", "déjà"]),
    ("['alpha', \"owner's pick\"]", ["alpha", "owner's pick"]),
    ("#alpha #beta", ["alpha", "beta"]),
    ("- alpha\n- beta", ["alpha", "beta"]),
    ("• alpha\n• beta", ["alpha", "beta"]),
    ("alpha\r\nbeta", ["alpha", "beta"]),
    ("alpha / beta", ["alpha", "beta"]),
    ("call graph / ci/cd / alpha", ["call graph", "ci/cd", "alpha"]),
    ("alpha，beta，gamma", ["alpha", "beta", "gamma"]),
    ("alpha, beta;gamma", ["alpha", "beta", "gamma"]),
    ("alpha||beta||gamma", ["alpha", "beta", "gamma"]),
    ("| alpha|beta |", ["alpha", "beta"]),
    ("[alpha, beta]", ["alpha", "beta"]),
    ("__extraction_failed__", []),
    ("", []),
    ("   ", []),
    (None, []),
    ("alpha", ["alpha"]),
    ("follow-up", ["follow-up"]),
]


def test_cases(spark):
    assert items(spark, [c for c, _ in CASES]) == [w for _, w in CASES]


def test_least(spark):
    assert items(spark, ["alpha", "alpha,beta"], 2) == [[], ["alpha", "beta"]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "chunk_uid string, tags string")
    assert P.unpack(df, "chunk_uid", ["tags"]).collect() == []


def test_long_field(spark):
    assert len(items(spark, [",".join(["alpha", "beta"] * 5000)])[0]) == 10000


@pytest.mark.parametrize("text", ['"', "''", "[", "[,]", ";;;", "\\", '"a', "#", "##", "- ", "a\\"])
def test_odd_texts(text):
    for _, values in P.parses(text):
        assert all(values)
