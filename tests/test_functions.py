import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgrain.functions import scores as S
from loomgrain.functions import similarity as M
from loomgrain.functions import text as T

SETS = [([], [], 0.5, 0.0, 1.0, 0.5), ([], [1], 0.0, 0.0, 0.0, 0.0), ([1], [], 0.0, 0.0, 0.0, 0.5), ([1, 2], [2, 1], 1.0, 1.0, 1.0, 1.0), ([1], [2], 0.0, 0.0, 0.0, 0.0), (None, [1, None, 1], 0.0, 0.0, 0.0, 0.0), ([1, 2, None, 2], [2, 3], 1 / 3, 1 / 3, 0.5, 0.5)]


def test_set_measures_keep_their_own_empty_answers(spark):
    df = spark.createDataFrame([(i, *row) for i, row in enumerate(SETS)], "i int, a array<bigint>, b array<bigint>, j double, s double, o double, c double")
    for r in df.select("*", M.jaccard("a", "b").alias("gj"), M.set_jaccard("a", "b").alias("gs"), M.overlap_coefficient("a", "b").alias("go"), M.containment("a", "b").alias("gc")).collect():
        assert (r.gj, r.gs, r.go, r.gc) == pytest.approx((r.j, r.s, r.o, r.c)), r.i


def test_signature_similarity_and_weighted_jaccard(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [1, 2, 5, 6], {1: 2.0, 2: 1.0}, {1: 1.0}), ([1], [1, 2], {}, None), ([], [], None, None)], "a array<bigint>, b array<bigint>, x map<bigint,double>, y map<bigint,double>")
    rows = df.select(M.signature_similarity("a", "b").alias("s"), M.weighted_jaccard("x", "y").alias("w")).collect()
    assert [r.s for r in rows] == [0.5, 0.0, 0.0]
    assert [r.w for r in rows] == pytest.approx([1 / 3, 0.0, 0.0])


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_lcs_length_equals_the_plain_recurrence(a, b):
    assert M.lcs_length(np.array(a, int), np.array(b, int)) == _lcs(a, b)


def test_minhash_estimates_jaccard(spark):
    a, b = list(range(0, 80)), list(range(20, 100))
    hashed = lambda xs: [(x * 2654435761 + 12345) % (1 << 60) for x in xs]
    df = spark.createDataFrame([(hashed(a), hashed(b))], "a array<bigint>, b array<bigint>")
    got = df.select(M.signature_similarity(M.minhash_signature("a", 128), M.minhash_signature("b", 128)).alias("s")).first().s
    assert abs(got - 0.6) < 0.15


def test_text_functions(spark):
    df = spark.createDataFrame([("fooBar_bazQux", 'x = "a//b"; // note\nif (y) { call.me(1); } /* c */')], "name string, code string")
    r = df.select(
        T.name_segments(F.col("name")).alias("seg"), T.call_targets(F.col("code")).alias("calls"), T.keywords_present(F.col("code")).alias("kw"),
        T.shannon_entropy(F.lit("aabb")).alias("e"), T.normalized_tokens(F.lit("while x if y // z")).alias("n"), T.directory_prefix(F.lit("a/b/c/d/e.ts")).alias("d"),
        T.fill_template(F.lit("{{n}} ${n} {n} <n>"), {"n": F.lit("v")}).alias("t"), T.names_a_secret(F.lit("userToken")).alias("s"), T.is_personal_name(F.lit("Email")).alias("p"),
    ).first()
    assert r.seg == ["foo", "Bar", "baz", "Qux"]
    assert r.calls == ["call.me"] and r.kw == ["if"]
    assert r.e == pytest.approx(1.0) and r.n == ["loop", "x", "branch", "y", "z"] and r.d == "b/c/d"
    assert r.t == "v v v v" and r.s and r.p


def test_globs():
    import re

    assert re.match(T.glob_pattern("src/**/*.ts"), "src/a/b/c.ts") and re.match(T.glob_pattern("src/**/*.ts"), "src/c.ts")
    assert not re.match(T.glob_pattern("src/*.ts"), "src/a/c.ts") and re.match(T.glob_pattern("a?.rs"), "ab.rs")


def test_scores(spark):
    df = spark.range(1)
    one = lambda c: df.select(c.alias("v")).first().v
    assert one(S.sigmoid(F.lit(0.4))) == pytest.approx(0.5)
    assert one(S.freshness(F.lit(None).cast("long"), F.lit(0))) == 1.0
    assert one(S.cross_lingual_penalty(F.lit("typescript"), F.lit("javascript"))) == 1.0
    assert one(S.cross_lingual_penalty(F.lit("rust"), F.lit("python"))) == 0.2
    assert one(S.hop_discount(F.lit(0.9), F.lit(None).cast("int"))) == pytest.approx(0.54)
    assert one(S.hop_discount(F.lit(0.2), F.lit(3))) == pytest.approx(0.2)
    assert one(S.combined_confidence(F.lit(0.25), F.lit(1.0))) == 0.5
    assert one(S.compose_confidence(F.lit(0.5), F.lit(True), F.lit(False), F.lit(None).cast("double"), F.lit(False), F.lit(True))) == pytest.approx(0.33)
    assert one(S.context_penalty(F.lit("route_handler"), F.lit("high"), F.lit("test"), F.lit("low"))) == 0.25
    assert one(S.taint_multiplier(F.lit(True), F.lit(0.1), F.lit(1.0))) == 0.5
    verdict = one(S.oracle_verdict(F.lit("differential_response"), F.lit(0.0), F.lit(0.5), F.lit(False), F.lit(0.01)))
    assert verdict.verdict == "sanitized"
    assert math.isclose(one(S.response_divergence(F.lit(200), F.lit(500), F.lit(10), F.lit(10), F.lit("a"), F.lit("b"), F.lit(6000), F.lit(0))), 0.75)
