import pytest

from loomgrain.llm import queries as Q
from tests.conftest import DATA
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    assert_same(Q.queries()[name](spark, DATA).toPandas(), duck.execute(Q.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = Q.queries()[name](spark, DATA)
    assert df.columns and df.count() >= 0


def test_leaks_equal_a_plain_scan(spark):
    from loomgrain.llm.leakage import words

    d = spark.read.parquet(f"{DATA}/documents.parquet").dropna(subset=["text"]).collect()
    wanted = {}
    for r in spark.read.parquet(f"{DATA}/eval_items.parquet").collect():
        w = words(r.text)
        for i in range(len(w) - 12):
            wanted.setdefault(tuple(w[i : i + 13]), set()).add(r.item_id)
    true = {(r.doc_id, item) for r in d for w in [words(r.text)] for i in range(len(w) - 12) for item in wanted.get(tuple(w[i : i + 13]), ())}
    assert {(r.doc_id, r.item_id) for r in Q.p8_found(spark, DATA).collect()} == true and true


def test_look_alikes_equal_a_plain_grouping(spark):
    from loomgrain.llm.visual_form import skeleton

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").dropna(subset=["text"]).collect()}
    forms = {i: skeleton(t) for i, t in rows.items()}
    true = {(a, b) for a in rows for b in rows if a < b and rows[a] != rows[b] and forms[a] == forms[b] and len(forms[a]) > 60}
    assert {(r.doc_a, r.doc_b) for r in Q.p10_found(spark, DATA).collect()} == true
