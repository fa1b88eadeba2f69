import duckdb
import pytest

import __spark_entry__ as entry
import check

QUICK = (
    "io6_register_model", "f2_sample_fraction", "f6_stage_counts", "t2_strip_html",
    "t18_clean_classical", "l7_prepare_reviews", "s3_split_train_val_test", "x7_tfidf",
    "e6_classification_report", "q3_describe_all",
)


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # the optional training-data queries have tests of their own
    names = set(entry.queries()) - set(entry.LLM_QUERIES)
    without = names - set(entry.oracle_sql())
    assert without == {
        "m2_fit_logistic", "m3_fit_vectors", "m4_predict", "m5_predict_proba", "m6_train",
        "p1_predict_ids", "p2_predict_with_labels", "p3_predict_with_probabilities",
        "p5_score_requests", "p6_score_stream", "e8_evaluate_model", "e11_holdout",
    }


def test_flagship(spark):
    assert {r["label"] for r in entry.entry(spark).collect()} == {0, 1}


@pytest.mark.parametrize("name", QUICK)
def test_against_sql(spark, sf, name):
    db = duckdb.connect()
    for table in ("documents", "labels", "pages", "events"):
        db.execute(f"CREATE VIEW {table} AS FROM '{sf}/{table}.parquet'")
    df = entry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    res = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in res.description]
    assert sorted(names) == columns
    want = [tuple(row[names.index(c)] for c in columns) for row in res.fetchall()]
    assert check.compare(got, want) is None
