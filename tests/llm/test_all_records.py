"""Records whose terms are all null are records."""

from readloom.llm.terms import term_table


def test_records_with_null_terms_only(spark):
    df = spark.createDataFrame([("a", "x", 5), ("b", "x", 5), (None, "y", 1), (None, "z", 1), ("b", "w", 9)], "term string, record string, amount long")
    assert {r.term: r.mark for r in term_table(df, "term", "record", "amount").collect()} == {"a": None, "b": None}
    assert {r.term: r.mark for r in term_table(df.where("record <> 'z'"), "term", "record", "amount").collect()} == {"a": None, "b": "common"}
