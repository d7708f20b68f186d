"""Signs that are used as marks inside, in the input."""

from readloom.operators.packed import split_packed

from .conftest import rows


def test_marks_in_the_input(spark):
    df = spark.createDataFrame([(1, "A\x1fB\x1eC;D"), (2, '"A\x1fB \x1e\x1d1\x1d";C')], "id long, f string")
    assert rows(split_packed(df, "id", "f")) == [(1, 1, "A"), (1, 2, "B"), (1, 3, "C"), (1, 4, "D"), (2, 1, "A\x1fB \x1e\x1d1\x1d"), (2, 2, "C")]
