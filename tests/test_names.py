from hypothesis import given, settings, strategies as st

from tessera.functions.names import guess_target, slugify, slugify_col, unique_names


def test_slugify_examples():
    assert slugify(" Income ") == "income"
    assert slugify("Customer ID") == "customer_id"
    assert slugify("1st value") == "col_1st_value"
    assert slugify("%%%") == "col"
    assert slugify("Año Nuevo") == "año_nuevo"
    assert slugify("a__b--c") == "a_b_c"


def test_unique_names_no_collision():
    assert unique_names(["a", "a", "a_1"]) == ["a", "a_1", "a_1_1"]
    out = unique_names(["x", "X", "x"])
    assert len({o.lower() for o in out}) == 3


def test_slugify_column_matches_python(spark):
    vals = [" Income ", "Customer ID", "1st value", "%%%", "Año Nuevo", "a__b--c", "Región_Label "]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    got = [r[0] for r in df.select(slugify_col("v")).collect()]
    assert got == [slugify(v) for v in vals]


@settings(max_examples=60, deadline=None)
@given(st.text(min_size=0, max_size=20))
def test_slugify_idempotent(s):
    once = slugify(s)
    assert slugify(once) == once


def test_guess_target():
    cols = ["customer_id", "has_policy", "income"]
    assert guess_target(cols, "HAS_POLICY") == "has_policy"
    assert guess_target(["x", "my_target_col"], "target") == "my_target_col"
