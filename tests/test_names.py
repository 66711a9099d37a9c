from tidepanel.functions.names import dedupe_names, sanitize_columns, sanitize_name


def test_silver_and_gold_flavours():
    assert sanitize_name("a-b") == "ab"
    assert sanitize_name("a-b", "gold") == "a_b"
    assert sanitize_name("a.b") == "ab"
    assert sanitize_name("a.b", "gold") == "a_b"
    assert sanitize_name("A B") == "a_b"
    assert sanitize_name("a b ") == "a_b"
    assert sanitize_name("(x)") == "x"
    assert sanitize_name("") == "col"
    assert sanitize_name("  ") == "col"
    assert sanitize_name("Cust/Key", "gold") == "cust_key"
    assert sanitize_name("prix (CAD$)") == "prix_cad"


def test_collisions_get_suffixes():
    assert dedupe_names(["a", "a", "a", "b"]) == ["a", "a_2", "a_3", "b"]


def test_sanitize_dataframe(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["Ref Date", "ref-date", "VALUE"])
    assert sanitize_columns(df, "gold").columns == ["ref_date", "ref_date_2", "value"]
    assert sanitize_columns(df).columns == ["ref_date", "refdate", "value"]


from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_sanitize_is_idempotent_and_clean(name):
    for flavour in ("silver", "gold"):
        once = sanitize_name(name, flavour)
        assert sanitize_name(once, flavour) == once
        assert once == "col" or (once == once.lower() and not once.startswith("_")
                                 and not once.endswith("_") and "__" not in once)
        assert all(c.isascii() and (c.isalnum() or c == "_") for c in once)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "a_2", "c"]), max_size=12))
def test_dedupe_gives_unique_names(names):
    out = dedupe_names(names)
    assert len(set(out)) == len(out) == len(names)
