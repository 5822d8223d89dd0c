"""Packed fields and filling in order of time."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from profilespark.operators.fill import fill_cells, fill_design, fill_in_time, filled_cases, missing_number, states_nothing
from profilespark.operators.packed import is_remark, parse_packed, split_packed
from tests.conftest import rows


def values(text):
    return [v for _, v, _, _ in parse_packed(text)]


def test_alternatives():
    assert values("A1;B2 , C3") == ["A1", "B2", "C3"]
    assert values(' "A1 (x; y)"|\'B2 (low, kept)\' ') == ["A1 (x; y)", "B2 (low, kept)"]
    assert values('"A1 (""by hand"")";B2(3)') == ['A1 ("by hand")', "B2(3)"]
    assert values("A1\nB2\tC3 D4") == ["A1", "B2", "C3", "D4"]
    assert values(";;A1;;A1;") == ["A1", "A1"]
    assert values("A1 (alpha; beta);B2") == ["A1 (alpha; beta)", "B2"]
    assert [k for _, _, k, _ in parse_packed("'A';B(2);C")] == ["quoted", "bracketed", "bare"]


def test_malformed_backtracks_and_flags():
    assert parse_packed('"A1;B2') == [(1, '"A1', "bare", "malformed_quote"), (2, "B2", "bare", None)]
    assert values('"A"x;B') == ['"A"x', "B"]
    assert parse_packed("A(1;B")[0] == (1, "A(1", "bare", "unclosed_bracket")
    assert parse_packed("A);B")[0] == (1, "A)", "bare", "stray_bracket")
    assert values('""') == [] and values(None) == [] and values(" ; ") == []


def test_remarks():
    assert all(is_remark(values(t)) for t in ("not assigned", "pending, ask curator", "N/A", "-", "--", "see parent"))
    assert not is_remark(values("YMJWFDDE"))


def test_values_that_look_like_remarks(spark):
    df = spark.createDataFrame([(1, "NA; A"), (2, "n/a"), (3, "pending, ask curator"), (4, "id|A")], "record_id long, f string")
    assert rows(split_packed(df, "record_id", ["f"], "v"), "record_id", "v") == [(1, "A"), (1, "NA"), (4, "A"), (4, "id")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abZ09;,|/+& \"'()", min_size=1, max_size=8), min_size=1, max_size=5), st.sampled_from([";", ",", "|", "/", "+", "&", "\t", "\n"]))
def test_round_trip_of_quoted_values(vals, sep):
    vals = [v.strip() for v in vals]
    text = sep.join('"' + v.replace('"', '""') + '"' for v in vals)
    assert values(text) == [v for v in vals if v]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_never_fails(text):
    parsed = parse_packed(text)
    assert [p for p, *_ in parsed] == list(range(1, len(parsed) + 1))


def test_split_table(spark):
    df = spark.createDataFrame([(1, "A1;B2", None, 9), (1, "A1;B2", None, 9), (2, "none", "X9/Y8/X9", 9), (3, None, "", 9)], "record_id long, a string, b string, value int")
    got = split_packed(df, "record_id", ["a", "b"])
    assert rows(got, "record_id", "field_name", "pos", "value") == [(1, "a", 1, "A1"), (1, "a", 2, "B2"), (2, "b", 1, "X9"), (2, "b", 2, "Y8"), (2, "b", 3, "X9")]
    assert split_packed(df.limit(0), "record_id", ["a", "b"]).count() == 0
    long = spark.createDataFrame([(1, ";".join(f"A{i}" for i in range(20000)))], "record_id long, a string")
    assert split_packed(long, "record_id", ["a"]).count() == 20000


T0 = dt.datetime(2021, 1, 1)


def at(h):
    return None if h is None else T0 + dt.timedelta(hours=h)


def test_fill_methods_and_chunks(spark):
    data = [("e", 0, "a", 1.0), ("e", 1, "b", None), ("e", 2, "c", 3.0), ("e", 99, "d", None), ("f", 0, "a", None), (None, 0, "a", None), ("g", 5, "a", 0.0), ("g", 9, "b", 7.0)]
    df = spark.createDataFrame([(e, at(h), i, x) for e, h, i, x in data], "k string, t timestamp, id string, x double")
    import pyspark.sql.functions as F

    for chunk, hot in ((3600, 1), (86400, 2), (10**9, 1), (3600, 10**6)):
        got = {(r.k, r.id): (r.x_filled, r.fill_method) for r in fill_in_time(df, ["k"], "t", "id", "x", missing_number(F.col("x")), True, max_gap_s=80 * 3600, chunk_s=chunk, hot_rows=hot).collect()}
        assert got["e", "b"] == (2.0, "interpolated") and got["e", "d"] == (3.0, "beyond_gap") and got["g", "a"] == (7.0, "carried_backward")
        assert got["f", "a"] == (None, "unfilled") and got[None, "a"] == (None, "unfilled") and got["e", "a"] == (1.0, "observed")


def test_fill_against_brute_force(spark):
    r = random.Random(3)
    data = [(r.choice("pq"), r.randrange(0, 400), f"i{i:03}", r.choice([None, 0.0, float("nan"), *[float(v) for v in range(1, 9)]])) for i in range(150)]
    df = spark.createDataFrame([(e, at(h), i, x) for e, h, i, x in data], "k string, t timestamp, id string, x double")
    import pyspark.sql.functions as F

    got = {r_.id: (r_.x_filled, r_.fill_method) for r_ in fill_in_time(df, ["k"], "t", "id", "x", missing_number(F.col("x")), True, hot_rows=70).collect()}
    ok = lambda x: x is not None and x == x and x != 0
    for e, h, i, x in data:
        before = [(h2, i2, x2) for e2, h2, i2, x2 in data if e2 == e and ok(x2) and (h2, i2) < (h, i)]
        after = [(h2, i2, x2) for e2, h2, i2, x2 in data if e2 == e and ok(x2) and (h2, i2) > (h, i)]
        if ok(x):
            want = x
        elif before and after:
            a, b = max(before), min(after)
            want = a[2] + (b[2] - a[2]) * ((h - a[0]) / (b[0] - a[0]) if b[0] > a[0] else 0.5)
        else:
            want = max(before)[2] if before else min(after)[2]
        assert abs(got[i][0] - want) < 1e-9


def test_fill_tables(spark):
    samples = spark.createDataFrame(
        [("s1", "d", "B", "LYSO", at(1), at(1)), ("s2", "d", "B", "n/a", at(2), at(2)), ("s2", "d", "B", "n/a", at(2), at(2)), ("s3", "d", None, None, at(3), at(3)), ("ref", None, None, "x", at(0), at(0))],
        "var_id string, dataset string, covariate_bait string, subcellular_enrichment string, acquired_at timestamp, registered_at timestamp",
    )
    cells = spark.createDataFrame(
        [("p", "s1", 1, 5.0, at(1)), ("p", "s2", 1, 4.0, at(1)), ("p", "s2", 1, None, at(2)), ("p", "ref", 1, None, at(2)), ("p", "s3", 1, 0.0, None), ("q", "s1", 1, None, at(1))], "obs_id string, var_id string, injection int, x double, loaded_at timestamp"
    )
    assert rows(filled_cases(cells, samples)) == [("subcellular_enrichment", "", "s2"), ("x", "p", "s2")]
    assert rows(fill_design(samples).where("fill_method <> 'unfilled'"), "var_id", "subcellular_enrichment_filled") == [("s1", "LYSO"), ("s2", "LYSO")]
    assert fill_cells(cells.limit(0), samples).count() == 0 and filled_cases(cells.limit(0), samples.limit(0)).count() == 0


def test_stand_ins(spark):
    import pyspark.sql.functions as F

    df = spark.createDataFrame([(v,) for v in (None, "", " ", "?", "-", "N/A", "unknown", "Not recorded", "tbd", "nan", "ER", "PM")], "v string")
    assert rows(df.where(~states_nothing(F.col("v")))) == [("ER",), ("PM",)]
