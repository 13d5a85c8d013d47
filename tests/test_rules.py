"""Rule branches and the surprising cases, one record each."""

import pytest
from pyspark.sql import functions as F

from packwise.functions import fixed_values as V
from packwise.functions import text, units
from packwise.operators import compliance, panels, rules

COLUMNS = {f: "string" for f in V.TEXT_FIELDS} | {f: "boolean" for f in V.FLAG_FIELDS} | {
    "category": "string", "readability": "string", "font_height": "double", "placement": "string",
    "token_confidence": "double",
}
SCHEMA = "n int, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())

CASES = [
    ({"net_quantity": "5 gallons"}, "R6-07", "PASS"),
    ({"net_quantity": "25 sticks"}, "R6-07", "REVIEW"),
    ({"net_quantity": "about 20 g"}, "R6-07", "REVIEW"),
    ({"net_quantity": "500 g", "font_height": 1.5}, "RULE7", "FAIL"),
    ({"net_quantity": "500 g", "font_height": 4.0}, "RULE7", "PASS"),
    ({}, "RULE7", "REVIEW"),
    ({"placement": "Uncertain"}, "RULE8", "PASS"),
    ({"placement": "text outside panel"}, "RULE8", "REVIEW"),
    ({"readability": "POOR (Unchecked)"}, "RULE9", "REVIEW"),
    ({"veg_nonveg_mark": "non-veg"}, "R6-16", "PASS"),
    ({"veg_nonveg_mark": "blue"}, "R6-16", "REVIEW"),
    ({"is_imported": True}, "R6-03", "FAIL"),
    ({"is_imported": False, "importer": "X"}, "R6-03", "NOT_APPLICABLE"),
    ({"importer": "X"}, "R6-03", "PASS"),
    ({"is_imported": True}, "R6-04", "FAIL"),
    ({}, "R6-04", "REVIEW"),
    ({"country_of_origin": "Atlantis"}, "R6-04", "REVIEW"),
    ({"generic_name": "Maggi"}, "R6-05", "REVIEW"),
    ({"generic_name": "Tea"}, "R6-05", "PASS"),
    ({"is_multi_product": True, "generic_name": "2 x Jam"}, "R6-06", "PASS"),
    ({"mrp": "99"}, "R6-08", "REVIEW"),
    ({"unit_sale_price": "₹ 3.00 / g (Calculated)"}, "R6-09", "REVIEW"),
    ({"unit_sale_price": "Rs. 5.123 / g"}, "R6-09", "REVIEW"),
    ({"unit_sale_price": "₹ 3.00 / g"}, "R6-09", "PASS"),
    ({"manufacture_date": "SEP2024"}, "R6-10", "FAIL"),
    ({"manufacture_date": "best before 03/2024"}, "R6-10", "REVIEW"),
    ({"manufacture_date": "best before 03/2024"}, "R6-11", "REVIEW"),
    ({"consumer_care": "write to us"}, "R6-12", "REVIEW"),
    ({"category": "Textile"}, "R6-13", "REVIEW"),
    ({"is_gm_food": True, "placement": "Top"}, "R6-15", "PASS"),
    ({"is_ecommerce": True}, "R6-17", "FAIL"),
    ({"manufacturer": " N/A "}, "R6-01", "FAIL"),
    ({"manufacturer": "Acme", "packer": "ACME"}, "R6-02", "NOT_APPLICABLE"),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, *[case.get(c) for c in COLUMNS]) for i, (case, _, _) in enumerate(CASES)]
    df = compliance.with_compliance(rules.evaluate(spark.createDataFrame(rows, SCHEMA)), "token_confidence")
    return {r["n"]: r for r in df.collect()}


@pytest.mark.parametrize("number", range(len(CASES)))
def test_branch(judged, number):
    _, rule_id, status = CASES[number]
    assert {r["rule_id"]: r["status"] for r in judged[number]["rule_results"]}[rule_id] == status


def test_score_status_and_violations_agree(judged):
    for r in judged.values():
        states = [x["status"] for x in r["rule_results"]]
        applicable = [s for s in states if s != "NOT_APPLICABLE"]
        assert r["score"] == round(states.count("PASS") / len(applicable), 4)
        assert r["status"] == ("FAIL" if "FAIL" in states else "REVIEW" if "REVIEW" in states else "PASS")
        assert len(r["violations"]) == states.count("FAIL") + states.count("REVIEW")
        assert r["confidence"] == round(max(0.0, 0.9 - 0.03 * states.count("REVIEW")), 4)


def test_rounding_follows_the_binary_value(spark):
    df = spark.createDataFrame([(2.675,), (6.25,), (0.125,), (1.005,)], "x double")
    got = df.select(text.fixed(F.col("x"), 2), text.fixed(F.col("x"), 1), text.half_up_fixed2(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [
        (f"{x:.2f}", f"{x:.1f}", js) for x, js in ((2.675, "2.67"), (6.25, "6.25"), (0.125, "0.13"), (1.005, "1.00"))
    ]


def test_suggested_unit_price(spark):
    df = spark.createDataFrame([("Rs. 120.00", "500 g"), ("₹ 1,200", "2 kg"), ("10", "4 matches"), ("x", "1 g")], "p string, q string")
    got = [r[0] for r in df.select(units.suggested_unit_price(F.col("p"), F.col("q"))["primary"]).collect()]
    assert got == ["₹ 24.00 / 100 g", "₹ 600.00 / kg", "₹ 2.50 / matche", None]


def test_panels_lose_an_explicit_false(spark):
    rows = [(1, 1, "abc", False), (1, 2, "abcd", None), (1, 3, "wxyz", False), (2, 1, "", True)]
    df = spark.createDataFrame(rows, "insp_no int, panel_no int, manufacturer string, is_imported boolean")
    got = {r["insp_no"]: r for r in panels.merge_fields(df, ["insp_no"]).collect()}
    assert (got[1]["manufacturer"], got[1]["is_imported"]) == ("abcd", None)
    assert (got[2]["manufacturer"], got[2]["is_imported"]) == (None, True)
