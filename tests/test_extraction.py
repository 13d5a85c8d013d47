"""Hand-derived labels: every line list with the declarations it must give."""

import pytest
from pyspark.sql import functions as F

from packwise.functions import fuzzy
from packwise.operators.declare import extract_fields

LABELS = [
    ("price on the line", ["MRP Rs. 120.00 (INCL. OF ALL TAXES)"], {"mrp": "Rs. 120.00 (INCL. OF ALL TAXES)"}),
    ("price with rupee sign and thousands", ["M.R.P.: ₹ 1,250"], {"mrp": "₹ 1,250"}),
    ("price three lines below, nutrition skipped", ["MRP", "PROTEIN 12", "03/24", "45.50"], {"mrp": "₹ 45.50"}),
    ("tax wording two lines below", ["MRP Rs. 10", "LOT", "incl of all taxes"], {"mrp": "Rs. 10 (INCL. OF ALL TAXES)"}),
    ("tiny price without a mark", ["MRP 0.20"], {"mrp": None}),
    ("spaced acronym", ["M . R . P : 99"], {"mrp": "Rs. 99"}),
    ("quantity on the line", ["NET WT 500 grams"], {"net_quantity": "500 g"}),
    ("quantity on the next line", ["NET QTY", "1.5 ltr"], {"net_quantity": "1.5 L"}),
    ("keyword pass beats an earlier bare quantity", ["20 g", "NET WT 5 kg"], {"net_quantity": "5 kg"}),
    ("nutrition line is no quantity", ["Protein 12 g", "25 sticks"], {"net_quantity": "25 sticks"}),
    ("broken decimals are no quantity", ["9.9 g"], {"net_quantity": None}),
    ("date is cut at the first two parts", ["MFD: 12/05/2024"], {"manufacture_date": "12/05"}),
    ("glued month", ["PKD: MAR2024"], {"manufacture_date": "MAR2024"}),
    ("date on the next line", ["MFD", "03/2024"], {"manufacture_date": "03/2024"}),
    ("country phrase", ["MADE IN SRI LANKA"], {"country_of_origin": "Sri Lanka"}),
    ("country by address", ["Plot 5, Mumbai 400001"], {"country_of_origin": "India"}),
    ("unknown country", ["COUNTRY OF ORIGIN: ATLANTIS"], {"country_of_origin": None}),
    (
        "maker over several lines up to the pin code",
        ["MANUFACTURED BY: ACME", "12 LONG ROAD", "PUNE 411001", "LOT A"],
        {"manufacturer": "ACME, 12 LONG ROAD, PUNE 411001"},
    ),
    ("maker stops at other declarations", ["PACKED BY ACME WORKS", "MRP Rs. 5", "PUNE"], {"manufacturer": "ACME WORKS"}),
    ("corporate line", ["Golden Foods", "LOT"], {"manufacturer": "Golden Foods, LOT"}),
    (
        "care block with phone and address",
        ["CUSTOMER CARE: 1800 123 4567", "12 Long Road, Pune"],
        {"consumer_care": "Phone: 1800 123 4567, 12 Long Road, Pune"},
    ),
    ("care without a keyword", ["write to a@b.com"], {"consumer_care": "Email: a@b.com, Website: b.com"}),
    ("ignored site", ["see openfoodfacts.org"], {"consumer_care": None}),
    # the named part ends at the apostrophe and is too short, so the commodity list decides
    ("too short a named part", ["COMMODITY: it's TEA-bags 2x"], {"generic_name": "Tea"}),
    ("generic name by keyword", ["COMMODITY: green TEA-bags 2x"], {"generic_name": "Green Tea-Bags 2X"}),
    ("longest commodity wins", ["crunchy milk chocolate chips"], {"generic_name": "Milk Chocolate"}),
    ("glued commodity", ["POTATOCHIPS"], {"generic_name": "Potato Chips"}),
    ("ingredients are no name", ["INGREDIENTS: butter"], {"generic_name": None}),
    ("title with a brand word", ["BRAND Sunny Day"], {"generic_name": "Brand Sunny Day"}),
    ("unit price", ["USP ₹ 16.00 per 100 ml"], {"unit_sale_price": "₹ 16.00 / 100 ml"}),
]


@pytest.fixture(scope="module")
def extracted(spark):
    rows = [(i, 1, n, t) for i, (_, lines, _) in enumerate(LABELS) for n, t in enumerate(lines, 1)]
    df = spark.createDataFrame(rows, "insp_no long, panel_no long, line_no int, text string")
    return {r["insp_no"]: r for r in extract_fields(df).collect()}


@pytest.mark.parametrize("number", range(len(LABELS)), ids=[name for name, _, _ in LABELS])
def test_label(extracted, number):
    for field, value in LABELS[number][2].items():
        assert extracted[number][field] == value


def test_numeric_repair(spark):
    given = ["SEP2024", "Rs. l2O.SO", "5EP 2024", "10 tablels", "MRP BOO", "MRP IOO", "500 ml", "2 shects"]
    want = ["5EP2024", "Rs. 120.50", "SEP 2024", "10 tablets", "MRP 800", "MRP IOO", "500 ml", "2 sheets"]
    df = spark.createDataFrame([(g,) for g in given], "v string")
    assert [r[0] for r in df.select(fuzzy.repair_numeric(F.col("v"))).collect()] == want
