import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from twinframe.functions import text
from twinframe.functions.coerce import cells_differ

SAME = [
    ("0", "0.0"), ("1.23e5", "123000"), ("$415,000.00", "415000.0"), ("($41,837.84)", "-41837.84"), ("₪158,634.54", "158634.54"), ("€2,345.67", "2345.67"),
    ("12/30/2024", "2024-12-30 00:00:00"), ("2025-01-01", "01/01/2025"), ("2024-12-31 00:00:00", "12/31/2024"), ("t", "TRUE"), ("yes", "Yes"), ("no", "NO"), ("f", "False"),
    ("1/20/2025", "1/20/2025 0:00"), ("-€ 30,848.00", "-30848.0"), ("- € 1,234.56", "-1234.56"), ("$   100.00", "100.0"), ("(50.00)", "-50.0"),
    ("'-System-", "-System-"), ('"Value"', "Value"), (" ABC ", "abc"), (None, None), ("O'Brien", "o'brien"),
]
OTHER = [("0", "false"), ("1", "true"), (None, "0"), ("0", None), ("10f", "10"), ("abc", "abd"), ("2024-01-01", "2024-01-02"), ("t", "no"), ("1.5", "1.6"), ("2024", "2024-01-01")]


@pytest.fixture(scope="module")
def verdicts(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate(SAME + OTHER)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    kind = StringType()
    return {r["i"]: r for r in df.select("i", cells_differ(F.col("a"), kind, F.col("b"), kind).alias("d"), cells_differ(F.col("b"), kind, F.col("a"), kind).alias("m")).collect()}


@pytest.mark.parametrize("i", range(len(SAME)))
def test_same(verdicts, i):
    assert verdicts[i]["d"] is False and verdicts[i]["m"] is False, SAME[i]


@pytest.mark.parametrize("i", range(len(OTHER)))
def test_other(verdicts, i):
    assert verdicts[len(SAME) + i]["d"] is True and verdicts[len(SAME) + i]["m"] is True, OTHER[i]


def test_tolerance(spark):
    df = spark.createDataFrame([("1.00", "1.005"), ("1.00", "1.02")], "a string, b string")
    kind = StringType()
    assert [r[0] for r in df.select(cells_differ(F.col("a"), kind, F.col("b"), kind, 0.01)).collect()] == [False, True]


def test_text_functions(spark):
    one = lambda fn, v: spark.createDataFrame([(v,)], "v string").select(fn("v")).first()[0]
    for raw, leaf in [("100 - Operations : 110 Operations", "110 Operations"), ("Finance:Accounting:AP", "AP"), ("Legal : : Compliance", "Compliance"), ("Name : ", ""), (":", ""), (None, None), (" x", " x")]:
        assert one(text.strip_hierarchy, raw) == leaf
    assert one(text.unicode_clean, "Crème  “brûlée” – x​") == 'Creme "brulee" - x'
    assert one(text.collapse_spaces, " a \t b\n") == "a b"
    assert str(one(text.currency_to_decimal, "($1,234.50)")) == "-1234.50"
    assert one(text.currency_to_decimal, "n/a") is None
    assert one(text.currency_to_float, "(100)") == -100.0
    assert one(text.boolean_t_f, "Yes") == "t" and one(text.boolean_t_f, "maybe") is None
    assert one(text.normalize_boolean, " N ") == "f"
    assert one(text.normalize_text, " é x​\r\n ") == "é x"
    assert one(text.normalize_text, "   ") is None
    assert one(text.normalize_for_display, "cafÃ©") == "café" and one(text.normalize_for_display, None) == ""
