import pytest

from twinframe.functions import names
from twinframe.plans.alignment import align, choose_keys, pairs


@pytest.mark.parametrize("raw, plain", [("Invoice ID", "invoice_id"), ("Line#", "line"), ("Unit Price ($)", "unit_price"), ("Internal ID.1", "internal_id_1"), ("__A  b--c__", "a_b_c"), ("already_fine", "already_fine")])
def test_normal_name(raw, plain):
    assert names.normal_name(raw) == plain


def test_repeated_names_get_numbers():
    assert names.normal_names(["User Name", "user_name", "UserName", "user name"]) == ["user_name", "user_name_2", "username", "user_name_3"]
    assert names.rename_report(["A b", "a_b", "c"])["conflicts"] == ["a_b"]


def test_find_column_in_three_ways():
    assert names.find_column("From Email", ["From Email"]) == "From Email"
    assert names.find_column("From Email", ["from_email"]) == "from_email"
    assert names.find_column("from_email", ["From Email"]) == "From Email"
    with pytest.raises(KeyError):
        names.find_column("x", ["a"])


def test_tables_and_titles():
    assert names.table_name("my file (1)") == "my_file_1"
    assert names.table_name("2024-data") == "t_2024_data"
    assert names.table_name("...") == "table_unnamed"
    assert names.friendly_name("sales_2024_q1") == "Sales 2024 Q1"
    assert names.friendly_name("USA_customer-list.csv") == "USA Customer List"
    assert names.pandas_spelling(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]


def test_alignment():
    found = pairs(["author_email", "n", "left_only"], ["From Email", "N"], {"from_email": "author_email"})
    assert found == {"author_email": "From Email", "n": "N"}
    assert choose_keys({"name": "name", "order_id": "order_id"}) == ["order_id"]
    assert choose_keys({"name": "name"}) == ["name"]
    plan = align(["id", "a", "b"], ["ID", "A", "c"], exclude=["a"])
    assert plan.keys == (("id", "ID"),) and plan.values == ()
