"""Pseudonyms against a plain Python version of the permutations."""

import datetime
import hashlib

import pytest

from snipdex.llm.pseudonyms import pseudonymise
from tests.llm.cases import documents, odd_texts

KEY = "example"


def number(kind, step, value):
    return int(hashlib.sha256(f"{KEY}|{kind}|{step}|{value}".encode()).hexdigest()[:15], 16)


def feistel(kind, left, right, a, b):
    for i in range(1, 11):
        if i % 2:
            left = (left + number(kind, i, right) % a) % a
        else:
            right = (right + number(kind, i, left) % b) % b
    return left, right


def digits(kind, text):
    n = len(text) // 2
    left, right = feistel(kind, int(text[:n]), int(text[n:]), 10**n, 10 ** (len(text) - n))
    return f"{left:0{n}d}{right:0{len(text) - n}d}"


def luhn(text):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(text))) % 10


def card(text):
    body = digits("card", text[:-1])
    return body + next(c for c in "0123456789" if luhn(body + c) == 0)


def date(day):
    left, right = feistel("date", *divmod((day - datetime.date(1900, 1, 1)).days, 4297), 17, 4297)
    return datetime.date(1900, 1, 1) + datetime.timedelta(left * 4297 + right)


def out(spark, *texts):
    rows = pseudonymise(documents(spark, list(enumerate(texts))).select("doc_id", "text"), KEY).orderBy("doc_id").collect()
    return [r.text for r in rows]


def test_cards(spark):
    number_ = "4111111111111111"
    want = card(number_)
    got = out(spark, f"a {number_}, b", "4111 1111 1111 1111", "4111-1111-1111-1112 4111111111111112", f"{number_} {number_}", f"x{number_} {number_}y 1.{number_}")
    assert got[0] == f"a {want}, b" and got[1].replace(" ", "") == want and got[3] == f"{want} {want}"
    assert got[2] == "4111-1111-1111-1112 4111111111111112" and got[4] == f"x{number_} {number_}y 1.{number_}"
    assert luhn(want) == 0 and want != number_


def test_dates_are_linked_over_notations(spark):
    day = date(datetime.date(2024, 2, 29))
    got = out(spark, "2024-02-29", "29.02.2024", "02/29/2024", "2024-02-30 31.04.2020 1899-12-31 2100-01-01", "3.4.2021")
    assert got[:3] == [f"{day:%Y-%m-%d}", f"{day:%d.%m.%Y}", f"{day:%m/%d/%Y}"]
    assert got[3] == "2024-02-30 31.04.2020 1899-12-31 2100-01-01"
    other = date(datetime.date(2021, 4, 3))
    assert got[4] == f"{other.day}.{other.month}.{other.year}"


def test_other_kinds(spark):
    got = out(spark, "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89 3704 0044 0532 0130 01", "10.0.0.1", "300.1.1.1 1.2.3.4.5", "123-45-6789", "000-12-3456 666-12-3456 123-00-1234", "+1 (743) 555-3824", "Ab.34@mail7.Example.com")
    for iban, form in ((got[0], "DE89 3704 0044 0532 0130 00"), (got[1], "GB82WEST12345698765432")):
        plain = iban.replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        assert iban != form and [c.isdigit() for c in iban] == [c.isdigit() for c in form]
    assert got[2] == "DE89 3704 0044 0532 0130 01" and got[4] == "300.1.1.1 1.2.3.4.5" and got[6] == "000-12-3456 666-12-3456 123-00-1234"
    left, right = feistel("ip", 10 * 256, 1, 65536, 65536)
    assert got[3] == f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    area, group, serial = map(int, got[5].split("-"))
    assert got[5] != "123-45-6789" and 1 <= area < 900 and area != 666 and group and serial
    assert got[7].replace("(", "").startswith("+1 ") and got[7] != "+1 (743) 555-3824" and "".join(c for c in got[7] if c.isdigit())[1:] == digits("phone", "7435553824")
    assert got[8].endswith(".com") and got[8] != "Ab.34@mail7.Example.com" and [c.isdigit() for c in got[8]] == [c.isdigit() for c in "Ab.34@mail7.Example.com"] and got[8][0].isupper()


def test_kinds_end_where_they_end(spark):
    """Behind each kind another kind, a capital and a number; what is behind stays or is found on its own."""
    kinds = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "4111 1111 1111 1111", "2024-05-01", "123-45-6789", "+44 20 7946 0958", "+33 1 23 45 67 89", "+49 30 1234567", "10.0.0.1", "a.b@mail.com"]
    alone = dict(zip(kinds, out(spark, *kinds)))
    assert all(a != b for a, b in alone.items())
    pairs = [(a, b) for a in kinds for b in kinds]
    assert out(spark, *(f"{a} {b}" for a, b in pairs)) == [f"{alone[a]} {alone[b]}" for a, b in pairs]
    for behind in (" I paid", " OR CASH", ", B", "; 500 EUR", ""):
        assert out(spark, *(k + behind for k in kinds)) == [alone[k] + behind for k in kinds]
    fixed = [k for k in kinds if k != "+49 30 1234567"]
    assert out(spark, *(f"{k} 500 EUR" for k in fixed)) == [f"{alone[k]} 500 EUR" for k in fixed]
    assert out(spark, "2024-05-01T12:00", "2024-05-01Tx") == [alone["2024-05-01"] + "T12:00", "2024-05-01Tx"]


def test_failed_ibans_take_nothing(spark):
    card_, day, iban = "4111 1111 1111 1111", "2024-05-01", "DE89 3704 0044 0532 0130 00"
    c, d, i = out(spark, card_, day, iban)
    got = out(spark, f"AB12 {card_}", f"DE00 1111 1111 1111 11 {day}", f"FR12 {iban} 1", f"\ue000 {iban} \ue000\ue001 {iban}")
    assert got == [f"AB12 {c}", f"DE00 1111 1111 1111 11 {d}", f"FR12 {i} 1", f"\ue000 {i} \ue000\ue001 {i}"]


def test_permutation_has_no_collisions(spark):
    texts = [f"10.0.{i // 256}.{i % 256}" for i in range(1500)] + [f"{i:03d}-45-{6000 + i:04d}" for i in range(1, 600)]
    got = out(spark, *texts)
    assert len(set(got)) == len(texts) and not set(got) & set(texts)


def test_odd_rows_keep_their_columns(spark):
    docs = documents(spark, odd_texts())
    found = pseudonymise(docs, KEY, found_col="what")
    assert found.columns == [*docs.columns, "what"]
    assert sorted(((r[0], r[1]) for r in found.collect()), key=str) == sorted(odd_texts(), key=str)
    assert found.filter("size(what) > 0").count() == 0
    assert pseudonymise(documents(spark, []), KEY).count() == 0
    with pytest.raises(ValueError):
        pseudonymise(docs, "it's")


def test_long_texts_are_read_in_linear_time(spark):
    texts = ["a" * 300_000, "1" * 300_000, "1.1." * 50_000, "a@" + "a." * 100_000, "a.b-" * 80_000 + "@", "(123) " * 50_000]
    assert out(spark, *texts) == texts


def test_plan_is_native(spark):
    plan = pseudonymise(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), KEY)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
