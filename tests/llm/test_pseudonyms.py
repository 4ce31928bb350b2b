"""Pseudonyms keep format and validity, are one to one, link equal values and can be undone."""

import datetime
import random
import re

import pytest
from hypothesis import given, settings, strategies as st

from metermill.llm import pseudonyms as ps

KEY = b"key of these tests"
M = ps.Pseudonymizer(KEY)


@given(st.integers(1, 3000))
@settings(max_examples=40, deadline=None)
def test_feistel_permutes_every_domain(size):
    f = ps.Feistel(b"k", "t", size)
    images = [f.walk(x, lambda y: True) for x in range(size)]
    assert sorted(images) == list(range(size)) and [f.walk(y, lambda z: True, undo=True) for y in images] == list(range(size))


def valid(kind, s):
    d = ps._digits(s)
    if kind == "card":
        return ps.luhn(d[:-1]) == int(d[-1])
    if kind == "iban":
        return ps.iban_rest(s.replace(" ", "")) == 1
    if kind == "ip":
        return all(0 <= int(p) <= 255 for p in s.split("."))
    return True


CASES = {
    "mail": ["Jane.Doe42@mail7.example.com", "ünal.x1@a.org"],
    "card": ["4539 1488 0343 6467", "4539148803436467", "4539-1488-0343-6467"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "ssn": ["123-45-6789"],
    "phone": ["+1 (988) 555-2485", "(988) 555-2485", "988-555-2485", "+1 (152) 155-8590", "+49 30 1234567", "+441632960961"],
    "ip": ["61.131.143.218", "8.8.8.8"],
    "date": ["2024-02-29", "29.02.2024", "1.3.1999", "3/14/1999", "31/12/1999"],
}


def test_formats_and_undo():
    for kind, values in CASES.items():
        for v in values:
            text = f"Before {v}, after. {v}"
            new, spans = M.text(text)
            found = {new[a:b] for k, a, b in spans if k == kind}
            assert len(spans) == 2 and len(found) == 1, (kind, v, new, spans)
            w = found.pop()
            assert v not in new and valid(kind, w)
            if kind != "ip":
                assert re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", w.split("@")[0]))) == re.sub(r"\d", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v[v.startswith("ü") :].split("@")[0]))) or kind == "date"
            assert M.text(new, undo=True)[0] == text
    forms = {ps._digits(M.text(v)[0]) for v in CASES["card"]}
    assert len(forms) == 1


def test_what_is_not_valid_stays():
    for t in ("4539148803436468 x", "999.1.1.1", "2023-02-29", "version 3.0.1", "DE89370400440532013001", "666-45-6789", "no digits", "", "x" * 300000 + "@", "1" * 100000, "a@b", "(988) 155-2485"):
        assert M.text(t) == (t, [])


def test_dates_stay_dates_and_are_one_to_one():
    rng = random.Random(2)
    days = rng.sample(range(73000), 400)
    values = [(datetime.date(1900, 1, 1) + datetime.timedelta(d)).isoformat() for d in days]
    images = [M.date(v, False) for v in values]
    assert len(set(images)) == len(values) and all(datetime.date.fromisoformat(i) for i in images)
    assert [M.date(i, True) for i in images] == values


def test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = ps.pseudonymized(docs.withColumn("start", docs.doc_id), key=KEY).cache()
    before = {r.doc_id: r.text for r in docs.collect()}
    mails, n = {}, 0
    for r in out.collect():
        t = before[r.doc_id]
        assert (r.text == t) == (not r.ps_spans)
        for m in re.findall(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}", t):
            n += 1
            assert m not in r.text
        for s in r.ps_spans:
            mails.setdefault(r.text[s.start : s.end], 0)
    assert n > 20
    assert {r.doc_id: r.text for r in ps.restored(out.drop("start"), key=KEY).collect()} == before


@pytest.mark.parametrize("rows", [[], [(1, None), (None, ""), (2, "8.8.8.8"), (2, "8.8.8.8")]])
def test_odd_tables(spark, rows):
    out = ps.pseudonymized(spark.createDataFrame(rows, "doc_id long, text string"), key=KEY).collect()
    assert len(out) == len(rows) and len({r.text for r in out if r.doc_id == 2}) == (1 if rows else 0)


def card(rng, n=16):
    body = str(rng.randint(4, 6)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 2))
    return body + str(ps.luhn(body))


def test_values_next_to_other_digits_and_words():
    rng = random.Random(5)
    cards = [card(rng) for _ in range(60)]
    for c in cards:
        spaced = " ".join(c[i : i + 4] for i in (0, 4, 8, 12))
        alone = M.text(c)[0]
        for form in (c, spaced, spaced.replace(" ", "-")):
            for text in (f"{form} 12/25", f"{form} 123 end", f"{form} 12", f"2 {form}", f"12 {form} 123", f"+5 {form}"):
                new, spans = M.text(text)
                assert [ps._digits(new[a:b]) for k, a, b in spans] == [alone], (text, new)
                assert M.back(new, spans) == text and M.text(new, undo=True)[0] == text
    for iban in ("ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "GB82WEST12345698765432", "NO93 8601 1117 947"):
        alone = M.text(iban)[0]
        for text in ("{} BIC CODE", "{} EUR 50", "{} 50 EUR", "IBAN {} EURO", "AB12 {} BIC"):
            new, spans = M.text(text.format(iban))
            assert new == text.format(alone) and [k for k, *_ in spans] == ["iban"], (text, iban, new)
            assert M.text(new, undo=True)[0] == text.format(iban)
    phone = "988-555-2485"
    assert M.text(f"1234 {phone}")[0] == f"1234 {M.text(phone)[0]}"
    assert [k for k, *_ in M.text("+49 30 1234567 4001 4002")[1]] == ["phone"]


def test_long_cards_and_many_short_groups_can_be_undone():
    rng = random.Random(6)
    for n in range(13, 20):
        for _ in range(30):
            c = card(rng, n)
            for form in (c, " ".join(re.findall(".{1,4}", c)), " ".join(re.findall(".{1,5}", c))):
                new, spans = M.text(f"no {form}.")
                assert M.text(new, undo=True)[0] == M.back(new, spans) == f"no {form}."
    text = "".join(f"{rng.randint(0, 99)} " for _ in range(20000))
    new, spans = M.text(text)
    assert M.back(new, spans) == text


def test_restored_by_spans(spark):
    rng = random.Random(7)
    texts = [f"{rng.randint(0, 99999)} {rng.randint(0, 999)} {card(rng)[:8]} {card(rng)} {rng.randint(0, 999)}" for _ in range(300)]
    rows = list(enumerate(texts))
    out = ps.pseudonymized(spark.createDataFrame([*rows, (300, None)], "doc_id long, text string"), key=KEY)
    assert {r.doc_id: r.text for r in ps.restored(out, key=KEY).collect()} == {**dict(rows), 300: None}


def test_dates_of_timestamps_and_year_first_forms():
    new = M.text("2024-03-05")[0]
    for text in ("2024-03-05T10:00:00Z", "at 2024-03-05T10:00:00.123+01:00, ok", "2024/03/05", "2024.03.05", "on 2024.03.05. Then", "2024/03/05 10:00"):
        got, spans = M.text(text)
        mark = re.search(r"\d{4}(.)", text)[1]
        assert got == re.sub(r"2024.03.05", new.replace("-", mark), text) and [k for k, *_ in spans] == ["date"], (text, got)
        assert M.text(got, undo=True)[0] == M.back(got, spans) == text
    for t in ("2024-03-05Text", "2024/03-05", "2024.13.05", "2024/02/30", "/2024/03/05/x"):
        assert M.text(t) == (t, [])


def test_a_key_is_required(spark):
    df = spark.createDataFrame([(1, "call 415-555-0123")], "doc_id long, text string")
    with pytest.raises(ValueError):
        ps.pseudonymized(df)
    one, two = (ps.pseudonymized(df, key=k).first().text for k in (b"one", b"two"))
    assert one != two
    spark.conf.set(ps.KEY_SETTING, "one")
    try:
        assert ps.pseudonymized(df).first().text == one
    finally:
        spark.conf.unset(ps.KEY_SETTING)
