import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trustfold.llm import pii

KEY = b"0123456789abcdef"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10**18), st.data())
def test_permutation_inverts(n, data):
    x = data.draw(st.integers(0, n - 1))
    y = pii.permute(x, n, KEY, b"t")
    assert 0 <= y < n and pii.permute(y, n, KEY, b"t", back=True) == x


@pytest.mark.parametrize("n", [1, 2, 7, 26, 1000])
def test_permutation_is_one_to_one(n):
    assert sorted(pii.permute(x, n, KEY, b"t") for x in range(n)) == list(range(n))


VALID = [("+1 (017) 555-7713", "phone"), ("+442071234567", "phone"), ("97.51.17.173", "ip"), ("4539 1488 0343 6467", "card"), ("4539148803436467", "card"),
         ("2024-02-29", "date"), ("31/12/1999", "date"), ("12/31/1999", "date"), ("123-45-6789", "ssn"), ("DE89 3704 0044 0532 0130 00", "iban"),
         ("the.72@mail3.example.com", "email"), ("für.08@mail1.example.com", "email")]
INVALID = ["9807915762804490", "1.2.3.4.5", "300.1.1.1", "2023-02-29", "000-45-6789", "DE88 3704 0044 0532 0130 00", "45/45/2000", "+12", "1234", "version 3.0", "0000000000000000"]


@pytest.mark.parametrize("value,kind", VALID)
def test_format_and_inverse(value, kind):
    text = f"é see {value}, or ({value})."
    out, counts = pii.pseudonymise(text, KEY)
    assert dict(zip(pii.KINDS, counts)) == {k: 2 * (k == kind) for k in pii.KINDS}
    assert value not in out and pii.pseudonymise(out, KEY, back=True)[0] == text
    shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
    if kind != "ip":
        assert shape(out) == shape(text)
    assert pii.pseudonymise(out, KEY)[1] == counts  # the new value is valid, too
    assert pii.pseudonymise(text, b"another key 1234")[0] != out


@pytest.mark.parametrize("value", INVALID)
def test_invalid_values_stay(value):
    assert pii.pseudonymise(f"a {value} b", KEY) == (f"a {value} b", [0] * len(pii.KINDS))


def test_equal_values_stay_linked():
    a, b = (pii.pseudonymise(t, KEY)[0] for t in ("x 4539 1488 0343 6467", "y 4539148803436467"))
    assert a[2:].replace(" ", "") == b[2:]


def test_frame(spark):
    rows = [(1, "call +1 (017) 555-7713", 5), (2, None, 5), (3, "", 5), (1, "call +1 (017) 555-7713", 5), (None, "x " * 200_000 + "97.51.17.173", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    out = pii.protect(docs, KEY)
    got = out.collect()
    assert len(got) == 5 and out.columns[:3] == docs.columns
    assert sum(r["n_phone"] for r in got) == 2 and sum(r["n_ip"] for r in got) == 1
    assert [r["text"] for r in got if r["doc_id"] == 2] == [None] and [r["text"] for r in got if r["doc_id"] == 3] == [""]
    back = pii.protect(out.select("doc_id", "text", "extra"), KEY, back=True).select("doc_id", "text", "extra")
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    assert pii.protect(docs.limit(0), KEY).count() == 0
    for bad in (lambda: pii.protect(docs, b"short"), lambda: pii.protect(docs.withColumnRenamed("extra", "n_ip"), KEY)):
        with pytest.raises(ValueError):
            bad()


NATIONAL = [("(415) 555-0132", "phone"), ("415-555-0132", "phone"), ("1 415.555.0132", "phone"), ("020 7123 4567", "phone"), ("(0161) 496 0000", "phone"),
            ("01632 960123", "phone"), ("01 42 68 53 00", "phone"), ("3/4/2021", "date"), ("3/25/2021", "date"), ("31.1.2021", "date"), ("5/09/2021", "date"),
            ("2021-3-4", "date"), ("2021/11/9", "date"), ("2001:db8::8a2e:370:7334", "ip"), ("2001:0DB8:0:0:0:FF00:42:8329", "ip"), ("fe80::1ff:fe23:4567:890a", "ip")]


@pytest.mark.parametrize("value,kind", NATIONAL)
def test_national_short_and_ipv6_forms(value, kind):
    text = f"é see {value}, or ({value}). {value}: so"
    for n in range(20):
        key = KEY + b"%d" % n
        out, counts = pii.pseudonymise(text, key)
        assert dict(zip(pii.KINDS, counts)) == {k: 3 * (k == kind) for k in pii.KINDS}
        assert out != text and pii.pseudonymise(out, key, back=True) == (text, counts)
        shape = lambda s: re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", s)))
        assert shape(out) == shape(text)


@pytest.mark.parametrize("value", ["115-555-0132", "411-555-0132", "415-911-0132", "30/2/2021", "2/30/2021", "0/4/2021", "12:30:45", "a::b", "std::dead::beef", "2001:db8::1::2",
                                   "1:2:3:4:5:6:7:8", "415-555-01324", "0000 496 0000"])
def test_other_numbers_stay(value):
    assert pii.pseudonymise(f"a {value} b", KEY) == (f"a {value} b", [0] * len(pii.KINDS))


#: Spellings of one value each.
SPELLINGS = [
    ("+1 (415) 555-0132", "(415) 555-0132", "415-555-0132", "1 415.555.0132", "+14155550132", "+1 415 555 0132"),
    ("+4915112345678", "+49 151 1234 5678", "+49 (0)151 1234 5678"),
    ("020 7123 4567", "(020) 7123 4567", "+442071234567", "+44 20 7123 4567", "+44 (0)20 7123 4567"),
    ("01 42 68 53 00", "01.42.68.53.00", "+33 1 42 68 53 00", "+33 (0)1 42 68 53 00", "+33142685300"),
    ("04/03/2021", "4/3/2021", "4.3.2021", "2021-03-04", "2021-3-4", "2021/03/04"),
    ("03/25/2021", "3/25/2021", "25/03/2021", "25.3.2021", "2021-03-25"),
    ("11/12/1999", "11.12.1999", "1999-12-11"),
    ("2001:db8::1", "2001:0db8::1", "2001:DB8::0001", "2001:0db8:0000:0000:0000:0000:0000:0001", "2001:db8:0:0:0:0:0:1"),
    ("2001:db8:0:a:b::", "2001:0db8:0000:000a:000b:0000:0000:0000"),
    ("the.72@mail3.example.com", "The.72@mail3.example.com", "THE.72@Mail3.Example.com"),
    ("DE89 3704 0044 0532 0130 00", "DE89370400440532013000"),
]


def canonical(value):
    """The value that a spelling stands for, read independently of the operator."""
    import datetime
    import ipaddress

    if "@" in value:
        return value.lower()
    if ":" in value:
        return ipaddress.IPv6Address(value)
    if re.fullmatch(r"\d{4}[-/]\d+[-/]\d+|\d+[./]\d+[./]\d{4}", value):
        a, b, c = map(int, re.split(r"\D", value))
        return datetime.date(a, b, c) if a > 31 else datetime.date(c, b, a) if b <= 12 else datetime.date(c, a, b)
    d = re.sub(r"\D", "", value.replace("(0)", ""))
    if value.startswith(("DE", "+")):
        return d
    return "44" + d[1:] if d[0] == "0" and len(d) == 11 else "33" + d[1:] if d[0] == "0" else "1" + d[-10:]


@pytest.mark.parametrize("spellings", SPELLINGS, ids=lambda x: x[0])
def test_spellings_of_one_value_stay_linked(spellings):
    assert len({canonical(x) for x in spellings}) == 1
    for n in range(40):
        key = KEY + b"%d" % n
        news = []
        for x in spellings:
            out, counts = pii.pseudonymise(f"see {x}, ok", key)
            assert sum(counts) == 1 and pii.pseudonymise(out, key, back=True)[0] == f"see {x}, ok"
            news.append(out[4:-4])
        assert len({canonical(x) for x in news}) == 1, news
        assert all(re.sub(r"\w", "9", x) == re.sub(r"\w", "9", y) for x, y in zip(spellings, news))


def test_country_codes_are_kept():
    for value, code in (("+4915112345678", "+49"), ("+49 151 1234 5678", "+49"), ("+12025550143", "+1"), ("+351 21 123 4567", "+351"), ("+79161234567", "+7")):
        for n in range(20):
            assert pii.pseudonymise(value, KEY + b"%d" % n)[0].startswith(code)


@pytest.mark.parametrize("days", [range(1, 10), range(10, 13), range(13, 32)])
def test_dates_are_permuted_one_to_one(days):
    import datetime

    dates = [x for x in (datetime.date(1900, 1, 1) + datetime.timedelta(i) for i in range(73049)) if x.day in days and x.month > 9]
    news = {pii.pseudonymise(x.isoformat(), KEY)[0] for x in dates}
    assert news == {x.isoformat() for x in dates}


def test_query_against_plain_python(spark):
    """Every row of the query is its text's own result, and over the whole table values and pseudonyms are one to one."""
    from tests.conftest import SF
    from trustfold.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op1_pii(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want, counts = pii.pseudonymise(texts[r["doc_id"]] or "", queries.PII_KEY)
        assert (r["text"] or "") == want and [r[f"n_{k}"] for k in pii.KINDS] == counts
        assert pii.pseudonymise(want, queries.PII_KEY, back=True)[0] == (texts[r["doc_id"]] or "")
