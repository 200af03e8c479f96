"""Pseudonyms against a plain version of them, and the notations that must stay linked."""

import datetime
import hashlib
import re

import pytest

from samplewright.llm import pseudonyms, queries

KEY = "a key"
CODES = {"1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}


def digest(key, tag, i, value):
    return int(hashlib.sha256(f"{key}|{tag}|{i}|{value}".encode()).hexdigest()[:15], 16)


def feistel(a, b, left, right, key, tag):
    for i in range(1, 9):
        if i % 2:
            a = (a + digest(key, tag, i, b)) % left
        else:
            b = (b + digest(key, tag, i, a)) % right
    return a, b


def digits_of(d, key, tag):
    half = len(d) // 2
    a, b = feistel(int(d[:half]), int(d[half:]), 10**half, 10 ** (len(d) - half), key, f"{tag}{len(d)}")
    return f"{a:0{half}d}{b:0{len(d) - half}d}"


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10


def refill(shape, d):
    d = iter(d)
    return "".join(next(d) if c.isdigit() else c for c in shape)


def card(x, key):
    d = re.sub(r"\D", "", x)
    if 13 <= len(d) <= 19 and luhn(d) == 0:
        body = digits_of(d[:-1], key, "card")
        return refill(x, body + str(-luhn(body + "0") % 10))


def phone(x, key):
    code = ""
    if x[0] == "+":
        code = next((x[1 : 1 + n] for n in (1, 2) if x[1 : 1 + n] in CODES), x[1:4])
        code = "+" + code if re.match(r"\+\d{1,3}", x) and (code in CODES or re.match(r"\+\d{3}", x)) else ""
    rest = x[len(code) :]
    d = re.sub(r"\D", "", rest)
    if 6 <= len(d) <= 15 and 7 <= len(re.sub(r"\D", "", x)) <= 15:
        return code + refill(rest, digits_of(d, key, "phone"))


def ssn(x, key):
    area, group, serial = map(int, x.split("-"))
    if 1 <= area <= 899 and area != 666 and group and serial:
        value = ((area - 2 if area > 666 else area - 1) * 99 + group - 1) * 9999 + serial - 1
        a, b = feistel(value // 9999, value % 9999, 898 * 99, 9999, key, "ssn")
        area = a // 99
        return f"{area + 2 if area >= 665 else area + 1:03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def ip(x, key):
    p = [int(k) for k in x.split(".")]
    if max(p) <= 255:
        a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def date(x, key):
    p = re.split("[./-]", x)
    american = "/" in x and int(p[0]) <= 12
    y, m, d = (p[0], p[1], p[2]) if "-" in x else (p[2], p[0], p[1]) if american else (p[2], p[1], p[0])
    try:
        n = (datetime.date(int(y), int(m), int(d)) - datetime.date(1800, 1, 1)).days
    except ValueError:
        return None
    if 0 <= n < 146097:
        a, b = feistel(n // 773, n % 773, 189, 773, key, "date")
        now = datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)
        w = 1 if min(len(m), len(d)) < 2 else 2
        if "-" in x:
            return now.isoformat()
        mm, dd = f"{now.month:0{w}d}", f"{now.day:0{w}d}"
        return f"{mm}/{dd}/{now.year}" if american else f"{dd}{x[len(p[0])]}{mm}{x[len(p[0])]}{now.year}"


def mail(x, key):
    local, domain = x.split("@")
    half = -(-len(local) // 2)
    a, b = local[:half], local[half:]

    def shift(part, other, i):
        out = ""
        for k, c in enumerate(part):
            by = int(hashlib.sha256(f"{key}|mail|{i}|{k}|{len(local)}|{other.lower()}|{domain.lower()}".encode()).hexdigest()[:8], 16)
            first, size = next(((f, n) for f, n in (("a", 26), ("A", 26), ("0", 10)) if ord(f) <= ord(c) < ord(f) + n), (c, 1))
            out += chr((ord(c) - ord(first) + by % size) % size + ord(first))
        return out

    for i in range(1, 9):
        a, b = (shift(a, b, i), b) if i % 2 else (a, shift(b, a, i))
    return f"{a}{b}@{domain}"


PLAIN = {"mail": mail, "ip": ip, "date": date, "ssn": ssn, "card": card, "phone": phone}


def plain(text, key):
    found = []

    def one(m):
        for kind, pattern, _ in pseudonyms.KINDS:
            if re.fullmatch(pattern, m[0], re.A) and (now := PLAIN[kind](m[0], key)) is not None:
                found.append((kind, m[0], now))
                return now
        return m[0]

    return re.sub(pseudonyms.ANY, one, text, flags=re.A), found


def test_documents_as_the_plain_version_has_them(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op6_pseudonyms(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert sorted(got) == sorted(r["doc_id"] for r in docs)
    kinds = set()
    for r in docs:
        text, found = plain(r["text"] or "", queries.QUERY_KEY)
        assert (got[r["doc_id"]]["text"] or "") == text
        assert [tuple(x) for x in got[r["doc_id"]]["replaced"]] == found
        kinds |= {k for k, _, _ in found}
    assert {"mail", "ip", "card", "phone"} <= kinds


def run(spark, texts, key=KEY, **kw):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pseudonyms.pseudonymise(rows, key, **kw).orderBy("doc_id").collect()]


def test_odd_values_as_the_plain_version_has_them(spark):
    texts = [
        "4420 7946 0958", "25/12/2020 and 12/25/2020 and 1/5/2020 or 01/05/2020, 5.1.2020", "31/31/2020 0/0/0000 2020-1-1", "+14155552671 +1 415 555 2671 +1 (415) 555-2671 +44 20 7946 0958 +442079460958", "+999 12 345 6789",
        "John@x.com john@x.com JOHN.q+1@X.com", "4111-1111-1111-1111 378282246310005", "123-45-6789 899-99-9999 666-11-1111", "\ufdd0 10.1.2.3 \ufdd0 a@b.org", "a@b.org\ufdd0" * 3, "@ @@ a@b 1", "", "++1 415 555 2671", "x" * 70 + "@mail.org",
    ]
    assert run(spark, texts) == [plain(t, KEY)[0] for t in texts]


def test_notations_of_a_value_stay_linked(spark):
    digits = lambda t: re.sub(r"\D", "", t)
    phones = run(spark, ["+14155552671", "+1 415 555 2671", "+1 (415) 555-2671", "+1.415.555.2671"])
    assert len({digits(x) for x in phones}) == 1 and phones[0].startswith("+1") and digits(phones[0]) != "14155552671"
    mails = run(spark, ["John@x.com", "john@x.com", "JOHN@X.com"])
    assert len({x.lower() for x in mails}) == 1 and mails[0][0].isupper() and mails[1].islower()
    iso, german, american, short, british = run(spark, ["2020-12-25", "25.12.2020", "12/25/2020", "25.12.2020", "25/12/2020"])
    day = datetime.date.fromisoformat(iso)
    assert {datetime.datetime.strptime(x, f).date() for x, f in ((german, "%d.%m.%Y"), (american, "%m/%d/%Y"), (british, "%d/%m/%Y"), (short, "%d.%m.%Y"))} == {day} != {datetime.date(2020, 12, 25)}
    assert re.fullmatch(r"[1-9]\d?/[1-9]\d?/\d{4}", run(spark, ["1/5/2020"])[0])
    assert run(spark, ["4420 7946 0958"])[0] != "4420 7946 0958"


def test_restore_inverts(spark):
    texts = ["+14155552671, 4111 1111 1111 1111; a.Bc9@x.org 10.0.0.1 2020-02-29 123-45-6789", "nothing", None]
    assert run(spark, run(spark, texts), restore=True) == texts


def test_the_key_has_no_default(spark):
    with pytest.raises(TypeError):
        pseudonyms.pseudonymise(spark.createDataFrame([(1, "x")], "doc_id long, text string"))
