import random
import re
from collections import Counter

import pytest

from thicket.llm import op5_pii as op

TEXT = "call +1 (625) 555-7196 4111111111111111 or 010-1234, mail jo.n40@mail6.example now; 40.34.141.122 on 2024-02-29 and 2024-02-30. 123-45-6789 999.1.1.1 1.2.3 GB82WEST12345698765432 4111 1111 1111 1111 12 4111111111111112"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    f = op.Feistel(b"k", "t", n)
    assert sorted(f(x) for x in range(n)) == list(range(n))
    assert n < 90 or [op.Feistel(b"other", "t", n)(x) for x in range(n)] != [f(x) for x in range(n)]


def test_values_change_and_keep_their_format():
    new, spans = op.Pseudonyms(b"k")(TEXT)
    assert Counter(k for k, _, _ in spans) == {"phone": 1, "card": 2, "mail": 1, "ip": 1, "date": 1, "ssn": 1, "iban": 1}
    for kind, a, b in spans:
        assert TEXT[a:b] not in new, kind
    assert "2024-02-30" in new and "999.1.1.1" in new and "010-1234" in new and "4111111111111112" in new and len(new) == len(TEXT) or "." in new
    m = re.search(r"\+1 \((\d{3})\) (\d{3})-\d{4} (\d{16}) or", new)
    assert m and m[1][0] in "23456789" and op.check_digit(m[3][:-1]) == int(m[3][-1])
    assert re.search(r"mail [a-z]{2}\.[a-z]\d\d@[a-z]{4}\d\.example now", new)
    iban = re.search(r"GB\d\d[A-Z]{4}\d{14}", new)[0]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def test_equal_values_stay_linked_and_different_ones_apart():
    p = op.Pseudonyms(b"k")
    a, b = (p(f"{x} 192.168.0.7 end")[0].split()[1] for x in ("left", "on the other page"))
    assert a == p("x 192.168.0.7")[0].split()[1] and a != "192.168.0.7" and b == "the"
    ips = {p(f"10.0.{i}.{j}")[0] for i in range(20) for j in range(20)}
    assert len(ips) == 400
    mails = {p(f"user{i}@example.org")[0] for i in range(300)}
    assert len(mails) == 300
    dates = {p(f"{y}-01-{d:02d}")[0] for y in range(1990, 2010) for d in range(1, 29)}
    assert len(dates) == 560 and all(re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", d) for d in dates)


def test_long_addresses():
    long = "a" * 300 + "1@" + "b" * 60 + ".example"
    new, spans = op.Pseudonyms(b"k")(long)
    assert new != long and len(new) == len(long) and spans == [("mail", 0, len(long))]


def test_clean_and_odd_texts(spark):
    clean = ["", None, "no numbers", "12 of 300, version 3.1.4, 50% or 1234567", "#" * 10, "a@b", "1" * 100_000]
    rows = [(i, t, 0) for i, t in enumerate(clean)] + [(None, TEXT, 1), (None, TEXT, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_found int")
    got = op.pseudonymise(df, ["doc_id", "n_found"], b"k").collect()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [by[i].text for i in range(len(clean))] == clean and all(not by[i]._found for i in by)
    assert len({r.text for r in got if r.doc_id is None}) == 1 and sum(r.doc_id is None for r in got) == 2
    assert op.pseudonymise(df.limit(0), ["doc_id"], b"k").count() == 0


def luhn(digits):
    """By the rule as it is usually told: from the right, every second digit twice, with the digits of each product added."""
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(digits))) % 10 == 0


def valid(kind, v):
    """Plain tests of each format, not those of the operator."""
    import datetime
    import ipaddress

    if kind == "ip":
        return str(ipaddress.ip_address(v)) == v
    if kind == "card":
        return luhn(v.replace(" ", "").replace("-", ""))
    if kind == "ssn":
        a, b, c = v.split("-")
        return int(a) not in (0, 666) and int(a) < 900 and int(b) > 0 and int(c) > 0
    if kind == "date":
        return 1900 <= datetime.date.fromisoformat(v).year <= 2099
    if kind == "iban":
        return int("".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in v[4:] + v[:4])) % 97 == 1
    return True


def planted(rng):
    """(kind, value): a valid one, made without the operator."""
    import datetime

    kind = rng.choice(["ip", "card", "ssn", "date", "iban", "mail", "phone"])
    if kind == "ip":
        return kind, ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = "".join(rng.choice("0123456789") for _ in range(15))
        if len(set(body)) == 1:
            return planted(rng)
        d = next(d for d in "0123456789" if luhn(body + d))
        sep = rng.choice(["", " ", "-"])
        return kind, sep.join((body + d)[i : i + 4] for i in range(0, 16, 4))
    if kind == "ssn":
        return kind, f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
    if kind == "date":
        return kind, (datetime.date(1900, 1, 1) + datetime.timedelta(rng.randint(0, 73_048))).isoformat()
    if kind == "iban":
        body = "".join(rng.choice("0123456789") for _ in range(18))
        return kind, next(f"DE{c:02d}{body}" for c in range(2, 99) if valid("iban", f"DE{c:02d}{body}"))
    if kind == "mail":
        return kind, f"{''.join(rng.choice('abcXYZ019_') for _ in range(rng.randint(1, 9)))}@h{rng.randint(0, 99)}.example"
    return kind, f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04d}"


def test_planted_values_are_found_where_they_stand_and_nothing_else():
    rng = random.Random(9)
    p, image = op.Pseudonyms(b"k"), {}
    for _ in range(400):
        parts, want, at = [], [], 0
        for _ in range(rng.randint(0, 12)):
            word = rng.choice(["plain", "12", "3.14", "v1.2.3", "a@b", "2024-02-30", "999.1.1.1", "no.", "(x)"])
            parts.append(word)
            at += len(word) + 1
            if rng.random() < 0.5:
                kind, v = planted(rng)
                # a word between, so that no two numbers stand side by side
                parts += [v, "and"]
                want.append((kind, at, at + len(v)))
                at += len(v) + 5
        text = " ".join(parts)
        new, spans = p(text)
        assert spans == want, text
        moved, last = 0, 0
        for kind, a, b in spans:
            assert new[last + moved : a + moved] == text[last:a]
            end = new.index(" and", a + moved) if kind in ("ip",) else b + moved
            made = new[a + moved : end]
            assert valid(kind, made), (kind, text[a:b], made)
            assert image.setdefault((kind, text[a:b]), made) == made
            last, moved = b, end - b
        assert new[last + moved :] == text[last:]
    assert len({(k, v) for (k, _), v in image.items()}) == len(image)  # different values stay apart


def test_every_day_becomes_another_day():
    import datetime

    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(i)).isoformat() for i in range(73_049)]
    assert sorted(op.date(d, b"k") for d in days) == days


def test_a_date_that_goes_on_is_none():
    p = op.Pseudonyms(b"k")
    for text in ("2024-02-29-1", "2024/02/29/7", "1.2.2024.5"):
        assert p(text) == (text, [])
    assert p("2024-02-29.")[1] == [("date", 0, 10)] and p("2024-02-29-x")[1] == [("date", 0, 10)]


def test_many_values_in_one_text():
    import time

    def took(n):
        text = " ".join(f"10.{i % 250}.{i // 250 % 250}.{i // 62500}" for i in range(n)) + " 2001-01-01 x@y.example"
        p = op.Pseudonyms(b"k")
        p(text)  # values are remembered
        began = time.perf_counter()
        assert len(p(text)[1]) == n + 2
        return time.perf_counter() - began

    assert took(32_000) < 30 * took(4_000) + 0.5


def test_columns_of_any_name_and_a_required_key(spark):
    df = spark.createDataFrame([(1, "at 10.0.0.1", 5, "x", "y")], "doc_id long, text string, _text int, _new string, _found string")
    got = op.pseudonymise(df, df.columns, b"k")
    assert got.columns == ["doc_id", "_text", "_new", "text", "_found"] and got.first()[:3] == (1, 5, "x") and got.first().text != "at 10.0.0.1"
    with pytest.raises(TypeError):
        op.pseudonymise(df, ["doc_id"])
