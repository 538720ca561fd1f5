"""The Feistel network in plain Python, against the pseudonyms."""

import random
from datetime import date, timedelta
from hashlib import sha256

from tidemark.llm import pii

KEY = "brute"


def digest(*parts):
    inner, outer = (sha256(f"{use}|{KEY}".encode()).hexdigest() for use in ("inner", "outer"))
    return sha256((outer + sha256("|".join([inner, *map(str, parts)]).encode()).hexdigest()).encode()).hexdigest()


def pair(a, b, ma, mb, kind):
    for r in range(1, pii.ROUNDS + 1):
        a, b, ma, mb = b, (a + int(digest(kind, r, b)[:15], 16)) % ma, mb, ma
    return a, b


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10


def card(d):
    inner = d[1:-1]
    h = len(inner) // 2
    a, b = pair(int(inner[:h]), int(inner[h:]), 10**h, 10 ** (len(inner) - h), "card")
    body = d[0] + str(a).zfill(h) + str(b).zfill(len(inner) - h)
    return next(body + str(c) for c in range(10) if luhn(body + str(c)) == 0)


def ssn(m):
    area, group, serial = int(m[:3]), int(m[4:6]), int(m[7:])
    a, b = pair(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "ssn")
    return f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def ip(m):
    o = list(map(int, m.split(".")))
    a, b = pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def phone(m):
    a, b = pair(int(m[1:4]) - 200, int(m[6:9] + m[10:]) - 2000000, 800, 8000000, "phone")
    d = f"{a + 200}{b + 2000000}"
    return f"({d[:3]}) {d[3:6]}-{d[6:]}"


def day(d):
    n = (d - date(1900, 1, 1)).days
    a, b = pair(n // 4297, n % 4297, 17, 4297, "date")
    return (date(1900, 1, 1) + timedelta(days=a * 4297 + b)).isoformat()


def email(m):
    name, host = m.split("@")
    a, b = name[: len(name) // 2], name[len(name) // 2 :]
    for r in range(1, pii.ROUNDS + 1):
        out = ""
        for i, c in enumerate(a):
            n = int(digest("email", r, i // 16, b)[4 * (i % 16) : 4 * (i % 16) + 4], 16)
            first, size = (97, 26) if c.islower() else (65, 26) if c.isupper() else (48, 10)
            out += chr(first + (ord(c) - first + n) % size) if c.isalnum() else c
        a, b = b, out
    return f"{a}{b}@{host}"


def test_pseudonyms_are_those_of_the_network(spark):
    rng = random.Random(8)
    want = {}
    for _ in range(25):
        body = str(rng.randint(2, 6)) + "".join(rng.choice("0123456789") for _ in range(rng.randint(11, 17)))
        d = next(body + str(c) for c in range(10) if luhn(body + str(c)) == 0)
        want[d] = card(d)
        m = f"{rng.choice([1, 200, 665, 667, 899]):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"
        want[m] = ssn(m)
        m = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        want[m] = ip(m)
        m = f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(0, 9999):04d}"
        want[m] = phone(m)
        d = date(1900, 1, 1) + timedelta(days=rng.randrange(17 * 4297))
        want[d.isoformat()] = day(d)
        m = "".join(rng.choice("abXY09._") for _ in range(rng.randint(0, 40))) + "z@h.example"
        m = "q" + m
        want[m] = email(m)
    got = pii.pseudonymise(spark.createDataFrame([(v,) for v in want], "text string"), KEY).collect()
    assert sorted(r.text for r in got) == sorted(want.values())
    again = pii.pseudonymise(spark.createDataFrame([(v,) for v in want], "v string").selectExpr("v", "v as text"), KEY).collect()
    assert {r.v: r.text for r in again} == want


def test_the_query_takes_its_key_from_the_session(spark, tmp_path):
    spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    trial = pii.op7(spark, str(tmp_path)).first().text
    spark.conf.set(pii.KEY_CONF, KEY)
    try:
        assert pii.op7(spark, str(tmp_path)).first().text == card("4111111111111111") != trial
    finally:
        spark.conf.unset(pii.KEY_CONF)
