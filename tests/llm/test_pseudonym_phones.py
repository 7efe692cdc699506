"""Phones and addresses against a version of their own in Python."""

import random
import re

from billrate.llm import pseudonyms
from test_operators import feistel

CODES = range(1000)
USED = [c for c in CODES if c >= 200 and c % 100 != 11]
OTHER = [c for c in CODES if c not in USED]


def phone(digits, key):
    area, exchange, last = int(digits[:3]), int(digits[3:6]), int(digits[6:])
    if area in USED and exchange in USED:
        areas, exchanges, tweak = USED, USED, "phone"
    elif area in USED:
        areas, exchanges, tweak = USED, OTHER, "phone-exchange"
    else:
        areas, exchanges, tweak = OTHER, list(CODES), "phone-area"
    n = len(exchanges)
    a, b = feistel(areas.index(area) * n + exchanges.index(exchange), last, len(areas) * n, 10**4, tweak, key)
    return f"{areas[a // n]:03d}{exchanges[a % n]:03d}{b:04d}"


def test_phones_of_every_form_and_code(spark):
    rng = random.Random(2)
    codes = [0, 11, 17, 199, 200, 210, 211, 212, 299, 310, 311, 312, 800, 910, 911, 912, 999, *rng.sample(CODES, 20)]
    numbers = [f"{rng.choice(codes):03d}{rng.choice(codes):03d}{rng.randrange(10**4):04d}" for _ in range(300)]
    shapes = ["+1 ({}) {}-{}", "({}) {}-{}", "+44 {} {} {}", "{}-{}-{}", "{}.{}.{}"]
    rows = [(k, shapes[k % 5].format(d[:3], d[3:6], d[6:])) for k, d in enumerate(numbers)]
    docs = spark.createDataFrame([(k, f"call {t} today") for k, t in rows], "doc_id long, text string")
    out = pseudonyms.replace(docs, "key").cache()
    changed = 0
    for r in out.collect():
        d, shape = numbers[r.doc_id], shapes[r.doc_id % 5]
        valid = int(d[:3]) in USED and int(d[3:6]) in USED
        new = phone(d, "key") if valid or shape[0] in "+(" else d
        assert r.text == f"call {shape.format(new[:3], new[3:6], new[6:])} today" and r.n_replaced == (new != d)
        assert valid == (int(new[:3]) in USED and int(new[3:6]) in USED)
        changed += new != d
    assert 150 < changed < 300
    back = pseudonyms.replace(out.select("doc_id", "text"), "key", back=True)
    assert sorted(map(tuple, back.select("doc_id", "text").collect())) == sorted(map(tuple, docs.collect()))


def test_what_is_no_phone_or_address_stays(spark):
    texts = ["000-000-0000", "211-555-0100", "212.911.0100", "from 010.001.1.1", "from 1.2.3.04", "at 0.0.0.0", "from 10.0.0.1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = pseudonyms.replace(docs, "key")
    got = {r.doc_id: (r.text, r.n_replaced) for r in out.collect()}
    assert [got[k] for k in range(5)] == [(t, 0) for t in texts[:5]]
    assert got[5][1] == got[6][1] == 1 and not re.search(r"\b0\d", got[5][0] + got[6][0])
    back = pseudonyms.replace(out.select("doc_id", "text"), "key", back=True)
    assert sorted(map(tuple, back.select("doc_id", "text").collect())) == list(enumerate(texts))


def test_no_documents(spark):
    assert pseudonyms.replace(spark.createDataFrame([], "doc_id long, text string"), "key").count() == 0
