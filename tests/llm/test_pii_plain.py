"""op3 and its permutations against plain Python: a Feistel network by loops, over all dates and many numbers."""

import datetime
import hashlib
import random
import re

import xxhash
from test_exact import documents
from test_pii import replaced

from edgeloom.llm import pii


def plain_feistel(values, bases, kind, key=pii.KEY):
    values = list(values)
    for r in range(1, pii.ROUNDS + 1):
        other = [str(v) for i, v in enumerate(values) if i % 2 != r % 2]
        h = hashlib.sha256("|".join([key, kind, ",".join(map(str, bases)), str(r), ",".join(other)]).encode()).hexdigest()
        for i in range(r % 2, len(values), 2):
            x = xxhash.xxh64(i.to_bytes(4, "little"), seed=xxhash.xxh64(h.encode(), seed=42).intdigest()).intdigest()
            values[i] = (values[i] + (x - 2**64 if x >= 2**63 else x) % bases[i]) % bases[i]
    return values


FIRST = datetime.date.fromisoformat(pii.FIRST_DAY)
IMAGE: dict[int, int] = {}


def next_day(n):
    if n not in IMAGE:
        a, b = plain_feistel(divmod(n, pii.DAY_BASES[1]), pii.DAY_BASES, "date")
        IMAGE[n] = a * pii.DAY_BASES[1] + b
    return IMAGE[n]


def plain_slash(day, month_first):
    """What a date with the year last becomes; month_first only where the day is over 12."""
    n, times = next_day((day - FIRST).days), 0
    while month_first and (FIRST + datetime.timedelta(n)).day <= 12:
        n, times = next_day(n), times + 1
    assert times < pii.AGAIN
    d = FIRST + datetime.timedelta(n)
    return d.strftime("%m/%d/%Y" if month_first else "%d/%m/%Y")


def test_all_dates_in_both_orders(spark):
    days = [FIRST + datetime.timedelta(n) for n in range(150 * 487)]
    out = {(d, o): plain_slash(d, o) for d in days for o in (False, True) if not o or d.day > 12}
    assert len(set(out.values())) == len(out) == 150 * 487 + sum(d.day > 12 for d in days)
    some = random.Random(4).sample(sorted(out), 1500)
    assert replaced(spark, [d.strftime("%m/%d/%Y" if o else "%d/%m/%Y") for d, o in some]) == [out[x] for x in some]


def plain_ssn(m):
    a, g, s = map(int, m.split("-"))
    a, g, s = plain_feistel([a - 1 - (a > 666), g - 1, s - 1], pii.SSN_BASES, "ssn")
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def plain_characters(m, kind):
    """Letters and digits, each within its own alphabet."""
    low = [next((b for b in "0aA" if ord(b) <= ord(c) < ord(b) + (10 if b == "0" else 26)), None) for c in m]
    new = iter(plain_feistel([ord(c) - ord(b) for c, b in zip(m, low, strict=True) if b], [10 if b == "0" else 26 for b in low if b], kind))
    return "".join(chr(ord(b) + next(new)) if b else c for c, b in zip(m, low, strict=True))


def plain_card(m):
    new = plain_feistel([int(c) for c in m if c.isdigit()][:-1], [10] * (sum(c.isdigit() for c in m) - 1), "card")
    total = sum(sum(divmod(2 * d, 10)) if i % 2 == 0 else d for i, d in enumerate(new[::-1]))
    digits = iter([*new, -total % 10])
    return "".join(str(next(digits)) if c.isdigit() else c for c in m)


def test_numbers_against_plain_python(spark):
    rng = random.Random(9)
    ssns = ["001-01-0001", "665-99-9999", "667-50-0001", "899-99-9999"]
    ssns += [f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(2000)]
    ssns = list(dict.fromkeys(ssns))
    out = replaced(spark, ssns)
    assert out == [plain_ssn(x) for x in ssns] and len(set(out)) == len(out)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", x) for x in out)
    assert not set(replaced(spark, out)) & set(out[:0]) and all(a != b for a, b in zip(out, replaced(spark, out), strict=True))  # found again
    mails = ["john.doe42@mail.example.com", "A.b-C_9@x.org"]
    assert replaced(spark, mails) == [plain_characters(m.split("@")[0], "email") + "@" + m.split("@")[1] for m in mails]
    cards = ["4111 1111 1111 1111", "378282246310005"]
    assert replaced(spark, cards) == [plain_card(m) for m in cards]


def test_long_local_parts(spark):
    local = "ab.cd9" * 60
    (out,) = replaced(spark, [f"to {local}@example.org, then"])
    assert re.fullmatch(r"to ([a-z]{2}\.[a-z]{2}\d){60}@example\.org, then", out) and "ab.cd9" not in out


def test_query_replaces_what_plain_patterns_find(spark):
    """Every e-mail address and social security number of the documents, and nothing in texts without digits, @, = and :."""
    before = dict(documents("/root/testdata/sf0.01"))
    rows = {r["doc_id"]: r for r in pii.op3_pii(spark, "/root/testdata/sf0.01").collect()}
    assert rows.keys() == before.keys()
    found = 0
    for i, text in before.items():
        new = rows[i]["text"]
        if text is None:
            assert new is None and rows[i]["replaced"] == 0
            continue
        for pattern, f in ((r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", plain_ssn), (r"(?<![\w.%+-])[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: plain_characters(m.split("@")[0], "email") + "@" + m.split("@")[1])):
            for m in re.findall(pattern, text, re.ASCII):
                found += 1
                assert m not in new and f(m) in new
        if not re.search(r"[\d@=:]", text):
            assert new == text and rows[i]["replaced"] == 0
    assert found > 10
