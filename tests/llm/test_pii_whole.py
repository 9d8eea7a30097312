"""Values beside other values, and long ones."""

import re

from test_pii import luhn_ok, replaced

VISA = "4111 1111 1111 1111"


def test_cards_beside_other_numbers(spark):
    texts = [f"{VISA} 12/26", "room 12 4111111111111111", f"{VISA} 4111-1111-1111-1111", f"7 {VISA} 99 88", "12-4111111111111111-7 x", "4111111111111111 192.168.7.41", "4111111111111111 42.john@x.com", "555-123-4567 378282246310005"]
    out = replaced(spark, texts)
    for text, new in zip(texts, out, strict=True):
        assert not re.search(r"4111[ -]?1111[ -]?1111[ -]?1111|378282246310005", new), new
    same = replaced(spark, [VISA])[0]
    assert out[0] == f"{same} 12/26" and out[1] == "room 12 " + same.replace(" ", "") and out[2] == f"{same} {same.replace(' ', '-')}" and out[3] == f"7 {same} 99 88" and luhn_ok(same)
    assert out[4] == f"12-{same.replace(' ', '')}-7 x" and "192.168.7.41" not in out[5] and "42.john" not in out[6] and "555-123-4567" not in out[7]


def test_dates_of_timestamps(spark):
    out = replaced(spark, ["at 2024-03-15T10:00:00Z", "at 2024-03-15", "2024-03-15Tx"])
    assert out[0] == out[1] + "T10:00:00Z" and "2024-03-15" not in out[1] and out[2] == "2024-03-15Tx"


def test_long_runs_of_digits(spark):
    texts = ["1" * 50_000 + "x", " ".join(f"{i % 7}" for i in range(6000)) + "a"]
    assert len(replaced(spark, texts)) == 2


def test_long_secrets(spark):
    value = "".join(chr(97 + i * i % 23) + str(i % 10) for i in range(120))
    long = "aB3" * 4000
    out = replaced(spark, [f"token={value}", f"password: {long} end", f"token={value[:128]}", f"token={value[:128]}x"])
    assert len(out[0]) == len(value) + 6 and not any(value[i : i + 8] in out[0] for i in range(len(value) - 7))
    assert out[1].endswith(" end") and len(out[1]) == len(long) + 14 and "aB3aB3" not in out[1]
    assert out[0][:134] == out[2] == out[3][:-1]  # the first block as ever
    assert len({out[1][10 + 128 * 3 * i : 10 + 128 * 3 * (i + 1)] for i in range(20)}) == 20  # equal blocks, different keys
