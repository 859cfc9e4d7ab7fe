"""Nothing of a detected original is left."""

import re

from .test_pii import luhn, texts

LONG = "".join("aB3dE6gH9k"[i % 10] for i in range(365))

LEFT = [
    (f'token = "{LONG}" end', [LONG[i : i + 20] for i in range(0, 340, 20)]),
    ("token=" + "x7" * 20_000, ["x7x7x7"]),
    ("secret: eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4.", ["eyJhbGciOiJIUzI1", "eyJzdWIiOiIxMjM0", "SflKxwRJSMeKKF2QT4"]),
    ("Password: correcthorse7 x", ["correcthorse7"]),
    ("password=p@ss.word1!x y", ["p@ss", "word1"]),
    ("AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMIK7MDENGbPxRfi", ["wJalrX", "MDENG"]),
    ("Api-Key: abcdefgh12345", ["abcdefgh", "12345"]),
    ("Mrs Anna Maria Luise Schmidt left", ["Anna", "Maria", "Luise", "Schmidt"]),
    ("ip 2001:db8::8a2e:370:7334 and fe80::1ff.", ["2001:db8", "8a2e", "7334", "fe80", "1ff"]),
    ("card 3782 822463 10005", ["3782 822463", "822463", "10005"]),
    ("call 555 123 4567 or 020 7946 0958 now", ["123 4567", "555 123", "7946", "0958"]),
    ("call +33 1 23 45 67 89 or +44 (0)20 7946 0958 now", ["23 45 67 89", "7946", "0958"]),
]


def test_no_part_of_an_original_is_left(spark):
    _, out = texts(spark, [row for row, _ in LEFT])
    for i, (_, originals) in enumerate(LEFT):
        assert not [x for x in originals if x in out[i]], out[i][:200]


def test_mentions_agree_in_every_form(spark):
    _, out = texts(spark, ["Mrs Anna Maria Schmidt and Mrs Schmidt, Mrs Anna Schmidt", "2001:db8::1 2001:0db8:0000:0000:0000:0000:0000:0001 2001:DB8:0:0:0:0:0:1 2001:db8::2", "3782 822463 10005 378282246310005", "Mr " + " ".join(["Abcd"] * 9_000)])
    full, alone, two = re.findall(r"Mrs ((?:[A-Z]\w+ ?)+)", out[0])
    a, m, s = full.split()
    assert alone == s and two.split() == [a, s] and len({a, m, s}) == 3
    a, b, c, d = out[1].split()
    assert a == b and a.lower() == c.lower() != d
    a, b = re.fullmatch(r"(\d{4} \d{6} \d{5}) (\d{15})", out[2]).groups()
    assert a.replace(" ", "") == b and luhn(b)
    assert "Abcd" not in out[3] and len(out[3].split()) == 9_001


def test_programs_stay(spark):
    rows = ["std::vector a[1::2] Face::Bad feed::ab", "token == other", "tokens: a, b"]
    _, out = texts(spark, rows)
    assert list(out.values()) == rows


def test_full_shapes_get_surrogates(spark):
    rows = [f"{c}.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows = [f"me@{r}" for r in rows] + [f"{c}@full.example.org" for c in "abcdefghijklmnopqrstuvwxyz0123456789"] + ["__@full.example.org"] + [f"token={'-' * 7}{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    _, out = texts(spark, [" , ".join(rows)])
    new = out[0].split(" , ")
    assert len(set(new)) == len(new) == len(rows) and not set(new) & set(rows)


def test_crowded_phones_get_surrogates(spark):
    rows = [f"+1{i:04d}" for i in range(9_000)]
    _, out = texts(spark, [" , ".join(rows), "+10001"])
    new = out[0].split(" , ")
    assert len(set(new)) == len(rows) and not set(new) & set(rows) and out[1] == new[1]
    assert all(re.fullmatch(r"\+\d{5,}", x) for x in new)
