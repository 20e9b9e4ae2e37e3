import random

from helpers import ODD, frame, prose

from loomgraph.llm import pii, secrets


def test_permutations_are_bijective_and_valid():
    for n in (1, 2, 3):
        assert sorted(pii.digits(str(i).zfill(n), pii.KEY, "x") for i in range(10**n)) == [str(i).zfill(n) for i in range(10**n)]
    cards = [c for i in range(3000) if pii.luhn(c := f"49{i:014d}")]
    new = [pii._card(c, pii.KEY) for c in cards]
    assert len(set(new)) == len(cards) and all(map(pii.luhn, new)) and all(len(c) == 16 for c in new)
    days = [f"2024-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    assert len({pii._date(x, pii.KEY) for x in days}) == len(days)
    assert pii._mod97(pii._iban("GB82WEST12345698765432", pii.KEY)) == 1


def test_equal_values_stay_linked_and_invalid_ones_stay():
    a, n = pii.pseudonymise("call +1 (017) 555-7713 or write jo.34@mail.example.com; card 4929-9485-0000-0003 x", b"k")
    b, _ = pii.pseudonymise("+10175557713, jo.34@mail.example.com.", b"k")
    digits = lambda s: "".join(c for c in s if c.isdigit())
    assert n["phone"] == 1 and n["email"] == 1
    assert digits(a.split(" or ")[0]) == digits(b.split(",")[0]) and a.split("write ")[1].split(";")[0] == b.split(", ")[1].rstrip(".")
    for text in ("4929948500000001", "300.1.1.1", "2024-02-31", "000-12-3456", "no data 12345", ""):
        assert pii.pseudonymise(text)[0] == text
    assert pii.pseudonymise("10.0.0.1")[0] != "10.0.0.1" and pii.pseudonymise("31.12.1999")[0] != "31.12.1999"


def test_numbers_side_by_side():
    card, iban, phone = "4111111111111111", "BE68539007547034", "555-123-4567"
    new_card, new_iban = pii._card(card, pii.KEY), pii._iban(iban, pii.KEY)
    apart = " ".join(new_card[k : k + 4] for k in range(0, 16, 4))
    for text, want in (
        (f"12 {card}", f"12 {new_card}"), (f"7-{card} 250", f"7-{new_card} 250"), (f"{card} 12", f"{new_card} 12"), (f"{card} {card}", f"{new_card} {new_card}"),
        ("12 34 4111 1111 1111 1111 251", f"12 34 {apart} 251"), (f"{iban} 250", f"{new_iban} 250"), (f"{iban} BIC", f"{new_iban} BIC"), (f"{iban} BANKER", f"{new_iban} BANKER"),
        (f"AB12 {iban}", f"AB12 {new_iban}"), (f"XX12 {card}", f"XX12 {new_card}"), (f"\u0661\u0662 {card}", f"\u0661\u0662 {new_card}"),
        (f"123 {phone}", f"123 {pii._phone(phone, pii.KEY)}"), ("12 34 56 78 90 12 34 50", "12 34 56 78 90 12 34 50"), (f"x{card} y", f"x{card} y"),
    ):
        assert pii.pseudonymise(text)[0] == want, text
    assert pii.pseudonymise(f"{card} 12 {card}")[1] == {"card": 2}


def test_table(spark):
    docs = frame(spark, (1, "ip 10.1.2.3"), (1, "ip 10.1.2.3"), (2, "again 10.1.2.3 ok"), *ODD)
    got = [(r["doc_id"], r["text"], r["n_ip"]) for r in pii.pseudonyms(docs).collect()]
    new = pii._ip("10.1.2.3", pii.KEY)
    assert got.count((1, f"ip {new}", 1)) == 2 and (2, f"again {new} ok", 1) in got
    assert {(i, t, 0) for i, t in ODD} <= set(got) and len(got) == 3 + len(ODD)
    assert pii.pseudonyms(docs.limit(0)).count() == 0


def test_held_out_accuracy():
    words = [w for w in prose(3, 4000).split() if w.isalpha()] + ["name", "value", "index"]
    table = secrets.train(words)
    import numpy as np

    def llr(strings):
        raw = np.frombuffer(" ".join(strings).encode(), np.uint8)
        s, e = secrets.tokens(raw, np.array([0, len(raw)]))
        return secrets.score(raw, s, e, table)

    assert (llr(secrets.random_strings(1000, 99)) > secrets.LOG_ODDS).mean() > 0.98
    plain = [x for x in secrets.ordinary_strings(words, 2000, 99) if len(x) >= 16]
    assert (llr(plain) > secrets.LOG_ODDS).mean() < 0.005


def test_secret_places(spark):
    g = random.Random(2)
    key = "".join(g.choice("0123456789abcdef") for _ in range(40))
    text = prose(1, 50) + f' é token = "{key}" ' + prose(2, 30)
    docs = frame(spark, (1, text), (2, text[:40]), (None, text), *[(k, prose(k, 80)) for k in range(10, 30)], *ODD[1:])
    got = [tuple(r)[:3] for r in secrets.secrets(docs).collect()]
    at = text.encode().index(key.encode())
    assert (1, at, 40) in got and {i for i, *_ in got} <= {1, 904}
    assert secrets.secrets(docs.limit(0)).count() == 0


def test_runs_do_not_pass_rows():
    import numpy as np

    s, e = secrets.tokens(np.frombuffer(b"a" * 20 + b"b" * 10 + b" " + b"c" * 16, np.uint8), np.array([0, 20, 30, 47]))
    assert list(zip(s, e)) == [(0, 20), (31, 47)]


def test_keys_glued_to_ordinary_text():
    import numpy as np

    words = [w for w in prose(3, 4000).split() if w.isalpha()] + ["name", "value", "index", "client", "secret", "token", "long", "variable", "home", "user", "file"]
    table = secrets.train(words)
    g = random.Random(4)
    key = lambda n, letters="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789": "".join(g.choice(letters) for _ in range(n))
    ordinary = ["/".join(g.choice(words) for _ in range(60)), "_".join(g.choice(words) for _ in range(60)), "_".join(g.choice(words) for _ in range(60)).upper()]
    missed = 0
    for name in ordinary:
        for sep in "=/":
            for k in (key(32), key(40), key(40, "0123456789abcdef")):
                raw = np.frombuffer(f"{name}{sep}{k}".encode(), np.uint8)
                off, at = np.array([0, len(raw)]), len(name) + 1
                assert secrets.score(raw, off[:1], off[1:], table)[0] < secrets.LOG_ODDS  # the whole run hides it
                missed += not any(s <= at and e == len(raw) and s > at - 20 for s, e, _ in zip(*secrets.findings(raw, off, table)))
    assert missed <= 1
    two = f"{ordinary[0]}={key(40)}/{ordinary[0]}={key(40)}"
    raw = np.frombuffer(two.encode(), np.uint8)
    assert len(secrets.findings(raw, np.array([0, len(raw)]), table)[0]) == 2
    plain = secrets.ordinary_strings(words, 2000, 99)
    raw = np.frombuffer(" ".join(plain).encode(), np.uint8)
    assert len(secrets.findings(raw, np.array([0, len(raw)]), table)[0]) < 10
