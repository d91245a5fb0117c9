import random
import re
from collections import defaultdict

from cladeloom.llm import pii


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def planted(rng):
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    low = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    return {
        "email": f"{low(4)}.{d(2)}@mail{rng.randint(0, 7)}.example.com", "phone": f"+1 ({rng.randint(200, 999)}) 555-{d(4)}",
        "ip": ".".join(str(rng.randint(1, 255)) for _ in range(4)), "card": "4" + d(15), "aws": "AKIA" + "".join(rng.choices("ABCDEFGHIJ234567", k=16)),
        "secret": "password=" + "".join(rng.choices("0123456789abcdef", k=18)), "token": 'token = "' + "".join(rng.choices("0123456789abcdef", k=40)) + '"',
        "ssn": f"{d(3)}-{d(2)}-{d(4)}",
    }


SHAPE = {
    "email": r"[a-z0-9]{4}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "ip": r"(\d{1,3}\.){3}\d{1,3}", "card": r"4\d{15}", "aws": r"AKIA[0-9A-Z]{16}",
    "secret": r"password=[0-9a-f]{18}", "token": r'token = "[0-9a-f]{40}"', "ssn": r"\d{3}-\d\d-\d{4}",
}


def test_every_planted_entity_is_replaced_one_to_one(spark):
    rng = random.Random(12)
    people = [planted(rng) for _ in range(60)]
    rows, marks = [], []
    for i in range(240):
        k, who = rng.choice(list(SHAPE)), rng.choice(people)
        rows.append((i, f"Anfang § {who[k]} Ende.\nétat {who['email'].upper()} 3.14 and 2024-01-02"))
        marks.append((k, who))
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, mentions string")
    out = {r["doc_id"]: r for r in pii.replace_pii(docs).collect()}
    forth, back = defaultdict(set), defaultdict(set)
    for (i, text), (k, who) in zip(rows, marks, strict=True):
        new = out[i]["text"]
        m = re.fullmatch(r"Anfang § (.*) Ende.\nétat (.*) 3.14 and 2024-01-02", new)
        assert m and re.fullmatch(SHAPE[k], m[1]), (text, new)
        assert who[k] not in new and who["email"].upper() not in new and out[i]["n_replaced"] == 2 and out[i]["mentions"] == "x"
        if k == "card":
            assert luhn(who[k]) <= luhn(m[1])
        for a, b in ((who[k], m[1]), (who["email"], m[2].lower())):
            forth[a].add(b)
            back[b].add(a)
    assert all(len(v) == 1 for v in forth.values()) and all(len(v) == 1 for v in back.values())


def test_names_keep_gender_script_and_coreference(spark):
    rows = [(1, "Frau Schmidt met Anna Schmidt and Mr. Klaus Weber."), (2, "Dr. Weber, Иван Петров. GB82 WEST 1234 5698 7654 32"), (3, "v1.2.3.4.5 12345 a.b"), (4, None), (5, ""), (None, "Mrs Schmidt"), (1, "Frau Schmidt"), (1, "Frau Schmidt")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.replace_pii(docs, "k").collect()
    assert len(out) == len(rows)
    by = {(r["doc_id"], r["n_replaced"]): r["text"] for r in out}
    m = re.fullmatch(r"Frau (\w+) met (\w+) (\w+) and Mr\. (\w+) (\w+)\.", by[1, 3])
    assert m[1] == m[3] != "Schmidt" and m[2] in pii.GIVEN["f", "latin"] and m[4] in pii.GIVEN["m", "latin"]
    n = re.fullmatch(r"Dr\. (\w+), (\w+) (\w+)\. (.*)", by[2, 3])
    assert n[1] == m[5] and n[2] in pii.GIVEN["m", "cyrillic"] and re.fullmatch("[А-Яа-я]+", n[3]) and re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", n[4])
    assert by[3, 0] == rows[2][1] and by[4, 0] is None and by[5, 0] == "" and by[None, 1] == f"Mrs {m[1]}" and by[1, 1] == f"Frau {m[1]}"
    assert pii.replace_pii(docs.limit(0)).count() == 0


def test_small_formats_never_collide(spark):
    values = [("given_f", f"Name{i}") for i in range(300)] + [("surname", f"X{i}") for i in range(300)] + [("ip", f"{a}.{b}.1.1") for a in range(1, 10) for b in range(1, 10)]
    values += [("digit", str(i)) for i in range(10)]
    got = pii.surrogates(spark.createDataFrame(values, "kind string, value string"), "k").collect()
    assert len(got) == len(values)
    assert len({(r["kind"], r["surrogate"]) for r in got}) == len(values)
    assert not {(r["kind"], r["surrogate"]) for r in got} & set(values)


def test_long_text(spark):
    text = "word " * 100_000 + "a.b@c.de " + "x" * 50_000
    out = pii.replace_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert out["n_replaced"] == 1 and "a.b@c.de" not in out["text"] and len(out["text"]) == len(text)


def test_long_entities_are_replaced_whole(spark):
    rng = random.Random(5)
    some = lambda n, of="abcdefghijklmnopqrstuvwxyzABCDEFGHIJ0123456789": "".join(rng.choices(of, k=n))
    host = ".".join("abcdefghijkl") + ".example.org"
    values = ["token=" + some(1000), "bearer: " + some(1000) + "." + some(1000), "sk-" + some(1000), some(1000, "0123456789abcdef"), f"{some(70)}.{some(900)}@mail.example.com", f"bob.{some(9)}@{host}", "token=" + some(10_000)]
    docs = spark.createDataFrame([(i, f"Anfang § {v} Ende.") for i, v in enumerate(values)], "doc_id long, text string")
    for r in pii.replace_pii(docs).collect():
        old = values[r["doc_id"]]
        new = re.fullmatch(r"Anfang § (.*) Ende\.", r["text"])[1]
        assert len(new) == len(old) and r["n_replaced"] == 1
        secret = old.split("@")[0] if "@" in old else re.sub(r"^(?:token=|bearer: |sk-)", "", old)
        same = sum(a == b for a, b in zip(secret, new[len(old.split(secret)[0]) :], strict=False))
        assert same < 0.3 * len(secret), (old, new)
    runs = spark.createDataFrame([(1, "a." * 20_000), (2, "a-" * 20_000), (3, "x@" + "a." * 20_000), (4, "é.bob@a.de ёbob@a.de bob@a.de.")], "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.replace_pii(runs).collect()}
    assert out[1] == ("a." * 20_000, 0) and out[2] == ("a-" * 20_000, 0)
    assert out[4][1] == 3 and "bob" not in out[4][0]
