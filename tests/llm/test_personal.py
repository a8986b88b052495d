"""Personal data against the contract's patterns run as they are, checks against known numbers, scores by hand."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from geoloom.llm import personal, queries

from ..oracle import same

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
IBAN = "DE89370400440532013000"


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(x // 10 + x % 10 for x in doubled) % 10 == 0


def plain(text):
    keep = {
        "email": lambda m: True,
        "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
        "card": lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d),
        "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15,
    }
    return sorted((m.start(), list(PLAIN).index(k), k, m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if keep[k](m[0]))


def base(text):
    return [(s, personal.KINDS.index(k), k, e) for k, s, e, _ in personal.spans_of(text) if k in PLAIN]


def test_base_spans_are_those_of_the_plain_patterns():
    dice = random.Random(5)
    bits = ["a", "b.c", "@", "@x.y", ".", "-", " ", "1", "12", "255", "256", "4111111111111111", "+1", "(", ")", "0", "_", "é", "\n", "%", "٣"]
    for _ in range(6000):
        text = "".join(dice.choices(bits, k=dice.randint(1, 25)))
        assert base(text) == plain(text), text
    assert any(k == "card" for _, _, k, _ in base("pay 4111 1111-1111 1111 now"))


@pytest.mark.parametrize("piece", ["x", "1", "1.", "1-", "1 ", "+1 ", "@", "a@b", "a.", "+", "(", "DE89 ", "5-", "é"])
def test_time_follows_the_length(piece):
    text, began = piece * (2_000_000 // len(piece)), time.perf_counter()
    personal.spans_of(text)
    assert time.perf_counter() - began < 20


def test_checks():
    assert personal.passes_luhn("4111111111111111") and not personal.passes_luhn("4111111111111112")
    assert personal.passes_97(IBAN) and not personal.passes_97(IBAN[:-1] + "1")
    kinds = lambda t: [(k, t[a:b]) for k, a, b, _ in personal.spans_of(t)]
    assert kinds(f"to {IBAN}.") == [("iban", IBAN)]
    assert kinds("to DE89 3704 0044 0532 0130 00 AND MORE") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("BE68 5390 0754 7034 WORD") == [("iban", "BE68 5390 0754 7034")]
    assert kinds(f"{IBAN[:-1]}1 {IBAN}9 ZZ89370400440532013000") == []
    assert kinds("SSN 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("SSN 000-45-6789, 666-45-6789, 900-45-6789, 123-00-6789, 123-45-0000") == [] == kinds("a 123-45-6789 b")
    assert kinds("call (212) 555-0199 now") == [("local_phone", "(212) 555-0199")] and kinds("take (212) 555-0199 now") == []
    assert kinds("call +1 (212) 555-0199") == [("phone", "+1 (212) 555-0199")]


def test_words_nearby_move_the_score():
    at = lambda t: personal.spans_of(t)[0][3]
    far = "." * personal.NEAR
    assert at("10.0.0.1") == 0.6 and at("host 10.0.0.1") == 0.9 and at("version 10.0.0.1") == 0.3 and at("10.0.0.1 is the server version") == 0.6
    assert at(f"host{far}10.0.0.1") == 0.6 and at("4111111111111111 visa") == 1.0 and at("ghost 10.0.0.1") == 0.6
    assert personal.spans_of(f"order number {IBAN}")[0][3] == 0.6


TEXTS = [None, "", " ", "mail a.b@c.de or +49 (30) 1234567", "host 10.0.0.1", f"konto {IBAN}", "x" * 300_000 + "@y.zz", "ssn 123-45-6789 é 10.20.30.40", "1.2.3.4.5.6.7.8", "call 212-555-0199, 4111111111111111"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "_s", 7, "c") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], None, None, None)] * 2 + [(None, TEXTS[3], "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, _spans string, n_chars int, `a b.c` string")


def test_rows_and_columns_pass(docs):
    found = personal.found(docs)
    assert found.columns == [*docs.columns, "_spans_1"]
    rows = found.collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        assert [tuple(s) for s in r["_spans_1"]] == personal.spans_of(r.text) and (r["_spans"], r["a b.c"]) in (("_s", "c"), (None, None), ("x", "y"))
    assert personal.found(docs.where("false")).count() == 0


def test_masks(docs):
    got = {r.doc_id: r for r in personal.masked(docs).where("doc_id is not null").collect()}
    assert got[3].text == "mail [EMAIL] or [PHONE]" and got[3].n_chars == len(got[3].text) and got[7].text == "[SSN] é [IP]".replace("[SSN]", "ssn [SSN]")
    assert got[0].text is None and got[0].n_chars == 7 and got[1].text == "" and personal.masked(docs).columns == docs.columns
    assert [r.text for r in personal.masked(docs, least=0.95).where("doc_id = 4").collect()] == ["host 10.0.0.1"] * 3


def test_sql_on_awkward_rows(spark, docs, tmp_path):
    dice = random.Random(9)
    bits = ["mail ", "a.b@c.de", "@", " ", "10.0.0.1", "300.1.1.1", "+1 (212) 555-0199", "212-555-0199 ", "(212) 555-0199", "call ", "order ", IBAN, "DE89 3704 0044 0532 0130 00 ", "123-45-6789", "ssn ", "4111 1111 1111 1111", "é", "\n", "-", "word "]
    more = [(100 + k, "".join(dice.choices(bits, k=dice.randint(1, 30)))) for k in range(400)]
    docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string")).withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text")}).write.parquet(str(tmp_path / "documents.parquet"))
    from ..oracle import TABLES

    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"/root/testdata/sf0.001/{t}.parquet")
    same(queries.queries()["op11_personal_data"], queries.oracle_sql()["op11_personal_data"], spark, str(tmp_path))
