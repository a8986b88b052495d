"""Personal data in texts: patterns propose spans, checks confirm them, words nearby adjust a score.

1. Each kind's pattern proposes leftmost spans that don't overlap within the kind.
2. A validator confirms or drops a proposal: parts of an address at most 255, Luhn's digit sum for card
   numbers, the remainder of 97 and the declared length of the country for bank accounts (IBAN), the numbers
   that are never issued for social security numbers, counts of digits for telephone numbers. A dropped
   proposal isn't tried again with another length.
3. The score is the kind's own weight, raised by MORE for words of the kind within NEAR code points before
   or after the span, and lowered by LESS for words that speak against it (order and serial numbers,
   versions, examples); it lies between 0 and 1.

The base kinds are email, ip, card and phone: all that are confirmed are returned, with their scores. The
further kinds (iban, ssn, local_phone) come only with a score of LEAST or more; a checked bank account
reaches it alone, the other two need words nearby. Further spans are added to base ones and never replace
them; a local number inside a base span isn't listed again.

Rows are handled where they are read: nothing is shuffled, a task holds one batch of rows, and each pattern
takes time in proportion to the text, whatever the text. Positions are code points, the end exclusive.

Defined results: null text counts as empty (no spans); very long texts are searched whole; repeated rows are
searched each; spans that begin at one place are listed in the order of KINDS; an empty table gives an empty
one; all other columns, whatever their names, pass through (the spans' column takes its name or the first
free one, name_1, ...).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import free, once, own_columns, small_batches, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "local_phone")
SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"
NEAR, MORE, LESS, LEAST = 40, 0.3, 0.3, 0.6
#: A confirmed span's score without any word nearby.
WEIGHT = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "local_phone": 0.4}
FOR = {
    "email": "e-?mail|contact|write to|reach",
    "ip": "ip|address|host|server|login|client",
    "card": "card|visa|mastercard|amex|credit|debit|payment|expir[a-z]+|cvv",
    "phone": "phone|tel|call|mobile|cell|fax|whatsapp",
    "iban": "iban|account|bank|bic|swift|konto|compte|cuenta",
    "ssn": "ssn|social security|tax(?:payer)? id",
    "local_phone": "phone|tel|telephone|call|mobile|cell|fax|whatsapp",
}
AGAINST = "order|invoice|serial|version|build|isbn|tracking|sku|example"
#: Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24,
    "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
#: As the contract's patterns: what stands before a digit run can't lead to another match inside it.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+-])(?:\([0-9]{3}\)\x20?|(?<![A-Za-z_])[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![A-Za-z0-9_-])")
_NOT_DIGITS = re.compile("[^0-9]+")
_WORD = {kind: re.compile(rf"(?<![A-Za-z0-9])(?:{words})(?![A-Za-z0-9])", re.I | re.A) for kind, words in FOR.items()}
_WORD_AGAINST = re.compile(rf"(?<![A-Za-z0-9])(?:{AGAINST})(?![A-Za-z0-9])", re.I | re.A)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ back over its local part and on over its domain: a search from the left would begin anew
    at each letter of a long run that no @ ends."""
    free_from, at = 0, text.find("@")
    while at >= 0:
        local = text[free_from:at]
        begin = free_from + len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        free_from = domain.end() if domain else at + 1
        at = text.find("@", free_from)


def passes_luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def passes_97(account: str) -> bool:
    """Of an account number without blanks: 1 remains of the number that its letters and digits spell."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) < 4 and int(p or 0) <= 255 for part in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() and 12 <= len(digits := _NOT_DIGITS.sub("", m[0])) <= 19 and passes_luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of the declared length, in groups parted by single blanks or none."""
    for head in _IBAN.finditer(text):
        length = IBAN_LENGTHS.get(head[0][:2], 0)
        whole = length and re.compile(rf"[A-Z0-9]{{4}}(?:\x20?[A-Z0-9]){{{length - 4}}}(?![A-Za-z0-9_])").match(text, head.start())
        if whole and passes_97(whole[0].replace(" ", "")):
            yield whole.span()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def _local_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _LOCAL_PHONE.finditer(text):
        yield m.span()


_PROPOSED: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns, "local_phone": _local_phones}


def score(text: str, kind: str, start: int, end: int) -> float:
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    near = lambda words: bool(words.search(before) or words.search(after))
    return min(1.0, max(0.0, round(WEIGHT[kind] + MORE * near(_WORD[kind]) - LESS * near(_WORD_AGAINST), 3)))


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by start and then by kind."""
    found: list[tuple[int, int, int, float]] = []
    if not text:
        return []
    for k, kind in enumerate(KINDS):
        base = sorted(found) if kind == "local_phone" else []
        for start, end in _PROPOSED[kind](text):
            value = score(text, kind, start, end)
            if kind in BASE or value >= LEAST and not _inside(start, base):
                found.append((start, k, end, value))
    return [(KINDS[k], start, end, value) for start, k, end, value in sorted(found)]


def _inside(start: int, base: list[tuple[int, int, int, float]]) -> bool:
    return any(a <= start < b for a, _, b, _ in base)


def _spans(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in spans_of(t)])


def found(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with _spans, the personal data of each text."""
    return docs.withColumn(free(docs, "_spans"), once(F.pandas_udf(_spans, SPANS))(F.coalesce(F.col(f"`{column}`"), F.lit(""))))


def masked(docs: DataFrame, least: float = LEAST, column: str = "text") -> DataFrame:
    """docs with each span of the given score or more replaced by its kind in brackets, overlapping spans by
    that of the first; n_chars, where there is such a column, follows. Texts without one stay as they are."""
    out = found(docs, column)
    spans, clean = out.columns[-1], free(out, "_clean")
    done = once(F.pandas_udf(_masked, "string"))(F.col(f"`{column}`"), F.filter(spans, lambda s: s["score"] >= least))
    out = out.withColumn(clean, F.when(F.size(spans) > 0, done).otherwise(F.col(f"`{column}`")))
    own = []
    for c, as_is in zip(docs.columns, own_columns(docs), strict=True):
        if c == "n_chars":
            as_is = F.when(F.size(spans) > 0, F.char_length(clean).cast(docs.schema[c].dataType)).otherwise(as_is).alias(c)
        own.append(F.col(clean).alias(c) if c == column else as_is)
    return out.select(*own)


def _masked(text: pd.Series, spans: pd.Series) -> pd.Series:
    def one(t: str | None, own) -> str | None:
        parts, at = [], 0
        for s in own if t is not None else ():
            if s["start"] >= at:
                parts += [t[at : s["start"]], f"[{s['kind'].upper()}]"]
            at = max(at, s["end"])
        return None if t is None else "".join(parts) + t[at:]

    return pd.Series([one(t, own) for t, own in zip(text, spans, strict=True)], dtype=object)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = found(small_batches(table(spark, sf_dir, "documents").select("doc_id", "text")))
    of = lambda *kinds: F.filter("_spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = of(*BASE)
    return docs.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


def _sql() -> str:
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
    luhn = f"list_sum(list_transform(range(1, length({digits('m')}) + 1), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * substr(reverse({digits('m')}), i, 1)::INT) // 10 + (CASE WHEN i % 2 = 1 THEN 1 ELSE 2 END * substr(reverse({digits('m')}), i, 1)::INT) % 10)) % 10 = 0"
    lengths = "CASE substr(m, 1, 2) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in IBAN_LENGTHS.items()) + " ELSE 0 END"
    remainder = (
        "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(iban, 5) || substr(iban, 1, 4), ''), lambda c: (CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)::BIGINT)), "
        "lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)"
    )
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b[A-Z]{2}[0-9]{2}",
        "ssn": r"[0-9-]+",
        "local_phone": r"(?:\([0-9]{3}\)\x20?|\b[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}\b",
    }
    test = {
        "email": "true",
        "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) < 4 AND ('0' || right(p, 3))::INT <= 255))",
        "card": f"length({digits('m')}) BETWEEN 12 AND 19 AND {luhn}",
        "phone": f"length({digits('m')}) BETWEEN 9 AND 15",
        "ssn": r"regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 3) < '900' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'",
        "local_phone": "NOT regexp_matches(substr(text, begin, 1), '[0-9+-]') AND NOT regexp_matches(substr(text, fin + 1, 1), '[0-9-]')",
    }
    own = " UNION ALL ".join(
        f"SELECT rid, {k} AS place, '{kind}' AS kind, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}') AS hits FROM d WHERE regexp_matches(text, '{p}')" for k, (kind, p) in enumerate(patterns.items())
    )
    tested = "CASE kind " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in test.items()) + " END"
    word = lambda words: f"'(?i)(?:^|[^A-Za-z0-9])(?:{words})(?:$|[^A-Za-z0-9])'"
    near = lambda p: f"(regexp_matches(bef, {p}) OR regexp_matches(aft, {p}))"
    pro = "CASE kind " + " ".join(f"WHEN '{k}' THEN {near(word(w))}" for k, w in FOR.items()) + " END"
    weight = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHT.items()) + " END"
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({own}),
e AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM f),
p AS (SELECT rid, place, kind, hits[i] AS m, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0))::BIGINT AS begin FROM e),
q AS (SELECT p.*, d.text, CASE WHEN kind = 'iban' THEN {lengths} ELSE 0 END AS n_iban, substr(d.text, begin + 1, 70) AS after_head, begin + length(m) AS fin FROM p JOIN d USING (rid)),
r AS (SELECT *, CASE WHEN n_iban > 0 THEN list_min(list_filter(range(n_iban, 2 * n_iban), lambda n: length(replace(substr(after_head, 1, n), ' ', '')) = n_iban)) END AS n_whole FROM q),
s AS (SELECT *, substr(after_head, 1, n_whole) AS whole, replace(substr(after_head, 1, n_whole), ' ', '') AS iban FROM r),
t AS (SELECT rid, place, kind, begin, text, CASE WHEN kind = 'iban' THEN begin + n_whole ELSE fin END AS fin FROM s
      WHERE CASE WHEN kind = 'iban' THEN n_whole IS NOT NULL AND regexp_full_match(whole, '[A-Z0-9]{{4}}(?:\\x20?[A-Z0-9])+') AND NOT regexp_matches(substr(text, begin + n_whole + 1, 1), '[A-Za-z0-9_]') AND {remainder} = 1 ELSE {tested} END),
u AS (SELECT *, substr(text, greatest(0, begin - {NEAR})::BIGINT + 1, least(begin, {NEAR})) AS bef, substr(text, fin + 1, {NEAR}) AS aft FROM t),
v AS (SELECT rid, place, kind, begin, fin, round({weight} + CASE WHEN {pro} THEN {MORE} ELSE 0 END - CASE WHEN {near(word(AGAINST))} THEN {LESS} ELSE 0 END, 3) AS score FROM u),
w AS (SELECT * FROM v WHERE place < {len(BASE)} OR score >= {LEAST}),
x AS (SELECT * FROM w WHERE kind <> 'local_phone' OR NOT EXISTS (SELECT 1 FROM w o WHERE o.rid = w.rid AND o.kind <> 'local_phone' AND w.begin >= o.begin AND w.begin < o.fin)),
g AS (SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)},
      coalesce(string_agg(kind || ':' || begin || ':' || fin, ',' ORDER BY begin, place) FILTER (kind IN ({base})), '') AS base,
      string_agg(kind || ':' || begin || ':' || fin, ',' ORDER BY begin, place) AS spans FROM x GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


SQL = _sql()
