"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's pattern a Boolean query over trigrams is derived: which three-letter sequences any match
must contain, as alternatives (OR) of sets (AND). The index is a table of postings, (trigram, key of the
text), written to the shared folder and dealt by trigram: one pass over the texts gathers each one's
distinct trigrams out of a dictionary. Rules are looked up in it: the postings of a query's trigrams are
intersected, and only the texts that remain are searched with the pattern. Rules whose patterns have no
mandatory trigram (long hexadecimal runs) search every text in the same scan.

Texts and trigrams are lower-cased for the index, and texts are keyed by a hash: copies share their
postings, and texts whose hashes collide only become candidates of each other's rules. The dictionary is
by default that of the rules, so it doesn't grow with the data; texts without any of its trigrams have no
postings, and texts themselves are never shuffled while the candidates' keys are few enough to be sent to
the scan. Beyond that, keys meet texts by a join dealt by key and salt.

The base kinds are assign, access and hex; the further ones are added to them and never replace them.
Matches of a kind are leftmost and don't overlap; matches that are too short are dropped afterwards.
Positions are code points, the end exclusive.

Defined results: null text counts as empty (no secrets); repeated rows are scanned each; spans that begin
at one place are listed in the order of the rules; very long texts are searched whole; all other columns,
whatever their names, pass through (`scanned` adds its column under its name or the first free one,
name_1, ...); an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, free, own_columns, table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A pattern, and how many characters a group of its matches needs to have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_either_case, ("password", "passwd", "secret", "token")), f"{_either_case('api')}_?{_either_case('key')}"])
#: The three base kinds, in the order in which spans at one place are listed.
BASE = (
    Rule("assign", f"({_NAMES})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", "[0-9a-f]{24,}", 0, 24),
)
_KEY_BEGIN = "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
#: A key goes on over its headers and its base64 (line breaks may be escaped) to the END line, or without one
#: to the end of the base64 run.
_KEY_REST = r"(?:\s+(?:Proc-Type|DEK-Info):[^\r\n]*+){0,2}+(?:[A-Za-z0-9+/=\\\s]*+-----END [A-Z ]{0,20}PRIVATE KEY-----|\s*+[A-Za-z0-9+/=\\]{16,}+[A-Za-z0-9+/=\\\r\n]*+|)"
#: Published formats of tokens and keys.
FURTHER = (
    Rule("private_key", _KEY_BEGIN + _KEY_REST),
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("signed", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
    Rule("maps_key", "AIza[A-Za-z0-9_-]{35}"),
)
RULES = BASE + FURTHER
#: At most so many exact strings are followed before they are turned into trigrams.
_MOST = 64
#: Up to so many keys of candidates (16 bytes each) are broadcast; beyond, they are joined by key and salt.
BROADCAST_KEYS, SALTS = 2_000_000, 32
#: A trigram's postings are dealt over so many parts, so that a common one isn't one task's work.
POSTING_PARTS = 16


def _and(a: frozenset, b: frozenset) -> frozenset:
    both = frozenset(x | y for x in a for y in b)
    return _simple(both) if len(both) <= _MOST else a


def _simple(clauses: frozenset) -> frozenset:
    """Without the clauses that another one is part of."""
    return frozenset(c for c in clauses if not any(d < c for d in clauses))


_TRUE = frozenset([frozenset()])


def _of_strings(strings: set[str]) -> frozenset:
    return _simple(frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings))


def _walk(items) -> tuple[set[str] | None, frozenset]:
    """(the exact strings that the pattern matches, if few; the query that any match meets)"""
    exact: set[str] = {""}
    query, whole = _TRUE, True
    for op, arg in items:
        own: set[str] | None
        if op is C.LITERAL:
            own, more = {chr(arg).lower()}, _TRUE
        elif op is C.IN:
            own, more = _letters(arg), _TRUE
        elif op is C.SUBPATTERN:
            own, more = _walk(arg[3])
        elif op is C.BRANCH:
            parts = [_walk(p) for p in arg[1]]
            own = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            more = _simple(frozenset().union(*(p[1] if p[0] is None else _of_strings(p[0]) for p in parts))) if own is None else _TRUE
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, sub = arg
            one, inner = _walk(sub)
            if one is not None and (low, high) == (0, 1):
                own, more = one | {""}, _TRUE
            elif one is not None and low == high and len(one) ** low <= _MOST:
                own, more = {""}, _TRUE
                for _ in range(low):
                    own = {a + b for a in own for b in one}
            else:
                own, more = None, inner if low else _TRUE
        elif op is C.AT:
            continue
        else:
            own, more = None, _TRUE
        if own is not None and len(exact) * len(own) <= _MOST:
            exact = {a + b for a in exact for b in own}
            continue
        query = _and(_and(query, _of_strings(exact)), more)
        exact, whole = (own if own is not None else {""}), False
    if whole:
        return exact, _TRUE
    return None, _and(query, _of_strings(exact))


def _letters(members) -> set[str] | None:
    out: set[str] = set()
    for op, arg in members:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            out.update(chr(c).lower() for c in range(arg[0], arg[1] + 1))
        else:
            return None
    return out if len(out) <= 8 else None


def trigram_query(pattern: str) -> list[list[str]]:
    """The sets of trigrams of which any lower-cased match contains one set wholly; none if the pattern
    has a match without a mandatory trigram."""
    exact, query = _walk(parser.parse(pattern))
    clauses = _of_strings(exact) if exact is not None else query
    return [] if frozenset() in clauses else sorted(sorted(c) for c in clauses)


def dictionary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for rule in rules for clause in trigram_query(rule.pattern) for t in clause})


def _one_of(trigrams: list[str]) -> str:
    """A pattern of a place where one of the trigrams begins, its letters shared from the left."""
    tree: dict[str, dict[str, str]] = {}
    for t in trigrams:
        tree.setdefault(t[0], {}).setdefault(t[1], "")
        tree[t[0]][t[1]] += t[2]
    sign = lambda c: c if c.isalnum() else f"\\x{{{ord(c):x}}}"
    third = lambda cs: sign(cs) if len(cs) == 1 else "[" + "".join(map(sign, cs)) + "]"
    parts = [sign(a) + "(?:" + "|".join(sign(b) + third(cs) for b, cs in more.items()) + ")" for a, more in tree.items()]
    return "(?=[" + "".join(map(sign, tree)) + "])(?=(" + "|".join(parts) + "))"


def postings(docs: DataFrame, trigrams: list[str], column: str = "text") -> DataFrame:
    """(trigram, key): the inverted index of the texts over a dictionary of trigrams, each posting once for
    each row that has it."""
    low = F.lower(text_or_empty(column))
    had = F.array_distinct(F.regexp_extract_all(low, F.lit(_one_of(trigrams)), F.lit(1)))
    rows = docs.select(F.xxhash64(text_or_empty(column)).alias("key"), F.explode(had).alias("trigram"))
    return rows.select("trigram", "key")


def build_index(docs: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = RULES, column: str = "text") -> DataFrame:
    """The postings, written to the shared folder with those of a trigram together."""
    return scratch.written(postings(docs, dictionary(rules), column).repartition("trigram", F.pmod("key", F.lit(POSTING_PARTS))).sortWithinPartitions("trigram"), "postings")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules): for the texts that have candidates, the rules to search them for, as a bit set."""
    terms, clause = [], 0
    for k, rule in enumerate(rules):
        for wanted in trigram_query(rule.pattern):
            terms += [(t, clause, 1 << k, 1 << place, (1 << len(wanted)) - 1) for place, t in enumerate(wanted)]
            clause += 1
    query = index.sparkSession.createDataFrame(terms, "trigram string, clause int, rule long, bit long, whole long")
    met = index.join(F.broadcast(query), "trigram").groupBy("key", "clause").agg(F.bit_or("bit").alias("bits"), F.first("whole").alias("whole"), F.first("rule").alias("rule"))
    return met.where("bits = whole").groupBy("key").agg(F.bit_or("rule").alias("rules"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """array<struct<start, place, end, kind>> of the rule's matches: the lengths of the pieces between
    matches and of the matches give their positions."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    rows = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), lambda p: F.char_length(p)).alias("gap"), F.transform(found, lambda m: F.char_length(m)).alias("own"), F.transform(judged, lambda m: F.char_length(m)).alias("least"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>").alias("out"))

    def step(acc: Column, row: Column) -> Column:
        begin = acc["at"] + row["gap"]
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), (begin + row["own"]).alias("end"), F.lit(rule.kind).alias("kind"))
        return F.struct((begin + F.coalesce(row["own"], F.lit(0))).alias("at"), F.when(row["least"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    return F.when(F.regexp_like(text, F.lit(rule.pattern)), F.aggregate(rows, start, step, lambda acc: acc["out"])).otherwise(none)


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES, column: str = "text") -> DataFrame:
    """docs with _spans, all spans by start and then by rule."""
    text, scratch = text_or_empty(column), Scratch(docs.sparkSession)
    found = scratch.written(candidates(build_index(docs, scratch, rules, column), rules), "candidates")
    scratch.remove("postings")
    spans, to = free(docs, "_spans"), free(docs, "_to")
    one = found.select(F.struct("key", "rules").alias(to))
    key = F.xxhash64(text) == F.col(f"{to}.key")
    if found.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        joined = docs.join(F.broadcast(one), key, "left")
    else:  # rows with the same text are told apart by their other columns
        salt, at = free(docs, "_salt"), free(docs, "_at")
        plain = [c for c, f in zip(own_columns(docs), docs.schema.fields, strict=True) if not any(k in f.dataType.simpleString() for k in ("map", "variant"))]
        salted = docs.withColumn(salt, F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int"))
        dealt = one.withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(dealt, key & (F.col(salt) == F.col(at)), "left").drop(salt, at)
    each = []
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    for k, rule in enumerate(rules):
        own = _spans(text, rule, k)
        each.append(F.when(F.col(f"{to}.rules").bitwiseAND(F.lit(1 << k)) != 0, own).otherwise(none) if trigram_query(rule.pattern) else own)
    return joined.withColumn(spans, F.array_sort(F.concat(*each))).drop(to)


def redacted(docs: DataFrame, mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES, column: str = "text") -> DataFrame:
    """docs with every span of the text replaced by a mark, overlapping spans by one; n_chars, where
    there is such a column, follows. Texts without a secret stay as they are, nulls included."""
    text, spans = F.col(f"`{column}`"), free(docs, "_spans")

    def step(acc: Column, s: Column) -> Column:
        more = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)).alias("out"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], more).otherwise(inside)

    whole = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.lit(2**31 - 1))))
    out = scanned(docs, rules, column)
    clean = free(out, "_clean")
    out = out.withColumn(clean, F.when(F.size(spans) > 0, whole).otherwise(text))
    own = []
    for c, as_is in zip(docs.columns, own_columns(docs), strict=True):
        if c == column:
            own.append(F.col(clean).alias(c))
        elif c == "n_chars":
            own.append(F.when(F.size(spans) > 0, F.char_length(clean).cast(docs.schema[c].dataType)).otherwise(F.col("n_chars")).alias(c))
        else:
            own.append(as_is)
    return out.select(*own)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter("_spans", lambda s: s["kind"] == rule.kind)).cast("long").alias(f"n_{rule.kind}") for rule in BASE]
    base = F.filter("_spans", lambda s: s["place"] < len(BASE))
    return docs.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(docs)


def _sql() -> str:
    quoted = lambda p: p.replace("'", "''")
    parts = []
    for k, rule in enumerate(RULES):
        p = quoted(rule.pattern.replace("*+", "*").replace("}+", "}"))  # DuckDB has no possessive repeats; these need none
        parts.append(
            f"SELECT rid, {k} AS place, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS found, "
            f"regexp_extract_all(text, '{p}', {rule.group}) AS judged FROM d WHERE regexp_matches(text, '{p}')"
        )
    union = " UNION ALL ".join(parts)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({union}),
e AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m),
s AS (SELECT rid, place, kind, length(found[i]) AS own, (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0))::BIGINT AS start
      FROM e WHERE length(judged[i]) >= least),
t AS (SELECT rid, place, start, kind || ':' || start || ':' || (start + own) AS item FROM s),
g AS (SELECT rid, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
      coalesce(string_agg(item, ',' ORDER BY start, place) FILTER (place < 3), '') AS base, string_agg(item, ',' ORDER BY start, place) AS spans FROM t GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)
"""


SQL = _sql()
