"""Quality rules with thresholds that adapt to each language and source.

Counts of words, symbols, repeated lines and repeated words are taken from the whole text. The base
rules (at least 50 words, at most half of them in repeated windows) are fixed by contract. Five further
rules have no fixed cutoff: for each (lang, source) a quantile sketch of the measure gives its quartiles,
and a document fails that lies more than FENCE spreads outside them, on either side. The spread is the
interquartile range; where that is smaller than the measure's standard error in a text of the document's
own size (a share of n units varies by sqrt(p (1 - p) / n), a mean length by sqrt(mean / n)), the
standard error counts. So short texts have more room, and there is no least margin to choose.

A sketch is a histogram of whole buckets, parts per thousand for shares and hundredths of a character for
the mean word length: at most BUCKETS of them whatever the rows, exact to one bucket, merged by adding
counts. (Measures of unknown range would need another sketch.) Spark pre-aggregates it before the shuffle,
so a source with a third of all rows sends one row per bucket and task. Groups with fewer than `least`
rows use the merged sketch of their language, and languages with fewer than that the merged sketch of all
rows.

Defined results: null text counts as empty (no words, base rules fail); null lang and null source are
groups of their own; a value at a fence passes; other columns, whatever their names, pass through `keep`;
`judged` adds its columns under their names or the first free ones (name_1, ...); an empty table gives an
empty table; repeated rows are judged alike and all returned; very long texts are counted whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, free, once, own_columns, small_batches, table, text_or_empty
from .wordhash import SPACE, Ranges, _spans, shingles, slices, words

SYMBOLS = "#*$%&|<>"
#: The measures, and the count whose units they vary by: a repeated line repeats all its words.
MEASURES = {"symbol": "n_words", "dup_line": "n_lines", "repeat_word": "n_lines", "capital": "n_words", "word_length": "n_words"}
LEAST_ROWS, FENCE, MIN_WORDS, MAX_REPEAT, BUCKETS = 100, 3, 50, 50, 3001
#: Quartiles are broadcast up to this many groups (a row has two names and ten numbers), and joined by a
#: salted key beyond.
BROADCAST_GROUPS, SALTS = 200_000, 64

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS.encode())] = True
_COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_capitals long"


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeats(text: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier one of the same text; found at least twice in the text)"""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.lexsort((hashes, text))  # stable: the first one comes first
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    later, twice = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return later, twice


def count_texts(column: pa.Array) -> pd.DataFrame:
    """The counts that the rules use, of each text."""
    parts = []
    for _, data, offsets in slices(column):
        w = words(data, offsets, lower=False)
        in_word = ~SPACE[data]
        texts = len(offsets) - 1
        line_starts, line_ends = _spans(data != 10, offsets)
        worded = np.concatenate(([0], np.cumsum(in_word)))
        has = worded[line_ends] > worded[line_starts]
        line_starts, line_ends = line_starts[has], line_ends[has]
        line_text = np.searchsorted(offsets, line_starts, "right") - 1
        later, _ = _repeats(line_text, Ranges(data).of(line_starts, line_ends))
        s, first = shingles(w, 3)
        n_words = np.diff(w.first)
        owner = np.repeat(np.arange(texts), np.diff(first))
        _, twice = _repeats(owner, s)
        twice &= n_words[owner] >= 3
        begin = w.first[owner] + np.arange(len(s)) - first[owner]
        covered = np.zeros(len(w.hashes) + 1, bool)
        for k in range(3):
            covered[begin[twice] + k] = True
        parts.append(
            {
                "n_words": n_words,
                "word_chars": _per_text(in_word & ((data & 0xC0) != 0x80), offsets),
                "n_symbols": _per_text(_IS_SYMBOL[data], offsets),
                "n_lines": np.bincount(line_text, minlength=texts),
                "n_dup_lines": np.bincount(line_text, later, minlength=texts).astype(np.int64),
                "n_repeat_words": _per_text(covered[:-1], w.first),
                "n_capitals": _per_text((data >= 65) & (data <= 90), offsets),
            }
        )
    names = [c.split()[0] for c in _COUNTS.split(", ")]
    return pd.DataFrame({n: np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64) for n in names}, dtype=np.int64)


def _counts_batch(text: pa.Array) -> pa.Array:
    counts = count_texts(text)
    return pa.StructArray.from_arrays([pa.array(counts[c].to_numpy()) for c in counts], list(counts))


def counts_of(column: str = "text") -> Column:
    """A struct of the counts."""
    return once(F.arrow_udf(_counts_batch, _COUNTS))(text_or_empty(column))


def _share(part: str, whole: str) -> Column:
    """Parts per thousand, rounded down; none where there is no whole."""
    return F.when(F.col(whole) > 0, F.floor(F.col(part) * 1000 / F.col(whole))).otherwise(0).cast("int")


def measures(q: str = "_q") -> dict[str, Column]:
    f = lambda name: f"{q}.{name}"
    return {
        "symbol": F.least(F.lit(1000), _share(f("n_symbols"), f("word_chars"))),
        "dup_line": _share(f("n_dup_lines"), f("n_lines")),
        "repeat_word": _share(f("n_repeat_words"), f("n_words")),
        "capital": F.least(F.lit(1000), _share(f("n_capitals"), f("word_chars"))),
        "word_length": F.when(F.col(f("n_words")) > 0, F.least(F.lit(BUCKETS - 1), F.floor(F.col(f("word_chars")) * 100 / F.col(f("n_words"))))).otherwise(0).cast("int"),
    }


def sketches(counted: DataFrame, by: list[str], q: str = "_q") -> DataFrame:
    """(by..., measure, bucket, n): the mergeable sketch of every measure of every group."""
    pairs = F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("bucket")) for k, v in measures(q).items()))
    return counted.select(*by, F.explode(pairs).alias("_p")).groupBy(*by, "_p.measure", "_p.bucket").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str], least: int) -> DataFrame:
    """(by..., and a struct (q1, q3) for each measure) of the groups with at least `least` rows. A group of a
    sketch has at most BUCKETS rows, so each window is bounded."""
    within = Window.partitionBy(*by, "measure")
    ranked = sketch.select("*", F.sum("n").over(within.orderBy("bucket")).alias("_upto"), F.sum("n").over(within).alias("_all")).where(F.col("_all") >= least)
    quartile = lambda k: F.min(F.when(F.col("_upto") * 4 >= F.col("_all") * k, F.col("bucket")))
    per = ranked.groupBy(*by, "measure").agg(F.struct(quartile(1).alias("q1"), quartile(3).alias("q3")).alias("_q13"))
    return per.groupBy(*by).agg(*(F.max(F.when(F.col("measure") == m, F.col("_q13"))).alias(m) for m in MEASURES))


def _of_all(sketch: DataFrame) -> dict[str, tuple[int, int]]:
    """The quartiles of all rows, from the wholly merged sketch: BUCKETS rows a measure at most."""
    total = sketch.groupBy("measure", "bucket").agg(F.sum("n").alias("n")).collect()
    out = {}
    for m in MEASURES:
        rows = sorted((r["bucket"], r["n"]) for r in total if r["measure"] == m)
        upto, n = np.cumsum([r[1] for r in rows]), sum(r[1] for r in rows)
        out[m] = tuple(rows[int(np.argmax(upto * 4 >= n * k))][0] for k in (1, 3)) if rows else (0, 0)
    return out


def spread(measure: str, q1: Column, q3: Column, q: str = "_q") -> Column:
    """What a fence is measured in: the interquartile range, or the standard error at the text's own size."""
    n = F.col(f"{q}.{MEASURES[measure]}").cast("double")
    if measure == "word_length":
        error = 100 * F.sqrt(q3 / 100.0 / F.greatest(n, F.lit(1.0)))
    else:
        p = F.greatest(q3 / 1000.0, 1 / (n + 1))
        error = 1000 * F.sqrt(p * (1 - p) / F.greatest(n, F.lit(1.0)))
    return F.greatest((q3 - q1).cast("double"), error)


def judged(docs: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """docs with _q (counts), _base_failed, _kept and _failed (the measures that lie outside). The text is
    counted twice, once for the sketches and once for the verdicts, rather than shuffled or stored."""
    q, base_name, kept, failed = (free(docs, n) for n in ("_q", "_base_failed", "_kept", "_failed"))
    counted = docs.withColumn(q, counts_of())
    scratch = Scratch(docs.sparkSession)
    fine = scratch.written(sketches(counted.select("lang", "source", q), ["lang", "source"], q), "sketch")
    every = _of_all(fine)
    by_lang = fine.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n"))
    own = scratch.written(quartiles(fine, ["lang", "source"], least), "own")
    lang = scratch.written(quartiles(by_lang, ["lang"], least), "lang")

    def joined(rows: DataFrame, limits: DataFrame, by: list[str], name: str) -> DataFrame:
        one = limits.select(F.struct("*").alias(name))
        on = lambda: [F.col(c).eqNullSafe(F.col(f"{name}.{c}")) for c in by]
        if limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
            return rows.join(F.broadcast(one), on(), "left")
        salt, at = free(rows, "_salt"), free(rows, "_at")
        salted = rows.withColumn(salt, F.pmod(F.xxhash64(text_or_empty()), F.lit(SALTS)).cast("int"))
        dealt = one.withColumn(at, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return salted.join(dealt, [*on(), F.col(salt) == F.col(at)], "left").drop(salt, at)

    l_own, l_lang = free(docs, "_own"), free(docs, "_lang")
    out = joined(joined(counted, own, ["lang", "source"], l_own), lang, ["lang"], l_lang)
    outside = []
    for m, value in measures(q).items():
        q1, q3 = (F.coalesce(F.col(f"{l_own}.{m}.{k}"), F.col(f"{l_lang}.{m}.{k}"), F.lit(every[m][i])) for i, k in enumerate(("q1", "q3")))
        room = FENCE * spread(m, q1, q3, q)
        outside.append(F.when((value > q3 + room) | (value < q1 - room), F.lit(m)))
    base = (F.col(f"{q}.n_words") < MIN_WORDS) | (100 * F.col(f"{q}.n_repeat_words") > MAX_REPEAT * F.col(f"{q}.n_words"))
    out = out.withColumns({base_name: base, failed: F.array_compact(F.array(*outside))})
    return out.withColumn(kept, ~F.col(base_name) & (F.size(failed) == 0)).drop(l_own, l_lang)


def keep(docs: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judged(docs, least).where(F.col(free(docs, "_kept"))).select(*own_columns(docs))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = small_batches(table(spark, sf_dir, "documents")).select("doc_id", "text", "lang", "source")
    return judged(docs).select("doc_id", *(F.col(f"_q.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"), F.array_join("_failed", ",").alias("failed"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep(small_batches(docs))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w),
tri AS (SELECT rid, i, md5(ws[i]) || md5(ws[i + 1]) || md5(ws[i + 2]) AS s FROM pos),
twice AS (SELECT rid, i FROM tri QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
      (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
      length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals FROM w LEFT JOIN rep USING (rid)),
m AS (SELECT *, CASE WHEN word_chars > 0 THEN least(1000, n_symbols * 1000 // word_chars) ELSE 0 END AS symbol,
      CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS dup_line,
      CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_word,
      CASE WHEN word_chars > 0 THEN least(1000, n_capitals * 1000 // word_chars) ELSE 0 END AS capital,
      CASE WHEN n_words > 0 THEN least(3000, word_chars * 100 // n_words) ELSE 0 END AS word_length FROM c),
long AS (SELECT rid, lang, source, 0 AS place, 'symbol' AS measure, symbol AS b, n_words AS n FROM m UNION ALL SELECT rid, lang, source, 1, 'dup_line', dup_line, n_lines FROM m
         UNION ALL SELECT rid, lang, source, 2, 'repeat_word', repeat_word, n_lines FROM m UNION ALL SELECT rid, lang, source, 3, 'capital', capital, n_words FROM m
         UNION ALL SELECT rid, lang, source, 4, 'word_length', word_length, n_words FROM m),
own AS (SELECT lang, source, measure, count(*) AS n, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM long GROUP BY ALL),
bylang AS (SELECT lang, measure, count(*) AS n, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM long GROUP BY ALL),
alls AS (SELECT measure, quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.75) AS q3 FROM long GROUP BY ALL),
pick AS (SELECT own.lang, own.source, own.measure, CASE WHEN own.n >= 100 THEN own.q1 WHEN bylang.n >= 100 THEN bylang.q1 ELSE alls.q1 END AS q1,
         CASE WHEN own.n >= 100 THEN own.q3 WHEN bylang.n >= 100 THEN bylang.q3 ELSE alls.q3 END AS q3
         FROM own JOIN bylang ON own.lang IS NOT DISTINCT FROM bylang.lang AND own.measure = bylang.measure JOIN alls ON own.measure = alls.measure),
j AS (SELECT long.*, q1, q3, greatest(q3 / 1000.0::DOUBLE, 1 / (n::DOUBLE + 1)) AS p FROM long JOIN pick ON long.lang IS NOT DISTINCT FROM pick.lang
      AND long.source IS NOT DISTINCT FROM pick.source AND long.measure = pick.measure),
room AS (SELECT *, 3 * greatest((q3 - q1)::DOUBLE, CASE WHEN place = 4 THEN 100 * sqrt(q3 / 100.0::DOUBLE / greatest(n::DOUBLE, 1)) ELSE 1000 * sqrt(p * (1 - p) / greatest(n::DOUBLE, 1)) END) AS room FROM j),
bad AS (SELECT rid, coalesce(string_agg(measure, ',' ORDER BY place) FILTER (b > q3 + room OR b < q1 - room), '') AS failed FROM room GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND failed = '' AS kept, failed
FROM m JOIN bad USING (rid)
"""
