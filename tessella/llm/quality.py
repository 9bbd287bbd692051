"""Operator 7: quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a Boolean Column over metrics.  On a sample of ``SAMPLE_ROWS`` documents at most, chosen by a hash and written once, the
cascade measures which documents each rule rejects, and what it costs: the characters, words and lines that its metric visits there
(``Rule.work``).  Rules then stand in order of rejections per cost, and one CASE applies them, so a
document that an early rule rejects costs the later ones nothing.  The order never changes which
documents are kept, only which rule is named first and what the decision costs.

Everything is computed inside a document's own row: no shuffle, no skew.  Repeated windows are found
by sorting a document's window hashes, and only in documents where some hash occurs twice.

Nulls: a null text has no words and fails the base rule.  Empty tables give no rows; repeated rows
are each judged; other columns of the input are kept out of the result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import store

#: Rows of the sample that only decides the order of rules.
SAMPLE_ROWS = 2_000
SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``rejects``: SQL over the metrics, never null.  ``work``: SQL over the metrics, how many elements of a document its metric visits."""

    name: str
    rejects: str
    work: str = "1"


_CHARS = "word_chars + n_words"
BASE = (Rule("too_short", "n_words < 50", _CHARS), Rule("repeats_itself", "100 * n_repeat_words > 50 * n_words", f"2 * ({_CHARS}) + n_words * log2(n_words + 2)"))
RULES = (
    Rule("symbols", "2 * n_symbols > n_words", _CHARS),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines", f"{_CHARS} + n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words", _CHARS),
    Rule("shouting", "2 * n_upper_words > n_words", f"3 * ({_CHARS})"),
)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, SPACES, "     "), " ", -1), lambda w: w != "")


def _hashes() -> Column:
    """Of every 3-word window, in order; the words are joined by a space, which no word contains."""
    w = F.col("_words")
    return F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _repeated() -> Column:
    """Words covered by windows found twice or more: sort (hash, place), keep equal neighbours, then
    each such window adds min(3, distance to the next one) words, and the last one 3."""
    n = F.size("_grams")
    placed = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct("_grams")) == n, F.lit(None)).otherwise(placed), F.expr(
        """case when _placed is null then 0L else
        aggregate(
          array_sort(transform(filter(_placed, (x, k) -> x.h = get(_placed, k - 1).h or x.h = get(_placed, k + 1).h), x -> x.i)),
          named_struct('n', 0L, 'last', -3),
          (a, i) -> named_struct('n', a.n + least(3, i - a.last), 'last', i),
          a -> a.n) end"""
    )


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id and: n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, n_upper_words."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select("doc_id", text.alias("_text"))
    step = step.select(
        "doc_id", "_text", _words(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n", -1), lambda x: F.translate(x, SPACES + " ", "") != "").alias("_lines"),
        F.length(F.translate("_text", SPACES + " ", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    step = step.select("*", _hashes().alias("_grams"))
    placed, repeated = _repeated()
    step = step.select("*", placed.alias("_placed"))
    return step.select(
        "doc_id", F.size("_words").cast("long").alias("n_words"), "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size(F.filter("_words", lambda w: (F.length(w) > 1) & (F.upper(w) == w) & (F.lower(w) != w))).cast("long").alias("n_upper_words"),
    )


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` rows of ``docs(doc_id, text)``, by a hash, in the shared folder; every part of the table has its share."""
    parts = max(1, docs.count() // max(1, rows) + 1)
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return store.written(chosen.filter(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(parts)) == 0).limit(rows), "sample")


def order_rules(sample: DataFrame, rules: tuple[Rule, ...]) -> list[Rule]:
    """By rejections per cost on the sample, the highest first; ties keep their order."""
    told = [(F.sum(F.expr(r.rejects).cast("int")).alias(f"r{i}"), F.sum(F.expr(r.work).cast("double")).alias(f"w{i}")) for i, r in enumerate(rules)]
    row = sample.agg(*[c for pair in told for c in pair]).first()
    worth = [(row[f"r{i}"] or 0) / (row[f"w{i}"] or 1.0) for i in range(len(rules))]
    return [rules[i] for i in sorted(range(len(rules)), key=lambda i: -worth[i])]


def cascade(measured: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``rejected_by`` (the first rule of the order that rejects, else null)."""
    case = F.lit(None).cast("string")
    for r in reversed(rules):
        case = F.when(F.expr(r.rejects), F.lit(r.name)).otherwise(case)
    return measured.withColumn("rejected_by", case)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Metrics, ``base_failed``, ``rejected_by`` and ``kept`` of every document."""
    sample = sample_of(docs, sample_rows)
    ordered = order_rules(metrics(sample), base + rules)
    store.discard(sample)
    failed = F.lit(False)
    for r in base:
        failed = failed | F.expr(r.rejects)
    out = cascade(metrics(docs), ordered)
    return out.withColumns({"base_failed": failed, "kept": F.col("rejected_by").isNull()})


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their base metrics and the cascade's verdict."""
    got = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLE_SQL = {
    "op7_quality_cascade": r"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from t),
g as (select doc_id, unnest(range(1, len(ws) - 1)) as i, ws from w where len(ws) >= 3),
k as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as s from g),
r as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from k) where n >= 2),
c as (select doc_id, count(distinct i + o) as n from r, (select unnest([0, 1, 2]) as o) group by doc_id),
m as (select w.doc_id, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
      length(text) - length(translate(text, '#*$%&|<>', '')) as n_symbols,
      len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines, coalesce(c.n, 0) as n_repeat_words,
      len(list_filter(ws, lambda x: length(x) > 1 and upper(x) = x and lower(x) <> x)) as n_upper
      from w left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
       n_repeat_words::bigint as n_repeat_words, base_failed,
       not (base_failed or 2 * n_symbols > n_words or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 20 * n_words or 2 * n_upper > n_words) as kept
from b
"""
}
