"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule rejects a document on a cheap or a dear feature of its text. The operator takes a sample of documents from
the whole table, runs each rule on it by itself, and measures what the rule costs there (seconds beyond those of
reading the sample) and which share of the documents it rejects. Rules are tried in the order of rejections per
cost, and a rule's features are computed only for documents that no rule before it has rejected. The order changes
the work, never the verdict: a document is kept if no rule rejects it.

Null and empty texts have no words; they fail the first base rule. Very long texts are read whole, within a row. Ties in
the order of rules are broken by their names. Equal documents, repeated rows among them, get equal verdicts and
each row its own. An empty table gives an empty result. Columns other than the text pass through untouched; feature
columns carry the prefix PREFIX, and columns of docs that carry it already are taken for features of this operator.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import SPACE, cut, read, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: Documents the sample for the cost and selectivity estimates holds, about. It only orders the rules.
SAMPLE_ROWS = 2000
#: The least cost a rule is taken to have, in seconds over the sample: below it a clock can't tell rules apart.
LEAST_SECONDS = 0.005

Features = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """Rejects where `rejects` is true; needs the features in `needs`."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Features], Column]


#: All features, base ones first.
FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_lettered", "longest_word")

BASE = (
    Rule("too_few_words", ("n_words",), lambda f: f("n_words") < 20),
    Rule("repeated_passages", ("n_words", "n_repeat_words"), lambda f: 100 * f("n_repeat_words") > 30 * f("n_words")),
)
MORE = (
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 2 * f("n_symbols") > f("n_words")),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda f: 100 * f("n_dup_lines") > 50 * f("n_lines")),
    Rule("word_length", ("n_words", "word_chars"), lambda f: (f("word_chars") < 2 * f("n_words")) | (f("word_chars") > 20 * f("n_words"))),
    Rule("lettered_words", ("n_words", "n_lettered"), lambda f: 10 * f("n_lettered") < 6 * f("n_words")),
    Rule("longest_word", ("longest_word",), lambda f: f("longest_word") > 1000),
)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


PREFIX = "_quality_"


def _f(name: str) -> Column:
    return F.col(PREFIX + name)


def _repeats_neighbour(windows: Column) -> Callable[[Column, Column], Column]:
    """Whether the window hash at a place of the sorted list equals the one before or after it."""
    before = lambda j: F.when(j > 0, F.get(windows, j - 1)["h"])
    return lambda x, j: F.get(windows, j + 1)["h"].eqNullSafe(x["h"]) | before(j).eqNullSafe(x["h"])


def features(docs: DataFrame, text: str = "text", names: tuple[str, ...] | None = None, helpers: bool = False) -> DataFrame:
    """Add the named features (all by default), as bigint columns named PREFIX + name.

    A word lies in a repeated passage if one of the WINDOW-word windows that hold it occurs twice or more in
    the text. Windows are compared by 64-bit hashes: sorted with their starts, equal ones become neighbours,
    and the union of their spans follows from the gaps between the sorted starts. Features that docs have
    already are not computed again; with `helpers` the words and lines stay for features to come. The row number
    that every feature refers to is never negative; it keeps the optimizer from moving a filter on features below
    their computation, where each mention would compute them anew.
    """
    wanted = {n for n in names or FEATURES if PREFIX + n not in docs.columns}
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    empty = lambda kind: F.array().cast(f"array<{kind}>")
    made = {"words": words_of(whole), "lines": _lines(whole)}
    out = docs.withColumns({PREFIX + k: v for k, v in made.items() if PREFIX + k not in docs.columns})
    simple = {
        "n_words": F.size(_f("words")),
        "word_chars": F.length(F.translate(whole, " \t\n\x0b\x0c\r", "")),
        "n_symbols": F.length(whole) - F.length(F.translate(whole, SYMBOLS, "")),
        "n_lines": F.size(_f("lines")),
        "n_dup_lines": F.size(_f("lines")) - F.size(F.array_distinct(_f("lines"))),
        "n_lettered": F.size(F.filter(_f("words"), lambda w: w.rlike(r"\p{L}"))),
        "longest_word": F.coalesce(F.array_max(F.transform(_f("words"), F.length)), F.lit(0)),
    }
    out = out.withColumns({PREFIX + k: v.cast("long") for k, v in simple.items() if k in wanted})
    spent = [] if helpers else ["words", "lines"]
    if "n_repeat_words" in wanted:
        out = out.withColumn(PREFIX + "hashes", F.transform(_f("words"), lambda w: F.xxhash64(w)))
        n = F.size(_f("hashes"))
        window = lambda i: F.xxhash64(*(F.get(_f("hashes"), i + k) for k in range(WINDOW)))
        out = out.withColumn(PREFIX + "windows", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)).otherwise(empty("bigint")))
        paired = F.sort_array(F.transform(_f("windows"), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = F.size(F.array_distinct(_f("windows"))) < F.size(_f("windows"))
        out = out.withColumn(PREFIX + "sorted", F.when(repeated, paired).otherwise(empty("struct<h:bigint,i:int>")))
        out = out.withColumn(PREFIX + "starts", F.sort_array(F.transform(F.filter(_f("sorted"), _repeats_neighbour(_f("sorted"))), lambda x: x["i"])))
        gaps = F.transform(_f("starts"), lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(_f("starts"), j + 1) - s, F.lit(WINDOW))).cast("long"))
        out = out.withColumn(PREFIX + "n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda total, x: total + x))
        spent += ["hashes", "windows", "sorted", "starts"]
    out = out.drop(*(PREFIX + h for h in spent)).withColumn(PREFIX + "row", F.monotonically_increasing_id())
    return out.withColumns({PREFIX + n: F.when(_f("row") >= 0, _f(n)) for n in FEATURES if n in wanted}).drop(PREFIX + "row")


def sampled(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """About sample_rows texts from all over the table, stored."""
    share = min(1.0, sample_rows / max(1, docs.count()))
    return cut(docs.select(F.col(f"`{text}`").alias("text")).sample(fraction=share, seed=11))


def measured(sample: DataFrame, rules: tuple[Rule, ...]) -> dict[str, tuple[float, float]]:
    """(share of the sample that a rule rejects, seconds it takes beyond reading the sample) of each rule."""

    def run(column: Column, needs: tuple[str, ...]) -> tuple[int, int, float]:
        began = time.perf_counter()
        n, hits = features(sample, "text", needs).agg(F.count("*"), F.count_if(column)).first()
        return n, hits, time.perf_counter() - began

    run(F.length("text") > 0, ())  # starts what every run needs
    reading = run(F.length("text") > 0, ())[2]
    out = {}
    for r in rules:
        n, hits, took = run(r.rejects(_f), r.needs)
        out[r.name] = (hits / max(1, n), max(LEAST_SECONDS, took - reading))
    return out


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per cost, most first, both as measured on a sample."""
    if not rules:
        return []
    seen = measured(sampled(docs, text, sample_rows), rules)
    return sorted(rules, key=lambda r: (-seen[r.name][0] / seen[r.name][1], seen[r.name][1], r.name))


def first_rejection(rules: list[Rule], feature: Features = _f) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated."""
    out = F
    for r in rules:
        out = out.when(r.rejects(feature), F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = MORE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Every document with its base features, base_failed, kept and the rule that rejected it first (rejected_by).

    The base features are a result, so all documents have them. The other rules' features stand inside the branches of
    a conditional, rule after rule: they are computed where the rules before leave the document open.
    """
    ordered = order_rules(docs, rules, text, sample_rows)
    base = features(docs, text, FEATURES[:6], helpers=True).withColumn(PREFIX + "base", first_rejection(list(BASE)))
    dear = {
        "n_lettered": F.size(F.filter(_f("words"), lambda w: w.rlike(r"\p{L}"))).cast("long"),
        "longest_word": F.coalesce(F.array_max(F.transform(_f("words"), F.length)), F.lit(0)).cast("long"),
    }
    open_ = F.when(_f("base").isNull(), first_rejection(ordered, lambda n: dear.get(n, _f(n))))
    judged = base.withColumn(PREFIX + "by", F.coalesce(_f("base"), open_)).drop(PREFIX + "words", PREFIX + "lines")
    return judged.withColumns({PREFIX + "base_failed": _f("base").isNotNull(), PREFIX + "kept": _f("by").isNull()})


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = MORE, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with their own columns only.

    Rule after rule computes what it needs for the documents that are left.
    """
    out = docs
    for rule in order_rules(docs, rules + BASE, text, sample_rows):
        out = features(out, text, rule.needs, helpers=True).filter(~F.coalesce(rule.rejects(_f), F.lit(False)))
    return out.select(*(f"`{c}`" for c in docs.columns))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(read(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(_f(n).alias(n) for n in names))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM s WHERE len(w) >= 8)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, range(0, 8) AS r(k) GROUP BY doc_id),
f AS (SELECT s.doc_id,
    CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(hit.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered,
    coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest
  FROM s LEFT JOIN hit ON hit.doc_id = s.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 2 * n_symbols > n_words OR 100 * n_dup_lines > 50 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_lettered < 6 * n_words OR longest > 1000) AS kept
FROM b
"""
