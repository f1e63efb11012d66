"""Licence scans: TF-IDF cosine of header lines, header blocks and whole texts to templates, then directory inheritance.

Templates are whole licence texts and notices, each of their paragraphs, and short statements. The units of a document
are its lines, its blocks (runs of lines with a letter or digit; lines of copyright owners are left out) and its whole text.
A unit is a sparse vector of all its terms: term frequency by inverse document frequency, which is counted over all
documents for the templates' terms; other terms have the median of those. Units are exploded into terms, joined to the
templates' terms and grouped again, so a cosine is a sum over the terms that both have.

Which units can reach MIN_COSINE follows from the templates: without the rarest terms of a template, no vector comes
that near. Those terms, of all templates, are the cues; what has none of them is not scored, and nothing is lost.
A document declares the licence with the largest cosine of its units, from MIN_COSINE on (ties: first by name); templates
that several licences share, as notices of one family do, decide only where no other is near. It is a licence file if its whole text is that near, or if its name says so and it declares one.

Documents without a declaration inherit from the nearest directory at or above their own that has a licence file, found
by joining the directories' ancestor paths to the table of directories with such files. If the licence files
of one directory differ, the most frequent licence holds (ties: first by name).

DataFrame functions only; templates and vocabulary are fixed and small. Equal texts are scored once, and the rows of hot
texts and directories are dealt over several tasks. Null texts and paths, empty texts and tables have no declarations; a
null path has no ancestors. Very long texts are scored whole. Repeated rows each get their row. Other columns, whatever
their names, pass through; those called like a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import cut, read, salted
from tokenloom.llm.license_texts import TEXTS

MIN_COSINE = 0.75
#: Templates shorter than this many terms match only units that hardly hold another term; paragraphs need as many.
LEAST_TERMS = 6
_NAMED = r"(?i)(^|/)(licen[sc]e|copying|unlicense)[^/]*$"
_OWNER = r"(?im)^\W*copyright\b.*\d{4}.*$|^\W*all rights reserved\W*$"


def templates(texts: dict[str, list[str]] | None = None) -> list[tuple[str, Counter, bool]]:
    """(licence, term frequencies, whether other licences have it too) of every text, its paragraphs and its identifier."""
    out = []
    for name, variants in (texts or TEXTS).items():
        for text in [*variants, f"SPDX-License-Identifier: {name}"]:
            paragraphs = [p for p in text.split("\n\n") if len(re.findall("[a-z0-9]+", p.lower())) >= LEAST_TERMS]
            for part in [text, *(paragraphs if len(paragraphs) > 1 else [])]:
                out.append((name, Counter(re.findall("[a-z0-9]+", part.lower()))))
    owners: dict[frozenset, set[str]] = {}
    for name, tf in out:
        owners.setdefault(frozenset(tf.items()), set()).add(name)
    return [(name, tf, len(owners[frozenset(tf.items())]) > 1) for name, tf in out]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def inverse_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[dict[str, float], float]:
    """The inverse document frequency of the vocabulary's terms, over all documents, and the median of them."""
    own = F.array_intersect(terms(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.array(*map(F.lit, vocabulary)))
    counted = docs.select(F.explode(F.concat(own, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    n = {r["term"]: r["n"] for r in counted.collect()}  # no more rows than the vocabulary has terms, and one
    total = n.get("", 0)
    idf = {t: math.log((1 + total) / (1 + n.get(t, 0))) + 1 for t in vocabulary}
    return idf, sorted(idf.values())[len(idf) // 2]


def cues(listed: list[tuple[str, Counter, bool]], idf: dict[str, float], least: float) -> list[str]:
    """For each template its rarest terms, until what is left of it is too short for a cosine of `least`."""
    out = set()
    for _, tf, _ in listed:
        weights = sorted((idf[t], t, (k * idf[t]) ** 2) for t, k in tf.items())
        left = total = sum(w for *_, w in weights)
        while weights and left >= least * least * total:
            _, t, w = weights.pop()
            left -= w
            out.add(t)
    return sorted(out)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of docs has."""
    while name in docs.columns:
        name += "_"
    return name


def _weights(spark: SparkSession, listed: list[tuple[str, Counter, bool]], idf: dict[str, float]) -> DataFrame:
    """(term, template, license, shared, weight of the normalised template): bounded by the templates."""
    rows = []
    for i, (name, tf, shared) in enumerate(listed):
        norm = math.sqrt(sum((k * idf[t]) ** 2 for t, k in tf.items()))
        rows += [f"('{t}', {i}, '{name}', {shared}, {k * idf[t] / norm}D)" for t, k in tf.items()]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(term, template, license, shared, weight)")


def declarations(docs: DataFrame, text: str = "text", texts: dict[str, list[str]] | None = None, least: float = MIN_COSINE) -> DataFrame:
    """The documents with _license, _cosine (null without one) and _whole (whether the whole text declares it)."""
    spark, listed = docs.sparkSession, templates(texts)
    idf, other = inverse_frequencies(docs, sorted({t for _, tf, _ in listed for t in tf}), text)
    cue = F.array(*map(F.lit, cues(listed, idf, least)))
    mark, body = _free(docs, "text_mark"), F.col(f"`{text}`")
    marked = docs.drop("_license", "_cosine", "_whole")
    # texts without a cue have no mark and never leave their task
    marked = marked.withColumn(mark, F.when(F.arrays_overlap(terms(body), cue), F.md5(body.cast("binary"))))
    distinct = marked.filter(F.col(mark).isNotNull()).groupBy(F.col(mark).alias("mark")).agg(F.first(body).alias("text"), F.count("*").alias("k"))
    own = F.regexp_replace("text", _OWNER, "")
    blocks = F.concat(F.split(own, "\n"), F.split(own, r"\n[^\p{L}\p{N}\n]*\n"), F.array(own))
    units = distinct.select("mark", "k", F.posexplode(F.transform(blocks, lambda u, i: F.struct(terms(u).alias("terms"), (i == F.size(blocks) - 1).alias("whole")))).alias("unit", "u"))
    scored = units.filter(F.arrays_overlap("u.terms", cue)).select("mark", "k", "unit", "u.whole", F.explode("u.terms").alias("term"))
    counted = scored.groupBy("mark", "k", "unit", "whole", "term").agg(F.count("*").cast("double").alias("tf"))
    known = spark.sql(f"SELECT * FROM VALUES {', '.join(f'''('{t}', {v}D)''' for t, v in idf.items())} AS t(term, idf)")
    weighted = counted.join(F.broadcast(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    norms = weighted.groupBy("mark", "k", "unit", "whole").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("known"))
    dots = norms.select("mark", "k", "unit", "whole", "norm", F.inline("known")).join(F.broadcast(_weights(spark, listed, idf)), "term")
    dots = dots.groupBy("mark", "k", "unit", "whole", "norm", "template", "license", "shared").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    found = dots.select("mark", "k", "license", "shared", "whole", F.round(F.col("dot") / F.col("norm"), 9).alias("c")).filter(F.col("c") >= least)
    by_name = found.groupBy("mark", "k", "license").agg(F.min(F.struct("shared", (-F.col("c")).alias("c"))).alias("best"), F.max("whole").alias("whole"))
    best = by_name.groupBy("mark", "k").agg(F.min(F.struct("best", "license", "whole")).alias("b"))
    best = cut(best.select(F.col("mark").alias(mark), "k", F.col("b.license").alias("_license"), (-F.col("b.best.c")).alias("_cosine"), F.col("b.whole").alias("_whole")))
    plain = marked.filter(F.col(mark).isNull()).withColumns({"_license": F.lit(None).cast("string"), "_cosine": F.lit(None).cast("double"), "_whole": F.lit(False)})
    held = marked.filter(F.col(mark).isNotNull())
    joined = salted(held, best, mark, F.monotonically_increasing_id(), "left").withColumn("_whole", F.coalesce("_whole", F.lit(False)))
    return joined.select(*(f"`{c}`" for c in plain.columns)).unionByName(plain).drop(mark)


def ancestors(path: Column) -> Column:
    """The directories at and above a path's own, nearest first, with their depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("directory")))


def inherit(declared: DataFrame, path: str = "path") -> DataFrame:
    """Documents with _license, license, how it was found (header, file, inherited, none) and from_directory.

    Directories, not documents, meet their ancestors in the join: all documents of a directory inherit alike.
    """
    declared = declared.drop("license", "found_by", "from_directory")
    place, own_name = F.col(f"`{path}`"), _free(declared, "own_directory")
    directory = F.regexp_extract(place, "^(.*)/[^/]*$", 1)
    is_file = F.col("_license").isNotNull() & (F.col("_whole") | F.coalesce(place.rlike(_NAMED), F.lit(False)))
    files = declared.filter(is_file & place.isNotNull()).groupBy(directory.alias("directory"), "_license").agg(F.count("*").alias("n"))
    top = files.groupBy("directory").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("_license").alias("license")))["license"].alias("held"))
    places = declared.filter(place.isNotNull()).groupBy(directory.alias("own")).agg(F.count("*").alias("rows"))
    up = cut(places.select("own", "rows", F.explode(ancestors(F.concat("own", F.lit("/x")))).alias("a")).select("own", "rows", "a.depth", "a.directory"))
    below = up.groupBy("directory").agg(F.count("*").alias("k"))
    nearest = salted(up, cut(top.join(below, "directory")), "directory", F.xxhash64("own")).groupBy("own", "rows").agg(F.max(F.struct("depth", "directory", "held")).alias("near"))
    names = [_free(declared, n) for n in ("inherited_license", "inherited_from")]
    nearest = nearest.select(F.col("own").alias(own_name), F.col("rows").alias("k"), F.col("near.held").alias(names[0]), F.col("near.directory").alias(names[1]))
    joined = salted(declared.withColumn(own_name, directory), cut(nearest), own_name, F.monotonically_increasing_id(), "left")
    own = F.col("_license").isNotNull()
    how = F.when(is_file, "file").when(own, "header").when(F.col(names[0]).isNotNull(), "inherited").otherwise("none")
    found = {"license": F.coalesce("_license", names[0]), "found_by": how, "from_directory": F.when(~own, F.col(names[1]))}
    return joined.withColumns(found).drop(own_name, *names)


def virtual_path(source: Column, lang: Column, doc_id: Column) -> Column:
    """A place in a tree for tables without paths: every eighth document at the source, others by language and hundreds."""
    deep = F.concat_ws("/", source, lang, F.floor(doc_id / 100).cast("string"), doc_id.cast("string"))
    return F.when(doc_id % 8 == 0, F.concat_ws("/", source, doc_id.cast("string"))).when(doc_id % 8 == 1, F.concat_ws("/", source, lang, doc_id.cast("string"))).otherwise(deep)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", virtual_path(F.col("source"), F.col("lang"), F.col("doc_id")).alias("path"))
    found = inherit(cut(declarations(docs).drop("text")))
    return found.select("doc_id", "path", "license", "found_by", F.round("_cosine", 6).alias("cosine"), "from_directory")
