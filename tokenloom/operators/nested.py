"""Nested JSON records without a schema: values as rows, and content replaced by its size and digest.

A record is cut into tokens by one pattern, and windows over its tokens find levels, containers, names and spans: any nesting, no parser and no schema. All windows and
sums are by record, so rows are shuffled once. A record's tokens are sorted in one task; the reader of logs bounds a record.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: A name with its colon, or a scalar, an opening or a closing with the comma that follows.
_TOKEN = rf'(?s){_STRING}\s*+:|(?:{_STRING}|[\[\]{{}}]|[^\s\[\]{{}}:,"]++)(?:\s*+,)?'
#: A value inside another one has the record's tokens from `pos` to `end`.
VALUES = ("pos", "end", "name", "kind", "only_objects", "only_strings", "bytes", "token")


@dataclass(frozen=True)
class Content:
    """What is content. names: fields whose values are (strings above `short` bytes, objects and arrays that aren't empty; an array of objects alone is looked into).
    never: fields that are always looked into. Any string above `long` bytes is content, and a named array of strings that have more together."""

    names: tuple[str, ...]
    never: tuple[str, ...] = ()
    short: int = 16
    long: int = 256


def _text(token: Column) -> Column:
    """The string that a token spells."""
    bare = F.regexp_replace(token, r"\s*,$", "")
    return F.get_json_object(F.concat(F.lit('{"x":'), bare, F.lit("}")), "$.x")


def _unnamed(token: Column) -> Column:
    return _text(F.regexp_replace(token, r"\s*:$", ""))


def values(records: DataFrame, by: list[str], text: str) -> DataFrame:
    """(by, VALUES, closing): one row for each token of each record but names. A container's row is that of its opening and tells whether all it holds are objects, or
    strings and how many bytes these have; the row of a closing is not a value. `by` tells records apart; a null text has no rows."""
    first = F.substring("token", 1, 1)
    opens, closes, named = first.isin("{", "["), first.isin("}", "]"), F.endswith("token", F.lit(":")) & (first == '"')
    # records are shuffled as they are, not their many tokens; every window below is by record and finds its rows together
    rows = records.repartition(*by).select(*by, F.posexplode(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0))).alias("pos", "token"))
    kind = F.when(named, "name").when(first == "{", "object").when(first == "[", "array").when(closes, "closing").when(first == '"', "string").otherwise("scalar")
    rows = rows.withColumn("kind", kind)
    order = Window.partitionBy(*by).orderBy("pos")
    depth = F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_depth", depth).withColumn("name", F.when(F.lag("kind").over(order) == "name", _unnamed(F.lag("token").over(order)))).filter("kind <> 'name'")
    # an opening is a member of the container that it lies in, and the first row inside its own; a closing is the last one inside
    inside, outside = F.struct(F.lit(True).alias("inner"), F.col("_depth").alias("level")), F.struct(F.lit(False).alias("inner"), (F.col("_depth") - 1).alias("level"))
    places = F.when(F.col("kind").isin("object", "array"), F.array(outside, inside)).when(F.col("kind") == "closing", F.array(F.struct(F.lit(True).alias("inner"), (F.col("_depth") + 1).alias("level"))))
    rows = rows.select("*", F.inline(F.coalesce(places, F.array(F.struct(F.lit(False).alias("inner"), F.col("_depth").alias("level"))))))
    level = Window.partitionBy(*by, "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    begin = F.when(F.col("inner") & (F.col("kind") != "closing"), F.col("pos"))
    rows = rows.withColumn("_in", F.last(begin, ignorenulls=True).over(level))
    plain = _text(F.col("token"))
    rows = rows.withColumn("bytes", F.when(F.col("kind") == "string", F.octet_length(plain).cast("long")))
    # one spelling for each string, so that digests tell texts and not their escapes
    respelled = F.concat(_quoted(plain), F.when(F.endswith("token", F.lit(",")), F.lit(",")).otherwise(F.lit("")))
    rows = rows.withColumn("token", F.when((F.col("kind") == "string") & F.contains("token", F.lit("\\")), F.coalesce(respelled, "token")).otherwise(F.regexp_replace("token", r"\s+,$", ",")))
    held = Window.partitionBy(*by, "level", "_in")
    member = lambda k: F.coalesce(F.min(F.when(~F.col("inner"), F.col("kind") == k)).over(held), F.lit(False))
    container = F.col("kind").isin("object", "array")
    rows = rows.withColumns({
        "end": F.when(container & F.col("inner"), F.max("pos").over(held)).otherwise(F.col("pos")),
        "only_objects": member("object"), "only_strings": member("string"),
        "_held": F.sum(F.when(~F.col("inner"), F.col("bytes"))).over(held),
    })
    rows = rows.filter(~container | F.col("inner")).withColumn("bytes", F.when(container, F.col("_held")).otherwise(F.col("bytes")))
    return rows.select(*by, *VALUES, (F.col("kind") == "closing").alias("closing"))


def is_content(content: Content) -> Column:
    """Whether a value (a row of `values`) is content as a whole."""
    name = F.coalesce("name", F.lit(""))
    of, never = name.isin(*content.names) if content.names else F.lit(False), name.isin(*content.never) if content.never else F.lit(False)
    empty = F.col("end") == F.col("pos") + 1
    array, thing, string = (F.col("kind") == k for k in ("array", "object", "string"))
    by_name = (string & (F.col("bytes") > content.short)) | (array & ~empty & ~F.col("only_objects")) | (thing & ~empty)
    by_size = (string & (F.col("bytes") > content.long)) | (array & F.col("name").isNotNull() & F.col("only_strings") & (F.col("bytes") > content.long))
    return F.coalesce(~never & F.when(of, by_name).otherwise(by_size), F.lit(False))


def stripped(records: DataFrame, by: list[str], text: str, content: Content) -> DataFrame:
    """(by, stripped, stubs, stubbed_bytes): each record as compact JSON with its content replaced by `{"$b": bytes, "$d": SHA-256}`.

    Bytes and digest are those of a string's text, and of the compact JSON of anything else. Outermost content is replaced, once. A record is known by `by`;
    a null text, or one without a token, stays null with no stubs.
    """
    order = Window.partitionBy(*by).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = values(records, by, text).withColumn("_stub", is_content(content))
    rows = rows.withColumn("_covered", F.coalesce(F.max(F.when(F.col("_stub"), F.col("end"))).over(before) >= F.col("pos"), F.lit(False)))
    rows = rows.withColumn("_stub", F.col("_stub") & ~F.col("_covered"))
    at = F.when(F.col("_covered"), F.last(F.when(F.col("_stub"), F.col("pos")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.col("pos"))
    piece = F.concat(F.when(F.col("name").isNotNull(), F.concat(_quoted(F.col("name")), F.lit(":"))).otherwise(F.lit("")), F.col("token"))
    parts = rows.select(*by, at.alias("_at"), "pos", "_stub", "name", "kind", "token", piece.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda p: p["piece"]), "")
    own = F.max_by(F.struct("_stub", "name", "kind", "token"), F.col("_at") == F.col("pos"))
    spans = parts.groupBy(*by, "_at").agg(joined.alias("text"), own.alias("o"))
    comma = F.when(F.endswith("text", F.lit(",")), F.lit(",")).otherwise(F.lit(""))
    head = F.when(F.col("o.name").isNotNull(), F.concat(_quoted(F.col("o.name")), F.lit(":"))).otherwise(F.lit(""))
    body = F.substring("text", F.length(head) + 1, F.length("text") - F.length(head) - F.length(comma))
    body = F.when(F.col("o.kind") == "string", _text(F.col("o.token"))).otherwise(body)
    spans = spans.select(*by, "_at", "text", F.col("o._stub").alias("stub"), head.alias("head"), comma.alias("comma"), F.when(F.col("o._stub"), body).alias("body"))
    size = F.octet_length("body").cast("long")
    stub = F.concat(F.col("head"), F.lit('{"$b":'), size.cast("string"), F.lit(',"$d":"'), F.sha2(F.col("body").cast("binary"), 256), F.lit('"}'), F.col("comma"))
    spans = spans.select(*by, "_at", F.when(F.col("stub"), stub).otherwise(F.col("text")).alias("text"), "stub", size.alias("size"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda p: p["text"]), "")
    out = spans.groupBy(*by).agg(whole.alias("stripped"), F.count_if("stub").alias("stubs"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("stubbed_bytes"))
    zero = F.lit(0).cast("long")
    kept = records.select(*by, F.lit(None).cast("string").alias("stripped"), zero.alias("stubs"), zero.alias("stubbed_bytes"))
    rest = kept.filter(records[text].isNull() | ~F.coalesce(F.rlike(records[text], F.lit(_TOKEN)), F.lit(False)))
    return out.unionByName(rest)


def _quoted(name: Column) -> Column:
    """A name as JSON."""
    one = F.to_json(F.array(name))
    return F.substring(one, F.lit(2), F.length(one) - 2)
