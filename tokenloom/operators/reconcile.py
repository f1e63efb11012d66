"""Observations of usage to requests that count once: re-reads, linked sets, revisions, owners, limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.keys import canonical
from tokenloom.operators.graph import numbering, representatives, with_roots, written
from tokenloom.operators.joins import dealt_join


def dedupe_rereads(rows: DataFrame, place: list[str]) -> DataFrame:
    """One row of each place: of unequal rows the first by content; counts the re-reads and the conflicts."""
    content = F.struct(*sorted(c for c in rows.columns if c not in place))
    versions = rows.groupBy(*place, content.alias("_version")).agg(F.count("*").alias("_reads"))
    per = versions.groupBy(*place).agg(F.min("_version").alias("_first"), F.sum("_reads").alias("_reads"), F.count("*").alias("_versions"))
    return per.select(*place, "_first.*", (F.col("_reads") - 1).alias("rereads"), (F.col("_versions") - 1).alias("conflicts"))


def linked_sets(observations: DataFrame, key: str, keys: str) -> DataFrame:
    """(key, set_id) of observations that share any of their keys (an array column), however indirectly.

    Each observation links its first key to the others, so a key that many share costs one edge for each of them. Links are between
    numbers of keys; the smallest key of a set, which names it, is the first of one of its observations.
    An observation without keys is a set by itself, under a key made of its own.
    """
    known = F.array_compact(keys)
    own = F.array(F.concat(F.lit("local:"), F.col(key).cast("string")))
    rows = observations.select(F.col(key).alias("key"), F.array_distinct(F.when(F.size(known) > 0, known.cast("array<string>")).otherwise(own)).alias("keys"))
    rows = written(rows.withColumn("first", F.array_min("keys"))).filter("first IS NOT NULL")  # before that, the filter would make the keys again
    number = numbering(rows.select(F.explode("keys").alias("node")))
    named = rows.select("key", "first", number(F.col("first")).alias("node"))
    links = rows.filter(F.size("keys") > 1).select(number(F.col("first")).alias("a"), F.explode(F.transform("keys", number)).alias("b"))
    found = dealt_join(named, representatives(links), ["node"], F.xxhash64("key"), "left").select("key", "first", "rep")
    return with_roots(found, "first").select(F.col("key").alias(key), F.col("root").alias("set_id"))


def identified(rows: DataFrame, by: list[str], keys: str) -> DataFrame:
    """(by, id, basis, aliases) of each set of rows with keys (an array column of keys' structs): the strongest key's id stands for the set, the others are aliases."""
    each = rows.select(*by, F.explode(keys).alias("_key")).distinct()  # a set has each key once before its keys are put together
    sets = each.groupBy(*by).agg(F.collect_set("_key").alias("_keys"))
    return sets.select(*by, F.inline(F.array(canonical(F.col("_keys")))))  # a generator makes it once


def alias_table(sets: DataFrame) -> DataFrame:
    """(alias, canonical) of sets' ids and aliases, as `rewrite_aliases` takes it."""
    return sets.select(F.explode("aliases").alias("alias"), F.col("id").alias("canonical"))


def latest_revision(sequence: str, place: list[str]) -> Column:
    """Order of revisions: by sequence if all of a set have one, else by place alone. For `select_revision` over `complete_sequences`."""
    return F.struct(F.when(F.col("_all_sequenced"), F.col(sequence)), *place)


def complete_sequences(rows: DataFrame, by: list[str], sequence: str) -> DataFrame:
    """The rows with whether all of their set have a sequence: the last of those is final, else it is only selected."""
    return rows.withColumn("_all_sequenced", F.min(F.col(sequence).isNotNull()).over(Window.partitionBy(*by)))


def largest_output(output: str, sequence: str, place: list[str | Column]) -> Column:
    """Order of revisions: by output (none reported: 0), then block, then place."""
    return F.struct(F.coalesce(F.col(output), F.lit(0)).alias("output"), F.col(sequence), *place)


def select_revision(rows: DataFrame, by: list[str], order: Column, values: list[str], inputs: list[str], usage: Column | None = None) -> DataFrame:
    """The values of each set's greatest revision, how many there are, and whether inputs disagree with its own.

    Of the revisions with usage (all, unless `usage` says which) two disagree if any input differs, null from null not.
    """
    picked = F.max_by(F.struct(*values), order).alias("_picked")
    parts = [c for i in inputs for c in (F.col(i).isNull(), F.col(i))]
    seen = F.struct(*(p.alias(f"i{n}") for n, p in enumerate(parts)))
    seen = seen if usage is None else F.when(usage, seen)
    out = rows.groupBy(*by).agg(picked, F.count("*").alias("revisions"), F.min(seen).alias("_least"), F.max(seen).alias("_most"))
    return out.select(*by, "_picked.*", "revisions", F.coalesce(F.col("_least") != F.col("_most"), F.lit(False)).alias("disagree"))


def ownership(rows: DataFrame, by: list[str], owner: str) -> DataFrame:
    """Proven owners of each set: none is unknown, one is owned, more are ambiguous."""
    seen = rows.groupBy(*by).agg(F.array_sort(F.collect_set(owner)).alias("candidates"))
    n = F.size("candidates")
    return seen.select(*by, F.when(n == 0, "unknown").when(n == 1, "owned").otherwise("ambiguous").alias("status"), F.when(n == 1, F.col("candidates")[0]).alias("owner"), "candidates")


def candidate_sets(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Of the members of a split set the first counts; the others are unresolved."""
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("counting", F.when(nth == 1, "counted").otherwise("unresolved"))


def first_owner(rows: DataFrame, key: str, owner: str, order: list[Column]) -> DataFrame:
    """Rows with the owner of the first row of their key, and whether they replay another's."""
    first = F.first(owner).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("first_owner", first).withColumn("replayed", F.col("first_owner") != F.col(owner))


def collapse_consecutive(rows: DataFrame, stream: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before in their stream."""
    before = F.lag(value).over(Window.partitionBy(*stream).orderBy(*order))
    start = F.row_number().over(Window.partitionBy(*stream).orderBy(*order)) == 1
    return rows.withColumns({"_before": before, "_start": start}).filter(F.col("_start") | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_start")


def merge_pricing(rows: DataFrame, by: list[str], dimensions: list[str], order: Column) -> DataFrame:
    """The first value of each dimension that isn't null, and whether any dimension has two."""
    firsts = [F.min_by(d, F.when(F.col(d).isNotNull(), order)).alias(d) for d in dimensions]
    two = [F.count_distinct(d) > 1 for d in dimensions]
    out = rows.groupBy(*by).agg(*firsts, *(t.alias(f"_two_{i}") for i, t in enumerate(two)))
    flags = [F.col(f"_two_{i}") for i in range(len(two))]
    return out.withColumn("conflicted", F.array_contains(F.array(*flags), True)).drop(*(f"_two_{i}" for i in range(len(two))))


def compact_diagnostics(rows: DataFrame, evidence: str = "evidence", samples: int = 3) -> DataFrame:
    """One row for each code and subject: occurrences, the first detail, and a few places in order."""
    group = ["code", "subject"]
    order = F.struct(evidence, "occurrences", "detail")
    per_place = rows.distinct().groupBy(*group, evidence).agg(F.sum("occurrences").alias("occurrences"), F.min(order).alias("first"))
    nth = F.row_number().over(Window.partitionBy(*group).orderBy(evidence))
    few = F.collect_list(F.when(F.col("_nth") <= samples, F.col(evidence)))  # no more than the samples
    return per_place.withColumn("_nth", nth).groupBy(*group).agg(F.sum("occurrences").alias("occurrences"), F.min("first")["detail"].alias("detail"), F.array_sort(few).alias("evidence"))


def split_by_invariant(rows: DataFrame, by: list[str], invariant: str, set_id: Column, local_id: Column) -> DataFrame:
    """Rows with request and split: members of a set that disagree on an invariant are requests of their own, under local ids."""
    over = Window.partitionBy(*by)
    split = F.coalesce(F.min(invariant).over(over) != F.max(invariant).over(over), F.lit(False))
    return rows.withColumn("split", split).withColumn("request", F.when(F.col("split"), local_id).otherwise(set_id))


def build_requests(rows: DataFrame, by: list[str], original: Column, instant: str, place: str) -> DataFrame:
    """One row for each set: originals and copies, when originals were seen, their first and last place, and if all are copies."""
    when = lambda c: F.when(original, F.col(c))
    out = rows.groupBy(*by).agg(
        F.count_if(original).alias("originals"), F.count_if(~original).alias("copies"), F.min(when(instant)).alias("first_seen"), F.max(when(instant)).alias("last_seen"),
        F.min(when(place)).alias("first_place"), F.max(when(place)).alias("last_place"),
    )
    return out.withColumn("copy_only", F.col("originals") == 0)


def resolve_property(rows: DataFrame, by: list[str], selected: Column, value: str, basis: str | None, to: str) -> DataFrame:
    """The selected revision's value, else the least (basis, value) of the set; and whether the set has several values."""
    offer = F.struct(basis, value) if basis else F.struct(value)
    known = F.when(F.col(value).isNotNull(), offer)
    out = rows.groupBy(*by).agg(F.max_by(F.struct(value), selected).alias("_own"), F.min(known).alias("_least"), (F.min(value) != F.max(value)).alias("_several"))
    return out.select(*by, F.coalesce(F.col(f"_own.{value}"), F.col(f"_least.{value}")).alias(to), F.coalesce("_several", F.lit(False)).alias(f"{to}_conflict"))


def merge_properties(rows: DataFrame, by: list[str], properties: list[str]) -> DataFrame:
    """Threads or actions reported several times: each property's only value, or null and a conflict."""
    out = rows.groupBy(*by).agg(*(x for p in properties for x in (F.min(p).alias(f"_a_{p}"), F.max(p).alias(f"_z_{p}"))))
    conflict = [F.coalesce(F.col(f"_a_{p}") != F.col(f"_z_{p}"), F.lit(False)) for p in properties]
    return out.select(*by, *(F.when(~c, F.col(f"_a_{p}")).alias(p) for p, c in zip(properties, conflict, strict=True)), *(c.alias(f"{p}_conflict") for p, c in zip(properties, conflict, strict=True)))


def merge_edges(rows: DataFrame, proven: Column, place: str) -> DataFrame:
    """One row for each (kind, source, target): proven if any report is, reports, first place."""
    return rows.groupBy("kind", "source", "target").agg(F.max(proven).alias("proven"), F.count("*").alias("reports"), F.min(place).alias("first_place"))


def collisions(rows: DataFrame, id_: str, check: str) -> DataFrame:
    """Ids that stand for more than one key, as their check bits tell."""
    return rows.groupBy(id_).agg(F.count_distinct(check).alias("keys")).filter("keys > 1")


def refuse_collisions(rows: DataFrame, id_: str, check: str) -> DataFrame:
    """The rows, unless two keys share an id."""
    if not collisions(rows, id_, check).isEmpty():
        raise ValueError(f"two keys share a {id_}")
    return rows


def rewrite_aliases(rows: DataFrame, aliases: DataFrame, column: str) -> DataFrame:
    """The rows with a column's aliases (table of alias, canonical) replaced."""
    named = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    out = rows.join(named, F.col(column) == F.col("_alias"), "left")
    return out.withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")


def scoped_ids(rows: DataFrame, id_: str, model: str, scope: str, to: str, counts: Column | None = None) -> DataFrame:
    """Message ids; one that stands for several models, among the rows that count, is scoped to its session."""
    seen = F.col(model) if counts is None else F.when(counts, F.col(model))
    over = Window.partitionBy(id_)
    several = F.coalesce(F.min(seen).over(over) != F.max(seen).over(over), F.lit(False))
    return rows.withColumn(to, F.when(several, F.concat_ws("/", F.col(scope).cast("string"), F.col(id_).cast("string"))).otherwise(F.col(id_).cast("string")))


def first_known(rows: DataFrame, by: list[str], values: list[str], place: str) -> DataFrame:
    """The first value of each column that isn't null, in order of place."""
    return rows.groupBy(*by).agg(*(F.min_by(v, F.when(F.col(v).isNotNull(), F.col(place))).alias(v) for v in values))


def replayed(rows: DataFrame, owners: DataFrame, key: str, owner: str, to: str = "replayed") -> DataFrame:
    """Whether another thread owns the row's key; owners has one row for each key (key, first_owner)."""
    found = rows.join(owners.select(F.col(key).alias("_key"), F.col("first_owner").alias("_first")), F.col(key) == F.col("_key"), "left")
    return found.withColumn(to, F.coalesce(F.col("_first") != F.col(owner), F.lit(False))).drop("_key", "_first")


def reported_by_parent(rows: DataFrame, thread: str, parent: str, turn: str, to: str = "in_parent") -> DataFrame:
    """Whether the parent thread has recorded the row's turn, across files."""
    known = rows.filter(F.col(turn).isNotNull()).select(F.col(thread).alias("_thread"), F.col(turn).alias("_turn")).distinct().withColumn("_yes", F.lit(True))
    return rows.join(known, (F.col(parent) == F.col("_thread")) & (F.col(turn) == F.col("_turn")), "left").withColumn(to, F.coalesce("_yes", F.lit(False))).drop("_thread", "_turn", "_yes")


def coverage(rows: DataFrame) -> DataFrame:
    """How much was read and what became of it, in one row."""
    return rows.agg(
        F.count("*").alias("observations"), F.count_if(F.col("counting") == "copy_only").alias("copies_excluded"), F.count_if(F.col("counting") == "unresolved").alias("unresolved"),
        F.count_if(F.col("counting") == "counted").alias("requests"), F.count_if((F.col("counting") == "counted") & F.col("output").isNull()).alias("requests_without_usage"),
        F.count_if(F.col("seen_ts").isNull()).alias("undated"),
    )
