"""The registry of keys: what it refuses, what it generates, and which id stands for a set."""

import pytest
from pyspark.sql import functions as F

from tokenloom.functions import identity, keys
from tokenloom.functions.keys import Kind, Part, Registry
from tokenloom.operators import reconcile

NAMED, NATIVE, DIGEST = Part("provider", "namespace"), Part("id", "native"), Part("digest", "digest")


@pytest.mark.parametrize(
    "kind",
    [
        Kind("req", "Upper", 0, "native", "provider", (NAMED, NATIVE)),
        Kind("req", "x", 0, "ambiguous", "provider", (NAMED, NATIVE)),
        Kind("req", "x", 0, "native", "planet", (NAMED, NATIVE)),
        Kind("req", "x", 0, "native", "provider", (NATIVE,)),
        Kind("req", "x", 0, "native", "provider", (Part("provider", "namespace", False), NATIVE)),
        Kind("req", "x", 0, "native", "account", (NAMED, NATIVE)),
        Kind("req", "x", 0, "native", "provider", (NAMED, Part("account", "account"), NATIVE)),
        Kind("req", "x", 0, "native", "lineage", (NATIVE,)),
        Kind("req", "x", 0, "native", "thread", (NATIVE,)),
        Kind("req", "x", 0, "native", "source", (DIGEST,)),
        Kind("src", "x", 0, "native", "source", (Part("e", "environment"), Part("d", "dialect"), DIGEST)),
        Kind("req", "x", 0, "native", "provider", (NAMED, Part("l", "locator"), NATIVE)),
        Kind("req", "x", 0, "native", "provider", (NAMED, DIGEST)),
        Kind("req", "x", 0, "fallback", "provider", (NAMED, NATIVE, DIGEST)),
        Kind("req", "x", 0, "fallback", "provider", (NAMED,)),
        Kind("req", "x", 0, "fallback", "thread", (Part("t", "parent"), Part("n", "sequence"))),
    ],
)
def test_kinds_that_cannot_hold(kind):
    with pytest.raises(keys.InvalidKind):
        Registry((kind,))


def test_kinds_of_an_entity_differ():
    a = Kind("req", "a", 0, "native", "provider", (NAMED, NATIVE))
    Registry((a, Kind("thr", "a", 0, "native", "provider", (NAMED, NATIVE)), Kind("src", "s", 0, "native", "source", (Part("e", "environment"), Part("d", "dialect"), Part("l", "locator"), DIGEST))))
    for other in (Kind("req", "a", 1, "native", "provider", (NAMED, NATIVE)), Kind("req", "b", 0, "native", "provider", (NAMED, NATIVE))):
        with pytest.raises(keys.InvalidKind):
            Registry((a, other))


def test_the_strongest_key_stands_for_a_set(spark):
    rows = spark.createDataFrame([("s", "m1", "r1", 0), ("s", None, "r1", 1), ("s", None, "r2", 2), ("t", None, None, 3)], "set string, message string, request string, offset long")
    of = lambda c: {"provider": F.lit("anthropic"), "native_id": F.col(c)}
    made = rows.withColumn("keys", keys.MESSAGES.keys("req", {"provider-response": of("message"), "provider-request": of("request")}, (F.lit("log"), F.col("offset"))))
    sets = {r["set"]: r for r in reconcile.identified(made, ["set"], "keys").collect()}
    one = lambda kind, value: spark.range(1).select(identity.analytical_id("req", kind, F.lit("anthropic"), F.lit(value))).first()[0]
    assert sets["s"]["id"] == one("provider-response", "m1") and sets["s"]["basis"] == "native"
    assert sets["s"]["aliases"] == sorted([one("provider-request", "r1"), one("provider-request", "r2")])
    assert (sets["t"]["basis"], sets["t"]["aliases"]) == ("ambiguous", []) and sets["t"]["id"].startswith("req-v1-")
    table = reconcile.alias_table(reconcile.identified(made, ["set"], "keys"))
    aliased = spark.createDataFrame([(one("provider-request", "r2"),), ("other",)], "id string")
    assert {r["id"] for r in reconcile.rewrite_aliases(aliased, table, "id").collect()} == {sets["s"]["id"], "other"}
