"""A registry of identity keys: what makes a record known elsewhere, declared once, checked once, and generated as columns.

A kind of key names an entity, how strong it is (its precedence among the entity's kinds, 0 first, and its basis), within which scope its ids are unique, and the parts that
are digested, in order. A key exists where all required parts are known; an optional part that isn't counts as null. A record without any key has one of its own
place, which only a re-read of the same record shares. Keys carry 128 bits in hex, which sort as their ids' text form does; `canonical` gives that form.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.functions.identity import VERSION, base32, digest_hex

#: From the strongest basis to the weakest.
BASES = ("native", "fallback", "ambiguous")
SCOPES = ("provider", "agent", "account", "lineage", "thread", "response", "source")
#: What a part of a key is.
ROLES = ("namespace", "account", "lineage", "parent", "native", "sequence", "digest", "environment", "dialect", "locator")
LOCAL, LOCAL_PRECEDENCE = "artifact-local", 255


class InvalidKind(ValueError):
    """A kind of key whose declaration can't hold."""


@dataclass(frozen=True)
class Part:
    name: str
    role: str
    required: bool = True


@dataclass(frozen=True)
class Kind:
    entity: str
    name: str
    precedence: int
    basis: str
    scope: str
    parts: tuple[Part, ...]

    def needs(self, role: str) -> bool:
        return any(p.role == role and p.required for p in self.parts)

    def has(self, role: str) -> bool:
        return any(p.role == role for p in self.parts)


_OF_SOURCES = ("environment", "dialect", "locator")
#: What must hold of every kind: the scope's own part is there, and no part of another scope.
RULES: tuple[tuple[str, Callable[[Kind], bool]], ...] = (
    ("a kind has a name of lower-case letters, digits and dashes", lambda k: bool(k.name) and k.name.strip("abcdefghijklmnopqrstuvwxyz0123456789-") == "" and k.name[0] != "-"),
    ("only native and fallback kinds are declared", lambda k: k.basis in BASES[:2]),
    ("scope and roles are known ones", lambda k: k.scope in SCOPES and all(p.role in ROLES for p in k.parts)),
    ("ids of a provider, an agent or an account need its namespace", lambda k: k.scope not in ("provider", "agent", "account") or k.needs("namespace")),
    ("an account is a part of account scopes alone, and they need it", lambda k: k.has("account") == (k.scope == "account") == k.needs("account")),
    ("a lineage's root is a part of lineage scopes alone, and they need it", lambda k: k.has("lineage") == (k.scope == "lineage") == k.needs("lineage")),
    ("ids within a thread or a response need their parent", lambda k: k.scope not in ("thread", "response") or k.needs("parent")),
    ("source scopes are for sources", lambda k: k.scope != "source" or k.entity == "src"),
    ("sources need environment, dialect, locator and digest; nothing else has the first three", lambda k: all(k.needs(r) for r in (*_OF_SOURCES, "digest")) if k.scope == "source" else not any(k.has(r) for r in _OF_SOURCES)),
    ("a native key needs a native id or a sequence", lambda k: k.basis != "native" or k.scope == "source" or k.needs("native") or k.needs("sequence")),
    ("a fallback key has no native id", lambda k: k.basis != "fallback" or not k.has("native")),
    ("a fallback key needs a digest or a place within a response", lambda k: k.basis != "fallback" or k.needs("digest") or k.needs("sequence")),
    ("a fallback key's place is one within a response", lambda k: k.basis != "fallback" or not k.has("sequence") or k.scope == "response"),
)


@dataclass(frozen=True)
class Registry:
    """Kinds of keys, checked together when the registry is made: of one entity no two share a name or a precedence."""

    kinds: tuple[Kind, ...]

    def __post_init__(self):
        for k in self.kinds:
            for rule, holds in RULES:
                if not holds(k):
                    raise InvalidKind(f"{k.name}: {rule}")
        for what in ("name", "precedence"):
            seen = [(k.entity, getattr(k, what)) for k in self.kinds]
            if len(set(seen)) < len(seen):
                raise InvalidKind(f"two kinds of an entity share a {what}")

    @cached_property
    def by_name(self) -> dict[tuple[str, str], Kind]:
        return {(k.entity, k.name): k for k in self.kinds}

    def key(self, entity: str, name: str, values: Mapping[str, Column]) -> Column:
        """A key of a kind from its parts' columns (or literals); null where a required part is."""
        kind = self.by_name[entity, name]
        parts = [values[p.name] for p in kind.parts]
        made = F.struct(F.lit(kind.precedence).alias("precedence"), F.lit(BASES.index(kind.basis)).alias("basis"), _bits(entity, name, *parts))
        known = F.lit(True)
        for p in kind.parts:
            if p.required:
                known = known & values[p.name].isNotNull()
        return F.when(known, made)

    def keys(self, entity: str, kinds: Mapping[str, Mapping[str, Column]], place: tuple[Column, Column]) -> Column:
        """All keys of a record as an array; that of its place (source, offset) if there is no other."""
        found = F.array_compact(F.array(*(self.key(entity, name, values) for name, values in kinds.items())))
        return F.when(F.size(found) > 0, found).otherwise(F.array(local_key(entity, *place)))


def local_key(entity: str, source: Column, offset: Column) -> Column:
    return F.struct(F.lit(LOCAL_PRECEDENCE).alias("precedence"), F.lit(BASES.index("ambiguous")).alias("basis"), _bits(entity, LOCAL, source, offset.cast("string")))


def _bits(entity: str, name: str, *parts: Column) -> Column:
    return F.substring(digest_hex(entity, name, *parts), 1, 32).alias("id")


def shown_id(entity: str, bits: Column) -> Column:
    """The text form of an id's bits."""
    return F.concat(F.lit(f"{entity}-v{VERSION}-"), base32(bits))


def canonical(keys: Column, entity: str = "req") -> Column:
    """(id, basis, aliases) of a set's keys: the id of the first by precedence, basis and id; the other ids, each once, in order."""
    best = F.array_min(keys)
    others = F.array_sort(F.array_distinct(F.filter(F.transform(keys, lambda k: k["id"]), lambda i: i != best["id"])))
    named = F.transform(F.concat(F.array(best["id"]), others), lambda i: shown_id(entity, i))
    return F.struct(named[0].alias("id"), F.element_at(F.array(*(F.lit(b) for b in BASES)), best["basis"] + 1).alias("basis"), F.slice(named, 2, 1 << 30).alias("aliases"))


_PROVIDED = (Part("provider", "namespace"), Part("native_id", "native"))
#: The kinds of both dialects. A message id that stands for several models is the agent's, within its session.
MESSAGES = Registry((
    Kind("req", "provider-response", 0, "native", "provider", _PROVIDED),
    Kind("req", "provider-request", 1, "native", "provider", _PROVIDED),
    Kind("thr", "inline-sidechain-digest", 1, "fallback", "agent", (Part("agent", "namespace"), Part("first_record_digest", "digest"))),
))
ROLLOUTS = Registry((
    Kind("req", "provider-response", 0, "native", "provider", (Part("provider", "namespace"), Part("response_id", "native"))),
    Kind("req", "thread-counter-digest", 1, "fallback", "thread", (Part("thread", "parent"), Part("cumulative_usage", "digest"))),
))
SCOPED = Registry((Kind("req", "agent-response", 0, "native", "agent", _PROVIDED),))
