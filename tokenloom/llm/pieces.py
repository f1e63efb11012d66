"""SentencePiece encoding and decoding over a lattice of pieces.

Words. A space is the mark U+2581 and a text starts with one more. A text falls into units between which no
piece reaches: marks with the letters after them, and single characters that no longer piece holds.

Lattice. For each distinct unit all substrings up to the longest piece's length are listed and joined by
equality to the piece table; the matches are the unit's edges. A fold over a unit's edges gives its pieces.

* Unigram models (`viterbi_words`): Spark joins the exploded substrings to the piece table, groups edges by
  word and folds them with the higher-order `aggregate` into the best path. For tables of distinct words.
* Merge (BPE) models (`encoder`): Viterbi over such a model's scores isn't what the model does, so its results
  would be wrong; there the fold repeats the best merge that the pieces so far allow, the leftmost of equals.
  The join and the fold run on columns within a task, for the distinct units of some megabytes of text at a
  time, so that no text and no word is shuffled. `merge_words` does the same with Spark's joins and folds.

Characters without a piece become one piece for each UTF-8 byte. Decoding joins the pieces' bytes, turns marks
to spaces and takes off the first; it gives back any text that has no mark of its own. Null texts stay
null, empty ones have no pieces, very long ones are encoded whole, repeated rows each get their row and empty tables
give empty results. Other columns, whatever their names, pass through `encode` and `decode`; one called like their result
is replaced. The piece table is that of the model file, whose size is fixed.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import read

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Longest unit that the column-wise fold takes (its boundaries are the bits of a number); others go through a heap.
LONGEST = 48
#: Text whose distinct units a task encodes at once, and encoded units that a task remembers.
BATCH_CHARS, REMEMBERED = 1_000_000, 60_000


@dataclass
class Vocabulary:
    """Pieces with their scores; `kind` is bpe or unigram."""

    pieces: list[str]
    scores: list[float]
    byte_ids: dict[int, int]
    special: set[int]
    kind: str = "bpe"

    @classmethod
    def load(cls, path: str = MODEL, kind: str = "bpe") -> Vocabulary:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in ids]
        return cls(pieces, [model.get_score(i) for i in ids], {int(pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}, {i for i in ids if model.is_byte(i) or model.is_control(i) or model.is_unknown(i)}, kind)

    def plain(self) -> list[tuple[str, int]]:
        return [(p, i) for i, p in enumerate(self.pieces) if i not in self.special]


def as_units(text: str, pattern: re.Pattern) -> list[str]:
    return pattern.findall(MARK + text.replace(" ", MARK)) if text else []


def unit_pattern(vocabulary: Vocabulary) -> re.Pattern:
    """Units for a vocabulary: no piece of it reaches over a unit's end."""
    longer = [p for p, _ in vocabulary.plain() if len(p) > 1]
    if any(MARK in p.lstrip(MARK) for p in longer):
        return re.compile(r"[\s\S]+")
    letters = "".join(re.escape(c) for c in sorted(set("".join(longer)) - {MARK}))
    return re.compile(f"{MARK}*[{letters}]+|{MARK}+|[^{letters}{MARK}]") if letters else re.compile(r"[\s\S]")


class Encoder:
    """The merge fold for distinct units, column-wise; remembers units within a task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.pattern = vocabulary, unit_pattern(vocabulary)
        self.ids = dict(vocabulary.plain())
        order = sorted({s for i, s in enumerate(vocabulary.scores) if i not in vocabulary.special}, reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        self.rank = {p: rank[vocabulary.scores[i]] for p, i in vocabulary.plain()}
        self.letters = frozenset(p for p in self.ids if len(p) == 1)
        self.tables, prefixes = {}, {}
        for p in self.ids:
            for n in range(2, len(p) + 1):
                prefixes.setdefault(n, set()).add(p[:n])
        for n, strings in prefixes.items():
            strings = sorted(strings)
            h = self._hash(np.array([[ord(c) for c in s] for s in strings], dtype=np.uint64))
            at = np.argsort(h)
            self.tables[n] = (h[at], np.array([self.ids.get(s, -1) for s in strings])[at], np.array([self.rank.get(s, 0) for s in strings])[at])
        self.known: dict[str, np.ndarray] = {}

    @staticmethod
    def _hash(chars: np.ndarray) -> np.ndarray:
        h = np.zeros(len(chars), dtype=np.uint64)
        for k in range(chars.shape[1]):
            h = Encoder._step(h, chars[:, k])
        return h

    @staticmethod
    def _step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ c) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(32))

    def _single(self, unit: str) -> np.ndarray:
        """One unit of any length: a heap of the merges that are possible."""
        parts: list[str | None] = list(unit)
        before, after = list(range(-1, len(parts) - 1)), [*range(1, len(parts)), -1]
        heap = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (r := self.rank.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, b, parts[a], parts[b]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, left, right = heapq.heappop(heap)
            if parts[a] == left and parts[b] == right and after[a] == b:
                parts[a], parts[b] = left + right, None
                after[a] = after[b]
                if after[b] >= 0:
                    before[after[b]] = a
                offer(before[a], a)
                offer(a, after[a])
        out: list[int] = []
        for p in parts:
            if p is not None:
                out += [self.ids[p]] if p in self.ids else [self.v.byte_ids[b] for b in p.encode()]
        return np.array(out, dtype=np.int32)

    def _edges(self, chars: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, length, id, rank) of the pieces among the substrings; room: characters left in the unit."""
        place, h = np.arange(len(chars)), self._step(np.zeros(len(chars), dtype=np.uint64), chars)
        out = []
        for n in range(2, 1 + max(self.tables, default=1)):
            fits = room[place] >= n
            place, h = place[fits], h[fits]
            h = self._step(h, chars[place + n - 1])
            keys, ids, ranks = self.tables[n]
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            found = keys[at] == h  # a prefix of some piece
            place, h, at = place[found], h[found], at[found]
            whole = ids[at] >= 0
            out.append((place[whole], np.full(int(whole.sum()), n), ids[at[whole]], ranks[at[whole]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def learn(self, units: list[str]) -> None:
        """Encode distinct units and remember them."""
        columns = []
        for u in units:
            if 1 < len(u) <= LONGEST and self.letters.issuperset(u):
                columns.append(u)
            else:
                self.known[u] = self._single(u)
        if not columns:
            return
        size = np.array([len(u) for u in columns])
        first = np.cumsum(size) - size
        chars = np.frombuffer("".join(columns).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(columns)), size)
        place, length, ids, rank = self._edges(chars, (first + size)[owner] - np.arange(len(chars)))
        unit = owner[place]
        start = place - first[unit]
        order = np.lexsort((start, rank, unit))
        unit, start, length, ids = unit[order], start[order], length[order], ids[order]
        one = np.uint64(1)
        ends = (one << start.astype(np.uint64)) | (one << (start + length).astype(np.uint64))
        inner = ((one << (start + length).astype(np.uint64)) - one) & ~((one << (start + 1).astype(np.uint64)) - one)
        cuts = (one << (size + 1).astype(np.uint64)) - one  # bit k: a piece starts or ends at k
        u, e, i = unit, ends, inner
        while len(u):
            own = cuts[u]
            ready = np.flatnonzero(((own & e) == e) & (np.bitwise_count(own & i) == 1))
            if not len(ready):
                break
            best = ready[np.concatenate([[True], u[ready][1:] != u[ready][:-1]])]
            cuts[u[best]] &= ~i[best]
            moving = np.zeros(len(columns), dtype=bool)
            moving[u[best]] = True
            own = cuts[u]
            left = moving[u] & ((own & e) == e) & ((own & i) != 0)
            u, e, i = u[left], e[left], i[left]
        bit = np.flatnonzero((cuts[owner] >> (np.arange(len(chars)) - first[owner]).astype(np.uint64)) & one)
        who = owner[bit]
        begin = bit - first[who]
        end = np.where(np.append(who[1:] != who[:-1], True), size[who], np.append(begin[1:], 0))
        table = np.argsort(key := unit << 12 | start << 6 | length, kind="stable")
        wanted = who << 12 | begin << 6 | (end - begin)
        at = np.minimum(np.searchsorted(key[table], wanted), max(0, len(table) - 1))
        single = end - begin == 1
        of_char = {c: self.ids[chr(c)] for c in np.unique(chars[bit[single]]).tolist()}
        result = np.empty(len(bit), dtype=np.int32)
        if len(table):
            result[~single] = ids[table[at[~single]]]
        letters = np.array(sorted(of_char), dtype=np.uint64)
        if len(letters):
            result[single] = np.array([of_char[c] for c in letters.tolist()], dtype=np.int32)[np.searchsorted(letters, chars[bit[single]])]
        to = np.cumsum(np.bincount(who, minlength=len(columns))).tolist()
        self.known.update((x, result[a:b]) for x, a, b in zip(columns, [0, *to[:-1]], to, strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        split = [as_units(t, self.pattern) if t is not None else None for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn([u for u in dict.fromkeys(x for units in split if units for x in units) if u not in self.known])
        none = np.zeros(0, dtype=np.int32)
        return [None if units is None else np.concatenate([self.known[u] for u in units]) if units else none for units in split]


def encoder(vocabulary: Vocabulary) -> Column:
    """A function of a text column that gives the ids of its pieces."""
    if vocabulary.kind != "bpe":
        raise ValueError("encoder() folds merges; for unigram models use viterbi_words()")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = Encoder(vocabulary)
        for batch in batches:
            out, held, size = [], [], 0
            for t in batch:
                held.append(t)
                size += len(t or "")
                if size >= BATCH_CHARS:
                    out += encode.encode(held)
                    held, size = [], 0
            yield pd.Series(out + encode.encode(held), dtype=object)

    return F.pandas_udf(run, "array<int>")


def decode_ids(ids: np.ndarray, table: list[bytes]) -> str:
    text = b"".join([table[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def piece_bytes(vocabulary: Vocabulary) -> list[bytes]:
    byte_of = {i: bytes([b]) for b, i in vocabulary.byte_ids.items()}
    return [byte_of.get(i, b"" if i in vocabulary.special else p.encode()) for i, p in enumerate(vocabulary.pieces)]


def decoder(vocabulary: Vocabulary) -> Column:
    """A function of a column of ids that gives the text."""
    table = piece_bytes(vocabulary)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if x is None else decode_ids(x, table) for x in batch], dtype=object)

    return F.pandas_udf(run, "string")


def lattice(words: DataFrame, pieces: DataFrame, word: str = "word") -> DataFrame:
    """(_word, edges) of distinct words: substrings as long as the longest piece, joined to the pieces, grouped by word.

    pieces has piece, id and score; an edge has end, s (its first character, from 1), id and score.
    """
    longest = pieces.agg(F.max(F.length("piece"))).first()[0] or 0
    distinct = words.select(F.col(f"`{word}`").alias("_word")).filter("_word <> ''").distinct()
    length = F.length("_word")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), length), lambda s: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), length - s + 1)), lambda n: F.struct(s.alias("s"), n.alias("n")))))
    exploded = distinct.select("_word", F.explode(spans).alias("x")).select("_word", F.col("x.s").alias("s"), F.col("x.n").alias("n"), F.substring("_word", F.col("x.s"), F.col("x.n")).alias("piece"))
    return exploded.join(pieces, "piece").groupBy("_word").agg(F.sort_array(F.collect_list(F.struct((F.col("s") + F.col("n") - 1).alias("end"), "s", "id", F.col("score").cast("double").alias("score")))).alias("edges"))


def viterbi_words(words: DataFrame, pieces: DataFrame, word: str = "word") -> DataFrame:
    """Best paths of distinct words under a unigram model; pieces has piece, id and score.

    Words that no path covers get null. Of equally good paths the one with the longest last pieces wins.
    """
    w = F.col("_word")
    edges = lattice(words, pieces, word)
    state = "array<struct<score:double,ids:array<int>>>"
    start = F.concat(F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))), F.array_repeat(F.lit(None).cast("struct<score:double,ids:array<int>>"), F.length(w)))

    def step(best: Column, e: Column) -> Column:
        source, target = F.get(best, e["s"] - 1), F.get(best, e["end"])
        offer = F.struct((source["score"] + e["score"]).alias("score"), F.concat(source["ids"], F.array(e["id"].cast("int"))).alias("ids"))
        better = source.isNotNull() & (target.isNull() | (offer["score"] > target["score"]))
        return F.when(better, F.transform(best, lambda x, i: F.when(i == e["end"], offer).otherwise(x))).otherwise(best)

    return edges.select(F.col("_word").alias(word), F.get(F.aggregate("edges", start.cast(state), step), F.length(w))["ids"].alias("ids"))


def merge_words(words: DataFrame, pieces: DataFrame, word: str = "word") -> DataFrame:
    """Pieces of distinct words under a merge model, by the same lattice and a fold that repeats the best possible merge.

    The state is the set of places where a piece starts or ends, as bits; for words of up to 60 characters, all of
    which are pieces. It gives what `encoder` does, and is what that is measured against.
    """
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    ends = lambda e: bit(e["s"] - 1).bitwiseOR(bit(e["end"]))
    inner = lambda e: (bit(e["end"]) - 1).bitwiseAND(F.bitwise_not(bit(e["s"]) - 1))
    edges = lattice(words, pieces, word).withColumn("edges", F.sort_array(F.transform("edges", lambda e: F.struct((-e["score"]).alias("rank"), e["s"].alias("s"), e["end"].alias("end"), e["id"].alias("id")))))

    def step(cuts: Column, _: Column) -> Column:
        ready = F.filter("edges", lambda e: (cuts.bitwiseAND(ends(e)) == ends(e)) & (F.bit_count(cuts.bitwiseAND(inner(e))) == 1))
        return F.when(F.size(ready) > 0, cuts.bitwiseAND(F.bitwise_not(inner(ready[0])))).otherwise(cuts)

    cuts = F.aggregate(F.sequence(F.lit(1), F.length("_word")), bit(F.length("_word") + 1) - 1, step)
    kept = F.filter("edges", lambda e: (F.col("cuts").bitwiseAND(ends(e)) == ends(e)) & (F.bit_count(F.col("cuts").bitwiseAND(inner(e))) == 0))
    ids = F.transform(F.sort_array(F.transform(kept, lambda e: F.struct(e["s"].alias("s"), e["id"].alias("id")))), lambda x: x["id"])
    return edges.withColumn("cuts", cuts).select(F.col("_word").alias(word), ids.alias("ids"))


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", to: str = "pieces") -> DataFrame:
    return docs.withColumn(to, encoder(vocabulary)(F.col(f"`{text}`")))


def decode(docs: DataFrame, vocabulary: Vocabulary, pieces: str = "pieces", to: str = "decoded") -> DataFrame:
    return docs.withColumn(to, decoder(vocabulary)(F.col(f"`{pieces}`")))


def coded(vocabulary: Vocabulary) -> Column:
    """A function of a text column: number and digest of its pieces, and whether decoding them gives the text.

    Encodes, decodes and digests some documents at a time in one pass, so that pieces needn't leave the task.
    """
    table = piece_bytes(vocabulary)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = Encoder(vocabulary)

        def rows(texts: list[str | None]) -> list[tuple]:
            found = zip(texts, encode.encode(texts), strict=True)
            return [(None, None, True) if x is None else (len(x), hashlib.sha256(x.astype("<i4").tobytes()).hexdigest(), decode_ids(x, table) == t) for t, x in found]

        for batch in batches:
            out, held, size = [], [], 0
            for t in batch:
                held.append(t)
                size += len(t or "")
                if size >= BATCH_CHARS:
                    out += rows(held)
                    held, size = [], 0
            yield pd.DataFrame(out + rows(held), columns=["n_pieces", "pieces_sha256", "round_trip"]).astype({"n_pieces": "Int64", "round_trip": bool})

    return F.pandas_udf(run, "n_pieces long, pieces_sha256 string, round_trip boolean")


def encoded_documents(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, number and digest of the pieces (ids as four little-endian bytes), and whether decoding gives the text."""
    return docs.select("doc_id", coded(Vocabulary.load(path))(F.col("text")).alias("_coded")).select("doc_id", "_coded.*")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(read(spark, sf_dir, "documents"))
