"""Katz backoff language model: Good-Turing discounted n-gram counts with exactly normalised backoff weights.

A text is its words (A-Z lower-cased) and one END; before the first stands BEGIN, which is a context but never predicted. With c the
count of an n-gram in the training texts and C that of its context, a token's probability is (c - D(c)) / C where c > 0, else the
context's weight times the probability after the context without its first word, and so on down to single words; END counts
as a word. What the words don't use is the probability of an unknown one. A context that was never seen has weight 1.

D follows Good-Turing up to MOST: D(c) = c * (1 - d_c), d_c by Katz's formula from the counts of counts of that order. Larger counts are
reliable and lose only RELIABLE of themselves, so every context keeps something for what it hasn't seen and no case is special. Where counts of
counts don't give discounts strictly between 0 and 1 (small tables), a count of up to MOST loses HALF of one. A context's weight is what it kept, over what the
shorter context gives to all words but those seen here: probabilities after any context sum to 1 exactly.

How it runs. The model is never collected or broadcast. Texts become postings, counted for each document and n-gram within a task,
packed as blocks and dealt by their *last* word (words above HOT_SHARE of all tokens by the one before it, too). So every order's count of a
posting, for all suffixes of its context, is found in one place by one sort, and so is the count of each context that ends in the word. That
step writes a table of: the n-grams' counts, what each n-gram tells its context (its count, and its count after the shorter context), what
documents' tokens ask of contexts (unseen n-grams need weights), sums of documents, and counts of counts. A second exchange brings what is
told and asked together by context, where weights are made and answered, and sums are added up by document. The driver gets hot words and counts of counts only.

Words and contexts go by 64-bit hashes: of n different words some two share one with odds of n^2 / 2^65.
Null and empty texts are one END; very long ones are cut into pieces at white space while their words are counted. Rows are told apart by their place, so repeated rows
and keys each get a score; a null key's checksum is that of an empty text. Without training texts every token is unknown with probability 1 (score 0). Empty tables give
empty results. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.llm.common import read, slices, store
from tokenloom.llm.importance import pieces

ORDER, MOST, HALF, RELIABLE = 2, 5, 0.5, 0.001
#: Of the base score: what is added to each count.
ADDED = 0.1
#: A word with this share of all tokens is dealt by the word before it, over so many tasks; no more than 1 / HOT_SHARE words are hot.
HOT_SHARE, SALTS = 1e-3, 64
#: Tokens that a task packs at once, and words it remembers the hash of.
AT_ONCE, REMEMBERED = 2_500_000, 1 << 20
#: Hashes of the marks and of what stands before BEGIN; words are hashed with another seed.
BEGIN, END, BEFORE = (np.uint64(xxhash.xxh64_intdigest(m, 1)) for m in (b"begin", b"end", b"before"))
#: Kinds of rows of the counted table.
ROW, TOLD, ASKED, SUMS, COUNTS = range(5)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 0)
        return h


def mixed(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a context with one more word."""
    with np.errstate(over="ignore"):
        x = context * np.uint64(0x9E3779B97F4A7C15) + word
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tokens(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hashes of BEGIN, words and END of some texts; lengths; places; whether held out)."""
    of, rows, size, first = _Hashes(), [], 0, 0
    places, held = np.array(batch["nth"]), np.array(batch["held"])
    for i, text in enumerate(batch["text"]):
        body = [np.array([BEGIN])]
        for piece in pieces((text.as_py() or "").encode().lower()):
            words = piece.split()
            body.append(np.fromiter(map(of.__getitem__, words), np.uint64, len(words)))
        rows.append(np.concatenate([*body, np.array([END])]))
        size += len(rows[-1])
        if size > AT_ONCE or i + 1 == batch.num_rows:
            yield np.concatenate(rows), np.array([len(r) for r in rows]), places[first : i + 1], held[first : i + 1]
            rows, size, first = [], 0, i + 1


def contexts(word: np.ndarray, lengths: np.ndarray, order: int) -> list[np.ndarray]:
    """For orders 2 and up the hash of the words before each token."""
    first = np.r_[0, np.cumsum(lengths)[:-1]]
    out = []
    for k in range(2, order + 1):
        before = np.roll(word, 1) if k == 2 else mixed(np.roll(out[-1], 1), np.roll(word, 1))
        before[first] = BEFORE
        out.append(before)
    return out


def _dealt(word: np.ndarray, before: np.ndarray | None, hot: np.ndarray, parts: int) -> np.ndarray:
    """The partition of each n-gram: by its last word, a hot one's by the word before it, too."""
    at = word % np.uint64(parts)
    if before is not None and len(hot):
        i = np.minimum(np.searchsorted(hot, word), len(hot) - 1)
        salt = mixed(before, word) % np.uint64(SALTS)
        at = np.where(hot[i] == word, mixed(word, salt) % np.uint64(parts), at)
    return at.astype(np.int32)


def _packed(a: np.ndarray) -> bytes:
    """The numbers in as few bytes as the largest needs."""
    kind = np.min_scalar_type(a.max()) if len(a) else np.dtype(np.uint8)
    return bytes([kind.itemsize]) + a.astype(kind).tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.dtype(f"u{b[0]}"), offset=1).astype(np.int64)


_POSTINGS = (("part", pa.int32()), ("nth", pa.int64()), ("held", pa.bool_()), *((c, pa.binary()) for c in ("word", "runs", "before", "docs", "grams", "n")))


def _sql(columns: tuple) -> str:
    return ", ".join(f"{c} {({pa.int32(): 'int', pa.int64(): 'bigint', pa.bool_(): 'boolean', pa.binary(): 'binary'})[t]}" for c, t in columns)


def _batch(columns: tuple, rows: list[tuple], keys: pa.DataType) -> pa.RecordBatch:
    """Rows without a key."""
    return pa.RecordBatch.from_arrays([pa.nulls(len(rows), keys), *(pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(columns))], names=["_key", *(c for c, _ in columns)])


def _cuts(sorted_: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where each run of equal values begins and ends."""
    edges = np.r_[np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]), len(sorted_)] if len(sorted_) else np.zeros(1, np.int64)
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def postings(rows: DataFrame, order: int, hot: list[int], parts: int) -> DataFrame:
    """A row for each document (_key, nth, held), and blocks of postings: n-grams of some documents by last word, with each n-gram's documents, counts and marks of held-out ones."""
    kind = rows.schema["_key"].dataType.simpleString()
    often = np.sort(np.array(hot, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, place = batch.num_rows, np.array(batch["nth"])
            blank = [pa.nulls(n, t) for _, t in _POSTINGS[3:]]
            yield pa.RecordBatch.from_arrays([batch["_key"], pa.array((place >> 8) % parts, pa.int32()), batch["nth"], batch["held"], *blank], names=["_key", *(c for c, _ in _POSTINGS)])
            for word, lengths, places, held in tokens(batch):
                yield _batch(_POSTINGS, blocks(word, lengths, places, held), batch["_key"].type)

    def blocks(word: np.ndarray, lengths: np.ndarray, places: np.ndarray, held: np.ndarray) -> list[tuple]:
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        before = contexts(word, lengths, order)
        part = _dealt(word, before[0] if before else None, often, parts)
        by = np.lexsort((*reversed(before), word, part))  # stable: documents stay in order
        word, doc, part, before = word[by], doc[by], part[by], [b[by] for b in before]
        new_word = np.r_[True, (word[1:] != word[:-1]) | (part[1:] != part[:-1])]
        new = new_word.copy()
        for b in before:
            new[1:] |= b[1:] != b[:-1]
        posting = new.copy()
        posting[1:] |= doc[1:] != doc[:-1]
        at = np.flatnonzero(posting)
        n, gram = np.diff(np.r_[at, len(word)]), np.flatnonzero(new[at])
        out = []
        for lo, hi in _cuts(part[at]):
            g0, g1 = np.searchsorted(gram, (lo, hi))
            own, heads = at[lo:hi], at[gram[g0:g1]]
            w = np.flatnonzero(new_word[heads])
            out.append((
                int(part[own[0]]), int(places[0]), None, word[heads[w]].tobytes(), _packed(np.diff(np.r_[w, len(heads)])), b"".join(b[heads].tobytes() for b in before),
                _packed((places[doc[own]] - places[0]) * 2 + held[doc[own]]), _packed(np.diff(np.r_[gram[g0:g1], hi])), _packed(n[lo:hi]),
            ))
        return out

    return rows.mapInArrow(run, f"_key {kind}, {_sql(_POSTINGS)}")


@dataclass
class Postings:
    """One partition's postings, sorted by word and contexts."""

    word: np.ndarray
    before: list[np.ndarray]
    doc: np.ndarray
    held: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, blocks: list[dict], order: int) -> Postings:
        word, doc, held, n, before = [], [], [], [], [[] for _ in range(order - 1)]
        for b in blocks:
            spans = _unpacked(b["grams"])
            word.append(np.repeat(np.repeat(np.frombuffer(b["word"], np.uint64), _unpacked(b["runs"])), spans))
            each = np.frombuffer(b["before"], np.uint64).reshape(order - 1, -1) if order > 1 else []
            for k, x in enumerate(each):
                before[k].append(np.repeat(x, spans))
            marked = _unpacked(b["docs"])
            doc.append(b["nth"] + (marked >> 1))
            held.append((marked & 1).astype(bool))
            n.append(_unpacked(b["n"]))
        word, doc, held, n, before = np.concatenate(word), np.concatenate(doc), np.concatenate(held), np.concatenate(n), [np.concatenate(b) for b in before]
        by = np.lexsort((*reversed(before), word))
        return cls(word[by], [b[by] for b in before], doc[by], held[by], n[by])

    def counts(self, hot: dict[int, int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each order whether a posting opens an n-gram of it, and the n-gram's count in training texts."""
        trained, new = np.where(self.held, 0, self.n), np.r_[True, self.word[1:] != self.word[:-1]]
        opens, counts = [], []
        for k in range(len(self.before) + 1):
            if k:
                new = new.copy()
                new[1:] |= self.before[k - 1][1:] != self.before[k - 1][:-1]
            starts = np.flatnonzero(new)
            count = np.add.reduceat(trained, starts)
            if not k and hot:
                count = np.array([hot.get(int(w), c) for w, c in zip(self.word[starts], count, strict=True)], np.int64)
            opens.append(new)
            counts.append(np.repeat(count, np.diff(np.r_[starts, len(self.word)])))
        return opens, counts


def _grouped(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sums of values by keys."""
    if not len(keys[0]):
        return keys, values
    by = np.lexsort(tuple(reversed(keys)))
    keys = [k[by] for k in keys]
    new = np.zeros(len(by), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    starts = np.flatnonzero(new)
    return [k[starts] for k in keys], [np.add.reduceat(v[by], starts) for v in values]


#: What the counting step writes. part: where a row goes next. The rest are arrays, as bytes.
_COUNTED = (("kind", pa.int32()), ("part", pa.int32()), ("level", pa.int32()), ("nth", pa.int64()), ("held", pa.bool_()), *((c, pa.binary()) for c in "abcde"))


def _bytes(a: np.ndarray) -> bytes:
    return _packed(a) if a.dtype == np.int64 else a.tobytes()


def _sent(kind: int, level: int, at: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """Rows for the partitions that entries go to."""
    by = np.argsort(at, kind="stable")
    at, columns = at[by], [c[by] for c in columns]
    return [(kind, int(at[lo]), level, None, None, *(_bytes(c[lo:hi]) for c in columns), *[None] * (5 - len(columns))) for lo, hi in _cuts(at)]


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each part; rows come sorted by it."""
    part, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["part"] != part:
                yield held
                held = []
            part = row["part"]
            held.append(row)
    if held:
        yield held


def counted(blocks: DataFrame, order: int, hot: dict[int, int], parts: int) -> DataFrame:
    """Counts n-grams and writes what they tell, ask and add up to, beside the rows of documents.

    TOLD: contexts of an order, classes (of the count and of the count after the shorter context, up to MOST + 1 each), how many n-grams, sums of both
    counts. ASKED: contexts, documents, and how often their weight (c), their count up (d) or down (e) is needed. SUMS: documents, known tokens, base score,
    logarithms, and tokens by class of order and count. COUNTS: counts of counts up to MOST + 1, and the sum of all counts and how many.
    """
    kind = blocks.schema["_key"].dataType.simpleString()
    often = np.sort(np.array(list(hot), np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for batch in batches:
            keys = batch["_key"].type
            rows = batch.filter(pa.compute.is_valid(batch["held"]))
            if n := rows.num_rows:
                zero = pa.array([0] * n, pa.int32())
                yield pa.RecordBatch.from_arrays([rows["_key"], zero, rows["part"], zero, rows["nth"], rows["held"], *[pa.nulls(n, pa.binary())] * 5], names=["_key", *(c for c, _ in _COUNTED)])
            for row in batch.filter(pa.compute.is_null(batch["held"])).to_pylist():
                if held and row["part"] != part:
                    for out in count(Postings.of(held, order)):
                        yield _batch(_COUNTED, out, keys)
                    held = []
                part = row["part"]
                held.append(row)
        if held:
            for out in count(Postings.of(held, order)):
                yield _batch(_COUNTED, out, keys)

    def to(hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(parts)).astype(np.int32)

    def count(p: Postings) -> Iterator[list[tuple]]:
        opens, counts = p.counts(hot)
        said = p.word != BEGIN
        for k in range(order):
            seen = opens[k] & (counts[k] > 0) & said
            whole = seen if k else seen & ~np.isin(p.word, often)  # a hot word stands in several partitions; its count is known already
            c = counts[k][whole]
            few = np.bincount(np.minimum(c, MOST + 2), minlength=MOST + 3)[: MOST + 2]
            yield [(COUNTS, 0, k + 1, None, None, _packed(few), _packed(np.array([c.sum(), len(c)])), None, None, None)]
            if k:
                ctx, own, less = p.before[k - 1][seen], counts[k][seen], counts[k - 1][seen]
                classes = np.minimum(own, MOST + 1) * (MOST + 2) + np.minimum(less, MOST + 1)
                (ctx, classes), (many, own, less) = _grouped([ctx, classes], [np.ones(len(own), np.int64), own, less])
                yield _sent(TOLD, k + 1, to(ctx), [ctx, classes, many, own, less])
        for k in range(2, order):  # what a longer context needs of its shorter one: both end in this word
            seen = opens[k - 1] & (counts[k - 1] > 0) & (p.word != END)
            ctx, none = mixed(p.before[k - 2][seen], p.word[seen]), np.zeros(seen.sum(), np.int64)
            yield _sent(TOLD, k + 1, to(ctx), [ctx, none, none, none, counts[k - 2][seen]])
        level = np.zeros(len(p.word), np.int64)  # the longest n-gram of each token that was seen
        for k in range(order):
            level[counts[k] > 0] = k + 1
        for k in range(2, order + 1):
            weight, down = said & (level < k), said & (level == k) & (k < order)
            need = weight | down
            (ctx, doc), asked = _grouped([p.before[k - 2][need], p.doc[need]], [np.where(x, p.n, 0)[need] for x in (weight, weight & (k == order), down)])
            yield _sent(ASKED, k, to(ctx), [ctx, doc, *asked])
        yield sums(p, counts, level, said)

    def sums(p: Postings, counts: list[np.ndarray], level: np.ndarray, said: np.ndarray) -> list[tuple]:
        top = np.zeros(len(level), np.int64)
        for k in range(order):
            top = np.where(level == k + 1, counts[k], top)
        logs = np.where(said & (top > MOST), p.n * np.log10(np.maximum(top, 1)), 0.0)
        if order > 1:  # every token is divided by its longest context's count; contexts are asked where that isn't so
            divides = (p.word != END) & (counts[order - 2] > 0)
            logs -= np.where(divides, p.n * np.log10(np.maximum(counts[order - 2], 1)), 0.0)
        base = np.where(said, p.n * np.log10(counts[0] + ADDED), 0.0)
        known = np.where(said & (counts[0] > 0), p.n, 0)
        classes = (MOST + 1) * order + 1  # by order and count, the last: unknown
        at = np.where(level > 0, (level - 1) * (MOST + 1) + np.minimum(top, MOST + 1) - 1, classes - 1)
        docs, place = np.unique(p.doc, return_inverse=True)
        table = np.bincount(place * classes + at, np.where(said, p.n, 0), len(docs) * classes).astype(np.int64)
        known, base, logs = (np.bincount(place, x, len(docs)) for x in (known, base, logs))
        to_ = ((docs >> 8) % parts).astype(np.int32)
        out = []
        by = np.argsort(to_, kind="stable")
        for lo, hi in _cuts(to_[by]):
            own = by[lo:hi]
            out.append((SUMS, int(to_[own[0]]), 0, int(docs[own].min()), None, _packed(docs[own] - docs[own].min()), _packed(known[own].astype(np.int64)), base[own].tobytes(), logs[own].tobytes(), _packed(table.reshape(-1, classes)[own].T.ravel())))
        return out

    return blocks.mapInArrow(run, f"_key {kind}, {_sql(_COUNTED)}")


@dataclass
class Discounts:
    """What counts lose, by order, and the tokens of the training texts."""

    lost: np.ndarray  # of an order and class of count (0 to MOST): what a count loses
    tokens: int
    words: int
    unknown: float

    @classmethod
    def of(cls, few: np.ndarray, whole: np.ndarray) -> Discounts:
        """few: counts of counts (order, 0 to MOST + 1); whole: the sum of an order's counts, and how many."""
        lost = np.full((len(few), MOST + 1), HALF)
        for k, n in enumerate(few.astype(float)):
            if np.all(n[1:] > 0) and n[1] > (MOST + 1) * n[MOST + 1]:
                far = (MOST + 1) * n[MOST + 1] / n[1]
                c = np.arange(1, MOST + 1)
                kept = ((c + 1) * n[2:] / (c * n[1:-1]) - far) / (1 - far)
                if np.all((kept > 0) & (kept < 1)):
                    lost[k, 1:] = c * (1 - kept)
        lost[:, 0] = 0
        c = np.arange(MOST + 1)
        total, words = (int(x) for x in whole[0])
        left = (few[0][: MOST + 1] * lost[0]).sum() + RELIABLE * (total - (few[0][: MOST + 1] * c).sum())
        return cls(lost, total, words, left / total if total else 1.0)

    def kept(self, order: int, classes: np.ndarray, many: np.ndarray, total: np.ndarray) -> np.ndarray:
        """What n-grams of a class keep: their counts add up to total."""
        return np.where(classes > MOST, total * (1 - RELIABLE), total - many * self.lost[order - 1][np.minimum(classes, MOST)])

    def scores(self, table: np.ndarray) -> np.ndarray:
        """Logarithms of tokens by class; those of large counts are without the count."""
        orders = len(self.lost)
        c = np.arange(1, MOST + 1)
        each = np.concatenate([*(np.r_[np.log10(c - self.lost[k, 1:]), np.log10(1 - RELIABLE)] for k in range(orders)), [np.log10(self.unknown)]])
        each[: MOST + 1] -= np.log10(max(self.tokens, 1))
        return table @ each


def weights(told: list[dict], level: int, known: Discounts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Contexts of an order, their counts and their weights."""
    ctx, classes, many, own, less = (np.concatenate([f(r[c]) for r in told] or [np.zeros(0, np.int64)]) for c, f in (("a", lambda b: np.frombuffer(b, np.uint64)), *((c, _unpacked) for c in "bcde")))
    gram = many > 0
    kept = np.where(gram, known.kept(level, classes // (MOST + 2), many, own), 0.0)
    lower = np.where(gram, known.kept(level - 1, classes % (MOST + 2), many, less), 0.0)
    (ctx,), (total, kept, lower, shorter) = _grouped([ctx], [own, kept, lower, np.where(gram, 0, less)])
    total = total.astype(float)
    divisor = np.maximum(shorter, 1) if level > 2 else max(known.tokens, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return ctx, total, (1 - kept / total) / (1 - lower / divisor)


def answered(stored: DataFrame, order: int, known: Discounts, parts: int) -> DataFrame:
    """Contexts' answers as sums of documents, of rows told and asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            docs, values = [np.zeros(0, np.int64)], [np.zeros(0)]
            for k in range(2, order + 1):
                ctx, total, weight = weights([r for r in rows if r["kind"] == TOLD and r["level"] == k], k, known)
                for r in rows:
                    if r["kind"] == ASKED and r["level"] == k and len(ctx):
                        wanted, doc, times, up, down = np.frombuffer(r["a"], np.uint64), *(_unpacked(r[c]) for c in "bcde")
                        at = np.minimum(np.searchsorted(ctx, wanted), len(ctx) - 1)
                        hit = (ctx[at] == wanted) & (total[at] > 0)
                        docs.append(doc[hit])
                        values.append((times * np.log10(weight[at]) + (up - down) * np.log10(total[at]))[hit])
            docs, values = np.concatenate(docs), np.concatenate(values)
            (docs,), (values,) = _grouped([docs], [values])
            yield _batch(_ANSWERS, [(int(p), d.tobytes(), v.tobytes()) for p, d, v in _apart(docs, values, parts)], pa.string()).drop_columns("_key")

    sent = stored.filter(F.col("kind").isin(TOLD, ASKED)).select("kind", "part", "level", *"abcde")
    return sent.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, _sql(_ANSWERS))


_ANSWERS = (("part", pa.int32()), ("docs", pa.binary()), ("answers", pa.binary()))


def _apart(docs: np.ndarray, values: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    at = (docs >> 8) % parts
    by = np.argsort(at, kind="stable")
    for lo, hi in _cuts(at[by]):
        yield at[by[lo]], docs[by[lo:hi]], values[by[lo:hi]]


def summed(sums: DataFrame, known: Discounts, classes: int, parts: int) -> DataFrame:
    """(nth, n_tokens, n_known, base_score, score): sums and answers added up by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches):
            docs, columns = [], [[], [], [], []]
            for r in rows:
                if r["answers"] is None:
                    own, table = r["nth"] + _unpacked(r["a"]), _unpacked(r["e"]).reshape(classes, -1).T
                    added = table.sum(axis=1), _unpacked(r["b"]), np.frombuffer(r["c"]), np.frombuffer(r["d"]) + known.scores(table)
                else:
                    own = np.frombuffer(r["docs"], np.int64)
                    added = *[np.zeros(len(own), np.int64)] * 2, np.zeros(len(own)), np.frombuffer(r["answers"])
                docs.append(own)
                for c, x in zip(columns, added, strict=True):
                    c.append(x)
            (docs,), (n, hit, base, score) = _grouped([np.concatenate(docs)], [np.concatenate(c) for c in columns])
            base = base - n * np.log10(known.tokens + ADDED * (known.words + 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (docs, n, hit, base, score)], names=["nth", "n_tokens", "n_known", "base_score", "score"])

    return sums.repartitionById(parts, "part").sortWithinPartitions("part").mapInArrow(run, "nth bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def words_of(rows: DataFrame) -> DataFrame:
    """(word, n, trained): how often each hash of a word or mark occurs, in all and in training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, lengths, _, held in tokens(batch):
                each, place = np.unique(word, return_inverse=True)
                n = np.bincount(place, minlength=len(each))
                trained = np.bincount(place, np.repeat(~held, lengths), len(each)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n), pa.array(trained)], names=["word", "n", "trained"])

    return rows.mapInArrow(run, "word bigint, n bigint, trained bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def score(docs: DataFrame, held: Column, key: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Every row's key, held_out, n_tokens, n_known, train_tokens, base_score and score: log10 probabilities by a model of the rows that aren't held out."""
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.monotonically_increasing_id().alias("nth"), F.coalesce(held, F.lit(False)).alias("held"), F.col(f"`{text}`").alias("text"))
    parts = 2 * slices(docs)
    words = store(words_of(rows), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # fewer than 1 / HOT_SHARE words
    hot = {r["word"] % (1 << 64): r["trained"] for r in words.filter(F.col("n") > total * HOT_SHARE).select("word", "trained").collect()}
    dealt = postings(rows, order, list(hot), parts).repartitionById(parts, "part").sortWithinPartitions("part")
    stored = store(counted(dealt, order, hot, parts), "counted")
    few, whole = np.zeros((order, MOST + 2), np.int64), np.zeros((order, 2), np.int64)
    for r in stored.filter(F.col("kind") == COUNTS).select("level", "a", "b").toLocalIterator():  # a few numbers for each partition
        few[r["level"] - 1] += _unpacked(r["a"])
        whole[r["level"] - 1] += _unpacked(r["b"])
    for w, c in hot.items():
        if c and w != int(BEGIN):
            few[0][c if c <= MOST + 1 else 0] += c <= MOST + 1
            whole[0] += (c, 1)
    known = Discounts.of(few, whole)
    sums = stored.filter(F.col("kind") == SUMS).select("part", "nth", *"abcde", F.lit(None).cast("binary").alias("docs"), F.lit(None).cast("binary").alias("answers"))
    answers = answered(stored, order, known, parts).select("part", F.lit(None).cast("bigint").alias("nth"), *(F.lit(None).cast("binary").alias(c) for c in "abcde"), "docs", "answers")
    found = summed(sums.unionByName(answers), known, (MOST + 1) * order + 1, parts)
    named = stored.filter(F.col("kind") == ROW).select("nth", "_key", "held")
    return named.join(found, "nth").select(F.col("_key").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
