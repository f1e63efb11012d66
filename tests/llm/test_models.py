"""Importance resampling, the Katz model and conversation tries against brute force, and on awkward tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm import tables as T
from tokenloom.llm import importance, katz, langid, tries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


# importance resampling


def drawn(rows, target, width, buckets=50, share=30, least=5):
    """By key and features: weight, score, rank."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    of = lambda t: [" ".join(w[i : i + n]) for w in [cut(t)] for n in range(1, width + 1) for i in range(len(w) - n + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in of(x)) for texts in ([x for _, x in rows], target))
    whole = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * whole[0] / ((s[b] + 1) * whole[1]))) for b in s}
    out = []
    for key, text in rows:
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in of(text))
        out.append([key, len(of(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(cut(text))])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for i, r in enumerate(fit[: share * len(fit) // 100]):
        r[4] = i + 1
    return sorted(map(str, (tuple(r[:5]) for r in out)))


@pytest.mark.parametrize("width", [1, 3])
def test_resampling(spark, width, monkeypatch):
    monkeypatch.setattr(importance, "AT_ONCE", 50)
    target = [t for (t,) in T.sample_rows("benchmark", "text")] + [None, ""]
    for docs in (T.awkward(spark), spark.createDataFrame(T.sample_rows("documents", "doc_id, text"), "doc_id long, text string").repartition(3)):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        got = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), width=width, buckets=50, share=30, least_words=5)
        assert sorted(map(str, T.rows_of(got))) == drawn(rows, target, width)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(T.empty(spark), none).count() == 0
    assert {r["rank"] for r in importance.resample(T.awkward(spark), none, share=0).collect()} == {None}
    named = T.awkward(spark).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert importance.resample(named, none).count() == len(T.ROWS)


def test_pieces_of_long_texts():
    text = "ab  cd\n" * 1000 + "x" * 500 + " end"
    whole = [f for _, own in importance.features(text, 2) for f in own]
    raw = text.encode().translate(importance._LETTERS)
    cut = list(importance.pieces(raw, 64))
    assert b"".join(cut) == raw and len(cut) > 50
    assert Counter(whole) == Counter(w for p in [raw.split()] for w in [*p, *(b" ".join(p[i : i + 2]) for i in range(len(p) - 1))])


# the Katz model


def katz_by_hand(rows, order, held):
    """(key, held out, tokens, known, training tokens, base score, score) of each row, the model's function and vocabulary."""
    counts = [Counter() for _ in range(order + 1)]
    for key, text in rows:
        if not held(key):
            s = ["<b>"] * order + words(text) + ["</s>"]
            for i in range(order, len(s)):
                for k in range(1, order + 1):
                    counts[k][tuple(s[i - k + 1 : i + 1])] += 1
    n, most = sum(counts[1].values()), katz.MOST
    lost = [{}]
    for k in range(1, order + 1):
        of = Counter(counts[k].values())
        kept = None
        if all(of[c] for c in range(1, most + 2)) and of[1] > (most + 1) * of[most + 1]:
            far = (most + 1) * of[most + 1] / of[1]
            kept = {c: ((c + 1) * of[c + 1] / (c * of[c]) - far) / (1 - far) for c in range(1, most + 1)}
            kept = kept if all(0 < x < 1 for x in kept.values()) else None
        lost.append({c: c * (1 - kept[c]) if kept else katz.HALF for c in range(1, most + 1)})
    loses = lambda k, c: lost[k][c] if c <= most else katz.RELIABLE * c
    total, after = defaultdict(int), defaultdict(list)
    for k in range(2, order + 1):
        for gram, c in counts[k].items():
            total[gram[:-1]] += c
            after[gram[:-1]].append(gram[-1])
    unknown = sum(loses(1, c) for c in counts[1].values()) / n if n else 1.0

    def p(ctx, w):
        k = len(ctx) + 1
        if k == 1:
            c = counts[1][(w,)]
            return (c - loses(1, c)) / n if c else unknown
        if c := counts[k][(*ctx, w)]:
            return (c - loses(k, c)) / total[ctx]
        if not total[ctx]:
            return p(ctx[1:], w)
        weight = sum(loses(k, counts[k][(*ctx, x)]) for x in after[ctx]) / total[ctx] / (1 - sum(p(ctx[1:], x) for x in after[ctx]))
        return weight * p(ctx[1:], w)

    out = []
    for key, text in rows:
        s = ["<b>"] * order + words(text) + ["</s>"]
        known = [counts[1][(w,)] for w in s[order:]]
        base = sum(math.log10((c + 0.1) / (n + 0.1 * (len(counts[1]) + 1))) for c in known)
        out.append((key, held(key), len(known), sum(c > 0 for c in known), n, base, sum(math.log10(p(tuple(s[i - order + 1 : i]), s[i])) for i in range(order, len(s)))))
    return out, p, [w for (w,) in counts[1]], after


def in_tenth(key):
    return zlib.crc32(str(key).encode() if key is not None else b"") % 10 == 0


HELD = lambda: F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz_scores(spark, order, monkeypatch):
    monkeypatch.setattr(katz, "AT_ONCE", 20_000)
    rows = T.sample_rows("documents", "doc_id, text")
    want, *_ = katz_by_hand(rows, order, in_tenth)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r) for r in katz.score(docs, HELD(), order=order).collect()}
    assert len(got) == len(want)
    for w in want:
        assert got[w[0]][:5] == w[:5] and got[w[0]][5:] == pytest.approx(w[5:], rel=1e-9)


def test_probabilities_sum_to_one():
    rows = T.sample_rows("documents", "doc_id, text")[:30]
    _, p, vocabulary, after = katz_by_hand(rows, 3, in_tenth)
    for ctx in [*list(after)[:15], ("never", "seen"), ("x", vocabulary[3])]:
        assert sum(p(ctx, w) for w in vocabulary) + p(ctx, "unknown word") == pytest.approx(1)


def test_katz_registered_query_and_awkward_tables(spark):
    rows = T.sample_rows("documents", "doc_id, text")
    want, *_ = katz_by_hand(rows, katz.ORDER, in_tenth)
    got = sorted(katz.op11_lm_scoring(spark, T.SF).collect())
    for w, g in zip(sorted(want), got, strict=True):
        assert tuple(g[:5]) == w[:5] and tuple(g[5:]) == pytest.approx(w[5:], rel=1e-9)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)
    docs = T.awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want, *_ = katz_by_hand(rows, 2, in_tenth)
    got = sorted((tuple(r) for r in katz.score(docs, HELD()).collect()), key=str)
    for w, g in zip(sorted(want, key=str), got, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert katz.score(T.empty(spark), HELD()).count() == 0
    assert {r["score"] for r in katz.score(docs, F.lit(True)).collect()} == {0.0}


# tries


def trie(convs):
    """{(conv_id, depth): the rest} of {conv: [(role, text)]}."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(members) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
    out = {}
    for n, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(n))))
        out[min(members), len(n)] = (min(nodes[n[:-1]]) if n else None, len(members), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest())
    return out


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), text or ""))
    own = {c: [(r, x) for *_, r, _, x in sorted(turns)] for c, turns in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    return {c: own.get(c - int(math.fmod(c, 20)), [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    return {r[:2]: r[2:] for r in rows}


CONVERSATION = "conv_id long, turn long, role string, text string"


def test_trie_of_awkward_conversations(spark, monkeypatch):
    monkeypatch.setattr(tries, "PIECE", 3)
    monkeypatch.setattr(tries, "CHAIN", 2)
    rows = [(c, t, "u", f"hello {t}") for c in range(40, 52) for t in range(c % 5)]
    rows += [(c, t, "u", f"long {t} " * 3) for c in (60, 61, 62, 63) for t in range(11 + c % 2)] + [(64, t, None, f"own {t}") for t in range(9)]
    rows += [(7, None, None, None), (7, 1, "a", "x y"), (7, 1, "a", "x y"), (-3, 0, "u", ""), (-3, 0, "u", "z"), (None, 0, "u", "lost"), (81, 0, "u", "one"), (93, 5, "", "")]
    turns = spark.createDataFrame(rows, CONVERSATION).withColumns({c: F.lit(1) for c in ("d", "conv", "node", "top", "k")}).repartition(4)
    for strides in ((1, 2), (3, 3), (64, 64)):
        assert found(tries.prefix_trie(*tries.rebuilt(turns), *strides)) == trie(rebuilt(rows))
    plain = {c: [] for c in {r[0] for r in rows if r[0] is not None}}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())):
        plain[c].append((role or "", text or ""))
    assert found(tries.prefix_trie(*tries.in_order(turns))) == trie(plain)


def test_trie_registered_query_and_empty_table(spark):
    rows = T.sample_rows("conversations", "conv_id, turn, role, text")
    assert found(tries.op13_conversation_trie(spark, T.SF)) == trie(rebuilt(rows))
    assert tries.prefix_trie(*tries.rebuilt(spark.createDataFrame([], CONVERSATION))).count() == 0


def test_the_labelled_sample_is_of_rows(spark):
    """One key on all rows, or none, sends no more rows to the driver than were asked for."""
    one = spark.range(2000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id") % 1500).alias("text"), F.lit("en").alias("lang"))
    for docs in (one, one.withColumn("doc_id", F.lit(None).cast("long")), one.withColumn("text", F.lit("all alike"))):
        sample = langid.labelled_sample(docs, "doc_id", "text", "lang", 10)
        assert len(sample) == 10
        assert [list(a) for a in langid.labelled_sample(docs.repartition(5), "doc_id", "text", "lang", 10)["at"]] == [list(a) for a in sample["at"]]
    assert len(langid.labelled_sample(T.empty(spark), "doc_id", "text", "lang", 10)) == 0
