"""Each operator on awkward and empty tables, and against brute force."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tests.llm import tables as T
from tokenloom.llm import chunks, common, decontaminate, langid, license_texts, licenses, pieces, quality, registry, secrets, sharding, simhash, suffixes


def test_quality(spark):
    judged = quality.judge(T.awkward(spark))
    p = quality.PREFIX
    for r in judged.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        twice = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
        lines = [x for x in (r["text"] or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r[p + "n_words"], r[p + "word_chars"], r[p + "n_repeat_words"]) == (len(words), sum(map(len, words)), len(twice))
        assert r[p + "n_dup_lines"] == len(lines) - len(set(lines))
        assert r[p + "base_failed"] == (len(words) < 20 or 100 * len(twice) > 30 * len(words))
        assert not (r[p + "base_failed"] and r[p + "kept"])
    kept = quality.keep(T.awkward(spark))
    assert kept.columns == T.awkward(spark).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in judged.filter(F.col(p + "kept")).collect())
    assert quality.judge(T.empty(spark)).count() == quality.keep(T.empty(spark)).count() == 0


def test_order_of_rules_does_not_change_the_verdict(spark):
    docs = spark.read.parquet(f"{T.SF}/documents.parquet")
    a = quality.judge(docs, rules=quality.MORE).select("doc_id", quality.PREFIX + "kept")
    b = quality.judge(docs, rules=tuple(reversed(quality.MORE)), sample_rows=5).select("doc_id", quality.PREFIX + "kept")
    assert sorted(T.rows_of(a)) == sorted(T.rows_of(b))
    assert quality.keep(docs).count() == a.filter(F.col(quality.PREFIX + "kept")).count()


def test_sharding(spark):
    placed = sharding.shard_by_bytes(T.awkward(spark), shards=3).collect()
    assert len(placed) == len(T.ROWS)
    assert sorted(r["size"] for r in placed) == sorted(len((t or "").encode()) + 1 for _, t, *_ in T.ROWS)
    for s in range(3):
        slots = sorted(r["slot"] for r in placed if r["shard"] == s)
        assert slots == list(range(len(slots)))
    big = sharding.shard_by_bytes(spark.read.parquet(f"{T.SF}/documents.parquet"))
    totals = [r[1] for r in big.groupBy("shard").agg(F.sum("size")).orderBy("shard").collect()]
    longest = big.agg(F.max("size")).first()[0]
    assert len(totals) == 8 and max(totals) - min(totals) <= 2 * longest
    bounds = big.groupBy("shard").agg(F.min("doc_id"), F.max("doc_id")).orderBy("shard").collect()
    assert all(a[2] < b[1] for a, b in zip(bounds, bounds[1:], strict=False))
    assert sharding.shard_by_bytes(T.empty(spark)).count() == 0


def _brute_phrases(docs, items, width=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for item, text in items:
        w = cut(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for text in docs:
        w, hit, found = cut(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= owners
        out.append((len(w), len(hit), sorted(found)))
    return out


def test_decontamination(spark):
    items = [(1, "Two three FOUR five six seven eight, nine ten eleven twelve"), (2, "hunter2hunter2"), (3, None), (4, "!!"), (10, "two three four five six seven eight nine ten eleven"), (5, "never seen words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (16_000_000, 10):  # one block, and a block for each item
        found = decontaminate.find(T.awkward(spark), benchmark, block_chars=block).withColumn("h", decontaminate.covered(F.col("spans")))
        got = [(r["n_words"], r["h"], list(r["items"])) for r in found.collect()]
        assert sorted(map(str, got)) == sorted(map(str, _brute_phrases([r[1] for r in T.ROWS], items)))
    kept = decontaminate.drop_contaminated(T.awkward(spark), benchmark)
    assert {r["doc_id"] for r in kept.collect()} == {None, 1, 2, 3, 5, 9} and kept.columns == T.awkward(spark).columns
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(T.awkward(spark), nothing).count() == len(T.ROWS)
    assert decontaminate.find(T.empty(spark), benchmark).count() == 0


def test_items_without_an_id_contaminate(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "beta gamma"), (7, "alpha beta")], "item_id long, text string")
    found = decontaminate.find(docs, items).withColumn("h", decontaminate.covered(F.col("spans"))).collect()
    assert {r["_key"]: (r["h"], r["items"]) for r in found} == {1: (3, ["7"]), 2: (0, [])}
    only = items.filter("item_id IS NULL")
    assert [r["doc_id"] for r in decontaminate.drop_contaminated(docs, only).collect()] == [2]


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha beta gamma delta"), (3, "alpha q q q q beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    hits = lambda slop, column: {r["_key"] for r in decontaminate.find(docs, items, slop=slop).collect() if r[column]}
    assert hits(0, "items") == hits(1, "items") == {2} and hits(1, "near") == {1, 2}


def test_one_index_serves_several_benchmarks(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "delta beta alpha"), (2, None)], "doc_id long, text string")
    index = decontaminate.build_index(docs)
    lists = {bytes(t): r["positions"][(r["at"][i - 1] if i else 0) : r["at"][i]] for r in index.collect() if r["terms"] for i, t in enumerate(r["terms"])}
    assert set(lists) == {b"alpha", b"beta", b"gamma", b"delta"}
    for text, want in (("beta gamma", {1}), ("beta alpha", {2}), ("alpha gamma", set())):
        items = spark.createDataFrame([(1, text)], "item_id long, text string")
        assert {r["_key"] for r in decontaminate.search_index(index, items).collect() if r["items"]} == want


def _group_bytes(index):
    """Bytes of each row group of a written table."""
    written = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.inputFiles()]
    groups = [m.row_group(i) for m in written for i in range(m.num_row_groups)]
    return [sum(g.column(c).total_compressed_size for c in range(g.num_columns)) for g in groups]


def _long_texts(spark, n):
    """n texts in one partition, each a segment of its own; text 7 ends with a passage."""
    words = F.transform(F.sequence(F.lit(1), F.lit(130_000)), lambda i: F.hex(F.xxhash64("doc_id", i)))
    passage = F.when(F.col("doc_id") == 7, " alpha beta gamma delta").otherwise("")
    return spark.range(0, n, 1, 1).toDF("doc_id").withColumn("text", F.concat(F.array_join(words, " "), passage))


def test_benchmark_stage_holds_a_few_segments_at_once(spark, monkeypatch):
    """Readers decode a row group of arrays at once: those of the stage's index don't grow with the task's part."""
    sizes, discard = [], decontaminate.discard
    monkeypatch.setattr(decontaminate, "discard", lambda *stored: (sizes.extend(_group_bytes(stored[0])), discard(*stored)))
    items = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    kept = {r["doc_id"] for r in decontaminate.drop_contaminated(_long_texts(spark, 12), items).select("doc_id").collect()}
    assert kept == set(range(12)) - {7}
    assert len(sizes) > 1 and max(sizes) < 12_000_000


def test_op6_holds_a_few_segments_at_once(spark, monkeypatch, tmp_path):
    """As above by the query, where a task's part is many short texts."""
    made, build = [], decontaminate.build_index
    monkeypatch.setattr(decontaminate, "build_index", lambda *a: made.append(build(*a)) or made[-1])
    words = F.transform(F.sequence(F.lit(1), F.lit(650)), lambda i: F.hex(F.xxhash64("doc_id", i)))
    passage = F.when(F.col("doc_id") % 500 == 7, " alpha beta gamma delta").otherwise("")
    spark.range(0, 2000, 1, 1).toDF("doc_id").withColumn("text", F.concat(F.array_join(words, " "), passage)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "beta gamma")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {tuple(r) for r in decontaminate.op6_decontamination(spark, str(tmp_path)).select("doc_id", "n_words", "n_hit", "contaminated").collect()}
    assert got == {(i, 654, 2, True) if i % 500 == 7 else (i, 650, 0, False) for i in range(2000)}
    sizes = _group_bytes(made[0])
    assert len(sizes) > 1 and max(sizes) < 12_000_000


def test_secrets_against_patterns(spark):
    texts = [t for _, t, *_ in T.ROWS] + [t for (t,) in T.sample_rows("documents", "text")]
    for text in texts:
        base = set()
        for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
            if len(m[2]) >= 6:
                base.add(("assign", *m.span()))
        base |= {("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20}
        base |= {("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24}
        assert {x for x in secrets.scan(text) if x[0] != "literal"} == base
    found = secrets.find_secrets(T.awkward(spark))
    assert found.count() == len(T.ROWS) and secrets.find_secrets(T.empty(spark)).count() == 0
    assert secrets.redact(T.awkward(spark)).filter("text LIKE '%hunter2%'").count() == 0


@pytest.mark.parametrize(
    ("text", "literal"),
    [
        ('CLIENT_SECRET = "aB3$kd92mLq0"', "aB3$kd92mLq0"),
        ('default = "Zx81-yyQw-0042"\nprivateKey := default', "Zx81-yyQw-0042"),
        ('{"authToken": "9f8A7b6C5d4E"}', "9f8A7b6C5d4E"),
        ("export DB_PWD='Tr0ub4dor&3xyz'", "Tr0ub4dor&3xyz"),
        ('password = "changeme"', None),
        ('title = "Nine8Seven7Six6"', None),
        ("the secret: of good bread is patience", None),
        ('def connect():\n    secret_key = TOKEN\n\nTOKEN = "Qw3rTy-88-zzPq"\n', "Qw3rTy-88-zzPq"),
        ('def a():\n    x = "Qw3rTy-88-zzPq"\ndef b():\n    x = "harmless words"\n    secret_key = x\n', None),
        ('def a():\n    x = "Qw3rTy-88-zzPq"\n    api_secret = x\ndef b():\n    x = "y"\n', "Qw3rTy-88-zzPq"),
        ('password: str = "Qw3rTy-88-zzPq"', "Qw3rTy-88-zzPq"),
        ('private_key = """Qw3rTy-88-zzPq"""', "Qw3rTy-88-zzPq"),
        ('<add key="DbPassword" value="Qw3rTy-88-zzPq"/>', "Qw3rTy-88-zzPq"),
        ("<password>Qw3rTy-88-zzPq</password>", "Qw3rTy-88-zzPq"),
        ("x" * 80 + '_password = "Qw3rTy-88-zzPq"', "Qw3rTy-88-zzPq"),
        ('config["db_password"] = "Qw3rTy-88-zzPq"', "Qw3rTy-88-zzPq"),
        ("mysql --password Qw3rTy-88-zzPq", "Qw3rTy-88-zzPq"),
        ('# api_secret = "Qw3rTy-88-zzPq"', "Qw3rTy-88-zzPq"),
        ('/* note */ const dbPassword = process.env.PW || "Qw3rTy-88-zzPq";', "Qw3rTy-88-zzPq"),
        ('password = os.getenv("PW", "Qw3rTy-88-zzPq")', "Qw3rTy-88-zzPq"),
        ('class K {\n static v = "Qw3rTy-88-zzPq";\n}\nlet authToken = K.v;', "Qw3rTy-88-zzPq"),
        ("db_secret:\n  value: Qw3rTy-88-zzPq\n", "Qw3rTy-88-zzPq"),
        ('{"db_secret": {"value": "Qw3rTy-88-zzPq"}}', "Qw3rTy-88-zzPq"),
        ("a = b\nb = a\npassword = a", None),
        ("\n".join(f"a{i} = a{i + 1}" for i in range(3000)) + '\na3000 = "Qw3rTy-88-zzPq"\npassword = a0', "Qw3rTy-88-zzPq"),
    ],
)
def test_literals(text, literal):
    found = [text[s:e] for k, s, e in secrets.scan(text) if k == "literal"]
    assert found == ([literal] if literal else [])


def test_parts_of_a_literal_are_all_found():
    for text in ('secret = "Qw3rTy-88" + "-zzPq"', 'secret = ("Qw3rTy-88"\n    "-zzPq")', 'a = "Qw3rTy-88"\nsecret = a + "-zzPq"'):
        assert [text[s:e] for k, s, e in secrets.scan(text) if k == "literal"] == ["Qw3rTy-88", "-zzPq"]


def test_golay_keys():
    patterns = simhash.coset_patterns()
    assert sorted({len(set(p)) for p in patterns.tolist()}) == [1, 6]
    assert (simhash.syndrome(patterns) == np.arange(2048)[:, None]).all()
    rng = random.Random(3)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        one, two = ({int(k) for _, ks in simhash.keys(np.array([x], dtype=np.uint64), patterns) for k in ks} for x in (a, b))
        assert one & two


@pytest.mark.parametrize("block", [simhash.BLOCK, 4])
def test_simhash(spark, block):
    rows = [(k, t) for k, t in T.sample_rows("documents", "doc_id, text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [T.brute_fingerprint(t) for _, t in rows]
    roots = T.brute_components(prints)
    least = {}
    for (k, _), r in zip(rows, roots, strict=True):
        least[r] = min(k, least.get(r, k))
    want = {k: (f"{p:016x}", least[r]) for (k, _), p, r in zip(rows, prints, roots, strict=True)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.group(docs, block=block).collect()}
    assert got == want


def test_simhash_of_awkward_rows(spark):
    got = simhash.group(T.awkward(spark)).collect()
    assert len(got) == len(T.ROWS)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 3)} == {1}
    kept = simhash.drop_near_copies(T.awkward(spark))
    assert kept.columns == T.awkward(spark).columns
    ids = [r["doc_id"] for r in kept.collect()]
    roots = T.brute_components([T.brute_fingerprint(t) for _, t, *_ in T.ROWS])
    assert len(ids) == len(set(roots)) and {1, 4}.issubset(ids) and not {2, 3, 6, None} & set(ids)
    assert simhash.group(T.empty(spark)).count() == simhash.drop_near_copies(T.empty(spark)).count() == 0


def test_near_copies_of_rows_that_lack_or_share_an_id(spark):
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"{rng.choice('abcdefgh')}{rng.randint(0, 999)}" for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, b), (None, b), (5, a), (5, c), (5, d), (6, c), (6, c), (4, d)]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        kept = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_copies(spark, docs, T.SF).collect()), key=str)
        assert kept == sorted([(5, a), (None, b), (5, c), (4, d)], key=str)


def test_spanning_edges_join_what_links_join():
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = np.array([base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(60)] + [rng.getrandbits(64) for _ in range(20)], dtype=np.uint64)
    prints = np.unique(prints)
    edges = simhash.spanning_edges(prints)
    assert len(edges) < len(prints) and all(bin(a ^ b).count("1") <= 4 for a, b in edges)
    roots = T.brute_components([int(x) for x in prints])
    assert len(edges) == len(prints) - len(set(roots))


def test_suffix_dedup_awkward(spark):
    docs = T.awkward(spark)
    got = suffixes.remove_repeats(docs, batches=3).collect()
    assert len(got) == len(T.ROWS)
    marks = {r["text"]: r["m"] for r in docs.select("text", F.hash("text").alias("m")).collect()}
    distinct = sorted({(k, t) for k, t, *_ in T.ROWS}, key=lambda x: (x[0] is not None, x[0] or 0, marks[x[1]]))
    want = T.brute_suffix(distinct)
    for r in got:
        n, spans, digest = want[r["doc_id"], r["text"]]
        assert (len((r["text"] or "").encode()) - len(r["_cut"]["kept"]), len(r["_cut"]["runs"]), hashlib.sha256(r["_cut"]["kept"]).hexdigest()) == (n, spans, digest)
    assert suffixes.remove_repeats(T.empty(spark)).count() == 0


@pytest.mark.parametrize(("batches", "block", "chunk", "frequent"), [(1, 16, 1, 3), (5, 4, 1 << 24, 100_000), (3, 77, 5000, 12)])
def test_suffix_dedup_by_batches_blocks_and_chunks(spark, monkeypatch, batches, block, chunk, frequent):
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    monkeypatch.setattr(suffixes.frequent_minimizers, "__defaults__", (*suffixes.frequent_minimizers.__defaults__[:-1], frequent))
    rows = [(k, t) for k, t in T.sample_rows("documents", "doc_id, substr(text, 1, 1500)")]
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(180))
    rows += [(1000 + i, f"{rng.random()}{shared}{rng.random()}" * 2) for i in range(12)]
    want = T.brute_suffix(sorted(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for r in suffixes.remove_repeats(docs, batches=batches, block=block).collect():
        n, spans, _ = want[r["doc_id"], r["text"]]
        assert (len((r["text"] or "").encode()) - len(r["_cut"]["kept"]), len(r["_cut"]["runs"])) == (n, spans)


def test_batches_stay_few_however_many_ranges_there_are(spark, monkeypatch):
    rows = spark.createDataFrame([(i if i % 10 else None, "", "x") for i in range(200)], "_key int, _mark string, _text string")
    by_range = type(rows).repartitionByRange
    monkeypatch.setattr(type(rows), "repartitionByRange", lambda self, n, *c: by_range(self, max(n, 16), *c))
    parts = [[r["_key"] for r in p.collect()] for p in suffixes._batches(rows, 3)]
    assert len(parts) == 3
    keys = [k for p in parts for k in p if k is not None]
    assert sorted(keys) == [i for i in range(200) if i % 10] and sum(map(len, parts)) == 200
    assert all(max(k for k in a if k is not None) < min(b) for a, b in zip(parts, parts[1:], strict=False))
    assert max(map(len, parts)) < 2 * 200 / 3


def test_levels_merge_geometrically(spark):
    rows = spark.read.parquet(f"{T.SF}/documents.parquet").select(F.col("doc_id").alias("_key"), F.lit("").alias("_mark"), F.col("text").alias("_text"))
    family = suffixes.Family(spark, 4)
    ranks = []
    for part in suffixes._batches(rows, 4):
        family.insert(suffixes.entries(part))
        ranks.append(sorted(family.levels))
    assert ranks == [[0], [1], [0, 1], [2]]
    level = family.levels[2]
    assert level.count() == suffixes.entries(rows).filter(suffixes._salt() == 0).select("gram", "seg").distinct().count()
    # a scan shuffles the new batch only
    plan = suffixes.merge_scan(suffixes.entries(rows), [level], 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    family.discard()


def test_suffix_dedup_takes_ids_of_any_type(spark):
    rows = [(f"k{i:04}", t) for i, (t,) in enumerate(T.sample_rows("documents", "substr(text, 1, 800)"))]
    want = T.brute_suffix(rows)
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(1) for c in ("_key", "_mark", "_text", "_row", "_maybe", "spans")})
    for r in suffixes.remove_repeats(docs, batches=3).collect():
        assert len(r["text"].encode()) - len(r["_cut"]["kept"]) == want[r["doc_id"], r["text"]][0] and r["_key"] == 1


def test_chunks():
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefghij klmnop") for _ in range(400))
    for _ in range(50):
        a, b = (("".join(rng.choice("qrstuv ") for _ in range(rng.randint(0, 300))) + passage).encode() for _ in range(2))
        inside = lambda raw: {raw[s : s + n] for s, n, _ in chunks.chunk(raw.decode())}
        assert len(inside(a) & inside(b)) >= 3
        assert b"".join(a[s : s + n] for s, n, _ in chunks.chunk(a.decode())) == a


def test_chunk_dedup(spark):
    got = chunks.remove_repeated(T.awkward(spark)).collect()
    assert len(got) == len(T.ROWS)
    left = {}
    for r in got:
        left.setdefault(r["doc_id"], []).append(len(r["_kept"]))
    assert len(left[4]) == 2 and left[4][0] == left[4][1] > 0
    assert left[6][0] < left[4][0] and left[1] == [0]
    assert chunks.remove_repeated(T.empty(spark)).count() == 0


def test_exact_copies_lose_all_their_bytes(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcdefghij klmnop") for _ in range(n)) for n in (1, 5, 20, 31, 40, 60, 300, 3000)]
    assert any(25 <= n < 32 for t in texts for _, n, _ in chunks.chunk(t))
    docs = spark.createDataFrame([(100 * r + i, t) for r in (0, 1) for i, t in enumerate(texts)], "doc_id long, text string")
    left = {r["doc_id"]: bytes(r["_kept"]) for r in chunks.remove_repeated(docs).collect()}
    assert all(left[i] == t.encode() and left[100 + i] == b"" for i, t in enumerate(texts))


def test_language(spark):
    docs = spark.read.parquet(f"{T.SF}/documents.parquet").unionByName(T.awkward(spark, extra=False))
    model = langid.fit(docs)
    found = langid.predict(docs, model).collect()
    assert np.mean([r["lang"] == r["_language"]["lang"] for r in found if (r["doc_id"] or 0) > 20]) > 0.97
    assert all(0 <= r["_language"]["score"] <= 1 for r in found)
    assert all(r["_language"]["lang"] == "und" for r in found if not any(c.isalpha() for c in r["text"] or ""))
    assert langid.fit(T.empty(spark)) is None
    assert langid.predict(T.awkward(spark), None).filter("_language.lang = 'und'").count() == len(T.ROWS)


def test_licenses(spark):
    rows = [
        (1, "Released under the MIT License.", "a/LICENSE"),
        (2, "code and more code\nLicensed under the Apache License, Version 2.0.\n" + "text " * 50, "a/b/x.py"),
        (3, "no word of it", "a/b/c/d/y.py"),
        (4, "nothing", "z/y.py"),
        (5, None, "a/q.py"),
        (6, "", None),
        (7, "This work is licensed under the GNU General Public License, version 3", "a/b/c/COPYING"),
        (7, "This work is licensed under the GNU General Public License, version 3", "a/b/c/COPYING"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, path string").withColumns({"own": F.lit(1), "term": F.lit(2), "directory": F.lit(3)})
    got = {r["doc_id"]: (r["license"], r["found_by"]) for r in licenses.inherit(licenses.declarations(docs)).collect()}
    assert got == {1: ("MIT", "file"), 2: ("Apache-2.0", "header"), 3: ("GPL-3.0", "inherited"), 4: (None, "none"), 5: ("MIT", "inherited"), 6: (None, "none"), 7: ("GPL-3.0", "file")}
    none = T.empty(spark).withColumn("path", F.col("source"))
    assert licenses.inherit(licenses.declarations(none)).count() == 0


def test_pieces_equal_the_library(spark):
    vocabulary = pieces.Vocabulary.load()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(4)
    texts = [t for (t,) in T.sample_rows("documents", "text")] + [t for _, t, *_ in T.ROWS if t is not None]
    texts += ["  a  b ", "日本語 テスト\r\n", "<s> </s> <0x41>", "a▁b"] + ["".join(rng.choice("ab the, XYé中\n 1") for _ in range(200)) for _ in range(50)]
    for t, ids in zip(texts, pieces.Encoder(vocabulary).encode(texts), strict=True):
        assert ids.tolist() == library.encode(t)
        assert pieces.decode_ids(ids, pieces.piece_bytes(vocabulary)) == t.replace("▁", " ")
    coded = pieces.encoded_documents(T.awkward(spark)).collect()
    assert len(coded) == len(T.ROWS) and all(r["round_trip"] for r in coded)
    assert pieces.encoded_documents(T.empty(spark)).count() == 0


def test_viterbi_words(spark):
    table = [("a", 1, -1.0), ("b", 2, -1.2), ("ab", 3, -1.9), ("abc", 4, -2.0), ("c", 5, -3.0), ("bc", 6, -1.5), ("▁", 7, -0.5), ("▁a", 8, -0.9)]
    score = {p: (i, s) for p, i, s in table}

    def best(word):
        paths = {0: (0.0, [])}
        for end in range(1, len(word) + 1):
            offers = [(paths[s][0] + score[word[s:end]][1], paths[s][1] + [score[word[s:end]][0]]) for s in range(end) if s in paths and word[s:end] in score]
            if offers:
                paths[end] = max(offers, key=lambda x: x[0])
        return paths.get(len(word), (0, None))[1]

    long = "ab" * 9
    table.append((long, 9, -1.0))
    score[long] = (9, -1.0)
    words = ["abc", "aab", "▁abcabc", "bca", "axb", "x", "", long + "c"]
    got = {r["word"]: r["ids"] for r in pieces.viterbi_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(table, "piece string, id int, score double")).collect()}
    assert got == {w: best(w) for w in words if best(w) or (w and any(c in score for c in w))}


def test_merge_words_equal_the_encoder(spark):
    vocabulary = pieces.Vocabulary.load()
    encode = pieces.Encoder(vocabulary)
    words = sorted({u for (t,) in T.sample_rows("documents", "text")[:40] for u in pieces.as_units(t, encode.pattern) if 1 < len(u) <= 40 and encode.letters.issuperset(u)})
    table = [(p, i, vocabulary.scores[i]) for p, i in vocabulary.plain()]
    got = pieces.merge_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame(table, "piece string, id int, score double")).collect()
    encode.learn(words)
    assert len(got) == len(words) > 500 and all(r["ids"] == encode.known[r["word"]].tolist() for r in got)


def test_language_of_symbols_beyond_the_letters(spark):
    for text in ("\U000f0000\U000f0001", "\U000e0041 \U000e0042", "123 .,", ""):
        assert len(langid.counts(text)[0]) == 0
    assert len(langid.counts("\U00020001")[0]) > 0


def test_costs_of_rules_are_measured(spark):
    docs = spark.read.parquet(f"{T.SF}/documents.parquet")
    seen = quality.measured(quality.sampled(docs), quality.MORE)
    assert set(seen) == {r.name for r in quality.MORE} and all(0 <= s <= 1 and c >= quality.LEAST_SECONDS for s, c in seen.values())
    assert quality.sampled(docs, sample_rows=50).count() < docs.count()


def test_license_texts_and_blocks(spark):
    mit = license_texts.TEXTS["MIT"][0]
    gpl = license_texts.TEXTS["GPL-3.0"][0].replace(". ", ".\n# ").replace("\n\n", "\n#\n# ")
    rows = [
        (1, "SPDX-License-Identifier: GPL-2.0-only", "a/x.c", ("GPL-2.0", "file")),
        (2, "GNU AFFERO GENERAL PUBLIC LICENSE Version 3", "b/COPYING", ("AGPL-3.0", "file")),
        (3, "MIT License\n\nCopyright (c) 2020 A. N. Other\n\n" + mit, "c/some.txt", ("MIT", "file")),
        (4, f"# {gpl}\nimport os\n" + "\n".join(f"call_{i}(value_{i}, other_{i})" for i in range(80)), "d/y.py", ("GPL-3.0", "header")),
        (5, "nothing", "c/deep/er/z.py", ("MIT", "inherited")),
        (6, "the permission of the software notice", "e/z.py", (None, "none")),
        (7, "\n".join(f"call_{i}()" for i in range(300)) + "\n" + mit.split("\n\n")[0], "f/z.py", ("MIT", "header")),
    ]
    clash = ("text_mark", "_license", "_cosine", "_whole", "license", "found_by", "from_directory", "mark", "unit", "own_directory", "inherited_license")
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, path string").withColumns({c: F.lit("x") for c in clash})
    got = {r["doc_id"]: (r["license"], r["found_by"], r["text_mark"]) for r in licenses.inherit(licenses.declarations(docs)).collect()}
    assert got == {r[0]: (*r[3], "x") for r in rows}


def _scores_by_hand(text, listed, idf, other):
    """The cosines of a text's units with all templates, plainly."""
    own = re.sub(licenses._OWNER.replace("(?im)", ""), "", text, flags=re.I | re.M)
    units = [*own.split("\n"), *re.split(r"\n[^\w\n]*\n", own), own]
    best = (False, 0.0, None)
    for u in units:
        tf = {}
        for w in re.findall("[a-z0-9]+", u.lower()):
            tf[w] = tf.get(w, 0) + 1
        norm = sum((n * idf.get(w, other)) ** 2 for w, n in tf.items()) ** 0.5
        for name, t, shared in listed:
            size = sum((n * idf[w]) ** 2 for w, n in t.items()) ** 0.5
            c = round(sum(n * idf[w] * t[w] * idf[w] for w, n in tf.items() if w in t) / (norm * size), 9) if norm else 0.0
            best = max(best, (c >= licenses.MIN_COSINE and not shared, c, name), key=lambda x: x[:2])
    return best[1:]


def test_license_cosines_against_brute_force(spark):
    docs = spark.read.parquet(f"{T.SF}/documents.parquet")
    listed = licenses.templates()
    idf, other = licenses.inverse_frequencies(docs, sorted({t for _, tf, _ in listed for t in tf}))
    for r in licenses.declarations(docs).collect():
        c, name = _scores_by_hand(r["text"], listed, idf, other)
        assert (r["_license"] is not None) == (c >= licenses.MIN_COSINE)
        if c >= licenses.MIN_COSINE:
            assert abs(r["_cosine"] - c) < 1e-6


def test_chunk_dedup_against_brute_force(spark):
    rows = sorted(T.sample_rows("documents", "doc_id, text"))
    seen, want = set(), {}
    for key, text in rows:
        removed = 0
        for _, n, digest in chunks.chunk(text):
            removed += n if digest in seen else 0
            seen.add(digest)
        want[key] = removed
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in chunks.op3_chunk_dedup(spark, T.SF).collect()}
    assert got == {k: (len((t or "").encode()), want[k]) for k, t in rows}
    clash = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("_key", "_mark", "_hash", "_row", "_maybe", "spans")})
    assert chunks.remove_repeated(clash).filter("_hash = 1 AND _row = 1").count() == len(rows)


def test_registered_queries_without_sql_against_brute_force(spark):
    rows = sorted(T.sample_rows("documents", "doc_id, text"))
    want = T.brute_suffix(rows)
    for r in suffixes.op4_suffix_dedup(spark, T.SF).collect():
        text = dict(rows)[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(text.encode()), *want[r["doc_id"], text])
    prints = [T.brute_fingerprint(t) for _, t in rows]
    roots = T.brute_components(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7_simhash_golay(spark, T.SF).collect()}
    assert got == {k: (f"{p:016x}", rows[i][0]) for (k, _), p, i in zip(rows, prints, roots, strict=True)}
    for r in secrets.op8_secret_scan(spark, T.SF).collect():
        found = secrets.scan(dict(rows)[r["doc_id"]])
        base = ",".join(f"{k}:{s}:{e}" for k, s, e in found if k != "literal")
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"] == ",".join(f"{k}:{s}:{e}" for k, s, e in found)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[0] == k for x in found) for k in secrets.KINDS[:3])
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in pieces.op1_sentencepiece(spark, T.SF).collect():
        ids = library.encode(dict(rows)[r["doc_id"]])
        assert (r["n_pieces"], r["pieces_sha256"], r["round_trip"]) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True)
    langs = dict(T.sample_rows("documents", "doc_id, lang"))
    found = langid.op10_language_id(spark, T.SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in found if r["held_out"] and langs[r["doc_id"]]]
    assert len(held) > 20 and np.mean(held) > 0.95


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_registered_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{T.SF}/{table}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in want.description)
    got = registry.queries()[name](spark, T.SF)
    assert sorted(got.columns) == columns
    assert sorted(map(str, T.rows_of(got.select(*columns)))) == sorted(str(r) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())


def test_hot_keys_of_a_join(spark, monkeypatch):
    large = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("int").alias("key"), "id").withColumn("k", F.lit("own"))
    small = large.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("k"))
    plain = sorted(T.rows_of(common.salted(large, small, "key", F.col("id"))))
    monkeypatch.setattr(common, "HOT", 100)
    dealt = common.salted(large, small, "key", F.col("id"))
    assert "_salt" in dealt._jdf.queryExecution().toString() and sorted(T.rows_of(dealt)) == plain and len(plain) == 3000
