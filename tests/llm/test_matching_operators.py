"""Fingerprints, line dedup, decontamination, Jaccard join, components, sharding: brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm.components import connected_components
from tessella.llm.decontaminate import contamination, digest
from tessella.llm.fingerprints import compare_edits, likeness, with_fingerprint
from tessella.llm.jaccard import jaccard_components
from tessella.llm.line_dedup import DISTANCE, EDITS, LOST, RARE, _enough, _keys, candidates, dedup_lines, key_lists, line_keys, marked, maybe, possible, simhashes
from tessella.llm.linking import open_lists, signed, unconnected
from tessella.llm.sharding import CommitConflict, SchemaConflict, Shard, ShardStore, shard_members

WORDS = [f"w{k}" for k in range(400)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def family(rng, n, edits):
    base = [rng.choice(WORDS) for _ in range(n)]
    for _ in range(edits):
        base[rng.randrange(n)] = rng.choice(WORDS)
    return " ".join(base)


# components

def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(500 + k, 501 + k) for k in range(60)] + [(700, 700 + k) for k in range(1, 90)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# fingerprints

def shingles(text, n):
    w = [x for x in re.split(r"[\x09-\x0d ]+", text.lower()) if x]
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    rng = random.Random(7)
    texts = [family(rng, rng.choice([3, 8, 40, 300, 900]), 0) for _ in range(60)]
    rows = [(k * 3, t) for k, t in enumerate(texts)] + [(1000, None), (1001, ""), (1002, texts[4]), (None, "no id"), (1003, "ÄÖ 👍 x")]
    got = {r["doc_id"]: r for r in compare_edits(frame(spark, rows).repartition(7)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    errors = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and (r["fingerprint"] == "") == (not t.split())
        errors.append(abs(r["near_edited"] - jaccard(shingles(t, 5), shingles(edited, 5))))
    assert sum(errors) / len(errors) < 0.03 and max(errors) < 0.2
    assert got[1002]["fingerprint"] == got[12]["fingerprint"] != got[15]["fingerprint"]
    assert compare_edits(frame(spark, [])).count() == 0
    one = compare_edits(frame(spark, [(1, "a b c d e f g h")])).collect()[0]
    assert one["near_next"] == 1.0


def test_likeness_is_unbiased(spark):
    rng = random.Random(9)
    rows = []
    for k in range(80):
        a = [rng.choice(WORDS) for _ in range(400)]
        b = a[: 400 - k * 4] + [rng.choice(WORDS) for _ in range(k * 4)]
        rows.append((k, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "k long, a string, b string")
    both = with_fingerprint(with_fingerprint(df, "a", "fa"), "b", "fb").select("k", likeness(F.col("fa"), F.col("fb")).alias("j")).collect()
    off = [r["j"] - jaccard(shingles(rows[r["k"]][1], 5), shingles(rows[r["k"]][2], 5)) for r in both]
    assert abs(sum(off) / len(off)) < 0.012


# line dedup

def test_simhash_against_counting(spark):
    rng = random.Random(1)
    lines = [sorted({rng.choice(WORDS) for _ in range(n)}) for n in (1, 2, 5, 64, 200)]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(lines)], "k long, words array<string>")
    want = []
    for w in lines:
        hashes = [r[0] for r in spark.createDataFrame([(x,) for x in w], "w string").select(F.xxhash64("w")).collect()]
        bits = sum((sum(h >> b & 1 for h in hashes) * 2 > len(w)) << b for b in range(64))
        want.append(bits - (1 << 64) if bits >> 63 else bits)
    for width in (16, 32):
        assert [r["sim"] for r in simhashes(df, ("k",), width).orderBy("k").collect()] == want


def test_line_dedup(spark):
    rows = [
        (1, "Header  line\nunique one here"),
        (2, "header line\n\nunique two there"),
        (3, "HEADER LINE"),
        (4, None),
        (5, ""),
        (None, "header line"),
        (6, "same\nsame\nother\r"),
        (7, "OTHER"),
    ]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in dedup_lines(frame(spark, rows).withColumn("n_kept", F.lit("clash"))).collect()}
    assert got[1] == (rows[0][1], 2, 2)
    assert got[2] == ("\nunique two there", 3, 2)
    assert got[3] == ("", 1, 0) and got[4] == (None, 0, 0) and got[5] == ("", 1, 1) and got[None] == ("header line", 1, 1)
    assert got[6] == ("same\nother\r", 3, 2) and got[7] == ("", 1, 0)
    assert dedup_lines(frame(spark, [])).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_lines_against_all_pairs(spark):
    """Groups are those of all pairs within the SimHash distance and the edit similarity."""
    rng = random.Random(6)
    lines = []
    for _ in range(12):
        base = [rng.choice(WORDS) for _ in range(rng.choice([8, 40, 150]))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            lines.append(" ".join(w))
    words = spark.createDataFrame([(k, list(dict.fromkeys(t.split()))) for k, t in enumerate(lines)], "k long, words array<string>")
    sim = {r["k"]: r["sim"] & (1 << 64) - 1 for r in simhashes(words, ("k",), 16).collect()}
    first = list(range(len(lines)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    near = 0
    for a in range(len(lines)):
        for b in range(a):
            x, y = lines[a].split(), lines[b].split()
            if (sim[a] ^ sim[b]).bit_count() <= DISTANCE and levenshtein(x, y) <= 0.2 * max(len(x), len(y)):
                near += x != y
                x, y = find(a), find(b)
                first[max(x, y)] = min(x, y)
    assert near > 20
    got = {r["doc_id"]: r["n_kept"] for r in dedup_lines(frame(spark, list(enumerate(lines)))).collect()}
    assert got == {k: int(find(k) == k) for k in range(len(lines))}


def test_unlike_lines_stay(spark):
    rng = random.Random(8)
    rows = [(k, " | ".join(rng.choice(WORDS) for _ in range(12))) for k in range(200)]
    assert dedup_lines(frame(spark, rows)).where("n_kept = 0").count() == 0


def word_groups(lines):
    """The first line of each group of all pairs with edit similarity 0.8 over words."""
    first = list(range(len(lines)))

    def find(x):
        while first[x] != x:
            x = first[x]
        return x

    for a in range(len(lines)):
        for b in range(a):
            x, y = lines[a].split(), lines[b].split()
            if levenshtein(x, y) <= 0.2 * max(len(x), len(y)):
                x, y = find(a), find(b)
                first[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(lines))]


def test_every_near_line_is_found(spark):
    """Lines of all lengths up to the limit of edits (changed, inserted, removed words) against all pairs, without SimHash."""
    rng = random.Random(12)
    lines = []
    for n in (4, 5, 6, 8, 9, 10, 12, 14, 19, 20, 24, 50):
        for _ in range(4):
            base = [rng.choice(WORDS) for _ in range(n)]
            lines.append(" ".join(base))
            w = list(base)
            for _ in range((n + 1) // 5):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 1])] = [rng.choice(WORDS)] * rng.choice([0, 1, 1])
            lines.append(" ".join(w))
    passage = " ".join(rng.choice(WORDS) for _ in range(12))
    lines += [f"{family(rng, 20, 0)} {passage} {family(rng, 20, 0)}" for _ in range(150)]
    want = word_groups(lines)
    assert sum(k != g for k, g in enumerate(want)) > 35
    got = {r["doc_id"]: r["n_kept"] for r in dedup_lines(frame(spark, list(enumerate(lines)))).collect()}
    assert got == {k: int(g == k) for k, g in enumerate(want)}


def test_long_words_do_not_hide_near_lines(spark):
    """Lines that differ in one very long word, or by a word that is a fifth of their characters."""
    rng = random.Random(13)
    base = [rng.choice(WORDS) for _ in range(150)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:70], "http://" + "x" * 600, *base[71:]])), (3, "a b c d"), (4, "a b c d longer")]
    assert {r["doc_id"]: r["n_kept"] for r in dedup_lines(frame(spark, rows)).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}


# decontamination

def words_of(t):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute_contamination(docs, items):
    out = {}
    for i, t in docs:
        w = words_of(t)
        hit, ids = set(), set()
        for k, text in items:
            v = words_of(text)
            n = min(10, len(v))
            if not n or k is None:
                continue
            spans = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)}
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in spans:
                    hit.update(range(a, a + n))
                    ids.add(str(k))
        out[i] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def test_contamination(spark):
    rng = random.Random(11)
    items = [(k, family(rng, rng.choice([1, 4, 9, 10, 11, 30, 80]), 0)) for k in range(30)] + [(90, None), (91, "..."), (None, "a b c"), (92, "x " * 40)]
    docs = [(0, None), (1, ""), (2, "x " * 100), (3, "É w1 É")]
    for k in range(4, 60):
        t = family(rng, rng.choice([3, 60, 200]), 0).split()
        if rng.random() < 0.6:
            source = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, max(0, len(source) - 5))
            place = rng.randint(0, len(t))
            t[place:place] = [x.upper() + "," for x in source[a : a + rng.randint(8, 25)]]
        docs.append((k, " ".join(t)))
    want = brute_contamination(docs, items)
    for block in (10**6, 50):
        found = contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_words=block)
        assert {r[0]: tuple(r[1:]) for r in digest(found).collect()} == want
    assert contamination(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = digest(contamination(frame(spark, docs), spark.createDataFrame([], "item_id long, text string"))).collect()
    assert not any(r["contaminated"] for r in none)


# Jaccard join

def brute_components(rows, n, num, den):
    sets = [shingles_ascii(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return Counter((repr(i), len(sets[k]), repr(least.get(find(k)))) for k, (i, _) in enumerate(rows))


def shingles_ascii(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize(("n", "num", "den"), [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_jaccard(spark, n, num, den):
    rng = random.Random(13)
    rows, k = [], 0
    shared = family(rng, 60, 0)
    for _ in range(25):
        base = family(rng, rng.choice([2, 5, 30, 120, 300]), 0).split()
        for _ in range(rng.choice([1, 1, 2, 6, 12])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            if rng.random() < 0.3:
                w += shared.split()
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, "A b"), (903, "a B"), (None, rows[0][1]), (None, "only null"), (904, rows[0][1])]
    df = frame(spark, rows).repartition(6).withColumn("n", F.lit("clash")).withColumn("token", F.lit(1))
    got = Counter((repr(r["doc_id"]), r["n_shingles"], repr(r["component_id"])) for r in jaccard_components(df, n, num, den).collect())
    assert got == brute_components(rows, n, num, den)


def test_jaccard_edges(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    got = jaccard_components(frame(spark, [(1, None), (2, " ")])).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == [(0, 1), (0, 2)]


# sharding

def test_shards(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target=60_000, fanout=3, shard_rows=50)
    rng = random.Random(2)
    rows = [(k if k % 9 else None, None if k % 7 == 0 else family(rng, 40, 0)) for k in range(600)]
    for part in (rows[:200], rows[200:350], rows[350:], []):
        store.append(frame(spark, part).repartition(4) if part else frame(spark, part))
    before = store.manifest()
    assert before["version"] == 4 and len(before["shards"]) >= 12
    after = store.compact()
    assert after["version"] > 4 and len(after["shards"]) < len(before["shards"])
    assert all(len(t) < 3 for t in store.tiers(after["shards"]).values())
    same = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = sorted(map(repr, rows))
    assert same(store.read()) == want and same(store.read(4)) == want and same(store.read(1)) == sorted(map(repr, rows[:200]))
    with pytest.raises(CommitConflict):
        store.commit(before, before["shards"], before["schema"])
    store.vacuum()
    assert store.versions() == [after["version"]] and same(store.read()) == want


# queries against SQL

def test_decontamination_query_equals_sql(spark, sf):
    from tessella.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, sf)
        rel = c.sql(sql)
        cols = sorted(rel.columns)
        assert sorted(df.columns) == cols
        assert sorted(repr(tuple(r[x] for x in cols)) for r in df.collect()) == sorted(repr(tuple(r[rel.columns.index(x)] for x in cols)) for r in rel.fetchall())
    assert xxhash.VERSION


def test_rows_that_share_an_id(spark):
    """Rows with one id and different texts are documents of their own; repeated rows are treated alike; inner names may clash."""
    rows = [(1, "a first unique line\nshared line of words"), (2, "shared line of words\nsecond unique line"), (2, "another text\nprecious unique line"), (3, "kept once\nkept once"), (3, "kept once\nkept once")]
    df = frame(spark, rows).withColumns({c: F.lit(1) for c in ("__lines", "__k0", "__k", "doc", "row", "lines", "norm", "uid")})
    got = sorted((r["doc_id"], r["text"]) for r in dedup_lines(df).collect())
    assert got == [(1, rows[0][1]), (2, "another text\nprecious unique line"), (2, "second unique line"), (3, "kept once"), (3, "kept once")]


@pytest.mark.parametrize("hot_rows", [1, 100_000])
def test_recall_of_edited_lines(spark, hot_rows):
    """One changed word or one changed letter, at every length from 5 words, among lines that share a long passage; nothing may be lost."""
    rng = random.Random(14)
    letters = lambda: "".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(2, 9)))
    passage = " ".join(letters() for _ in range(12))
    rows, twins = [], 0
    for n in (5, 6, 8, 12, 20, 33, 40, 64, 80, 150):
        for k in range(12):
            words = [letters() for _ in range(n)]
            rows.append((len(rows), " ".join(words)))
            at = rng.randrange(n)
            words[at] = letters() if k % 2 else words[at][:-1] + "zq"
            rows.append((len(rows), " ".join(words)))
            twins += 1
    many = [f"{' '.join(letters() for _ in range(20))} {passage} {' '.join(letters() for _ in range(20))}" for _ in range(120)]
    logs = [f"job {k} on host {letters()} ended with state ok after {k * 7} seconds and {k % 5} retries in the queue of batch work" for k in range(150)]
    rows += [(len(rows) + k, t) for k, t in enumerate(many + logs)]
    kept = {r["doc_id"]: r["n_kept"] for r in dedup_lines(frame(spark, rows), hot_rows=hot_rows).collect()}
    assert sum(kept[2 * k] == 1 and kept[2 * k + 1] == 0 for k in range(twins)) == twins
    assert all(kept[2 * twins + k] == 1 for k in range(len(many)))
    first = word_groups(logs)
    assert [kept[2 * twins + len(many) + k] for k in range(len(logs))] == [int(g == k) for k, g in enumerate(first)]


def classes_of(df):
    """What key_lists and candidates need to know of lines that are documents of their own."""
    one = df.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("row"), F.lit(0).alias("line"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"))
    return one.withColumn("first", F.struct("doc", "line", "row"))


def test_keys_do_not_depend_on_other_documents(spark):
    """A line's keys are the same whatever else is in the corpus: neither order nor number comes from a sample."""
    rng = random.Random(17)
    base = [rng.choice(WORDS) for _ in range(60)]
    rows = [(k, " ".join([*base[:at], "changed", *base[at + 1 :]])) for k, at in enumerate((5, 30))]
    more = [(k, " ".join([f"x{k}", *base[k % 55 : k % 55 + 5]])) for k in range(2, 2000)]

    def of(f, r):
        df = frame(spark, r)
        return {tuple(x) for x in f(df, "text", "doc_id", classes_of(df).where("false")).select("uid", "key").collect()}

    alone, among = of(line_keys, rows), of(line_keys, rows + more)
    assert len(alone) >= 20 and alone == {x for x in among if x[0] in {u for u, _ in alone}}
    lists = of(key_lists, rows)
    assert len(lists) == 2 and len({k for _, k in lists}) == 1, "lists of the same two classes are one"


def test_number_of_keys(spark):
    """As many keys as the bound asks for; beyond the table no fewer. Lines are split once."""
    some = [(e, r, k) for k in (2, 3) for e in (0, 1, 3, 7, 20, 31, 32, 90, 6000) for r in (0, 1, k * e - 1, k * e, k * e + 1, 5 * e, 159, 160, 5 * e + 40) if r >= 0]
    df = spark.createDataFrame(some, "e long, r long, k int")
    for k in (2, 3):
        for x in df.where(f"k = {k}").withColumn("many", _keys(F.col("e"), k, F.col("r"))).collect():
            least = _enough(k * x["e"], x["r"])
            if x["e"] < EDITS and x["r"] < RARE:
                assert x["many"] == least, x
            else:
                chance = lambda p: ((k * x["e"] - (p - 1) / 2) / (x["r"] - (p - 1) / 2)) ** p  # noqa: B023, E731
                assert x["many"] == k * x["e"] + 1 or x["r"] > k * x["e"] and chance(x["many"]) <= LOST, x
    df = frame(spark, [(1, "a b c d e")])
    plan = spark._jvm.PythonSQLUtils.explainString(line_keys(df, "text", "doc_id", classes_of(df).where("false"))._jdf.queryExecution(), "simple")
    assert not [x for x in plan.split("\n") if "Filter" in x and "split(" in x], "lines are split once"
    assert not [x for x in plan.split("\n") if "Generate explode" in x and "lambda" in x], "Spark can compile the step that gives keys"


def test_signs_hold_unequal_lengths(spark):
    """Lines with a common passage of 60 words: 12 more words against 20 are 20 edits, of which 16 are allowed; 12 against 12 pass."""
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([f"w{k}x{j}" for j in range(n)] + passage)) for k, n in enumerate((12, 12, 20))]
    df = frame(spark, rows)
    classes = classes_of(df).withColumn("uid", F.col("doc").cast("long"))
    _, signs = candidates(classes.select("uid"), classes, df, "text", "doc_id")
    pairs = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "a long, b long")
    assert {(r["a"], r["b"]) for r in possible(pairs, signs).collect()} == {(0, 1)}


def test_pairs_of_shared_lists_are_made_once(spark, monkeypatch):
    """Two large lists of the same classes and a small one: the join gives every pair once, those with a list's `lo` not at all."""
    from pyspark.sql.classic.dataframe import DataFrame as Classic

    rows = [(key, uid, lo, uid, 1, 20) for key, lo in ((1, 0), (2, 5)) for uid in range(20)] + [(3, uid, 30, uid, 30, 3) for uid in (30, 31, 32)]
    members = spark.createDataFrame(rows, "key long, uid long, lo long, component long, main long, size long")
    signs = spark.createDataFrame([(uid, -uid) for uid in range(33)], "uid long, h2 long")
    monkeypatch.setattr(Classic, "distinct", lambda self: self)
    made = [tuple(r) for r in unconnected(members, signs, lambda a, b: F.col(f"{a}uid") != F.col(f"{b}uid")).collect()]
    assert sorted(made) == sorted([(a, -a, b, -b) for a in range(1, 20) for b in range(a + 1, 20)] + [(31, -31, 32, -32)])


def test_lists_are_shuffled_once(spark):
    """Rows of open lists go to their list's task once, with their signs, and give the pairs of different components."""
    rng = random.Random(23)
    lists = {k: rng.sample(range(60), n) for k, n in enumerate((2, 3, 5, 17, 30, 40))}
    component = {u: u - u % 3 for u in range(0, 60, 2)}
    rows = [(k, u, max(us), len(us)) for k, us in lists.items() for u in us]
    members = signed(spark.createDataFrame(rows, "key long, uid long, lo long, size long"), spark.createDataFrame([(u, -u) for u in range(60)], "uid long, h2 long"))
    known = spark.createDataFrame(list(component.items()), "uid long, component long")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = unconnected(open_lists(members, F.broadcast(known)), None, lambda a, b: F.lit(True))
        plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple").split("\n")
        got = [(r["a"], r["ha"], r["b"], r["hb"]) for r in made.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert len([x for x in plan if "- Exchange hashpartitioning(key" in x]) == 1 and any("ReusedExchange" in x for x in plan)
    of = lambda u: component.get(u, u)
    held = {(min(u, max(us)), max(u, max(us))) for us in lists.values() for u in us}
    pairs = {(a, b) for us in lists.values() if len(us) > 2 for a in us for b in us if a < b and max(us) not in (a, b) and of(a) != of(b)}
    assert len(got) == len(set(got)) and {(a, b) for a, _, b, _ in got} - held == pairs - held and all((ha, hb) == (-a, -b) for a, ha, b, hb in got)


def test_marks_hold_every_link(spark):
    """What every class has from the start rules out no similar lines, of few and many words and with many repeats, and most others."""
    rng = random.Random(19)
    lines = []
    for n in (5, 12, 40, 90):
        for few in (3, 2000):
            base = [f"w{rng.randrange(few)}" for _ in range(n)]
            for edits in (0, 1, n // 10, n // 5, n // 4, n // 2):
                w = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(w))
                    w[at : at + rng.choice([0, 1, 1])] = [f"x{rng.randrange(few)}"] * rng.choice([1, 1, 2])
                lines.append(w)
    many = [f"w{rng.randrange(9)}" for _ in range(600)]
    last = len(lines)
    lines += [many, [*many[:300], *(f"x{k}" for k in range(60)), *many[360:]]]
    rows = marked(spark.createDataFrame(list(enumerate(lines)), "k long, w array<string>")).withColumnRenamed("words", "n")
    side = lambda p: rows.select(*[F.col(c).alias(f"{p}{c}") for c in rows.columns])
    got = {(r["ak"], r["bk"]) for r in side("a").join(side("b"), F.col("ak") < F.col("bk")).where(maybe("a", "b")).select("ak", "bk").collect()}
    near = {(a, b) for b in range(last) for a in range(b) if levenshtein(lines[a], lines[b]) <= 0.2 * max(len(lines[a]), len(lines[b])) + 1e-9} | {(last, last + 1)}
    assert len(near) > 30 and near <= got and len(got) < len(lines) * (len(lines) - 1) / 6


def test_pairs_of_long_words_are_keys(spark):
    """Lines of twelve words that share a half of shorter words only have no common key."""
    short, long_ = "alpha gamma delta theta kappa omega".split(), [[f"{c}{k}verylongword" for k in range(6)] for c in "xy"]
    rows = [(10 * k + j, " ".join(short[j:] + short[:j] + words)) for j in range(6) for k, words in enumerate(long_)]
    df = frame(spark, rows)
    uids = {r["h1"]: r["doc"] % 100 for r in classes_of(df).collect()}
    keys = {}
    for uid, key in (tuple(r) for r in line_keys(df, "text", "doc_id", classes_of(df).where("false")).collect()):
        keys.setdefault(next(d for h, d in uids.items() if h >> 8 == uid >> 8) // 10, set()).add(key)
    assert len(keys) == 2 and not keys[0] & keys[1]


def test_very_long_lines(spark):
    """Near lines of more than 32,766 words."""
    rng = random.Random(15)
    base = [f"x{rng.randrange(50_000)}" for _ in range(33_000)]
    rows = [(0, " ".join(base)), (1, " ".join([*base[:500], "changed", *base[501:]])), (2, " ".join(reversed(base)))]
    assert [r["n_kept"] for r in dedup_lines(frame(spark, rows)).orderBy("doc_id").collect()] == [1, 0, 1]


def test_shard_writers_at_once(spark, tmp_path):
    """Of writers of one version exactly one succeeds; appends at once all arrive; vacuum leaves what is not committed yet."""
    from concurrent.futures import ThreadPoolExecutor

    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(frame(spark, [(0, "first")]))

    def commit(k):
        try:
            return store.commit(base, [*base["shards"], Shard(f"data/x{k}", 1)], base["schema"])["version"]
        except CommitConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        for _ in range(10):
            base = store.manifest()
            assert sum(v is not None for v in pool.map(commit, range(8))) == 1
    store = ShardStore(spark, f"file://{tmp_path}/t")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: store.append(frame(spark, [(k, f"text {k}")])), range(8)))
    assert store.manifest()["version"] == 8 and sorted(r[0] for r in store.read().collect()) == list(range(8))
    base = store.manifest()
    pending = store._write(frame(spark, [(100, "pending")]))
    store.vacuum()
    store.commit(base, base["shards"] + pending, base["schema"])
    assert store.read().count() == 9
    left = store._write(frame(spark, [(101, "left over")]))
    store.vacuum(orphans_s=-60)
    assert not (tmp_path / "t" / left[0].path).exists() and store.read().count() == 9


def test_shard_schemas(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    store.append(frame(spark, [(1, "a")]))
    store.append(spark.createDataFrame([(2, "b", 5)], "doc_id long, text string, n int"))
    assert sorted(map(tuple, store.read().collect())) == [(1, "a", None), (2, "b", 5)]
    with pytest.raises(SchemaConflict):
        store.append(spark.createDataFrame([("x", "b")], "doc_id string, text string"))
    got = shard_members(store).orderBy("doc_id").collect()
    assert {r["version"] for r in got} == {2} and len({r["shard"] for r in got}) == 2 and all(r["shard"].endswith(".parquet") for r in got)


def test_only_documents_that_may_be_wanted_are_shuffled(spark, monkeypatch):
    """With many documents wanted, a bitmap picks them before the join, and the result is the same."""
    from tessella.llm import line_dedup

    rng, picked = random.Random(31), []
    rows = [(k, "\n".join(family(random.Random(k % 5 + j), 12, 0) + (" more" if k % 3 else "") for j in range(3)) + f"\n{family(rng, 9, 0)}") for k in range(40)]
    rows += [rows[3], (None, "a b c d e"), (77, None)]
    want = sorted(map(repr, dedup_lines(frame(spark, rows)).collect()))
    of = line_dedup.perhaps_in
    monkeypatch.setattr(line_dedup, "perhaps_in", lambda *a: picked.append(1) or of(*a))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert sorted(map(repr, dedup_lines(frame(spark, rows)).collect())) == want
    assert picked


def test_bitmap_of_wanted_rows(spark):
    from tessella.llm.line_dedup import perhaps_in

    rows = spark.range(20_000).select(F.col("id").alias("doc"), F.lit(5).cast("long").alias("row"), F.col("id").cast("int").alias("line"))
    got = {r["doc"] for r in perhaps_in(rows, rows.where("doc % 7 = 0"), ["doc", "row", "line"]).collect()}
    assert got >= set(range(0, 20_000, 7)) and len(got) < 2_900
    assert perhaps_in(rows, rows.where("false"), ["doc", "row", "line"]).count() == 0
