"""SimHash, ranked search and the filter audit against plain versions."""

import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from wayfare.llm import audit, lexical, oracle, simhash
from wayfare.llm._scratch import Scratch
from wayfare.llm.components import components

from ._tables import DOCS, documents, table, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Columns with names that the operators use themselves.
CLASHES = ["node", "anchor", "part", "visits", "least", "comp", "shard", "term", "ids", "weight", "rank", "score", "word", "k1", "k2", "digest", "first", "good"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASHES})


# SimHash


def plain_fingerprint(text):
    found = WORD.findall(lower(text))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """The number of the first of each group of linked fingerprints."""
    group = list(range(len(prints)))
    for i, j in itertools.combinations(range(len(prints)), 2):
        if ((prints[i] ^ prints[j]) % (1 << 64)).bit_count() <= 3 and group[i] != group[j]:
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_fingerprints(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    for text in [None, "", " \n", "One", "two\x0bWORDS", "a b c", "É é A z", "x " * 50, words(random.Random(4), 300), "y" * 400]:
        assert simhash.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_every_half_has_one_home():
    leaders, next_ones = simhash.cosets()
    assert len(set(leaders.tolist())) == 1 << 11 and sum(map(len, next_ones)) == math.comb(23, 4)
    r = random.Random(2)
    for word in (r.getrandbits(23) for _ in range(50)):
        home = lambda w: w ^ int(leaders[int(simhash.syndrome(np.array([w]))[0])])
        assert simhash.syndrome(np.array([home(word)]))[0] == 0 and (home(word) ^ word).bit_count() <= 3
        s = int(simhash.syndrome(np.array([word]))[0])
        assert {home(word), *(word ^ int(v) for v in next_ones[s])} == {home(word), *(home(word ^ 1 << b) for b in range(23))}


def hostile_prints(r):
    """Random fingerprints, chains and balls of near ones, and some at the very limit."""
    base = [r.getrandbits(64) for _ in range(60)]
    prints = list(base)
    for x in base[:25]:
        for k in (1, 2, 3, 3, 4, 4):
            prints.append(x ^ sum(1 << b for b in r.sample(range(64), k)))
    centre = r.getrandbits(64)
    prints += [centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 3))) for _ in range(250)]
    return [x - (1 << 64) if x >> 63 else x for x in dict.fromkeys(prints)]


@pytest.mark.parametrize("held", [3, 16_384])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, held):
    monkeypatch.setattr(simhash, "HELD", held)
    prints = sorted(hostile_prints(random.Random(held)))
    nodes = spark.createDataFrame([(x,) for x in prints], "node long").repartition(3)
    found = simhash.links(nodes, Scratch(spark, "t"))
    rows = found.collect()
    assert len(rows) < 40 * len(prints)  # the ball alone has some 31,000 pairs, which meet at several anchors
    assert all((a ^ b) != 0 for a, b in rows)
    comp = {r.node: r.comp for r in components(found, Scratch(spark, "t"), "c").collect()}
    assert [comp.get(x, x) for x in prints] == [prints[g] for g in plain_groups(prints)]


def test_home_unites_groups():
    home = simhash.Home(np.array([0b1111, 0b11110000, 1 << 40], np.int64))
    a, b = home.links(np.array([0b0111 | 0b10000, 1 << 41, 0b111 | 0b1110000], np.int64))
    edges = {frozenset(e) for e in zip(np.concatenate(a).tolist(), np.concatenate(b).tolist(), strict=True)}
    assert edges == {frozenset((0b10111, 0b1111)), frozenset((1 << 41, 1 << 40))}
    a, b = home.links(np.array([0b11001100], np.int64))
    assert sum(map(len, a)) == 0 or home.group[0] == home.group[1]


def test_simhash(spark):
    rows = documents(5)
    found = simhash.near_duplicates(clashing(table(spark, rows))).collect()
    prints = [plain_fingerprint(r[1]) for r in rows]
    group = plain_groups(prints)
    least = [min((rows[j][0] for j, h in enumerate(group) if h == g and rows[j][0] is not None), default=None) for g in group]
    expected = collections.Counter((r[0], f"{p:016x}", m) for r, p, m in zip(rows, prints, least, strict=True))
    assert collections.Counter(map(tuple, found)) == expected
    assert simhash.near_duplicates(table(spark, [])).collect() == []


# Ranked search


def plain_search(docs, items, k=20):
    texts = [(i, TERM.findall(lower(t))) for i, t in docs]
    df = collections.Counter(t for _, w in texts for t in set(w))
    n, total = sum(1 for _, w in texts if w), sum(len(w) for _, w in texts)
    asked = collections.defaultdict(collections.Counter)
    for item, text in items:
        asked[item].update(TERM.findall(lower(text)))
    out = []
    for item, wanted in asked.items():
        scored = []
        for doc, w in texts:
            tf = collections.Counter(w)
            m = 75 + 25 * len(w) * n // max(total, 1)
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t, c in wanted.items() if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, doc) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


def test_terms_and_packed_integers():
    texts = ["", "A-b c", None, "É9_x\x00y", "end", "z" * 300]
    found, n = lexical.terms(pa.array([t or "" for t in texts]))
    assert found.to_pylist() == [t for x in texts for t in TERM.findall(lower(x))] and n.tolist() == [0, 3, 0, 3, 1, 1]
    found, n = lexical.terms(pa.array(["xx", "a b", "c"])[1:])
    assert found.to_pylist() == ["a", "b", "c"] and n.tolist() == [2, 1]
    values = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**40 + 5, 2**62], np.int64)
    data, ends = lexical.packed(values)
    assert lexical.unpacked(data).tolist() == values.tolist() and ends[-1] == len(data) and ends[2] == 3
    assert len(lexical.packed(values[:0])[0]) == 0 and len(lexical.unpacked(np.zeros(0, np.uint8))) == 0


def test_bounded_heap_prefers_small_ids():
    best = lexical.Best(2)
    for score, doc in ((5, 9), (5, 3), (5, 4), (5, None), (7, 100)):
        best.offer(score, doc)
    assert sorted(best.heap) == [(5, -3), (7, -100)] and best.least == 5


@pytest.mark.parametrize("window", [2, 256])
def test_bounds_change_no_rank(monkeypatch, window):
    monkeypatch.setattr(lexical, "WINDOW", window)
    r = np.random.default_rng(window)
    for _ in range(20):
        n = 400
        lists = []
        for share, high in ((0.9, 4), (0.5, 9), (0.1, 200), (0.02, 3000), (0.6, 1)):
            at = np.flatnonzero(r.random(n) < share)
            gain = r.integers(0, high, len(at))
            lists.append(lexical.Postings(at, gain, int(gain.max(initial=0))))
        total = np.zeros(n, np.int64)
        for p in lists:
            total[p.at] += p.gain
        ids = r.permutation(n).tolist()
        best = lexical.Best(7)
        lexical.rank(lists, ids, best)
        expected = sorted(((int(s), -ids[i]) for i, s in enumerate(total) if s > 0), reverse=True)[:7]
        assert sorted(best.heap, reverse=True) == expected


@pytest.mark.parametrize("queries", [3, 1000])
def test_search(spark, monkeypatch, queries):
    monkeypatch.setattr(lexical, "QUERIES", queries)
    rows = documents(6)
    r = random.Random(8)
    known = [x[1] for x in rows if x[1]]
    items = [(i, " ".join(r.sample(r.choice(known).split(), 1)) + " " + " ".join(r.choice(known).split()[:6])) for i in range(12)]
    items += [(3, "two words"), (50, None), (51, ""), (52, "unheard-of"), (None, "one ONE two"), (7, items[7][1])]
    asked = clashing(spark.createDataFrame(items, "item_id long, text string"))
    found = lexical.search(clashing(table(spark, rows)).repartition(3), asked).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, plain_search([x[:2] for x in rows], items)))
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(table(spark, []), asked).collect() == [] and lexical.search(table(spark), none).collect() == []


def test_shards_in_small_pieces(spark):
    """More than one shard in a task; the heaps go on from one to the next."""
    rows = [(i, " ".join(random.Random(i).choices("abcdefg", k=2000)), "en", "s", 0, 0.0) for i in range(40)]
    batches = pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows])], ["doc_id", "text"])
    whole, parts = list(lexical._shard([batches], 0)), list(lexical._shard([batches.slice(0, 15)], 0)) + list(lexical._shard([batches.slice(15)], 1))
    assert sum(b.num_rows for b in parts) > sum(b.num_rows for b in whole) == 8
    held = whole[1].column("term").to_pylist()
    assert sorted(held) == sorted("abcdefg") and whole[1].column("df").to_pylist() == [40] * 7


# Filter audit


def plain_audit(docs, labels):
    seen = collections.defaultdict(list)
    for i, t, _ in docs:
        seen[t or ""].append(i)
    good, toxic = ({i for i, q, x in labels if i is not None and (q, x)[k] == 1} for k in (0, 1))
    kept = collections.defaultdict(list)
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and any(j is not None and j < i for j in seen[t])
        }
        kept[lang or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = []
    for part, rows in kept.items():
        removed = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                removed[c] += sum(1 for f, _, _ in rows if c in f and not f & set(order[:k]))
        for order in itertools.permutations("ABCDE"):
            for k, c in enumerate(order):
                before = set(order[:k])
                here = [x for x in rows if c in x[0] and not x[0] & before]
                out.append(
                    (part, "".join(order), k + 1, sum(1 for x in rows if not x[0] & (before | {c})), len(here), sum(1 for x in rows if c in x[0] and x[0] & before),
                     sum(1 for x in rows if x[0] == {c}), sum(x[1] for x in here), sum(x[2] for x in here), removed[c])
                )
    return out


def audited_tables(spark):
    rows = documents(7)
    r = random.Random(9)
    rows += [(2000 + k, words(r, 300) + r.choice(["", " $", " " + "LOUD " * 30, " again" * 400]), r.choice(["en", None]), "s", 0, 0.0) for k in range(30)]
    rows += [(3000 + k, rows[-1 - k][1], "en", "s", 0, 0.0) for k in range(5)]
    rows += [(2010, None, "xx", "s", 0, 0.0)]  # a doc_id of two texts
    labels = [(x[0], k % 2, (k // 2) % 2) for k, x in enumerate(rows) if k % 5] + [(2001, 1, 0), (2001, 0, 1), (None, 1, 1), (9999, 1, 1), (2002, None, None)]
    return rows, labels


def test_audit(spark):
    rows, labels = audited_tables(spark)
    docs, marks = clashing(table(spark, rows)).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = audit.audit(docs, clashing(marks))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, found.select(names).collect())) == sorted(plain_audit([x[:3] for x in rows], labels))
    assert audit.audit(table(spark, []), marks).collect() == []
    assert audit.audit(table(spark), marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_sql_of_search_and_audit(spark):
    """The SQL of both queries on tables with nulls, repeats and ties."""
    rows, labels = audited_tables(spark)
    db = duckdb.connect()
    documents_, labels_ = table(spark, rows).toPandas(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").toPandas()
    benchmark_ = spark.createDataFrame([(1, rows[0][1] or "same"), (2, "Same two"), (3, None)], "item_id long, text string").toPandas()
    for name, df in (("documents", documents_), ("labels", labels_), ("benchmark", benchmark_)):
        db.register(f"{name}_df", df)
        ids = ", ".join(f"CAST({c} AS BIGINT) AS {c}" if c.endswith("_id") else c for c in df.columns)
        db.sql(f"CREATE TABLE {name} AS SELECT {ids} FROM {name}_df")
    found = audit.audit(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    sql = db.sql(oracle.AUDIT).df()
    assert sorted(map(tuple, found.select(list(sql.columns)).collect())) == sorted(map(tuple, sql.itertuples(index=False)))
    ranked = lexical.search(table(spark, rows), spark.createDataFrame([(1, rows[0][1] or "same"), (2, "Same two"), (3, None)], "item_id long, text string"))
    scores = [(x.item_id, x["rank"], x.score) for x in ranked.collect()]
    assert sorted(scores) == sorted((int(a), int(b), int(c)) for a, b, c in db.sql(f"SELECT item_id, rank, score FROM ({oracle.SEARCH})").fetchall())


def test_orders_of_one_document(spark):
    """A document that fails two filters is removed by whichever comes first, 60 times each of 120."""
    docs = spark.createDataFrame([(1, "$ few words", "en", "s", 0, 0.0)], DOCS)
    rows = audit.audit(docs, spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(rows) == 600 and {r.shapley for r in rows if r.filter_order[r.step - 1] in "AD"} == {60} and sum(r.good_lost for r in rows) == 120
