"""Operators on documents against brute force: mixing, decontamination, quality, repeats, near-duplicates."""

import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from wayfare.llm import _words, decontamination, minhash, mixing, quality, suffix_dedup
from wayfare.llm._scratch import Scratch
from wayfare.llm.components import components

from ._tables import DOCS, documents, table, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def folded(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


# Words


def test_hashed_words_agree_with_a_split(monkeypatch):
    monkeypatch.setattr(_words, "SLICE", 64)
    texts = ["", " ", "a", "A b\tc\n", None, "é x y", "w" * 700, "x " * 500, "end"]
    seen = {}
    for i, hashes, starts, ends in _words.hashed_words(pa.array(texts), spans=True):
        expected = folded(texts[i])
        data = (texts[i] or "").encode()
        assert [data[a:b].decode().lower() for a, b in zip(starts, ends, strict=True)] == [w.lower() for w in expected]
        for w, h in zip(expected, hashes, strict=True):
            assert seen.setdefault(w, int(h)) == int(h)
    assert len(set(seen.values())) == len(seen)


def test_shingles():
    one = np.arange(1, 9, dtype=np.uint64)
    assert len(_words.shingles(one)) == 4 and len(_words.shingles(one[:3])) == 1 and len(_words.shingles(one[:0])) == 0


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c")
    assert {r_.node: r_.comp for r_ in found.collect()} == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "c").count() == 0


def test_components_of_few_edges_take_few_jobs(spark, monkeypatch):
    from wayfare.llm import components as module

    rng = np.random.default_rng(5)
    order = rng.permutation(120).tolist()
    edges = list(zip(order, order[1:], strict=False)) + [(500, 501), (502, 501), (7, 7), (-3, 900)]
    expected = {**dict.fromkeys(range(120), 0), 500: 500, 501: 500, 502: 500, -3: -3, 900: -3}
    kept, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df, name: (kept.append(name), keep(self, df, name))[1])
    for few, most in ((16_384, 2), (60, 99), (0, 99)):  # at once; in rounds first; in rounds only
        kept.clear()
        monkeypatch.setattr(module, "FEW", few, raising=False)
        found = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()
        assert {r.node: r.comp for r in found} == expected and len(found) == len(expected)
        assert len(kept) <= most


def test_operator_gives_back_memory_of_the_one_before(spark):
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6

    Scratch(spark, "t")
    held = [bytes(1000 + i % 7) for i in range(300_000)]
    held = held[::1000]  # what stays keeps the heap from shrinking at its end
    before = resident()
    Scratch(spark, "t")
    assert resident() < before - 150


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = float(sum(sizes.values())), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if w[s] * level > most * sizes[s]]
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{k}": r.choice([0, 1, 5, 100, 3000]) for k in range(r.randint(1, 8))} | ({None: 40} if seed % 2 else {})
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expected = brute_targets(sizes)
    assert {x.source for x in rows} == set(sizes)
    for x in rows:
        assert x.target == pytest.approx(expected[x.source], abs=1e-6)


def test_mix(spark):
    r = random.Random(5)
    rows = [(i, words(r, r.randint(1, 60)), "en", f"s{i % 5}" if i % 50 else None, 1, 0.0) for i in range(1500)] + [
        (None, None, None, None, None, None), (3, "x", None, "s1", 1, 0.0), (3, "x", None, "s1", 1, 0.0)
    ]
    docs = table(spark, rows)
    found = mixing.mix_sources(docs, block=128).collect()
    again = mixing.mix_sources(docs.repartition(7), block=128).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, again), key=repr)
    assert len(found) == len(rows) and all(x.taken <= 3 * x.size and x.taken == x.copies * x.size for x in found)
    by = collections.defaultdict(list)
    for x in found:
        by[x.source].append(x)
    goal = brute_targets({s: sum(x.size for x in xs) for s, xs in by.items()})
    for s, xs in by.items():
        assert xs[0].target == pytest.approx(goal[s]) and abs(sum(x.taken for x in xs) - goal[s]) <= max(5, 0.005 * goal[s])


def test_flight_keeps_balance():
    r = np.random.default_rng(2)
    size, p = r.integers(1, 500, 400), np.full(400, 0.37)
    out = mixing.fly(p, size, 1, False)
    assert out.sum() == pytest.approx(p.sum()) and (out * size).sum() == pytest.approx((p * size).sum())
    assert ((out[: -mixing.RESERVE] > 0) & (out[: -mixing.RESERVE] < 1)).sum() <= 2
    landed = mixing.fly(p, size, 1, True)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) < 5
    rate = np.mean([mixing.fly(np.full(40, 0.3), size[:40], k, True)[0] for k in range(1500)])
    assert abs(rate - 0.3) < 0.06


def test_mix_edges(spark):
    assert mixing.mix_sources(table(spark, [])).count() == 0
    assert mixing.with_copies(table(spark, [])).columns == [*table(spark, []).columns, "copies"]
    rows = [x for x in documents()]
    kept = mixing.with_copies(table(spark, rows))
    assert kept.columns == [*(c.split()[0] for c in DOCS.split(", ")), "copies"] and 0 < kept.count() <= len(rows)


# Decontamination


def test_masks_find_all_of_two_changes():
    from itertools import combinations

    for k in range(3):
        for gone in combinations(range(decontamination.WINDOW), k):
            assert any(
                all(o + j not in gone for j, c in enumerate(m) if c == "1") for m in decontamination.MASKS for o in range(
                    decontamination.WINDOW - len(m) + 1
                )
            )


def brute_overlap(text, item):
    a, b = folded(text), folded(item)
    if len(b) < 6:
        return False
    width = min(12, len(b))
    need = 10 if width == 12 else width
    return any(
        sum(
            x == y for x, y in zip(a[i : i + width], b[j : j + width], strict=True)
        ) >= need for i in range(len(a) - width + 1) for j in range(len(b) - width + 1)
    )


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_decontamination(spark, monkeypatch, bound):
    """By a broadcast table, and by a join of seeds."""
    monkeypatch.setattr(decontamination, "SEEDS", bound)
    r = random.Random(8)
    items = [(k, words(r, n)) for k, n in enumerate((30, 14, 12, 8, 4, 40))] + [(90, None), (None, words(r, 20))]
    rows = [(i, words(r, r.randint(0, 60)), None, None, None, None) for i in range(30)]
    for k, (_, item) in enumerate(items):
        if item:
            for changes in range(4):
                w = item.upper().split() if changes == 1 else item.split()
                for at in r.sample(range(len(w)), min(changes, len(w))):
                    w[at] = "other"
                rows.append((100 + 10 * k + changes, words(r, 9) + " " + " ".join(w) + " " + words(r, 9), None, None, None, None))
    rows += [x for x in documents() if x[0] is None or x[0] > 50]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontamination.overlaps(table(spark, rows), benchmark).collect()}
    expected = {(x[0], k) for x in rows for k, item in items if item and brute_overlap(x[1], item)}
    assert found == expected and len(found) > 10
    kept = decontamination.keep_uncontaminated(table(spark, rows), benchmark)
    assert sorted(x.doc_id or -1 for x in kept.collect()) == sorted(
        x[0] or -1 for x in rows if not any(item and brute_overlap(x[1], item) for _, item in items)
    )
    assert decontamination.overlaps(table(spark, []), benchmark).count() == 0
    assert decontamination.overlaps(table(spark), benchmark.where("false")).count() == 0


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_decontamination_of_short_items(spark, monkeypatch, bound):
    """Items below a window overlap with all but one word equal (6 to 11 words) or all words (1 to 5)."""
    monkeypatch.setattr(decontamination, "SEEDS", bound)
    r = random.Random(12)
    items = [(n, words(r, n, "klmnopqrst")) for n in range(1, 15)]
    rows = []
    for n, item in items:
        for changes in range(4):
            for k in range(n):
                w = item.split()
                for at in [k, *r.sample(range(n), n)][: min(changes, n)]:
                    w[at] = "other"
                rows.append((len(rows), " ".join([words(r, k % 4), *w, words(r, (k + n) % 3)]), None, None, None, None))

    def overlap(text, item):
        a, b = folded(text), folded(item)
        width = min(12, len(b))
        need = math.ceil(10 * width / 12)
        return any(
            sum(
                x == y for x, y in zip(a[i : i + width], b[j : j + width], strict=True)
            ) >= need for i in range(len(a) - width + 1) for j in range(len(b) - width + 1)
        )

    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in decontamination.overlaps(table(spark, rows), benchmark, short=True).collect()}
    expected = {(x[0], k) for x in rows for k, item in items if overlap(x[1], item)}
    assert found == expected and {k for _, k in found} == set(range(1, 15))
    kept = decontamination.keep_uncontaminated(table(spark, rows), benchmark, short=True)
    assert {x.doc_id for x in kept.collect()} == {x[0] for x in rows} - {i for i, _ in expected}


def test_table_and_join_give_the_same_rows(spark, monkeypatch):
    """Whole rows, with repeated documents, null ids, and an item that half of the documents hold."""
    r = random.Random(9)
    items = [(k, words(r, r.randint(3, 40))) for k in range(9)] + [(None, words(r, 20)), (3, words(r, 15))]
    rows = [(i, words(r, 20) + " " + (items[8][1] if i % 2 else items[i % 11][1]) + " " + words(r, 10), None, None, None, None) for i in range(60)]
    rows += [rows[1], rows[1], (None, items[4][1], None, None, None, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def found():
        return collections.Counter(map(tuple, decontamination.overlaps(table(spark, rows), benchmark, short=True).collect()))

    by_table = found()
    monkeypatch.setattr(decontamination, "SEEDS", 0)
    assert by_table == found() and sum(by_table.values()) >= 60


# Quality


def base(text):
    w, lines = WORD.findall(text or ""), [x for x in (text or "").split("\n") if WORD.search(x)]
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(
        c in "#*$%&|<>" for c in text or ""
    ), len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)


def test_base_features(spark):
    rows = documents() + [
        (2000, "a b c a b c\na b c a b c\n\n  \nx", None, None, None, None), (2001, "##|| <b> $%& \U0001f600\U0001f600 é", None, None, None, None)
    ]
    found = quality.apply_rules(table(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    got = collections.Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in found)
    assert got == collections.Counter((x[0], *base(x[1])) for x in rows)
    assert all(x.kept == (not x.base_failed) for x in found)  # no labels: the base rule only


def test_binomial_tail(spark):
    cases = [(100, 0, 0.05), (100, 2, 0.05), (5000, 20, 0.01), (200_000, 1800, 0.01), (50, 10, 0.05)]
    for n, k, p in cases:
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(k).cast("long"), p)).first()[0]
        terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p) for j in range(k + 1)]
        exact = 1.0 if k >= n * p else sum(map(math.exp, terms))
        assert got == pytest.approx(exact, rel=1e-6)


def judged(n=3000, seed=3):
    """Documents of two languages, a tenth of them bad (symbols in most words), two in three labelled."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = i % 10 > 0
        text = " ".join(f"w{r.randint(0, 10**6)}" + ("" if good or r.random() < 0.1 else "$$") for _ in range(60))
        if r.random() < 0.2:
            text += "\nsame line\nsame line"
        rows.append((i, text, "en" if i // 10 % 2 else "de", None, None, None))
        if i % 3:
            labels.append((i, int(good), 0))
    rows += [(n + k, rows[k][1], None, None, None, None) for k in range(40)]
    return rows, labels + [(n + k, 1, 0) for k in range(40)] + [(5, None, None), (None, 1, 0), (7, 0, 0)]


def test_thresholds_hold_the_risk(spark):
    rows, labels = judged()
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    cuts = quality.thresholds(quality.base_features(docs), marks).collect()
    # 40 good labels can pass no test, so the null language takes no share of DELTA.
    rules = {x.rule for x in cuts}
    assert {x.stratum for x in cuts} == {"en", "de"} and "symbols_per_word" in rules and rules <= {"symbols_per_word", "long_words"}
    assert all(x.tail <= quality.DELTA / 2 for x in cuts)
    found = {x.doc_id: x.kept for x in quality.apply_rules(docs, marks).collect()}
    lost = sum(not found[i] for i in range(3000) if i % 10) / 2700
    assert lost <= quality.ALPHA and sum(not found[i] for i in range(0, 3000, 10)) > 250
    assert quality.apply_rules(table(spark, []), marks).count() == 0


def test_certified_union_against_brute_force(spark):
    """Path and tests, written out: the union of the rules so far, and the labels that may choose the path."""
    rows, labels = judged(900, 5)
    truth = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            truth[i] = max(q, truth.get(i, 0))
    docs, marks = table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    features = quality.base_features(docs)
    patterns = quality._patterns(features, marks)
    certified = {}
    for x in quality.tests(patterns, quality.path(patterns)).collect():
        certified.setdefault(x.stratum, []).append(x)
    values = quality._rule_values()
    held = features.where("not base_failed").select("doc_id", "stratum", *[v.alias(k) for k, v in values.items()]).collect()
    assert certified
    for stratum, steps in certified.items():
        steps.sort(key=lambda x: x.step)
        good = [x for x in held if x.stratum == stratum and truth.get(x.doc_id) == 1]
        others = [x for x in held if x.stratum == stratum and truth.get(x.doc_id) != 1]
        so_far, ok = [], True
        for x in steps:
            so_far.append((x.rule, quality.CUTOFFS[x.rule][x.pos]))
            assert x.n_good == len(good) and x.n_rejected == sum(any(d[r] >= c for r, c in so_far) for d in good)
            bad, none = (sum(d[x.rule] >= so_far[-1][1] for d in others if (d.doc_id in truth) == marked) for marked in (True, False))
            n_bad, n_none = (sum((d.doc_id in truth) == marked for d in others) for marked in (True, False))
            assert bad > 0 and bad * n_none >= quality.ENRICH * none * n_bad
            ok = ok and x.tail <= quality.DELTA / len(certified)
            assert x.certified == ok


def test_quality_sql_with_certified_cutoffs(spark):
    import duckdb

    from wayfare.llm.oracle import oracles

    rows, labels = judged(1500, 9)
    docs, marks = table(spark, rows + documents()[:0]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = quality.apply_rules(docs, marks).withColumn("rejected_by", F.concat_ws(",", "rejected_by")).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", marks.toPandas().astype({"doc_id": "Int64", "quality": "Int64"}))
    wanted = con.sql(oracles()["op3_quality_rules"]).df()
    assert (found.rejected_by != "").sum() > 50
    columns = sorted(found.columns)
    assert sorted(map(tuple, found[columns].values.tolist())) == sorted(map(tuple, wanted[columns].values.tolist()))


# Repeats


def brute_repeats(rows):
    last = 1 << 63
    data = sorted(((x[0] if x[0] is not None else last, (x[1] or "").encode()) for x in rows), key=lambda x: x[0])
    first = {}
    for i, t in data:
        for k in range(len(t) - 49):
            first.setdefault(t[k : k + 50], i)
    out = collections.Counter()
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out[
            (None if i == last else i, len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
        ] += 1
    return out


def repeats(spark, rows):
    return collections.Counter(tuple(x)[:5] for x in suffix_dedup.repeated_bytes(table(spark, rows)).collect())


@pytest.mark.parametrize("chunk", [8 << 20, 20_000])
def test_repeats(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "BUCKET", chunk)
    assert repeats(spark, documents()) == brute_repeats(documents())


def test_repeats_in_small_pieces(spark):
    """Texts of few letters, with repeats of every kind."""
    r = random.Random(11)
    parts = ["".join(r.choice("ab \n") for _ in range(r.randint(20, 130))) for _ in range(12)]
    rows = [(i // 2 if i > 50 else i, "".join(r.choice(parts) for _ in range(r.randint(0, 6))), None, None, None, None) for i in range(70)]
    assert repeats(spark, rows) == brute_repeats(rows)


def test_index_parts():
    r = random.Random(2)
    base = ["".join(r.choice("abc") for _ in range(80)) for _ in range(6)]
    texts = [t[a : a + r.randint(50, 80)].encode() for t in base for a in range(0, 30, 3)]
    ids = np.array([r.randint(0, 20) for _ in texts])
    sizes = np.array([len(t) for t in texts])
    runs = zip(*suffix_dedup.least_holders(np.frombuffer(b"".join(texts), np.uint8), sizes, ids), strict=True)
    found = {(int(s), k): i for s, lo, hi, i in runs for k in range(lo, hi + 1)}
    least = {}
    for t, i in zip(texts, ids, strict=True):
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(least.get(t[k : k + 50], 99), i)
    assert found == {(s, k): least[t[k : k + 50]] for s, t in enumerate(texts) for k in range(len(t) - 49)}
    index = suffix_dedup.RunLengthIndex(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    assert len(index.runs) < len(index.text) / 2  # repetitive: few runs
    body = index.text.tobytes()
    rows = sorted(range(len(body)), key=lambda i: body[i:])
    assert rows == index.rows.tolist()
    for j in range(1, len(rows)):
        a, b = body[rows[j - 1] :], body[rows[j] :]
        common = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert index.match[rows[j]] == common


def test_hot_anchor(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", 2)
    r = random.Random(6)
    line = words(r, 12)
    rows = [(i, words(r, 15) + " " + line + " " + words(r, 15), None, None, None, None) for i in range(30)]
    rows += [(50 + i, rows[i][1][20:150], None, None, None, None) for i in range(10)]
    assert repeats(spark, rows) == brute_repeats(rows)


def test_every_span_comes_from_the_index(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup.RunLengthIndex, "smallest", lambda self, owner, length=50: np.full(len(self.rows), suffix_dedup.LAST))
    rows = [(i, "x" * 60 + " " + words(random.Random(1), 30), None, None, None, None) for i in range(4)]
    table_ = pa.table({"chunk": [0] * 4, "doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})
    sent = suffix_dedup._send(0)(table_)
    answers = suffix_dedup._judge(sent)
    marked = suffix_dedup._mark(0)(table_, answers)
    assert marked.num_rows
    parts = [suffix_dedup._index(marked.filter(pa.compute.equal(marked.column("key"), k))) for k in set(marked.column("key").to_pylist())]
    answers = pa.concat_tables(parts)
    assert answers.num_rows and not any(suffix_dedup._spans(answers, np.arange(4)))


def test_equal_hashes_of_different_bytes():
    """Classes are told apart by their bytes, not by their hashes."""
    flat = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60, np.uint8)
    at, size, one = np.array([0, 60, 120]), np.full(3, 60), np.ones(3, np.uint64)
    cls, head = suffix_dedup._same(flat, at, size, one, one)
    assert cls[0] == cls[2] != cls[1] and len(head) == 2


def test_repeated_rows_are_dealt_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 10_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET", 10_000)
    same = words(random.Random(5), 60)
    rows = [(7, same, None, None, None, None)] * 200 + [(8, same, None, None, None, None)] * 3
    texts, _ = suffix_dedup._chunked(table(spark, rows).select("doc_id", "text"), Scratch(spark, "test"))
    assert texts.groupBy("chunk").count().agg(F.max("count")).first()[0] < 100
    assert repeats(spark, rows) == brute_repeats(rows)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("wayfare_texts")]


def test_remove_repeats(spark):
    kept = suffix_dedup.remove_repeats(table(spark))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    plain = {x[0]: x[1] for x in documents()}
    for x in kept.collect():
        if x.doc_id is not None and x.doc_id < 40:
            assert x.text == plain[x.doc_id]
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0 and suffix_dedup.repeated_bytes(table(spark, [])).count() == 0


# Near-duplicates


def brute_near(rows):
    sets = [(x[0], frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) if (w := folded(x[1])) else frozenset()) for x in rows]
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = collections.Counter()
    for i, (d, s) in enumerate(sets):
        c = least.get(find(i)) if s else d
        out[(d, len(s), c, d == c)] += 1
    return out


def near(spark, rows):
    return collections.Counter(tuple(x) for x in minhash.near_duplicates(table(spark, rows)).collect())


def test_near_duplicates(spark):
    assert near(spark, documents()) == brute_near(documents())


@pytest.mark.parametrize("block", [16, 512])
def test_large_groups_of_near_copies(spark, monkeypatch, block):
    """Variants whose likeness lies on both sides of the threshold, through lists of pairs and through blocks."""
    r = random.Random(4)
    base_ = words(r, 60).split()
    rows = []
    for i in range(70):
        w = list(base_)
        for at in r.sample(range(60), r.choice([0, 1, 1, 2, 2, 3])):
            w[at] = f"v{i}x{at}"
        rows.append((i, " ".join(w), None, None, None, None))
    expected = brute_near(rows)
    assert near(spark, rows) == expected
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", block)
    assert near(spark, rows) == expected


@pytest.mark.parametrize("block", [8, 512])
def test_blocks_lose_no_link(spark, monkeypatch, block):
    """Links come from the blocks alone: one bucket holds all nodes, and none is linked before."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    r = random.Random(14)
    rows, k = [], 0
    for _ in range(12):
        base_ = words(r, 40).split()
        for _ in range(5):
            w = list(base_)
            for at in r.sample(range(40), r.choice([1, 1, 2])):
                w[at] = f"v{k}x{at}"
            rows.append((k, " ".join(w), None, None, None, None))
            k += 1
    many = spark.createDataFrame([(x[0], -1, x[0]) for x in rows], "node long, pivot long, comp long")
    texts = spark.createDataFrame([(x[0], x[1]) for x in rows], "node long, text string")
    links = minhash._between_blocks(many, texts, Scratch(spark, "t"))
    comp = {x.node: x.comp for x in components(links, Scratch(spark, "t"), "t").collect()}
    wanted = {k[0]: k[2] for k in brute_near(rows)}
    assert {x: comp.get(x, x) for x in wanted} == wanted and links.count() < len(rows) * 4


def test_rows_without_ids(spark):
    r = random.Random(3)
    rows = [(None, words(r, 30), None, None, None, None) for _ in range(200)]
    rows += [rows[0]] * 50 + [(4, rows[1][1], None, None, None, None)]
    assert near(spark, rows) == brute_near(rows)


def test_sets_whose_digests_meet(spark, monkeypatch):
    """Sets that share the first half of their digest, but not the second, stay apart."""
    monkeypatch.setattr(minhash, "digest", lambda found: b"\0" * 8 + hashlib.blake2b(found.tobytes(), digest_size=8).digest())
    rows = [x for x in documents(3) if x[1] and len(x[1]) < 2000]
    batch = pa.RecordBatch.from_pydict({"doc_id": [x[0] for x in rows], "text_hash": list(range(len(rows))), "text": [x[1] for x in rows]})
    sigs = spark.createDataFrame(pa.Table.from_batches(minhash._signatures([batch])))
    out, nodes = minhash._nodes(sigs, Scratch(spark, "t"))
    sets = {frozenset(tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))) for x in rows if (w := folded(x[1]))}
    assert nodes.count() == nodes.select("node").distinct().count() == len(sets)


def test_keep_first(spark):
    kept = minhash.keep_first(table(spark)).collect()
    ids = [x.doc_id for x in kept]
    expected = {k[0] for k in brute_near(documents()) if k[3]}
    assert set(ids) - {None} == expected - {None} and len(ids) == len(set(ids))
    assert minhash.keep_first(table(spark, [])).count() == 0


def test_signature_estimates_likeness():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3000], r.integers(0, 1 << 63, 1000, dtype=np.uint64)])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 0.6) < 0.15


# Columns of the input that have names of our own


def clashing(spark):
    """The table with further columns, called as the operators call theirs."""
    names = """size copies taken_id taken_copies node bands check comp bucket near_text near_id text_hash first_id first_text chunk c0 c1 data key
      block p number n row rows shard ids words times stratum quality base_failed s w cuts at term toxic held_out word item seed shift length x h id""".split()
    df = table(spark)
    return df.withColumns({c: F.lit(k) for k, c in enumerate(names)}), ["doc_id", "text", "lang", "source", "n_chars", "score"]


def test_columns_with_our_names(spark):
    more, plain = clashing(spark)
    marks = spark.createDataFrame(
        [(i, i % 2, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean"
    ).withColumn("toxic", F.col("toxic").cast("int"))
    marks = marks.withColumns({c: F.lit(1) for c in ("text", "id", "n", "stratum")})
    benchmark = spark.createDataFrame([(1, documents()[3][1] or "a b c", 1, 2)], "item_id long, text string, item long, words long")
    from wayfare.llm import scoring, toxicity

    index = toxicity.train(table(spark), marks)
    operators = {
        "mix": mixing.mix_sources, "near": minhash.near_duplicates, "repeats": suffix_dedup.repeated_bytes, "scores": scoring.score_documents,
        "quality": lambda d: quality.apply_rules(d, marks), "overlaps": lambda d: decontamination.overlaps(d, benchmark), "toxicity": lambda d: toxicity.score_documents(d, index),
    }
    for name, run in operators.items():
        got, wanted = (collections.Counter(map(str, run(d).collect())) for d in (more, more.select(*plain)))
        assert got == wanted, name
    stages = {
        "near": minhash.keep_first, "repeats": suffix_dedup.remove_repeats, "overlaps": lambda d: decontamination.keep_uncontaminated(d, benchmark),
        "toxicity": lambda d: toxicity.keep_clean(d, index), "mix": mixing.with_copies,
    }
    for name, run in stages.items():
        out = run(more)
        assert [c for c in out.columns if c != "copies"] == [c for c in more.columns if c != "copies"], name
        got, wanted = (collections.Counter(map(str, d.select("doc_id", "text", "lang").collect())) for d in (out, run(more.select(*plain))))
        assert got == wanted, name
        assert out.select("node").distinct().count() == 1 and out.count()
