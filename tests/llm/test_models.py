"""Operators on pages, conversations and labels, and language-model scores: round trips, brute force, held-out accuracy."""

import base64
import collections
import hashlib
import html
import math
import os
import random
import re
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.llm import chat, extraction, scoring, toxicity, warc
from wayfare.llm._scratch import Scratch

from ._tables import documents, table, words

# Chat


TURNS = "conv_id long, turn long, role string, text string"


def conversations(seed=2):
    r = random.Random(seed)
    rows = []
    for c in range(25):
        if r.random() < 0.5:
            rows.append((c, 0, "system", words(r, 5)))
        for t in range(1, r.randint(1, 14)):
            text = words(r, r.choice([0, 3, 40, 150]))
            if r.random() < 0.4:
                text += r.choice(["</s>", "\\[INST]", "\n</s>\n", "x\\", "[/ROLE]\n[ROLE]\n", "<<SYS>>\\\\</s>", "\\\\"])
            rows.append((c, t, r.choice(["user", "assistant", "assistant", "tool", None, "[TEXT]", "system"]), None if r.random() < 0.05 else text))
    rows += [
        (900, 1, "assistant", words(r, 1200)), (900, 2, "assistant", "b"), (900, 2, "assistant", "a"),
        (900, None, "user", "first"), (None, 1, "assistant", "lone"), rows[5], rows[5]
    ]
    return rows


def digests(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        out[c] = (
            len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for _, _, a, b in turns).encode()).hexdigest(), len(said),
            hashlib.sha256(said.encode()).hexdigest()
        )
    return out


@pytest.mark.parametrize(("budget", "history"), [(384, 96), (60, 30), (5, 0)])
def test_chat_round_trip(spark, budget, history):
    rows = conversations()
    windows = chat.format_chats(spark.createDataFrame(rows, TURNS), budget, history)
    found = chat.read_back(windows).collect()
    assert {x.conv_id: (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) for x in found} == digests(rows) and len(found) == len(digests(rows))


def test_windows_are_read_wherever_they_lie(spark):
    r = random.Random(2)
    turns = spark.createDataFrame([(c, t, "user" if t % 2 == 0 else "assistant", words(r, 40)) for c in (*range(20), None) for t in range(12)], TURNS)
    windows = chat.format_chats(turns, budget=120, history=2)
    read = [sorted(map(str, chat.read_back(w).collect())) for w in (windows, windows.repartition(5), windows.orderBy(F.desc("window")))]
    assert len(read[0]) == 21 and read[0] == read[1] == read[2]


def test_windows_keep_the_budget(spark):
    rows = conversations()
    found = chat.format_chats(spark.createDataFrame(rows, TURNS), 200, 50).collect()
    first_role = {c: min((t is not None, t or 0, r or "") for k, t, r, _ in rows if k == c)[2] for c in {x[0] for x in rows}}
    for x in found:
        turns = chat.read_turns(x.text)
        assert x.tokens <= 200 or len(turns) - x.repeated == 1
        if x.window and first_role[x.conv_id] == "system":
            assert turns[0][0] == "system" and x.repeated >= 1
        assert all(any(a == s and b == e and role == "assistant" for role, _, s, e in turns[x.repeated :]) for a, b in x.loss)
    assert any(x.repeated > 1 for x in found)


def test_escaping():
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice([*chat.MARKS, "\\", "\n", "a", "<", "[", "s>"]) for _ in range(r.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text
        assert [
            x[:2] for x in chat.read_turns(chat.turn_text("user", text)[0] + chat.turn_text("tool" + text, text)[0])
        ] == [("user", text), ("tool" + text, text)]
    assert chat.format_chats.__defaults__[0] == chat.BUDGET


def test_chat_empty(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], TURNS))).count() == 0


# WARC


PAGES = "page_id long, url string, html string, digest string"


def pages(seed=3):
    r = random.Random(seed)
    rows = [(i, f"http://{r.choice('abc')}.example.org:8{i % 3}/p{i % 30}?q=\n é", "<p>" + words(r, r.randint(0, 30)), "x") for i in range(90)]
    rows += [(200 + i, "https://u@x.org/a#f", rows[i % 5][2], None) for i in range(30)]
    return rows + [
        (300, None, None, None), (301, "", "", None), (302, "no url", "é" * 3000, None), rows[7], rows[7],
        (None, "http://n.org/", rows[3][2], None), (None, "http://n.org/", "only here", None)
    ]


@pytest.mark.parametrize("least,groups", [(0, 50_000), (50, 50_000), (0, 0)])
def test_warc_round_trip(spark, least, groups, monkeypatch):
    """With groups broadcast, and joined by a shuffle."""
    monkeypatch.setattr(warc, "BROADCAST_GROUPS", groups)
    monkeypatch.setattr(warc, "ARCHIVE", 2000)
    monkeypatch.setattr(warc, "RANGE", 20)
    monkeypatch.setattr(warc, "BLOCK", 6)
    rows = pages()
    firsts = {}
    for i, _, h, _ in rows:
        if i is not None:
            firsts[h or ""] = min(firsts.get(h or "", i), i)
    expected = collections.Counter()
    for i, _, h, _ in rows:
        data, first = (h or "").encode(), firsts.get(h or "")
        again = len(data) >= least and first is not None and first != i
        expected[
            (
                i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response",
                first if again else None, None if again else (h or "")
            )
        ] += 1
    found = warc.archive_and_read(spark.createDataFrame(rows, PAGES), least).collect()
    assert collections.Counter((x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to, x.payload) for x in found) == expected


def test_records_are_valid(spark):
    """Every member of every archive read one after another, by the rules of WARC/1.1, without the index."""
    import glob

    scratch = Scratch(spark, "t")
    root = scratch.path("archives")
    n = scratch.keep(warc.write_archives(spark.createDataFrame(pages(), PAGES), root, archive=3000), "lines").count()
    ids, kinds, uris = set(), collections.Counter(), set()
    for path in glob.glob(f"{root}/*.warc.gz"):
        data = open(path, "rb").read()
        k = 0
        while data:
            packer = zlib.decompressobj(31)
            raw = packer.decompress(data)
            data = packer.unused_data
            head, _, rest = raw.partition(b"\r\n\r\n")
            first, *lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) for x in lines)
            assert first == "WARC/1.1" and len(fields) == len(lines)
            block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
            assert end == b"\r\n\r\n" and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"])
            assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"]) and fields["WARC-Record-ID"] not in ids
            ids.add(fields["WARC-Record-ID"])
            kinds[fields["WARC-Type"]] += 1
            assert (k == 0) == (fields["WARC-Type"] == "warcinfo")
            if fields["WARC-Type"] != "warcinfo":
                assert fields["WARC-Block-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
                http, _, payload = block.partition(b"\r\n\r\n")
                assert http.startswith(b"HTTP/1.1 200 OK\r\n") and " " not in fields["WARC-Target-URI"]
                uris.add(fields["WARC-Target-URI"])
            if fields["WARC-Type"] == "revisit":
                assert payload == b"" and fields["WARC-Profile"].endswith("identical-payload-digest") and fields[
                    "WARC-Refers-To-Date"
                ] == fields["WARC-Date"]
                assert fields["WARC-Refers-To-Target-URI"]
            k += 1
    assert kinds["response"] + kinds["revisit"] == n and kinds["revisit"] > 10


def test_index_is_sorted_and_sparse(spark):
    scratch = Scratch(spark, "t")
    lines = scratch.keep(warc.write_archives(spark.createDataFrame(pages(), PAGES), scratch.path("archives"), archive=3000), "lines")
    index = warc.CaptureIndex(lines, scratch.path("archives"), range_lines=25)
    blocks = index.blocks.orderBy("first_key", "first_id").collect()
    read = [tuple(x.split("\t")[:2]) for b in blocks for x in zlib.decompress(bytes(b.data)).decode().split("\n")]
    assert len(read) == len(pages()) and [(k, int(i)) for k, i in read] == sorted((k, int(i)) for k, i in read)
    assert index.ranges > 3 and len(index.upper) <= index.ranges
    nobody = spark.createDataFrame([(1, "http://nobody.org/")], "page_id long, url string")
    assert index.locate(nobody).count() == 0


def test_urls_with_raw_spaces_are_found(spark):
    """A raw space sorts before a percent sign, its encoded form does not: neighbours that change places."""
    urls = ["http://e.org/?q=a b", "http://e.org/?q=a%20a", "http://e.org/?q=a\tc", "http://e.org/?q=a!"]
    found = warc.archive_and_read(spark.createDataFrame([(i, u, f"page {i}", None) for i, u in enumerate(urls)], PAGES)).collect()
    assert sorted((x.page_id, x.payload) for x in found) == [(i, f"page {i}") for i in range(len(urls))]


def test_url_keys():
    assert warc.url_key("http://www.A.org:80/x?y#z") == "org,a,www:80)/x?y"
    assert warc.url_key("https://u:p@b.net") == "net,b)/" and warc.url_key(None) == "" and warc.url_key(" x ") == "x"


def test_warc_empty(spark):
    assert warc.archive_and_read(spark.createDataFrame([], PAGES)).count() == 0


# HTML


def test_extraction_on_unseen_layouts():
    r, right = random.Random(77), 0
    for _ in range(150):
        source = extraction.invented_page(r)
        page = extraction.Page(source)
        mark = [0] * len(page.tag)
        for i in range(len(mark)):
            mark[i] = int(page.mark[i]) if page.mark[i] is not None else (mark[page.parent[i]] if i else 0)
        right += extraction.main_texts([source], extraction.model())[0] == page.text(np.array(mark, bool))
    assert right >= 135


def test_extraction_of_an_article():
    source = """<!DOCTYPE html><html><head><title>T | site</title><style>p{}</style></head><body><header><h1>Site</h1><nav><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></nav></header>
      <div class="cookie-notice">We use cookies. <button>OK</button></div><article><h1>Fish &amp; chips&#8212;now</h1><p>First   <b>bold</b>,\n text.<br>Second line. <p>Unclosed one <i>two</i>
      <script>var a = "</p>";</script><!-- gone --><div class="ad">Buy now, it is cheap.</div><p>Last words of it, with a <a href=/y>link</a> inside.</p></article>
      <aside class="sidebar"><h3>Related</h3><ul><li><a href=/1>One thing</a></ul></aside><section id="comments"><p>Nice, said someone.</p></section><form><label>Name</label><input></form><footer>&copy; Site</footer></body></html>"""
    assert extraction.main_texts(
        [source], extraction.model()
    )[0] == "Fish & chips—now First bold, text. Second line. Unclosed one two Last words of it, with a link inside."


def test_extraction_stands_anything(spark):
    r = random.Random(5)
    odd = [
        None, "", "   ", "plain text, no tags", "<", "<<<p>", "<p", "</div></div>", "<a href='x\">y", "<!-- never closed",
        "<script>never", "<p>" * 3000, "<div>" * 800 + "x" + "</div>" * 800, "&#0;&bogus;&#99999999;",
        "<article>" + "<p>Some plain words of prose, one after another.</p>" * 20_000 + "</article>", "<title>t"
    ]
    odd += [
        "".join(
            r.choice(
                ["<p>", "</p>", "<div class=ad>", "</div>", "<li>", "<table>", "</td>", "text ", "&amp;", "<br/>", "<a>", "</a>", "'", '"', "<b", ">"]
            ) for _ in range(60)
        ) for _ in range(60)
    ]
    rows = [(i, None if i % 7 == 0 else f"u{i}", h, "t") for i, h in enumerate(odd)] + [(0, "again", odd[3], "t"), (None, None, odd[3], "t")]
    found = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(found) == len(rows) and all(x.n_chars == len(x.text) for x in found)
    by = {x.page_id: x for x in found}
    assert by[1].text == "" and by[14].n_chars == len("Some plain words of prose, one after another. " * 20_000) - 1
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "wrap",
    [
        "<div class='post-body'>%s</div>", "<main>%s</main>", "<div id=content><div>%s</div></div>", "<table><tr><td>%s</table>",
        "<section class=story>%s</section>"
    ]
)
def test_pages_without_article(wrap):
    """Layouts that the training generator does not write."""
    r = random.Random(4)
    sources, wanted = [], []
    for _ in range(20):
        paras = [words(r, r.randint(25, 70)).capitalize() + "." for _ in range(r.randint(3, 8))]
        nav = "<nav><ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(r.randint(4, 12))) + "</ul></nav>"
        body = wrap % "".join(f"<p>{x}</p>" for x in paras)
        side = "<aside class=widget><p>Buy our stuff now</p></aside><footer><p>Copyright 2020 x</p></footer>"
        sources.append(f"<html><head><title>t</title></head><body><header><h2>Site</h2></header>{nav}{body}{side}</body></html>")
        wanted.append(" ".join(paras))
    assert extraction.main_texts(sources, extraction.model()) == wanted


@pytest.mark.parametrize("tag", ["button", "object", "canvas", "svg", "select", "head", "noscript", "iframe", "title", "textarea"])
def test_unclosed_silent_elements_keep_the_page(tag):
    text = "A long sentence of the article, with words enough. " * 12
    (found,) = extraction.main_texts([f"<html><body><{tag}>x<article><p>{text}</p></article></body></html>"], extraction.model())
    assert text.strip() in found


@pytest.mark.parametrize("part", ["<div>|</section>", "<i>|</b>", "<button>|", "<noscript>|", "<a|", "<td>|<tr>", "<p><i>|<div></p>", "<svg>|<svg></svg>"])
def test_hostile_pages_take_linear_time(part):
    import time

    first, second = part.split("|")
    took = []
    for n in (4000, 32_000):
        began = time.process_time()
        extraction.Page(first * n + second * n)
        took.append(time.process_time() - began)
    assert took[1] < 24 * max(took[0], 0.02)


def test_decoding_is_consistent():
    r = np.random.default_rng(4)
    for seed in range(40):
        page = extraction.Page(extraction.invented_page(random.Random(seed)))
        _, length = page.features()
        margin = r.normal(0, 3, len(page.tag))
        keep = page.decode(margin, length)
        assert keep.dtype == bool and len(keep) == len(page.tag)
        main = page.decode(np.full(len(page.tag), 9.0), length)
        assert main.all() or not length.all()


# Toxicity


def marked(n=900, seed=6):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        w = words(r, r.randint(5, 60)).split()
        if bad:
            for _ in range(r.randint(1, 4)):
                w.insert(r.randint(0, len(w)), r.choice(["Nastyword", "vilethings", "vilefolk,", "awfulness."]))
        rows.append((i, " ".join(w), "en", "s", 1, 0.1))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = marked()
    docs = table(
        spark, rows + [(5000, None, None, None, None, None), (5001, "", None, None, None, None), (None, "Nastyword here", None, None, None, None)]
    )
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (4, 1, 0)], "doc_id long, quality int, toxic int")
    found = toxicity.score_documents(docs, toxicity.train(docs, marks)).collect()
    truth = {i: y for i, _, y in labels}
    held = [x for x in found if x.doc_id in truth and zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    assert held and all(x.held_out for x in held) and sum(x.held_out for x in found if x.doc_id in truth) == len(held)
    assert sum(x.predicted == truth[x.doc_id] for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in found) and len(found) == len(rows) + 3
    assert [x.predicted for x in found if x.doc_id in (5000, 5001)] == [0, 0] and next(x for x in found if x.doc_id is None).predicted == 1
    kept = toxicity.keep_clean(docs, toxicity.train(docs, marks))
    assert kept.columns == docs.columns and kept.count() == sum(1 - x.predicted for x in found)


def labelled(n=600, seed=3):
    """(doc_id, toxic, counts) of random texts: frequent and rare words, some that toxic texts have more often."""
    r = np.random.default_rng(seed)
    out = []
    for d in range(n):
        toxic = int(r.random() < 0.25)
        picked = np.minimum(r.zipf(1.3, r.integers(0, 60)), 900).tolist() + r.integers(2000, 2010, 3 * toxic).tolist()
        out.append((d, toxic, dict(collections.Counter(f"w{k}" for k in picked))))
    return out + [(n, 1, out[0][2]), (n + 1, 0, out[0][2])]


def brute_weights(examples):
    """Terms of two or more examples with idf times the association factor, written out term by term."""
    n1 = sum(y for _, y, _ in examples)
    n0, out = len(examples) - n1, {}
    for term in {t for _, _, c in examples for t in c}:
        a, b = (sum(term in c for _, y, c in examples if y == side) for side in (1, 0))
        if a + b >= 2:
            g = 0.0
            for seen, among in ((a, n1), (b, n0)):
                for k, rate in ((seen, (a + b) / (n1 + n0)), (among - seen, 1 - (a + b) / (n1 + n0))):
                    g += 2 * k * math.log(k / (among * rate)) if k else 0.0
            out[term] = (math.log((1 + n1 + n0) / (1 + a + b)) + 1) * (math.sqrt(max(g, 0.0)) + toxicity.FLOOR)
    return out


def brute_vector(counts, weights):
    found = {t: (1 + math.log(n)) * weights[t] for t, n in counts.items() if t in weights}
    length = math.sqrt(sum(x * x for x in found.values()))
    return {t: x / length for t, x in found.items()}


@pytest.mark.parametrize("frequent", [0, 16])
def test_scores_against_brute_force(monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    monkeypatch.setattr(toxicity, "LANE", 16)
    examples, fold = labelled(), [(d + 5000, y, c) for d, y, c in labelled(200, 4)]
    words_, number = [], {}

    def coded(rows):
        out = []
        for d, y, c in rows:
            for w in c:
                if w not in number:
                    number[w] = len(words_)
                    words_.append(w)
            out.append((d, y, np.array([number[w] for w in c], np.int64), np.array(list(c.values()), np.int64)))
        return out

    examples_, fold_ = coded(examples), coded(fold)
    index = toxicity.Index(words_, examples_, fold_)

    def vector(counts):
        return index.query(" ".join(w for w, n in counts.items() for _ in range(n)), {})

    weights = brute_weights(examples)
    assert set(index.terms) == set(weights) and all(abs(index.scale[i] - weights[t]) < 1e-9 for t, i in index.terms.items())
    vectors = {d: (brute_vector(c, weights), y) for d, y, c in examples}

    def nearest(counts, apart=False):
        q = brute_vector(counts, weights)
        found = [(round(sum(x * v.get(t, 0.0) for t, x in q.items()), 10), y) for v, y in vectors.values()]
        return sorted(((c, y) for c, y in found if c > 0 and not (apart and c > 1 - 1e-9)), reverse=True)[: toxicity.NEIGHBOURS]

    def votes(found):
        """The votes that equal cosines at the end allow."""
        last = found[-1][0] if found else 0
        sure = [(c, y) for c, y in found if c > last + 1e-9]
        return sum(c * c * y for c, y in sure), sum(c * c for c, _ in found), last * last * (len(found) - len(sure))

    visited = 0
    for _, _, counts in labelled(150, 8):
        query = vector(counts)
        if query is None:
            assert not brute_vector(counts, weights)
            continue
        best, scores, blocks = next(index.nearest([query]))
        visited += blocks < index.blocks
        wanted = nearest(counts)
        assert np.allclose(scores, [c for c, _ in wanted], atol=2e-10)
        low, whole, open_ = votes(wanted)
        if wanted:
            assert low / whole - 1e-6 <= index.vote(best, scores) <= (low + open_) / whole + 1e-6
    assert visited  # bounds do exclude blocks
    # Calibration: rates rise, and the pools hold the mean of the fold's labels.
    assert (np.diff(index.rates) >= 0).all() and (np.diff(index.votes) > 0).all()
    text = " ".join(t for t, n in examples[3][2].items() for _ in range(n))
    assert index.query(text + " ?! unknownword", {})[1].tolist() == vector(examples[3][2])[1].tolist()


def test_bounds_of_the_examples(spark):
    rows, labels = marked(300)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert len(toxicity.train(table(spark, rows), marks, examples=40).ids) <= 40
    assert len(toxicity.train(table(spark, rows), marks, postings=500).ids) < len(toxicity.train(table(spark, rows), marks).ids)
    assert toxicity.train(table(spark, rows), marks, postings=1).score(["a b"], {})[0][0] < 0.5


def test_toxicity_without_labels(spark):
    docs = table(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = toxicity.score_documents(docs, toxicity.train(docs, none)).collect()
    assert len(found) == len(documents()) and all(x.predicted == 0 for x in found)
    assert toxicity.score_documents(table(spark, []), toxicity.train(docs, none)).count() == 0


# Language model


def test_pseudo_likelihood_learns_both_sides(spark):
    """In texts of a fixed cycle, neighbours tell each word; shuffled words of the same texts score lower."""
    r = random.Random(7)
    cycle = [f"w{k}" for k in range(12)]
    rows = [(i, " ".join(cycle[(i + k) % 12] for k in range(200)), None, None, None, None) for i in range(300)]
    mixed = [(1000 + i, " ".join(r.sample(rows[i][1].split(), 200)), None, None, None, None) for i in range(20)]
    docs = table(
        spark,
        rows + mixed + [(5000, None, None, None, None, None), (5001, "", None, None, None, None), (5002, "w1", None, None, None, None), rows[0]]
    )
    found = {x.doc_id: x for x in scoring.score_documents(docs).collect()}
    assert len(found) == 323 and found[5000].n_tokens == 0 and found[5000].pseudo_log_likelihood == 0 and found[5000].mean_log_probability is None
    assert found[0].n_tokens == 200 and found[0].pseudo_log_likelihood == pytest.approx(200 * found[0].mean_log_probability)
    ordered, shuffled = np.mean([found[i].mean_log_probability for i in range(300)]), np.mean(
        [found[1000 + i].mean_log_probability for i in range(20)]
    )
    assert ordered > shuffled + 0.5 and ordered > -2.2


def test_every_word_trains_once(spark, monkeypatch):
    """The rounds together train on all words of the corpus, copies included, whatever its size and its texts' lengths."""
    monkeypatch.setattr(scoring, "SHARD", 5000)
    rows = documents()
    scratch = Scratch(spark, "t")
    words_, counts, mass = scoring.vocabulary(table(spark, rows), scratch)
    scoring.train(scoring.tokens(table(spark, rows), words_, counts), mass, scratch)
    parts = [spark.read.parquet(scratch.path(f"round{k}-0")).where("part = 0").collect() for k in range(scoring.ROUNDS)]
    assert len(parts[0]) > 3
    seen = [sum(x.n for x in p) for p in parts]
    assert sum(seen) == sum(len((x[1] or "").split()) for x in rows) and min(seen) > 0.4 * sum(seen)


def test_scores_do_not_depend_on_the_split(spark, monkeypatch):
    monkeypatch.setattr(scoring, "SHARD", 5000)
    docs = table(spark, documents())

    def scores(df):
        return sorted((str(x.doc_id), x.n_tokens, x.pseudo_log_likelihood) for x in scoring.score_documents(df).collect())

    assert scores(docs.coalesce(1)) == scores(docs.repartition(7, "n_chars"))


EXACT = """
import hashlib, sys
import numpy as np
sys.path.insert(0, sys.argv[1])
from wayfare.llm import scoring
r = np.random.default_rng(11)
net = scoring.Network(r.standard_normal(scoring.Network.SIZE).astype(np.float32)).on_grid()
line = r.integers(0, scoring.PAD, 3000)
context = np.stack([np.roll(line, -k) for k in scoring.PLACES], axis=1)
for block in (1, 7, 512, 3000):
    parts = [net.log_probability(context[i : i + block], line[i : i + block]) for i in range(0, len(line), block)]
    print(hashlib.sha256(np.concatenate(parts).tobytes()).hexdigest())
turned = net.log_probability(context[::-1], line[::-1])[::-1]
print(hashlib.sha256(np.ascontiguousarray(turned).tobytes()).hexdigest())
"""


def test_scores_are_the_same_in_any_block_and_by_any_kernel():
    flags = open("/proc/cpuinfo").read()
    kinds = ["Sandybridge", *(["Haswell", "Zen"] if " avx2 " in flags else []), *(["SkylakeX"] if " avx512f " in flags else [])]
    top, seen = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), set()
    for kind in kinds:
        run = subprocess.run([sys.executable, "-c", EXACT, top], env=os.environ | {"OPENBLAS_CORETYPE": kind}, capture_output=True, text=True, check=True)
        seen |= set(run.stdout.split())
    assert len(seen) == 1


@pytest.mark.parametrize("known", [1_000_000, 50])
def test_scores_against_written_out_network(spark, monkeypatch, known):
    """Ids, the network and the shares of words, one word at a time; counts by broadcast, and by a join."""
    monkeypatch.setattr(scoring, "KNOWN", known)
    own = " ".join(f"top{k} top{k} top{k} top{k} top{k} top{k} top{k}" for k in range(scoring.WORDS))
    rare = [f"r{k}" for k in range(2 * scoring.BUCKETS) for _ in range(1 + k % 3)]
    rows = [(1, own, None, None, None, None), (2, " ".join(rare), None, None, None, None)]
    texts = ["top1 r5 top2", "top1 r4 top2", "top1 never top2", "r3 r3 r3 r7", "r5", "TOP1 R5 top2"]
    rows += [(10 + i, t, None, None, None, None) for i, t in enumerate(texts)] + [(None, None, None, None, None, None)]
    docs = table(spark, rows)
    scratch = Scratch(spark, "t")
    words_, counts, mass = scoring.vocabulary(docs, scratch)
    tokens = scoring.tokens(docs, words_, counts)
    net = scoring.train(tokens, mass, scratch)
    found = {x.doc_id: x for x in scoring.score(tokens, net, counts, mass, scratch).collect()}
    assert len(found) == len(rows) and found[None].n_tokens == 0
    everything = collections.Counter(w for r in rows for w in (r[1] or "").lower().split())
    hashed = {}
    for w in everything:
        ((_, h),) = list(scoring.hashed_words(__import__("pyarrow").array([w])))
        hashed[w] = int(words_.ids(h)[0])
    for i, text in enumerate(texts):
        line = text.lower().split()
        ids = [scoring.PAD, scoring.PAD, *[hashed[w] for w in line], scoring.PAD, scoring.PAD]
        expected = 0.0
        for k, w in enumerate(line):
            h = net.hidden.astype(float).copy()
            for j, shift in enumerate(scoring.PLACES):
                h += net.embed[j * (scoring.PAD + 1) + ids[k + 2 + shift]]
            h = np.tanh(h)
            c, m = divmod(ids[k + 2], scoring.MEMBERS)
            for scores, at in ((h @ net.classes + net.class_bias, c), (h @ net.members[c] + net.member_bias[c], m)):
                expected += scores[at] - np.log(np.exp(scores).sum())
            assert (ids[k + 2] >= scoring.WORDS) == (not w.startswith("top"))
            if not w.startswith("top"):
                others = everything[w] - line.count(w)
                expected += np.log(others if others else 1 / scoring.UNSEEN) - np.log(mass[ids[k + 2]] + 1)
        assert found[10 + i].pseudo_log_likelihood == pytest.approx(expected, abs=1e-3) and found[10 + i].n_tokens == len(line)
    assert found[10].pseudo_log_likelihood == found[15].pseudo_log_likelihood


def test_held_out_text_gets_likelier(spark):
    """Training lowers the perplexity of texts that it has not seen."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text")
    seen, rest = rows.where("doc_id % 5 <> 0"), rows.where("doc_id % 5 = 0")
    scratch = Scratch(spark, "t")
    words_, counts, mass = scoring.vocabulary(seen, scratch)
    net = scoring.train(scoring.tokens(seen, words_, counts), mass, scratch)
    held = scoring.tokens(rest, words_, counts)
    mean = [
        scoring.score(held, n, counts, mass, scratch).agg(F.sum("pseudo_log_likelihood") / F.sum("n_tokens")).first()[0] for n in (
            scoring.Network.start(mass), net
        )
    ]
    assert mean[1] > mean[0] + 0.2


def test_probabilities_sum_to_one():
    net = scoring.Network.start(np.arange(scoring.PAD, dtype=float))
    context = np.tile([[5, 9, 100, scoring.PAD]], (scoring.PAD, 1))
    assert np.exp(net.log_probability(context, np.arange(scoring.PAD))).sum() == pytest.approx(1, abs=1e-3)


def test_gradient_lowers_the_loss():
    r = np.random.default_rng(1)
    net = scoring.Network.start(np.ones(scoring.PAD))
    context, target = r.integers(0, 50, (512, 4)), r.integers(0, 50, 512)
    target = context[:, 1] + 1
    before = net.log_probability(context, target).mean()
    for _ in range(60):
        net.step(context, target, scoring.RATE)
    assert net.log_probability(context, target).mean() > before + 1


def _plain_step(net, context, target, rate):
    """A step of the network, class by class."""
    def softmax(x):
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    order = np.argsort(target, kind="stable")
    context, target = context[order].astype(np.int64), target[order].astype(np.int64)
    rows, used = np.arange(len(target)), context + np.arange(4) * (scoring.PAD + 1)
    h, cls = np.tanh(net.embed[used].sum(1) + net.hidden), target // scoring.MEMBERS
    p = softmax(h @ net.classes + net.class_bias)
    p[rows, cls] -= 1
    back = p @ net.classes.T
    for c in np.unique(cls):
        here = np.flatnonzero(cls == c)
        here = slice(here[0], here[-1] + 1)
        q = softmax(h[here] @ net.members[c] + net.member_bias[c])
        q[rows[: len(q)], target[here] % scoring.MEMBERS] -= 1
        back[here] += q @ net.members[c].T
        each = np.float32(rate / np.sqrt(len(q)))
        net.members[c] -= each * (h[here].T @ q)
        net.member_bias[c] -= each * q.sum(0)
    whole = np.float32(rate / np.sqrt(len(rows)))
    net.classes -= whole * (h.T @ p)
    net.class_bias -= whole * p.sum(0)
    back *= 1 - h * h
    net.hidden -= whole * back.sum(0)
    flat = used.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.diff(flat[order], prepend=-1))
    times = np.diff(np.append(first, len(flat)))
    moved = np.add.reduceat(back[order // 4], first)
    net.embed[flat[order][first]] -= moved * (np.float32(rate) / np.sqrt(times).astype(np.float32))[:, None]


def _plain_logs(net, context, target):
    """Logarithms of probabilities by a network on the grid, all words' scores at once."""
    def log_sum(x):
        top = x.max(1)
        return top + np.log(np.exp(x - top[:, None]).sum(1))

    context, target = context.astype(np.int64), target.astype(np.int64)
    h, rows = np.tanh(net.embed[context + np.arange(4) * (scoring.PAD + 1)].sum(1) + net.hidden), np.arange(len(target))
    h, cls = np.rint(h.astype(float) * scoring.GRID) / scoring.GRID, target // scoring.MEMBERS
    first, second = (h @ net.classes + net.class_bias).astype(np.float32), np.empty((len(target), scoring.MEMBERS), np.float32)
    for c in np.unique(cls):
        second[cls == c] = h[cls == c] @ net.members[c] + net.member_bias[c]
    return first[rows, cls] - log_sum(first) + second[rows, target % scoring.MEMBERS] - log_sum(second)


def _steps(words, seed, size=scoring.BATCH):
    """Contexts and targets with few frequent ids, as in texts; two in five words have shared ids."""
    rng = np.random.default_rng(seed)
    p = 1 / (np.arange(scoring.WORDS) + 2.7)
    p = np.concatenate([0.6 * p / p.sum(), np.full(scoring.BUCKETS, 0.4 / scoring.BUCKETS)])
    line = rng.choice(scoring.PAD, words + 4, p=p / p.sum()).astype(np.uint16)
    at = rng.permutation(np.arange(2, words + 2))
    return [(scoring._context(line, at[i : i + size]), line[at[i : i + size]]) for i in range(0, words, size)]


@pytest.mark.parametrize(("words", "scale"), [(1, 1), (9, 1), (5000, 1), (3000, 300)])
def test_network_step_is_that_of_each_class(words, scale):
    net = scoring.Network.start(np.arange(scoring.PAD, dtype=float))
    net.members *= scale  # at 300, scores too far from zero for plain powers
    plain = scoring.Network(net.flat.copy())
    for context, target in _steps(words, words):
        net.step(context, target, scoring.RATE)
        _plain_step(plain, context, target, scoring.RATE)
    assert np.isfinite(net.flat).all()
    assert np.abs(net.flat - plain.flat).max() < (1e-4 if scale == 1 else 2e-2)


@pytest.mark.parametrize("scale", [1, 10, 300])
def test_scores_are_those_of_whole_blocks(scale):
    net = scoring.Network.start(np.arange(scoring.PAD, dtype=float))
    net.members *= scale
    net = net.on_grid()
    for words in (1, 700, 9000):
        for context, target in _steps(words, words, 8192):
            assert np.abs(net.log_probability(context, target) - _plain_logs(net, context, target)).max() < 2e-5 * scale


def test_training_and_scoring_take_less_time_than_class_by_class():
    import time

    net = scoring.Network.start(np.ones(scoring.PAD))
    on_grid = net.on_grid()
    kinds = {
        "step": (_steps(20 * scoring.BATCH, 1), lambda *a: net.step(*a, scoring.RATE)),
        "plain step": (_steps(20 * scoring.BATCH, 1), lambda *a: _plain_step(net, *a, scoring.RATE)),
        "score": (_steps(65536, 1, 32768), on_grid.log_probability), "plain score": (_steps(65536, 1, 32768), lambda *a: _plain_logs(on_grid, *a))
    }
    best = dict.fromkeys(kinds, 1e9)
    for _ in range(7):
        for kind, (steps, run) in kinds.items():
            began = time.thread_time()
            for context, target in steps:
                run(context, target)
            best[kind] = min(best[kind], time.thread_time() - began)
    assert best["step"] < 0.5 * best["plain step"] and best["score"] < 0.65 * best["plain score"], best


def test_texts_stand_apart_in_a_line():
    texts = [np.arange(5), np.zeros(0, np.int64), np.arange(3000) % 700]
    column = __import__("pyarrow").array([t.astype(np.uint16).tobytes() for t in texts])
    for some in (column, column.slice(1)):
        line, at, n = scoring.padded(some)
        own = texts if some is column else texts[1:]
        assert n.tolist() == [len(t) for t in own] and np.array_equal(line[at], np.concatenate(own))
        where = 0
        for t in own:
            full = np.concatenate([[scoring.PAD] * 2, t, [scoring.PAD] * 2])
            for k in range(len(t)):
                assert np.array_equal(scoring._context(line, at[where : where + 1])[0], full[[k, k + 1, k + 3, k + 4]])
                where += 1


def test_lm_on_odd_tables(spark):
    assert len(scoring.score_documents(table(spark)).collect()) == len(documents())
    assert scoring.score_documents(table(spark, [])).count() == 0
    only = [(1, None, None, None, None, None), (2, "", None, None, None, None)]
    assert [x.n_tokens for x in scoring.score_documents(table(spark, only)).collect()] == [0, 0]


# All of it


def test_pages_text_matches_tags(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {x.page_id: x.text for x in extraction.extract(rows).collect()}
    for x in rows.collect():
        inner = re.search(r"<article>(.*?)</article>", x.html or "", re.S)
        if inner:
            plain = re.sub(r"<[^>]*>", "", re.sub(r"<(/?(p|h1|br|ul|li|div|h2))\b[^>]*>", " ", inner[1]))
            assert found[x.page_id] == " ".join(html.unescape(plain).split())


def test_registered_queries_and_stages():
    import corpus_pipeline
    from wayfare.llm import queries

    numbers = sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.queries())
    assert numbers == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "suffix_dedup", "decontamination", "mixing"]


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    rows, labels = marked(300)
    r = random.Random(1)
    rows = rows[:300] + [(2000, rows[1][1], "en", "s", 1, 0.1), (2001, words(r, 40), "en", "s2", 1, 0.1)]
    item = words(r, 25)
    rows.append((2002, words(r, 30) + " " + item + " " + words(r, 30), "en", "s2", 1, 0.1))
    passage = words(r, 30)
    rows += [(2003 + k, words(r, 100) + " " + passage + " " + words(r, 100), "en", "s3", 1, 0.1) for k in range(3)]
    table(spark, rows).drop("score").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, sf = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    scratch, seen = Scratch(spark, "t"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "mixing":
            assert out.columns == docs.columns
        docs = scratch.keep(out, name)
        seen[name] = {x.doc_id: x.text for x in docs.collect()}
    assert not any(i % 6 == 0 for i in seen["toxicity"] if i < 300) and 2002 in seen["toxicity"]
    assert 2000 in seen["toxicity"] and 2000 not in seen["near_duplicates"] and 1 in seen["near_duplicates"]
    assert passage in seen["suffix_dedup"][2003] and not any(passage in seen["suffix_dedup"][2003 + k] for k in (1, 2))
    assert 2002 in seen["suffix_dedup"] and 2002 not in seen["decontamination"] and 2001 in seen["decontamination"]
    assert docs.where(F.col("copies") <= 0).count() == 0 and set(seen["mixing"]) <= set(seen["decontamination"])


def brute_pipeline(rows, marks, items, index):
    """Each stage of the pipeline, written out over lists; rows (doc_id, text, lang, source, n_chars), ids distinct."""
    from .test_documents import brute_near, folded

    rows = [x for x in rows if index.score([x[1]], {})[0][0] < 0.5]
    kept = {k[0] for k in brute_near([(*x, None) for x in rows]) if k[3]}
    rows = sorted((x for x in rows if x[0] in kept), key=lambda x: x[0])
    first = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        for k in range(len(data) - 49):
            first.setdefault(data[k : k + 50], i)
    out = []
    for i, text, *rest in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 49):
            if first[data[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        if any(gone):
            text = bytes(c for c, g in zip(data, gone, strict=True) if not g).decode("utf-8", "ignore")
            if not text:
                continue
        out.append((i, text, *rest[:-1], None if text is None else len(text)))

    def overlap(text, item):
        a, b = folded(text), folded(item)
        width = min(12, len(b))
        need = -(-10 * width // 12)
        pairs = ((a[i : i + width], b[j : j + width]) for i in range(len(a) - width + 1) for j in range(len(b) - width + 1))
        return width and any(sum(x == y for x, y in zip(p, q, strict=True)) >= need for p, q in pairs)

    return [x for x in out if not any(overlap(x[1], item) for item in items)]


def test_run_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    from wayfare.llm import mixing

    rows, labels = marked(260)
    r = random.Random(21)
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t, *_ in rows]
    passage, items = words(r, 40), [words(r, 25), words(r, 8)]
    for k in range(6):
        rows.append((1000 + k, words(r, 30) + " " + passage + " " + words(r, 30), "en", "s1", 1))
        rows.append((1100 + k, rows[5 + k][1], "en", "s2", 1))
        near = rows[40 + k][1].split()
        near[len(near) // 2] = "other"
        rows.append((1200 + k, " ".join(near), "en", "s0", 1))
    rows += [
        (1300, words(r, 20) + " " + items[0] + " end", "en", "s1", 1), (1301, "x " + items[1], "en", "s1", 1),
        (1302, None, None, None, None), (1303, "", "de", "s1", 0), (1304, passage, "en", "s1", 1)
    ]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "documents.parquet"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    index = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), marks)
    left = brute_pipeline(rows, labels, items, index)
    assert len(left) < len(rows) - 40 and {1304, 1300, 1301} & {x[0] for x in left} == set()
    wanted = mixing.with_copies(spark.createDataFrame(left, kinds).repartition(3)).collect()
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter(map(str, found)) == collections.Counter(map(str, wanted)) and found
    taken = collections.Counter()
    for x in found:
        taken[x.source] += x.copies * len((x.text or "").split())
    sizes = collections.Counter()
    for x in left:
        sizes[x[3]] += len((x[1] or "").split())
    goal = {x.source: x.target for x in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert all(abs(taken[k] - goal[k]) <= 0.02 * goal[k] + 2 for k in goal)


def test_registered_queries_cover_their_tables(spark):
    """Every query of this subpackage over the smallest tables: whole tables, distinct ids, the columns of the contract."""
    from wayfare.llm import queries

    sf = "/root/testdata/sf0.001"
    n = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("documents", "pages")}
    n["conversations"] = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1
    expected = {
        "op1": ("documents", "doc_id size source_size target taken"), "op3": (
            "documents", "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept"
        ),
        "op4": ("documents", "doc_id n_bytes n_removed n_spans kept_sha256"), "op5": (
            "conversations", "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars"
        ),
        "op6": ("documents", "doc_id pseudo_log_likelihood"), "op7": ("pages", "page_id payload_bytes payload_digest record_type refers_to"), "op8": (
            "pages", "page_id url text n_chars"
        ),
        "op9": ("documents", "doc_id held_out score predicted"), "op10": ("documents", "doc_id n_shingles component_id kept"),
        "op11": ("documents", "doc_id fingerprint component_id"),
    }
    for name, run in queries.queries().items():
        if name.split("_")[0] in expected:
            source, columns = expected[name.split("_")[0]]
            found = run(spark, sf)
            assert set(columns.split()) <= set(found.columns), name
            key = columns.split()[0]
            assert found.count() == found.select(key).distinct().count() == n[source], name
