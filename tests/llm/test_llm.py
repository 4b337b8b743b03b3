"""Brute force, round trips, held-out accuracy and odd rows for the training-data operators."""

import base64
import collections
import gzip
import hashlib
import io
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from worksift.llm import common, op1_minhash, op2_warc, op3_secrets, op4_decontaminate, op5_line_dedup, op6_quality, op7_toxicity, op8_chat, op9_packing, op10_sharding

ODD = [(1, None, "en"), (2, "", None), (3, " \n\t ", "xx"), (None, "a b c", "en"), (4, "one", "en"), (5, "same text here " * 30, "en"), (6, "same text here " * 30, "en"), (6, "same text here " * 30, "en"), (7, "x " * 60_000, "fr")]
ODD_SCHEMA = "doc_id long, text string, lang string, `rank` string, n long, words string, doc string, ord string, tree string"


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "r", 1, "w", "d", "o", "t") for r in ODD], ODD_SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, repeated lines and passages; one source text has a third of the rows."""
    rng = random.Random(5)
    docs = [" ".join(words(rng, rng.randint(1, 120), 3000)) for _ in range(60)]
    docs += [docs[0]] * 40
    for k in range(30):
        base = docs[k % 6].split()
        for _ in range(rng.randint(1, 4)):
            base[rng.randrange(len(base))] = f"new{rng.randrange(9)}"
        docs.append(" ".join(base))
    return list(enumerate(docs))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_minhash_equals_brute_force(spark, corpus):
    sets = {i: shingles(t) for i, t in corpus}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    got = {r.doc_id: r for r in op1_minhash.near_duplicates(frame(spark, corpus)).collect()}
    assert {i: got[i].component_id for i in sets} == {i: find(i) for i in sets}
    assert all(got[i].n_shingles == len(sets[i]) and got[i].kept == (find(i) == i) for i in sets)


@pytest.mark.parametrize("n_words,changed", [(100, 2), (200, 4)])
def test_minhash_finds_a_hub_among_its_copies(spark, n_words, changed):
    """The copies are linked to their original, whose id is in the middle, but hardly to each other; so are those of a second family."""
    rng = random.Random(n_words)
    rows = []
    for family in range(2):
        hub = [f"f{family}w{k}" for k in range(n_words)]
        for k in range(301):
            copy = list(hub)
            for at in rng.sample(range(n_words), changed if k != 150 else 0):
                copy[at] = f"x{family}.{k}.{at}"
            rows.append((1000 * family + k, " ".join(copy)))
    sets = {i: shingles(t) for i, t in rows}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = {i: i // 1000 * 1000 if near(i, i // 1000 * 1000 + 150) else None for i in sets}
    got = {r.doc_id: r.component_id for r in op1_minhash.near_duplicates(frame(spark, rows)).collect()}
    linked = [i for i in want if want[i] is not None]
    assert len(linked) > 500 and len({got[i] for i in linked}) == 2 and all(got[i] // 1000 == i // 1000 for i in got)


def test_minhash_odd_rows(spark, odd):
    got = op1_minhash.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(ODD) and by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[6].component_id == 5
    assert by[None].component_id is None and by[None].kept and op1_minhash.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)]
    root = {}
    adjacent = collections.defaultdict(set)
    for a, b in edges:
        if a != b:
            adjacent[a].add(b)
            adjacent[b].add(a)
    for start in sorted(adjacent):
        todo = [start]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = start
                todo += adjacent[x]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    got |= {x: x for x in root if x not in got}
    assert got == root


def test_warc_records(spark, tmp_path):
    html = '<!DOCTYPE html><html lang="en"><head><title>A &amp; B</title><style>p{}</style><script>var t="</p>";</script></head><body><p>One<br>two <b>three</b> &lt;&eacute;&#33;<a href="/x?a=1&amp;b=2">link</a><!-- no --></body></html>'
    assert op2_warc.read_page(html) == ("One\ntwo three <é!link", "A & B", "en", ["/x?a=1&b=2"])
    pages = spark.createDataFrame([(1, "http://e/x", html, "k"), (2, None, None, "k"), (None, "u", "<p>ok", "k")], "page_id long, url string, html string, block string")
    found = op2_warc.responses_of_pages(pages)
    records = op2_warc.derivatives(found)
    rows = records.collect()
    by = {(r.page_id, r.record_type): r for r in rows}
    assert len(rows) == 6 and by[1, "conversion"].block == "One\ntwo three <é!link" and by[2, "conversion"].block == ""
    assert by[1, "metadata"].refers_to == by[1, "conversion"].refers_to != by[2, "conversion"].refers_to
    assert by[1, "conversion"].block_digest == "sha256:" + hashlib.sha256(by[1, "conversion"].block.encode()).hexdigest()
    assert by[1, "metadata"].source_payload_digest == "sha256:" + hashlib.sha256(html.encode()).hexdigest()
    assert op2_warc.write_warc(records, str(tmp_path / "w")) == 6 and op2_warc.write_warc(op2_warc.response_records(found), str(tmp_path / "r")) == 3
    back = op2_warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert {(r.record_id, r.refers_to, bytes(r.block)) for r in back} == {(r.record_id, r.refers_to, r.block.encode()) for r in rows} and all(r.digest_ok for r in back)
    assert {r.header for r in back} == {r.header for r in rows} and op2_warc.derivatives(found.limit(0)).count() == 0
    # The same derivatives come from the responses' own records.
    again = op2_warc.derivatives(op2_warc.responses(op2_warc.read_warc(spark, str(tmp_path / "r")))).drop("page_id")
    assert sorted(map(str, again.collect())) == sorted(map(str, records.drop("page_id").collect()))


def plain_warc(data):
    """(headers, block) of the records of a WARC file, by a parser of its own: one pass over a stream."""
    stream, out = io.BytesIO(gzip.decompress(data)), []
    while line := stream.readline():
        if line.strip():
            headers = {}
            while field := stream.readline().strip():
                name, _, value = field.decode().partition(":")
                headers[name.lower()] = value.strip()
            out.append((headers, stream.read(int(headers["content-length"]))))
    return out


def test_warc_responses_keep_what_they_state(spark, tmp_path):
    bodies = [b"<p>caf\xe9</p>\r\n\r\nWARC/1.1\r\n\r\n", b"", b"<title>t</title>x", b"<p>" + b"long " * 400_000]
    http = ["HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1\r\nServer: x", "HTTP/1.1 404 Gone\r\nX-Odd:  a: b", "HTTP/1.0 200 OK", "HTTP/1.1 200 OK"]
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "a.warc.gz", "wb") as out:
        out.write(gzip.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\ninfo\r\n\r\n"))
        for k, (h, body) in enumerate(zip(http, bodies, strict=True)):
            block = f"{h}\r\n\r\n".encode() + body
            sha1 = base64.b32encode(hashlib.sha1(block).digest()).decode()
            stated = f"WARC-Block-Digest: sha1:{sha1}\r\nWARC-Payload-Digest: sha1:STATED{k}\r\n" if k != 2 else ""
            out.write(gzip.compress(f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{k}>\r\nWARC-Date: 2024-01-0{k + 1}T00:00:00Z\r\nWARC-Target-URI: http://e/{k}\r\n{stated}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"))
    read = op2_warc.read_warc(spark, str(tmp_path / "in"))
    assert {r.record_type: r.digest_ok for r in read.where("record_id <> 'urn:uuid:2' or record_id is null").collect()} == {"warcinfo": None, "response": True}
    made = op2_warc.derivatives(op2_warc.responses(read))
    op2_warc.write_warc(made, str(tmp_path / "out"))
    found = [x for f in sorted((tmp_path / "out").glob("*.gz")) for x in plain_warc(f.read_bytes())]
    assert len(found) == 8
    for headers, block in found:
        k = int(headers["warc-refers-to"][-2])
        assert headers["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and headers["warc-date"] == f"2024-01-0{k + 1}T00:00:00Z" and headers["warc-target-uri"] == f"http://e/{k}"
        assert headers["x-source-http"] == http[k].replace("\r\n", " | ") + " |" and (headers["x-source-payload-digest"] == f"sha1:STATED{k}") == (k != 2)
        if headers["warc-type"] == "conversion":
            assert block.decode() == op2_warc.read_page(bodies[k].decode("latin-1"))[0] and (k or block.decode().startswith("café"))


def test_warc_files_are_read_in_one_pass(spark, tmp_path):
    """100,000 small gzip members in one file, a plain file, zeros between members, a block that compresses a thousandfold, cut-off files."""
    record = lambda k, block: f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <r:{k}>\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "many.warc.gz", "wb") as out:
        for k in range(100_000):
            out.write(gzip.compress(record(k, b"block %d\r\n\r\nWARC/1.1" % k), 1) + b"\0" * (k % 3))
    (tmp_path / "in" / "plain.warc").write_bytes(b"".join(record(f"p{k}", b"x" * k) for k in range(3000)))
    (tmp_path / "in" / "wide.warc.gz").write_bytes(gzip.compress(record("w", b"y" * (60 << 20)) + b"".join(record(f"w{k}", b"") for k in range(20_000))))
    start = time.perf_counter()
    got = op2_warc.read_warc(spark, str(tmp_path / "in")).select("record_id", F.length("block").alias("n"), F.md5("block").alias("h"))
    rows = {r.record_id: (r.n, r.h) for r in got.collect()}
    assert time.perf_counter() - start < 60 and len(rows) == 100_000 + 3000 + 20_001
    assert rows["r:w"][0] == 60 << 20 and all(rows[f"r:p{k}"][0] == k for k in range(3000))
    assert all(rows[f"r:{k}"][1] == hashlib.md5(b"block %d\r\n\r\nWARC/1.1" % k).hexdigest() for k in range(0, 100_000, 997))
    whole = gzip.compress(record(1, b"abc"))
    for odd_ in (whole[:-9], gzip.compress(record(1, b"abc")[:-6]), b"no record"):
        with pytest.raises(ValueError):
            list(op2_warc.records_of(op2_warc.inflated(io.BytesIO(odd_))))
    assert list(op2_warc.records_of(op2_warc.inflated(io.BytesIO(b"")))) == []


def test_secrets_and_ledger(spark, odd):
    text = "é api_key = 'abcdef' secret: token: abcdefgh PASSWORD=xyz AKIA" + "A1" * 8 + " " + "0f" * 12 + " AKIASHORT token=" + "ab" * 12
    history = frame(spark, [(1, text), (2, text), (3, "new"), (4, None)])
    ledger = op3_secrets.update(history)
    assert ledger.count() == 3 * len(op3_secrets.RULES)
    found = {r.doc_id: [(x.kind, text[x.start : x.end]) for x in r.found] for r in op3_secrets.findings(history, ledger).collect()}
    want = [("assign", "api_key = 'abcdef"), ("access", "AKIA" + "A1" * 8), ("hex", "0f" * 12), ("assign", "token=" + "ab" * 12), ("hex", "ab" * 12)]
    assert found[1] == found[2] == want and found[3] == found[4] == []
    assert op3_secrets.update(history, ledger).count() == 0
    newer = (*op3_secrets.RULES[:2], op3_secrets.Rule("hex", 2, "[0-9a-f]{30,}"))
    assert {(r.rule, r.rule_version) for r in op3_secrets.update(history, ledger, newer).collect()} == {("hex", 2)}
    assert op3_secrets.findings(odd, op3_secrets.update(odd)).count() == len(ODD) and op3_secrets.findings(odd.limit(0), ledger).count() == 0


def test_secrets_many_matches_and_hot_blobs(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    rng = random.Random(11)
    texts = ["".join(rng.choice(["token=abc123 ", "é", "secret: xy ", "AKIA" + "Z" * 16 + " ", "0123456789abcdef" * 2 + "\n"]) for _ in range(n)) for n in (0, 1, 2, 400)]
    rows = list(enumerate([*texts, *[texts[3]] * 20]))
    for r in op3_secrets.findings(frame(spark, rows), op3_secrets.update(frame(spark, rows))).collect():
        text = rows[r.doc_id][1]
        want = []
        for rank, rule in enumerate(op3_secrets.RULES):
            want += [(m.start(), rank, rule.kind, m.end()) for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]
        assert [tuple(x) for x in r.found] == sorted(want)


def test_decontamination(spark, odd):
    rng = random.Random(2)
    items = [(k, " ".join(words(rng, n, 60))) for k, n in enumerate([3, 10, 14, 30, 1, 25])] + [(9, None), (10, "!!"), (1, "w1 w2")]
    docs = [(k, ", ".join(words(rng, 80, 60))) for k in range(20)]
    docs += [(20 + k, f"pre {t or ''} post. {(t or '').upper()}") for k, (_, t) in enumerate(items)]
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = {}
    for doc, text in docs:
        w, hit, ids = tokens(text), set(), set()
        for item, t in items:
            p = tokens(t)
            m = min(10, len(p))
            for i in range(len(p) - m + 1 if m else 0):
                for at in range(len(w) - m + 1):
                    if w[at : at + m] == p[i : i + m]:
                        hit.update(range(at, at + m))
                        ids.add(str(item))
        want[doc] = (len(w), len(hit), sorted(ids))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (1 << 20, 60):
        got = {r.doc_id: (r.n_words, sum(x["end"] - x["start"] for x in r.spans), list(r["items"])) for r in op4_decontaminate.contamination(frame(spark, docs), bench, block_bytes=size).collect()}
        assert got == want
    assert op4_decontaminate.contamination(odd, bench).count() == len(ODD) and op4_decontaminate.contamination(odd, bench.limit(0)).where("size(items) > 0").count() == 0


@pytest.mark.parametrize("limit", [1 << 26, -1])
def test_line_dedup(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(common, "HOT_ROWS", 5000 if limit > 0 else 3)
    rng = random.Random(7)
    base = [words(rng, rng.randint(5, 14), 6) for _ in range(12)]
    docs = []
    for k in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(w))
                rng.choice([lambda: w.pop(at), lambda: w.insert(at, rng.choice("xyz")), lambda: w.__setitem__(at, rng.choice("xyz"))])()
            lines.append(" ".join(w).title() if rng.random() < 0.3 else "  ".join(w))
        docs.append((k, "\n".join(lines)))
    docs += [(40, None), (41, ""), (42, docs[3][1]), (43, "short line\n\nPage 5\n \t\nSHORT\x0bline"), (44, "page 5\n\n"), (45, "page 6")] + [(k, "short line") for k in range(50, 60)]

    def close(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    seen, want = [], {}
    for doc, text in docs:
        kept = []
        for line in (text or "").split("\n"):
            w = line.lower().split()
            if w and any(w == x or min(len(w), len(x)) >= 8 and close(w, x) for x in seen):
                seen.append(w)
                continue
            seen += [w] if w else []
            kept.append(line)
        want[doc] = None if text is None else "\n".join(kept)
    assert {r.doc_id: r.text for r in op5_line_dedup.drop_repeated_lines(frame(spark, docs)).collect()} == want


def test_line_dedup_odd_rows(spark, odd):
    got = op5_line_dedup.drop_repeated_lines(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(ODD) and rows[1].text is None and rows[2].text == "" and rows[6].text == "" and rows[3].text == ODD[2][1] and rows[5].text == ODD[5][1] and rows[6]["rank"] == "r"
    assert op5_line_dedup.drop_repeated_lines(odd.limit(0)).count() == 0


def divergence(p, q):
    m = [(x + y) / 2 for x, y in zip(p, q)]
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v > 0)
    return (max(kl(p) + kl(q), 0) / 2) ** 0.5


def test_quality(spark, odd, monkeypatch):
    """Base counts, references, distances, learnt limits and verdicts, all by brute force."""
    monkeypatch.setattr(op6_quality, "COMMON", 12)
    rng = random.Random(4)
    rows = [(k, "\n".join(" ".join(words(rng, rng.randint(0, 9), 5)) for _ in range(rng.randint(0, 12))), "en") for k in range(25)] + [(99, "#*$ %&|<> é 漢字\n\n#*$ %&|<> é 漢字", "es")]
    weights = {"en": [1 / (k + 1) for k in range(60)], "fr": [1 / (60 - k) for k in range(60)]}
    for k in range(100, 500):
        lang, n = rng.choice(["en", "fr"]), rng.randint(70, 90) if k < 420 else rng.randint(80, 400)
        made = rng.choices([f"v{i}" for i in range(60)], weights[lang if k < 460 else "fr"], k=n)
        rows.append((k, " ".join(made).upper() if k > 490 else " ".join(made), lang))
    labels = [(k, int(k < 460)) for k in range(100, 500)]
    got = {r.doc_id: r for r in op6_quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    classes = lambda t: [len(re.findall(x, t)) for x in ("[a-z]", "[A-Z]", "[0-9]", r"[ \t-\r]", r"[#*$%&|<>]", r"[^\x00-\x7f]", r"[!\"'()+,./:;=?@\\^_`{}~\[\]-]")]
    share = lambda c: [x / sum(c) for x in c]
    good = [r for r in rows if 100 <= r[0] < 460 and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    lists, refs, most = {}, {}, {}
    for lang in ("en", "fr"):
        n = collections.Counter(w for _, t, x in good if x == lang for w in t.lower().split())
        lists[lang] = [w for w, _ in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:12]]
        refs[lang] = [n[w] / n.total() for w in lists[lang]]
        refs[lang].append(1 - sum(refs[lang]))
        lists[lang, "c"] = share([sum(x) for x in zip(*(classes(t) for _, t, y in good if y == lang))])

    def distances(text, lang):
        w = text.lower().split()
        n = collections.Counter(w)
        own = [n[x] / len(w) for x in lists[lang]]
        return divergence(share(classes(text)), lists[lang, "c"]) if len(text) >= 200 else None, divergence([*own, 1 - sum(own)], refs[lang]) if len(w) >= 64 else None

    band = lambda text: int(2 * np.log2(len(text.split())))
    for kind in (0, 1):
        for lang in ("en", "fr"):
            by = collections.defaultdict(list)
            for _, t, x in good:
                if x == lang and (d := distances(t, lang)[kind]) is not None:
                    by[band(t)].append(d)
            learnt = {b: max(np.mean(d) + 5 * np.std(d), max(d)) for b, d in by.items() if len(d) >= 30}
            for b in range(131):
                near = [x for x in learnt if x <= b]
                most[kind, lang, b] = learnt[max(near) if near else min(learnt)]
    for b in range(131):
        most[0, "en", b] = most[0, "fr", b] = max(most[0, "en", b], most[0, "fr", b])
    for doc, text, lang in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 2 * want[4] > want[0])
        if doc >= 100:
            found = distances(text, lang)
            assert [r.class_distance, r.word_distance] == [x if x is None else pytest.approx(x, abs=2e-6) for x in found]
            far = [x is not None and x > 1.03 * most[k, lang, band(text)] for k, x in enumerate(found)]
            assert r.kept == (not r.base_failed and not any(far)), doc
    assert sum(not got[k].kept for k in range(491, 500)) > 5 and all(got[k].kept or got[k].base_failed for k in range(100, 420))
    empty = spark.createDataFrame([], "doc_id long, quality int")
    alone = op6_quality.quality(odd, empty)
    assert alone.count() == len(ODD) and alone.where("kept = base_failed").count() == 0 and op6_quality.quality(odd.limit(0), empty).count() == 0


def test_every_language_has_its_reference(spark):
    """Twenty-five languages of forty documents each; in each one document in the words of the next language."""
    rng = random.Random(8)
    rows = [(100 * n + k, " ".join(rng.choices([f"{chr(97 + (n + (k == 50)) % 25)}q{i}" for i in range(40)], k=120)), f"l{n}") for n in range(25) for k in range(51)]
    good = [(d, 1) for d, _, _ in rows if d % 100 < 50]
    got = op6_quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(good, "doc_id long, quality int")).collect()
    assert {r.doc_id for r in got if not r.kept} == {100 * n + 50 for n in range(25)}


def test_js_distance(spark):
    a, b = np.array([3.0, 1, 0]), np.array([1.0, 1, 2])
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v)
    got = spark.range(1).select(op6_quality.js_distance(F.array(*map(F.lit, a.tolist())), F.array(*map(F.lit, b.tolist()))).alias("x")).first()["x"]
    assert got == pytest.approx(((kl(p) + kl(q)) / 2) ** 0.5)


def test_toxicity(spark, odd):
    rng = random.Random(3)
    docs, labels = [], []
    for k in range(400):
        w, toxic = words(rng, 30, 200), k % 4 == 0
        w += ["horrible"] * 3 if toxic else []
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    docs += [(1000, "w1 w2 h0rr1ble w3"), (1001, "w1 h o r r i b l e w4"), (1002, "w5 hooorrrible w6"), (1003, None), (1004, "")]
    rows, marks = frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in op7_toxicity.toxicity(rows, marks).collect()}
    away = [k for k, _ in labels if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(away) > 50 and all(got[k].predicted == labels[k][1] for k in away)
    assert all(got[k].predicted == 1 for k in (1000, 1001, 1002)) and got[1003].predicted == got[1004].predicted == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert op7_toxicity.toxicity(odd, marks.limit(0)).where("score = 0").count() == len(ODD)
    assert op7_toxicity.toxicity(odd.limit(0), marks).count() == 0


@pytest.mark.parametrize("token,word", [("1d10t", "idiot"), ("i.d.i.o.t", "idiot"), ("stuuupid", "stupid"), ("wor7hless", "worthless"), ("m0r0n", "moron")])
def test_decoding(token, word):
    text = {"the": 90, "idiot": 4, "stupid": 4, "worthless": 4, "moron": 4, "of": 60, "and": 60, "less": 9, "pass": 9, "worth": 9}
    model = op7_toxicity.CharacterModel(op7_toxicity.CharacterModel.count(text))
    assert word in op7_toxicity.readings(token, model)


def test_decoding_is_exact():
    """Viterbi against all readings of short tokens."""
    model = op7_toxicity.CharacterModel(op7_toxicity.CharacterModel.count({"the": 90, "idiot": 4, "stupid": 4, "to": 60, "all": 9, "it": 50}))
    code = model.code

    def paths(token):
        out = [(0.0, 0, 0, "", "")]
        for at, sign in enumerate(token):
            stretched = token[max(0, at - 2) : at + 3].count(sign) >= 3
            options = [(sign, 0.0 if sign.isalpha() else op7_toxicity.COST_ODD), *((x, op7_toxicity.COST_LOOK) for x in op7_toxicity.LOOKALIKES.get(sign, ""))]
            new = []
            for score, a, b, last, text in out:
                for x, cost in options:
                    new.append((score + model.log[a][b][code(x)] - cost, b, code(x), x, text + x))
                    if x == last:
                        new.append((score - cost - (op7_toxicity.COST_REPEAT if stretched else op7_toxicity.COST_PAIR), a, b, last, text))
                if sign in op7_toxicity.SEPARATORS:
                    new.append((score - op7_toxicity.COST_SKIP, a, b, last, text))
            out = new
        return sorted(((score + model.log[a][b][0], text) for score, a, b, _, text in out), reverse=True)

    rng = random.Random(12)
    for _ in range(150):
        token = "".join(rng.choice("idot1!.-70ss") for _ in range(rng.randint(1, 6)))
        best = paths(token)
        assert model.decode(token) in {text for score, text in best if score > best[0][0] - 1e-9}


@pytest.mark.parametrize("text", ["", "\\", "<s>", "<\\s>", "a\\n<|im_end|>\nb</s>[INST][/INST]", "<|im_", "é \r\n"])
def test_chat_escapes(text):
    assert op8_chat.unescape(op8_chat.escape(text)) == text
    assert not any(c in op8_chat.escape(text) for c in op8_chat.CONTROLS)
    for role in ("user", "a\nb\\", "", text):
        assert op8_chat.parse("".join(op8_chat.segment(role, text))) == (role, text)


def chat_digests(turns):
    """(n_turns, turns_sha256, loss_chars, loss_sha256) of (role, text) turns."""
    whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    learnt = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest()


@pytest.mark.parametrize("hot", [5000, 3])
def test_prefix_trees(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng = random.Random(9)
    talks = {c: [("user" if k % 2 == 0 else "assistant", rng.choice("abc") * rng.randint(1, 2)) for k in range(rng.randint(1, 5))] for c in range(40)}
    talks[100] = [(None, None), ("assistant", "<|im_end|>"), ("assistant", "<|im_end|>")]
    talks[101] = [("user", "long é\n" * 30_000), ("assistant", "ok")]
    comb = [("user", f"step {k}") for k in range(12)]
    talks |= {200 + k: [*comb[: k + 1], ("assistant", f"off at {k}")] for k in range(12)}
    talks[7] = talks[3]
    rows = [(c, k, r, t, "x") for c, turns in talks.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "lost", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, owner string")
    nodes, walks = op8_chat.prefix_trees(table)
    made, steps = {(r.owner, r.idx): r for r in nodes.collect()}, collections.defaultdict(list)
    for r in walks.collect():
        steps[r.conv_id].append(r)
    paths = {tuple((r or "", t or "") for r, t in turns[: k + 1]) for turns in talks.values() for k in range(len(turns))}
    assert len(made) == len(paths)
    trees, encoding = collections.defaultdict(list), op8_chat._encoding(*tokenizer_files())
    for r in made.values():
        trees[r.tree].append((r.offset, r.offset + r.n_tokens))
    assert all(a[1] == b[0] for t in trees.values() for a, b in zip(sorted(t), sorted(t)[1:])) and all(min(t)[0] == 0 for t in trees.values())
    for c, turns in talks.items():
        path = sorted((r for r in made.values() if any(s.owner == r.owner and s.start <= r.offset < s.end for s in steps[c])), key=lambda r: r.offset)
        assert [op8_chat.parse(encoding.decode(np.frombuffer(bytes(r.ids), "<u2").tolist())) for r in path] == [(r or "", t or "") for r, t in turns]
        for k, r in enumerate(path):
            before = path[:k]
            assert r.idx == k and r.position == sum(x.n_tokens for x in before) and 2 * r.n_tokens == len(r.ids)
            seen = {t for s in r.attention for t in range(s.start, s.end)} | {t for x in before if x.owner == r.owner for t in range(x.offset, x.offset + x.n_tokens)}
            assert seen == {t for x in before for t in range(x.offset, x.offset + x.n_tokens)}
    back = {r.conv_id: r for r in op8_chat.read_back(*op8_chat.prefix_forest(table)).collect()}
    assert {c: tuple(back[c])[1:5] for c in back} == {c: chat_digests(turns) for c, turns in talks.items()}
    assert op8_chat.read_back(*op8_chat.prefix_forest(table.limit(0))).count() == 0


def tokenizer_files():
    import public_tokenizers

    return public_tokenizers.path(op8_chat.RANKS_FILE), public_tokenizers.PATTERN


def test_chat_query(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn))
    talks = collections.defaultdict(list, {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]})
    for r in rows:
        talks[r.conv_id].append((r.role, r.text))
    got = {r.conv_id: tuple(r)[1:5] for r in op8_chat.op8_chat_prefix_tree(spark, sf).collect()}
    assert got == {c: chat_digests(turns) for c, turns in talks.items()}


def test_packing(spark, odd):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(8)
    texts = ["", None, "a  b\n\n c\t\tdé漢 <|endoftext|> 'll 123456", "x" * 5000, "<|endoftext|>", "a<|endoftext|><|endoftext|> b <|endoftext"] + [" ".join(words(rng, rng.randint(1, 900))) for _ in range(150)]
    made = common.cut(op9_packing.pieces(frame(spark, list(enumerate(texts)))))
    got = op9_packing.pack(made).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for k, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        parts = sorted(by[k], key=lambda r: r.piece)
        assert [x for r in parts for x in np.frombuffer(bytes(r.ids), "<u4")] == ids and all(r.ids_crc32 == zlib.crc32(bytes(r.ids)) for r in parts)
        assert all(r.length == 1024 for r in parts[1:]) and len(parts) == -(-len(ids) // 1024) and [r.start for r in parts] == [sum(x.length for x in parts[:i]) for i in range(len(parts))]
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for rows in bins.values():
        end = 0
        for offset, length in sorted(rows):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 1024 + 1
    whole = {r.sequence_id: r for r in op9_packing.sequences(op9_packing.pack(made)).collect()}
    assert len(whole) == len(bins) and sum(len(r.ids) for r in whole.values()) == 4 * sum(r.length for r in got)
    assert op9_packing.pack(common.cut(op9_packing.pieces(odd, with_ids=False))).count() >= len(ODD) and op9_packing.pack(common.cut(op9_packing.pieces(odd.limit(0)))).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_packing_plan(seed):
    rng = random.Random(seed)
    counts = collections.Counter(rng.choice([rng.randint(1, 1024), rng.randint(1, 60), 512, 341, 342]) for _ in range(rng.choice([1, 30, 3000])))
    bins, placed = collections.defaultdict(list), collections.Counter()
    for length, rank, n, first, each, offset in op9_packing.plan(dict(counts)):
        assert rank == placed[length]
        placed[length] += n
        for k in range(n):
            bins[first + k // each].append((offset + k % each * length, length))
    assert placed == counts and sorted(bins) == list(range(len(bins)))
    for rows in bins.values():
        assert sum(3 * n > 1024 for _, n in rows) <= 2
        rows.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(rows, rows[1:])) and rows[0][0] == 0 and sum(rows[-1]) <= 1024


def test_sharding(spark, odd):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    got = op10_sharding.assign(rows, F.col("k"), [1.0, 2.0, 1.0], [1.0, 2.0, 1.0, 1.0])
    n = {r.shard: r["count"] for r in got.groupBy("shard").count().collect()}
    assert abs(n[1] - 10_000) < 400 and abs(n[0] - 5_000) < 300
    moved = got.where("shard <> grown_shard")
    assert moved.where("grown_shard <> 3").count() == 0 and abs(moved.count() - 4_000) < 300
    assert op10_sharding.assign(odd, F.col("doc_id"), [1.0] * 4).count() == len(ODD)


def test_running_sum(spark):
    rng = random.Random(6)
    rows = [(0 if rng.random() < 0.7 else rng.randrange(5), o, rng.randrange(9)) for o in rng.sample(range(10**6), 3000)]
    got = {(r.g, r.o): r.s for r in common.running_sum(spark.createDataFrame(rows, "g int, o int, v int"), ["g"], ["o"], F.col("v"), "s").collect()}
    total = collections.Counter()
    for g, o, v in sorted(rows):
        assert got[g, o] == total[g]
        total[g] += v


@pytest.mark.parametrize("name", ["op3_secret_scan", "op4_benchmark_decontamination", "op5_line_dedup"])
def test_queries_agree_with_sql(spark, sf, name):
    from worksift.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf).toPandas()
    want = con.sql(SQL[name]).df()[list(got.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every stage against plain Python on a small corpus with null and repeated rows; a stage's input is its predecessor's output."""
    import corpus_pipeline

    rng = random.Random(21)
    docs, labels = [], []
    for k in range(240):
        w = words(rng, rng.randint(20, 60), 4000)
        toxic = k % 4 == 0
        if toxic:
            w[5:5] = ["horrible", "awful"]
        docs.append((k, "\n".join(" ".join(w[i : i + 12]) for i in range(0, len(w), 12)), "en", "s", 1))
        labels.append((k, 1, int(toxic)))
    item = "the tall grey wall stands near one old mill by water"
    docs += [(300, f"we read {item} here", "en", "s", 1), (301, docs[1][1], "en", "s", 1), (302, docs[2][1] + " one more", "en", "s", 1), (None, "lost words " * 9, "en", "s", 1), (None, "horrible awful lost", "en", "s", 1), (303, None, None, None, None), (304, "", "en", "s", 0)]
    docs += [(305, "twice over " * 12, "en", "s", 1)] * 2 + [(306, "horrible awful thing", "en", "s", 1), (306, "a mild thing", "en", "s", 1), (307, "w " * 3000, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([("b1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shown = lambda rows: sorted((str(r[0]), str(r[1])) for r in rows)

    now = spark.createDataFrame(docs, schema)
    rows, stages = docs, dict(corpus_pipeline.STAGES)
    for name in list(stages)[:-1]:
        now = common.stored(stages[name](spark, now, str(tmp_path)))
        assert now.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        if name == "toxicity":
            rows = [r for r in rows if "horrible" not in (r[1] or "")]
        elif name == "line dedup":
            seen, out = set(), []
            for doc, text, *rest in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
                kept = []
                for line in (text or "").split("\n"):
                    key = tuple(line.lower().split())
                    if not (key and key in seen):
                        kept.append(line)
                    seen.add(key)
                out.append((doc, None if text is None else "\n".join(kept), *rest))
                if doc == 305:  # rows that share id and text are one document
                    seen.discard(tuple(("twice over " * 12).split()))
            rows = out
        elif name == "near dedup":
            groups, out, ids = {}, [], set()
            for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
                sh = frozenset(shingles(r[1]))
                if r[0] is None or r[0] not in ids and not (sh and any(4 * len(sh & x) >= 3 * len(sh | x) for x in groups)):
                    out.append(r)
                ids.add(r[0])
                groups[sh] = r[0]
            rows = out
        elif name == "decontamination":
            rows = [r for r in rows if item not in (r[1] or "")]
        assert shown(now.collect()) == shown(rows), name
    packed = stages["packing"](spark, now, str(tmp_path)).collect()
    encoding = op8_chat._encoding(*tokenizer_files())
    want = [[*encoding.encode_ordinary(r[1] or ""), 2] for r in rows]
    by = collections.defaultdict(list)
    for r in packed:
        by[r.doc_id].append(r)
    parts = [b"".join(bytes(x.ids) for x in sorted(v, key=lambda x: x.piece)) for k, v in by.items() if k is not None]
    assert sorted(parts) == sorted(np.array(x, "<u4").tobytes() for r, x in zip(rows, want, strict=True) if r[0] is not None)
    bins = collections.defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    assert all(sorted(v)[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(v), sorted(v)[1:])) and sum(n for _, n in v) <= 1024 for v in bins.values())
    assert shown((r.doc_id, r.piece, r.sequence_id) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "sequence_id").collect()) == shown((r.doc_id, r.piece, r.sequence_id) for r in packed)


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id string, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


CLASHES = ["found", "blob", "doc", "row", "dropped", "shard", "rank", "slot", "bucket", "class", "score", "position", "spans", "words", "kept", "block", "dropped_lines", "Text_Key"]


def test_clashing_columns(spark):
    """Extra columns come back as they were, or are replaced by a result of the same name; no operator breaks."""
    rows = spark.createDataFrame([(k, f"some words here to read {k % 3}\nsecret=abcdef{k % 3}", "en", 1, *map(str, range(len(CLASHES)))) for k in range(9)], "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(9)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("i", "words here to read", "x")], "item_id string, text string, spans string")

    def same(out, replaced=()):
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        got = out.collect()
        assert len(got) == 9 and all(r[c] == str(i) for r in got for i, c in enumerate(CLASHES) if c not in replaced)

    same(op3_secrets.findings(rows, op3_secrets.update(rows)), ["found"])
    same(op4_decontaminate.contamination(rows, bench), ["spans"])
    same(op4_decontaminate.contamination(rows, bench, block_bytes=10), ["spans"])
    same(op5_line_dedup.drop_repeated_lines(rows), ["dropped_lines"])
    same(op7_toxicity.toxicity(rows, labels), ["score"])
    same(op10_sharding.assign(rows, F.col("doc_id"), [1.0] * 4, [1.0] * 5), ["shard"])
    same(common.running_sum(rows, ["doc_id"], ["n_chars"], F.lit(1), "position"), ["position"])
    same(op9_packing.pack(common.cut(rows.withColumn("length", F.lit(700).cast("long")))))
    assert op1_minhash.near_duplicates(rows).count() == op6_quality.quality(rows, labels).count() == 9
    assert op9_packing.pieces(rows).count() == 9 and op2_warc.derivatives(op2_warc.responses_of_pages(rows.withColumnsRenamed({"doc_id": "page_id", "text": "html", "lang": "url"}))).count() == 18
    talk = rows.withColumnsRenamed({"doc_id": "conv_id", "n_chars": "turn", "lang": "role"})
    assert op8_chat.read_back(*op8_chat.prefix_forest(talk)).count() == 9
    import corpus_pipeline

    assert corpus_pipeline.drop_lines(spark, rows, "").columns == rows.columns and corpus_pipeline._without(rows, corpus_pipeline._judged(rows)).count() == 0


def test_sharding_query(spark, tmp_path):
    rows = [(k, f"té {k}") for k in range(500)] + [(None, None), (7, "té 7"), (8, "")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op10_sharding.op10_rendezvous_sharding(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((False, k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows if k is not None)
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and len({r.shard for r in got if r.doc_id == 7}) == 1 and any(r.grown_shard == 40 for r in got)
    (tmp_path / "none").mkdir()
    frame(spark, []).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert op10_sharding.op10_rendezvous_sharding(spark, str(tmp_path / "none")).count() == 0


def test_minhash_unlike_members_and_shared_ids(spark, monkeypatch):
    """Documents that share a passage but are unlike, a chain of likes among them, hot keys, and an id with two texts."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    monkeypatch.setattr(op1_minhash, "FAN", 4)
    rng = random.Random(31)
    passage = [f"p{k}" for k in range(60)]
    docs = [(k, " ".join([*words(rng, 40, 10**6), *passage])) for k in range(80)]
    for k in range(80, 160):
        w = docs[k - 80 if k < 90 else k - 1][1].split()
        w[rng.randrange(40)] = f"z{k}"
        docs.append((k, " ".join(w)))
    docs += [(200, docs[3][1]), (201, docs[5][1]), (201, docs[6][1]), (201, docs[6][1])]
    sets, named = [(i, frozenset(shingles(t))) for i, t in docs], {}
    for i, a in sets:
        named[a] = min(i, named.get(a, i))
    root = {i: i for i in named.values()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, i in named.items():
        for b, j in named.items():
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    got = op1_minhash.near_duplicates(frame(spark, docs)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((i, find(named[a])) for i, a in sets)


@pytest.mark.parametrize("hot", [10**9, 20])
def test_rare_pairs_of_a_family_and_strays(spark, monkeypatch, hot):
    """Hot shingles, split or not: every similar pair of different roots is met, and no pair of one root."""
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    rng, rows = np.random.default_rng(5), []
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    for i in range(260):
        own = rng.integers(-(1 << 62), 1 << 62, 60)
        swapped = rng.permutation(60)[: int(rng.integers(0, 5 if i < 200 else 12))]
        found = base.copy()
        found[swapped] = own[swapped]
        rows.append((i, 0 if i < 200 else i, sorted(set(map(int, found.view(np.uint64))))))
    signed = [(i, root, list(map(int, np.array(x, np.uint64).view(np.int64)))) for i, root, x in rows]
    got = {(r.a, r.b) for r in op1_minhash.rare_pairs(spark.createDataFrame(signed, "doc_id long, root long, shingles array<long>")).collect()}
    sets = {i: (root, set(x)) for i, root, x in signed}
    similar = {(a, b) for a in sets for b in sets if a < b and sets[a][0] != sets[b][0] and 100 * len(sets[a][1] & sets[b][1]) >= 75 * len(sets[a][1] | sets[b][1])}
    assert similar and similar <= got
    assert all(sets[a][0] != sets[b][0] for a, b in got)


def test_toxicity_splits_runs_and_reads_long_tokens(spark):
    rng = random.Random(8)
    plain = "such a the you are i am we house tree river garden window very good nice idea day today walk street paper".split()
    docs, labels = [], []
    for k in range(400):
        w, toxic = rng.choices(plain, k=30), k % 4 == 0
        w += ["stupid", "idiot"] if toxic else []
        rng.shuffle(w)
        docs.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    odd = ["such a s t u p i d idea", "we say y o u i d i o t today", "they I s t u p i d day", "house " + ("." * 8).join("stupid") + " tree", "house st" + "u" * 60 + "pid tree", "nice g o o d d a y a river"]
    docs += [(1000 + k, t) for k, t in enumerate(odd)]
    got = {r.doc_id: r.predicted for r in op7_toxicity.toxicity(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [got[1000 + k] for k in range(len(odd))] == [1, 1, 1, 1, 1, 0]


def test_quality_references_are_all_good_labels(spark):
    labels = spark.range(40_000).selectExpr("id as doc_id", "1 as quality")
    want = labels.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").count()
    assert op6_quality.reference_rows(labels).count() == want > 20_000


@pytest.mark.parametrize("part", [None, 0])
def test_repeated_windows_look_at_few_places(spark, monkeypatch, part):
    """Only places of like windows are sorted by whole hashes; a ``part`` without bits makes all places look alike, with the same counts."""
    if part is not None:
        monkeypatch.setattr(op6_quality, "_PART", part)
    rng = random.Random(5)
    texts = [[], ["a"], ["a", "a", "a"], ["a"] * 4, [f"w{k}" for k in range(3000)], [f"w{k}" for k in range(900)] + ["w5", "w6", "w7"], *(rng.choices("abcd", k=rng.randint(3, 90)) for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, words array<string>").withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    rows = rows.withColumn("marks", op6_quality.window_marks(F.col("h"))).withColumn("near", op6_quality.near_places(F.col("marks")))
    for r in rows.withColumn("n", op6_quality.repeated_window_words(F.col("h"), F.col("near"))).collect():
        w = texts[r.id]
        n = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        twice = {i for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1}
        assert r.n == len({i + k for i in twice for k in range(3)}) and twice <= set(r.near)
        assert part is not None or len(r.near) <= len(twice) + 2


def test_shares_are_dealt_to_short_lists(spark):
    shares = spark.createDataFrame([(x, f"{x}{k}", k / 1000, 0.5) for x in ("en", "fr") for k in range(300)], "lang string, word string, share double, rest double")
    told = op6_quality.dealt_shares(shares).collect()
    want = {x.lang: {} for x in told}
    for r in shares.select("lang", F.xxhash64("word").alias("h"), "share").collect():
        want[r.lang][r.h] = r.share
    for r in told:
        assert r.rest == 0.5 and max(len(m or {}) for m in r.shares) <= 16
        assert {h: v for m in r.shares for h, v in (m or {}).items()} == want[r.lang] and len(want[r.lang]) == 300
        assert all(h % op6_quality.LISTS == at for at, m in enumerate(r.shares) for h in m or {})
