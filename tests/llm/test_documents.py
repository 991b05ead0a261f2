"""Searches, classifiers, packing, personal data, pages and archives on small fixtures."""

import base64
import hashlib
import os
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tandem import session
from tandem.llm import decontaminate, html_extract, packing, permutation_index, pii, quality, toxicity, warc
from tests.llm.conftest import AWKWARD, SF

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


PERSONAL = [
    "a@b.com_x@y.com", "1.2.3.4.5.6.7.8 999.1.1.1 010.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1112 é 5500000000000004x",
    "+1 (555) 123-4567 +49-30-1234567 +12", "x@y.z.w. b%@c-d.e-f é@q.r a@b a@b.c@d.e", "+1+2+345 67 89 01 2" + "5" * 30,
    "é" * 10 + " j@x.com 10.0.0.1 " + "1" * 13, "0" * 12 + " " + "1 " * 40, None, "",
]


def test_personal_data_against_plain_matching(spark, awkward, nothing):
    rows = [(i, t) for i, t in enumerate(PERSONAL)] + [(100 + (i or 0), t) for i, t in AWKWARD]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i, t in rows:
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k, _ in PATTERNS] == [sum(s.startswith(k) for s in want) for k, _ in PATTERNS]
    assert pii.report(awkward).count() == len(AWKWARD)
    assert pii.report(nothing).count() == 0
    assert pii.sanitise(awkward).columns == awkward.columns and pii.sanitise(awkward).count() == len(AWKWARD)


def test_terms_that_reveal_an_entity_are_removed(spark):
    told = [(i, f"Note {i} from Zebulon Quastor at z@q.com about the {w} plan") for i, w in enumerate(["blue", "grey", "green", "brown"])]
    other = [(100 + i, f"number {i} about the plan from nobody with words {i * 7}") for i in range(200)]
    docs = spark.createDataFrame(told + other, "doc_id bigint, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.report(docs).collect()}
    begin = told[0][1].index("Zebulon")
    assert f"term:{begin}:{begin + 7}" in spans[0] and "email:" in spans[0] and spans[100] == ""
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and "about" in clean[0]
    assert clean[100] == other[0][1]


def test_a_long_text_takes_no_square_time(spark):
    """Each of many flagged words of a long text is found, and the rest stays."""
    other = [(100 + i, f"Ask number {i} about then mail") for i in range(200)]
    letters = "abcdefghij"
    rare = ["".join(letters[int(d)] for d in f"{i:05}") for i in range(60_000)]
    long = " ".join(rare) + " mail me@here.org then " + " ".join(rare[:1000])
    docs = spark.createDataFrame([*other, (1, long)], "doc_id bigint, text string")
    begin = time.perf_counter()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert time.perf_counter() - begin < 90
    assert clean[100] == other[0][1] and clean[1].split() == ["mail", "[EMAIL]", "then"]


def test_redaction_against_plain_slicing(spark):
    rng = np.random.Generator(np.random.PCG64(6))
    rows = []
    for i in range(60):
        text = "".join(rng.choice(list("ab é\n😀"), int(rng.integers(0, 3000))))
        cuts = np.sort(rng.choice(len(text) + 1, 2 * min(8, len(text) // 2), replace=False)) if len(text) > 3 else []
        spans = [(int(a), int(rng.integers(0, 5)), int(b), ) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        spans = [(a, r, b, [*pii.KINDS, pii.TERM][r], "") for a, r, b in spans]
        spans += [(a, 1, b + 3, "ip", "") for a, r, b, k, _ in spans[-1:] if k != "term"]
        rows.append((i, text, sorted(spans)))
    want = {}
    for i, text, spans in rows:
        out, at = "", 0
        for a, _, b, kind, _ in spans:
            if a >= at:
                out += text[at:a] + ("" if kind == "term" else f"[{kind.upper()}]")
            at = max(at, b)
        want[i] = out + text[at:]
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,rank:int,end:int,kind:string,value:string>>")
    assert {r["i"]: r["t"] for r in df.select("i", pii._redacted(F.col("text"), F.col("spans")).alias("t")).collect()} == want


def test_terms_of_a_value_in_one_text_are_removed(spark):
    told = [(0, "Ask Zebulon Quastor at z@q.com about the plan"), (1, "Ask Ulrika at u@firm.org about the plan of Firmament"), (2, "Ask Ottokar at o@firm.org about the plan of Firmament")]
    docs = spark.createDataFrame(told + [(100 + i, f"Ask number {i} about the plan") for i in range(200)], "doc_id bigint, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0].split() == "Ask at [EMAIL] about the plan".split()
    assert clean[1].split() == clean[2].split() == "Ask at [EMAIL] about the plan of".split()
    assert clean[100] == "Ask number 0 about the plan"


def test_terms_far_from_their_value_are_removed(spark):
    filler = "and about the plan " * 30
    told = [(0, f"From Zebulon {filler}mail z@q.com {filler}says zebulon, Zoé+1 555 123 4567 or Zoé x {filler}"), (1, f"Zebulon {filler} alone")]
    docs = spark.createDataFrame(told + [(100 + i, f"From {i} mail or says {filler}") for i in range(400)], "doc_id bigint, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "ebulon" not in clean[0] and "[EMAIL]" in clean[0] and "[PHONE]" in clean[0] and clean[0].count("plan") == 90
    assert len(clean[0].split()) == len(told[0][1].split()) - 1 - 3
    assert clean[1] == told[1][1] and clean[100] == docs.filter("doc_id = 100").first()["text"]


def test_tokens_equal_the_library_and_packing_is_whole(spark, awkward, nothing):
    tokens, plain = packing.WordTokens(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    odd = ["a,b(c)'s d're,x we'll... ('s)", "it's\"ok\"[x]é,ö.ä ½x ²", "a!!b ??c---d_e", "Don't İstanbul ΣΑΣ", "á b", "x<|endoftext|>y", "\x1c a\x85b\xa0c", "１２ ٣ 'S", "", "  "]
    for text, ids in zip(odd, tokens(odd), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids
    got = [r for r in packing.pack_documents(awkward, VOCABULARY, 64).collect()]
    assert len({r["doc_id"] for r in got}) == len({i for i, _ in AWKWARD})
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    texts = dict(reversed(AWKWARD))
    for r in got:
        ids = [*plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1]
        part = ids[r["start"] : r["start"] + 64]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert packing.pack_documents(nothing, VOCABULARY).count() == 0


def test_plans_use_every_piece_once():
    rng = np.random.Generator(np.random.PCG64(1))
    for size in (8, 64, 512):
        for _ in range(20):
            counts = {int(k): int(rng.integers(1, 40)) for k in rng.integers(1, size + 1, rng.integers(1, 40))}
            left = dict(counts)
            for times, used in packing.plan(counts, size):
                assert times > 0 and sum(k * n for k, n in used.items()) <= size
                for k, n in used.items():
                    left[k] -= n * times
            assert not any(left.values())


def test_search_finds_all_above_the_threshold():
    rng = np.random.Generator(np.random.PCG64(2))
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(words, rng.integers(4, 30)))) for i in range(60)]
    index = decontaminate.Index(items)
    for _ in range(100):
        terms = np.unique(rng.integers(0, len(index.terms), rng.integers(1, 40)))
        scores = np.zeros(len(index.item_of))
        for t in terms:
            entries, impacts, _ = index.postings[t]
            np.add.at(scores, entries, impacts)
        for threshold in (0.05, 0.2, 0.5):
            found = dict(index.search(terms.tolist(), threshold))
            assert set(found) == set(np.flatnonzero(scores >= threshold - 1e-9).tolist())


def test_leaks_are_found_and_clean_documents_stay(spark, awkward, nothing):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    tests = [(r["item_id"], words(r["text"])) for r in items.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, t in tests if t in words(r["text"])}
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()} == want
    assert decontaminate.drop_leaks(docs, items).count() == docs.count() - len({d for d, _ in want})
    odd = spark.createDataFrame([(1, None), (None, "x y z"), (2, ""), (3, "a b c d e f g h i j"), (3, "a b c d e f g h i j")], "item_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(awkward, odd).collect()} == {(7, 3), (8, 3), (9, 3), (None, 3)}
    assert decontaminate.find_leaks(awkward, nothing.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_neighbours_are_close_to_brute_force(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in permutation_index.nearest(table, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.collect())
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    hits = total = 0
    for at in np.flatnonzero(ids % 50 == 0):
        scores = x @ x[at]
        scores[at] = -9
        true = set(ids[np.argsort(-scores)[:5]].tolist())
        found = sorted(got[ids[at]])
        assert [rank for rank, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(scores[np.searchsorted(ids, v)] - s) < 1e-9 for _, v, s in found)
        hits, total = hits + len(true & {v for _, v, _ in found}), total + 5
    assert hits / total >= 0.9


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (50, [0.0, 1.0])]
    got = permutation_index.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0)
    found = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got.collect())
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 50, 0.0), (50, 1, 0, 0.0), (50, 2, 1, 0.0), (50, 3, 2, 0.0)]
    assert permutation_index.nearest(spark.createDataFrame([], "vec_id bigint, embedding array<double>"), F.lit(True)).count() == 0


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.97), (toxicity, "toxic", 0.8)])
def test_held_out_accuracy(spark, awkward, nothing, module, label, least):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = module.report(docs, labels).join(labels, "doc_id").filter("held_out").select("score", label).collect()
    y, s = np.array([r[label] for r in got]), np.array([r["score"] for r in got])
    order, ones = np.argsort(np.argsort(s)), y.sum()
    assert (order[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones)) > least
    few = spark.createDataFrame([(2, 1, 1), (7, None, 0), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    scored = module.report(awkward, few).collect()
    assert len(scored) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in scored)
    assert module.report(nothing, few.filter("doc_id < 0")).count() == 0


def test_pages():
    article = "<p>Some long paragraph, with commas, and more than a hundred characters so that it scores well here, does it not?</p>"
    page = f"<body><header><h1>Site</h1></header><div><div id=x>{article}<p>Two,&nbsp;  &amp; more.</p></div><div class='side sidebar'><p>bad, bad</p></div><div id=comments><p>nice, post</p></div></div><footer>f</footer>"
    assert html_extract.extract(page) == article[3:-4] + "\n\nTwo, & more."
    for broken in ("", "<", "<p", "<div " * 5000, '<a href="x' * 5000, "<!--", "<script>x", "</p></div>", "<div>" * 5000 + "</div>" * 5000):
        html_extract.extract(broken)


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(None, None, None), (1, "u", ""), (1, "u", "")], pages.schema)
    got = html_extract.main_text(pages.unionByName(odd)).collect()
    assert len(got) == pages.count() + 3
    assert sum(r["text"] == "" and r["n_chars"] == 0 for r in got) == 3
    whole = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in got[:50]:
        inner = re.search(r"<article>(.*)</article>", whole[r["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(__import__("html").unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b)


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 20_000)
    rows = [(i, f"http://x/{i}", "page" * (i % 7) + "é") for i in range(60)] + [(100, None, None), (101, "a\nb", ""), (None, "z", "é"), (3, "http://x/3", "pagepagepageé")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    sums = []
    for _ in range(2):
        folder = session.run_dir(spark, "warc")
        sums.append(sorted((r["file"], r["sha256"]) for r in warc.write(pages, folder).collect()))
        got = warc.read(spark, folder).collect()
    assert sums[0] == sums[1]
    assert len(got) == len(rows)
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    html = {i: t or "" for i, _, t in rows}
    for r in got:
        data = html[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        again = r["page_id"] is not None and first[html[r["page_id"]]] != r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[html[r["page_id"]]]) if again else ("response", None))
    heads, names = [], sorted(os.listdir(f"{folder}/archives"))
    assert not os.path.exists(f"{folder}/_temporary")
    for name in names:
        with open(f"{folder}/archives/{name}", "rb") as stream:
            heads.append([warc._headers(m.partition(b"\r\n\r\n")[0]) for m in warc._members(stream)])
    for name, members in zip(names, heads, strict=True):
        assert members[0]["warc-type"] == "warcinfo" and members[0]["warc-filename"] == name
        assert all(h["warc-record-id"].startswith("<urn:uuid:") for h in members)
    pages_of = [h for members in heads for h in members[1:]]
    responses = {h["warc-record-id"]: h for h in pages_of if h["warc-type"] == "response"}
    revisits = [h for h in pages_of if h["warc-type"] == "revisit"]
    assert len({m[0]["warc-record-id"] for m in heads}) == len(names) > 1 and revisits
    for h in revisits:
        there = responses[h["warc-refers-to"]]
        assert there["x-page-id"] == h["x-refers-to-page-id"] and there["warc-target-uri"] == h["warc-refers-to-target-uri"]
        assert there["warc-payload-digest"] == h["warc-payload-digest"]
    clash = pages.withColumns({c: F.lit("x") for c in ("sha", "bucket", "first", "first_url", "size", "part", "head", "copies")})
    named = session.run_dir(spark, "warc")
    assert sorted((r["file"], r["sha256"]) for r in warc.write(clash, named).collect()) == sums[0]
    empty = session.run_dir(spark, "warc")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0
