"""Ranked search, archives and token alignment against brute force and the libraries."""

from __future__ import annotations

import base64
import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vecloom.llm import op11_lexical_search, op12_warc, op13_token_alignment, registry

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [None, "", " ", "  ", "a", "a", "a ", " a", "a  b", "A-b_c É 日本語 x1\x00y\x7fz", LONG, LONG, "x" * 50_000, "<|endoftext|> <s> </s>", "▁ mark", "no     break    ", "tab\t \n \n\n  x \r\n", "½ ﬁ 😀😀 é", "the the the cat", "the dog", "The CAT's 123,456", " \n", " ", "a  ", "don't  stop   now    "]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "k") for i, t in enumerate(ODD)] + [(None, "the cat", "n"), (None, None, "n"), (18, "the the the cat", "again"), (18, "the the the cat", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, term string").withColumns({n: F.lit(n) for n in ("row", "tf", "n", "bucket", "share", "score", "key", "unit", "slice", "pos", "links", "page", "salt")})


def oracle(data, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con.execute(registry.ORACLES[name]).fetchall()


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


KEY = lambda r: tuple((x is None, x) for x in r)


# 11. Ranked lexical search.


def terms_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def ranked(docs, items, top):
    bags = [(i, Counter(terms_of(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    total = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            m = 50 + (50 * bag.total() * n_docs) // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in {*terms_of(text)} & {*bag})
            if s > 0:
                found.append((-s, doc is None, doc))
        out += [(item, k, doc, -s) for k, (s, _, doc) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


@pytest.mark.parametrize("broadcast_bytes", [op11_lexical_search.BROADCAST_BYTES, -1])
def test_ranks_are_brute_forces(spark, odd, broadcast_bytes):
    asked = [(0, "The cat, the DOG."), (1, None), (1, "É x1 b w5x5"), (2, "..."), (None, "now stop"), (4, "nowhere")]
    items = spark.createDataFrame(asked, "item_id long, text string")
    terms = op11_lexical_search.item_terms(items)
    index = op11_lexical_search.postings(odd, sieve=op11_lexical_search.sieve_of(terms))
    found = op11_lexical_search.ranked(index, terms, 3, broadcast_bytes)
    assert found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(values(found, "item_id", "rank", "doc_id", "score"), key=KEY) == sorted(ranked(docs, asked, 3), key=KEY)


def test_an_index_of_every_term_serves_any_items(spark, odd):
    terms = op11_lexical_search.item_terms(spark.createDataFrame([(7, "cat now w1x1")], "item_id long, text string"))
    every, some = op11_lexical_search.postings(odd), op11_lexical_search.postings(odd, sieve=op11_lexical_search.sieve_of(terms))
    assert every.count() > some.count()
    get = lambda i: sorted(values(op11_lexical_search.ranked(i, terms), "rank", "doc_id", "score"), key=KEY)
    assert get(every) == get(some) != []


def test_search_of_empty_tables(spark, odd):
    items = spark.createDataFrame([(0, "cat")], "item_id long, text string")
    assert op11_lexical_search.search(odd.limit(0), items).count() == op11_lexical_search.search(odd, items.limit(0)).count() == 0


def test_search_is_the_oracles(spark, data):
    assert sorted(values(registry.QUERIES["op11_lexical_search"](spark, data), "item_id", "rank", "doc_id", "score")) == sorted(oracle(data, "op11_lexical_search"))


# 12. WARC.

PAGES = [(0, "http://a/x y\r\nEvil: 1", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://b", None), (3, "http://b", ""), (4, "http://c", "z" * 3_000_000), (5, "http://c", "z" * 3_000_000), (5, "http://d", "z" * 3_000_000), (None, "http://e", "<p>é</p>"), (None, "http://e", "alone\r\n\r\nWARC/1.1\r\n"), (9, "http://f", "Content-Length: 5\r\n\r\n")]


def expected(pages, least):
    largest = defaultdict(lambda: -1)
    for page, _, html in pages:
        largest[html or ""] = max(largest[html or ""], -1 if page is None else page)
    out = []
    for page, _, html in pages:
        p = (html or "").encode()
        to = largest[html or ""]
        again = len(p) >= least and to >= 0 and page != to
        out.append((page, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", to if again else None))
    return out


@pytest.mark.parametrize("least", [0, 9])
def test_archives_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({n: F.lit(n) for n in ("payload", "key", "salt", "copies", "response", "page")})
    index = op12_warc.archive(df, f"file://{tmp_path}", least=least)
    found = op12_warc.read(index, payload=True).collect()
    names = "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    assert sorted((tuple(r[c] for c in names) for r in found), key=KEY) == sorted(expected(PAGES, least), key=KEY)
    whole = Counter((r["page_id"], bytes(r["payload"])) for r in found if r["record_type"] == "response")
    assert whole == Counter((p, (h or "").encode()) for (p, _, h), e in zip(PAGES, expected(PAGES, least), strict=True) if e[3] == "response")
    assert {r["url"] for r in index.collect()} == {u for _, u, _ in PAGES}
    # Some records alone: reads touch their ranges only.
    some = op12_warc.read(index.where("page_id IN (0, 9)"), payload=True).collect()
    assert sorted(r["page_id"] for r in some) == [0, 9]
    assert next(r["url"] for r in some if r["page_id"] == 0) == "http://a/x%20y%0D%0AEvil:%201"


def test_archives_are_warc_files(spark, tmp_path):
    """Members one after the other, each a record, at the places that the index names."""
    import zlib

    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    index = op12_warc.archive(df, f"file://{tmp_path}").collect()
    for name in {r["archive"] for r in index}:
        data, at, seen = open(name.removeprefix("file://"), "rb").read(), 0, {}
        while at < len(data):
            d = zlib.decompressobj(31)
            record = d.decompress(data[at:])
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: ") and record.endswith(b"\r\n\r\n")
            seen[at] = len(data) - at - len(d.unused_data)
            at += seen[at]
        places = {r["offset"]: r["length"] for r in index if r["archive"] == name}
        assert places.items() <= seen.items() and len(seen) == len(places) + 1  # the first tells of the file


def test_a_changed_archive_is_refused(spark, tmp_path):
    index = op12_warc.archive(spark.createDataFrame([(1, "u", "abc" * 50)], "page_id long, url string, html string"), f"file://{tmp_path}")
    r = index.first()
    fields, block = op12_warc.parsed(open(r["archive"].removeprefix("file://"), "rb").read()[r["offset"] :])
    changed = op12_warc._member([(k, v) for k, v in fields.items() if k != "Content-Length"], block.replace(b"abc", b"abd"))
    (tmp_path / "x.warc.gz").write_bytes(changed)
    bad = spark.createDataFrame([(f"file://{tmp_path}/x.warc.gz", 0, len(changed))], "archive string, offset long, length long")
    with pytest.raises(Exception, match="digest"):
        op12_warc.read(bad).collect()


def test_ranges_join_what_lies_near():
    gap, most = op12_warc.GAP, op12_warc.READ
    places = [("a", 0, 10), ("a", 10, 10), ("a", 20 + gap, 5), ("a", 26 + 2 * gap, 5), ("b", 0, 1), ("b", 1, most), ("b", 1 + most, 1)]
    assert list(op12_warc._ranges(places)) == [(0, 3), (3, 4), (4, 5), (5, 6), (6, 7)]
    assert list(op12_warc._ranges([])) == []


def test_warc_of_an_empty_table(spark, tmp_path):
    assert op12_warc.read(op12_warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}")).count() == 0


def test_warc_is_the_oracles(spark, data):
    assert sorted(values(registry.QUERIES["op12_warc"](spark, data), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), key=KEY) == sorted(oracle(data, "op12_warc"), key=KEY)


# 13. Cross-tokenizer alignment.


def brute_alignment(docs):
    """Token by token, with whole texts encoded by the libraries."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {c: chr(c) for c in plain} | {c: chr(256 + k) for k, c in enumerate(c for c in range(256) if c not in plain)}
    byte = {v: k for k, v in char.items()}
    rows, count = [], Counter()
    for doc, text in docs:
        row = {"doc": doc, "a": [], "b": [], "groups": [], "links": []}
        rows.append(row)
        if not text:
            continue
        x = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        y = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if not b"".join(t for _, t in x) == b"".join(t for _, t in y) == (" " + text).encode():
            continue
        row["a"], row["b"] = [i for i, _ in x], [i for i, _ in y]
        i = j = p = q = 0  # p, q: where x[i], y[j] begin
        group = ([], [])
        fresh = True, True
        while i < len(x):
            if fresh[0]:
                group[0].append(x[i][0])
            if fresh[1]:
                group[1].append(y[j][0])
            row["links"].append((x[i][0], y[j][0]))
            e, f = p + len(x[i][1]), q + len(y[j][1])
            fresh = e <= f, f <= e
            if e <= f:
                i, p = i + 1, e
            if f <= e:
                j, q = j + 1, f
            if e == f:
                row["groups"].append(group)
                group = ([], [])
        count.update(row["links"])
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    written = lambda r: hashlib.sha256(";".join("|".join(",".join(map(str, s)) for s in g) for g in r["groups"]).encode()).hexdigest() if r["a"] else ""
    return [(r["doc"], len(r["a"]), len(r["b"]), len(r["groups"]), len(r["links"]), sum(count[x] == most[x[1]] for x in r["links"]), sum(count[x] for x in r["links"]), written(r)) for r in rows]


COLUMNS = "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"


@pytest.mark.parametrize("size", [op13_token_alignment.SLICE, 200])
def test_alignment_is_brute_forces(spark, odd, size):
    found = op13_token_alignment.alignment(odd, op13_token_alignment.default_tokenizer(), op13_token_alignment.default_model(), size=size)
    assert [f"{n} {k}" for n, k in found.dtypes] == [f.replace("long", "bigint") for f in op13_token_alignment._OUT.split(", ")]
    want = brute_alignment([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sum(w[1] == 0 for w in want) == 4  # null, empty, null, and the space mark
    assert sorted(values(found, *COLUMNS), key=KEY) == sorted(want, key=KEY)


def test_alignment_of_the_documents(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert sorted(values(registry.QUERIES["op13_token_alignment"](spark, data), *COLUMNS)) == sorted(brute_alignment([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]))


def test_digests_of_long_documents_are_taken_in_parts(monkeypatch):
    import numpy as np

    monkeypatch.setattr(op13_token_alignment, "UNITS", 3)
    written, unit, at = pa.array(["a", "b", "c"]), np.array([0, 1, 2, 0, 1, 2, 0, 0, 1]), np.array([0, 7, 7, 8, 9])
    got = op13_token_alignment._digests(written, unit, at, np.array([True, False, True, False]))
    assert got == [hashlib.sha256(b"a;b;c;a;b;c;a").hexdigest(), "", hashlib.sha256(b"a").hexdigest(), ""]


def test_units_aligned_in_parts_are_alike(monkeypatch):
    p = op13_token_alignment.pair(op13_token_alignment.default_tokenizer(), op13_token_alignment.default_model())
    words = pa.array(["plain", "", "naïve", "x\u00a0y", "two  spaces", "日本語", "a\tb", "ﬁne", "end"] * 3)
    whole = p.aligned(words)
    monkeypatch.setattr(op13_token_alignment, "ALIGNED", 4)
    parts = p.aligned(words)
    assert {k: list(v) for k, v in parts.items() if k != "written"} == {k: list(v) for k, v in whole.items() if k != "written"}
    assert parts["written"].to_pylist() == whole["written"].to_pylist()


def test_rows_of_a_slice_are_bounded(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").coalesce(1)
    size = 1 << 18
    found = op13_token_alignment.slices(docs, op13_token_alignment.default_tokenizer(), op13_token_alignment.default_model(), size=size).toPandas()
    assert max(len(v) for c in op13_token_alignment._LISTS for v in found[c]) == op13_token_alignment.PART
    length = {r["doc_id"]: len((r["text"] or "").encode()) for r in docs.collect()}
    for _, rows in found.groupby("slice"):
        assert sorted(rows["place"]) == list(range(len(rows)))
        own = [d for ids in rows["doc_id"] for d in ids]
        assert len(own) == 1 or sum(length[d] for d in own) <= size


def test_alignment_of_an_empty_table(spark, odd):
    assert op13_token_alignment.alignment(odd.limit(0), op13_token_alignment.default_tokenizer(), op13_token_alignment.default_model()).count() == 0
    assert values(op13_token_alignment.alignment(odd.where("text IS NULL"), op13_token_alignment.default_tokenizer(), op13_token_alignment.default_model()), "n_a", "groups_sha256") == [(0, ""), (0, "")]


# Of earlier operators.


def test_texts_of_rows_without_ids_are_sent_once(spark):
    """n near copies whose ids are null send n texts, and are one class."""
    from vecloom.llm import op8_ngram_jaccard as op8

    for n in (20, 40):
        rows = [(None, " ".join([f"w{i}" for i in range(60)] + [f"own{k}"])) for k in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        hashed = df.withColumn("text_hash", F.unhex(F.sha2("text", 256)))
        member = hashed.select(F.monotonically_increasing_id().alias("rep"), F.col("text_hash").alias("key"), F.col("text_hash").alias("rep_hash"), "doc_id")
        assert op8._texts(hashed, member).count() == n
        assert values(op8.jaccard_join(df), "doc_id", "class_id", "n_links") == [(None, None, n - 1)] * n


def test_ids_of_texts_whose_tokens_span_spaces():
    from vecloom.llm import op1_token_ids

    path = op1_token_ids.default_tokenizer()
    t, e = Tokenizer.from_file(path), op1_token_ids.Encoder(path)
    texts = ["a \u00a0 \u00a0 b", "\u00a0 \u00a0 \u00a0 \u00a0 \u00a0", "x\u00a0 y", "plain words", None, "x \u00a0y \u00a0 \u00a0 \u00a0 \u00a0z"]
    ids, n = e.encode(pa.array(texts))
    want = [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, []) and e.spanned == ["\u00a0 "]
