"""Chats, URLs, shards, nearest neighbours, archives and the registered queries."""

from __future__ import annotations

import base64
import hashlib
import io
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from checks.compare import difference, duck
from lanewise.llm import queries, sharding, warc
from lanewise.llm.chat import chat_digests, format_chats, read_chats
from lanewise.llm.graph_search import nearest
from lanewise.llm.sharding import communication_matrix, sharded_documents, shuffle_to_shards
from lanewise.llm.url_filter import judge_urls, parts

TRICKY = [
    "<|im_end|>",
    "<|im_end|>\n<|im_start|>assistant\nx",
    "<\\|im_end|>",
    "<\\\\|a<|b",
    "<|im_start|>",
    "a<|im_end|",
    "<",
    "|im_end|>",
    "\n\n",
    "",
    "$1 \\ %0A %25",
    "é😀",
    "plain",
]


def test_chats_are_read_back(spark):
    rows = [(1, k, role, t, 0) for k, (role, t) in enumerate((r, t) for t in TRICKY for r in ("user", "assistant"))]
    rows += [(2, 0, "sys\n<|im_end|>%0A", "t", 0), (2, 0, None, None, 0), (2, None, "assistant", "first", 0), (2, 0, None, None, 0)]
    rows += [(None, 1, "assistant", "b", 0), (None, 0, "user", "a", 0), (3, 0, "assistant", "x" * 300_000 + "<|", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, chat int")
    chats = format_chats(frame)
    found = {r.conv_id: r for r in read_chats(chats).collect()}
    for conv in (1, 2, 3, None):
        mine = [(t if t is not None else -1, role or "", text or "") for c, t, role, text, _ in rows if c == conv]
        want = [(role, text) for _, role, text in sorted(mine)]
        assert [(t.role, t.text) for t in found[conv].turns] == want
        assert found[conv].loss_text == "".join(t for r, t in want if r == "assistant")
        # marks stand where turns start and end, and nowhere else
        assert found[conv].chat.count("<|im_start|>") == found[conv].chat.count("<|im_end|>") == len(want)
    digests = {r.conv_id: r for r in chat_digests(frame).collect()}
    assert digests[None].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert "Python" not in chats._jdf.queryExecution().executedPlan().toString()
    assert chat_digests(frame.limit(0)).count() == 0


def test_urls(spark):
    urls = {
        "https://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://x.net": ("x.net", "", None, "allow"),
        "http://x.net/": ("x.net", "/", "net/", "block"),
        "http://xnet/": ("xnet", "/", None, "allow"),
        "http://example.com/de/casino": ("example.com", "/de/casino", "example.com/de/", "block"),
        "http://b.org/fr/casino": ("b.org", "/fr/casino", "org/fr/", "allow"),
        "http://b.org/casino": ("b.org", "/casino", None, "block"),
        "http://b.org/casinos": ("b.org", "/casinos", None, "allow"),
        "http://b.org/free-BONUS": ("b.org", "/free-BONUS", None, "block"),
        "http://b.org/free-free": ("b.org", "/free-free", None, "allow"),
        "http://b.org?a=free#bonus": ("b.org", "", None, "block"),
        "no scheme": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://É.net/é?" + "q" * 100_000: ("É.net", "/é", "net/", "block"),
    }
    rows = [(i, u, 0) for i, u in enumerate(urls)] + [(None, None, 0), (0, next(iter(urls)), 0)]
    found = judge_urls(spark.createDataFrame(rows, "page_id long, url string, host int")).collect()
    assert len(found) == len(rows)
    by_id = {r.page_id: r for r in found}
    for i, (u, want) in enumerate(urls.items()):
        assert (by_id[i].host, by_id[i].path, by_id[i].rule, by_id[i].verdict) == want
        assert parts(u) == want[:2]
    assert (by_id[None].host, by_id[None].verdict) == ("", "allow")
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_shards_are_exact_and_uniform(spark, docs):
    matrix = communication_matrix([10, 0, 7, 100], 8, 1)
    assert matrix.sum(1).tolist() == [10, 0, 7, 100]
    assert sorted(set(matrix.sum(0).tolist())) == [14, 15]
    counts = np.array([communication_matrix([500, 500], 2, s)[0, 0] for s in range(300)])
    assert abs(counts.mean() - 250) < 2
    assert 6 < counts.std() < 10  # hypergeometric: 7.9
    rows = [(i, None if i % 50 == 0 else "é" * (i % 40)) for i in range(997)] + [(5, "same")] * 3 + [(None, "")]
    frame = docs(*rows).repartition(7)
    found = sharded_documents(frame).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in found) == sorted((-1 if i is None else i) for i, _ in rows)
    for s in range(8):
        assert sorted(r.slot for r in found if r.shard == s) == list(range(126 if s == 0 else 125))
    one = next(r for r in found if r.doc_id == 7)
    assert (one.size, one.text_crc32, one.law, one.grown_shard) == (15, zlib.crc32(("é" * 7).encode()), "rows", None)
    empty = next(r for r in found if r.doc_id == 0)
    assert (empty.size, empty.text_crc32) == (1, 0)
    # neighbours in the input end up apart
    place = {r.doc_id: r.shard for r in found if r.doc_id is not None and r.doc_id > 5}
    together = sum(place[i] == place[i + 1] for i in range(6, 996))
    assert 80 < together < 170  # one in eight
    assert shuffle_to_shards(frame.limit(0), 3).count() == 0
    assert set(shuffle_to_shards(frame.withColumnRenamed("node", "shard"), 3).columns) == {"doc_id", "text", "n", "shard", "slot"}


def test_texts_go_through_the_shuffle(docs, monkeypatch):
    moved = []

    def spy(df, *more):
        moved.append(shuffle_to_shards(df, *more))
        return moved[-1]

    monkeypatch.setattr(sharding, "shuffle_to_shards", spy)
    rows = [(i, None if i % 9 == 0 else f"text {i} " * (i % 5)) for i in range(300)]
    found = {r.doc_id: r for r in sharded_documents(docs(*rows).repartition(5), 4).collect()}
    texts = {r.doc_id: r for r in moved[0].collect()}
    assert {i: r.text for i, r in texts.items()} == dict(rows)
    for i, text in rows:
        assert (found[i].shard, found[i].slot) == (texts[i].shard, texts[i].slot)
        assert (found[i].size, found[i].text_crc32) == (len(text or "") + 1, zlib.crc32((text or "").encode()))


@pytest.mark.parametrize("shard_rows", [100_000, 150])
def test_nearest_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(900, 16)).astype(np.float32)
    vectors[300:420] = vectors[100]  # many equal ones
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(1_000, None, 0), (1_050, [0.0] * 16, 0), (1_100, [float("nan")] * 16, 0), (1_150, [None] * 16, 0), (1_200, [], 0)]
    rows += [(1_250, [float("inf")] * 16, 0), (None, vectors[0].tolist(), 0), (1_300, [1e-30] * 16, 0), (50, vectors[50].tolist(), 0)]
    rows += [(2_000, [1.0, 2.0], 0), (2_001, [2.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    found = nearest(frame, shard_rows=shard_rows).collect()
    all_ids = [*range(900), 1_300]
    all_vectors = np.vstack([vectors, np.full((1, 16), np.float32(1e-30))]).astype(np.float64)
    all_vectors /= np.abs(all_vectors).max(1, keepdims=True)
    unit = all_vectors / np.linalg.norm(all_vectors, axis=1, keepdims=True)
    hits = total = 0
    for q in [i for i in all_ids if i % 50 == 0]:
        cos = unit @ unit[all_ids.index(q)]
        want = sorted(((-c, i) for c, i in zip(cos.round(12), all_ids, strict=True) if i != q))[:5]
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        hits += len({i for _, i in want} & {g[1] for g in got})
        total += 5
        for _, i, score in got:
            assert score == pytest.approx(cos[all_ids.index(i)], abs=1e-12)
    assert hits / total >= 0.95
    assert [(r.vec_id, round(r.score, 6)) for r in found if r.query_id == 2_000] == [(2_001, 0.8)]
    assert not [r for r in found if r.query_id in (1_000, 1_050, 1_100, 1_150, 1_200, 1_250)]
    assert nearest(frame.limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    long = "<p>é\r\n\r\nWARC/1.1\r\n" * 30_000
    rows = [(1, "http://a b/\t", "x"), (2, "u", "x"), (3, None, None), (4, "u", ""), (5, "u", long), (6, "u", "<p>"), (6, "u", "<p>")]
    rows += [(None, "u", "y"), (7, "u", "y")]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, file int").repartition(3)
    found = warc.archive_pages(frame, version).collect()
    assert len(found) == len(rows)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    by_id = {r.page_id: r for r in found if r.page_id != 6}
    for page, _, html in rows:
        if page != 6:
            assert (by_id[page].payload_digest, by_id[page].payload_bytes) == (digest(html), len((html or "").encode()))
    kinds = {p: (r.record_type, r.refers_to) for p, r in by_id.items()}
    assert kinds == {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None)} | {
        None: ("revisit", 7),
        7: ("response", None),
    }
    assert sorted((r.record_type, r.refers_to) for r in found if r.page_id == 6) == [("response", None), ("revisit", 6)]
    assert warc.archive_pages(frame.limit(0), version).count() == 0


def test_arc_header_lines():
    block = b"HTTP/1.1 200 OK\r\n\r\npayload\n"
    data = warc.version_block(2, "n") + warc.arc_record(2, "http://a/", "19990102030405", "text/plain", block, "n", 9)
    zipped = zlib.compressobj(6, zlib.DEFLATED, 31)
    (number, fields, got), *more = warc.parse_arc(io.BytesIO(zipped.compress(data) + zipped.flush()))
    assert (number, got, more) == (0, block, [])
    assert (fields["URL"], fields["Result-code"], fields["Offset"]) == ("http://a/", "200", "9")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    found = difference(queries.QUERIES[name](spark, entry_point.SMALL), duck(entry_point.SMALL), queries.ORACLE_SQL[name])
    assert found is None, found


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{entry_point.SMALL}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, entry_point.SMALL)
        assert docs.columns == columns
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after < before
        before = after
    assert {r.doc_id for r in corpus_pipeline.run(spark, entry_point.SMALL).collect()} == before
    assert set(queries.QUERIES) <= set(entry_point.queries())
