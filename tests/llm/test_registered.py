"""Registered queries that SQL cannot express, as they are registered, against plain Python."""

import hashlib
import re

import numpy as np

from parchment.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()


def test_mixing(spark, sf):
    docs = {r.doc_id: r for r in documents(spark, sf)}
    size = {i: len(WORD.findall(r.text or "")) for i, r in docs.items()}
    sources = sorted({r.source for r in docs.values()}, key=lambda s: (s is None, s))
    held = {s: sum(size[i] for i, r in docs.items() if r.source == s) for s in sources}
    weight = {s: [5, 2, 1][k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(held.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * held[s]}
        target |= {s: 2.0 * held[s] if over else level * weight[s] for s in over or free}
        left -= sum(target[s] for s in over)
        free -= over or free
    got = {r.doc_id: r for r in queries.op4_mixing(spark, sf).collect()}
    assert got.keys() == docs.keys() and all(r.size == size[i] and r.taken in (0, r.size, 2 * r.size) for i, r in got.items())
    for s in sources:
        mine = [got[i] for i, r in docs.items() if r.source == s]
        assert all(r.source_size == held[s] and abs(r.target - target[s]) <= 1e-6 * max(1, target[s]) for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(0.01 * target[s], max(r.size for r in mine))
    assert {r.doc_id: r.taken for r in queries.op4_mixing(spark, sf).collect()} == {i: r.taken for i, r in got.items()}


def test_nearest(spark, sf):
    rows = {r.vec_id: np.array(r.embedding, np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    found, hits = {}, 0
    for r in queries.op7_nearest(spark, sf).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found.keys() == {i for i in rows if i % 100 == 0}
    for q, mine in found.items():
        exact = lambda i: float(np.sqrt(((rows[i] - rows[q]) ** 2).sum()))  # noqa: E731, B023
        mine = sorted(mine)
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(s - exact(i)) < 1e-12 and i != q for _, i, s in mine)
        assert [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in sorted((exact(i), i) for i in rows if i != q)[:10]})
    assert hits >= 0.9 * 10 * len(found)


def test_bpe(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.no_truncation()
    tok.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in documents(spark, sf):
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op10_bpe(spark, sf).collect()} == want


def test_urls(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    got = {r.page_id: r for r in queries.op1_url_filter(spark, sf).collect()}
    assert got.keys() == pages.keys()
    free = {}
    for i, r in got.items():
        rest = pages[i].split("://", 1)[1] if pages[i] and "://" in pages[i] else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(x), x, v) for v, x in queries.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        assert (r.host, r.path) == (host, path) and (r.rule, r.verdict)[: 1 + bool(fits)] == ((max(fits)[1], max(fits)[2]) if fits else (None,))
        if not fits:
            free.setdefault(pages[i], set()).add(r.verdict)
    assert all(len(v) == 1 and v <= {"allow", "block"} for v in free.values())


def test_url_rules_are_the_contract_s(spark, tmp_path):
    """Rules and verdicts spelt out from the contract, not read from the code."""
    want = {
        "http://com/en/": ("com/en/", "block"), "http://a.b.com/en/x?y#z": ("com/en/", "block"), "http://notexample.com/en/7": ("com/en/", "block"), "http://example.com/en/6": ("com/en/", "block"),
        "http://example.com/en/7": ("example.com/en/7", "allow"), "HTTP://WWW.Example.COM/en/71": ("example.com/en/7", "allow"),
        "http://net/de/": ("net/de/", "allow"), "http://a.b.net/de/x?y#z": ("net/de/", "allow"), "http://notexample.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "HTTP://WWW.Example.NET/de/81": ("example.net/de/8", "block"),
        "http://org/es/": ("org/es/", "block"), "http://example.org/es/x?y#z": ("org/es/", "block"),
    }
    free = ["http://a.net/DE/1", "http://a.net/de", "http://a.org?/es/", "http://xcom/en/", "http://a.com.au/en/", "net/de/", None]
    rows = list(enumerate([*want, *free]))
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in queries.op1_url_filter(spark, str(tmp_path)).collect()}
    assert {u: (got[i].rule, got[i].verdict) for i, u in rows if u in want} == want
    assert len(got) == len(rows) and all(got[i].rule is None for i, u in rows if u not in want)
