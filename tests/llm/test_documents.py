"""Operators on documents, each against a plain Python version, with odd rows among the real ones."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchment.llm import bpe, common, line_dedup, mixing, near_dedup, pii, quality, queries, sharding
from parchment.llm.common import n_words
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark, sf):
    odd = spark.createDataFrame([(i, t, None, "odd" if i else None, 0) for i, t in brute.ODD], SCHEMA)
    return spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd)


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality(docs, rows, none):
    got = docs.select("text", quality.repetition(F.col("text")).alias("r")).select("text", "r.*").collect()
    for r in got:
        n, chars, symbols, dup, repeat = brute.quality(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.kept and r.base_failed)
        for k in quality.LIMITS:
            assert r[f"dup_{k}_chars"] == brute.covered(r.text, k)
    out = quality.quality_filter(docs.withColumn("r", F.lit(1)))
    assert out.columns == [*docs.columns, "r"] and out.count() == sum(r.kept for r in got)
    assert quality.quality_filter(none).count() == 0


def test_quality_keeps_good_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    good = docs.join(labels.filter("quality = 1"), "doc_id").select(quality.repetition(F.col("text")).alias("r")).select("r.*")
    long = good.filter("n_words >= 20")
    assert long.filter("not kept").count() <= 0.01 * long.count()


def test_near_duplicates(spark, docs, rows, none):
    rng = random.Random(4)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    family = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(9999)}"
        family.append((3000 + k, " ".join(w)))
    extra = spark.createDataFrame(family, "doc_id long, text string")
    for n in (4, 5):
        want = brute.components([*rows, *family], n)
        got = near_dedup.near_duplicates(docs.select("doc_id", "text").unionByName(extra), shingle=n).collect()
        assert len(got) == len(rows) + len(family)
        for r in got:
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert len({c for _, c in want.values()}) < len(want)
    assert near_dedup.near_duplicates(none).count() == 0
    left = near_dedup.deduplicate(docs.select("doc_id", "text").unionByName(extra)).select("doc_id").collect()
    assert {r.doc_id for r in left} == {c for _, c in want.values()} | {None}


def test_deduplicate_goes_by_rows(spark):
    """An id that two texts share loses only the text that is a duplicate, and of equal rows one stays."""
    rng = random.Random(6)
    one, other, third = (" ".join(f"w{rng.randrange(9999)}" for _ in range(60)) for _ in range(3))
    rows = [(3, one), (5, one + " more"), (5, other), (7, third), (7, third), (8, third.upper()), (9, ""), (9, ""), (10, None), (None, one), (None, one), (11, other), (4, "Shared Class"), (4, "shared class")]
    got = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("__gone", F.lit(1))).collect()
    left = sorted(((r.doc_id or -1, r.text) for r in got), key=str)
    assert left[:2] == [(-1, one), (-1, one)] and {t for i, t in left if i == 4} < {"Shared Class", "shared class"}
    assert sorted((i, t) for i, t in left if i not in (-1, 4, 10)) == sorted([(3, one), (5, other), (7, third), (9, "")]) and len(left) == 8
    plain = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.component_id for r in plain if r.doc_id == 5) == [3, 5] and sum(r.kept for r in plain if r.doc_id == 7) == 2


def test_links_that_no_hub_has(spark):
    """A chain in which neighbours alone are alike, so that hubs cannot link it, is one component all the same."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(900)]
    docs = [(100 - k, " ".join(words[12 * k : 12 * k + 200])) for k in range(40)]
    want = brute.components(docs, 5)
    assert {c for _, c in want.values()} == {61}
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Groups beyond a block are dealt out as pairs of blocks and lose nothing."""
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    docs = [(k, " ".join(f"x{rng.randrange(99)}" if rng.random() < 0.02 else w for w in base)) for k in range(90)]
    want = brute.components(docs, 5)
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_every_pair_under_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**32, (300, near_dedup.SYMBOLS), dtype=np.uint32)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)] += 1
    x, y = near_dedup.index_keys(a), near_dedup.index_keys(b)
    assert all(set(p) & set(q) for p, q in zip(x, y, strict=True))


@pytest.mark.parametrize("many", [10**6, 10])
def test_connected_components(spark, monkeypatch, many):
    monkeypatch.setattr(common, "MANY", many)
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {v: v for e in edges for v in e}
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.node: r.root for r in got} == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}
    assert len(got) == len({r.node for r in got})


def test_pii(spark, docs, none):
    text = "mail a.b12@x.com and 4785380592391139, 4785-3805-9239-1139 on 1999-12-31 DE89370400440532013000 ip 1.2.3.4 999.1.1.1 +1 (743) 555-3824 ssn 123-45-6789 tok 24be64439e3e49cf46b2d7c90f3602a3d0b907ff 1999-13-01 4785380592391138"
    df = spark.createDataFrame([(1, text), (2, text), (3, None), (4, ""), (5, "plain words")], "doc_id long, text string")
    one, two, three, four, five = pii.pseudonymise(df, "corpus", found="found").orderBy("doc_id").collect()
    assert one.text == two.text and three.text is None and three.found is None and four.text == "" and five.text == "plain words"
    assert [x.kind for x in one.found] == ["email", "card", "card", "date", "iban", "ip", "phone", "ssn", "secret"]
    assert all(text[x.start : x.start + x.length] != one.text[x.start : x.start + x.length] for x in one.found if x.kind in ("email", "card", "date", "iban"))
    assert one.text.endswith("1999-13-01 4785380592391138") and " 999.1.1.1 " in one.text
    card = one.text[one.found[1].start :][:16]
    assert sum(int(c) * (1 + k % 2) - 9 * (k % 2 and int(c) > 4) for k, c in enumerate(reversed(card))) % 10 == 0
    assert one.text[one.found[2].start :][:19].replace("-", "") == card
    again = pii.pseudonymise(df, key="other").orderBy("doc_id").first()
    assert again.text != one.text
    assert pii.pseudonymise(none, "k").count() == 0 and pii.pseudonymise(docs.withColumn("found", F.lit(1)), "k").columns == [*docs.columns, "found"]


def test_pii_secrets_of_any_case(spark):
    """Secrets in capitals and in both cases are found and keep their case; those in small letters keep their pseudonym."""
    low, digits = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "0123456789" * 4
    mixed = low[:20].upper() + low[20:]
    values = [low, low.upper(), mixed, digits, "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"]
    not_hex = "TOKEN " + "ABCDEF" * 6 + " " + low.upper()[:31] + " " + low.upper() + "G"
    df = spark.createDataFrame([*enumerate(f'TOKEN = "{v}" end' for v in values), (9, not_hex)], "doc_id long, text string")
    *got, plain = pii.pseudonymise(df, "corpus", found="found").orderBy("doc_id").collect()
    assert plain.text == not_hex and plain.found == []
    new = [r.text[9:49] for r in got]
    for r, v, w in zip(got, values, new, strict=True):
        assert [tuple(x) for x in r.found] == [("secret", 9, 40)] and r.text == f'TOKEN = "{w}" end' and w != v
    assert len(set(new)) == len({w.lower() for w in new}) == len(values)
    assert set(new[1]) | set(new[4]) <= set("0123456789ABCDEF") and set(new[0]) <= set("0123456789abcdef")
    assert all((a.isdigit(), a.isupper(), a.lower() <= "f") == (b.isdigit(), b.isupper(), b.lower() <= "f") for a, b in zip(mixed, new[2], strict=True))
    old = df.filter("doc_id = 0").select(pii.feistel(F.lit(low), "corpus|secret", hexadecimal=True)).first()[0]
    assert new[0] == old


def test_pii_is_a_permutation(spark):
    two = spark.range(10000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("v"))
    assert two.select(pii.feistel(F.col("v"), "k").alias("w")).distinct().count() == 10000
    assert spark.range(899 * 7).select(pii.feistel_number(F.col("id"), 899, 7, "k").alias("w")).filter("w between 0 and 899 * 7 - 1").distinct().count() == 899 * 7
    days = spark.range(72900).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    assert days.select(pii.date(F.col("v"), "k").alias("w")).distinct().count() == 72900


VALUES = {
    "email": ["a.b12@x.com", "Some-One_9%+z" + "q" * 90 + "@mail.example.co.uk"], "card": ["4785380592391139", "4785-3805-9239-1139", "4785 3805 9239 1139"], "iban": ["DE89370400440532013000", "GB82WEST12345698765432"],
    "ip": ["1.2.3.4", "255.0.0.255"], "ssn": ["123-45-6789", "899-99-9999", "001-01-0001", "667-01-0001"], "phone": ["+1 (743) 555-3824", "743-555-3824", "+91-743.555.3824"],
    "date": ["1999-12-31", "0001-01-01", "0097-01-01", "0103-08-28", "0103-08-29", "9882-09-22", "9990-05-05", "9999-12-31", "2024-02-29"], "secret": ["24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF", "24BE64439E3E49cf46b2d7c90f3602a3d0b907ff", "0123456789" * 4],
}


def test_pii_query_matches_plain_feistel(spark, tmp_path):
    """The registered query on values of all kinds, against permutations worked out sign by sign."""
    rows = [(k, kind, v, f"<{v}> and {v}, end") for k, (kind, v) in enumerate((kind, v) for kind, vs in VALUES.items() for v in vs)]
    odd = [(900, "no date 0000-05-05 nor 1999-02-30 nor 1.2.3.456"), (901, None), (902, ""), (900, "no date 0000-05-05 nor 1999-02-30 nor 1.2.3.456")]
    spark.createDataFrame([*((k, t) for k, _, _, t in rows), *odd], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_pii(spark, str(tmp_path)).collect()}
    key = queries.pii_key(spark)
    for k, kind, v, t in rows:
        new = brute.pseudonym(kind, v, key)
        assert (got[k].text, got[k].n_found) == (f"<{new}> and {new}, end", 2), v
        assert got[k].found == f"{kind}:1:{len(v)}|{kind}:{len(v) + 7}:{len(v)}" and (len(new) == len(v) or kind == "ip") and new != v
    assert (got[900].text, got[900].n_found, got[901].text, got[902].text) == (odd[0][1], 0, None, "")


def test_pii_dates_keep_four_digits(spark):
    days = spark.range(3_652_059).filter("id < 60000 or id > 3590000 or id % 97 = 0").select(F.date_format(F.date_add(F.lit("0001-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("v"))
    r = days.select("v", pii.date(F.col("v"), "k").alias("w")).agg(F.count("*").alias("n"), F.count_distinct("w").alias("m"), F.count_if(~F.col("w").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")).alias("odd"), F.min("w").alias("a"), F.max("w").alias("b")).first()
    assert r.n == r.m and r.odd == 0 and r.a >= "0001-01-01" and r.b <= "9999-12-31"
    first = spark.range(37_495).select(pii.feistel_number(F.col("id"), 5, 7499, "k").alias("w"))
    assert first.distinct().count() == 37_495


def test_mixing(docs, none):
    got = mixing.mix(docs, n_words(F.col("text")), [5.0, 2.0, 1.0], 1.5).toPandas()
    words = {}
    for s, t in docs.select("source", "text").collect():
        words[s] = words.get(s, 0) + len(brute.words(t))
    want = brute.targets(words, [5.0, 2.0, 1.0], 1.5)
    got["source"] = got["source"].astype(object).where(got["source"].notna(), None)
    assert len(got) == docs.count() and got.copies.between(0, 2).all()
    for s, g in got.groupby(got["source"].map(lambda v: v if v is not None else "<null>")):
        s = None if s == "<null>" else s
        assert g.source_size.iloc[0] == words[s] and abs(g.target.iloc[0] - want[s]) < 1e-6 * max(1, want[s])
        assert abs((g["size"] * g.copies).sum() - want[s]) <= max(0.02 * want[s], 30, g["size"].max() / 2 if g["size"].max() > 0.2 * words[s] else 0)
        assert abs((g["size"] * g.rate).sum() - want[s]) <= 1e-6 * max(1.0, want[s])
    again = mixing.mix(docs.repartition(7), n_words(F.col("text")), [5.0, 2.0, 1.0], 1.5).toPandas()
    key = ["doc_id", "size", "copies"]
    assert sorted(map(tuple, got[key].fillna(-1).values)) == sorted(map(tuple, again[key].fillna(-1).values))
    out = mixing.mixed(docs.withColumn("copies", F.lit("x")), n_words(F.col("text")), [5.0, 2.0, 1.0], 1.5)
    assert out.columns == [*docs.columns, "copies"] and out.filter("source = 'src0'").count() == got[got.source == "src0"].copies.sum()
    assert mixing.mix(none, n_words(F.col("text")), [5.0], 1.5).count() == 0


def test_sharding(docs, none, monkeypatch):
    for rows in (50_000, 10):
        monkeypatch.setattr(sharding, "ROWS", rows)
        got = sharding.shard(docs.withColumn("slot", F.lit("old")), 7).toPandas()
        n = docs.count()
        sizes = got.groupby("shard").size()
        assert len(got) == n and set(sizes) <= {n // 7, n // 7 + 1} and len(sizes) == 7
        assert all(sorted(g) == list(range(len(g))) for _, g in got.groupby("shard")["slot"])
        again = sharding.shard(docs.repartition(5), 7).toPandas()
        pick = lambda p: sorted(p[["doc_id", "shard", "slot"]].dropna().astype(int).drop_duplicates("doc_id", keep=False).values.tolist())
        assert pick(got) == pick(again)
    assert sharding.shard(none, 3).count() == 0


def test_communication_matrix_is_hypergeometric():
    m = np.array([sharding.matrix(np.array([5, 3, 4]), np.array([6, 6]), s) for s in range(4000)])
    assert (m.sum(axis=2) == [5, 3, 4]).all() and (m.sum(axis=1) == [6, 6]).all()
    assert np.abs(m.mean(axis=0) - [[2.5, 2.5], [1.5, 1.5], [2, 2]]).max() < 0.05
    assert abs(m[:, 0, 0].var() - 5 * 0.25 * 7 / 11) < 0.05


@pytest.mark.parametrize(("good", "bad", "n"), [(40, 60, 30), (5, 3, 6), (10**10, 3 * 10**10, 2 * 10**9), (7, 10**12, 10**11)])
def test_draws_of_any_size_follow_the_law(monkeypatch, good, bad, n):
    """The inverted law, which is used beyond numpy's range, has the exact mean and variance (and, where small, frequencies)."""
    rng = np.random.Generator(np.random.PCG64(11))
    if good + bad < 10**9:
        class Big:
            random = staticmethod(rng.random)
        want = np.random.default_rng(4).hypergeometric(good, bad, n, 40_000)
        monkeypatch.setattr(sharding, "_small", lambda total: False)
        got = np.array([sharding.draw(Big, good, bad, n) for _ in range(40_000)])
        assert np.abs(np.bincount(got, minlength=n + 1) - np.bincount(want, minlength=n + 1)).max() < 5 * 40_000**0.5
    else:
        got = np.array([sharding.draw(rng, good, bad, n) for _ in range(300)])
    p, total = good / (good + bad), good + bad
    mean, var = n * p, n * p * (1 - p) * (total - n) / (total - 1)
    assert abs(got.mean() - mean) < 6 * (var / len(got)) ** 0.5 + 1e-9 and 0.6 * var <= got.var() <= 1.5 * var
    assert got.min() >= max(0, n - bad) and got.max() <= min(n, good)


def test_sharding_query(spark, docs, rows, tmp_path, monkeypatch):
    """The registered query: every column of its contract; one row that fills a third of the table is dealt out evenly."""
    import zlib

    hot = [(555, "the same row again")] * 600
    docs.select("doc_id", "text").unionByName(spark.createDataFrame(hot, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(sharding, "ROWS", 100)
    monkeypatch.setattr(sharding, "COPIES", 50)
    got = queries.op6_sharding(spark, str(tmp_path)).collect()
    want = sorted([((i or -1), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in [*rows, *hot]])
    assert sorted((r.doc_id or -1, r["size"], r.text_crc32) for r in got) == want
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    by = {k: sorted(r.slot for r in got if r.shard == k) for k in range(24)}
    assert all(v == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    same = [sum(r.doc_id == 555 for r in got if r.shard == k) for k in range(24)]
    assert sum(same) == 600 and min(same) >= 5 and max(same) <= 50


def test_line_dedup(spark, docs, rows, none, monkeypatch):
    passage = "The first whole sentence of a passage. Of it. A second one follows with some more words! Then this is the very end of it all here. "
    odd = [(7001, f"Own words come before {passage}and own words after"), (7002, f"Others here. {passage}And after?"), (7003, passage), (7003, passage), (7003, passage), (7004, f"x\n\n{passage.strip()}\n\ny"), (7005, "Of it. x")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    plain = lambda df: sorted((r.doc_id, r.text, [tuple(x) for x in r.removed]) for r in df.collect() if r.doc_id is not None and r.text is not None)
    for unit, least in (("sentence", 20), ("line", 1), ("sentence", 1)):
        want = sorted(brute.line_dedup([*rows, *odd], unit, least))
        assert plain(line_dedup.deduplicate_units(docs, unit=unit, min_words=least)) == want
    want = sorted(brute.line_dedup([*rows, *odd]))
    assert sum(len(s) for _, _, s in want) > 50 and [t for i, t, _ in want if i == 7003] == ["", "", ""] and (7005, "Of it. x", []) in want
    assert [t for i, t, _ in want if i == 7002] == ["Others here. The first whole sentence of a passage. And after?"]
    monkeypatch.setattr(line_dedup, "COPIES", 2)  # many equal rows are given out in parts
    assert plain(line_dedup.deduplicate_units(docs)) == want
    assert line_dedup.deduplicate_units(none).count() == 0


def test_line_dedup_paragraphs(spark):
    two = "A first paragraph\nof two lines with words enough to go as one that repeats here and there and so on.\n\n"
    got = line_dedup.deduplicate_units(spark.createDataFrame([(1, two + "own"), (2, f"Head\n\n{two}tail")], "doc_id long, text string"), unit="paragraph", min_words=15).orderBy("doc_id").collect()
    assert [r.text for r in got] == [two + "own", "Head\n\ntail"] and [tuple(x) for x in got[1].removed] == [(1, 6, 6 + len(two))]


def test_line_dedup_takes_short_lines(spark, docs, rows, tmp_path):
    """The registered query removes repeats of lines of 1 to 4 words as well."""
    short = [(8001, "All rights reserved.\nfirst"), (8002, "x\nall  RIGHTS reserved.\nfirst\n\n"), (8003, "first")]
    docs.select("doc_id", "text").unionByName(spark.createDataFrame(short, "doc_id long, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((i, t, len(s), "|".join(f"{u}:{a}:{b}" for u, a, b in s)) for i, t, s in brute.line_dedup([*rows, *short], "line", 1))
    got = queries.QUERIES["op8_line_dedup_all"](spark, str(tmp_path)).filter("doc_id is not null and text is not null").collect()
    assert sorted((r.doc_id, r.text, r.n_removed, r.removed) for r in got) == want
    assert (8002, "x\n\n", 2, "1:2:24|2:24:30") in want and (8003, "", 1, "0:0:5") in want


def test_bpe(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x" * 5000 + " " * 3000 + "y z  \n\n  w", "trail   ", "it's we'll 漢字\n" * 300, "<|endo" + "ftext|>" * 500, " '" * 3000]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(texts * 2, 5000)), "doc_id long, text string"))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = docs.collect()
    ids = [e.ids for e in tok.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((r.doc_id or -1, len(i), sha(",".join(map(str, i))), sha(r.text or "")) for r, i in zip(rows, ids, strict=True))
    got = bpe.encode(docs, shape=bpe.digests(), schema=bpe.DIGEST).collect()
    assert sorted((r[0] or -1, *r[1:]) for r in got) == want
    back = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((r.doc_id or -1, r.text or "") for r in rows)
    assert bpe.encode(none).count() == 0


def test_chunks_follow_content():
    rng = random.Random(3)
    shared = " ".join(f"word{rng.randrange(10**6)}" for _ in range(900)).encode()
    cores = [{s for s, whole in bpe.pieces(f"head {k} ".encode() * (k + 1) + shared) if whole} for k in range(4)]
    assert len(set.intersection(*cores)) >= 4
