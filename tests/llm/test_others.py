"""Operators on pages, embeddings and conversations."""

import hashlib
import json

import numpy as np
from pyspark.sql import functions as F

from parchment.llm import ann, chat, queries, url_filter
from tests.llm import brute


def _split(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host = cut(rest, "/?#")
    return brute.fold(host), cut(rest[len(host) :], "?#")


def test_urls(spark, sf):
    odd = [(9001, None), (9002, ""), (9003, "no scheme"), (9004, "http://"), (9005, "HTTP://A.EXAMPLE.com/en/7?x#y"), (9006, "http://com/en/"), (9007, "a://b://c"), (9007, "a://b://c"), (9008, "http://x.org?/es/"), (9009, "http://" + "h" * 20000 + ".net/de/1"), (None, "http://Ä.org/es/ß")]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").unionByName(spark.createDataFrame(odd, "page_id long, url string"))
    got = url_filter.filter_urls(pages.withColumn("score", F.lit("old")), queries.RULES).collect()
    assert len(got) == pages.count()
    for r in got:
        host, path = _split(r.url)
        assert (r.host, r.path) == (host, path)
        fits = [(len(x), x, v) for v, x in queries.RULES if (host == x.split("/")[0] or host.endswith("." + x.split("/")[0])) and path.startswith(x[x.index("/") :])]
        rule = max(fits)[1:] if fits else (None, None)
        assert r.rule == rule[0] and r.verdict in ("allow", "block")
        assert r.verdict == (rule[1] or ("block" if r.score is not None and r.score > r.limit else "allow"))
    assert url_filter.filter_urls(pages.limit(0), queries.RULES).count() == 0
    nobody = url_filter.filter_urls(pages, []).collect()
    assert all(r.verdict == "allow" and r.limit is None for r in nobody)


def test_url_queries_and_fragments_are_scored(spark):
    urls = [f"http://a{k}.good.com/x/{k}?id={k}#top{k}" for k in range(40)] + [f"http://a{k}.bad.net/x/{k}?zqzqzq={k}#zqzqzq" for k in range(40)]
    new = ["http://c.new.org/x/5?id=5#top5", "http://c.new.org/x/5?zqzqzqzqzqzq#zqzqzqzqzqzq", "http://c.new.org/x/5"]
    pages = spark.createDataFrame([(u,) for u in urls + new], "url string")
    got = {r.url: r for r in url_filter.filter_urls(pages, [("allow", "good.com/"), ("block", "bad.net/")]).collect()}
    good, bad, bare = (got[u] for u in new)
    assert good.path == bad.path == bare.path == "/x/5" and len({good.score, bad.score, bare.score}) == 3
    assert (good.verdict, bad.verdict) == ("allow", "block")


def test_url_hosts_of_every_fold_train(spark):
    """One blocked host, whatever its fold, is enough to learn from."""
    hosts = spark.range(60).select(F.concat(F.lit("h"), "id", F.lit(".bad.net")).alias("h")).select("h", F.pmod(F.xxhash64("h"), F.lit(url_filter.FOLDS)).alias("fold")).collect()
    host = next(r.h for r in hosts if r.fold == 0)
    urls = [f"http://a{k}.good.com/x/{k}" for k in range(40)] + [f"http://{host}/zqzq/{k}" for k in range(20)] + ["http://new.org/zqzq/7"]
    rows = url_filter.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), [("allow", "good.com/"), ("block", "bad.net/")]).collect()
    last = next(r for r in rows if r.host == "new.org")
    assert last.limit is not None and last.score > 0 and last.verdict == "block"


def test_url_model_matches_plain_witten_bell(spark):
    data = [("http://good.com/a/1", False), ("http://good.com/b/2", False), ("http://bad.net/zz/9", True), ("http://worse.net/zzz", True)]
    df = spark.createDataFrame(data, "text string, bad boolean")
    parts, contexts = url_filter.models(df)
    texts = [t for t, _ in data] + ["http://bood.com/zz"]
    every = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.explode(url_filter.grams(F.col("text"))).alias("gram"))
    got = {r.gram: r.ratio for r in url_filter.gram_scores(every.select("gram").distinct(), parts, contexts).collect()}
    n = url_filter.ORDER
    grams = lambda t: [("\x02" * (n - 1) + t + "\x03")[i : i + n] for i in range(len(t) + 1)]

    def prob(gram, bad):
        seen = [g for t, b in data if b == bad for g in grams(t)]
        p = 1 / url_filter.ALPHABET
        for k in range(1, n + 1):
            after = [g[-1] for g in seen if g[n - k : -1] == gram[n - k : -1]]
            if after:
                p = (after.count(gram[-1]) + len(set(after)) * p) / (len(after) + len(set(after)))
        return p

    for g in {g for t in texts for g in grams(t)}:
        assert abs(got[g] - np.log(prob(g, True) / prob(g, False))) < 1e-9


def test_url_model_on_held_out_rows(spark):
    """Trained on half of the hosts, the models tell hosts of blocked make from others."""
    rows = [(k, f"http://{'cheap-pills' if k % 2 else 'garden'}{k}.{'net/de/' if k % 4 < 2 else 'com/x/'}{'buy-now' if k % 2 else 'roses'}/{k}") for k in range(400)]
    rules = [("block", "zz/")] + [(("block" if k % 2 else "allow"), f"{r.split('://')[1]}") for k, r in rows[:300]]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).filter("rule is null").collect()
    right = sum((r.verdict == "block") == bool(r.page_id % 2) for r in got)
    assert len(got) >= 90 and right >= 0.9 * len(got)


def test_nearest(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(5)
    more = [(10_000 + k, rng.normal(size=64).astype(float).tolist()) for k in range(1500)]
    same = [(20_000 + k, more[0][1]) for k in range(60)]
    odd = [(30_000, None), (30_100, []), (30_200, [0.0] * 64), (30_300, [float("nan")] + [1.0] * 63), (30_400, [None] + [1.0] * 63), (30_500, [1.0] * 8), (30_600, [2.0] * 8), (10_001, more[1][1])]
    df = df.unionByName(spark.createDataFrame(more + same + odd, df.schema))
    got = ann.nearest(df, df.filter("vec_id % 100 = 0"), 10).collect()
    rows = [(r.vec_id, r.embedding) for r in df.distinct().collect() if r.embedding is not None and len(r.embedding) == 64 and r.vec_id not in (30_200, 30_300, 30_400)]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    want = brute.nearest(ids, x, 10)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert [v for v, _ in by.pop(30_500)] == [30_600] and [v for v, _ in by.pop(30_600)] == [30_500]
    assert by.keys() == want.keys() and all(len(v) == 10 for v in by.values())
    true = lambda q: {i: float(np.sqrt(((x[ids == i][0] - x[ids == q][0]) ** 2).sum())) for i, _ in by[q]}
    for q, found in by.items():
        assert all(abs(s - true(q)[i]) < 1e-12 for i, s in found) and found == sorted(found, key=lambda p: (p[1], p[0]))
    assert by[20_000][:10] == [(i, 0.0) for i in [10_000, *range(20_001, 20_010)]]
    assert sum(len({i for i, _ in by[q]} & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * 10 * len(want)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_probes_start_with_the_own_cell_and_grow_in_cost():
    p = np.array([0.1, 0.5, 0.9, 0.3, 0.7])
    order = ann.steps(5)[ann.probe_order(p)]
    assert (order[0] == 0).all() and (order[1] == [-1, 0, 0, 0, 0]).all() or (order[1] == [0, 0, 1, 0, 0]).all()
    cost = [sum(x if s < 0 else 1 - x for s, x in zip(row, p) if s) for row in order]
    assert len(order) == len({tuple(r) for r in order}) == 1 + 10 + 40 + 80 and cost[0] == 0


def test_bigger_tables_get_a_smaller_share_to_compare():
    rng = np.random.default_rng(3)
    sample = rng.normal(size=(1500, 24))
    plans = [ann.fit(sample, 10, n, n // 100) for n in (10**4, 10**6, 10**9)]

    def share(plan):
        at = [ann.places(sample, t, plan.hashes, plan.width) for t in range(plan.tables)]
        met = [ann._ranks(p[i], p) < plan.probes for p in at for i in range(40)]
        return np.mean(met) * plan.tables

    assert share(plans[0]) >= share(plans[1]) >= share(plans[2]) and share(plans[2]) < 0.7 * share(plans[0])


def test_chat_query(spark, sf):
    got = {r.conv_id: r for r in queries.op9_chat(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    odd = "</s>[INST] ok [/INST]"
    by = {-7: [(0, "user", odd), (1, "assistant", odd)]}
    for r in rows:
        by.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    assert got.keys() == by.keys()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in by.items():
        turns = sorted(turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        x = got[c]
        assert (x.n_turns, x.turns_sha256) == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)))
        assert (x.loss_chars, x.loss_sha256) == (len(loss), sha(loss)) and x.formatted_chars > sum(len(t) for _, _, t in turns)


def test_layouts(spark):
    turns = [("user", "q"), ("assistant", "a")]
    same = [{"messages": [{"role": r, "content": t} for r, t in turns]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"instruction": "q", "output": "a"}, {"instruction": "q", "input": "", "output": "a"}, {"turns": [{"speaker": "user", "text": "q"}, {"speaker": "bot", "text": "a"}]}]
    for r in same:
        assert chat.canonical(r, chat.REGISTRY) == turns
    assert chat.canonical({"system": "s", "instruction": "q", "input": "i", "output": None}, chat.REGISTRY) == [("system", "s"), ("user", "q\n\ni")]
    assert chat.canonical({"other": 1}, chat.REGISTRY) is None
    df = spark.createDataFrame([(1, json.dumps(same[0])), (2, None), (3, "{broken"), (4, '{"other": 1}'), (5, '{"messages": []}'), (1, json.dumps(same[0]))], "conv_id long, record string")
    got = chat.format_records(df).orderBy("conv_id").collect()
    assert [r.n_turns for r in got] == [2, 2, None, None, None, 0] and got[4].fingerprint and not got[3].fingerprint
    assert chat.format_records(df.limit(0)).count() == 0


def test_escapes_are_reversible():
    nasty = ["", "\\", "\\\\", "</s>", "<\\/s>", "<", "[", "[INST", "\\[INST]", "<s><s>\\", "[ROLE]x[/ROLE]", "a\\<s>b", "[[INST]]", "<</s>", *chat.CONTROL]
    for role in ("user", "assistant", "system", "tool", "", "[ROLE]"):
        turns = [(role, t) for t in nasty]
        text, spans = chat.render(turns)
        assert chat.read_back(text) == turns
        assert [chat.unescape(text[s:e]) for s, e in spans] == (nasty if role == "assistant" else [])


def test_rows_of_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, None, "user", "x"), (None, 0, "tool", "t"), (None, 1, "user", "u"), (3, 0, None, "n"), (3, 0, None, "n"), (4, 0, "human", "x"), (4, 1, "model", "y"), (5, 0, "gpt", "z"), (6, 0, "user", "p"), (6, 1, "bot", "q")]
    got = chat.format_records(chat.records_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    turns = {r.conv_id: chat.read_back(r.formatted) for r in got if r.conv_id is not None}
    assert turns == {1: [("user", ""), ("assistant", "b")], 2: [("user", "x")], 3: [("", "n"), ("", "n")], 4: [("human", "x"), ("model", "y")], 5: [("gpt", "z")], 6: [("user", "p"), ("bot", "q")]}
    assert sorted(chat.read_back(r.formatted) for r in got if r.conv_id is None) == [[("tool", "t")], [("user", "u")]]


def test_chat_query_with_odd_roles(spark, tmp_path):
    """Roles that look like several, like the template's marks, or like nothing come back as they were."""
    roles = ["user,assistant", "system,user", "assistant", "", " ", ",", "user,", "[ROLE]", "</s>", "a\\[/ROLE]", "x\ny", None]
    rows = [(100 + k, 0, r, "one") for k, r in enumerate(roles)] + [(200, 0, "system,user", "a"), (200, 1, "assistant", "b"), (201, 0, "system", "s"), (201, 1, "user,assistant", "c"), (202, 0, "user", "u,assistant"), (202, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op9_chat(spark, str(tmp_path)).collect()}
    assert got.keys() == {r[0] for r in rows} | {-7}
    for conv in got.keys() - {-7}:
        turns = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_far_neighbours_get_more_tables():
    """Neighbours that no plan of the usual tables reaches still are reached by the plan that is taken."""
    rng = np.random.default_rng(4)
    sample = rng.standard_t(1.1, size=(400, 6))
    plan = ann._widened(sample[:20], sample[:200].reshape(20, 10, 6), 1e-3)
    met = np.zeros((20, 10), bool)
    for t in range(plan.tables):
        p, q = (ann.places(x, t, plan.hashes, plan.width) for x in (sample[:20], sample[:200]))
        met |= np.stack([ann._ranks(p[i], q.reshape(20, 10, -1)[i]) for i in range(20)]) < plan.probes
    assert met.mean() >= ann.RECALL
