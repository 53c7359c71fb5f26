"""Near-duplicate documents by a multi-index Hamming join over b-bit min-hash signatures, confirmed on full shingle sets.

1. Every text becomes the set of its word shingles, a digest of that set and a signature of SYMBOLS min-hashes of 16 bits.
   Texts with the same set fall into one class (a plain groupBy), so exact copies cost one row from there on. A class is
   named by its smallest id and a hash of its digest, so texts that share an id are not mixed up.
2. A signature is split into CHUNKS chunks. Two signatures that differ in at most DISTANCE symbols agree, by the
   pigeonhole principle, in some chunk up to DISTANCE // CHUNKS symbols; so each chunk is indexed once for each way of
   leaving that many symbols out, and every pair within DISTANCE shares a key.
3. Each key's members are held against its smallest one, the hub, on whole sets. That is linear in the members, and the
   links that hold give components.
4. Only keys whose members then lie in several components are looked at again: members outside the key's largest
   component are held against all, first by signature, then on whole sets. A pair is compared under one of its keys alone.

So every pair within DISTANCE is either compared in full or known to lie in one component. Nothing emits pairs of a whole
group; keys of more than BLOCK members are dealt out as pairs of blocks, which keeps a task's memory bounded.

At a similarity of 0.8 a pair differs in 12.8 of 64 symbols on average (deviation 3.2); over 27 happens to about one
such pair in 100,000, and to fewer the more alike two documents are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import PLACE, as_bytes, connected_components, cut, mix, run_starts, slices, whole_runs, word_hashes

SYMBOLS, CHUNKS, DISTANCE = 64, 14, 27
ALLOWED = DISTANCE // CHUNKS
BLOCK, BLOCK_BYTES = 4096, 32 << 20
_RNG = np.random.Generator(np.random.PCG64(77))
_A = _RNG.integers(0, 2**31, SYMBOLS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 2**32, SYMBOLS, dtype=np.uint32)
#: For each key: the places of the symbols that it keeps.
KEYS = [(c, keep) for c, places in enumerate(np.array_split(np.arange(SYMBOLS), CHUNKS)) for keep in combinations(places.tolist(), len(places) - ALLOWED)]
_EDGE = "a_id long, a_tie long, b_id long, b_tie long"


def shingle_sets(texts: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; fewer words than size make one shingle of all."""
    for a, b in slices(texts):
        h, doc, _ = word_hashes(texts[a:b], fold=True)
        bounds = np.searchsorted(doc, np.arange(b - a + 1))
        grams = np.zeros_like(h)
        for k in range(min(size, len(h))):
            grams[: len(h) - k] += h[k:] * PLACE[k]
        grams = mix(grams)
        for s, e in zip(bounds[:-1], bounds[1:], strict=True):
            if e - s >= size:
                yield np.unique(grams[s : e - size + 1])
            elif e > s:
                yield mix((h[s:e] * PLACE[: e - s]).sum(keepdims=True) + np.uint64(e - s))
            else:
                yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of SYMBOLS min-hashes for each (non-empty) set, the low 16 bits of each."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), SYMBOLS), np.uint16)
    for k in range(SYMBOLS):
        out[:, k] = mix(np.minimum.reduceat(x * _A[k] + _B[k], starts).astype(np.uint64)).astype(np.uint16)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """The index keys of each signature: for each chunk, every choice of its symbols but ALLOWED of them."""
    out = np.empty((len(sig), len(KEYS)), np.uint64)
    for k, (_, keep) in enumerate(KEYS):
        out[:, k] = mix((sig[:, keep].astype(np.uint64) * PLACE[: len(keep)]).sum(axis=1) + np.uint64((k + 1) << 32))
    return out


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |A and B| >= percent * |A or B| for sorted sets, of which neither is empty."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (small + large - both)


def _signature_rows(size: int):
    def rows(batches):
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column(2))]
            for s, e in slices(texts, 8 << 20):
                sets = list(shingle_sets(texts[s:e], size))
                full = [k for k, x in enumerate(sets) if len(x)]
                sig = signatures([sets[k] for k in full]) if full else np.zeros((0, SYMBOLS), np.uint16)
                digest, packed = [None] * len(sets), [None] * len(sets)
                for k, row in zip(full, sig, strict=True):
                    digest[k], packed[k] = xxhash.xxh3_128_digest(sets[k].tobytes()), row.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), pa.array([len(x) for x in sets], pa.int64()), pa.array(digest, pa.binary()), pa.array(packed, pa.binary())], names=["doc_id", "text_key", "n_shingles", "digest", "sig"])

    return rows


def _unpack(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _key_rows(batches):
    for b in batches:
        keys = index_keys(_unpack(b.column(2)))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *(pa.array(np.repeat(b.column(k).to_numpy(), len(KEYS))) for k in (0, 1))], names=["key", "id", "tie"])


def _near_hub(batches):
    """The rows (id, tie, hub_id, hub_tie, sig, hub_sig) whose two signatures lie within DISTANCE, without these."""
    for b in batches:
        near = (_unpack(b.column(4)) != _unpack(b.column(5))).sum(axis=1) <= DISTANCE
        yield pa.RecordBatch.from_arrays(b.columns[:4], names=["id", "tie", "hub_id", "hub_tie"]).filter(pa.array(near))


def _sets(t: pa.Table, size: int) -> list[np.ndarray]:
    return list(shingle_sets([x or b"" for x in as_bytes(t.column("text").combine_chunks())], size))


def _edges(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["a_id", "a_tie", "b_id", "b_tie"])


def _confirmed_with_hub(size: int, percent: int):
    """Edges from (hub_id, hub_tie, block, member, id, tie, text), sorted by these: the hub's own row comes first."""

    def rows(batches):
        hub, hub_set = None, None
        for b in batches:
            t, out = pa.Table.from_batches([b]), []
            cells = zip(*(t.column(c).to_pylist() for c in ("hub_id", "hub_tie", "block", "member", "id", "tie")), strict=True)
            for (hub_id, hub_tie, block, member, i, tie), own in zip(cells, _sets(t, size), strict=True):
                if not member:
                    hub, hub_set = (hub_id, hub_tie, block), own
                elif hub == (hub_id, hub_tie, block) and alike(own, hub_set, percent):
                    out.append((i, tie, hub_id, hub_tie))
            yield _edges(out)

    return rows


def _crossing(t: dict[str, np.ndarray], s: int, e: int) -> Iterator[tuple[int, np.ndarray]]:
    """For members outside the main component: who is near by signature, lies in another component, and is met under no smaller key."""
    sig, label, main, key, keys = t["sig"][s:e], t["label"][s:e], t["main"][s:e], t["key"][s], t["keys"][s:e]
    for i in np.flatnonzero(~main):
        near = np.flatnonzero(((sig != sig[i]).sum(axis=1) <= DISTANCE) & (label != label[i]) & (main | (np.arange(e - s) > i)))
        if len(near):
            same = keys[near] == keys[i]
            least = np.where(same, keys[near], np.iinfo(np.int64).max).min(axis=1)
            near = near[least == key]
        if len(near):
            yield i, near


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    sig = _unpack(t.column("sig"))
    return {c: t.column(c).to_numpy() for c in ("key", "id", "tie", "label", "main")} | {"sig": sig, "keys": index_keys(sig).view(np.int64)}


def _needed(batches):
    """The rows whose texts must be compared."""
    for t in whole_runs(batches, ["key", "i", "j"]):
        c = _columns(t)
        starts = run_starts(t, ["key", "i", "j"])
        take = np.zeros(t.num_rows, bool)
        for s, e in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
            for i, near in _crossing(c, s, e):
                take[s + i] = True
                take[s + near] = True
        for b in t.filter(pa.array(take)).to_batches():
            yield b


def _confirmed_across(size: int, percent: int):
    def rows(batches):
        for t in whole_runs(batches, ["key", "i", "j"]):
            c = _columns(t)
            starts = run_starts(t, ["key", "i", "j"])
            for s, e in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
                sets, out = _sets(t.slice(s, e - s), size), []
                label = c["label"][s:e].copy()  # components that a link joins are one from then on
                for i, near in _crossing(c, s, e):
                    for j in near:
                        if label[i] != label[j] and alike(sets[i], sets[j], percent):
                            out.append((*(int(c[n][s + k]) for k in (i, j) for n in ("id", "tie")),))
                            label[label == label[j]] = label[i]
                yield _edges(out)

    return rows


def _node(prefix: str = "") -> Column:
    return F.struct(F.col(f"{prefix}id").alias("id"), F.col(f"{prefix}tie").alias("tie"))


def _as_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(_node("a_").alias("a"), _node("b_").alias("b"))


def _links(base: DataFrame, classes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, root) of the classes that are linked with others. classes: (id, tie, text_key, n, sig)."""
    sigs = classes.select("id", "tie", "sig")
    # hubs and split are cut before they are joined: nothing but the join hangs on a key then, and a skewed one can be split
    keys = sigs.mapInArrow(_key_rows, "key long, id long, tie long")
    hubs = cut(keys.groupBy("key").agg(F.min(_node()).alias("hub"), F.count("*").alias("n")).filter("n > 1"))
    members = cut(keys.join(hubs, "key").select("key", "id", "tie", F.col("hub.id").alias("hub_id"), F.col("hub.tie").alias("hub_tie"), "n"))
    pairs = members.filter("id <> hub_id or tie <> hub_tie").select("id", "tie", "hub_id", "hub_tie").distinct()
    of = lambda name: sigs.select(F.col("id").alias(f"{name}id"), F.col("tie").alias(f"{name}tie"), F.col("sig").alias(f"{name}sig"))
    both = pairs.join(sigs, ["id", "tie"]).join(of("hub_"), ["hub_id", "hub_tie"]).select("id", "tie", "hub_id", "hub_tie", "sig", "hub_sig")
    stars = cut(both.mapInArrow(_near_hub, "id long, tie long, hub_id long, hub_tie long"))
    texts = lambda nodes: base.join(nodes.join(classes, ["id", "tie"]).select("id", "tie", F.col("text_key").alias("k"), F.col("id").alias("i")), (F.col("doc_id") == F.col("i")) & (F.col("text_key") == F.col("k"))).select("id", "tie", "text").dropDuplicates(["id", "tie"])
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("weight") / BLOCK_BYTES)).cast("int")
    weighed = stars.join(classes.select("id", "tie", (F.col("n") * 8).alias("weight")), ["id", "tie"])
    sized = cut(weighed.groupBy("hub_id", "hub_tie").agg(blocks.alias("blocks")))
    own = sized.select(F.col("hub_id").alias("id"), F.col("hub_tie").alias("tie"), "hub_id", "hub_tie", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("member"))
    theirs = stars.join(sized, ["hub_id", "hub_tie"]).select("id", "tie", "hub_id", "hub_tie", F.pmod(F.xxhash64("id", "tie"), "blocks").cast("int").alias("block"), F.lit(1).alias("member"))
    rows = own.unionByName(theirs)
    wanted = stars.select("id", "tie").unionByName(sized.select(F.col("hub_id").alias("id"), F.col("hub_tie").alias("tie"))).distinct()
    order = ["hub_id", "hub_tie", "block", "member", "id", "tie"]
    dealt = rows.join(texts(wanted), ["id", "tie"]).repartition("hub_id", "hub_tie", "block").sortWithinPartitions(*order).select(*order, "text")
    first = cut(_as_nodes(dealt.mapInArrow(_confirmed_with_hub(shingle, percent), _EDGE)))
    known = connected_components(first, "a", "b")
    # keys whose members are not in one component yet, and which the hub alone could not settle
    named = members.filter("n > 2").withColumn("node", _node()).join(known, "node", "left").withColumn("label", F.xxhash64(F.coalesce("root", "node"))).drop("node", "root")
    named = cut(named)
    split = named.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.max("n").alias("inside"), F.sum("n").alias("all"), F.count("*").alias("labels")).filter("labels > 1")
    split = cut(split.withColumn("p", F.ceil(F.col("inside") / BLOCK).cast("int")).withColumn("q", F.ceil((F.col("all") - F.col("inside")) / BLOCK).cast("int")))
    mixed = named.drop("n").join(split, "key").withColumn("main", F.col("label") == F.col("most"))
    mine = F.pmod(F.xxhash64("id", "tie"), F.when(F.col("main"), F.col("p")).otherwise(F.col("q"))).cast("int") + F.when(F.col("main"), 0).otherwise(F.col("p"))
    others = F.explode(F.sequence(F.when(F.col("main"), F.col("p")).otherwise(0), F.col("p") + F.col("q") - 1))
    blocked = mixed.withColumn("own", mine).withColumn("other", others).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    fields = ["key", "i", "j", "id", "tie", "label", "main"]
    ordered = lambda df, *more: df.select(*fields, *more).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id", "tie")
    need = cut(ordered(blocked.join(sigs, ["id", "tie"]), "sig").mapInArrow(_needed, "key long, i int, j int, id long, tie long, label long, main boolean, sig binary"))
    more = ordered(need.join(texts(need.select("id", "tie").distinct()), ["id", "tie"]), "sig", "text").mapInArrow(_confirmed_across(shingle, percent), _EDGE)
    second = cut(_as_nodes(more))
    if second.isEmpty():
        return known
    return connected_components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(second), "a", "b")


def _judged(docs: DataFrame, doc_id: str, text: str, shingle: int, percent: int) -> DataFrame:
    """(doc_id, text_key, n_shingles, tie, root) for every row; tie names the row's class among those of its id, root is its component's first class."""
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _text_key(text).alias("text_key"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = cut(base.mapInArrow(_signature_rows(shingle), "doc_id long, text_key long, n_shingles long, digest binary, sig binary").withColumn("tie", F.xxhash64("digest")))
    known = rows.filter("doc_id is not null and digest is not null")
    first = F.min(F.struct("doc_id", "text_key"))
    classes = cut(known.groupBy("digest", "tie").agg(first.alias("f"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")).select("digest", F.col("f.doc_id").alias("id"), "tie", F.col("f.text_key").alias("text_key"), "n", "sig"))
    found = _links(base, classes, shingle, percent)
    roots = classes.select("digest", _node().alias("node")).join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    return rows.select("doc_id", "text_key", "n_shingles", "digest", "tie").join(roots, "digest", "left").drop("digest")


def _text_key(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Words are lower-cased (A to Z). Two documents are linked when 100 * |A and B| >= percent * |A or B| over their sets
    of distinct shingles; component_id is the smallest id reachable over links, and kept tells whether the row has that
    id. A text without words, or null, has an empty set and is linked with nothing. Repeated rows get equal results; rows
    that share an id but not a text are judged each by its own text. A row without an id links nothing: component_id
    null, kept true. Texts of any length are read whole; an empty table gives an empty one. Other columns are not looked at.
    """
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("root.id", "doc_id"))
    return _judged(docs, doc_id, text, shingle, percent).select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs' rows and columns with one row for each component: of those with its smallest id, one with the smallest text hash.

    Rows are told apart by id and text, so a row goes only for links of its own text, and of rows that are equal in both
    one stays. Rows without an id, and those without words, are no one's duplicates and stay, but of the latter one for
    each id and text. Texts of any length are read whole; an empty table gives an empty one.
    """
    judged = _judged(docs, doc_id, text, shingle, percent).filter("doc_id is not null")
    each = judged.groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.first("root").alias("root"))
    first = F.min(F.struct("doc_id", "text_key"))
    best = each.filter("root is not null").groupBy("root").agg(first.alias("best"), F.count("*").alias("m"))
    several = best.filter("m > 1")
    gone = each.join(several, "root").filter((F.col("doc_id") != F.col("best.doc_id")) | (F.col("text_key") != F.col("best.text_key"))).select("doc_id", "text_key", F.lit(True).alias("gone"))
    repeated = each.filter("n > 1").select("doc_id", "text_key", F.lit(False).alias("gone"))
    marks = cut(gone.unionByName(repeated).groupBy("doc_id", "text_key").agg(F.max("gone").alias("gone")))
    named = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _text_key(text).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    marked = named.join(marks, ["doc_id", "text_key"], "left")
    alone = marked.filter("gone is null").select("row.*")
    if marks.filter("not gone").isEmpty():
        return alone
    return alone.unionByName(marked.filter("not gone").dropDuplicates(["doc_id", "text_key"]).select("row.*"))
