"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over each text's bytes cuts it into chunks where the content says so, so that a passage that many
documents share is cut alike in all of them. A chunk seen in two documents or more is encoded once, by the task that
holds one of its documents, and its ids travel to the others; chunks of one document only are encoded in place.

Joins. The byte-level pre-tokenizer never lets a token reach from a character that is not white space into white space
that follows it, so such a place is a token boundary whatever surrounds it. Of a chunk only the stretch between its first
and last such places is encoded alone. At each join the text between two stretches is encoded anew together with the last
tokens of the one and the first of the other; where these do not come out as they were, more of both is taken, in the end
all of both. So a join is taken only once it agrees exactly.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import as_bytes, cut, hot_keys, slices, spread_join

#: Mean chunk length (a power of two) and the window of the rolling hash, in bytes.
MEAN, WINDOW = 1024, 32
#: Tokens to both sides of a join that are encoded again with it at first.
MARGIN = 4
END_OF_TEXT = "<|endoftext|>"
_GEAR = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SAFE = re.compile(rb"(?<=[!-~])[ \n]")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoding(path: str, special: str = END_OF_TEXT):
    """The tokenizer of a rank file; the special token takes the first free id and is found in texts."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})


def cuts(text: bytes) -> list[int]:
    """Chunk ends by content: after a byte whose last WINDOW bytes hash to 0 in the top bits, never inside a character."""
    if len(text) <= WINDOW:
        return [len(text)] if text else []
    buf = np.frombuffer(text, np.uint8)
    h = _GEAR[buf]
    width = 1
    while width < WINDOW:  # doubles the window: h(2w) = h(w) shifted by w places, plus h(w) of the bytes before
        h[width:] = h[width:] + (h[:-width] << np.uint64(width))
        width *= 2
    at = np.flatnonzero(h[WINDOW - 1 : -1] >> np.uint64(64 - MEAN.bit_length() + 1) == 0) + WINDOW
    at = at[(buf[at] & 0xC0) != 0x80]
    return [*at.tolist(), len(text)]


def core(chunk: bytes) -> tuple[int, int]:
    """Where the stretch that can be encoded alone begins and ends; equal if there is none."""
    first = _SAFE.search(chunk)
    if not first:
        return 0, 0
    begin, end = first.start(), first.start()
    tail = len(chunk)
    while tail > begin:  # the last safe place: back over the white spaces from the end
        tail = max(chunk.rfind(b" ", begin, tail), chunk.rfind(b"\n", begin, tail))
        if tail <= begin or 33 <= chunk[tail - 1] <= 126:
            break
    if tail > begin:
        end = tail
    return begin, end


def pieces(text: bytes) -> Iterator[tuple[bytes, bool]]:
    """The text in order as (span, whether it is a chunk's core). The other spans are the joins."""
    pending: list[bytes] = []
    at = 0
    for end in cuts(text):
        chunk = text[at:end]
        begin, stop = core(chunk)
        if begin == stop:
            pending.append(chunk)
        else:
            if span := b"".join([*pending, chunk[:begin]]):
                yield span, False
            yield chunk[begin:stop], True
            pending = [chunk[stop:]]
        at = end
    if span := b"".join(pending):
        yield span, False


def _hash(span: bytes) -> int:
    """Names a chunk by 64 bits, signed. Ids that are looked up by it are checked against the chunk's own bytes."""
    h = xxhash.xxh3_64_intdigest(span)
    return h - (1 << 64) if h >> 63 else h


def _found(enc, known: dict[int, list[int]], span: bytes) -> list[int] | None:
    ids = known.get(_hash(span))
    return ids if ids is not None and enc.decode_bytes(ids) == span else None


def encode_pieces(enc, text: bytes, known: dict[int, list[int]]) -> list[int]:
    """The ids of a text; a core in known costs a look-up and its joins, all other spans are encoded together."""
    whole_text = lambda b: enc.encode(b.decode(), allowed_special="all")
    if not known:
        return whole_text(text) if text else []
    ids: list[int] = []
    last: list[int] = []  # the ids of the stretch before, which ids end with
    run: list[bytes] = []
    for span, got in [*((s, _found(enc, known, s) if whole else None) for s, whole in pieces(text)), (b"", [])]:
        if got is None:
            run.append(span)
            continue
        between, run, margin = b"".join(run), [], MARGIN
        while True:
            tail, head = last[-margin:], got[:margin]
            every = len(tail) == len(last) and len(head) == len(got)
            try:
                anew = whole_text(enc.decode_bytes(tail) + between + enc.decode_bytes(head))
            except UnicodeDecodeError:  # the margin ends inside a character
                anew = None
            agrees = anew is not None and anew[: len(tail)] == tail and anew[len(anew) - len(head) :] == head and len(anew) >= len(tail) + len(head)
            if agrees or every:
                break
            margin *= 2
        ids = ids[: len(ids) - len(tail)] + anew + got[len(head) :] if not agrees else ids + anew[len(tail) :] + got[len(head) :]
        last = got if agrees else anew
    return ids


def _chunk_rows(batches):
    for b in batches:
        keys, owners = [], []
        for owner, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
            own = {_hash(s) for s, whole in pieces(t or b"") if whole}
            keys += own
            owners += [owner] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(owners, pa.int64())], names=["chunk", "owner"])


def _encode_chunks(path: str):
    def rows(batches):
        enc = encoding(path)
        for b in batches:
            chunks, ids = [], []
            for t, wanted in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                left = set(wanted)
                for span, whole in pieces(t or b""):
                    if whole and (h := _hash(span)) in left:
                        left.discard(h)
                        chunks.append(h)
                        ids.append(np.array(enc.encode(span.decode(), allowed_special="all"), np.uint32).astype(np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(ids, pa.binary())], names=["chunk", "ids"])

    return rows


def _encode_docs(path: str):
    def rows(batches):
        enc = encoding(path)
        kind = np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32
        for b in batches:
            texts = [t or b"" for t in as_bytes(b.column(1))]
            for s, e in slices(texts, 4 << 20):
                known = [{x["chunk"]: np.frombuffer(x["ids"], kind).tolist() for x in c or ()} for c in b.column(2).slice(s, e - s).to_pylist()]
                ids = [encode_pieces(enc, t, k) for t, k in zip(texts[s:e], known, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, shape=None, schema: str = "doc_id long, ids array<int>") -> DataFrame:
    """(doc_id, ids) for every row: the ids of the whole text; null and empty texts have none.

    The special token's string in a text becomes its id. Rows that repeat an id are encoded each by its own text, and
    rows without an id go by a hash of theirs; chunks are known by content, so neither can mix texts up. shape may map
    the stream of (doc_id, ids) Arrow batches to another schema inside the same tasks. Texts of any length are encoded
    whole; an empty table gives an empty one. path names a rank file; its vocabulary is used with the one pre-tokenizer
    that this module's safe places are made for.
    """
    path = path or default_ranks()
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("key", F.coalesce("doc_id", F.xxhash64("text")))
    dealt = base.repartition("key")  # both joins below read this one exchange, so both take all three columns
    found = base.select("key", "text").mapInArrow(_chunk_rows, "chunk long, owner long")
    shared = cut(found.groupBy("chunk").agg(F.count("*").alias("n"), F.min("owner").alias("home")).filter("n > 1"))
    wanted = shared.groupBy("home").agg(F.collect_list("chunk").alias("wanted"))
    once = dealt.join(wanted, F.col("key") == F.col("home")).select("text", "wanted", "doc_id", "key").mapInArrow(_encode_chunks(path), "chunk long, ids binary").groupBy("chunk").agg(F.first("ids").alias("ids"))
    given = spread_join(found, once, "chunk", hot_keys(shared, "chunk"), ["owner"]).groupBy("owner").agg(F.collect_set(F.struct("chunk", "ids")).alias("known"))
    joined = dealt.join(given, F.col("key") == F.col("owner"), "left").select("doc_id", "text", "known", "key")
    run = _encode_docs(path)
    return joined.mapInArrow((lambda batches: shape(run(batches))) if shape else run, schema)


def decode(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text): the texts of lists of ids, special tokens included, one row for each row of encoded.

    Null and empty lists give empty texts, bytes that are no UTF-8 the replacement sign. Lists of any length are decoded whole,
    repeated rows alike; an empty table gives an empty one, and other columns are not looked at. An id that the vocabulary
    lacks is an error.
    """
    path = path or default_ranks()

    def rows(batches):
        enc = encoding(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([enc.decode_bytes(x or []).decode(errors="replace") for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(rows, "doc_id long, text string")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(path: str | None = None):
    """A shape for encode(): counts and digests of the ids and of the text that they decode to."""
    path = path or default_ranks()

    def rows(batches):
        enc = encoding(path)
        names = np.array([str(k) for k in range(enc.n_vocab)], object)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b in batches:
            lists = b.column(1)
            flat, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            out = [[], []]
            for s, e in zip(at[:-1], at[1:], strict=True):
                out[0].append(sha(",".join(names[flat[s:e]]).encode()))
                out[1].append(sha(enc.decode_bytes(flat[s:e].tolist()).decode(errors="replace").encode()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(at).astype(np.int64)), pa.array(out[0]), pa.array(out[1])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows
