"""Quality rules: how much of a text lies inside n-grams and lines that it repeats."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import PLACE, as_bytes, mix, slices, word_hashes

#: Share of the word characters that duplicated n-grams of each length, or duplicated lines, may cover.
LIMITS = {5: 0.40, 8: 0.32, 10: 0.30}
LINE_LIMIT = 0.30
#: The base rule: fewest words, most percent of words in repeated windows of BASE_WINDOW words.
BASE_WORDS, BASE_PERCENT, BASE_WINDOW = 20, 30, 8
_SYMBOLS, _SPACES = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_REST = bytes(range(0x80, 0xC0))
_LONGS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")


def _covered(h: np.ndarray, doc: np.ndarray, n: int, grams: np.ndarray) -> np.ndarray:
    """Marks the words inside n-word windows that their text holds twice or more."""
    inside = np.zeros(len(h), bool)
    if len(h) < n:
        return inside
    at = np.flatnonzero(doc[: len(h) - n + 1] == doc[n - 1 :])
    key = mix(grams[at]) ^ mix(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key, where = key[order], at[order]
    same = (key[1:] == key[:-1]) & (doc[where[1:]] == doc[where[:-1]])
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    step = np.zeros(len(h) + 1, np.int32)
    step[where[twice]] += 1
    np.subtract.at(step, where[twice] + n, 1)
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[bytes], lengths: tuple[int, ...] = tuple(LIMITS)) -> dict[str, np.ndarray]:
    """The measures of some texts (UTF-8). Rolling hashes give the n-grams, byte counts and line sets the rest."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in (*_LONGS, *(f"dup_{k}_chars" for k in lengths))}
    for k, t in enumerate(texts):
        plain = t.translate(None, _REST)
        out["word_chars"][k] = len(plain.translate(None, _SPACES))
        out["n_symbols"][k] = len(plain) - len(plain.translate(None, _SYMBOLS))
        seen: set[bytes] = set()
        for line in t.split(b"\n"):
            if not line.strip(_SPACES):
                continue
            if line in seen:
                out["n_dup_lines"][k] += 1
                out["dup_line_chars"][k] += len(line.translate(None, _SPACES + _REST))
            seen.add(line)
    for a, b in slices(texts):
        h, doc, size = word_hashes(texts[a:b])
        out["n_words"][a:b] = np.bincount(doc, minlength=b - a)
        grams = np.zeros_like(h)
        for k in range(1, max(*lengths, BASE_WINDOW) + 1):
            if k > len(h):
                break
            grams[: len(h) - k + 1] += h[k - 1 :] * PLACE[k - 1]
            if k in lengths or k == BASE_WINDOW:
                hit = _covered(h, doc, k, grams)
                if k == BASE_WINDOW:
                    out["n_repeat_words"][a:b] = np.bincount(doc[hit], minlength=b - a)
                if k in lengths:
                    out[f"dup_{k}_chars"][a:b] = np.bincount(doc[hit], weights=size[hit], minlength=b - a).astype(np.int64)
    return out


def judge(m: dict[str, np.ndarray], limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept)"""
    failed = (m["n_words"] < BASE_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    chars = np.maximum(m["word_chars"], 1)
    good = m["dup_line_chars"] <= line_limit * chars
    for n, most in limits.items():
        good &= m[f"dup_{n}_chars"] <= most * chars
    return failed, good & ~failed


def report_type(lengths=tuple(LIMITS)) -> str:
    return ", ".join([*(f"{k} long" for k in _LONGS), *(f"dup_{k}_chars long" for k in lengths), "base_failed boolean, kept boolean"])


def repetition(text, limits: dict[int, float] = LIMITS, line_limit: float = LINE_LIMIT):
    """A struct column of the measures and the verdict for a text column.

    A null or empty text has no words: all measures 0, base_failed, not kept. A text of any length is measured whole.
    Equal rows get equal results; other columns play no part.
    """
    lengths = tuple(limits)

    @F.arrow_udf(f"struct<{report_type(lengths).replace(' long', ':long').replace(' boolean', ':boolean')}>")
    def report(column: pa.Array) -> pa.Array:
        m = measure([t or b"" for t in as_bytes(column)], lengths)
        failed, kept = judge(m, limits, line_limit)
        m |= {"base_failed": failed, "kept": kept}
        return pa.StructArray.from_arrays([pa.array(v) for v in m.values()], names=list(m))

    return report(text)


def quality_filter(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns only."""
    return docs.withColumn("__repetition", repetition(F.col(text))).filter("__repetition.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
