"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit, a logistic classifier over hashed byte n-grams (2 and 3 bytes of
the lower-cased text, everything but letters taken as a space) learns whether a text's language has the bit set. A
text's language is that of the codeword with the least weighted loss: the sum over the bits of a weight (how far the
classifier beats chance on its sample) times the logistic loss of the classifier's margin. The answer is ambiguous
if the runner-up's loss is close or if more bits disagree than the code can correct.

Codes: with up to 6 languages, all 2 ** (k - 1) - 1 ways to split them; beyond, random codewords of 10 log2(k) bits or
more, the best of several draws by least distance.

The classifiers are fitted on a sample of at most about `per_language` labelled rows of each language and `sample` rows
in all (what the driver holds is sample x BUCKETS numbers, however many languages there are), chosen by a hash of the
doc_id. Everything else covers all rows and whole texts; a prediction's only input is the text.

Defined results: a null text, or one without a letter, is `und` with score 0; without any labelled row all texts are
`und`; with one language all others are that language with score 1; rows with equal texts get equal answers; a null
doc_id is not held out and not learned from; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm._common import arrow_map

BUCKETS = 1 << 13
PER_LANGUAGE, SAMPLE = 500, 16_000
_ASCII = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def grams(text: str) -> np.ndarray:
    """Hashed 2- and 3-byte grams of a text."""
    b = np.frombuffer(b" ".join([b"", *text.lower().encode("utf-8", "replace").translate(_ASCII).split(), b""]), np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.int64)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    with np.errstate(over="ignore"):
        both = np.concatenate([two, three + np.uint32(0x10000000)]) * np.uint32(2654435761)
    return (both >> np.uint32(32 - 13)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k rows of +1 and -1."""
    if k <= 1:
        return np.ones((k, 1))
    if k <= 6:
        bits = 2 ** (k - 1) - 1
        return np.array([[-1.0 if i and (c + 1) >> (i - 1) & 1 else 1.0 for c in range(bits)] for i in range(k)])
    bits, rng, best, far = max(15, math.ceil(10 * math.log2(k))), np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (k, bits))
        code[0] = 1.0
        d = ((bits - code @ code.T) / 2 + np.eye(k) * bits).min()
        if d > far and (np.abs(code.sum(0)) < k).all():
            best, far = code, d
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def losses(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        g = grams(text)
        margin = self.bias + (self.weights[g].sum(axis=0) / len(g) if len(g) else 0)
        return (self.trust * np.logaddexp(0, -self.code * margin)).sum(axis=1) / self.trust.sum(), margin

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, ambiguous)."""
        if not self.languages or not has_letter(text):
            return "und", 0.0, True
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss, margin = self.losses(text)
        order = np.argsort(loss, kind="stable")
        p = np.exp(-(loss - loss[order[0]]) * self.code.shape[1])
        apart = int(((len(margin) - self.code @ self.code.T) / 2 + np.eye(len(loss)) * len(margin)).min())
        wrong = int((np.sign(margin) != self.code[order[0]]).sum())
        return self.languages[order[0]], float(p[order[0]] / p.sum()), bool(loss[order[1]] - loss[order[0]] < 0.1 or wrong > (apart - 1) // 2)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], steps: int = 250) -> Model:
    """rows: (language, buckets, counts). One logistic regression for each bit, all at once, by Adam."""
    languages = tuple(sorted({r[0] for r in rows}))
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, code, np.zeros((BUCKETS, 1), np.float32), np.zeros(1), np.ones(1))
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (_, at, n) in enumerate(rows):
        x[i, at] = n / max(1.0, n.sum())
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
    x *= scale
    at = np.array([languages.index(r[0]) for r in rows])
    share = 1.0 / np.bincount(at, minlength=len(languages))[at]
    share = (share / share.sum()).astype(np.float32)[:, None]
    goal = code[at].astype(np.float32)
    w, b = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for t in range(1, steps + 1):
        pull = -goal / (1 + np.exp(np.clip(goal * (x @ w + b), -30, 30))) * share
        for p, g, m1, m2 in ((w, x.T @ pull + 1e-5 * w, m, v), (b, pull.sum(axis=0), mb, vb)):
            m1 += 0.1 * (g - m1)
            m2 += 0.01 * (g * g - m2)
            p -= np.float32(0.05) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    right = (((x @ w + b) * goal > 0) * share).sum(axis=0)
    return Model(languages, code, w * scale[:, None], b.astype(np.float64), np.maximum(0.05, 2 * right - 1))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def learn(df: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model:
    """Fit on a sample of the rows that are not held out and have a label."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang")).filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return fit([])
    per_language = max(1, min(per_language, sample // len(sizes)))
    limits = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 30, math.ceil((1 << 30) * per_language / n)))))
    some = rows.filter(F.xxhash64("doc_id").bitwiseAND((1 << 30) - 1) < limits[F.col("lang")]).select("doc_id", "lang", "text")

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, at, n = [], [], []
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if has_letter(text):
                found, count = np.unique(grams(text), return_counts=True)
                lang.append(label)
                at.append(found.astype("<u2").tobytes())
                n.append(count.astype("<f4").tobytes())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], names=["lang", "at", "n"])

    got = sorted((r["lang"], bytes(r["at"]), bytes(r["n"])) for r in arrow_map(some, kernel, "lang string, at binary, n binary").collect())
    return fit([(lang, np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(n, "<f4")) for lang, at, n in got])


def identify(df: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each row."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        lang, score, vague = zip(*map(model.predict, batch.column(1).to_pylist()), strict=True)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(vague, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return arrow_map(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kernel, "doc_id long, lang_pred string, score double, ambiguous boolean")
