"""The pipeline, stage by stage, against brute force on each stage's own input."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from premia.llm import bpe, mixing, quality
from premia.llm._common import written
from test_llm import WORDS, counts_of, fingerprint, least, removed


def test_stages(spark, sf):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(corpus_pipeline.tokenizer_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
        steps.append(docs.toPandas())
        if name != "tokens":
            assert docs.columns == columns
    start = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    verdict = quality.scores(spark.read.parquet(f"{sf}/documents.parquet")).toPandas()
    base = {i for i, t in zip(start["doc_id"], start["text"]) if (c := counts_of(t))[0] < 10 or 100 * c[4] > 20 * c[0]}
    assert set(steps[0]["doc_id"]) == set(verdict[verdict["kept"]]["doc_id"]) and not base & set(steps[0]["doc_id"])

    kept = steps[0].sort_values("doc_id").reset_index(drop=True)
    fps = [fingerprint(t) for t in kept["text"]]
    comp = least([(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4], len(fps))
    assert set(steps[1]["doc_id"]) == {kept["doc_id"][c] for c in comp}

    rows = list(zip(steps[1]["doc_id"], steps[1]["text"]))
    want = {r[0]: r for r in removed(rows)}
    after = dict(zip(steps[2]["doc_id"], steps[2]["text"]))
    assert set(after) == set(want)
    for i, (_, n, gone, _, sha) in want.items():
        left = after[i].encode()
        if n - gone == len(left):  # no character was cut
            assert hashlib.sha256(left).hexdigest() == sha
    assert (steps[2]["n_chars"] == steps[2]["text"].str.len()).all()

    frame = spark.createDataFrame(steps[2])
    plan = {r["doc_id"]: r["copies"] for r in mixing.plan(frame).collect()}
    assert Counter(steps[3]["doc_id"]) == Counter({k: v for k, v in plan.items() if v})
    assert all(len(WORDS.findall(t)) > 0 for t in steps[3]["text"])

    end = steps[4]
    assert Counter(zip(end["doc_id"], map(tuple, end["ids"]))) == Counter((i, tuple(lib.encode(t, add_special_tokens=False).ids)) for i, t in zip(steps[3]["doc_id"], steps[3]["text"]))
    assert sorted(end["text"]) == sorted(steps[3]["text"])


def test_stages_on_an_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
    assert docs.count() == 0


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, repeated rows and ids, a very long text and clashing names, through all five stages."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(3000)]

    def prose(n):
        w = [rng.choice(vocabulary) for _ in range(n)]
        return "\n".join(" ".join(w[i : i + 12]).capitalize() + "." for i in range(0, n, 12))

    one, two, long = prose(120), prose(90), prose(60_000)
    rows = [(1, one, "en", "s"), (1, one, "en", "s"), (2, one, "en", None), (None, two, None, "s"), (None, two, None, "s"), (3, two + "\n" + prose(60), "en", "t"), (4, long, "en", "t"), (5, long[:200_000] + prose(50), None, "u"), (6, None, "en", "s"), (7, "", None, None), (8, "x", "en", "s"), (None, None, None, None), (9, prose(100), "en", "s"), (9, prose(100), "de", "s"), ((1 << 63) - 1, prose(80), "en", "t"), (-4, prose(80), None, "t")]
    docs = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["mix_row", "mix__time", "dedup_n", "Dedup_h", "cut_left", "cut_DOC", "__q_n_words", "__keep", "__row", "doc", "row", "size", "copies", "a.b", "s"]
    docs = docs.withColumns({c: F.lit(None).cast("string") if k % 2 else F.lit(k) for k, c in enumerate(names)})
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, "unused"))
        kept.append(docs.select("doc_id", "text").collect())
        if name != "tokens":
            assert docs.columns == columns
    assert all(r["text"] for r in kept[0]) and len(kept[0]) == 12  # the texts with words stay, also as repeated rows
    assert Counter(r["doc_id"] for r in kept[1]) == Counter([1, None, 3, 4, 5, 9, 9, (1 << 63) - 1, -4])
    left = {r["doc_id"]: r["text"] for r in kept[2]}
    assert left[4] == long and len(left[5]) < 1000 and len(kept[2]) == len(kept[1])
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept[4]) == sorted((r["doc_id"] or 0, r["text"]) for r in kept[3]) and kept[3]



def test_tokens_has_one_python_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "one two", "en", None), (2, None, None, "s"), (3, "", None, None), (None, "ünï\n x", "en", "s")], "doc_id long, text string, lang string, source string")
    out = corpus_pipeline.tokens(spark, docs, "unused")
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = bpe.decode(bpe.encode(docs, corpus_pipeline.tokenizer_path()).drop("text"), corpus_pipeline.tokenizer_path(), text_col="text")
    want = two.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")
    assert out.dtypes == want.dtypes and Counter(map(str, out.collect())) == Counter(map(str, want.collect()))
