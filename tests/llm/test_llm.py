"""Operators of the llm subpackage against brute force, the libraries, and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from premia.llm import bpe, compact_windows, langid, mixing, quality, queries, simhash, spotsigs, sstable, suffix_dedup, token_count
from premia.llm.components import connected

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def table(spark, rows):
    """documents from (doc_id, text) or longer rows, with a column that clashes with internal names."""
    full = [(*r, *(None,) * (4 - len(r)))[:4] for r in rows]
    df = spark.createDataFrame([(i, t, lang, s, len(t) if t is not None else None) for i, t, lang, s in full], SCHEMA)
    return df.withColumns({"size": F.lit(1), "fp": F.lit("x"), "part": F.lit(None).cast("string"), "label": F.lit(2)})


def awkward():
    """Nulls, empties, repeats, ties, a long text, white space, special strings, non-Latin scripts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, long = prose(120), prose(6000)
    rows = [(0, base), (1, base), (2, base + " " + prose(5)), (3, prose(30) + " " + " ".join(base.split()[20:90]) + " " + prose(25)), (4, None), (5, ""), (6, " \n\t "), (None, base), (7, "漢字 и кириллица é <|endoftext|> x<|endoftext|>"), (8, long), (9, long[:3000] + prose(40)), (10, "x"), (11, "a b c"), (11, "a b c"), (12, "AAA bbb\nAAA bbb\n\nAAA bbb"), (13, "x" * 5000), (14, "\U0001f600" * 80), (15, "!!! ??? ***"), (16, "a  b   c \n d"), (None, None), (None, "only here and without an id to go by"), (None, "another one that has no id of its own")]
    return [(i, t, "en" if k % 2 else None, ["s", None, "z"][k % 3]) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, awkward()).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, awkward()).limit(0)


# -- tokens ----------------------------------------------------------------------------------------------------------
PIECES = st.lists(st.sampled_from(["a", "b", " ", "\n", "  ", "'s", "'re", "the", "é", "漢", "1", "23", "՘", "\U0001f600", "<|endoftext|>", "aaaa", "\x1c", "\x85", "　", "ing", "\t", "!!", "ZZ", "-", "\r\n", ","]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(PIECES, st.integers(1, 9))
def test_automaton_is_the_library(pieces, chunk):
    from tokenizers import Tokenizer

    lib, a, text = test_automaton_is_the_library.__dict__.setdefault("lib", Tokenizer.from_file(PATH)), bpe.load(PATH), "".join(pieces)
    ids = lib.encode(text, add_special_tokens=False).ids
    assert a.encode(text) == ids and token_count.count(a, text, chunk) == len(ids)
    assert a.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    assert np.frombuffer(sstable.library_encoder(PATH).encode([text])[0], "<u2").tolist() == ids


def test_automaton_survives_full_tables(lib, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 50)
    monkeypatch.setattr(bpe, "MAX_WORDS", 20)
    import json

    a = bpe.Automaton(json.load(open(PATH, encoding="utf-8")))
    for _, text, *_ in awkward():
        assert a.encode(text) == lib.encode(text or "", add_special_tokens=False).ids


def test_bpe_query(docs, none, lib):
    got = {(r["doc_id"], r["ids_sha256"], r["n_tokens"], r["decoded_sha256"]) for r in bpe.digests(docs, PATH).collect()}
    want = set()
    for i, text, *_ in awkward():
        ids = lib.encode(text or "", add_special_tokens=False).ids
        want.add((i, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), len(ids), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want and bpe.digests(none, PATH).count() == 0
    back = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert {(r["doc_id"], r["decoded"]) for r in back.collect()} == {(i, t or "") for i, t, *_ in awkward()}


def test_token_counts(docs, none, lib):
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.token_counts(docs, PATH).collect())
    want = sorted((str(i), len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, *_ in awkward())
    assert got == want and token_count.token_counts(none, PATH).count() == 0


def test_sstable(spark, docs, none, lib, tmp_path):
    path = f"file://{tmp_path}/shards"
    sstable.write_shards(docs, path, PATH, shard_bytes=4_000)
    got = sstable.with_starts(sstable.read_shards(spark, path)).orderBy("start").collect()
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(got) == len(awkward())
    want = Counter()
    for i, t, *_ in awkward():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        want[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    found = {(r["doc_id"], tuple(r["ids"])) for r in sstable.lookup(spark, path, [3, 11, None, 999]).collect()}
    assert {k for k, _ in found} == {3, 11, None} and (11, tuple([*lib.encode("a b c").ids, 2])) in found
    reader = sstable.Table(spark, path)
    assert len(reader.files) > 3 and len(reader.get(11)) == 2 and len(reader.get(None)) == 4 and reader.get(999) == []
    assert [x.tolist() for x in reader.get(10)] == [[*lib.encode("x").ids, 2]]
    ranged, whole = sstable.Table(spark, path), sum(f[2] for f in reader.files)
    ranged.get(3)
    assert 0 < ranged.bytes_read < whole / 2 and len(ranged.heads) < len(ranged.files)
    sstable.write_shards(none, f"file://{tmp_path}/none", PATH)
    assert sstable.read_shards(spark, f"file://{tmp_path}/none").count() == 0


def test_sstable_blocks():
    w, rows = sstable.Writer(3), []
    for i in range(5000):
        rows += w.add(sstable.key_of(i * 7 - 9000), np.arange(i % 40, dtype=np.uint32) + 70_000 * (i % 2))
    s = sstable.Shard(b"".join(r + b"\n" for r in [*rows, *w.finish()]))
    assert s.docs == 5000 and s.number == 3 and len(s.blocks) > 3
    assert [sstable.id_of(k) for k, _ in s.entries()] == [i * 7 - 9000 for i in range(5000)]
    for i in (0, 1, 77, 4999):
        assert s.get(i * 7 - 9000)[0].tolist() == (np.arange(i % 40) + 70_000 * (i % 2)).tolist()
    assert s.get(5) == []


# -- quality ---------------------------------------------------------------------------------------------------------
def counts_of(text):
    w = WORDS.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    c, cover = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            cover |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(cover)


def test_quality_counts(spark, none):
    extra = [(100, "a b c d e f a b c d e f a b c d e g " * 3), (101, "q " * 40), (102, "one two three four five six seven eight nine ten eleven")]
    rows = awkward() + extra
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.scores(table(spark, rows)).collect())
    want = sorted((str(i), *(c := counts_of(t)), c[0] < 10 or 100 * c[4] > 20 * c[0]) for i, t, *_ in rows)
    assert got == want and quality.scores(none).count() == 0


def test_quality_em_recovers_the_classes():
    rng = random.Random(3)
    n, truth = Counter(), {}
    for _ in range(4000):
        good = rng.random() < 0.9
        v = tuple(None if rng.random() < 0.2 else (0 if rng.random() < (0.001 if good else 0.5) else 1) for _ in range(6))
        n[v] += 1
        truth.setdefault(v, Counter())[good] += 1
    model = quality.fit(sorted(n.items(), key=str))
    right = sum(c[quality.posterior(*model, v) >= 0.5] for v, c in truth.items())
    assert right > 0.97 * 4000 and abs(model[0] - 0.9) < 0.05


def em_by_arrays(patterns, rounds):
    """The same model written with products of probabilities instead of log-odds."""
    votes = np.array([[np.nan if x is None else x for x in v] for v, _ in patterns], float)
    m, cast, bad = np.array([c for _, c in patterns], float)[:, None], ~np.isnan(votes), votes == 0
    good = np.clip((np.nansum(votes, axis=1) / cast.sum(axis=1)) ** 3, 0.02, 0.98)[:, None]
    for _ in range(rounds):
        prior = ((good * m).sum() + 1) / (m.sum() + 2)
        of_good = ((good * m * bad).sum(axis=0) + 1) / ((good * m * cast).sum(axis=0) + 2)
        of_bad = (((1 - good) * m * bad).sum(axis=0) + 1) / (((1 - good) * m * cast).sum(axis=0) + 2)
        like = [np.where(cast, np.where(bad, p, 1 - p), 1).prod(axis=1)[:, None] for p in (of_good, of_bad)]
        good = prior * like[0] / (prior * like[0] + (1 - prior) * like[1])
    return good[:, 0]


def test_quality_verdict_is_that_of_em(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    counted = quality.with_counts(docs).filter("NOT base_failed")
    seen = counted.select("doc_id", *(v.alias(k) for k, v in quality.votes().items())).join(quality.scores(docs).select("doc_id", "posterior", "kept"), "doc_id").join(labels, "doc_id", "left").toPandas()
    patterns = Counter(tuple(None if pd.isna(x) else int(x) for x in row) for row in seen[list(quality.RULES)].itertuples(index=False))
    want = dict(zip(patterns, em_by_arrays(list(patterns.items()), quality.ROUNDS)))
    for row, posterior in zip(seen[list(quality.RULES)].itertuples(index=False), seen["posterior"]):
        assert abs(want[tuple(None if pd.isna(x) else int(x) for x in row)] - posterior) < 1e-9
    vetoed = (seen[list(quality.RULES)] == 0).any(axis=1)
    assert (seen["kept"] & vetoed).sum() > 20 and (~seen["kept"]).sum() > 20  # neither all-must-pass nor keep-all
    fired = (seen[list(quality.RULES)] == 0).sum()
    assert (fired > 0).sum() >= 6
    assert seen[seen["quality"] == 1]["kept"].mean() > 0.99 and seen[seen["quality"] == 0]["kept"].mean() < 0.1


def test_quality_classes_cannot_change_places():
    """A start that takes bad for good ends with the class whose rules vote bad more often as the bad one."""
    n = Counter({(0, 0, 1): 900, (0, 0, 0): 60, (1, 1, 1): 40})
    good, rules = quality.fit(sorted(n.items()))
    assert sum(b - g for b, g in rules) > 0 and quality.posterior(good, rules, (1, 1, 1)) > 0.5


def test_quality_filter_keeps_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = quality.filter_documents(docs.withColumn("__q_n_words", F.lit(1)))
    assert kept.columns == [*docs.columns, "__q_n_words"] and kept.count() == quality.scores(docs).filter("kept").count()


def test_quality_sql(spark, sf):
    got = queries.op2_quality(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op2_quality"]).df().sort_values("doc_id").reset_index(drop=True)
    for c in got.columns:
        assert got[c].tolist() == want[c].tolist(), c


# -- languages -------------------------------------------------------------------------------------------------------
def test_langid_on_held_out(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    model = langid.learn(docs)
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", langid.held_out(F.col("doc_id"))).toPandas()
    assert (got["held"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    assert (got[got["held"]]["lang"] == got[got["held"]]["lang_pred"]).mean() > 0.97 and got["score"].between(0, 1).all()


def test_langid_edges(spark, docs, none):
    model = langid.learn(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, model).collect()}
    assert (4, "und") in got and (15, "und") in got and (14, "und") in got and (0, "en") in got
    assert langid.identify(none, langid.learn(none)).count() == 0 and langid.learn(none).predict("abc") == ("und", 0.0, True)


@pytest.mark.parametrize("k", [2, 3, 4, 6, 9, 30])
def test_codewords_are_apart(k):
    c = langid.codewords(k)
    d = (c.shape[1] - c @ c.T) / 2 + 1e9 * np.eye(k)
    assert d.min() >= (2 ** (k - 2) if k <= 6 else 3) and len({tuple(r) for r in c}) == k


# -- near duplicates -------------------------------------------------------------------------------------------------
def fingerprint(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least(pairs, n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash(spark, docs, none):
    rows = [r for r in awkward()]
    fps = [fingerprint(t) for _, t, *_ in rows]
    comp = least([(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4], len(rows))
    ids = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in comp}
    want = Counter((rows[i][0], f"{fps[i]:016x}", ids[comp[i]]) for i in range(len(rows)))
    found = simhash.components(docs)
    got = Counter((r["doc_id"], r["h"], r["component_id"]) for r in found.select("doc_id", simhash.hex_column(F.col("fp")).alias("h"), "component_id").collect())
    assert got == want and simhash.components(none).count() == 0
    clashing = docs.withColumns({c: F.lit(0) for c in ("dedup_n", "dedup_row_d", "Dedup__h", "__keep", "doc", "a.b", "first")})
    kept = simhash.deduplicate(clashing)
    assert kept.columns == clashing.columns and kept.count() == len(set(comp))
    top = table(spark, [((1 << 63) - 1, "one text that is here"), (None, "and another text there"), (None, "one text that is here")])
    assert {(r["doc_id"], r["component_id"]) for r in simhash.components(top).collect()} == {((1 << 63) - 1, (1 << 63) - 1), (None, (1 << 63) - 1), (None, None)}
    assert simhash.deduplicate(top).count() == 2


def test_cells_are_joined_in_parts(spark, monkeypatch):
    """A crowded cell without a star's help: far pairs in one cell, near ones only side by side."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = np.random.default_rng(3)
    fps = {int(x) << 40 for x in rng.integers(0, 1 << 23, 120)}
    fps |= {f ^ 5 for f in list(fps)[:40]}
    got = simhash.labels(spark.createDataFrame([(f,) for f in fps], "fp long")).toPandas()
    fps = sorted(fps)
    want = least([(a, b) for a in range(len(fps)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4], len(fps))
    label = dict(zip(got["fp"], got["label"]))
    groups = [label.get(f, f) for f in fps]
    assert all((groups[a] == groups[b]) == (want[a] == want[b]) for a in range(len(fps)) for b in range(a))


def test_popcounts_bound_the_distance(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(a) ^ int(b)) for a, b in zip(rng.integers(0, 1 << 62, 300), rng.integers(0, 1 << 12, 300))]
    got = spark.createDataFrame(rows, "a long, b long").select("a", "b", simhash.manhattan(F.col("a"), F.col("b")).alias("m"), simhash.distance(F.col("a"), F.col("b")).alias("d")).collect()
    for r in got:
        counts = [[bin(x >> (2 * i) & 3).count("1") for i in range(32)] for x in (r["a"], r["b"])]
        assert r["m"] == sum(abs(p - q) for p, q in zip(*counts)) <= r["d"]


@pytest.mark.parametrize("g", [6, 7, 8, 10, 12])
def test_grid_holds_every_link(g):
    rng = np.random.default_rng(g)
    masks = [np.uint64(m) for m in simhash._masks(g)]
    odd = np.uint64(0x5555555555555555)

    def packed(x):
        low, high = x & odd, (x >> np.uint64(1)) & odd
        return (low | high) | ((low & high) << np.uint64(1))

    x = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    assert np.any([packed(x) & m == packed(y) & m for m in masks], axis=0).all()


def test_dense_group_is_one_component(spark):
    rng = np.random.default_rng(0)
    fps = {0}
    while len(fps) < 400:  # a cloud: each within 3 bits of another
        f = int(rng.choice(list(fps)))
        for _ in range(3):
            f ^= 1 << int(rng.integers(0, 63))
        fps.add(f)
    got = simhash.labels(spark.createDataFrame([(f,) for f in fps], "fp long")).toPandas()
    assert len(got) == 400 and got["label"].nunique() == 1


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 500)]
    want = least(links, 600)
    got = {r["node"]: r["label"] for r in connected(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(want[k] == v for k, v in got.items()) and set(got) == {x for p in links if p[0] != p[1] for x in p}


# -- substrings ------------------------------------------------------------------------------------------------------
def removed(rows):
    out = []
    keyed = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t, *_ in rows]
    first = {}
    for i, b in keyed:
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, i), i)
    for (i, b), (own, *_) in zip(keyed, rows):
        flag = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                flag[p : p + 50] = b"\1" * 50
        spans = sum(1 for k in range(len(b)) if flag[k] and not (k and flag[k - 1]))
        out.append((own, len(b), sum(flag), spans, hashlib.sha256(bytes(x for x, f in zip(b, flag) if not f)).hexdigest()))
    return Counter(out)


def test_suffix_dedup(docs, none):
    got = Counter(tuple(r) for r in suffix_dedup.digests(docs).collect())
    assert got == removed(awkward()) and suffix_dedup.digests(none).count() == 0
    clashing = docs.withColumns({c: F.lit(0) for c in ("doc", "row", "left", "cut_doc", "CUT__row", "__left", "a.b")})
    cut = suffix_dedup.deduplicate(clashing)
    assert cut.columns == clashing.columns and cut.count() == docs.count()
    assert cut.filter("doc_id = 1").first()["text"] == "" and cut.filter("doc_id = 1").first()["n_chars"] == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab", max_size=160), min_size=2, max_size=6), st.integers(50, 120))
def test_refinement_on_small_alphabets(texts, size):
    pieces = [(t * 3)[: max(50, len(t))].encode() for t in texts if len(t) >= 17]
    docs = np.arange(len(pieces))
    want = set()
    first = {}
    for i, b in enumerate(pieces):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, b in enumerate(pieces):
        want |= {(i, p) for p in range(len(b) - 49) if first[b[p : p + 50]] < i}
    if pieces:
        got = {(i, p) for i, a, z in zip(*(x.tolist() for x in suffix_dedup.refine(pieces, docs)), strict=True) for p in range(a, z + 1)}
        assert got == want


def test_suffix_dedup_over_a_very_long_text(spark, monkeypatch):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdef ") for _ in range(3_000_000))
    monkeypatch.setattr(suffix_dedup, "RUN", 1 << 18)
    rows = [(0, long[1_000_000:1_000_300]), (1, long), (2, long[2_999_000:])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in suffix_dedup.digests(table(spark, rows)).collect()}
    assert got == {0: (0, 0), 1: (300, 1), 2: (1000, 1)}


def passages_linked(a, b):
    sh = lambda t: [tuple(w[i : i + 5]) for w in [WORDS.findall((t or "").lower())] for i in range(len(w) - 4)]
    x, y = sh(a), sh(b)
    for i in range(len(x) - 45):
        s = set(x[i : i + 46])
        for j in range(len(y) - 45):
            t = set(y[j : j + 46])
            n = len(s & t)
            if n >= 0.8 * (len(s) + len(t) - n):
                return True
    return False


def test_compact_windows(spark, none):
    rows = [r for r in awkward() if r[0] not in (8, 9)]
    rng = random.Random(11)
    w = ["w%d" % rng.randrange(10_000) for _ in range(200)]
    edited = w[:90] + ["zz"] + w[91:]
    rows += [(50, " ".join(w), None, None), (51, " ".join(["k%d" % i for i in range(70)] + w[30:100]), None, None), (52, " ".join(edited[60:130]), None, None), (53, " ".join(w[:30] + ["u%d" % i for i in range(100)]), None, None)]
    long = [(i, t) for i, t, *_ in rows if t and len(WORDS.findall(t)) >= 50]
    pairs = [(a, b) for a in range(len(long)) for b in range(a) if long[a][1] == long[b][1] or passages_linked(long[a][1], long[b][1])]
    comp = least(pairs, len(long))
    want = {}
    for k, (i, _) in enumerate(long):
        if i is not None:
            want[i] = min(long[m][0] for m in range(len(long)) if comp[m] == comp[k] and long[m][0] is not None)
    got = {r["doc_id"]: r["class_id"] for r in compact_windows.classes(table(spark, rows)).collect() if r["doc_id"] is not None}
    assert {k: got[k] for k in want} == want and all(got[k] == k for k in got if k not in want)
    assert compact_windows.classes(none).count() == 0


def test_compact_windows_of_forms_with_own_fields(spark):
    """Pairs of like texts in one form: most of their hashes are those of all texts, which the stars cannot part."""
    form, rows = ["form%d" % i for i in range(30)], []
    for k in range(60):
        own = ["v%d_%d" % (k, i) for i in range(20)]
        rows += [(2 * k, " ".join(form + own), None, None), (2 * k + 1, " ".join(form + own[:-1] + ["last"]), None, None)]
    got = {r["doc_id"]: r["class_id"] for r in compact_windows.classes(table(spark, rows)).collect()}
    assert got == {i: i // 2 * 2 for i in range(120)}


def test_compact_windows_of_quotations(spark):
    """Many texts that quote the same 40 words are not near duplicates, and are not tried one by one."""
    quoted = ["quote%d" % i for i in range(40)]
    rows = [(k, " ".join([f"a{k}_{i}" for i in range(30)] + quoted + [f"b{k}_{i}" for i in range(30)]), None, None) for k in range(80)]
    rows += [(100, " ".join([f"a3_{i}" for i in range(30)] + quoted), None, None)]
    got = {r["doc_id"]: r["class_id"] for r in compact_windows.classes(table(spark, rows)).collect()}
    assert got == {k: k for k in range(80)} | {100: 3}


def test_compact_windows_of_repeated_words(spark):
    """Passages whose own shingles repeat, alone and against a passage without repeats."""
    some = ["r%d" % i for i in range(30)]
    rows = [(0, " ".join(some * 3), None, None), (1, " ".join(["x"] * 20 + some * 3), None, None), (2, " ".join(["q"] * 60), None, None), (3, "z " + " ".join(["q"] * 70), None, None), (4, " ".join(some + [f"n{i}" for i in range(60)]), None, None)]
    got = {r["doc_id"]: r["class_id"] for r in compact_windows.classes(table(spark, rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_compact_windows_over_a_very_long_text(spark, monkeypatch):
    monkeypatch.setattr(compact_windows, "PIECE", 1 << 12)
    rng = random.Random(9)
    long = ["w%d" % rng.randrange(10**6) for _ in range(30_000)]
    rows = [(0, " ".join(long[17_000:17_060]), None, None), (1, " ".join(long), None, None), (2, " ".join(["other"] + long[29_900:]), None, None), (3, " ".join("u%d" % i for i in range(80)), None, None)]
    assert {r["doc_id"]: r["class_id"] for r in compact_windows.classes(table(spark, rows)).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    text = (" ".join(long)).encode()
    starts, ends = compact_windows.word_places(text + b" ")
    assert [text[a:b].decode() for a, b in zip(starts[:50], ends[:50])] == long[:50] and len(starts) == len(ends) == 30_000
    assert (compact_windows.hashes_of(text) == compact_windows.word_hashes(text)[0]).all()


def linked_along_diagonals(x, y):
    """Have two shingle lists passages alike, at places that a shared shingle puts side by side?"""
    where = {}
    for j, g in enumerate(y):
        where.setdefault(g, []).append(j)
    for d in {j - i for i, g in enumerate(x) for j in where.get(g, ())}:
        for i in range(max(0, -d), min(len(x), len(y) - d) - 45):
            a, b = set(x[i : i + 46]), set(y[i + d : i + d + 46])
            n = len(a & b)
            if n >= 0.8 * (len(a) + len(b) - n):
                return True
    return False


def test_compact_windows_recall(spark, sf):
    """Against all pairs of texts that share 37 shingles, the least that near duplicates can share."""
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r["text"] or "", []).append(r["doc_id"])
    grams = {min(ids): [tuple(w[i : i + 5]) for i in range(len(w) - 4)] for t, ids in texts.items() for w in [WORDS.findall(t.lower())] if len(w) >= 50}
    having = {}
    for i, g in grams.items():
        for x in set(g):
            having.setdefault(x, []).append(i)
    common = Counter((a, b) for ids in having.values() for k, a in enumerate(ids) for b in ids[:k])
    pairs = [p for p, n in common.items() if n >= 37 and linked_along_diagonals(grams[p[0]], grams[p[1]])]
    got = {r["doc_id"]: r["class_id"] for r in compact_windows.classes(docs).collect()}
    assert len(pairs) > 30 and sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)
    number = {i: k for k, i in enumerate(sorted(grams))}
    whole = least([(number[a], number[b]) for a, b in pairs], len(number))
    assert all(got[a] != got[b] or whole[number[a]] == whole[number[b]] for a in grams for b in grams if a < b)


def test_compact_windows_give_the_class_alone(none):
    """A count of the links that were tried is not the number of links of a text."""
    assert compact_windows.classes(none).columns == ["doc_id", "class_id"]


def test_last_join_of_windows_is_whole(monkeypatch):
    monkeypatch.setattr(compact_windows, "BLOCK", 16)
    monkeypatch.setattr(compact_windows, "CHUNK", 50)
    rng = np.random.default_rng(6)
    a = np.zeros(300, compact_windows.LABELLED)
    a["hash"] = np.where(np.arange(300) < 120, 7, rng.integers(1000, 1040, 300)).astype(np.uint64) << np.uint64(16)
    a["doc"] = rng.permutation(300)
    a["label"] = a["doc"] // 3
    cells = list(compact_windows.spread(iter([compact_windows._dealt(np.zeros(300, np.int64), a, 0)]), 4))
    pairs = compact_windows._read(iter(list(compact_windows.all_pairs(iter(cells), 4))), compact_windows.PAIR)
    rows = sorted(zip(a["doc"].tolist(), a["hash"].tolist(), a["label"].tolist()))
    want = [(x[0], y[0]) for i, x in enumerate(rows) for y in rows[i + 1 :] if x[1] == y[1] and x[2] != y[2]]
    assert sorted(zip(pairs["a"].tolist(), pairs["b"].tolist())) == sorted(want)
    assert sum(b.column(0)[0].as_py() for b in compact_windows.pair_counts(iter(cells))) >= len(want)


def test_stars_of_later_turns_have_other_centres():
    """Near copies meet one centre in all hashes at first, then one for each hash; either way a pair for each window at most."""
    a = np.zeros(400, compact_windows.LABELLED)
    a["hash"] = np.repeat(np.arange(1, 21), 20).astype(np.uint64) << np.uint64(16)
    a["doc"] = a["label"] = np.tile(np.arange(20), 20)
    for turn, centres in ((0, 1), (1, 8)):
        pairs, first = compact_windows._star(a, turn=turn)
        assert len(np.unique(first["doc"])) >= centres and (turn or len(np.unique(first["doc"])) == 1)
        assert len(first) == 20 and len(pairs) == 380


def test_compact_windows_by_many_stars(spark, monkeypatch):
    """Near copies of one passage, of which not all are like the first; turns do not change the classes."""
    rng, base = random.Random(3), ["n%d" % i for i in range(60)]
    rows = [(k, " ".join(f"e{k}_{i}" if i in set(rng.sample(range(60), 1 + k % 2)) else x for i, x in enumerate(base)), None, None) for k in range(60)]
    got = []
    for many, turns in ((1 << 60, 1), (-1, 3)):
        monkeypatch.setattr(compact_windows, "MANY", many)
        monkeypatch.setattr(compact_windows, "TURNS", turns)
        got.append({r["doc_id"]: r["class_id"] for r in compact_windows.classes(table(spark, rows)).collect()})
    assert got[0] == got[1] and 1 < len(set(got[0].values())) < 60 or got[0] == got[1] == dict.fromkeys(range(60), 0)


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(4)
    s = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    valid = np.arange(len(s) - compact_windows.STARTS + 1)
    h, lo, hi, c = compact_windows.windows(s, valid, 1)
    with np.errstate(over="ignore"):
        value = compact_windows._mix(s * compact_windows._M[5] + compact_windows._M[6] * np.uint64(3))
    want = {}
    for i in valid.tolist():
        want.setdefault(i + int(np.argmin(value[i : i + compact_windows.STARTS])), []).append(i)
    assert {int(k): (int(a), int(b)) for a, b, k in zip(lo, hi, c)} == {k: (v[0], v[-1]) for k, v in want.items()}


# -- fingerprints ----------------------------------------------------------------------------------------------------
def spot_chains(text, common):
    """The spots of a text as word chains, without hashing."""
    w = [x for x in regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).split(" ") if x]
    out = set()
    for i, x in enumerate(w):
        if x in common:
            after = [y for y in w[i + 1 :] if y not in common][:2]
            out.add((x, *after, *[None] * (2 - len(after))))
    return out or ({("", text)} if text else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_spotsigs(docs, none, spark):
    got = spotsigs.edited_fingerprints(docs).toPandas()
    rows = sorted(awkward(), key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t, *_ in rows]
    having = Counter(x for _, t, *_ in awkward() for x in {y for y in regex.sub(r"[^\p{L}\p{N}]+", " ", (t or "").lower()).split(" ") if y})
    common = set(sorted(having, key=lambda x: (-having[x], x.encode()))[: spotsigs.ANCHORS])
    assert set(spotsigs.common_words(docs)) == common
    sets = {t: spot_chains(t, common) for t in texts}
    assert len(got) == len(rows)
    for k, (i, _, *_) in enumerate(rows):
        if i is not None and i != 11 and rows[(k + 1) % len(rows)][0] is not None:
            t, n = texts[k], texts[(k + 1) % len(rows)]
            m = len(t) // 2
            edited = t[: len(t) - m] + n[:m]
            own = got[got["doc_id"] == i].iloc[0]
            assert own["n_chars"] == len(t) and own["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert abs(own["near_edited"] - jaccard(sets[t], spot_chains(edited, common))) < 1e-9 and abs(own["near_next"] - jaccard(sets[t], sets[n])) < 1e-9
            assert len([x for x in own["fingerprint"].split(",") if x]) == len(sets[t])
    assert got[got["doc_id"].isin([0, 1])]["fingerprint"].nunique() == 1
    assert spotsigs.edited_fingerprints(none).count() == 0
    one = spotsigs.edited_fingerprints(table(spark, [(1, "the quick brown fox")])).first()
    assert one["near_next"] == 1.0 and one["near_class"] == 1


def test_spotsigs_order_over_buckets(spark):
    rng = np.random.default_rng(2)
    for ids in (rng.choice(10**12, 300, replace=False).tolist(), [7] * 100 + [None] * 150 + [8, 9], [3] * 80):
        rows = [(None if i is None else int(i), f"text number {k} {i} of the list") for k, i in enumerate(ids)]
        df = table(spark, rows)
        got = {r["text"]: r["next_text"] for r in spotsigs.with_next(df, bucket_bytes=500).collect()}
        h = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
        order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), h[r[1]]))
        assert got == {order[k][1]: order[(k + 1) % len(order)][1] for k in range(len(order))}


def test_spotsigs_classes(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    common = spotsigs.common_words(docs)
    assert "the" in common and "de" in common
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spotsigs.spots(F.col("text"), common).alias("s")).withColumn("node", F.xxhash64("s"))
    rows = [(r["doc_id"], frozenset(r["s"]), r["node"]) for r in sets.collect()]
    having = {}
    for k, (_, s, _) in enumerate(rows):
        for x in s or {None}:
            having.setdefault(x, []).append(k)
    tried = {(a, b) for ids in having.values() for i, a in enumerate(ids) for b in ids[:i]}
    whole = least([(a, b) for a, b in tried if jaccard(rows[a][1], rows[b][1]) >= 0.8], len(rows))
    want = {rows[k][0]: min(rows[m][0] for m in range(len(rows)) if whole[m] == whole[k]) for k in range(len(rows))}
    classes = {r["node"]: r["near_class"] for r in spotsigs.near_classes(sets).collect()}
    assert {i: classes[node] for i, _, node in rows} == want and len(set(want.values())) < len(rows)


def test_spotsigs_turns(spark, monkeypatch):
    """Sets that the stars leave apart, over two partitions of lengths and in crowded spots."""
    monkeypatch.setattr(spotsigs, "BLOCK", 4)
    rng = random.Random(4)
    base = [sorted(rng.sample(range(1, 10**6), 20)) for _ in range(12)]
    sets = []
    for b in base:
        for drop in range(3):
            sets.append(sorted(set(b[drop:]) | {10**7 + rng.randrange(10**6) for _ in range(drop)}))
    sets += [[5], [5, 6], [5, 6, 7, 8], [5, 6, 7, 8, 9]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "doc_id long, s array<int>").withColumn("node", F.xxhash64("s"))
    got = {r["node"]: r["near_class"] for r in spotsigs.near_classes(df).collect()}
    whole = least([(a, b) for a in range(len(sets)) for b in range(a) if jaccard(set(sets[a]), set(sets[b])) >= 0.8], len(sets))
    assert [got[r["node"]] for r in df.orderBy("doc_id").collect()] == whole


def test_spotsigs_of_one_passage(spark, monkeypatch):
    """Short texts that quote one passage and near copies of one text, unlike at 0.8: few are compared, all links are found."""
    rng, own = random.Random(5), iter(range(10**6, 10**8, 37))
    passage, text = list(range(10)), rng.sample(range(1000, 10**6), 72)
    sets = [sorted([*passage, next(own), next(own)]) for _ in range(150)]
    sets += [sorted([*rng.sample(text, 72 - k), *(next(own) for _ in range(k))]) for k in rng.choices(range(2, 11), k=150)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "doc_id long, s array<int>").withColumn("node", F.xxhash64("s"))
    tried, verified = [], spotsigs.verified
    monkeypatch.setattr(spotsigs, "verified", lambda pairs, *rest: tried.append(pairs.distinct().count()) or verified(pairs, *rest))
    got = {r["node"]: r["near_class"] for r in spotsigs.near_classes(df).collect()}
    whole = least([(a, b) for a in range(len(sets)) for b in range(a) if jaccard(set(sets[a]), set(sets[b])) >= 0.8], len(sets))
    assert [got[r["node"]] for r in df.orderBy("doc_id").collect()] == whole and len(set(whole)) < len(sets)
    assert sum(tried) < 6 * len(sets), tried


# -- mixing ----------------------------------------------------------------------------------------------------------
def shared_out(sizes, weights, budget, repeats=3):
    """Targets by filling up, round by round."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), min(float(budget), repeats * sum(sizes))
    while open_:
        rate = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if weights[i] * rate >= repeats * sizes[i]}
        for i in full or open_:
            out[i] = float(repeats * sizes[i]) if full else weights[i] * rate
        if not full:
            break
        left -= sum(out[i] for i in full)
        open_ -= full
    return out


def test_targets(spark):
    for sizes in ([100, 10, 10], [0, 0], [5], [1000, 1, 1, 1, 0, 300, 7], []):
        per = spark.createDataFrame([(f"={i}", n) for i, n in enumerate(sizes)], "s string, source_size long")
        got = {r["s"]: r["target"] for r in mixing.targets(per).collect()}
        want = shared_out(sizes, [i % 3 + 1 for i in range(len(sizes))], sum(sizes))
        assert len(got) == len(sizes) and all(abs(got[f"={i}"] - t) < 1e-5 for i, t in enumerate(want)), sizes


def test_mixing(spark, docs, none):
    got = mixing.plan(docs).toPandas()
    sizes = {(i, len(WORDS.findall(t or ""))) for i, t, *_ in awkward()}
    assert {(None if pd.isna(i) else int(i), n) for i, n in zip(got["doc_id"], got["size"])} == sizes
    again = mixing.plan(docs.repartition(5)).toPandas()
    key = ["doc_id", "text_hash", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert (got["taken"] <= 3 * got["size"]).all() and mixing.plan(none).count() == 0 and mixing.mix(none).count() == 0
    out = mixing.mix(docs.withColumns({"mix_row": F.lit(1), "MIX__time": F.lit("x"), "a.b": F.lit(2)}))
    assert out.count() == got["copies"].sum() and out.columns == [*docs.columns, "mix_row", "MIX__time", "a.b"]


def test_mixing_of_repeated_rows(spark):
    rows = [(1, "a b c", None, "x")] * 40 + [(2, "d e", None, "x"), (None, "f g h i", None, None)]
    planned = mixing.plan(table(spark, rows)).toPandas()
    assert abs(planned["taken"].sum() - planned["size"].sum()) <= 4
    assert mixing.mix(table(spark, rows)).count() == planned["copies"].sum()


def test_mixing_before_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SPAN", 4)
    rows = [(s, i, (7 * i) % 5) for s in ("=a", "") for i in range(30)]
    got = {(r["s"], r["i"]): r["before"] for r in mixing.before(spark.createDataFrame(rows, "s string, i long, n long"), ["s"], "i", "n").collect()}
    assert got == {(s, i): sum(m for t, k, m in rows if t == s and k < i) for s, i, _ in rows}


def test_mixing_sql(spark, sf):
    got = queries.op6_mixing(spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op6_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    assert got["taken"].tolist() == want["taken"].tolist() and np.allclose(got["target"], want["target"])
    near = got.assign(source=spark.read.parquet(f"{sf}/documents.parquet").toPandas().sort_values("doc_id")["source"].tolist()).groupby("source").agg(t=("target", "first"), k=("taken", "sum"), m=("size", "max"))
    assert ((near["k"] - near["t"]).abs() <= near["m"]).all() and abs(got["taken"].sum() - got["size"].sum()) <= got["size"].max()


def test_sstable_words_of_plain_texts_go_to_the_model_once(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(sstable, "MAX_WORDS", 12)
    e = sstable.LibraryEncoder(path)
    texts = ["Une forêt (très) dense, 42.5 ha.\nForêt!", "don't 'tis it's ''s ÀÿØß", " x\n", "\n", "", "a  b", "x\ty", "a—b", "<|endoftext|> a", "Ġ Ċ"]
    texts += [f"forêt (très) w{i}, dense {'z' * (60 + i)}" for i in range(9)]
    whole = e.lib
    for some in (texts, texts[::-1], *([x] for x in texts)):
        assert [np.frombuffer(x, e.dtype).tolist() for x in e.encode(some)] == [x.ids for x in whole.encode_batch(some, add_special_tokens=False)]
    fresh = sstable.LibraryEncoder(path)
    fresh.encode(texts[:1])
    assert set(fresh.pieces) == {"Une", " forêt", " (", "très", ")", " dense", ",", " 42", ".", "5", " ha", "\n", "Forêt", "!"}
    monkeypatch.setattr(fresh, "words", None)  # not asked again for what it has seen
    fresh.encode(["Forêt dense, 42 forêt (très) ha."])


def test_components_at_once(spark):
    r = random.Random(5)
    links = [(r.randrange(400) - 200, r.randrange(400) - 200) for _ in range(330)] + [(i, i + 1) for i in range(1000, 1200)] + [(-(1 << 63), (1 << 63) - 1)]
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    by_rounds = sorted(map(tuple, connected(df, "a", "b").collect()))
    for at_once in (len(links), 10):  # in one task, and too many for it
        assert sorted(map(tuple, connected(df, "a", "b", at_once).collect())) == by_rounds
    assert connected(df.limit(0), "a", "b", 10).count() == 0


def test_compact_windows_counts_the_pairs_left():
    def pairs(rows):
        a = np.zeros(len(rows), compact_windows.LABELLED)
        for i, (h, doc, label, row) in enumerate(rows):
            a[i]["hash"], a[i]["doc"], a[i]["label"], a[i]["row"] = h, doc, label, row
        blob = compact_windows._dealt(np.zeros(len(a), np.int64), a, 0)
        return sum(b.column(0)[0].as_py() for b in compact_windows.pairs_left(iter([blob])))

    plain = compact_windows.PLAIN
    assert pairs([(1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 3, 0), (2, 4, 4, 0), (2, 5, 4, 0)]) == 3  # the second hash has one class
    assert pairs([(1, 1, 1, plain), (1, 2, 2, plain), (1, 3, 3, 0)]) == 2  # those marked PLAIN do not meet each other
