"""Substring, line and near-duplicate removal against brute force, and their edge cases."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from incidence.llm import lines, packing, queries, simhash, substring
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def corpus(seed, docs=60, vocabulary=40, copies=8):
    """Small texts with copies, near copies and shared passages."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = make(15)
    texts = ["\n".join(make(r.randint(3, 25)) for _ in range(r.randint(1, 4))) for _ in range(docs - copies)]
    for i in range(copies):
        base = texts[i].split(" ")
        if i % 2:
            base[r.randrange(len(base))] = "changed"
        texts.append(" ".join(base) + ("\n" + passage if i % 3 == 0 else ""))
    r.shuffle(texts)
    return [*enumerate(texts), (docs, None), (docs + 1, ""), (docs + 2, " \n\t "), (docs + 3, "é　ü x\x85y"), (None, texts[0]), (3, texts[3])]


def cut_by_hand(rows, window):
    owner = {}
    words = [(k, WORD.findall(t or "")) for k, t in rows]
    for k, ws in words:
        for i in range(len(ws) - window + 1 if k is not None else 0):
            run = tuple(ws[i : i + window])
            owner[run] = min(owner.get(run, k), k)
    out = []
    for k, ws in words:
        gone = set()
        for i in range(len(ws) - window + 1 if k is not None else 0):
            if owner[tuple(ws[i : i + window])] < k:
                gone |= set(range(i, i + window))
        out.append((k, len(ws), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed, chunk, vocabulary", [(1, 4096, 40), (2, 2, 40), (3, 4096, 6), (4, 3, 3), (5, 8, 2)])
def test_substrings(spark, monkeypatch, seed, chunk, vocabulary):
    monkeypatch.setattr(substring, "CHUNK", chunk)
    monkeypatch.setattr(substring, "ROWS", 7)
    monkeypatch.setattr(substring, "BRANCHING", 0 if seed == 1 else 4)
    rows = corpus(seed, vocabulary=vocabulary)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", spans string")
    found = substring.find_repeats(df, window=8, gram=3)
    kept = F.sha2(substring.without_spans(F.col("text"), F.col("spans")), 256)
    cut = found.spans.select("doc_id", "_id", substring.removed_words(F.col("spans")).alias("n"), kept.alias("sha"))
    out = found.documents.join(cut, ["doc_id", "_id"], "left").select("doc_id", "n_words", F.coalesce("n", F.lit(0)), F.coalesce("sha", "words_sha256"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == cut_by_hand(rows, 8)


def test_substrings_of_no_rows(spark):
    found = substring.find_repeats(spark.createDataFrame([], SCHEMA))
    assert found.spans.count() == found.documents.count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_twins(spark, name):
    same(connect(SF), queries.QUERIES[name](spark, SF), queries.SQL[name])


def lines_by_hand(rows, least=5):
    """Lines to remove of each (key, text), by comparing all pairs."""
    seen = []  # (key, number, set)
    for k, t in rows:
        if k is not None:
            seen += [(k, n, frozenset(WORD.findall(x))) for n, x in enumerate((t or "").split("\n"))]
    seen = [s for s in seen if len(s[2]) >= least]
    gone = {}
    for k, t in rows:
        own = []
        for n, x in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(x))
            if k is not None and len(s) >= least and any((a, b) < (k, n) and 5 * len(s & o) >= 4 * len(s | o) for a, b, o in seen):
                own.append(n)
        gone[k, t] = own
    return gone


@pytest.mark.parametrize("seed, named", [(1, 8), (2, 1), (3, 1)])
def test_lines(spark, monkeypatch, seed, named):
    monkeypatch.setattr(lines, "NAMED", named)
    monkeypatch.setattr(lines, "NAMED_WEAK", named)
    monkeypatch.setattr(lines, "CHUNK", 4 if seed == 3 else lines.CHUNK)
    monkeypatch.setattr(lines, "SPLIT", 3 if seed > 1 else lines.SPLIT)
    monkeypatch.setattr(lines, "FEW_DOCUMENTS", 0 if seed < 3 else lines.FEW_DOCUMENTS)
    monkeypatch.setattr(lines, "WANTED_MOST", 0 if seed == 2 else lines.WANTED_MOST)
    rows = corpus(seed, docs=80, vocabulary=15, copies=40)
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", _gone string")
    want = lines_by_hand(rows)
    got = {(r["doc_id"], r["text"]): r["kept"] for r in df.join(lines.dedup_lines(df).select("doc_id", F.col("text").alias("kept"), F.xxhash64("_gone")), "doc_id", "left").collect() if r["doc_id"] != 3}
    for (k, t), gone in want.items():
        if k not in (None, 3):
            assert got[k, t] == (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
    assert any(want.values()) and lines.dedup_lines(df).columns == df.columns and lines.dedup_lines(df).count() == len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_short_lines(spark, seed):
    r = random.Random(seed)
    rows = [(i, "\n".join(" ".join(r.choice("abcdef") for _ in range(r.randint(0, 7))) for _ in range(6))) for i in range(40)]
    got = {r["doc_id"]: r["removed"] for r in lines.repeated_lines(spark.createDataFrame(rows, SCHEMA), min_words=1).collect()}
    assert got == {k: gone for (k, _), gone in lines_by_hand(rows, 1).items() if gone}


def test_queries_take_short_lines(spark, tmp_path):
    text = "All rights reserved.\nsome other words here\n\nagain"
    spark.createDataFrame([(1, text), (2, text), (3, "some other words here today")], SCHEMA).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    gone = {r["doc_id"]: r["removed_lines"] for r in queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert gone == {1: "", 2: "0,1,3", 3: "0"}
    kept = corpus_pipeline.line_dedup(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {1: text, 2: "", 3: ""}


def test_lines_of_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert lines.dedup_lines(df).count() == 0


def fingerprint(text, size=4):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(max(1, len(words) - size + 1))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, bits=4):
    names = dict.fromkeys(prints, None)
    for k in sorted(prints):
        if names[k] is None:
            queue = [k]
            while queue:
                x = queue.pop()
                if names[x] is None:
                    names[x] = k
                    queue += [y for y in prints if names[y] is None and (prints[x] ^ prints[y]).bit_count() <= bits]
    return names


@pytest.mark.parametrize("chunk, chance", [(4096, 4096), (3, 1)])
def test_near_duplicates(spark, monkeypatch, chunk, chance):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "BY_CHANCE", chance)
    rows = [r for r in corpus(5, docs=120, copies=60) if r[0] is not None][:-1]
    out = {r["doc_id"]: r for r in simhash.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", fp int")).collect()}
    prints = {k: fingerprint(t) for k, t in rows}
    names = components(prints)
    assert {k: r["fp"] % (1 << 64) for k, r in out.items()} == prints
    assert {k: r["component_id"] for k, r in out.items()} == names
    assert len(set(names.values())) < len(names)


def test_keys_beside_null(spark):
    rows = [(None, "a b"), (2**60 + 1, "one two three"), (2**60 + 3, "ONE two\nthree"), (None, "one two three"), (None, None), (2**60 + 5, "")]
    out = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()), key=str)
    assert out == sorted([(None, None), (2**60 + 1, 2**60 + 1), (2**60 + 3, 2**60 + 1), (None, 2**60 + 1), (None, 2**60 + 5), (2**60 + 5, 2**60 + 5)], key=str)


def test_one_of_each(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(5, base), (2, base.replace("word7 ", "other ")), (9, base.upper()), (1, "something else entirely " * 9), (1, "something else entirely " * 9), (1, "quite another text with a key in use"), (7, None), (8, ""), (None, base), (None, "only a null key here")]
    df = spark.createDataFrame([(*r, "k", i) for i, r in enumerate(rows)], SCHEMA + ", _kept string, _key int")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 1, 2, 7, None]
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in simhash.one_of_each(df.orderBy("_key", ascending=False)).collect()}
    assert simhash.one_of_each(df.limit(0)).count() == 0


def shingles(words, n=5):
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


@pytest.mark.parametrize("length, vocabulary", [(100, 5000), (2000, 300), (3000, 100000)])
def test_near_copies_are_found(spark, length, vocabulary):
    """Pairs of a similarity of 0.8 and a little more, of which nine in ten at least must be found; far ones must stay."""
    r, rows, close = random.Random(length), [], 0
    for i in range(40):
        base = [f"w{r.randrange(vocabulary)}" for _ in range(length)]
        near, far = list(base), list(base)
        for at in r.sample(range(length), max(1, length // 50)):
            near[at] = f"new{i}x{at}"
        for at in r.sample(range(length), length // 10):
            far[at] = f"far{i}x{at}"
        a, b = shingles(base), shingles(near)
        close += len(a & b) / len(a | b) >= 0.8
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    kept = {x["doc_id"] for x in simhash.one_of_each(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert close >= 36 and {k for k, _ in rows if k % 3 != 1} <= kept and sum(k % 3 == 1 for k in kept) <= 40 - 0.9 * close


def test_plan_fills_bins():
    r = random.Random(1)
    counts = {r.randint(1, 60): r.randint(1, 30) for _ in range(40)}
    plan = packing.minimum_slack_plan(counts, 64)
    used = {}
    for items, times in plan:
        assert sum(items) <= 64 and times > 0
        for n in items:
            used[n] = used.get(n, 0) + times
    assert used == counts
    free = []  # best-fit decreasing
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        best = min((i for i in range(len(free)) if free[i] >= n), key=lambda i: free[i], default=None)
        if best is None:
            free.append(64 - n)
        else:
            free[best] -= n
    assert sum(t for _, t in plan) <= len(free)
