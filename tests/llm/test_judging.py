"""The quality classifier, the filter audit and the conversation repair: brute force, SQL, held-out labels, edge cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from incidence.llm import attention, audit, queries, repair
from incidence.llm.bytewords import blocks
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", ["op12_filter_interaction_audit", "op13_conversation_repair"])
def test_matches_sql(spark, duck, name):
    same(duck, queries.QUERIES[name](spark, SF), queries.SQL[name])


# Quality classifier


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    heads = np.array([0, 2, 3, 7])
    x, y, importance = rng.normal(size=(7, attention.FEATURES)), np.array([1.0, 0.0, 1.0]), np.array([0.5, 2.0, 1.0])
    w = {"encode": rng.normal(size=(attention.FEATURES, 4)) / 9, "encode_bias": rng.normal(size=4), "tilt": rng.normal(size=(4, 3)), "gate": rng.normal(size=(4, 3)), "attend": rng.normal(size=3), "score": rng.normal(size=4), "score_bias": rng.normal(size=1)}

    def loss(w):
        p = attention._forward(w, x, heads)["p"]
        return -(importance * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / importance.sum() + 0.005 * sum((v**2).sum() for k, v in w.items() if not k.endswith("bias"))

    told = attention._gradients(w, x, heads, y, importance, 0.01)
    for name, at in [("encode", (5, 2)), ("encode_bias", (1,)), ("tilt", (2, 1)), ("gate", (3, 0)), ("attend", (1,)), ("score", (2,)), ("score_bias", (0,))]:
        high, low = ({k: v.copy() for k, v in w.items()} for _ in range(2))
        high[name][at] += 1e-5
        low[name][at] -= 1e-5
        assert abs((loss(high) - loss(low)) / 2e-5 - told[name][at]) < 1e-6, name


def test_passages_cover_whole_texts():
    texts = ["", "  ", "one", "A b! " * 40 + "é", " ".join(f"w{i}" for i in range(1000)), "\n\nx y\n"]
    found, heads = zip(*(attention.encode(b) for b in blocks(pa.array(texts), limit=50)), strict=True)
    assert [int(h[i + 1] - h[i]) for h in heads for i in range(len(h) - 1)] == [max(1, -(-len(t.split()) // attention.PASSAGE)) for t in texts]
    told = np.concatenate(found)
    assert told[:2, -1].tolist() == [0, 0] and told[2:, -1].all() and np.isfinite(told).all()
    together = attention.encode(next(blocks(pa.array(texts), limit=1 << 20)))[0]
    assert np.allclose(told, together)
    for i, text in enumerate(texts[:3]):  # of one passage: shares of pairs of byte kinds add up to one
        assert abs((told[i, :-5] ** 2).sum() - (1 if text else 0)) < 1e-6


def test_attention_finds_the_one_bad_passage(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "and", "the", "of"]
    good = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, good(rng.randint(1, 900)) if i % 3 else good(300) + " " + " ".join(rng.choice(words).upper() + "!!" for _ in range(60)) + " " + good(300)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)], "doc_id long, quality int")
    out = attention.quality_scores(docs, labels).collect()
    held = [r for r in out if r["held_out"]]
    assert len(held) > 80 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == (r["doc_id"] % 3 > 0) for r in held) >= 0.97 * len(held)


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = dict(labels.select("doc_id", "quality").collect())
    out = [(known[r["doc_id"]], r) for r in attention.quality_scores(docs, labels).collect() if r["doc_id"] in known and r["held_out"]]
    bad, good = [r for q, r in out if q == 0], [r for q, r in out if q == 1]
    assert sum(not r["predicted"] for r in bad) >= 0.85 * len(bad) and sum(r["predicted"] for r in good) >= 0.97 * len(good)
    assert np.mean([(b["score"] < g["score"]) for b in bad for g in good]) > 0.97


def test_classifier_never_sees_held_out_labels_ids_or_sources(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    plain = {r["doc_id"]: r["score"] for r in attention.quality_scores(docs, labels).collect()}
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality")
    again = {r["doc_id"]: r["score"] for r in attention.quality_scores(docs.selectExpr("doc_id", "text", "'x' as source", "1 as score", "true as held_out"), turned).collect()}
    assert plain == again


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (1, ""), (None, "one"), (2, "x " * 200_000), (3, " \n")], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (None, 0), (1, None)], "doc_id long, quality int")
    out = attention.quality_scores(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 1}) == 1 and next(r for r in out if r["doc_id"] is None)["held_out"]
    assert attention.quality_scores(docs.limit(0), labels.limit(0)).count() == 0


# Filter interaction audit


def brute_counts(text):
    words = WORD.findall(text or "")
    return [len(words), len(set(words)), len(re.findall("[A-Z]", text or "")), len(text or ""), len(re.findall(r"[#$%&*|]", text or ""))]


def test_transducer(monkeypatch):
    rng = random.Random(1)
    chars = "aAbZ #|$\n\t\x0b\x1f\x00é€😀Я.\x85\xa0 "
    texts = [None, "", " ", "a", "a a", " A  a# ", "x" * 5000, "Ab " * 3000] + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for block in (1, 64, 1 << 20):
        monkeypatch.setattr(audit, "BLOCK", block)
        assert audit.scan_texts(pa.array(texts, pa.string())).T.tolist() == [brute_counts(t) for t in texts]
    assert audit.scan_texts(pa.array(texts, pa.string()).slice(3, 5)).T.tolist() == [brute_counts(t) for t in texts[3:8]]


def test_hash_table_verifies_words(monkeypatch):
    monkeypatch.setattr(audit, "span_hashes", lambda blob, starts, ends: np.zeros(len(starts), np.uint64))  # every hash collides
    texts = ["a b a c", "c c", "a bb a bb bc", ""]
    assert audit.scan_texts(pa.array(texts)).T.tolist() == [brute_counts(t) for t in texts]


def brute_audit(rows, labels):
    good, toxic = ({k for k, *l in labels if k is not None and l[i] == 1} for i in (0, 1))
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    fails, out = [], {}
    for key, text, source in rows:
        n, distinct, caps, points, marks = brute_counts(text)
        fails.append((source or "", key, {"A": n < 200, "B": 100 * distinct < 50 * n, "C": 100 * caps > 2 * points, "D": marks > 0, "E": key is not None and key > least[text or ""]}))
    for part in {f[0] for f in fails}:
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                removed = [f for f in left if f[2][letter]]
                redundant = sum(f[2][letter] for f in gone)
                left, gone = [f for f in left if not f[2][letter]], gone + removed
                alone = sum(f[2][letter] and sum(f[2].values()) == 1 for f in fails if f[0] == part)
                shapley[letter] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), redundant, alone, sum(f[1] in good for f in removed), sum(f[1] in toxic for f in removed)]
        for (p, order, step), told in out.items():
            if p == part:
                told.append(shapley[order[step - 1]])
    return out


def test_audit_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["", None, "a b c", "A B C #", "w " * 250, " ".join(map(str, range(250))), " ".join(f"X{i}" for i in range(201)), "# " + " ".join(map(str, range(199)))]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["s", "t", "", None])) for _ in range(300)]
    labels = [(rng.choice([None, *range(40)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as step", "'x' as kept", "2 as _mask", "3 as n_words")
    out = audit.interactions(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in columns] for r in out.collect()} == brute_audit(rows, labels)
    assert audit.interactions(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_failing_rows_keep_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "A B", 5), (2, None, 6)], "doc_id long, text string, failed int")
    assert [tuple(r) for r in audit.failing_rows(docs).orderBy("doc_id").collect()] == [(1, "A B", 5, "AC"), (2, None, 6, "A")]


# Conversation structure repair


def brute_repair(turns):
    """Cheapest first, then ASCII-least: uniform cost search over (turn, state)."""
    heap, done = [(0, "", 0, repair.NONE)], set()
    while heap:
        cost, edits, i, state = heapq.heappop(heap)
        if i == len(turns) and state in repair.LEGAL_END:
            return cost, edits
        if (i, state) in done:
            continue
        done.add((i, state))
        role, after = ("assistant", repair.ASSISTANT) if state == repair.USER else ("user", repair.USER)
        assert role
        heapq.heappush(heap, (cost + 3, edits + "I", i, after))
        if i < len(turns):
            t = turns[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state))
            if not t.must_go:
                stay = 3 if t.truncated else 0
                heapq.heappush(heap, (cost + stay + 3, edits + "R", i + 1, after))
                legal = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, t.initial))
                if legal is not None:
                    heapq.heappush(heap, (cost + stay, edits + "K", i + 1, legal))


def random_turns(rng, n):
    return [repair.Turn(rng.choice("ssuuaax"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(n)]


def test_branch_and_bound_is_optimal():
    rng = random.Random(4)
    for _ in range(1500):
        turns = random_turns(rng, rng.randint(0, 12))
        assert repair.repair(turns) == brute_repair(turns), turns
    for initial in "uasx":
        for flags in ((False, False), (False, True), (True, False)):
            turns = [repair.Turn(initial, *flags)] * repair.SEGMENT
            assert repair.repair(turns) == brute_repair(turns)


def test_segments_join_to_the_optimum():
    rng = random.Random(6)
    for _ in range(300):
        turns, path, at = random_turns(rng, rng.randint(0, 40)), repair._Path(), 0
        while at < len(turns):
            step = rng.randint(1, 9)
            path.extend({entry: repair.search(turns[at : at + step], entry) for entry in range(4)})
            at += step
        assert path.close() == brute_repair(turns)


def brute_conversations(rows):
    out = {}
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        by[conv] += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    for conv, kept in by.items():
        kept.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, turns, faults = set(), [], Counter()
        for _, role, text in kept:
            said = re.sub("[\x20\x09-\x0d]+$", "", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            turns.append(repair.Turn(role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, edits = brute_repair(turns)
        told, state, at = [], repair.NONE, 0
        for edit in edits:
            if edit in "IR":
                role, state = repair.NEXT_ROLE[state]
                told.append(f"{role}:{kept[at][2] if edit == 'R' else ''}")
            elif edit == "K":
                state = repair.FOLLOWS[state, kept[at][1][:1]]
                told.append(f"{kept[at][1]}:{kept[at][2]}")
            at += edit != "I"
        known = [t for t, _, _ in kept if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, hashlib.sha256("\n".join(told).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("segment, chunk", [(64, 1024), (3, 4)])
def test_repair_against_brute_force(spark, monkeypatch, segment, chunk):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    monkeypatch.setattr(repair, "CHUNK", chunk)
    rng = random.Random(7)
    texts = ["Yes.", "No", "Why? ", "", None, " \n", "a.b", "…", "Same!", "x" * 30_000 + "."]
    rows = [(rng.choice([None, *range(60)]), rng.choice([None, *range(-3, 12)]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(900)]
    rows += [(500, t, ("user", "assistant")[t % 2], "Fine." if t % 7 else f"No. {t}") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as cost", "'x' as audit", "2 as _copies")
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_conversations(repair.damaged(df)).collect()}
    assert out == brute_conversations(rows)
    assert repair.repair_conversations(repair.damaged(df.limit(0))).count() == 0


def test_dropped_conversations_stay(spark):
    dropped = [(c, t) for c in range(200) for t in range(5) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    df = spark.createDataFrame([(*dropped[0], "user", "Hi."), (None, None, None, None)], "conv_id long, turn int, role string, text string")
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in repair.repair_conversations(repair.damaged(df)).collect()}
    assert out[dropped[0][0]] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert out == brute_conversations([tuple(r) for r in df.collect()])


def test_whole_conversations_need_no_damage(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Yes.")], "conv_id long, turn int, role string, text string")
    out = {r["conv_id"]: (r["cost"], r["audit"]) for r in repair.repair_conversations(repair.whole(df)).collect()}
    assert out == {1: (0, "KK"), 2: (3, "IK")}
