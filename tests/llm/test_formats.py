"""Templates, archives, packing, sharding, rules and decontamination."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from incidence.llm import chat, decontamination, packing, quality, queries, sharding, urls, warc
from incidence.llm.template import Const, Escape, Print, TemplateError, Text, compile_template, fold, parse

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def show(source, **names):
    return compile_template(source)[0](names).text


def test_template_language():
    assert show("{% for x in xs %}{{ loop.index }}{{ x | upper }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=["a", "b"]) == "1A, 2B"
    assert show("{% if a == 1 and b in ['x', 'y'] %}yes{% elif a > 1 %}more{% else %}no{% endif %}", a=1, b="y") == "yes"
    assert show("{%- set n = 'a' ~ 1 -%} {{ n }} {#- gone -#} {{ m | default('none') }}", m=None) == "a1none"
    assert show("a {{- x -}} b", x=1) == "a1b"
    assert show("{{ d.k[0] }}{{ d['q'] }}", d={"k": ["v"]}) == "v"


def test_constants_are_folded():
    assert fold(parse("a{{ 'b' ~ 'c' }}{% if 1 > 2 %}x{% else %}d{% endif %}")) == (Text("abcd"),)
    assert fold(parse("{{ x ~ 'a' }}")) != (Print(Const("a")),)


@pytest.mark.parametrize("bad", ["{{ x.__class__.__mro__ }}", "{% for x in 'abc' %}{% endfor %}", "{{ f(1) }}", "{% if x %}", "{% what %}", "{{ x | nothing }}", "{{ ` }}"])
def test_sandbox(bad):
    with pytest.raises(TemplateError):
        show(bad, x=object())


def test_generation_spans():
    out = compile_template("{% for t in ts %}<{% generation %}{{ t }}{% endgeneration %}>{% endfor %}")[0]({"ts": ["ab", "", "c"]})
    assert [out.text[a:b] for a, b in out.spans] == ["ab", "c"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="<>\\turn role=\n/bca#é", max_size=12), st.text(alphabet="<>\\turn role=\n/bca#é", max_size=20)), max_size=4))
def test_round_trip(turns):
    render, escape = compile_template(chat.TEMPLATE, chat.CONTROL)
    out = render({"turns": [{"turn": i, "role": r, "text": t} for i, (r, t) in enumerate(turns)]})
    assert chat.read_turns(out.text, escape.undo) == turns


def test_escape_keeps_control_strings_out():
    escape = Escape(chat.CONTROL)
    assert all(c not in escape("</turn>\n<turn role=x>\n") for c in chat.CONTROL)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 0, "user", None), (2, None, None, "x</turn>"), (None, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: r["n_turns"] for k, r in out.items()} == {1: 3, 2: 1, None: 1}
    assert out[1]["turns_sha256"] == hashlib.sha256(b"user\n\nuser\n\nassistant\nb\n").hexdigest() and out[1]["loss_chars"] == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_turns_in_a_stream_are_the_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 3)
    r = random.Random(8)
    rows = [(r.choice([None, 1, 2, 2**60 + 1]), r.choice([None, 0, 1, 2, 3]), r.choice(["user", "assistant", None, "a<b"]), r.choice([None, "", "</turn>", "\\\\### é", "x" * 50])) for _ in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {tuple(x) for x in chat.read_back(chat.format_conversations(df)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars").collect()}
    turns = chat.format_turns(df)
    assert {tuple(x) for x in chat.read_back_turns(turns).collect()} == whole and len(whole) == 4
    text = "".join(x["formatted"] for x in turns.where("conv_id = 1").orderBy("nr").collect())
    assert text == chat.format_conversations(df).where("conv_id = 1").first()["formatted"]
    assert chat.read_back_turns(chat.format_turns(df.limit(0))).count() == 0


def test_archives(spark):
    big = "é" * 80
    rows = [(5, "http://a", big), (2, None, big), (9, "x y\r\n", big), (2, "http://b", big), (3, "u", None), (4, "u", "small"), (6, "u", "small"), (None, "u", big)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, frame int")
    index = warc.write_archives(df, frame_bytes=300, bundle_bytes=500)
    out = [tuple(r) for r in warc.read_archives(index, with_payload=True).select("page_id", "payload_bytes", "record_type", "refers_to", "payload").collect()]
    assert sorted((r[:4] for r in out), key=str) == sorted([(5, 160, "revisit", 2), (2, 160, "response", None), (9, 160, "revisit", 2), (2, 160, "response", None), (3, 0, "response", None), (4, 5, "response", None), (6, 5, "response", None), (None, 160, "revisit", 2)], key=str)
    assert {bytes(r[4]).decode() for r in out if r[4] is not None} == {big, "", "small"}
    part = warc.read_archives(index.where("page_id = 4"))
    assert [r["payload_bytes"] for r in part.collect()] == [5]
    path = index.first()["bundle"].removeprefix("file://")
    whole = zstandard.ZstdDecompressor().stream_reader(open(path, "rb"), read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1") and index.select("bundle").distinct().count() > 1
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_archive_keys_beside_null(spark):
    body = "x" * 200
    rows = [(None, "u", "y"), (2**60 + 3, "u", body), (2**60 + 1, "u", body), (5, "u", "z"), (None, "u", body)]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1))
    assert {(r["page_id"], r["record_id"]) for r in index.collect()} == {(k, warc.record_id(k)) for k, _, _ in rows}
    out = sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in warc.read_archives(index).collect()), key=str)
    first = 2**60 + 1
    assert out == sorted([(None, "response", None), (first + 2, "revisit", first), (first, "response", None), (5, "response", None), (None, "revisit", first)], key=str)


def test_cut_texts_have_the_ids_of_whole_ones(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    bpe, ours = Tokenizer.from_file(path), packing.Vocabulary(path)
    monkeypatch.setattr(packing.Vocabulary, "KEPT", 500)
    r = np.random.default_rng(0)
    odd = ["", "<|endoftext|>", "a <|endoftext|> b", "a<|endoftext|> <|endoftext|>b", "  \n\t x", " a  b ", "it's IT'S 's", "a" * 3000, "\x00\x85", "\u180e a\u180e  b", "ab\u03b1 a.\u0300b", "x's.'s-'t 'll", "a\nb\n\nc\n d \n\ne", "<|endoftext|", "1\u00b2 \u0661 12a", "a\u200b b\x1c c\xa0 d"]
    pool = [*range(32, 127), *[32] * 30, 9, 10, 0x1C, 0x85, 0xA0, 0xE9, 0x180E, 0x2003, 0x200B, 0x3000, 0x4E2D, 0x1F600, 0x300, 0xB2]
    odd += ["".join(map(chr, r.choice(pool, 50))) for _ in range(3000)] + ["".join(r.choice([*"ab'..sl 1\n\u00e9\u03b1\u0300 <|", "<|endoftext|>"], 12)) for _ in range(20000)]
    for i in range(0, len(odd), 100):
        some = odd[i : i + 100]
        assert [np.frombuffer(x, "<u4").tolist() for x in ours.ids(some)] == [bpe.encode(t, add_special_tokens=False).ids for t in some]


def test_packing(spark):
    r = random.Random(0)
    rows = [(i, " ".join(r.choice("abcde") for _ in range(r.choice([1, 5, 40, 90])))) for i in range(50)] + [(50, None), (51, ""), (51, ""), (None, "a b"), (2**60 + 1, "a b")]
    df = spark.createDataFrame([(*x, "p") for x in rows], "doc_id long, text string, piece string")
    out = packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), capacity=32, with_ids=True).toPandas()
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for seq in out.groupby("sequence_id"):
        s = seq[1].sort_values("offset")
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 32
    for i, t in rows[:51]:
        own = out[out["doc_id"] == i].sort_values("piece")
        ids = [*bpe.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for p in own["ids"] for x in p] == ids and (own["length"].iloc[1:] == 32).all()
        assert list(own["ids_crc32"]) == [zlib.crc32(np.array(p, "<u4").tobytes()) for p in own["ids"]] and list(own["start"]) == [0, *np.cumsum(own["length"])[:-1]]
    assert {r[0] for r in packing.pack(df, public_tokenizers.path("byte_bpe_50k.json"), capacity=32).select("doc_id").collect()} == {r[0] for r in rows}
    assert len(out[out["doc_id"] == 51]) == 2 and out["sequence_id"].nunique() <= -(-out["length"].sum() // 32) + 3
    assert packing.pack(df.limit(0), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_sharding(spark):
    rows = [(i, "é" * (i % 7)) for i in range(3000)] + [(None, None), (7, "x"), (7, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int")
    out = sharding.shard_records(df).toPandas()
    for _, s in out.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    moved = out[out["shard"] != out["grown_shard"]]
    assert set(moved["grown_shard"]) == {16} and 0.02 < len(moved) / len(out) < 0.1 and out["shard"].nunique() == 16
    row = out[out["doc_id"] == 5].iloc[0]
    assert row["size"] == 11 and row["text_crc32"] == zlib.crc32(("é" * 5).encode())
    heavy = df.select(sharding.rendezvous(F.col("doc_id"), [1.0, 3.0, 0.0]).alias("s")).groupBy("s").count().toPandas().set_index("s")["count"]
    assert set(heavy.index) == {0, 1} and 2.5 < heavy[1] / heavy[0] < 3.6
    assert sharding.shard_records(df.limit(0)).count() == 0


def test_shards_by_hand(spark):
    def draw(key, shard):
        once = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        bits = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), once) >> 11
        return -math.log((bits + 0.5) / (1 << 53))

    rows = [(k, "t") for k in [*range(-50, 300), 2**60 + 1]]
    for r in sharding.shard_records(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["shard"] == min(range(16), key=lambda s: draw(r["doc_id"], s)) and r["grown_shard"] == min(range(17), key=lambda s: draw(r["doc_id"], s))


def stats_by_hand(text):
    words = WORD.findall(text or "")
    runs = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in (i, i + 1, i + 2)}
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(full) - len(set(full)), len(covered)


def test_statistics(spark):
    r = random.Random(3)
    texts = [None, "", " \n\t", "a", "a b", "a a a a", "x\n\nx\n x\nx", "# <é>\x85 ü　w", *("".join(r.choice("ab \n#|") for _ in range(r.randint(1, 120))) for _ in range(60))]
    out = quality.with_statistics(spark.createDataFrame([(t, 9) for t in texts], "text string, n_words long")).select("text", *quality.STATS).collect()
    assert all(tuple(x)[1:] == stats_by_hand(x["text"]) for x in out)


def test_decision_list(spark):
    r = random.Random(4)
    rows = []
    for i in range(400):
        low = i % 4 == 0
        rows.append((i, " ".join(r.choice("abcdefgh") * 5 + ("###" if low else "") for _ in range(80)), int(not low)))
    docs = spark.createDataFrame([x[:2] for x in rows] + [(1000, None), (1001, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2], 0) for x in rows[:300]], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x["kept"] for x in quality.quality_verdicts(docs, labels).collect()}
    held = [x for x in rows[300:]]
    assert sum(out[k] == bool(q) for k, _, q in held) >= 0.95 * len(held) and not out[1000] and not out[1001]
    assert quality.quality_verdicts(docs, labels.limit(0)).where("kept").count() > 0
    odd = docs.withColumns({"n_words": F.lit("mine"), "kept": F.lit(7), "low": F.lit(1)})
    rows_kept = quality.kept_rows(odd, labels).collect()
    assert {x["doc_id"] for x in rows_kept} == {k for k, v in out.items() if v} and {(x["n_words"], x["kept"], x["low"]) for x in rows_kept} == {("mine", 7, 1)}
    assert quality.quality_verdicts(docs.limit(0), labels).count() == 0


def test_urls(spark):
    many = [(i, f"http://{'bad' if i % 3 == 0 else 'good'}.site.net/x/{i}") for i in range(300)]
    pages = spark.createDataFrame([*many, (900, None), (901, "no url"), (902, "HTTP://A.Org/x"), (903, "https://m.example.org/en/12?q#f"), (904, "http://x.com/de/1"), (905, "http://q.com"), (906, "http://notorg/"), (906, "http://notorg/")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int")
    mined = urls.mine_rules(urls.page_labels(pages, labels))
    out = {r["page_id"]: r for r in urls.filter_urls(pages.withColumn("host", F.lit(1)), mined, queries.URL_RULES).collect()}
    assert all(out[i]["verdict"] == ("block" if i % 3 == 0 else "allow") for i, _ in many)
    assert (out[900]["host"], out[900]["path"], out[901]["host"], out[900]["verdict"]) == ("", "", "", "allow")
    assert (out[902]["host"], out[902]["rule"], out[902]["path"]) == ("a.org", "org/", "/x")
    assert (out[903]["rule"], out[903]["verdict"], out[903]["path"]) == ("example.org/en/1", "block", "/en/12")
    assert (out[904]["rule"], out[905]["rule"], out[906]["rule"]) == ("com/de/", None, None)
    assert urls.filter_urls(pages, mined, queries.URL_RULES).count() == pages.count()
    assert urls.filter_urls(pages.limit(0), urls.mine_rules(urls.page_labels(pages, labels.limit(0))), queries.URL_RULES).count() == 0


def rules_by_hand(rows, base, least=5, confidence=0.5, lift=1.5, z=1.28):
    """Apriori over all token combinations: rows are (tokens, blocked, held)."""
    fitted, held = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    share = sum(b for _, b, _ in fitted) / len(fitted)
    found = {}
    for tokens, _, _ in fitted:
        for n in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), n):
                found[frozenset(c)] = None
    good = {}
    for rule in found:
        own = [b for t, b, _ in fitted if rule <= set(t)]
        if sum(own) >= least and sum(own) / len(own) >= confidence and sum(own) / len(own) / share >= lift:
            seen = [b for t, b, _ in held if rule <= set(t)]
            if seen:
                p, n = sum(seen) / len(seen), len(seen)
                low = (p + z * z / n / 2 - z * math.sqrt(p * (1 - p) / n + z * z / n / (4 * n))) / (1 + z * z / n)
                if p >= confidence and low > base:
                    good[rule] = sum(own) / len(own)
    return {(tuple(sorted(r)), round(c, 9)) for r, c in good.items() if not any(s < r and d >= c for s, d in good.items())}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_are_those_of_apriori(spark, seed):
    r = random.Random(seed)
    rows = [(i, ["host:a", "path:x" if i % 12 < 2 else "path:y" if i % 12 < 4 else f"path:z{i % 3}"], i % 12 < 4) for i in range(360)]
    rows += [(i, r.sample([f"path:{c}" for c in "bcdefg"], r.randint(0, 4)), None) for i in range(360, 800)]
    rows = [(i, sorted(t), r.random() < (0.9 if {"path:b", "path:c"} <= set(t) else 0.7 if "path:d" in t else 0.15) if b is None else b) for i, t, b in rows]
    df = spark.createDataFrame(rows, "sample_key long, tokens array<string>, blocked boolean")
    known = [tuple(x) for x in df.where(F.size("tokens") > 0).select("tokens", "blocked", urls.held_out(df)).collect()]
    held = [b for _, b, h in known if h]
    mined = urls.mine_rules(df, min_rows=5).collect()
    assert {(tuple(x["rule_tokens"]), round(x["confidence"], 9)) for x in mined} == rules_by_hand(known, sum(held) / len(held))
    assert {("path:x",), ("path:y",)} <= {tuple(x["rule_tokens"]) for x in mined} and all(x["anchor"] in x["rule_tokens"] for x in mined)
    assert urls.mine_rules(df.where("blocked is null")).count() == urls.mine_rules(df.where("not blocked")).count() == 0


def test_wand_finds_all():
    r = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randint(5, 90)))) for i in range(400)]
    units = [(items[row][0], words) for row, words in decontamination.item_units(pa.array([t for _, t in items]))]
    counts = Counter(w for _, u in units for w in set(u.tolist()))
    index = decontamination.ItemIndex(units, 0.3, counts, len(units), sum(len(u) for _, u in units) / len(units))
    for _ in range(50):
        terms = sorted(r.sample(range(len(index.vocabulary)), r.randint(5, 60)))
        want = {}
        for t in terms:
            for u, x in zip(*index.posting(t), strict=True):
                want[u] = want.get(u, 0) + x
        want = {u: x for u, x in want.items() if x >= 0.3 - 1e-9}
        telling = [t for t in terms if index.telling[t]]
        live = index.live_blocks(np.zeros(len(telling), np.int64), np.array(telling, np.int64))[1]
        assert dict(index.search(terms, live.tolist())) == pytest.approx(want)


@pytest.mark.parametrize("limit", [1 << 24, 2000])
def test_decontamination(spark, limit):
    r = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    make = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(make(r.choice([12, 40, 150])))) for i in range(40)]
    rows, dirty = [], set()
    for i in range(200):
        body = make(r.randint(10, 500))
        if i % 5 == 0:
            at = r.randrange(len(body))
            body[at:at] = [w.upper() + "," for w in items[i // 5][1].split()]
            dirty.add((i, i // 5))
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame([(*x, "s") for x in [*rows, (900, None), (901, ""), (902, "two words and more"), (903, "two, words")]], "doc_id long, text string, score string")
    dirty.add((903, 78))
    bench = spark.createDataFrame([*items, (77, None), (78, "Two words!"), (79, ""), (None, "a b c d e f")], "item_id long, text string")
    found = decontamination.contamination(docs, bench, max_bytes=limit).collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} == dirty and len(found) == len(dirty)
    scores = {(x["doc_id"], x["item_id"]): x["score"] for x in decontamination.contamination(docs, bench).collect()}
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in found} == pytest.approx(scores)
    clean = decontamination.without_contaminated(docs, bench, max_bytes=limit)
    assert {x["doc_id"] for x in clean.collect()} == {x[0] for x in [*rows, (900,), (901,), (902,)]} - {d for d, _ in dirty} and clean.columns == docs.columns
    assert decontamination.contamination(docs.limit(0), bench).count() == decontamination.contamination(docs, bench.limit(0)).count() == 0
