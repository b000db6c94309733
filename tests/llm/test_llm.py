"""The operators of subpackage llm against brute force, round trips and held-out labels, and their defined cases."""

import base64
import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import licenses, media, packing, quality, resharding, simhash, spencode, toxicity, urlfilter, warc
from corpusloom.llm.common import written

DOCS = "doc_id long, text string, lang string, source string, n_chars long, cell int, score double, fp string"
EDGES = [None, "", " \t\n", "one", "a a a a a", "x" * 20_000, "word " * 3_000, "Ünïcode ▁ mark ½ 漢字 é   <|endoftext|>", "same text here", "same text here"]


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, None, "s", 0, 1, 0.5, "x") for i, t in enumerate(EDGES)] + [(9, EDGES[9], None, "s", 0, 1, 0.5, "x"), (None, "no id", None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(edge):
    return edge.filter("false")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1. SentencePiece


def test_pieces_equal_the_library(edge, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for frame in (edge, docs):
        for r in spencode.decoded(spencode.encoded(frame, path), path).select("row.row.text", "row.ids", "decoded").collect():
            assert r["ids"] == sp.encode(r["text"] or "") and r["decoded"] == sp.decode(r["ids"])
        known = frame.select("doc_id", "text").distinct()
        for r in spencode.checked(frame, path).join(known, "doc_id").collect():
            assert r["ids"] == sp.encode(r["text"] or "") and r["n_ids"] == len(r["ids"])
            assert r["round_trip"] == (sp.decode(r["ids"]) == (r["text"] or ""))


def test_unigram_pass_is_viterbi():
    rnd = random.Random(2)
    pieces = {p: (i, -rnd.random() * 5) for i, p in enumerate({"".join(rnd.choices("ab▁", k=rnd.randint(1, 4))) for _ in range(25)} | {"a", "b", "▁"})}
    model = spencode.PieceTrie(pieces, None, kind="unigram")
    words = sorted({"".join(rnd.choices("ab▁", k=rnd.randint(1, 9))) for _ in range(60)})

    def best(w):
        return max((pieces[w[:n]][1] + best(w[n:]) for n in range(1, len(w) + 1) if w[:n] in pieces), default=-1e9) if w else 0.0

    for w, parts in model.forward(words):
        assert "".join(parts) == w and abs(sum(pieces[p][1] for p in parts) - best(w)) < 1e-9


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def message(*fields):
    """A protocol buffer of (number, int, float, str or bytes) fields."""
    out = b""
    for n, v in fields:
        if isinstance(v, float):
            out += varint(n << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(n << 3) + varint(v)
        else:
            v = v.encode() if isinstance(v, str) else v
            out += varint(n << 3 | 2) + varint(len(v)) + v
    return out


@pytest.mark.parametrize("kind", ["unigram", "bpe"])
def test_a_models_own_type_is_followed(spark, tmp_path, kind):
    """A file made by hand, with unknown characters: ids equal the library's, and the two types differ."""
    import sentencepiece

    rnd = random.Random(5)
    words = sorted({"".join(rnd.choices("abc", k=rnd.randint(2, 4))) for _ in range(25)})
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((p, -rnd.randint(64, 640) / 64, 1) for p in ["▁", "a", "b", "c", "▁a", "▁ab", "▁▁", *words])]
    model = b"".join(message((1, message((1, p), (2, score), (3, t)))) for p, score, t in pieces)
    model += message((2, message((3, 1 if kind == "unigram" else 2))), (3, message((1, "identity"), (3, 1), (4, 0), (5, 1))))
    path = str(tmp_path / f"{kind}.model")
    with open(path, "wb") as f:
        f.write(model)
    assert spencode.model_type(path) == kind
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", "zz", "az z zb", *("".join(rnd.choices("abcabcabc  z", k=rnd.randint(1, 60))) for _ in range(300))]
    rows = spencode.encoded(spark.createDataFrame([(t,) for t in texts], "text string"), path).select("row.text", "ids").collect()
    assert [r["ids"] for r in rows] == [sp.encode(r["text"]) for r in rows]
    other = spencode.PieceTrie({p: (i, s) for i, (p, s, t) in enumerate(pieces) if t == 1}, None, kind="bpe" if kind == "unigram" else "unigram")
    assert any(a.tolist() != sp.encode(t) for t, a in zip(texts, other.encode(texts)))


def test_bpe_pass_is_the_merging():
    rnd = random.Random(4)
    pieces = {p: (i, -float(i)) for i, p in enumerate(["".join(rnd.choices("abc", k=rnd.randint(1, 5))) for _ in range(40)])}
    model = spencode.PieceTrie(pieces, None)
    words = sorted({"".join(rnd.choices("abcd", k=rnd.randint(1, 12))) for _ in range(200)})
    for w, parts in model.forward(words):
        assert parts == model.merged(w)


# 2. resharding


def test_flow_moves_the_fewest_bytes():
    rnd = random.Random(6)
    for _ in range(30):
        supply = [rnd.randint(0, 50) for _ in range(4)]
        room = resharding.capacities(sum(supply), 6)
        flow = resharding.min_cost_flow(supply, room, lambda i, j: 0 if i == j else 1)
        assert [sum(f) for f in flow] == supply and all(sum(f[j] for f in flow) <= room[j] for j in range(6))
        assert sum(flow[i][i] for i in range(4)) == sum(min(s, r) for s, r in zip(supply, room))


def test_resharding(edge, docs, none):
    for frame in (edge, docs):
        old = resharding.laid_out(resharding.sized(frame), 3)
        rows = resharding.slotted(resharding.resharded(old, 8), F.col("row.doc_id")).collect()
        assert sorted(map(str, (tuple(r["row"]) for r in rows))) == sorted(map(str, map(tuple, frame.collect())))
        for s, own in itertools.groupby(sorted(rows, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
            assert [r["slot"] for r in own] == list(range(sum(r["shard"] == s for r in rows)))
        by_text = {}
        for r in rows:
            by_text.setdefault(r["row"]["text"] or "", set()).add(r["shard"])
        assert all(len(s) == 1 for s in by_text.values())
    held = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(held) - min(held) <= max(r["size"] for r in rows)
    old = resharding.laid_out(resharding.sized(none), 3)
    assert old.count() == 0 and resharding.slotted(resharding.resharded(old, 8), F.col("row.doc_id")).count() == 0


@pytest.mark.parametrize("heavy", [False, True])
def test_transfers_move_hardly_more_than_the_fewest_bytes(heavy):
    """Whole blocks against the flow's bound, over even and heavy-tailed block sizes."""
    rng = np.random.default_rng(3)
    n = 16_384
    sizes = (rng.pareto(1.5, n) * 1000 + 1).astype(int) if heavy else rng.integers(900, 1100, n)
    by = {(b * 5 // n, b): int(s) for b, s in enumerate(sizes)}
    place = resharding.transfers(by, 8)
    old = [sum(s for (o, _), s in by.items() if o == i) for i in range(5)]
    fewest = sum(old) - sum(min(o, c) for o, c in zip(old, resharding.capacities(sum(old), 8)))
    moved = sum(s for (o, b), s in by.items() if place[b] != o)
    held = [sum(s for (_, b), s in by.items() if place[b] == j) for j in range(8)]
    assert moved <= 1.01 * fewest and max(held) - min(held) <= max(sizes)


# 3. packing


def test_cutting_stock_is_near_the_bound():
    rnd = random.Random(8)
    demand = {w: rnd.randint(0, 400) for w in range(1, 65)}
    plan = packing.cutting_stock(demand, 64)
    got = {}
    for pattern, copies in plan:
        assert sum(w * n for w, n in pattern.items()) <= 64
        for w, n in pattern.items():
            got[w] = got.get(w, 0) + n * copies
    assert got == {w: n for w, n in demand.items() if n}
    assert sum(c for _, c in plan) <= sum(w * n for w, n in demand.items()) / 64 * 1.03 + 2
    assert packing.cutting_stock({}, 64) == []


def test_packing(edge, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for frame in (edge, docs):
        tokens = written(packing.tokenized(frame, path, with_ids=True), "tokens")
        for r in tokens.join(frame.select("doc_id", "text").distinct(), "doc_id").collect():
            assert r["ids"] == [*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        plan = packing.packed(tokens, cells=3).collect()
        assert sum(p["length"] for p in plan) == tokens.agg(F.sum("doc_tokens")).first()[0]
        for _, own in itertools.groupby(sorted(plan, key=lambda p: (p["sequence_id"], p["offset"])), key=lambda p: p["sequence_id"]):
            at = 0
            for p in own:
                assert p["offset"] == at and p["length"] > 0
                at += p["length"]
            assert at <= 2048
    ids = {r["doc_id"]: r["ids"] for r in tokens.collect()}
    for p in plan:
        assert zlib.crc32(np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes()) == p["ids_crc32"]
    whole = packing.sequences(packing.packed(tokens, cells=3), tokens)
    assert whole.agg(F.sum(F.size("ids"))).first()[0] == sum(map(len, ids.values()))
    assert packing.packed(written(packing.tokenized(none, path), "tokens")).count() == 0


# 4. toxicity


def test_toxicity_finds_the_sentence(spark):
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefg", k=5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(500):
        said = [" ".join(rnd.choices(words, k=8)) for _ in range(rnd.randint(1, 12))]
        bad = i % 4 == 0
        if bad:
            said[rnd.randrange(len(said))] += " " + rnd.choice(["vilest", "vileness", "horrid"])
        rows.append((i, ". ".join(said)))
        labels.append((i, int(bad)))
    frame, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(frame, known)
    wrong = 0
    for r in toxicity.scored(frame, model).collect():
        score, bad = r["toxicity"]["score"], r["row"]["doc_id"] % 4 == 0
        wrong += (score >= 0.5) != bad
        if bad and score >= 0.5:
            assert re.search("vile|horrid", toxicity.sentences(r["row"]["text"])[r["toxicity"]["worst_sentence"]])
    assert wrong <= 5


def test_noisy_or_and_its_gradient():
    """The likelihood sentence by sentence from its definition, and the gradient by differences."""
    rnd = np.random.default_rng(7)
    n_sentences = np.array([1, 3, 2, 4, 1])
    y = np.array([0, 1, 0, 1, 1])
    bags = [[sorted(rnd.choice(6, rnd.integers(0, 4), replace=False).tolist()) for _ in range(n)] for n in n_sentences]
    pairs = [np.array([s << 20 | f for s, own in enumerate(bag) for f in own], dtype=np.int64) for bag in bags]
    w, b = rnd.normal(size=6), -0.7
    model = toxicity.NoisyOr(y, n_sentences, pairs, 6, positive_weight=3.0, l2=0.01)
    total = 0.0
    for bag, label in zip(bags, y):
        none = 1.0
        for own in bag:
            none *= 1 - 1 / (1 + np.exp(-(b + sum(w[f] for f in own))))
        total -= 3 * np.log(1 - none) if label else np.log(none)
    loss, grad = model.loss(w, b)
    assert abs(loss - (total / 5 + 0.005 * (w @ w))) < 1e-9
    for k in range(7):
        at = lambda h: model.loss(w + (np.arange(6) == k) * h, b + (k == 6) * h)[0]
        assert abs((at(1e-5) - at(-1e-5)) / 2e-5 - grad[k]) < 1e-6
    scored = toxicity.ToxicityModel({"=bad": 2.0}, -1.0)
    p, q = 1 / (1 + np.exp(-1.0)), 1 / (1 + np.exp(1.0))
    assert abs(scored.score("A bad one. A good one")[0] - (1 - (1 - p) * (1 - q))) < 1e-12


def test_smallest_is_the_first_n(spark):
    from corpusloom.llm.common import smallest

    rows = spark.range(5_000).select(F.xxhash64("id").alias("h"))
    every = sorted(r["h"] for r in rows.collect())
    for n in (0, 1, 70, 4_999, 9_000):
        assert sorted(r["h"] for r in smallest(rows, F.col("h"), n).collect()) == every[:n]


def test_toxicity_edges(spark, edge, none, docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(edge, labels)
    scores = [r["toxicity"]["score"] for r in toxicity.scored(edge, model).collect()]
    assert len(scores) == edge.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity.scored(none, toxicity.fit(none, labels.filter("false"))).count() == 0


def test_toxicity_never_learns_from_the_held_out(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).weights == toxicity.fit(docs, flipped).weights


def test_toxicity_learns_one_text_of_a_repeated_id(spark, sf):
    """However many rows share an id, one of their texts is learnt from, whatever the order of rows."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    own = labels.filter("toxic = 1").filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).agg(F.min("doc_id")).first()[0]
    others = docs.filter(F.col("doc_id") > own).limit(300).select(F.lit(own).alias("doc_id"), "text")
    many = written(docs.unionByName(others), "many")
    least = many.withColumn("h", F.xxhash64("text")).groupBy("doc_id").agg(F.min_by("text", "h").alias("text"))
    assert toxicity.fit(many.repartition(7), labels).weights == toxicity.fit(least, labels).weights


# 5. licences


def test_licences(spark, edge, none):
    gpl = licenses.TEMPLATES["GPL-3.0"][1]
    words = gpl.split()
    changed = " ".join(words[:20] + ["altered"] + words[21:])
    half = " ".join(words[:20])
    filler = " ".join(f"w{i}" for i in range(300))
    texts = [f"{filler} {gpl} {filler}", f"{filler}\n{changed.upper()}", half, filler, f"{filler} Released under the MIT License. {filler} Licensed under CC BY-NC 4.0.", gpl]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(h["licence"], h["first_word"], h["end_word"]) for h in r["hits"]] for r in licenses.scanned(frame).select("row.doc_id", "hits").collect()}
    assert got[0] == [("GPL-3.0", 300, 300 + len(words))] and [h[0] for h in got[1]] == ["GPL-3.0"] and got[2] == [] and got[3] == []
    assert [(h[0], h[1], h[2]) for h in got[4]] == [("CC-BY-NC-4.0", 605, 610), ("MIT", 300, 305)] and got[5] == [("GPL-3.0", 0, len(words))]
    flat = [(r["doc_id"], r["licence"], r["first_word"], r["end_word"]) for r in licenses.found(frame).collect()]
    assert sorted(flat) == sorted((d, *h) for d, own in got.items() for h in own)
    assert licenses.scanned(edge).filter(F.size("hits") == 0).count() == edge.count() and licenses.scanned(none).count() == 0
    assert licenses.found(edge).count() == 0 and licenses.found(none).count() == 0


def brute_hits(text, scanner):
    """Exact containment of every template at every shingle, without any retrieval."""
    words = [(i, licenses.plain(w)) for i, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", text))]
    words = [(i, w) for i, w in words if w]
    out = []
    for licence, own in licenses.TEMPLATES.items():
        marks = []
        for t in own:
            plain = [w for w in map(licenses.plain, t.split()) if w]
            size = min(5, len(plain))
            wanted = {tuple(plain[i : i + size]) for i in range(len(plain) - size + 1)}
            n = len(plain) - size + 1
            here = [tuple(w for _, w in words[i : i + size]) for i in range(len(words) - size + 1)]
            for i in range(len(here)):
                inside = [k for k in range(i, min(i + n + n // 4, len(here))) if here[k] in wanted]
                share = len({here[k] for k in inside}) / len(wanted)
                if inside and inside[0] == i and share >= 0.8:
                    marks.append((words[i][0], words[inside[-1] + size - 1][0] + 1, share))
        covered = sorted({p for a, b, _ in marks for p in range(a, b)})
        starts = sorted({a for a, _, _ in marks})
        while covered:
            a = covered[0]
            end = a
            while any(m[0] <= end < m[1] or m[0] == a == end for m in marks):  # as far as overlapping marks reach
                reach = max(m[1] for m in marks if m[0] <= end < m[1])
                inner = [m for m in marks if m[0] < reach and m[1] > a]
                far = max(m[1] for m in inner)
                end = far if far > reach else reach
                if not any(m[0] < end < m[1] for m in marks):
                    break
            out.append((licence, a, end, max(m[2] for m in marks if a <= m[0] and m[1] <= end)))
            covered = [p for p in covered if p >= end]
        assert all(any(licence == o[0] and o[1] <= s < o[2] for o in out) for s in starts)
    out = sorted(out)
    return [h for h in out if not any(o[0] != h[0] and o[3] > h[3] and min(o[2], h[2]) - max(o[1], h[1]) >= 0.8 * (h[2] - h[1]) for o in out)]


def test_scan_equals_exact_containment_of_every_template():
    """Every template, whole and damaged, in both orders, alone and together with others; recall and places are exact."""
    rnd = random.Random(3)
    scanner = licenses.Scanner()
    passages = [x for ws in licenses.TEMPLATES.values() for x in ws]
    filler = lambda: " ".join(f"z{rnd.randint(0, 999)}" for _ in range(rnd.choice([0, 1, 4, 30, 110])))

    def damaged(x):
        own = x.split()
        for k in rnd.sample(range(len(own)), rnd.choice([0, 0, 1, min(len(own), len(own) // 40)])):
            own[k] = "changed"
        return " ".join(own)

    texts = passages + [damaged(x) for x in passages] + [f"{a}\n{filler()} {b}" for a, b in itertools.pairwise(passages)] + [f"{b} {filler()} {a}" for a, b in itertools.pairwise(passages)]
    texts += [" ".join(y for x in rnd.sample(passages, 3) for y in (filler(), damaged(x))) for _ in range(40)]
    got = scanner.scan_all(texts)
    for text, hits in zip(texts, got):
        assert [(h[0], h[1], h[2]) for h in hits] == [h[:3] for h in brute_hits(text, scanner)], text[:200]
    assert got == [scanner.scan(t) for t in texts]  # what a text is laid beside changes nothing


def test_two_notices_of_one_licence_far_apart():
    mit = licenses.TEMPLATES["MIT"]
    text = mit[2] + " " + " ".join(f"w{i}" for i in range(100)) + " " + mit[0]
    n = len(mit[2].split())
    assert [h[:3] for h in licenses.Scanner().scan(text)] == [("MIT", 0, n), ("MIT", n + 100, n + 105)]


# 6. quality


def brute_rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_rules_match_brute_force():
    rnd = random.Random(9)
    cases = [x or "" for x in EDGES if x is None or len(x) < 3_000] + ["".join(rnd.choices("ab \n#|", k=rnd.randint(0, 120))) for _ in range(300)]
    for t in cases:
        assert quality.count_rules(t) == brute_rules(t)


def test_quality(spark, sf, edge, none):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    stats = written(quality.statistics(docs), "stats")
    rows = quality.judged(stats, quality.fit(stats, labels)).withColumn("doc_id", F.col("row.doc_id")).join(labels, "doc_id").filter("not base_failed").collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.2
    e = quality.statistics(edge)
    assert quality.judged(e, quality.fit(e, labels.filter("false"))).filter("kept").count() == 0
    n = quality.statistics(none)
    assert quality.judged(n, quality.fit(n, labels)).count() == 0


def brute_threshold(scores, good, lost=0.002):
    """By trying every cut."""
    cuts = np.unique(scores)
    tried = [(c, (scores[good] > c).mean(), (scores[~good] > c).mean()) for c in (cuts[1:] + cuts[:-1]) / 2]
    most = max(((hit, c, gone) for c, gone, hit in tried if gone <= lost + 1e-12), default=(0, 0, 1))
    return most[1] if most[0] > most[2] else float("inf")


def test_quality_learns_from_all_rows(spark):
    """More labelled rows than any former bound, and families that catch but few of the bad ones."""
    rnd = np.random.default_rng(3)
    n = 30_000
    good = rnd.random(n) < 0.8
    rules = np.stack([rnd.integers(50, 400, n), np.zeros(n, int), rnd.poisson(2, n), np.zeros(n, int), np.zeros(n, int)], axis=1)
    rules[:, 1] = rules[:, 0] * 5 + rnd.integers(-20, 20, n)
    odd = ~good & (rnd.random(n) < 0.03)
    rules[odd, 2] += 300
    import pandas as pd

    flat = spark.createDataFrame(pd.DataFrame(rules, columns=quality.NAMES).assign(doc_id=np.arange(n), quality=good.astype(int)))
    stats = flat.select(F.struct("doc_id").alias("row"), F.struct(*quality.NAMES).alias("rules"))
    model = quality.fit(stats, flat.select("doc_id", "quality"), trees=10)
    again = quality.fit(stats.repartition(7), flat.select("doc_id", "quality"), trees=10)
    assert model.thresholds == again.thresholds
    mine = np.array([zlib.crc32(str(i).encode()) % 5 != 0 for i in range(n)])
    assert mine.sum() > 20_000
    seen, ok = quality.features(rules[mine]), good[mine]
    for name, forest in model.forests.items():
        scores = forest.score(seen[:, quality.FAMILIES[name]])
        assert model.thresholds[name] == brute_threshold(scores, ok)
        seen, ok = seen[scores <= model.thresholds[name]], ok[scores <= model.thresholds[name]]
    assert np.isfinite(model.thresholds["symbols"])


def test_path_lengths_are_those_of_the_trees():
    """A row's score from a walk by hand, and the forest's trees against the definition."""
    rng = np.random.default_rng(2)
    parts = [rng.normal(size=(64, 2)) for _ in range(5)]
    forest = quality.IsolationForest.fit(parts)
    rows = np.concatenate([rng.normal(size=(30, 2)), [[9.0, 9.0]], parts[0][:5]])
    usual = lambda n: 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def depth(at, row, part, d=0):
        f = forest.feature[at]
        if f < 0:
            assert len(part) <= 1 or d == 6 or (part == part[0]).all()
            return d + usual(len(part))
        assert part[:, f].min() <= forest.value[at] < part[:, f].max()
        left = row[f] <= forest.value[at]
        mask = part[:, f] <= forest.value[at]
        return depth(at + 1 if left else forest.child[at], row, part[mask if left else ~mask], d + 1)

    want = [2.0 ** (-np.mean([depth(root, row, part) for root, part in zip(forest.roots, parts)]) / usual(64)) for row in rows]
    got = forest.score(rows)
    assert np.allclose(got, want) and got.argmax() == 30


def test_subsamples_are_of_all_rows(spark):
    """A value with a count is drawn as often as its rows, and few rows are all drawn."""
    rows = spark.range(3000).select(F.struct(*(F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias(c) for c in quality.NAMES)).alias("rules"))
    parts = quality.subsamples(rows, 40)
    assert all(len(p) == 256 and 0.5 < (p[:, 0] == 7).mean() < 0.85 for p in parts)
    assert all(len(set(p[p[:, 0] != 7][:, 0])) == (p[:, 0] != 7).sum() for p in parts)
    few = quality.subsamples(rows.limit(5), 2)
    assert [len(p) for p in few] == [5, 5]


# 7. SimHash


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints(edge, docs):
    for frame in (edge, docs.limit(60)):
        for r in simhash.fingerprints(frame).collect():
            assert r["fp"] & (1 << 64) - 1 == brute_fingerprint(r["row"]["text"] or "")


@pytest.mark.parametrize("hot", [48, 3])
def test_links_and_components(spark, hot):
    """Chains and clouds of fingerprints, with hot keys by pairs or by hubs: the same components."""
    rnd = random.Random(hot)
    fps = set()
    for _ in range(12):
        f = rnd.getrandbits(64)
        for _ in range(rnd.randint(1, 25)):
            fps.add(f)
            for b in rnd.sample(range(64), rnd.randint(1, 3)):
                f ^= 1 << b
    centre = rnd.getrandbits(64)
    fps |= {centre ^ (1 << b) for b in range(20)}
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    found = simhash.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot))
    root = {r["node"]: r["root"] for r in found.collect()}
    parent = {f: f for f in fps}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(fps, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    for f in fps:
        assert root.get(f, f) == find(f)


def test_deduplicated(edge, none):
    rows = simhash.deduplicated(edge).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 7, 8] and sum(r["doc_id"] is None for r in rows) == 1
    assert simhash.deduplicated(none).count() == 0 and set(rows[0].asDict()) == set(edge.columns)


def test_deduplicated_with_repeated_ids(spark):
    """Rows that share an id but no text are no duplicates of each other."""
    words = [f"w{i}" for i in range(300)]
    x, y = " ".join(words), " ".join(reversed(words))
    near = x + " w0"
    assert (simhash.fingerprint(x) ^ simhash.fingerprint(near)).bit_count() <= simhash.RADIUS
    rows = [(1, near, "a"), (5, x, "b"), (5, y, "c"), (7, "one other text", "d"), (7, "and a third text", "e"), (7, "and a third text", "f"), (None, y, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [sorted(tuple(r) for r in simhash.deduplicated(d).collect()) for d in (docs, docs.repartition(5, "source"), docs.orderBy(F.desc("source")).coalesce(1))]
    assert got[0] == got[1] == got[2]
    assert sorted(r[:2] for r in got[0]) == sorted([(1, near), (5, y), (7, "one other text"), (7, "and a third text")])


def test_deduplicated_with_equal_rows(spark):
    """A row that fills most of the table is one row afterwards, and its whole copies are gone before the shuffle."""
    docs = spark.range(4_000).select(F.lit(3).alias("doc_id"), F.lit("one text of four thousand").alias("text")).union(spark.createDataFrame([(1, "something else")], "doc_id int, text string"))
    out = simhash.deduplicated(docs)
    assert sorted(map(tuple, out.collect())) == [(1, "something else"), (3, "one text of four thousand")]


# 8. media


def test_media(edge, docs, none):
    for frame in (edge, docs):
        rows = written(media.listed(frame), "manifest")
        index = media.stored(frame, rows)
        assert index.count() == index.select("digest").distinct().count()
        got = rows.select("doc_id", "medium").join(media.verified(rows, index), "medium").join(frame.select("doc_id", "text").distinct(), "doc_id").collect()
        assert len(got) == frame.filter("doc_id is not null").count()
        for r in got:
            data = media.payload_of(r["text"] or "")
            assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
            assert r["medium"].hex() == r["media_sha256"] == hashlib.sha256(media.wav_header(len(data)) + data).hexdigest() and r["feature"] == media.features(data)
    rows = written(media.listed(none), "manifest")
    assert media.verified(rows, media.stored(none, rows)).count() == 0


def test_cuts_follow_the_content():
    rnd = np.random.default_rng(1)
    data = rnd.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    h = 0
    plain = [h := ((h << 1) + int(media.GEAR[b])) & 0xFFFFFFFF for b in data[:3_000]]
    assert media.gear_hashes(np.frombuffer(data[:3_000], np.uint8)).tolist() == plain
    a, b = media.chunked(data), media.chunked(data[:50_000] + b"inserted" + data[50_000:])
    assert b"".join(a) == data and len(set(a) & set(b)) >= len(a) - 3 and max(map(len, a)) <= media.MOST
    assert media.payload_of("") == bytes(64) and len(media.payload_of("x" * 64)) == 64


# 9. WARC


def test_warc(spark, none):
    pages = [(i, f"http://h/{i}", t) for i, t in enumerate(["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "é" * 300_000, "<p>a</p>"])] + [(6, "http://h/6", "<p>a</p>"), (None, None, "<p>a</p>")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).withColumn("digest", F.lit(1))
    both = [sorted(map(str, warc.decided(frame, most=m).collect())) for m in (0, 1_000)]
    assert both[0] == both[1]  # joined by id, or broadcast
    index = warc.bundled(warc.decided(frame))
    got = warc.read_back(index).collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, t in pages:
        if i is not None:
            first.setdefault(t or "", i)
    html = {i: t or "" for i, _, t in pages}
    for r in got:
        data = html[r["page_id"]].encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        keeper = first[html[r["page_id"]]]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if r["page_id"] == keeper else ("revisit", keeper))
        assert r["payload"] == (data if r["record_type"] == "response" else b"")
    assert warc.bundled(warc.decided(frame.filter("false"))).count() == 0
    one = warc.read_back(index.filter("page_id = 5")).first()
    assert one["payload_bytes"] == 600_000


def test_bundles_are_plain_zstandard(spark):
    """Any reader that skips skippable frames reads a bundle from front to end."""
    import io

    import zstandard

    frame = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 9_000) for i in range(20)], "page_id long, url string, html string")
    index = warc.bundled(warc.decided(frame).coalesce(1)).collect()
    path = index[0]["bundle"].removeprefix("file:").replace("//", "/")
    whole = zstandard.ZstdDecompressor().stream_reader(io.FileIO(path), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 20 and len({r["frame"] for r in index}) > 2


# 10. URL filters


def test_cascade_is_exact():
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 63), 1 << 63, (30_000, 2))
    listed = rng.random(30_000) < 0.03
    levels = []
    urlfilter.finish(levels, keys[listed], keys[~listed])
    assert (urlfilter.Cascade(levels).listed(keys[:, 0], keys[:, 1]) == listed).all() and len(levels) > 1
    assert not urlfilter.Cascade([]).listed(keys[:, 0], keys[:, 1]).any()


def test_spark_levels_equal_local(spark, monkeypatch):
    keys = spark.range(5_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    frame = written(keys.select("key", *urlfilter.hashes(F.col("key")), (F.xxhash64("key", F.lit(3)) % 20 == 0).alias("is_listed")), "keys")
    rows = frame.toPandas()
    a = urlfilter.build(frame)
    monkeypatch.setattr(urlfilter, "LOCAL", 300)
    b = urlfilter.build(frame)
    for c in (a, b):
        assert (c.listed(rows["h1"].to_numpy(), rows["h2"].to_numpy()) == rows["is_listed"].to_numpy()).all()
    assert urlfilter.build(frame, max_bytes=8) is None


@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_urls(spark, max_bytes):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "http://example.com/en/", "http://a.example.com/en?x", "http://x.net/es/1#f", "http://spam-farm.example.org/de/1", "http://m.spam-farm.example.org", "http://fine.example.org/fr/", "http://com/", "http://com", "http://xcom/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("key", F.lit(1))
    got = {r["row"]["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judged(frame, lambda k: F.substring_index(k, ".", 1).isin(urlfilter.LISTED), max_bytes=max_bytes).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[5] == ("example.com", "/en/", "example.com/en/", "block")
    assert got[6] == ("a.example.com", "/en", "com/", "allow") and got[7][2:] == ("net/es/", "block") and got[8][2:] == (None, "block") and got[9] == ("m.spam-farm.example.org", "", None, "block")
    assert got[10][2:] == (None, "allow") and got[11][2:] == ("com/", "allow") and got[12][2:] == (None, "allow") and got[13][2:] == (None, "allow")


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, kept, sf), name)
        assert after.columns == docs.columns and 0 < after.count() < kept.count()
        kept = after
    plan = corpus_pipeline.STAGES[-1][1](spark, kept, sf)
    assert {r[0] for r in plan.select("doc_id").distinct().collect()} == {r[0] for r in kept.select("doc_id").collect()}
