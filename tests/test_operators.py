"""Operators on small rows made by hand, with results worked out by hand or by brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import columns, licences, text
from corpusloom.operators import dedup, experiments, gates, joins, review, select, similarity, splits, validate
from corpusloom.operators.ratelimit import Admitted, admit


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "bucket"),
    [("Attribution 4.0", "cc_by"), ("CC0 1.0 Universal", "cc0_public_domain"), ("Attribution-NonCommercial-ShareAlike 3.0", "cc_by_nc"), ("Attribution-ShareAlike 3.0", "cc_by_sa"), ("Download Only", "other_unknown"), ("", "other_unknown"), (None, "other_unknown"), ("cc by", "cc_by"), ("No Derivatives", "cc_by_nd")],
)
def test_bucket(spark, name, bucket):
    assert one(spark, licences.bucket(F.lit(name).cast("string"))) == bucket


def test_policies_disagree(spark):
    hyphened = F.lit("Attribution-Non-Commercial")
    assert one(spark, licences.strictly_deployable(hyphened)) and one(spark, licences.disagreement(hyphened))
    assert one(spark, licences.licence_class(F.lit("Some Licence"))) == "non-commercial"


def test_ids_and_places(spark):
    assert one(spark, columns.stable_id(F.lit("a"), F.lit("bc"))) != one(spark, columns.stable_id(F.lit("ab"), F.lit("c")))
    assert one(spark, columns.stable_id(F.lit(None), F.lit("x"))) != one(spark, columns.stable_id(F.lit("x"), F.lit(None)))
    assert one(spark, columns.hash_position(42, "song", F.lit("Track00001"))) == 0.35360340521001943


def test_paths(spark):
    assert one(spark, columns.track_from_path(F.lit("/d/Track00001/stems/S01.wav"))) == "Track00001"
    assert one(spark, columns.track_from_path(F.lit("/d/band/mix.wav"))) == "band"
    assert one(spark, columns.track_from_path(F.lit("/d/a/b.wav"), "/d")) == "a__b"
    assert one(spark, columns.normalize_tags(F.array(F.lit(" Rock "), F.lit("a b"), F.lit(""), F.lit("rock"), F.lit(None)))) == ["a_b", "rock"]
    assert one(spark, columns.normalize_tags(F.lit(None).cast("array<string>"))) == []
    assert one(spark, columns.genre_ids(F.lit("[21, x, 76]"))) == ["21", "76"]


@pytest.mark.parametrize(("n", "want"), [(100, (80, 10, 10)), (3, (1, 1, 1)), (1, (1, 0, 0)), (0, (0, 0, 0)), (10, (8, 1, 1))])
def test_quota_counts(n, want):
    assert tuple(splits.quota_counts(n).values()) == want


def test_quota_split_is_independent_of_order(spark):
    keys = [(f"k{i}",) for i in range(97)]
    a = {r[0]: r[1] for r in splits.by_quota(spark.createDataFrame(keys, "k string"), "k").collect()}
    random.Random(1).shuffle(keys)
    b = {r[0]: r[1] for r in splits.by_quota(spark.createDataFrame(keys, "k string").repartition(7), "k").collect()}
    assert a == b and len(a) == 97
    order = sorted(a, key=lambda k: (int(__import__("hashlib").sha256(f"42:song:{k}".encode()).hexdigest()[:16], 16) / 2**64, k))
    counts = splits.quota_counts(97)
    assert [a[k] for k in order] == ["train"] * counts["train"] + ["val"] * counts["val"] + ["test"] * counts["test"]


def test_weighted_split_uses_all():
    import numpy as np

    weights = np.array([1000.0, 100.0, 100.0, 100.0, 100.0])
    plan = splits.balanced(list("ABCDE"), weights, np.arange(5) / 10)
    held = [weights[plan == k].sum() for k in range(3)]
    assert set(plan.tolist()) == {0, 1, 2} and int(np.argmax(held)) == 0
    assert splits.balanced(list("AB"), np.array([5.0, 1.0]), np.zeros(2)).tolist() == [0, 1]
    lone = splits.balanced(list("ABC"), np.array([1e9, 1.0, 1.0]), np.arange(3) / 3, {"train": 1.0, "val": 1e-12, "test": 1e-12})
    assert sorted(lone.tolist()) == [0, 1, 2]


def test_weighted_split_goes_where_most_is_lacking():
    """Every key, by falling weight, against the rule taken literally."""
    import numpy as np

    rnd = random.Random(4)
    for _ in range(40):
        n = rnd.randint(1, 30)
        weights, places = np.array([float(rnd.randint(1, 9)) for _ in range(n)]), np.array([rnd.random() for _ in range(n)])
        plan = splits.balanced(list(range(n)), weights, places)
        goal = weights.sum() * np.array([0.8, 0.1, 0.1])
        held, want = np.zeros(3), {}
        for i in sorted(range(n), key=lambda i: (-weights[i], places[i])):
            k = int(np.argmax(np.round((goal - held) / goal, 12)))
            held[k] += weights[i]
            want[i] = k
        if len(set(want.values())) == 3 or n < 3:
            assert plan.tolist() == [want[i] for i in range(n)]


def test_allocation():
    plan = select.allocation({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1000, "b": 10, "c": 1000}, 100)
    assert plan["a"] == {"quota": 50, "pool": 1000, "unique": 63, "granted": 13, "repeats": 0}
    assert plan["b"]["unique"] == 10 and plan["b"]["repeats"] == 20
    assert sum(p["unique"] for p in plan.values()) == 100
    with pytest.raises(ValueError):
        select.allocation({"a": 0.5}, {"a": 3}, 10)


def test_assembled_repeats_the_pool(spark):
    rows = spark.createDataFrame([("b", i) for i in range(4)] + [("a", i) for i in range(20)], "family string, id long")
    plan = {"b": {"unique": 4, "repeats": 6, "pool": 4}, "a": {"unique": 5, "repeats": 0, "pool": 20}}
    got = [(r["family"], r["id"], r["repeat_index"]) for r in select.assembled(rows, "family", "id", plan).collect()]
    assert len(got) == len(set(got)) == 15
    by = [sum(f == "b" and k == i for f, _, k in got) for i in range(3)]
    assert by == [4, 4, 2]


def in_cells(frame):
    """Whether no row is numbered in a window of its whole group."""
    specs = [x.split(")")[0] for x in frame._jdf.queryExecution().optimizedPlan().toString().split("row_number() windowspecdefinition(")[1:]]
    return len(specs) > 0 and all("__cell" in x for x in specs)


def test_assembled_numbers_in_cells(spark):
    """The same places as in one window of a family, of which one holds nearly all rows."""
    pools = {"a": 3000, "b": 40}
    rows = spark.createDataFrame([(f, i) for f, n in pools.items() for i in range(n)], "family string, id long")
    plan = {"a": {"unique": 2900, "repeats": 0, "pool": 3000}, "b": {"unique": 40, "repeats": 60, "pool": 40}}
    got = select.assembled(rows, "family", "id", plan)
    assert in_cells(got)
    want = set()
    for f, n in pools.items():
        first = sorted(range(n), key=lambda i: hashlib.sha256(f"42:{i}".encode()).hexdigest())
        want |= {(f, i, 0) for i in first[: plan[f]["unique"]]} | {(f, first[k % n], 1 + k // n) for k in range(plan[f]["repeats"])}
    assert {(r["family"], r["id"], r["repeat_index"]) for r in got.collect()} == want


def test_stratified_numbers_in_cells(spark):
    """Evenly spread rows of a hot track, of small ones and of none, by an order with nulls."""
    rnd = random.Random(5)
    rows = [("hot", rnd.randint(0, 300), i) for i in range(2000)] + [(f"t{i % 9}", None if i % 7 == 0 else i, i) for i in range(60)] + [(None, 1, 1), (None, 1, 2)]
    frame = spark.createDataFrame(rows, "track string, at int, id long")
    got = select.stratified(frame, F.col("track"), ["at", "id"], 4)
    assert in_cells(got) and got.columns == frame.columns
    want = {r for r in rows if r[0] is None}
    for t in {r[0] for r in rows} - {None}:
        own = sorted((r for r in rows if r[0] == t), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want |= {own[int(i * (len(own) / 4))] for i in range(4)} if len(own) > 4 else set(own)
    assert {tuple(r) for r in got.collect()} == want


def test_replay_streams_a_client(spark):
    """A client's requests pass in several batches, and its state with them."""
    log = spark.range(25_000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.when(F.col("id") % 7 == 0, 2).otherwise(1)).alias("client"), F.timestamp_seconds(F.col("id") * 7 % 25_000 * 11).alias("ts"))
    got = experiments.admitted_requests(log.repartition(3), "client", "ts", 3, 900)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()
    limiters, want = {}, set()
    for i in sorted(range(25_000), key=lambda i: (i * 7 % 25_000, i)):
        client = None if i % 5 == 0 else 2 if i % 7 == 0 else 1
        limiters[client], ok = admit(limiters.get(client, Admitted()), i * 7 % 25_000 * 11_000_000, 3, 900)
        if ok:
            want.add(i)
    assert {r["event_id"] for r in got.filter("accepted").collect()} == want and 900 < len(want) < 25_000


def test_greedy_cover_matches_the_plain_greedy(spark):
    rnd = random.Random(3)
    fams = "ABCDE"
    tracks = [(f"t{i:03}", sorted(rnd.sample(fams, rnd.randint(0, 3))), ) for i in range(60)]
    frame = spark.createDataFrame([(t, a, a) for t, a in tracks], "track_id string, families array<string>, audible array<string>")
    quotas = {"A": 2, "B": 5, "C": 1, "D": 3, "E": 9}
    got = [r["track_id"] for r in select.greedy_cover(frame, 12, quotas).orderBy("pick").collect()]
    prevalence = {f: sum(f in a for _, a in tracks) for f in fams}
    pool, left, want = dict(tracks), dict(quotas), []
    while len(want) < 12:
        best = max(pool, key=lambda t: (sum(1 / prevalence[f] for f in pool[t] if left[f] > 0) + 1e-6 * len(pool[t]), t))
        for f in pool.pop(best):
            left[f] = max(0, left[f] - 1)
        want.append(best)
    assert got == want


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", "x", "train", 1), ("b", "x", "val", 2), ("c", "", "train", 3), ("d", None, "val", 4), ("e", "y", "val", 5), ("f", "y", "val", 6)], "id string, h string, split string, n int")
    kept = {r["id"]: r["kept"] for r in dedup.keep_first(rows, "h", ["n"]).collect()}
    assert kept == {"a": True, "b": False, "c": True, "d": True, "e": True, "f": False}
    r = dedup.report(rows, "h").first()
    assert (r["fingerprinted"], r["duplicate_groups"], r["rows_in_groups"], r["cross_split_groups"], r["ok"]) == (4, 2, 4, 1, False)
    assert [x["h"] for x in dedup.spanning(rows, "h", "split").collect()] == ["x"]
    assert dedup.report(rows.filter("false"), "h").first()["ok"]


def test_corpus_records(spark):
    good = ("d", "t", "p", "MIT", "permissive", "u", "train", "h", 0.5)
    cols = "dataset string, track_id string, audio_path string, licence string, licence_class string, source_url string, split string, duplicate_hash string, quality_score double"
    rows = [good, ("d", "t", "p", "CC-BY-NC-4.0", "permissive", "u", "train", "h", None), ("d", "t", "p", "CC-BY-NC-4.0", "research-only", "u", "train", "h", None), ("d", "", "p", "MIT", "permissive", "u", "train", "h", 0.5), ("d", "t", "p", "MIT", "permissive", "u", "train", "h", 1.5), ("d", "t", "p", "MIT", "permissive", "u", None, "h", None)]
    got = [r["p"] for r in spark.createDataFrame(rows, cols).select(validate.corpus_problem().alias("p")).collect()]
    assert got == [None, "licence is not on the allowlist", None, "missing required field track_id", "quality score outside [0, 1]", "bad split"]
    with pytest.raises(Exception, match="track_id"):
        validate.refuse_invalid(spark.createDataFrame(rows[3:4], cols)).collect()


def test_same_rows(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    assert validate.same_rows(a, a.repartition(3)) and not validate.same_rows(a, a.distinct())


def test_curves(spark):
    c = spark.createDataFrame([("r", s, 10.0 - s) for s in (0, 1, 2, 2, 4)] + [("q", 0, 1.0)], "run string, step int, loss double")
    got = {r["run"]: r for r in experiments.step_integrity(c, "run", "step", 5).collect()}
    assert (got["r"]["n_repeated"], got["r"]["n_missing"], got["q"]["n_missing"]) == (1, 1, 4)
    assert [(r["run"], r["step"]) for r in experiments.missing_steps(c, "run", "step").collect()] == [("r", 3)]
    w = {r["run"]: r for r in experiments.curve_windows(c, "run", "step", "loss").collect()}
    assert w["r"]["decreased"] and not w["q"]["decreased"]


def test_limiter():
    state, got = Admitted(), []
    for t in (0, 1, 2, 61, 62, 130, 86_500):
        state, ok = admit(state, t * 1_000_000, 2, 3)
        got.append(ok)
    assert got == [True, True, False, True, False, False, True]


def test_limiter_is_the_rule():
    """Against the whole list of accepted times."""
    rnd = random.Random(8)
    state, accepted, now, opened = Admitted(), [], 0, None
    for _ in range(4_000):
        now += rnd.choice([0, 1_000_000, 20_000_000, 59_000_000, 60_000_000, 60_000_001, 3_000_000_000])
        state, ok = admit(state, now, 3, 40)
        fresh = opened is None or now - opened > 86_400_000_000
        used = 0 if fresh else sum(t >= opened for t in accepted)
        want = sum(now - t <= 60_000_000 for t in accepted) < 3 and used < 40
        if want:
            opened = now if fresh else opened
            accepted.append(now)
        assert ok == want


def test_tail_and_nth_largest(spark):
    from corpusloom.operators import splits as s

    values = [3, 3, 3, 1, 9, 4, None, 9, 2] + list(range(100, 160)) + [50] * 40
    frame = spark.createDataFrame([(v,) for v in values], "x int")
    ranked = sorted((v for v in values if v is not None), reverse=True)
    known = frame.filter("x is not null")
    for nth in (1, 2, 59, 61, 70, 108):
        assert s.largest(known, "x", nth, few=5) == ranked[nth - 1] == s.largest(known, "x", nth)
    assert s.largest(known, "x", 109) is None and s.largest(known, "x", 0) is None
    assert s.tail(spark.range(50), "id").filter("split = 'val'").count() == 5 and s.tail(spark.range(1), "id").filter("split = 'val'").count() == 0


def test_bootstrap(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 0, -1)], "delta double")
    r = experiments.bootstrap(d, iterations=500).first()
    assert (r["n"], r["wins"], r["losses"]) == (5, 3, 2) and r["low"] < 1.0 < r["high"]
    again = experiments.bootstrap(d.repartition(3), iterations=500).first()
    assert (again["low"], again["high"]) == (r["low"], r["high"])


def test_bootstrap_has_no_bound(spark):
    """More than a million items, of which a third share one delta, and in many cells the interval of the normal law."""
    many = spark.range(1_200_000).select(F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") % 1000).cast("double")).alias("delta"))
    r = experiments.bootstrap(many, iterations=300, cell_values=50).first()
    mean, sd = many.agg(F.avg("delta"), F.stddev("delta")).first()
    half = 1.96 * sd / 1_200_000**0.5
    assert r["n"] == 1_200_000 and r["wins"] == many.filter("delta > 0").count() and abs(r["mean"] - mean) < 1e-9
    assert 0.8 * half < mean - r["low"] < 1.25 * half and 0.8 * half < r["high"] - mean < 1.25 * half
    again = experiments.bootstrap(many.repartition(7), iterations=300, cell_values=50).first()
    assert (again["mean"], again["low"], again["high"]) == (r["mean"], r["low"], r["high"])


def test_review(spark):
    sheet = spark.createDataFrame([("_legend", "1", "2"), ("piano", "5", "N/A"), ("vocal", "", "11"), ("guitar", "3.5", "8")], "track string, prompt_adherence string, vocal_realism string")
    long = review.long_sheet(sheet)
    states = {(r["track"], r["dimension"]): r["state"] for r in long.collect()}
    assert states[("piano", "vocal_realism")] == "na" and states[("vocal", "prompt_adherence")] == "missing" and states[("vocal", "vocal_realism")] == "bad" and ("_legend", "vocal_realism") not in states
    c = review.completeness(long).first()
    assert (c["expected"], c["filled"]) == (5, 3)
    assert review.ranked_dimensions(long).filter("dimension = 'prompt_adherence'").first()["worst_track"] == "guitar"


def test_prompts(spark):
    p = spark.createDataFrame([("Warm piano and live drums, hip hop, 90 bpm, final chorus then outro",)], "prompt string")
    r = text.annotated(p).first()
    assert r["genre"] == ["hip hop"] and r["bpm"] == 90 and r["structure"] == ["outro", "chorus"] and r["duration_seconds"] == 60.0
    assert sorted(r["instruments"]) == ["live drums", "warm piano"]
    assert one(spark, text.fix_articles(F.lit("A unhurried song, an loud end"))) == "An unhurried song, a loud end"
    assert one(spark, text.humanise(F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == "a, b and c"
    assert one(spark, text.label_caption(F.array().cast("array<string>"), F.array().cast("array<string>"))) == "instrumental recording"


def test_prompts_are_read_once(spark):
    p = spark.createDataFrame([(1, "Warm piano, hip hop")], "request_id int, prompt string")
    a = text.annotated(p, with_instruments=False)
    plan = a.select("genre", "mood", "bpm", "key", "structure", "vocal")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1 and plan.count("split(") == 1
    requests = a.select("request_id", F.array(F.lit("mood"), F.lit("bpm")).alias("controls"), F.lit(True).alias("wants_vocals"), "duration_seconds", "vocal.language")
    can = spark.createDataFrame([("m", "mood", "ignored"), ("m", "bpm", "native"), ("m", "key", "native"), ("n", "key", "native")], "model string, control string, support string")
    limits = spark.createDataFrame([("m", False, 30.0, []), ("n", True, 30.0, [])], "model string, sings boolean, max_seconds double, languages array<string>")
    got = joins.resolved_controls(requests, can, limits)
    assert [tuple(r) for r in got.collect()] == [(1, "m", ["bpm=native", "mood=ignored"], ["mood: not supported", "vocals: not supported", "duration: too long"])]
    assert "Exchange hashpartitioning(request_id" not in got._jdf.queryExecution().executedPlan().toString()  # requests stay where they are


def test_prompts_match_brute_force(spark):
    rnd = random.Random(7)
    pieces = [*text.GENRES, *text.MOODS, *text.LANGUAGES, *text.VOICES, *"pre-chorus prechorus pre chorus intro verse solo finals final finale outro drop voice invoice vocals choir choirs sung female man no instrumental build up to huge ending quiet loud fade out".split()]
    said = ["".join(x for _ in range(rnd.randint(0, 12)) for x in (rnd.choice(pieces), rnd.choice([" ", " ", " ", " ", "-", ", ", "_", "é", "\n", "1", ""]))) for _ in range(1500)]
    rows = text.annotated(spark.createDataFrame(list(enumerate(said)), "id int, prompt string"), with_instruments=False).collect()
    assert len(rows) == len(said)
    word = lambda w, t: re.search(rf"\b{re.escape(w)}\b", t)
    for r in rows:
        t = said[r["id"]]
        found = [g for g in text.GENRES if word(g, t)]
        assert r["genre"] == [g for g in found if not any(g != o and g in o for o in found)] and r["mood"] == [m for m in text.MOODS if word(m, t)]
        places = [(m.start(), i, k) for i, (k, p) in enumerate(text.SECTIONS.items()) if (m := re.search(p, t))]
        assert r["structure"] == [k for *_, k in sorted(places)] and r["energy"] == [e for e, p in text.ENERGY.items() if re.search(p, t)]
        gender = next((g for g, ws in text.GENDERS.items() if any(word(w, t) for w in ws)), None)
        language = next((c for n, c in text.LANGUAGES.items() if word(n, t)), None)
        style = next((v for v in text.VOICES if re.search(rf"\b{v}\b(?:\s+\w+){{0,2}}\s+(voice|vocal|singing|singer)", t)), None)
        wanted = gender or language or re.search(r"\bvocal|voice|singer|singing|sung|choir\b", t)
        want = (False, None, None, None) if re.search(r"\binstrumental\b|\bno vocals?\b", t) else (True, gender, style, language) if wanted else None
        assert (tuple(r["vocal"]) if r["vocal"] else None) == want


def test_leak_guard_matches_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(80)]
    needles = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 8)))) for i in range(30)] + [(99, docs[7][1][1:-1] or "zz")]
    got = joins.containing(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(needles, "n int, needle string"), "id", "text", "n", "needle")
    assert {(r["id"], r["n"]) for r in got.collect()} == {(i, n) for i, t in docs for n, x in needles if x in t}
    got = joins.containing(spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(needles, "n int, needle string"), "id", "text", "n", "needle", few=4, held=0)
    assert {(r["id"], r["n"]) for r in got.collect()} == {(i, n) for i, t in docs for n, x in needles if x in t}


def test_near_windows_lose_nothing(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    for dim, signed in ((12, False), (40, True), (3, True)):
        base = rng.normal(size=(60, dim)) if signed else np.abs(rng.normal(size=(60, dim)))
        base[40:50] = base[:10]  # repeats
        base /= np.linalg.norm(base, axis=1, keepdims=True)
        near = base + rng.normal(scale=0.24 / dim**0.5 / 2, size=base.shape)
        near /= np.linalg.norm(near, axis=1, keepdims=True)
        near[7] = 0.0
        a = spark.createDataFrame([("c", i, v.tolist()) for i, v in enumerate(near[5:25])], "candidate string, i int, vec array<double>")
        b = spark.createDataFrame([("x", j, v.tolist()) for j, v in enumerate(base)], "item string, j int, vec array<double>")
        got = [(r["i"], r["j"]) for r in similarity.near_windows(a, b, dim).collect()]
        sims = near[5:25] @ base.T
        assert sorted(got) == sorted(zip(*(x.tolist() for x in np.nonzero(sims >= 0.985)))) and len(got) > 5
        p, q = similarity.by_blocks(a, b, dim).first(), similarity.by_matrix(a, b).first()
        assert p.asDict() | {"max_cosine": 0} == q.asDict() | {"max_cosine": 0}
        assert similarity.by_matrix(a, b, max_windows=5).first() == p
        assert similarity.near_windows(a.filter("false"), b, dim).count() == 0 == similarity.near_windows(a, b.filter("false"), dim).count()


def test_copies_of_items_are_screened_once(spark, monkeypatch):
    """Items with equal windows give the rows that each alone would give, and only one of them is paired."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    song = lambda name, rows: [(name, k, x[r].tolist()) for k, r in enumerate(rows)]
    a = spark.createDataFrame([r for k in range(6) for r in song(f"c{k}", [1, 2, 3])] + song("d", [3, 2, 1]), "candidate string, i int, vec array<double>")
    b = spark.createDataFrame([r for k in range(5) for r in song(f"x{k}", [0, 1, 2, 3, 4])] + song("y", [2, 5]), "item string, j int, vec array<double>")
    seen, plain = [], similarity.near_windows
    monkeypatch.setattr(similarity, "near_windows", lambda p, q, *rest: seen.append((p.select("candidate").distinct().count(), q.select("item").distinct().count())) or plain(p, q, *rest))
    tops = lambda f: sorted((r["candidate"], r["closest_item"], r["matched_windows"], r["suspicious"]) for r in f.collect())
    got = tops(similarity.by_blocks(a, b, 10))
    assert seen == [(2, 2)] and got == tops(similarity.by_matrix(a, b))
    assert got[:6] == [(f"c{k}", "x0", 3, True) for k in range(6)] and got[6][0] == "d"


def test_nearest_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    unit = lambda n: (lambda z: z / np.linalg.norm(z, axis=1, keepdims=True))(rng.normal(size=(n, 5)))
    ours, theirs = {f"c{k}": unit(n) for k, n in enumerate([1, 3, 8, 2])}, {f"x{k}": unit(n) for k, n in enumerate([4, 2, 3, 6])}
    theirs["x9"] = theirs["x0"]  # a tie
    a = spark.createDataFrame([(c, i, v.tolist()) for c, w in ours.items() for i, v in enumerate(w)], "candidate string, i int, vec array<double>")
    b = spark.createDataFrame([(c, j, v.tolist()) for c, w in theirs.items() for j, v in enumerate(w)], "item string, j int, vec array<double>")
    want = {}
    for c, u in ours.items():
        for item, v in sorted(theirs.items()):
            short, long_ = (u, v) if len(u) <= len(v) else (v, u)
            top = max((short * long_[o : o + len(short)]).sum(axis=1).max() for o in range(len(long_) - len(short) + 1))
            if top > max(want.get(c, ("", 0.0))[1], 0.0) + 1e-12:
                want[c] = (item, top)
    for most in (20_000, 4):
        got = {r["candidate"]: (r["closest_item"], r["max_cosine"]) for r in similarity.nearest(a, b, most).collect()}
        assert {c: x[0] for c, x in got.items()} == {c: x[0] for c, x in want.items()}
        assert all(abs(got[c][1] - want[c][1]) < 1e-9 for c in want)
    assert similarity.by_matrix(a.filter("false"), b).count() == 0 == similarity.by_blocks(a, b.filter("false"), 5).count()
    assert similarity.nearest(a.filter("false"), b).count() == 0 == similarity.nearest(a, b.filter("false")).count()
    candidates = spark.createDataFrame([("c1", "h"), ("zz", "")], "item string, pcm_sha256 string")
    verdicts = similarity.screen(candidates, similarity.by_matrix(a, b), similarity.exact(candidates, candidates.filter("false")), similarity.nearest(a, b))
    shown = {r["candidate"]: r for r in verdicts.collect()}
    assert shown["c1"]["closest_item"] == want["c1"][0] and not shown["c1"]["suspicious"] and shown["zz"]["closest_item"] is None


def test_screen(spark):
    """Exact copies first, then runs; a candidate that is near to nothing is not suspicious."""
    unit = lambda k: [float(i == k) for i in range(6)]
    candidates = spark.createDataFrame([("a", "h1"), ("b", "zz"), ("c", ""), ("d", None)], "item string, pcm_sha256 string")
    db = spark.createDataFrame([("x", "h1"), ("w", "h1"), ("y", ""), ("z", None)], "item string, pcm_sha256 string")
    windows = spark.createDataFrame([("b", i, unit(k)) for i, k in enumerate([1, 2, 3])] + [("c", 0, unit(5)), ("c", 1, unit(1))], "candidate string, i int, vec array<double>")
    stored = spark.createDataFrame([("y", j, unit(k)) for j, k in enumerate([0, 1, 2, 3, 4])], "item string, j int, vec array<double>")
    got = {r["candidate"]: r for r in similarity.screen(candidates, similarity.by_blocks(windows, stored, 6), similarity.exact(candidates, db)).collect()}
    assert (got["a"]["exact_duplicate_of"], got["a"]["closest_item"], got["a"]["max_cosine"], got["a"]["suspicious"]) == ("w", "w", 1.0, True)
    assert (got["b"]["closest_item"], got["b"]["matched_windows"], got["b"]["suspicious"]) == ("y", 3, True)
    assert (got["c"]["matched_windows"], got["c"]["suspicious"]) == (1, False) and (got["d"]["closest_item"], got["d"]["suspicious"]) == (None, False)


def test_gates_in_order(spark):
    cols = "id int, dataset string, licence string, source_url string, duplicate_hash string, track_id string, split string, duration_seconds double, silent boolean, clipping_ratio double, quality_score double, caption string"
    ok = ("d", "CC0", "u", "h{}", "t{}", "train", 5.0, False, 0.0, 1.0, "four words are here")
    make = lambda i, **over: (i, *(over.get(k, v.format(i) if isinstance(v, str) else v) for k, v in zip(("dataset", "licence", "source_url", "duplicate_hash", "track_id", "split", "duration_seconds", "silent", "clipping_ratio", "quality_score", "caption"), ok)))
    rows = [make(1), make(2, licence="what"), make(3, source_url=None), make(4, duplicate_hash="same"), make(5, duplicate_hash="same", dataset="e"), make(6, duration_seconds=0.5, silent=True), make(7, silent=True), make(8, clipping_ratio=0.5), make(9, track_id="shared"), make(10, track_id="shared", split="val"), make(11, quality_score=None), make(12, caption="few words"), make(13, licence="Attribution-ShareAlike 3.0")]
    got = gates.admitted(spark.createDataFrame(rows, cols))
    failed = {r["id"]: r["failed_gate"] for r in got.collect()}
    assert failed == {1: None, 2: "licence", 3: "provenance", 4: "cross_corpus_duplicate", 5: "cross_corpus_duplicate", 6: "integrity_decode", 7: "silence", 8: "clipping_quality", 9: "split_leakage", 10: "split_leakage", 11: "metadata", 12: "rich_caption", 13: "deployability"}
    funnel = validate.funnel(got, gates.GATES).orderBy("gate_no").collect()
    assert funnel[0]["n_in"] == 13 and funnel[-1]["n_failed"] == 1
