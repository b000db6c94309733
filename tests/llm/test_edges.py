"""Every operator and every stage over one awkward table: ids of several kinds, nulls, repeated ids with different texts,
repeated rows, and columns named like everything that the operators add; and over its empty copy."""

import itertools

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import licenses, media, packing, quality, queries, resharding, simhash, spencode, toxicity, urlfilter, warc
from corpusloom.llm.common import written

#: Names that operators use for columns of their own, beside those of documents.
NAMES = """row key block size text_crc32 old_shard bucket shard slot before nth cell rules base_failed excess kept n_words word_chars toxicity score ids decoded hits licence
fp node root component least n host path rule verdict is_listed h1 h2 order best digest first payload refers_to medium samples chunks n_bytes parts doc_tokens crcs rank wholes class whole
start length ids_crc32 sequence_id offset place toxic quality labels dotted.name Kept_ __key __text __row""".split()
WORDS = " ".join(f"word{i}" for i in range(300))
TEXTS = [None, "", " \t\n", "one", "a a a a a", "x" * 20_000, "word " * 3_000, "Ünïcode ▁ mark ½ 漢字 é   <|endoftext|>", WORDS, WORDS, WORDS + " word0", " ".join(reversed(WORDS.split())), "same text here", "Released under the MIT License. " + WORDS]
LONG = [None, None, 5, 5, 5, 1 << 60, (1 << 60) + 1, (1 << 60) + 3, 0, 1, -7, 8, 8, 1 << 62]


def awkward(spark, ids, kind):
    rows = [(i, t, None if k % 3 == 0 else "en", "s", k) for k, (i, t) in enumerate(zip(ids, TEXTS))]
    rows.append(rows[9])  # a whole row again
    frame = spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, n_chars long")
    kinds = [F.lit("mine"), F.lit(-1), F.lit(True), F.array(F.lit(0.5)), F.struct(F.lit(1).alias("x")), F.create_map(F.lit("k"), F.lit(None).cast("string"))]
    return written(frame.select("*", *(c.alias(n) for n, c in zip(NAMES, itertools.cycle(kinds)))), "awkward")


@pytest.fixture(scope="module", params=["long", "string", "empty"])
def table(spark, request):
    if request.param == "string":
        return awkward(spark, [None if i is None else f"id {i}" for i in LONG], "string")
    frame = awkward(spark, LONG, "long")
    return frame.filter("false") if request.param == "empty" else frame


def same(rows, frame):
    """Whether rows holds the rows of frame, all columns and repeats included."""
    assert rows.columns == frame.columns and rows.dtypes == frame.dtypes
    return sorted(str(r.asDict(True)) for r in rows.collect()) == sorted(str(r.asDict(True)) for r in frame.collect())


def ids_of(frame, name="doc_id"):
    return sorted(map(str, (r[0] for r in frame.select(name).collect())))


def test_sentencepiece(table):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = spencode.encoded(table, path)
    assert same(found.select("row.*"), table) and ids_of(spencode.checked(table, path)) == ids_of(table)
    assert same(spencode.decoded(found, path).select("row.row.*"), table)


def test_resharding(table):
    old = resharding.laid_out(resharding.sized(table), 3)
    rows = resharding.slotted(resharding.resharded(old, 5), F.col("row.doc_id"))
    assert same(rows.select("row.*"), table)
    for _, own in itertools.groupby(sorted((r["shard"], r["slot"]) for r in rows.select("shard", "slot").collect()), key=lambda x: x[0]):
        own = list(own)
        assert [slot for _, slot in own] == list(range(len(own)))


def test_packing(table):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokens = written(packing.tokenized(table, path), "tokens")
    plan = packing.packed(tokens, cells=4)
    assert plan.schema["doc_id"].dataType == table.schema["doc_id"].dataType
    rows = plan.collect()
    assert ids_of(plan.filter("start = 0")) == ids_of(table)
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in tokens.collect())
    taken = {(r["sequence_id"], r["offset"] + k) for r in rows for k in range(r["length"])}
    assert len(taken) == sum(r["length"] for r in rows) and all(0 <= at < 2048 for _, at in taken)


def test_toxicity(spark, table):
    kind = table.schema["doc_id"].dataType.simpleString()
    labels = spark.createDataFrame([(1, 1), (5, 0), (5, 1), (8, None), (None, 1)], "doc_id int, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))
    for known in (labels, labels.filter("false")):
        found = toxicity.scored(table, toxicity.fit(table, known))
        assert same(found.select("row.*"), table) and all(0 <= r[0] <= 1 for r in found.select("toxicity.score").collect())


def test_licences(table):
    found = licenses.scanned(table)
    assert same(found.select("row.*"), table)
    n = 0 if table.isEmpty() else 1
    assert found.filter(F.size("hits") > 0).count() == licenses.found(table).filter("licence = 'MIT'").count() == n


def test_quality(spark, table):
    stats = written(quality.statistics(table), "stats")
    kind = table.schema["doc_id"].dataType.simpleString()
    labels = spark.createDataFrame([(0, 1), (8, 0), (None, 1), (5, None)], "doc_id int, quality int").withColumn("doc_id", F.col("doc_id").cast(kind))
    for known in (labels, labels.filter("false")):
        assert same(quality.judged(stats, quality.fit(stats, known, trees=3)).select("row.*"), table)


def test_simhash(table):
    assert same(simhash.fingerprints(table).select("row.*"), table)
    rows = simhash.clustered(table).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ids_of(table)
    for _, own in itertools.groupby(sorted(rows, key=lambda r: r["fp"]), key=lambda r: r["fp"]):
        own = list(own)
        known = [r["doc_id"] for r in own if r["doc_id"] is not None]
        assert len({r["component"] for r in own}) == 1 and (not known or own[0]["component"] is not None and own[0]["component"] <= min(known))
    kept = simhash.deduplicated(table)
    assert kept.columns == table.columns and kept.dtypes == table.dtypes
    every = [(r["doc_id"], r["text"], simhash.fingerprint(r["text"] or "")) for r in table.select("doc_id", "text").collect()]
    groups = []
    for row in every:  # merge what a row is near to
        near = [g for g in groups if any((row[2] ^ o[2]).bit_count() <= 2 for o in g)]
        groups = [g for g in groups if g not in near] + [[row, *(o for g in near for o in g)]]
    left = [(r["doc_id"], r["text"]) for r in kept.select("doc_id", "text").collect()]
    assert len(left) == len(groups)
    for g in groups:
        known = [i for i, _, _ in g if i is not None]
        mine = [x for x in left if x in [o[:2] for o in g]]
        assert len(mine) == 1 and mine[0][0] == (min(known) if known else None)


def test_media(table):
    rows = written(media.listed(table), "manifest")
    found = media.verified(rows, media.stored(table, rows))
    assert ids_of(rows) == ids_of(table) and found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] == table.count()


def test_warc(table):
    pages = table.select("*", F.hash("doc_id").cast("long").alias("page_id"), F.col("text").alias("html"), F.lit("u").alias("url"))
    for most in (0, 100):
        back = warc.read_back(warc.bundled(warc.decided(pages, most=most)))
        assert ids_of(back, "page_id") == ids_of(pages, "page_id")


def test_urls(table):
    pages = table.withColumn("url", F.concat(F.lit("http://a.spam-farm.org/"), F.col("source")))
    for most in (0, 1 << 20):
        found = urlfilter.judged(pages, lambda k: F.substring_index(k, ".", 1).isin(urlfilter.LISTED), max_bytes=most)
        assert same(found.select("row.*"), pages) and found.filter("verdict = 'block'").count() == table.count()


def test_stages(spark, sf, table):
    """What a stage keeps are rows of its input, unchanged."""
    given = [str(r.asDict(True)) for r in table.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, table, sf)
        assert kept.columns == table.columns and kept.dtypes == table.dtypes, name
        assert set(str(r.asDict(True)) for r in kept.collect()) <= set(given), name
    assert ids_of(corpus_pipeline.STAGES[-1][1](spark, table, sf).filter("start = 0")) == ids_of(table)


def test_pipeline_stage_by_stage(spark, sf):
    """Every stage against a plain version of its rule over what it is given, in one process."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}

    stats = written(quality.statistics(docs), "stats")
    model = quality.fit(stats, labels)
    counts = {i: quality.count_rules(t) for i, t in rows.items()}
    good = {i for i, c in counts.items() if c[0] >= 50 and 2 * c[4] <= c[0] and model.excess(np.array([c]))[0] <= 0}
    after = written(stages["quality_rules"](spark, docs, sf), "a")
    assert {r["doc_id"] for r in after.collect()} == good and after.columns == docs.columns

    model = toxicity.fit(after, labels)
    mild = {i for i in good if model.score(rows[i])[0] < 0.5}
    after = written(stages["toxicity"](spark, after, sf), "b")
    assert {r["doc_id"] for r in after.collect()} == mild

    prints = {i: simhash.fingerprint(rows[i]) for i in sorted(mild)}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    after = written(stages["near_duplicates"](spark, after, sf), "c")
    kept = {i for i in prints if find(i) == i}
    assert {r["doc_id"] for r in after.collect()} == kept

    plan = stages["packing"](spark, after, sf).collect()
    ends = {}
    for p in sorted(plan, key=lambda p: (p["doc_id"], p["start"])):
        assert ends.get(p["doc_id"], 0) == p["start"]
        ends[p["doc_id"]] = p["start"] + p["length"]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert ends == {i: len(plain.encode(rows[i], add_special_tokens=False).ids) + 1 for i in kept}
    held = {}
    for p in plan:
        held[p["sequence_id"]] = held.get(p["sequence_id"], 0) + p["length"]
    assert max(held.values()) <= 2048


def test_warc_columns_equal_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = queries.op9_warc(spark, sf).select("page_id", "payload_bytes", "record_type", "refers_to").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.execute(queries.WARC_SQL).fetchall()))


def test_keys_named_like_results(spark):
    frame = spark.createDataFrame([(1, "one text", 5)], "ids long, text string, `a.b` long")
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert spencode.checked(frame, path, key="ids").columns == ["key", "n_ids", "ids", "round_trip"]
    tokens = written(packing.tokenized(frame, public_tokenizers.path("word_bpe_49k.json"), key="a.b"), "tokens")
    assert [r["a.b"] for r in packing.packed(tokens, key="a.b").collect()] == [5]


def test_near_duplicates_of_rows_that_differ_by_a_null(spark):
    """A null that stands in another column makes another row."""
    text, other = "some words that make a text of their own here", "quite another text with other words in it altogether"
    frame = spark.createDataFrame([(1, text, None), (1, None, text), (2, other, None), (2, None, other)], "doc_id long, text string, lang string")
    got = sorted((r["doc_id"], r["text"] or "", r["lang"] or "") for r in simhash.deduplicated(frame).collect())
    assert len(got) == 3 and (1, text, "") in got and (2, other, "") in got
    ids = spark.createDataFrame([(1, None, text), (None, 1, text)], "a long, doc_id long, text string")
    assert [(r["a"], r["doc_id"]) for r in simhash.deduplicated(ids).collect()] == [(None, 1)]


def test_near_duplicates_shuffle_no_rows(spark):
    import io
    import re
    from contextlib import redirect_stdout

    frame = written(spark.createDataFrame([(k, f"text {k} of some words", "x" * 50) for k in range(20)], "doc_id long, text string, lang string"), "docs")
    out = io.StringIO()
    with redirect_stdout(out):
        simhash.deduplicated(frame).explain("formatted")
    assert "Exchange" in out.getvalue() and not re.search(r"Exchange\nInput \[\d+\]: \[[^\]]*(text|row|lang)#", out.getvalue())


def test_many_equal_rows(spark):
    """One row 20,000 times: no cell has a hundredth of it, and slots, sequences and record ids are whole."""
    frame = written(spark.range(20_000).select(F.lit(7).alias("doc_id"), F.lit("a text").alias("text"), F.lit("u").alias("url"), F.lit("<p>").alias("html")).repartition(3), "equal")
    slots = resharding.slotted(resharding.laid_out(resharding.sized(frame), 2).withColumn("shard", F.lit(0)).drop("row"), F.lit(7))
    assert [r[0] for r in slots.select("slot").orderBy("slot").collect()] == list(range(20_000))
    assert slots.count() == 20_000
    tokens = written(packing.tokenized(frame, public_tokenizers.path("word_bpe_49k.json")), "tokens")
    plan = packing.packed(tokens).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("at"))
    rows = plan.collect()
    assert sum(r["n"] for r in rows) == tokens.agg(F.sum("doc_tokens")).first()[0] and all(r["n"] <= packing.LENGTH for r in rows)
    assert all(a["offset"] + a["length"] == b["offset"] for r in rows for a, b in zip(r["at"], r["at"][1:]))
    cells = written(frame.withColumn("mixed", F.xxhash64(F.lit(7), F.monotonically_increasing_id())), "cells").groupBy(F.pmod("mixed", F.lit(256))).count()
    assert cells.agg(F.max("count")).first()[0] < 200
    index = warc.bundled(warc.decided(frame.withColumn("page_id", F.lit(1))))
    assert index.select("record_id").distinct().count() == 20_000


def test_url_list_table(spark, sf):
    """The list is a table of thousands of hosts, most of which no page has; verdicts equal a plain look-up."""
    listed = queries.listed_hosts(spark, sf)
    names = {r["key"] for r in listed.collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    found = urlfilter.judged(pages, listed).collect()
    assert len(names) > 500 and {r["verdict"] for r in found} == {"allow", "block"}
    for r in found:
        if r["rule"] is None:
            labels = r["host"].split(".")
            assert (r["verdict"] == "block") == any(".".join(labels[k:]) in names for k in range(len(labels)) if r["host"])
