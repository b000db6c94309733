"""Joins of manifests with listings, plans, capabilities and snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .settled import settled


def available(catalogue: DataFrame, listing: DataFrame, key: str = "track_id") -> DataFrame:
    """Catalogue rows whose file exists (existence only, so a listing that repeats a file changes nothing)."""
    return catalogue.join(listing.select(key).distinct(), key, "left_semi")


def unfinished(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key), key, "left_anti")


def labelled(segments: DataFrame, stems: DataFrame) -> DataFrame:
    """segments with instrument labels of (track_id, stem_id). A mix has family `Mixture`; what is unknown stays null."""
    is_mix = F.lower(F.col("stem_id")).isin("mix", "mixture")
    known = stems.select("track_id", "stem_id", F.col("inst_class").alias("__c"), F.col("program_name").alias("__n"), F.col("is_drum").alias("__d")).dropDuplicates(["track_id", "stem_id"])
    joined = segments.join(known, ["track_id", "stem_id"], "left")
    return joined.withColumns({"instrument_family": F.when(is_mix, "Mixture").otherwise(F.col("__c")), "instrument_name": F.when(is_mix, "mix").otherwise(F.col("__n")), "is_drum": F.when(is_mix, False).otherwise(F.col("__d")), "stem_id": F.when(~is_mix, F.col("stem_id"))}).drop("__c", "__n", "__d")


def resume_plan(samples: DataFrame, final: DataFrame, partial: DataFrame, sources: DataFrame, key: str = "id") -> DataFrame:
    """samples with `action` (done, adopt, todo or missing_audio), and the bad artefacts found as `repaired`. Listings:
    key and valid. A valid final is done, a valid partial is adopted, the rest is made again if its source exists."""
    one = lambda listing, name: listing.groupBy(key).agg(F.bool_or("valid").alias(name))
    found = samples.join(one(final, "__f"), key, "left").join(one(partial, "__p"), key, "left").join(sources.select(key).distinct().withColumn("__s", F.lit(True)), key, "left")
    action = F.when(F.col("__f"), "done").when(F.col("__p"), "adopt").when(F.col("__s"), "todo").otherwise("missing_audio")
    bad = F.when(F.col("__f") == F.lit(False), 1).otherwise(0) + F.when((F.col("__p") == F.lit(False)) & ~F.coalesce("__f", F.lit(False)), 1).otherwise(0)
    return found.withColumns({"action": action, "repaired": bad}).drop("__f", "__p", "__s")


def staging_audit(source: DataFrame, staged: DataFrame) -> DataFrame:
    """One row: files missing, of another size, empty, or staged without a source. Listings: name, size_bytes."""
    a, b = source.select("name", F.col("size_bytes").alias("a")), staged.select("name", F.col("size_bytes").alias("b"))
    both = a.join(b, "name", "full_outer")
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    out = both.agg(count(F.col("b").isNull()).alias("missing"), count(F.col("a") != F.col("b")).alias("size_mismatch"), count(F.col("b") == 0).alias("zero_byte"), count(F.col("a").isNull()).alias("stray"))
    return out.withColumn("ok", F.col("missing") + F.col("size_mismatch") + F.col("zero_byte") + F.col("stray") == 0)


def resolved_controls(requests: DataFrame, capabilities: DataFrame, limits: DataFrame, key: str = "request_id") -> DataFrame:
    """For each request and model: applied (control -> support) and warnings. requests: key, controls, wants_vocals,
    duration_seconds, language. capabilities: model, control, support. limits: model, sings, max_seconds, languages (a row
    for each model). What the models can do is broadcast (a row for each model), so requests stay where they are."""
    can = capabilities.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("control", "support"))).alias("__can"), F.collect_set("control").alias("__known"))
    each = requests.crossJoin(F.broadcast(can.join(F.broadcast(limits), "model"))).filter(F.arrays_overlap("controls", "__known"))
    joined = each.withColumn("applied", F.filter("__can", lambda a: F.array_contains(F.col("controls"), a["control"])))
    dropped = F.transform(F.filter("applied", lambda a: a["support"] == "ignored"), lambda a: F.concat(a["control"], F.lit(": not supported")))
    more = F.array_compact(F.array(F.when(F.col("wants_vocals") & ~F.col("sings"), "vocals: not supported"), F.when(F.col("duration_seconds") > F.col("max_seconds"), "duration: too long"), F.when(F.col("language").isNotNull() & (F.size("languages") > 0) & ~F.array_contains("languages", F.col("language")), "language: not supported")))
    return joined.select(key, "model", F.transform("applied", lambda a: F.concat_ws("=", a["control"], a["support"])).alias("applied"), F.concat(dropped, more).alias("warnings"))


def containing(texts: DataFrame, needles: DataFrame, key: str, text: str, needle_key: str, needle: str, gram: int = 4, few: int = 100_000, held: int = 32 << 20) -> DataFrame:
    """Pairs (key, needle_key) where the text contains the needle. Any text that contains a needle holds the needle's
    words that are whole within it, so a needle is looked for only where the one of its grams (of `gram` consecutive words)
    stands that is rarest among the needles' grams. Needles of `held` bytes or fewer are broadcast, and every text is
    scanned once where it lies: only grams that begin with the first word of a needle's gram are looked up. More needles
    are joined with the texts on their grams, and then verified. Needles with too few whole words are spotted by an automaton."""
    words = F.split(F.col(needle), " ")
    inner = needles.select(needle_key, needle).withColumn("__w", F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))))  # the first and last word may be cut
    long, short = inner.filter(F.size("__w") >= gram), inner.filter(F.size("__w") < gram)
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - gram + 1), lambda i: F.array_join(F.slice(w, i, gram), " "))
    each = long.select(needle_key, needle, F.explode(grams(F.col("__w"))).alias("__g"))
    counts = each.groupBy("__g").agg(F.count("*").alias("__n"))
    rare = each.join(counts, "__g").groupBy(needle_key, needle).agg(F.min_by("__g", F.struct("__n", "__g")).alias("__g"))
    n, size = rare.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(needle) + F.octet_length("__g")), F.lit(0))).first()
    if size + 100 * n <= held:
        out = _held_containing(texts, rare, key, text, needle_key, needle, gram)
    else:
        split = texts.select(key, text, F.split(F.col(text), " ").alias("__w")).filter(F.size("__w") >= gram)
        found = split.select(key, F.explode(F.array_distinct(grams(F.col("__w")))).alias("__g")).join(rare.select("__g", needle_key), "__g").select(key, needle_key).distinct()
        checked = found.join(texts.select(key, text), key).join(needles.select(needle_key, needle), needle_key).filter(F.col(text).contains(F.col(needle)))
        out = checked.select(key, needle_key)
    return out.union(spotted(texts, short, key, text, needle_key, needle, few))


def spotted(texts: DataFrame, needles: DataFrame, key: str, text: str, needle_key: str, needle: str, few: int = 100_000, shard: int = 8 << 20) -> DataFrame:
    """Pairs (key, needle_key) where the text contains the needle, whatever the needle: an Aho-Corasick automaton finds all needles in
    one pass over each text, where it lies. Needles are dealt into shards of about `few` needles and `shard` bytes, each broadcast by itself;
    with several, a shard's pairs are written before the next one is sent."""
    some = needles.select(needle_key, needle).filter(F.col(needle).isNotNull())
    n, size = some.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(needle)), F.lit(0))).first()
    shards = max(1, -(-n // few), -(-size // shard))
    found = []
    for k in range(shards):
        part = some.filter(F.pmod(F.xxhash64(F.lit("shard"), needle_key, needle), F.lit(shards)) == k)
        pairs, held = _spotted(texts, part, key, text, needle_key, needle)
        if shards > 1:
            pairs = settled(pairs, "spotted")
            held.unpersist()
        found.append(pairs)
    return reduce(DataFrame.union, found)


def _spotted(texts: DataFrame, needles: DataFrame, key: str, text: str, needle_key: str, needle: str):
    by_needle: dict[str, list] = {}
    for r in needles.collect():  # a shard
        by_needle.setdefault(r[needle], []).append(r[needle_key])
    shared = texts.sparkSession.sparkContext.broadcast(by_needle)
    kinds = [(c, d.schema[c].dataType) for c, d in ((key, texts), (needle_key, needles))]

    def scan(batches):
        import ahocorasick
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        lists = list(shared.value.items())
        automaton = ahocorasick.Automaton()
        for k, (word, _) in enumerate(lists):
            if word:
                automaton.add_word(word, k)
        automaton.make_automaton()
        everywhere = [k for k, (word, _) in enumerate(lists) if not word]
        for b in batches:
            at, hits = [], []
            for row, x in enumerate(b.column(1).to_pylist()):
                if x is None:
                    continue
                mine = {k for _, k in automaton.iter(x)} if len(automaton) else set()
                keys = [i for k in sorted(mine.union(everywhere)) for i in lists[k][1]]
                at += [row] * len(keys)
                hits += keys
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(hits, to_arrow_type(kinds[1][1]))], names=[key, needle_key])

    return texts.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(scan, ", ".join(f"`{c}` {k.simpleString()}" for c, k in kinds)), shared


def _held_containing(texts: DataFrame, rare: DataFrame, key: str, text: str, needle_key: str, needle: str, gram: int) -> DataFrame:
    """`containing` for needles that every worker can hold, by their rarest grams (`__g`)."""
    by_gram: dict[str, list] = {}
    for r in rare.collect():  # `held` bytes at most
        by_gram.setdefault(r["__g"], []).append((r[needle_key], r[needle]))
    shared = texts.sparkSession.sparkContext.broadcast(by_gram)
    kinds = [(c, d.schema[c].dataType) for c, d in ((key, texts), (needle_key, rare))]

    def scan(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        wanted = shared.value
        firsts = {g.split(" ", 1)[0] for g in wanted}
        for b in batches:
            at, hits = [], []
            for row, x in enumerate(b.column(1).to_pylist()):
                w = (x or "").split(" ")
                grams = {" ".join(w[i : i + gram]) for i, first in enumerate(w) if first in firsts}
                mine = {k for g in grams.intersection(wanted) for k, whole in wanted[g] if whole in x}
                at += [row] * len(mine)
                hits += mine
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(hits, to_arrow_type(kinds[1][1]))], names=[key, needle_key])

    return texts.select(key, F.col(text).cast("string").alias("__text")).mapInArrow(scan, ", ".join(f"`{c}` {k.simpleString()}" for c, k in kinds))


def aligned(rows: DataFrame, category: str, candidate: str, source: str) -> DataFrame:
    """category, source and reason of each category: kept (reason null) if every candidate has it from one and the same
    source."""
    n = rows.select(candidate).distinct().agg(F.count("*").alias("n_candidates"))
    each = rows.groupBy(category, candidate).agg(F.min(source).alias("a"), F.max(source).alias("b"))
    found = each.groupBy(category).agg(F.count("*").alias("have"), F.min("a").alias("source"), F.max("b").alias("other")).crossJoin(F.broadcast(n))  # one row
    reason = F.when(F.col("have") < F.col("n_candidates"), "candidate missing").when(F.col("source") != F.col("other"), "sources differ")
    return found.select(category, F.when(reason.isNull(), F.col("source")).alias("source"), reason.alias("reason"))


def absent(expected: DataFrame, listing: DataFrame, name: str = "name") -> DataFrame:
    return expected.join(listing.select(name), name, "left_anti")


def drift(now: DataFrame, before: DataFrame | None, name: str = "name", tolerance: float = 1e-9) -> DataFrame:
    """One row: compared, changed and whether anything changed (null without an earlier snapshot). Columns: name, total, std."""
    if before is None:
        return now.agg(F.lit(0).cast("long").alias("compared"), F.lit(0).cast("long").alias("changed"), F.lit(None).cast("boolean").alias("has_changed"))
    old = before.select(name, F.col("total").alias("t0"), F.col("std").alias("s0"))
    moved = (F.abs(F.col("total") - F.col("t0")) > tolerance) | (F.abs(F.col("std") - F.col("s0")) > tolerance)
    return now.join(old, name).agg(F.count("*").alias("compared"), F.coalesce(F.sum(moved.cast("long")), F.lit(0)).alias("changed")).withColumn("has_changed", F.col("changed") > 0)


def paired(rows: DataFrame, item: str, condition: str, value: str, base: str, treatment: str) -> DataFrame:
    """item, base, treatment and delta of the items that have both."""
    mean = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    both = rows.filter(F.col(condition).isin(base, treatment)).groupBy(item).agg(mean(base).alias("base"), mean(treatment).alias("treatment"))
    return both.filter("base is not null and treatment is not null").withColumn("delta", F.col("treatment") - F.col("base"))


def held_out_problems(held: DataFrame, frozen: DataFrame, families: DataFrame, key: str, family: str) -> DataFrame:
    """key and problem of held-out rows that the frozen set has too, and of those whose family isn't known."""
    both = held.join(frozen.select(key), key, "left_semi").select(key, F.lit("also in the frozen set").alias("problem"))
    unknown = held.join(families.select(family), family, "left_anti").select(key, F.concat(F.lit("unknown family "), F.coalesce(F.col(family).cast("string"), F.lit("null"))).alias("problem"))
    return both.unionByName(unknown)
