"""Line de-duplication by winnowing: delete later repeats of runs of lines.

A run counts if it has at least `MIN_WORDS` words; words are runs of `[^\\x20\\x09-\\x0D]`, lines without a word are
passed over but go with a run that encloses them.

1. Every line is hashed.  A gram is the shortest run from a line on with `MIN_WORDS // 2` words; a window is the shortest run
   from a line on, or back from it, with `MIN_WORDS` words.  The least gram hash inside each window is selected:
   its place is a fingerprint, one for all the windows that select it.  Two texts that share a run of `MIN_WORDS`
   words share a window, hence a fingerprint: none is missed.
2. Positions meet by fingerprint; a fingerprint that stands in one place only goes no further.
3. From each place of a shared fingerprint the match is extended both ways, window by window of those that selected it: the
   stretches around it that begin, and those that end, at each line are compared by the hashes of their lines.
   A match thus reaches as far as both texts agree.  Each stretch's first place, by document id and line, stays; all
   later places are deleted.

A group of any size is reduced to its first place by an aggregate before anything is joined to it; no pairs are
formed.  Fingerprints and stretches with more than a thousandth of all places are joined apart from the shuffle.

Cases: null text stays null; rows that repeat an id and text count as one document and get the same result; null
ids come first; a text that consists of repeats becomes empty, its row stays.  A run that repeats inside one text is
deleted there as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import Scratch, hot_join, text_key

#: Repeated runs of more than 50 words are found.
MIN_WORDS = 51
KEY = ["key_a", "key_b"]


def _line_table(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One row per line with a word: document key, place, two hashes, words before it and up to its end."""
    rows = docs.where(F.col(text_col).isNotNull()).select(
        *text_key(F.col(id_col), F.col(text_col)), F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line")
    )
    words = F.regexp_count("line", F.lit(r"[^\x20\x09-\x0D]+"))
    rows = rows.select(*KEY, "doc_id", "pos", F.struct(F.xxhash64("line").alias("x"), F.xxhash64(F.lit(7), "line").alias("y")).alias("h"), words.cast("long").alias("n"))
    # dealt by document once; all windows below keep to it.  Rows that repeat a document fall together here.
    rows = rows.where("n > 0").repartition(*KEY).dropDuplicates([*KEY, "pos"])
    so_far = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum("n").over(so_far)).withColumn("before", F.col("upto") - F.col("n"))


def _digest(lines: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), lines)


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per selected place: document key, gram hash `mark`, and the `stretches` (x, y, start, stop) that selected it."""
    lines = _line_table(docs, text_col, id_col)
    ahead = Window.partitionBy(*KEY).orderBy("before")
    run, gram = ahead.rangeBetween(0, min_words - 1), ahead.rangeBetween(0, min_words // 2 - 1)
    lines = lines.withColumns({
        "run": F.collect_list("h").over(run), "run_words": F.sum("n").over(run), "run_end": F.max("pos").over(run),
        "gram": F.collect_list("h").over(gram), "gram_words": F.sum("n").over(gram), "gram_end": F.max("pos").over(gram),
    })
    whole = F.col("run_words") >= min_words

    def stretch(found: Column, hashes: str, start: str, stop: str) -> Column:
        return F.when(found, F.struct(_digest(F.col(hashes), 1).alias("x"), _digest(F.col(hashes), 2).alias("y"), F.col(start).alias("start"), F.col(stop).alias("stop")))

    lines = lines.select(
        *KEY, "doc_id", "pos", "h", "upto", "before", stretch(whole, "run", "pos", "run_end").alias("forth"),
        F.when(F.col("gram_words") >= min_words // 2, F.struct(_digest(F.col("gram"), 3).alias("g"), "pos", F.col("gram_end").alias("stop"))).alias("gram"),
    )
    lines = lines.withColumn("grams", F.collect_list("gram").over(run))
    inside = F.filter("grams", lambda g: g.stop <= F.col("forth.stop"))
    lines = lines.withColumn("mark", F.when(F.col("forth").isNotNull(), F.array_min(inside))).drop("grams", "gram")
    back = Window.partitionBy(*KEY).orderBy("upto").rangeBetween(-(min_words - 1), 0)
    lines = lines.withColumns({
        "back": F.collect_list("h").over(back), "back_start": F.min("pos").over(back), "back_from": F.min("before").over(back),
        "back_mark": F.first("mark").over(back), "back_end": F.first("forth.stop").over(back),
    })
    # a window backwards that equals one forwards is known already; any other holds the one from its first line, hence its mark
    new = (F.col("upto") - F.col("back_from") >= min_words) & (F.coalesce(F.col("back_end"), F.lit(-1)) != F.col("pos"))
    lines = lines.withColumn("backward", stretch(new, "back", "back_start", "pos"))
    both = F.array(
        F.struct(F.col("mark"), F.col("forth").alias("stretch")),
        F.struct(F.when(F.col("backward").isNotNull(), F.col("back_mark")).alias("mark"), F.col("backward").alias("stretch")),
    )
    each = lines.select(*KEY, "doc_id", F.inline(both)).where("mark IS NOT NULL AND stretch IS NOT NULL")
    # dealt by document still: no shuffle
    found = each.groupBy(*KEY, "doc_id", F.col("mark.g").alias("mark"), F.col("mark.pos").alias("pos")).agg(F.collect_list("stretch").alias("stretches"))
    return found.drop("pos")


def repeated_runs(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, runs): merged line ranges, as (start, stop) with stop included, that repeat an earlier place."""
    marks = scratch.put(table.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1"), "line_marks")
    shared = hot_join(table, marks, ["mark"], "n").select(*KEY, "doc_id", F.inline("stretches"))
    places = scratch.put(shared.withColumn("place", F.struct("doc_id", *KEY, "start")).drop("doc_id"), "line_places")
    firsts = places.groupBy("x", "y").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    later = hot_join(places, scratch.put(firsts, "line_firsts"), ["x", "y"], "n").where(F.col("place") > F.col("first")).select(*KEY, "start", "stop")
    by_start = Window.partitionBy(*KEY).orderBy("start", "stop")
    reach = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("opens", (F.col("start") > F.coalesce(reach, F.lit(-2)) + 1).cast("int"))
    later = later.withColumn("island", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    merged = later.groupBy(*KEY, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("runs"))


def remove_repeats(docs: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the text's later repeats deleted, `removed_runs` and `n_removed_lines`."""
    table = scratch.put(fingerprints(docs, text_col, id_col, min_words), "line_marks_of_documents")
    keyed = docs.drop("removed_runs", "n_removed_lines").withColumns(dict(zip(("_strandlog_ka", "_strandlog_kb"), text_key(F.col(id_col), F.col(text_col)))))
    runs = scratch.put(repeated_runs(table, scratch), "line_runs").select(F.col("key_a").alias("_strandlog_ka"), F.col("key_b").alias("_strandlog_kb"), F.col("runs").alias("removed_runs"))
    scratch.drop("line_marks_of_documents", "line_marks", "line_places", "line_firsts")
    # a plan that doesn't depend on how many repeats there are
    met = keyed.join(runs.hint("merge"), ["_strandlog_ka", "_strandlog_kb"], "left").drop("_strandlog_ka", "_strandlog_kb")
    kept = F.filter(F.split(text_col, "\n"), lambda _, i: ~F.exists("removed_runs", lambda r: i.between(r.start, r.stop)))
    n = F.aggregate("removed_runs", F.lit(0), lambda a, r: a + (r.stop - r.start + 1).cast("int"))
    return met.withColumns({
        text_col: F.when(F.col("removed_runs").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n")),
        "n_removed_lines": F.coalesce(n, F.lit(0)).cast("long"),
    }).select(*[c for c in docs.columns if c not in ("removed_runs", "n_removed_lines")], "removed_runs", "n_removed_lines")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = remove_repeats(docs, Scratch(spark))
    spans = F.array_join(F.transform("removed_runs", lambda r: F.concat_ws(":", r.start.cast("string"), (r.stop + 1).cast("string"))), ",")
    return found.select("doc_id", "n_removed_lines", F.coalesce(spans, F.lit("")).alias("removed_lines"), "text")
