"""Personal data: generators propose spans, boosted trees select among those that no rule settles.

Base spans follow fixed patterns (leftmost, without overlap, per kind) and always stay:

* email `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`
* ip `[0-9]+(\\.[0-9]+){3}`, each part at most 255
* card `[0-9]([\\x20-]?[0-9])+`, 12 to 19 digits with a Luhn check digit
* phone `\\+[0-9][\\x20().0-9-]+[0-9]`, 9 to 15 digits

Two more generators have high recall: `number` (seven digits or more, loosely grouped) and `secret` (20 or
more characters of a key's alphabet, one of them a digit).  Their spans, which may overlap those of any kind, are
described by format and context features; boosted trees, fitted on made-up examples of known kinds and
turned into one SQL expression, give a margin, and spans above the margin of the calibrated probability `SELECT` are
added where they meet no base span; a `number` gives way to a `secret`.

Everything on the path of the data is a SQL expression.  Positions come from the pieces between
matches: their lengths add up in a window per document, so a text may have any number of spans.  A row of the
input is known by its place in the input.

Cases: a null text is empty; a text without spans has zero counts, the digest of the empty string and empty `spans`.
Positions count code points; ends are exclusive.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlog.llm import boosting

# The patterns.  Possessive loops don't recurse; a run is entered at its start, or where the
# last match ended, so that long runs are read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "number": r"(?<![0-9A-Za-z])[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
    "secret": r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
}
BASE = ("email", "ip", "card", "phone")
ADDED = ("number", "secret")
#: Calibrated probability from which a proposed span is taken.
SELECT = 0.6
_BEFORE, _AFTER = 24, 12

FEATURES = {
    "f_is_secret": "CAST(kind = 'secret' AS INT)",
    "f_size": "length(found)",
    "f_digits": "length(digits)",
    "f_letters": "length(regexp_replace(found, '[^A-Za-z]', ''))",
    "f_uppers": "length(regexp_replace(found, '[^A-Z]', ''))",
    "f_marks": "length(regexp_replace(found, '[0-9A-Za-z]', ''))",
    "f_kinds": "size(array_distinct(split(found, '')))",
    "f_hex": "CAST(found RLIKE '^[0-9a-fA-F]+$' AS INT)",
    "f_groups": "size(regexp_extract_all(found, '[0-9]+', 0))",
    "f_first_group": "length(regexp_extract(found, '^[^0-9]*([0-9]+)', 1))",
    "f_last_group": "length(regexp_extract(found, '([0-9]+)[^0-9]*$', 1))",
    "f_longest_group": "array_max(transform(regexp_extract_all(found, '[0-9]+', 0), x -> length(x)))",
    "f_turns": "size(regexp_extract_all(found, '[0-9][A-Za-z]|[A-Za-z][0-9]', 0))",
    "f_longest_word": "coalesce(array_max(transform(regexp_extract_all(found, '[a-z]+', 0), x -> length(x))), 0)",
    "f_dots": "length(regexp_replace(found, '[^.]', ''))",
    "f_slashes": "length(regexp_replace(found, '[^/]', ''))",
    "f_zeros": "length(regexp_extract(found, '(0*)$', 1))",
    "f_year": "CAST(found RLIKE '^(19|20)[0-9]{2}([^0-9]|[01][0-9][0-3][0-9]$)' AS INT)",
    "f_luhn": "CAST(luhn AS INT)",
    "f_said_secret": "CAST(lower(before) RLIKE 'token|secret|passw|api|key|bearer|auth|credential' AS INT)",
    "f_said_number": "CAST(lower(before) RLIKE 'phone|tel|call|mobile|fax|card|visa|account|acct|iban|ssn|passport|contact' AS INT)",
    "f_said_amount": "CAST(before RLIKE '[$€£#]\\\\s?$' OR lower(before) RLIKE '(isbn|issue|version|views|total|page|order|about) ?$' AS INT)",
    "f_quoted": "CAST(before RLIKE '[\"\\'=:]\\\\s?$' AS INT)",
    "f_unit_after": "CAST(lower(after) RLIKE '^ ?(%|km|kg|mb|gb|items|views|people|years|times|units|[.][0-9])' AS INT)",
}


def _luhn(digits: str) -> str:
    return (
        f"(aggregate(transform(sequence(1, greatest(length({digits}), 1)), i -> "
        f"CAST(substring({digits}, -CAST(i AS INT), 1) AS INT) * IF(i % 2 = 0, 2, 1)), 0, "
        f"(a, x) -> a + IF(x > 9, x - 9, x)) % 10 = 0)"
    )


def _proposals(text: Column, kind: str) -> Column:
    """(kind, i, lead, found, before, after) of each match; `lead` is the length of what precedes it."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    parts = F.split(text, PATTERNS[kind])
    made = F.transform(
        F.sequence(F.lit(0), F.size(found) - 1),
        lambda i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("i"),
            F.length(F.get(parts, i)).alias("lead"),
            F.get(found, i).alias("found"),
            F.right(F.get(parts, i), F.lit(_BEFORE)).alias("before"),
            F.left(F.get(parts, i + 1), F.lit(_AFTER)).alias("after"),
        ),
    )
    return F.when(F.size(found) > 0, made).otherwise(F.array().cast("array<struct<kind:string,i:int,lead:int,found:string,before:string,after:string>>"))


def propose(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document and match with its `start` and `stop`; one row, without match, for the others."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    digit, at = F.col("text").rlike("[0-9]"), F.col("text").contains("@")
    able = {"email": at, "phone": digit & F.col("text").contains("+")}
    none = F.array().cast("array<struct<kind:string,i:int,lead:int,found:string,before:string,after:string>>")
    lists = [F.when(able.get(k, digit), _proposals(F.col("text"), k)).otherwise(none) for k in PATTERNS]
    flat = rows.select("_row", "doc_id", F.explode_outer(F.concat(*lists)).alias("m")).select("_row", "doc_id", "m.*")
    # dealt by document once; the windows and the grouping below keep to it
    flat = flat.repartition("_row")
    so_far = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("stop", F.sum(F.col("lead") + F.length("found")).over(so_far))
    return flat.withColumn("start", F.col("stop") - F.length("found")).drop("lead", "i")


def describe(spans: DataFrame) -> DataFrame:
    """Whether a base span passes its check, and the features of the others."""
    spans = spans.withColumn("digits", F.regexp_replace("found", "[^0-9]", ""))
    spans = spans.withColumn("luhn", F.expr(f"CASE WHEN length(digits) BETWEEN 12 AND 19 THEN {_luhn('digits')} ELSE false END"))
    small = "forall(split(found, '[.]'), x -> length(ltrim('0', x)) <= 3 AND CAST(right(x, 3) AS INT) <= 255)"
    base = F.expr(
        f"CASE kind WHEN 'email' THEN true WHEN 'ip' THEN {small} "
        "WHEN 'card' THEN luhn WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15 ELSE false END"
    )
    return spans.withColumn("base", F.coalesce(base, F.lit(False)))


# ---------------------------------------------------------------- the model


def _examples(n: int, seed: int = 20) -> list[tuple[str, int]]:
    """Made-up texts with one proposed span each, and whether it is personal data."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    h = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    b = lambda k: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("tion er the an in re on at en nd ing es or st".split()) for _ in range(r.randint(1, 3)))
    made = []
    for _ in range(n):
        kind = r.randrange(4)
        if kind == 0:
            span = r.choice([f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{d(3)}-{d(2)}-{d(4)}", d(16), f"{d(4)} {d(4)} {d(4)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}", d(10), f"{d(4)}-{d(4)}-{d(4)}-{d(4)}"])
            before = r.choice(["phone ", "call ", "card ", "account ", "tel: ", word() + " ", word() + ", ", ""])
            after, label = r.choice([" ", ". ", ", "]) + word(), 1
        elif kind == 1:
            year = r.choice(("19", "20")) + d(2)
            span = r.choice([f"{year}-{d(2)}-{d(2)} {d(2)}", f"{year} {year} {year}", f"{year}{d(2)}{d(2)}", f"3.{d(8)}", f"{r.randint(1, 9)}{'0' * r.randint(6, 10)}", f"1{d(9)}000", f"{r.randint(1, 20)}.{r.randint(0, 9)}.{d(5)}.{d(2)}", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", d(7)])
            before = r.choice(["$", "about ", "isbn ", "version ", "total ", "issue ", word() + " ", "views "])
            after, label = r.choice([" km", " items", " views", " people", "%", " " + word(), ". " + word()]), 0
        elif kind == 2:
            span = r.choice([h(32), h(40), h(64), b(24), b(32), b(40), "sk-" + b(30), "ghp_" + b(36), b(20) + "/" + b(19), b(42) + "="])
            before = r.choice(['token = "', "key: ", "secret=", 'password "', "Bearer ", "api ", word() + " ", ""])
            after, label = r.choice(['" ', " ", "\n", ". "]) + word(), 1
        else:
            slug = "-".join(word() for _ in range(r.randint(5, 8)))
            span = r.choice([f"{slug}-{d(4)}", f"/{word()}/{word()}/{slug}/{d(4)}", f"{word()}{word()}{word()}{word()}tiontiontion{d(1)}", "=" * r.randint(20, 40) + d(1), f"IMG_{d(8)}_{slug}", f"a/{d(4)}/{d(2)}/{slug}", f"{d(4)}-{d(2)}-{d(2)}_{slug}", "-" * 25 + d(2)])
            before, after, label = r.choice([word() + " ", "see ", ""]), " " + word(), 0
        made.append((f"{before}{span}{after}", label))
    return made


def train(spark: SparkSession, n: int = 3000) -> boosting.Boosted:
    """Fit the trees on `n` made-up examples, described by the same expressions as real spans."""
    rows = [(i, text, label) for i, (text, label) in enumerate(_examples(n))]
    made = spark.createDataFrame(rows, "doc_id long, text string, label int").coalesce(1)
    spans = describe(propose(made)).where("kind IN ('number', 'secret')").where("kind <> 'secret' OR length(digits) > 0")
    spans = spans.join(made.select("doc_id", "label"), "doc_id").selectExpr("doc_id", "start", "label", *[f"CAST({e} AS DOUBLE) AS {n}" for n, e in FEATURES.items()])
    got = spans.orderBy("doc_id", "start", "f_is_secret").collect()  # as many as examples
    x = np.array([[r[name] for name in FEATURES] for r in got]).reshape(-1, len(FEATURES))
    return boosting.fit(x, np.array([float(r.label) for r in got]), trees=24, depth=3, rate=0.3)


def select(described: DataFrame, model: boosting.Boosted, probability: float = SELECT) -> DataFrame:
    """Rows of accepted spans, `base` or added, and one row at least per document."""
    names = list(FEATURES)
    scored = described.selectExpr(
        "*", *[f"CASE WHEN kind IN ('number', 'secret') AND length(digits) > 0 THEN CAST({e} AS DOUBLE) END AS {n}" for n, e in FEATURES.items()]
    )
    least = model.margin_for(probability)
    added = F.col("f_size").isNotNull() & (F.expr(model.margin_sql(names)) >= F.lit(least))
    scored = scored.withColumn("added", F.coalesce(added, F.lit(False))).drop(*names)
    by_start = Window.partitionBy("_row").orderBy("start", "stop", "kind")
    before, after = by_start.rowsBetween(Window.unboundedPreceding, -1), by_start.rowsBetween(1, Window.unboundedFollowing)

    def meets(flag: Column) -> Column:
        ends, starts = F.max(F.when(flag, F.col("stop"))).over(before), F.min(F.when(flag, F.col("start"))).over(after)
        return F.coalesce(ends > F.col("start"), F.lit(False)) | F.coalesce(starts < F.col("stop"), F.lit(False))

    scored = scored.withColumn("_base", meets(F.col("base"))).withColumn("_secret", meets(F.col("added") & (F.col("kind") == "secret")))
    free = F.col("added") & ~F.col("_base") & ((F.col("kind") == "secret") | ~F.col("_secret"))
    return scored.withColumn("taken", F.col("base") | free)


def find(docs: DataFrame, model: boosting.Boosted, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per document: counts of base kinds and of the added kinds, `base_spans` and `all_spans` as arrays of (start, order, kind, stop)."""
    taken = select(describe(propose(docs, text_col, id_col)), model)
    place = F.array_position(F.array(*map(F.lit, [*BASE, *ADDED])), F.col("kind"))
    span = F.struct("start", place.alias("place"), "kind", "stop")

    def gather(flag: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(flag, span)))

    return taken.groupBy("_row", "doc_id").agg(
        *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in BASE],
        *[F.count(F.when(F.col("taken") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in ADDED],
        gather(F.col("base")).alias("base_spans"),
        gather(F.col("taken")).alias("all_spans"),
    )


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    walked = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("done"), F.lit("").alias("out")),
        lambda a, s: F.when(
            s.start >= a.done,
            F.struct(
                s.stop.alias("done"),
                F.concat(a.out, F.substring(text, a.done.cast("int") + 1, (s.start - a.done).cast("int")), F.lit("["), s.kind, F.lit("]")).alias("out"),
            ),
        ).otherwise(a),
    )
    return F.concat(walked.out, F.substring(text, walked.done.cast("int") + 1, F.length(text)))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(spark))
    spans = [F.sha2(as_text(F.col("base_spans")), 256).alias("base_sha256"), as_text(F.col("all_spans")).alias("spans")]
    return found.select("doc_id", *[f"n_{k}" for k in BASE], *spans, *[f"n_{k}" for k in ADDED])
