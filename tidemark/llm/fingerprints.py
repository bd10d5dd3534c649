"""Canonical exact digests, with DataFrame functions alone.

A text is normalised (NFKC), case-folded and its whitespace folded; two xxhash64 values of the result
with different seeds make a 128-bit digest. Texts are grouped by digest, and inside every bucket of
more than one row the canonical texts themselves are compared: should two differ, the digests of that
bucket get a SHA-256 suffix, so equal fingerprints mean equal canonical texts.

Spark has no SQL function for Unicode normalisation; the `java_method` SQL function calls that of
the ICU library which Spark brings for its collations. Plain ASCII texts skip it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.runtime import doc_key, materialise, read_table

#: Ids of documents that need a byte comparison are broadcast up to this many rows, else joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Neighbouring ids are cut at this many quantiles, and evenly between two of them into stretches of about so many rows.
#: Only one row of each stretch is looked at by a single task.
QUANTILES, STRETCH_ROWS = 512, 100_000


def canonical(text: Column) -> Column:
    """NFKC, case folding and one space for every run of Unicode whitespace; none at the ends. Null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    compose = lambda x: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))
    fold = lambda x: F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    folded = F.when(text.rlike(r"[^\x00-\x7F]"), compose(fold(compose(text)))).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(x: Column) -> Column:
    """32 hex digits: two seeds of xxhash64."""
    half = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(half(F.xxhash64(x)), half(F.xxhash64(F.lit("second seed"), x)))


def fingerprint(docs: DataFrame, text: str = "text", hash_of: Callable[[Column], Column] = wide_hash) -> DataFrame:
    """All columns of docs plus `fingerprint` and `copies`, the number of rows that have it.

    Null and empty texts are equal. Repeated rows are counted. An empty table stays empty. An
    existing column of either name is replaced. Rows of one hot text are counted by partial
    aggregation and are never gathered.
    """
    rows = docs.drop("fingerprint", "copies").withColumn("_canon", canonical(F.col(text))).withColumn("_hash", hash_of(F.col("_canon")))
    counts = rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n"), F.min("_canon").alias("_a"), F.max("_canon").alias("_b"))
    counts = counts.select("_hash", "_n", (F.col("_a") != F.col("_b")).alias("_split"))
    out = rows.join(counts, "_hash")
    mark = F.when(F.col("_split"), F.concat("_hash", F.lit("-"), F.sha2("_canon", 256))).otherwise(F.col("_hash"))
    out = out.withColumn("fingerprint", mark)
    again = out.where("_split").groupBy("fingerprint").agg(F.count(F.lit(1)).alias("_m"))
    return out.join(again, "fingerprint", "left").withColumn("copies", F.coalesce("_m", "_n")).drop("_canon", "_hash", "_n", "_split", "_m")


def likeness(a: Column, b: Column) -> Column:
    """An exact digest knows equal (1) and different (0)."""
    return (a == b).cast("double")


def with_next(docs: DataFrame, key: str = "k", quantiles: int = QUANTILES, rows: int = STRETCH_ROWS) -> DataFrame:
    """docs (key, tie and more columns) with a struct `n` of the next row in key order; the last gets the first's.

    Rows are dealt by stretches of keys, whose number grows with the rows; inside a stretch a window
    finds the next row, and the last row of a stretch takes the first of the next. Rows with equal
    keys are ordered by `tie`.
    """
    cuts, n = docs.select(F.percentile_approx(key, [i / quantiles for i in range(1, quantiles)], 10_000), F.count(F.lit(1))).first()
    cuts = sorted(set(cuts or []))
    at = F.lit(0) if not cuts else F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key)))
    finer = -(-n // (quantiles * rows))
    if finer > 1 and len(cuts) > 1:
        # the place of a key between its two cuts; keys before the first and after the last use the nearest two
        of = F.array(*[F.lit(c).cast("double") for c in cuts])
        low = F.element_at(of, F.least(F.greatest(at, F.lit(1)), F.lit(len(cuts) - 1)))
        high = F.element_at(of, F.least(F.greatest(at, F.lit(1)), F.lit(len(cuts) - 1)) + 1)
        share = F.when(at == 0, (F.col(key) - (low - (high - low))) / (high - low)).when(at == len(cuts), (F.col(key) - high) / (high - low)).otherwise((F.col(key) - low) / (high - low))
        at = at * finer + F.floor(F.least(F.greatest(share * finer, F.lit(0.0)), F.lit(finer - 1.0)))
    rows = docs.withColumn("stretch", at.cast("int"))
    inner = Window.partitionBy("stretch").orderBy(key, "tie")
    row = F.struct(*docs.columns)
    rows = rows.withColumn("n", F.lead(row).over(inner))
    # the first row of each stretch: found by key and tie alone, and fetched whole by a semi join, so that no more rows are described anew
    head = docs.select(key, "tie", at.cast("int").alias("stretch")).groupBy("stretch").agg(F.min(F.struct(key, "tie")).alias("f"))
    over = Window.orderBy("stretch")
    head = head.select("stretch", F.coalesce(F.lead("f").over(over), F.first("f").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("f"))
    head = materialise(head.select("stretch", F.col(f"f.{key}").alias(key), "f.tie"), "stretches")
    whole = docs.join(head.select(key, "tie").distinct(), [key, "tie"], "left_semi").dropDuplicates([key, "tie"]).select(key, "tie", row.alias("f"))
    first = head.join(whole, [key, "tie"]).select("stretch", "f")
    rows = rows.join(first, "stretch", "left")
    return rows.withColumn("n", F.coalesce("n", "f")).drop("f", "stretch")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def op1_fingerprint(spark, sf_dir: str, hash_of: Callable[[Column], Column] = wide_hash) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key(F.col("doc_id")).alias("k"), F.xxhash64(body).alias("tie"), body.alias("text"))
    # digests are made after neighbours have met: each text and each edited text is normalised once
    pairs = with_next(keyed)
    new = edited(F.col("text"), F.col("n.text"))
    digests = materialise(
        pairs.select(
            "doc_id", "k", "tie", F.col("n.k").alias("nk"), F.col("n.tie").alias("ntie"), F.length("text").cast("long").alias("n_chars"),
            F.sha2(new, 256).alias("edited_sha256"), hash_of(canonical(F.col("text"))).alias("h"), hash_of(canonical(new)).alias("eh"),
        ),
        "fingerprint-digests",
    )
    digests = digests.join(digests.select(F.col("k").alias("nk"), F.col("tie").alias("ntie"), F.col("h").alias("nh")).dropDuplicates(["nk", "ntie"]), ["nk", "ntie"])
    # byte comparison inside every bucket of more than one row, over originals and edited texts
    both = digests.select(F.explode(F.array("h", "eh")).alias("hash"))
    many = both.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hash")
    side = lambda c: digests.select("k", "tie", "nk", "ntie", F.col(c).alias("hash"), F.lit(c).alias("side"))
    need = materialise(side("h").unionByName(side("eh")).join(many, "hash", "left_semi"), "fingerprint-buckets")
    ids = need.select(F.explode(F.array(F.struct("k", "tie"), F.struct(F.col("nk").alias("k"), F.col("ntie").alias("tie")))).alias("x")).select("x.*").distinct()
    ids = materialise(ids, "fingerprint-ids")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    texts = keyed.select("k", "tie", "text").join(ids, ["k", "tie"], "left_semi").dropDuplicates(["k", "tie"])
    own = need.where("side = 'h'").join(texts, ["k", "tie"]).select("hash", F.col("text").alias("body"))
    after = texts.select(F.col("k").alias("nk"), F.col("tie").alias("ntie"), F.col("text").alias("following"))
    mixed = need.where("side = 'eh'").join(texts, ["k", "tie"]).join(after, ["nk", "ntie"]).select("hash", edited(F.col("text"), F.col("following")).alias("body"))
    compared = own.unionByName(mixed).select("hash", canonical(F.col("body")).alias("canon"))
    split = materialise(compared.groupBy("hash").agg(F.min("canon").alias("a"), F.max("canon").alias("b")).where("a <> b").select("hash"), "fingerprint-split")
    if split.isEmpty():
        marked = digests
    else:
        # a bucket with different texts: their SHA-256 tells them apart
        marked = pairs.select(
            "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(new, 256).alias("edited_sha256"),
            *[x for name, body in (("h", F.col("text")), ("eh", new), ("nh", F.col("n.text"))) for x in (hash_of(canonical(body)).alias(name), F.sha2(canonical(body), 256).alias(f"{name}_sha"))],
        )
        for c in ("h", "eh", "nh"):
            hit = split.select(F.col("hash").alias(c), F.lit(True).alias("hit"))
            marked = marked.join(hit, c, "left").withColumn(c, F.when(F.col("hit"), F.concat(c, F.lit("-"), f"{c}_sha")).otherwise(F.col(c))).drop("hit")
    return marked.select(
        "doc_id", "n_chars", "edited_sha256", F.col("h").alias("fingerprint"), F.col("eh").alias("edited_fingerprint"),
        likeness(F.col("h"), F.col("eh")).alias("near_edited"), likeness(F.col("h"), F.col("nh")).alias("near_next"),
    )
