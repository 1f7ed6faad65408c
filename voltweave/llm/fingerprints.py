"""Document fingerprints by SimHash, in DataFrame operations alone.

Terms are word shingles; a term's hash votes on every bit with the term's length as weight, so runs of
short function words count less. Two bits are counted in the halves of one 64-bit sum, which makes 32
plain sums of the votes of a text, combined within the task. Fingerprints within a Hamming radius are found by
permuted block tables: the 64 bits are cut into radius + 3 blocks, and every choice of three blocks is a
table keyed by them; two fingerprints within the radius agree in one of the tables.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltweave.runtime import cut

SHINGLE = 3
RADIUS = 3
#: Ids of a bucket in which the next document is looked up; buckets of a group above it.
BUCKET_ROWS = 500
GROUP_BUCKETS = 10_000
#: Fingerprints of a group that are compared with each other; larger groups are filed anew.
MEMBERS = 512
#: One in either half of a sum. A half holds votes of up to 2^32, a text of over a gigabyte.
HALVES = (1 << 32) | 1
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.split(F.btrim(text, F.lit(SPACES)), "[\\x20\\x09-\\x0D]+")


def terms(words: str) -> Column:
    """Array of (hash, weight) of all shingles of a column of words; fewer words are one shingle."""

    def term(word: Column, i: Column) -> Column:
        parts = [word, *[F.get(F.col(words), i + k) for k in range(1, SHINGLE)]]
        weight = reduce(lambda a, b: a + b, [F.coalesce(F.length(p), F.lit(0)) for p in parts])
        return F.struct(F.xxhash64(*parts).alias("h"), weight.cast("long").alias("w"))

    return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))), term)


def votes() -> list[Column]:
    """The sums over the rows of one text, each of two bits; and the sum of the weights."""
    sums = [F.sum(F.shiftright("h", k).bitwiseAND(F.lit(HALVES)) * F.col("w")).alias(f"v{k}") for k in range(32)]
    return [*sums, F.sum("w").alias("total")]


def majority() -> Column:
    """The fingerprint from the sums: a bit is one if more than half of the weight has it."""
    bits = []
    for k in range(32):
        low, high = F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{k}", 32)
        bits += [F.when(2 * half > F.col("total"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
                 for half, at in ((low, k), (high, k + 32))]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def fingerprint(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """The key columns, which name a row, and ``fp`` (signed 64 bits; 0 for a text without a word)."""
    # A column of its own, so that a text is split once.
    split = texts.select(*keys, words_of(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    spread = split.select(*keys, F.inline(terms("_words")))
    return spread.groupBy(*keys).agg(*votes()).select(*keys, majority().alias("fp"))


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def hex16(fp: str) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text, bucket``: consecutive ids share a bucket of about ``BUCKET_ROWS`` rows.

    Rows without an id come first, by a hash of the text.
    """
    least, most, n = docs.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id")).first()
    span = 1 if least is None else most - least + 1
    width = max(1, span * BUCKET_ROWS // max(n, 1))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(
        F.expr(f"(doc_id - {least or 0}L) div {width}L"),
        F.pmod(F.xxhash64("text"), F.lit(4096)) - 4096).alias("bucket"))


def next_bucket(buckets: DataFrame) -> DataFrame:
    """``bucket, after``: the bucket behind each one in use, the first behind the last.

    Only one row per group of buckets, one in millions of documents, comes together in a task.
    """
    grouped = buckets.withColumn("_group", F.floor(F.col("bucket") / GROUP_BUCKETS))
    own = Window.partitionBy("_group").orderBy("bucket")
    starts = grouped.groupBy("_group").agg(F.min("bucket").alias("_start"))
    over_all = Window.orderBy("_group")
    whole = over_all.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = starts.select("_group", F.coalesce(F.lead("_start").over(over_all), F.first("_start").over(whole)).alias("_other"))
    led = grouped.withColumn("after", F.lead("bucket").over(own)).join(starts, "_group")
    return led.select("bucket", F.coalesce("after", "_other").alias("after"))


def _order() -> Window:
    return Window.partitionBy("bucket").orderBy("doc_id", "_h", "text")


def with_next(rows: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``in_order`` with their number ``rn`` in the bucket and the text of the next document.

    Texts are shuffled once; the first text of every bucket goes to the bucket before it.
    """
    rows = rows.withColumn("_h", F.xxhash64("text"))
    heads = rows.withColumn("_n", F.row_number().over(_order())).where("_n = 1")
    heads = heads.select(F.col("bucket").alias("after"), F.col("text").alias("_head"))
    heads = after.join(heads, "after").select("bucket", "_head")
    led = rows.withColumn("rn", F.row_number().over(_order())).withColumn("_next", F.lead("text").over(_order()))
    return led.join(heads, "bucket", "left").select(
        "bucket", "rn", "doc_id", "text", F.coalesce("_next", "_head").alias("next_text"))


def compare(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of every text and of its edited text, and what lies near.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` and
    ``n_near``, the number of other fingerprints in the table within the radius. The edited text has its
    last quarter replaced by the beginning of the next document (by doc_id; equal ids by text; rows
    without an id first; the first follows the last). NULL is empty; repeated rows stay; other columns are
    left out; an empty table gives an empty result.
    """
    rows = in_order(docs)
    after = cut(next_bucket(rows.select("bucket").distinct()))
    quarter = F.floor(F.length("text") / 4).cast("int")
    both = with_next(rows, after).withColumn("edited", F.concat(
        F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next_text", F.lit(1), quarter)))
    keys = ["bucket", "rn", "doc_id", "n_chars", "edited_sha256", "kind"]
    texts = both.select(
        "bucket", "rn", "doc_id", F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("kind", "body"))
    # Narrow from here on, and written, for the next document's fingerprint is looked up in it.
    own = cut(fingerprint(texts, keys, "body"))
    by_kind = own.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fp"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fp"))).alias("edited_fp"))
    heads = own.where("rn = 1 AND kind = 0").select(F.col("bucket").alias("after"), F.col("fp").alias("_head"))
    heads = after.join(heads, "after").select("bucket", "_head")
    led = by_kind.withColumn("_next", F.lead("fp").over(Window.partitionBy("bucket").orderBy("rn")))
    led = led.join(heads, "bucket", "left").withColumn("next_fp", F.coalesce("_next", "_head"))
    distinct = own.where("kind = 0").select("fp").distinct()
    # Written, so that the join below has two plain sides and a fingerprint of many copies can be split.
    found = led.join(cut(near_counts(distinct, radius)), "fp", "left")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", hex16("fp").alias("fingerprint"), hex16("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"))


def table_masks(radius: int = RADIUS) -> list[int]:
    """The bits of each table's keys: three blocks of radius + 3."""
    n = radius + 3
    bounds = [64 * k // n for k in range(n + 1)]
    return [sum((1 << bounds[b + 1]) - (1 << bounds[b]) for b in chosen) for chosen in combinations(range(n), 3)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_keys(fp: str, radius: int = RADIUS) -> Column:
    """Array of the fingerprint's keys, one for each table: its bits in the table's blocks."""
    return F.array(*[F.col(fp).bitwiseAND(F.lit(_signed(m))) for m in table_masks(radius)])


def parts(radius: int = RADIUS) -> list[list[int]]:
    """Levels at which a large group is filed anew: masks that cut the 64 bits in radius + 1 parts, each time across
    the parts before (by the digits of the bit's number, then by their sum)."""
    k, digits = radius + 1, 1
    while k ** digits < 64:
        digits += 1
    digit = [lambda bit, d=d: bit // k ** d % k for d in range(digits)]
    digit.append(lambda bit: sum(f(bit) for f in digit[:digits]) % k)
    return [[sum(1 << bit for bit in range(64) if f(bit) == p) for p in range(k)] for f in digit]


def near_counts(fps: DataFrame, radius: int = RADIUS, members: int = MEMBERS) -> DataFrame:
    """``fp, n_near`` for every fingerprint (column fp, distinct) with another one within the radius.

    A group under a table key of at most ``members`` fingerprints is one array, in which each of them counts those near it. A larger group
    is filed anew under the parts of its remaining bits, one of which two near fingerprints share. Two that share
    several keys count each other under the first: the tables and parts before must tell them apart, which
    their difference alone decides. So no pair is ever a row. Behind the last level a group's fingerprints differ in a
    few bits only, which bounds it.
    """
    tables = F.array(*[F.lit(_signed(m)) for m in table_masks(radius)])
    filed = fps.select("fp", F.posexplode(block_keys("fp", radius)).alias("path", "key"))
    found, levels = [], parts(radius)
    for level in range(len(levels) + 1):
        sizes = filed.groupBy("path", "key").agg(F.count("*").alias("_n")).where("_n > 1")
        filed = filed.join(sizes, ["path", "key"])
        if not level:
            # The bits of the key and, for each table before, its own: said by the path, so not shuffled.
            filed = filed.withColumns({"mask": F.get(tables, "path"), "before": F.slice(tables, F.lit(1), F.col("path"))})
        filed = cut(filed)
        last = level == len(levels)
        small = filed if last else filed.where(F.col("_n") <= members)
        grouped = small.groupBy("path", "key").agg(F.collect_list("fp").alias("_all"), F.first("before").alias("before"))
        found.append(grouped.select(F.explode("_all").alias("fp"), "_all", "before").select("fp", _near("_all", "before", radius).alias("n_near")))
        large = filed.where(F.col("_n") > members)
        if last or large.isEmpty():
            break
        masks = F.array(*[F.lit(_signed(m)) for m in levels[level]])
        filed = large.select("fp", "path", "before", "mask", F.posexplode(masks).alias("_p", "_part")).select(
            "fp", (F.col("path") * (radius + 1) + F.col("_p")).alias("path"),
            F.col("fp").bitwiseAND(F.col("mask").bitwiseOR(F.col("_part"))).alias("key"),
            F.concat("before", F.slice(masks, F.lit(1), F.col("_p"))).alias("before"),
            F.col("mask").bitwiseOR(F.col("_part")).alias("mask"))
    counts = reduce(DataFrame.unionByName, found).where("n_near > 0")
    return counts.groupBy("fp").agg(F.sum("n_near").alias("n_near"))


def _near(group: str, before: str, radius: int) -> Column:
    """How many of a group's fingerprints are near ``fp`` and not under a key before."""

    def counts(x: Column) -> Column:
        difference = x.bitwiseXOR(F.col("fp"))
        return (F.bit_count(difference) <= radius) & (difference != 0) & F.forall(before, lambda m: difference.bitwiseAND(m) != 0)

    return F.size(F.filter(group, counts)).cast("long")


def near_pairs(fps: DataFrame, other: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs ``a, b`` of different fingerprints of the two tables (column fp, distinct) within the radius.

    For searches of some fingerprints in a table; what lies near in one table is told by ``near_counts``.
    """
    left = fps.select(F.col("fp").alias("a"), F.posexplode(block_keys("fp", radius)).alias("block", "key"))
    right = other.select(F.col("fp").alias("b"), F.posexplode(block_keys("fp", radius)).alias("block", "key"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["block", "key"]).where(close & (F.col("a") != F.col("b")))
    return pairs.select("a", "b").distinct()
