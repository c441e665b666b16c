"""Lines repeated across one site's documents (problem 1).

The document frequency of every line within a source is compared with its frequency outside of it by Dunn's
log-likelihood ratio; those with a significant excess, at a false-discovery rate after Benjamini and Hochberg over all
of them, that also stand in enough documents of the source are taken out of each document by position. Everything stays in built-in expressions; only counts are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut

#: Log-likelihood ratios are binned for the false-discovery threshold: bins of 1/8, those beyond the last share it.
BINS_PER_UNIT, LAST_BIN = 8, 8 * 400


def letters(line: Column) -> Column:
    """The letters of a line, whatever their case (upper then lower, so that sharp s meets its capital form)."""
    return F.lower(F.upper(F.regexp_replace(line, r"[^\p{L}]+", "")))


def numbered_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, source, line_no, key, key2) of every line that has letters; null texts have no lines, blank sources count as none."""
    lines = documents.select("doc_id", _site().alias("source"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.select("doc_id", "source", "line_no", letters(F.col("line")).alias("letters")).filter(F.col("letters") != "")
    return lines.select("doc_id", "source", "line_no", F.xxhash64("letters").alias("key"), F.hash("letters").alias("key2"))


def log_likelihood(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    """Dunn's log-likelihood ratio of k1 of n1 against k2 of n2."""

    def part(observed: Column, expected: Column) -> Column:
        return F.when(observed > 0, observed * F.log(observed / expected)).otherwise(0.0)

    hit, all_ = (k1 + k2) / (n1 + n2), n1 + n2
    miss = (all_ - k1 - k2) / all_
    return 2.0 * (part(k1, n1 * hit) + part(n1 - k1, n1 * miss) + part(k2, n2 * hit) + part(n2 - k2, n2 * miss))


def line_counts(documents: DataFrame) -> DataFrame:
    """(source, key, key2, docs), how many documents of a source have a line, rows without source included as one; written once, since all that follows reads it twice."""
    return cut(_doc_lines(documents).groupBy("source", "key", "key2").agg(F.count(F.lit(1)).alias("docs")))


def tested_lines(documents: DataFrame, min_docs: int = 3, min_share: float = 0.08) -> DataFrame:
    """(source, key, key2, docs, site_docs, outside_docs, outside_rows, recurs, llr) of every line of every source that stands in at least min_docs documents at all.

    Rarer lines can't be significant whatever their distribution, so they aren't tested. recurs tells whether the line
    stands in at least min_docs documents and min_share of the rows of the source. The outside are all rows but those of
    this source and of the others in which the line recurs: sites that share a template must not hide it from each other.
    A site's rows are all its rows, those without text included; rows without source are outside of every source. Where
    nothing is outside, the ratio is null.
    """
    counts = line_counts(documents)
    sites = documents.select(_site().alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("site_docs"))
    total = sites.agg(F.sum("site_docs").alias("all_docs"))
    sites = sites.filter(F.col("source").isNotNull())
    recurs = (F.col("docs") >= min_docs) & (F.col("docs") >= F.col("site_docs") * min_share)
    marked = counts.join(sites, "source", "left").withColumn("recurs", F.coalesce(recurs, F.lit(False)))
    lines = marked.groupBy("key", "key2").agg(
        F.sum("docs").alias("line_docs"), F.sum(F.when(F.col("recurs"), F.col("docs")).otherwise(0)).alias("recurring_docs"), F.sum(F.when(F.col("recurs"), F.col("site_docs")).otherwise(0)).alias("recurring_rows")
    )
    tests = marked.filter(F.col("source").isNotNull()).join(lines.filter(F.col("line_docs") >= min_docs), ["key", "key2"]).withColumn("all_docs", total.scalar())
    tests = tests.withColumn("outside_docs", F.col("line_docs") - F.col("recurring_docs") - F.when(F.col("recurs"), 0).otherwise(F.col("docs")))
    tests = tests.withColumn("outside_rows", F.col("all_docs") - F.col("recurring_rows") - F.when(F.col("recurs"), 0).otherwise(F.col("site_docs")))
    k1, n1, k2, n2 = (F.col(c).cast("double") for c in ("docs", "site_docs", "outside_docs", "outside_rows"))
    excess = F.when(k1 / n1 > k2 / n2, log_likelihood(k1, n1, k2, n2)).otherwise(0.0)
    return tests.select("source", "key", "key2", "docs", "site_docs", "outside_docs", "outside_rows", "recurs", F.when(n2 > 0, excess).alias("llr"))


def recurring_lines(documents: DataFrame, min_docs: int = 3, min_share: float = 0.08, fdr: float = 0.05) -> DataFrame:
    """(source, key, key2, docs, site_docs, outside_docs, llr): the lines with a significant excess within their source that recur there.

    Every tested line counts for the false-discovery rate. Where nothing is outside of the sources in which a line
    recurs there is nothing to compare with, and recurring decides.
    """
    tests = tested_lines(documents, min_docs, min_share)
    found = _significant(tests.filter("llr is not null"), fdr).filter("recurs").unionByName(tests.filter("llr is null and recurs"))
    return found.select("source", "key", "key2", "docs", "site_docs", "outside_docs", "llr")


def _site() -> Column:
    """The source of a row, null if blank."""
    return F.when(F.trim("source") != "", F.col("source"))


def _doc_lines(documents: DataFrame) -> DataFrame:
    """(source, key, key2), once for each document that has the line: repeats within a document go before any shuffle."""
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n", -1), letters), lambda x: x != ""), lambda x: F.struct(F.xxhash64(x).alias("key"), F.hash(x).alias("key2"))))
    return documents.select(_site().alias("source"), F.explode(keys).alias("k")).select("source", "k.key", "k.key2")


def _significant(tests: DataFrame, fdr: float) -> DataFrame:
    """Benjamini and Hochberg over the binned ratios: the bins are few whatever the number of tests.

    A bin's p-value is the chi-square tail at its lower edge, by its upper bound exp(-x/2) * sqrt(2 / (pi x)).
    """
    tests = tests.withColumn("bin", F.least(F.floor(F.col("llr") * BINS_PER_UNIT), F.lit(LAST_BIN)))
    edge = F.col("bin") / F.lit(float(BINS_PER_UNIT))
    p = F.when(edge < 0.25, 1.0).otherwise(F.least(F.lit(1.0), F.exp(-edge / 2) * F.sqrt(2.0 / (3.141592653589793 * edge))))
    everything = Window.orderBy(F.desc("bin"))  # over at most LAST_BIN + 1 rows
    bins = tests.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select("bin", F.sum("n").over(everything).alias("rank"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("m"))
    lowest = bins.filter(p * F.col("m") <= fdr * F.col("rank")).agg(F.min("bin").alias("lowest"))
    return tests.filter(F.col("bin") >= lowest.scalar()).drop("bin")


#: Up to so many recurring lines (40 bytes each) are broadcast; beyond it they are joined by shuffles.
BROADCAST_ROWS = 500_000


def _known(documents: DataFrame, **options: float) -> tuple[DataFrame, bool]:
    """The recurring lines, written once, and whether they are few enough to be broadcast."""
    found = cut(recurring_lines(documents, **options).select("source", "key", "key2"))
    return found, found.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _occurrences(documents: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    lines = numbered_lines(documents).filter(F.col("source").isNotNull())
    return lines.join(F.broadcast(found) if few else found, ["source", "key", "key2"], "left_semi").select("doc_id", "source", "line_no")


def repeated_lines(documents: DataFrame, **options: float) -> DataFrame:
    """(doc_id, source, line_no): every occurrence of a recurring line; see recurring_lines for the options."""
    return _occurrences(documents, *_known(documents, **options))


def remove_repeated_lines(documents: DataFrame, **options: float) -> DataFrame:
    """documents with a column clean_text (an earlier one goes), the text without its recurring lines, and n_removed.

    Lines are taken out by position, the rest keeps its order. A null text stays null; doc_id must be unique. A source
    has few recurring lines, since each stands in min_share of its rows: they meet its documents as one broadcast list.
    Only where there are too many sources for that, the documents are joined with their occurrences by doc_id.
    """
    documents = documents.drop("clean_text", "n_removed", "_gone", "_site")
    found, few = _known(documents, **options)
    if not few:
        gone = _occurrences(documents, found, few).groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
        kept = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.coalesce("_gone", F.array().cast("array<int>")), i))
        joined = documents.join(gone, "doc_id", "left")
        return joined.withColumn("clean_text", F.array_join(kept, "\n")).withColumn("n_removed", F.coalesce(F.size("_gone"), F.lit(0))).drop("_gone")
    lists = found.groupBy(F.col("source").alias("_site")).agg(F.collect_set(F.struct("key", "key2")).alias("_gone"))
    joined = documents.join(F.broadcast(lists), _site() == F.col("_site"), "left")

    def gone_at(line: Column) -> Column:
        own = letters(line)
        return (own != "") & F.array_contains("_gone", F.struct(F.xxhash64(own).alias("key"), F.hash(own).alias("key2")))

    lines = F.split("text", "\n", -1)
    kept = F.when(F.col("_gone").isNull(), lines).otherwise(F.filter(lines, lambda x: ~gone_at(x)))
    joined = joined.withColumn("_kept", kept)
    removed = F.coalesce(F.size(lines) - F.size("_kept"), F.lit(0))
    return joined.withColumn("clean_text", F.array_join("_kept", "\n")).withColumn("n_removed", F.when(F.col("text").isNull(), 0).otherwise(removed)).drop("_gone", "_site", "_kept")
