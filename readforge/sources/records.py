"""Alignment records, index chunks and annotated sequences: SAM text, BAM index arithmetic, GenBank flat files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from readforge.functions.columns import reverse_complement

#: The eleven fields of an alignment line, in order.
SAM_FIELDS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
SAM_NUMBERS = {"flag", "pos", "mapq", "pnext", "tlen"}


def read_sam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The eleven fields and ``tags`` (map of tag to ``type:value``) of each alignment line; header lines begin with ``@``.

    A line of fewer fields is an error. ``*`` stays as it is.
    """
    f = F.split(F.regexp_replace("value", "\r$", ""), "\t")
    lines = spark.read.text(path).where(~F.col("value").startswith("@") & (F.col("value") != "")).select(f.alias("f"))
    kept = lines.select(F.when(F.size("f") >= 11, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not an alignment line: "), F.col("f")[0])).cast("array<string>")).alias("f"))
    own = [(F.col("f")[i].cast("long") if c in SAM_NUMBERS else F.col("f")[i]).alias(c) for i, c in enumerate(SAM_FIELDS)]
    pairs = F.transform(F.slice("f", 12, 1 << 30), lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.substring(t, 4, 1 << 30).alias("value")))
    return kept.select(*own, F.map_from_entries(pairs).alias("tags"))


def write_sam(rows: DataFrame, path: str) -> None:
    """Alignment lines without a header; ``tags`` in the order of their names, missing fields as ``*`` or 0."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("0" if c in SAM_NUMBERS else "*")) for c in SAM_FIELDS]
    tags = [F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))] if "tags" in rows.columns else []
    rows.select(F.concat_ws("\t", *fields, *tags)).write.text(path)


def sam_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(type, fields) of the header lines; fields by tag, the text of a comment under ``text``."""
    line = spark.read.text(path).where(F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"))
    pairs = F.transform(F.slice("f", 2, 1 << 30), lambda t: F.struct(F.substring(t, 1, 2).alias("tag"), F.substring(t, 4, 1 << 30).alias("value")))
    comment = F.create_map(F.lit("text"), F.array_join(F.slice("f", 2, 1 << 30), "\t"))
    kind = F.expr("substring(f[0], 2)")
    return line.select(kind.alias("type"), F.when(kind == "CO", comment).otherwise(F.map_from_entries(pairs)).alias("fields"))


def index_bin(start: Column, end: Column) -> Column:
    """The smallest bin of the index that holds the 0-based half-open range: levels of 16 kb and eight times more each."""
    last, at = end - 1, F.lit(0).cast("long")
    for level in range(1, 6):  # coarse to fine, so that the finest that fits wins
        shift, first = 29 - 3 * level, ((1 << 3 * level) - 1) // 7
        at = F.when(F.shiftright(start, shift) == F.shiftright(last, shift), F.shiftright(start, shift) + first).otherwise(at)
    return at


def merged_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunk_start, chunk_end): chunks of a bin, ordered by start and then longest first, joined where they touch or overlap."""
    order = W.partitionBy(*keys).orderBy("chunk_start", F.desc("chunk_end"))
    reach = F.max("chunk_end").over(order.rowsBetween(W.unboundedPreceding, -1))
    own = chunks.select(*keys, "chunk_start", "chunk_end").distinct()
    numbered = own.withColumn("_new", F.coalesce(F.col("chunk_start") > reach, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    return numbered.groupBy(*keys, "_run").agg(F.min("chunk_start").alias("chunk_start"), F.max("chunk_end").alias("chunk_end")).drop("_run")


# ---- GenBank

FEATURE = "array<struct<key:string,location:string,qualifiers:array<struct<name:string,value:string>>>>"


def read_genbank(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(locus, length, definition, accession, features, seq) of each entry of flat files; entries end with ``//``.

    features: array of key, location (without line breaks) and qualifiers (name, value), in order. Entries are found by
    the text reader's separator, so plain files are split over tasks.
    """
    text = spark.read.option("lineSep", "\n//\n").text(path).select(F.replace("value", F.lit("\r"), F.lit("")).alias("t")).where(F.col("t").rlike(r"(?m)^LOCUS"))
    field = lambda name: F.regexp_replace(F.regexp_extract("t", rf"(?m)^{name} +(.*(?:\n {{12}}.*)*)", 1), r"\n +", " ")
    table = F.regexp_extract("t", r"(?m)^FEATURES.*\n((?: {5}.*(?:\n|$))*)", 1)
    entries = F.regexp_extract_all(table, F.lit(r"(?m)^ {5}\S.*(?:\n {21}.*)*"), F.lit(0))
    inner = lambda e: F.regexp_replace(e, r"\n {21}", "\n")
    name = lambda q: F.regexp_extract(q, r"^/([^=\n]+)", 1)
    value = lambda q: F.when(q.contains("="), F.regexp_replace(F.regexp_extract(q, r'(?s)=(?:"(.*)"|(.*))$', 1), '""', '"'))
    bare = lambda q: F.when(q.contains("="), F.regexp_extract(q, r"(?s)=(.*)$", 1))
    shown = lambda q: F.regexp_replace(F.when(q.rlike(r'(?s)="'), value(q)).otherwise(bare(q)), "\n", " ")

    def feature(e):
        text = inner(e)
        parts = F.split(text, r"\n(?=/)")
        return F.struct(
            F.regexp_extract(text, r"^ {5}(\S+)", 1).alias("key"),
            F.regexp_replace(F.regexp_extract(parts[0], r"(?s)^ {5}\S+\s+(.*)$", 1), r"\s", "").alias("location"),
            F.transform(F.slice(parts, 2, 1 << 30), lambda q: F.struct(name(q).alias("name"), shown(q).alias("value"))).alias("qualifiers"),
        )

    seq = F.upper(F.regexp_replace(F.regexp_extract("t", r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[^A-Za-z]", ""))
    locus = F.regexp_extract("t", r"(?m)^LOCUS +(\S+)", 1)
    length = F.regexp_extract("t", r"(?m)^LOCUS +\S+ +(\d+) (?:bp|aa)", 1)
    return text.select(locus.alias("locus"), F.when(length != "", length.cast("long")).alias("length"), field("DEFINITION").alias("definition"), field("ACCESSION").alias("accession"), F.transform(entries, feature).cast(FEATURE).alias("features"), seq.alias("seq"))


def genbank_text() -> Column:
    """One entry from the columns of ``read_genbank``, its closing line left to the writer."""
    block = lambda s, n: F.array_join(F.regexp_extract_all(s, F.lit(f"(?s).{{1,{n}}}"), F.lit(0)), " ")
    rows = F.regexp_extract_all("seq", F.lit("(?s).{1,60}"), F.lit(0))
    origin = F.array_join(F.transform(rows, lambda s, i: F.concat(F.lpad((i * 60 + 1).cast("string"), 9, " "), F.lit(" "), F.lower(block(s, 10)))), "\n")
    quoted = lambda q: F.concat(F.lit("\n" + " " * 21 + "/"), q["name"], F.coalesce(F.concat(F.lit('="'), F.regexp_replace(q["value"], '"', '""'), F.lit('"')), F.lit("")))
    listed = F.transform("features", lambda f: F.concat(F.lit("     "), F.rpad(f["key"], 16, " "), f["location"], F.array_join(F.transform(f["qualifiers"], quoted), "")))
    head = F.concat(F.lit("LOCUS       "), "locus", F.lit(" "), F.length("seq").cast("string"), F.lit(" bp\nDEFINITION  "), "definition", F.lit("\nACCESSION   "), "accession")
    return F.concat(head, F.lit("\nFEATURES             Location/Qualifiers\n"), F.array_join(listed, "\n"), F.lit("\nORIGIN\n"), origin)


def write_genbank(rows: DataFrame, path: str) -> None:
    rows.select(genbank_text()).write.option("lineSep", "\n//\n").text(path)


def located(seq: Column, location: Column) -> Column:
    """The bases a location names: ``a..b``, ``a``, ``complement(...)`` and ``join(...)`` within each other, 1-based and inclusive."""
    ranges = F.regexp_extract_all(location, F.lit(r"(?:complement\()?<?\d+(?:\.\.>?\d+)?"), F.lit(0))
    whole = location.rlike(r"^complement\((?:join|order)\(")

    def bases(r):
        a = F.regexp_extract(r, r"(\d+)", 1).cast("int")
        b = F.coalesce(F.nullif(F.regexp_extract(r, r"\.\.>?(\d+)", 1), F.lit("")).cast("int"), a)
        own = F.substring(seq, a, b - a + 1)
        return F.when(r.startswith("complement("), reverse_complement(own)).otherwise(own)

    text = F.array_join(F.transform(ranges, bases), "")
    return F.when(whole, reverse_complement(text)).otherwise(text)


def features_of(entries: DataFrame, key: str) -> DataFrame:
    """(locus, location, qualifiers as a map of arrays, bases) of all features of one kind."""
    each = entries.select("locus", "seq", F.explode(F.filter("features", lambda f: f["key"] == key)).alias("f"))
    names = F.array_distinct(F.transform("f.qualifiers", lambda q: q["name"]))
    values = F.transform(names, lambda n: F.transform(F.filter("f.qualifiers", lambda q: q["name"] == n), lambda q: q["value"]))
    return each.select("locus", "f.location", F.map_from_arrays(names, values).alias("qualifiers"), located(F.col("seq"), F.col("f.location")).alias("bases"))
