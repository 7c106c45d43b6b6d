"""The transaction record: its schema, its validation by column expressions, and the split into clean and quarantined."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyflow.functions.scalars import coerce_float, coerce_integer, parse_instant, valid_ipv4

#: Fixed values of the record contract.
SCRIPT_TYPES = ("P2PKH", "P2SH", "P2WPKH", "P2WSH", "unknown")
RECORD = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("dst_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("dst_port", T.IntegerType()),
        T.StructField("txid", T.StringType()),
        T.StructField("input_addresses", T.ArrayType(T.StringType())),
        T.StructField("output_addresses", T.ArrayType(T.StringType())),
        T.StructField("input_amounts", T.ArrayType(T.DoubleType())),
        T.StructField("output_amounts", T.ArrayType(T.DoubleType())),
        T.StructField("fee", T.DoubleType()),
        T.StructField("script_type", T.StringType()),
        T.StructField("geo_country", T.StringType()),
        T.StructField("geo_asn", T.LongType()),
    ]
)
COLUMNS = RECORD.fieldNames()
QUARANTINE = "file string, row bigint, error string, raw string"
#: What a run may write to, apart from the clean folder, never includes it.
CLEAN_ZONE = "clean"


@dataclass(frozen=True)
class Rule:
    """A column's parsed value and when the raw one is right; the message names what failed."""

    name: str
    value: Column
    valid: Column
    message: str


def _list(name: str, kind: str) -> Column:
    text = F.trim(F.col(name))
    return F.when(text.isNull() | (text == ""), F.from_json(F.lit("[]"), f"array<{kind}>")).otherwise(F.from_json(text, f"array<{kind}>"))


def record_rules() -> list[Rule]:
    """Rules over text columns; ``valid`` may look at the parsed value as _v_<name>."""
    parsed = lambda name: F.col(f"_v_{name}")
    there = lambda name: parsed(name).isNotNull()
    rules = [Rule("timestamp", parse_instant(F.col("timestamp")), there("timestamp"), "timestamp: not an instant")]
    for c in ("src_ip", "dst_ip"):
        rules.append(Rule(c, F.trim(F.col(c)), valid_ipv4(parsed(c)), f"{c}: not an IPv4 address"))
    for c in ("src_port", "dst_port"):
        rules.append(Rule(c, coerce_integer(F.col(c)).try_cast("int"), parsed(c).between(0, 65535), f"{c}: not an integer from 0 to 65535"))
    rules.append(Rule("txid", F.col("txid"), F.col("txid").rlike("^[a-f0-9]{64}$"), "txid: not 64 hex digits"))
    for c, kind in (("input_addresses", "string"), ("output_addresses", "string"), ("input_amounts", "double"), ("output_amounts", "double")):
        rules.append(Rule(c, _list(c, kind), there(c) & ~F.exists(parsed(c), lambda x: x.isNull()), f"{c}: not a list of {kind}"))
    rules.append(Rule("fee", coerce_float(F.col("fee")), there("fee"), "fee: not a float"))
    rules.append(Rule("script_type", F.col("script_type"), F.col("script_type").isin(*SCRIPT_TYPES), "script_type: unknown name"))
    rules.append(Rule("geo_country", F.col("geo_country"), F.col("geo_country").isNotNull(), "geo_country: missing"))
    rules.append(Rule("geo_asn", coerce_integer(F.col("geo_asn")), there("geo_asn"), "geo_asn: not an integer"))
    return rules


def checked(raw: DataFrame, rules: list[Rule]) -> DataFrame:
    """The raw rows with ``errors``, the messages of the rules that fail (a null counts as failing)."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(r.valid, F.lit(False)), F.lit(r.message)) for r in rules]))
    return raw.withColumn("errors", failed)


def split(raw: DataFrame, rules: list[Rule] | None = None, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantine) of raw text rows. One pass decides; both sides are filters on its result.

    ``_file`` and ``_row`` name a row's origin where the reader gave them. Columns outside the contract are dropped.
    """
    marked = judged(raw, rules)
    return clean_side(marked, rules, keep), bad_side(marked, rules)


def judged(raw: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """The raw rows with their parsed values (_v_<name>) and ``errors``. Values are parsed once, and the rules then look at them."""
    rules = rules or record_rules()
    raw = raw.select("*", *[F.lit(None).cast("string").alias(r.name) for r in rules if r.name not in raw.columns])
    return checked(raw.select("*", *[r.value.alias(f"_v_{r.name}") for r in rules]), rules)


def clean_side(marked: DataFrame, rules: list[Rule] | None = None, keep: list[str] | None = None) -> DataFrame:
    return marked.where(F.size("errors") == 0).select(*(keep or []), *[F.col(f"_v_{r.name}").alias(r.name) for r in rules or record_rules()])


def bad_side(marked: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(file, row, error, raw) of the rows that break a rule."""
    file = F.col("_file") if "_file" in marked.columns else F.lit(None).cast("string")
    bad = marked.where(F.size("errors") > 0)
    if "_row" not in marked.columns:
        bad = numbered(marked, bad) if "_block" in marked.columns else bad.withColumn("_row", F.lit(None))
    line = F.to_json(F.struct(*[F.col(r.name) for r in rules or record_rules()]))
    return bad.select(file.alias("file"), F.col("_row").cast("bigint").alias("row"), F.array_join("errors", "; ").alias("error"), line.alias("raw"))


def contract_projection(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Only the contract's columns, in its order."""
    return df.select(*[c for c in (columns or COLUMNS) if c in df.columns])


def normalised(df: DataFrame) -> DataFrame:
    """Records whose lists are arrays or JSON text and whose timestamp is a string or an instant, in one typed schema."""
    kinds = dict(df.dtypes)
    out = []
    for f in RECORD.fields:
        if f.name not in kinds:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif kinds[f.name] == "string" and isinstance(f.dataType, T.ArrayType):
            out.append(_list(f.name, f.dataType.elementType.simpleString()).alias(f.name))
        elif kinds[f.name] == "string" and f.name == "timestamp":
            out.append(parse_instant(F.col(f.name)).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


def numbered(rows: DataFrame, some: DataFrame) -> DataFrame:
    """Adds ``_row``, the number from 1 within its file, to ``some`` of the ``rows``.

    Rows have their file, the start of the block of it that they were read with, and an ``_id`` that rises by one within
    a block. So a row's number is its place in its block plus the rows of the file's blocks before: only blocks, a row
    each, are brought together.
    """
    blocks = rows.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_file", "_block", (F.coalesce(earlier, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return some.join(blocks, ["_file", "_block"]).withColumn("_row", F.col("_id") + F.col("_shift"))


def schema_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, in_a, in_b): columns of either schema with their types, where they differ."""
    spark = a.sparkSession
    x = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in a.schema], "name string, in_a string")
    y = spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in b.schema], "name string, in_b string")
    return x.join(y, "name", "full").where(~F.col("in_a").eqNullSafe(F.col("in_b")))
