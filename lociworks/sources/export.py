"""Sinks: VCF lines, TSV matrices, partitioned Parquet, fingerprints of sources, concatenation with a check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import union_by_name

#: Lines that head a VCF file (a fixed format).
VCF_INFO = {
    "CLUSTER": ("Integer", "Cluster label, -1 is noise"),
    "CLPROB": ("Float", "Cluster membership probability"),
    "UMAP1": ("Float", "First projected coordinate"),
    "UMAP2": ("Float", "Second projected coordinate"),
    "SRC_FILT": ("Integer", "Filter value of the source row"),
}


def vcf_header(date: str, source: str, reference: str | None = None) -> list[str]:
    out = ["##fileformat=VCFv4.3", f"##fileDate={date}", f"##source={source}"]
    if reference:
        out.append(f"##reference={reference}")
    out += [f'##INFO=<ID={k},Number=1,Type={t},Description="{d}">' for k, (t, d) in VCF_INFO.items()]
    return [*out, '##FILTER=<ID=PASS,Description="All filters passed">', "#" + "\t".join(["CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"])]


def six_digits(x: Column) -> Column:
    """Numbers with six significant digits, as %.6g writes them: Java's form of it, less the zeros at the end. NaN is null.

    Halves of the sixth digit are rounded up.
    """
    zeros = F.regexp_replace(F.format_string("%.6g", x), r"(\.\d*?)0+(?=e|$)", "$1")
    return F.when(x.isNotNull() & ~F.isnan(x), F.regexp_replace(zeros, r"\.(?=e|$)", ""))


def vcf_lines(df: DataFrame) -> DataFrame:
    """(CHROM, POS, REF, ALT, line): one tab-separated line per row; absent parts of INFO are left out."""
    have = set(df.columns)
    pick = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    number = lambda name: six_digits(pick(name, "double"))
    part = lambda tag, value: F.when(value.isNotNull(), F.concat(F.lit(f"{tag}="), value))
    filt = pick("FILT", "int")
    info = F.concat_ws(
        ";",
        part("CLUSTER", pick("cluster_label", "string")),
        part("CLPROB", number("cluster_probability")),
        part("UMAP1", number("umap_1")),
        part("UMAP2", number("umap_2")),
        part("SRC_FILT", filt.cast("string")),
    )
    passed = F.when(filt.isNull() | (filt == 1), "PASS").otherwise(".")
    line = F.concat_ws(
        "\t",
        pick("CHROM", "string"),
        pick("POS", "string"),
        F.lit("."),
        pick("REF", "string"),
        pick("ALT", "string"),
        F.coalesce(number("QUAL"), F.lit(".")),
        passed,
        F.when(info == "", ".").otherwise(info),
    )
    return df.select("CHROM", "POS", "REF", "ALT", line.alias("line"))


def write_vcf(df: DataFrame, path: str, header: list[str]) -> None:
    """Sorted lines in part files, range-partitioned by place, and the header on its own; no rows is an error."""
    lines = vcf_lines(df)
    if lines.isEmpty():
        raise ValueError("no rows to export")
    spark = df.sparkSession
    spark.createDataFrame([("\n".join(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    lines.repartitionByRange("CHROM", "POS", "REF", "ALT").sortWithinPartitions("CHROM", "POS", "REF", "ALT", "line").select("line").write.mode("overwrite").text(f"{path}/lines")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)


def concatenate(parts: dict[str, DataFrame], path: str) -> int:
    """Writes all parts as one table and checks that no row went missing."""
    union_by_name(parts).write.mode("overwrite").option("compression", "zstd").parquet(path)
    spark = next(iter(parts.values())).sparkSession
    wanted, found = sum(p.count() for p in parts.values()), spark.read.parquet(path).count()
    if wanted != found:
        raise ValueError(f"{wanted} rows went in, {found} came out")
    return found


def percent(text: Column) -> Column:
    """"12.3%" as a number; null if it isn't one."""
    return F.regexp_replace(F.trim(text), "%$", "").try_cast("double")


def write_manifest(rows: DataFrame, path: str, columns: list[str], form: str = "csv") -> None:
    """A manifest as CSV or JSON lines with a fixed list of columns; others are left out."""
    writer = rows.select(*columns).write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)
