"""Readers of the text formats around traces and probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str, upper: bool = False) -> DataFrame:
    """name (the whole header line), seq. A record begins at a > in front of a line; other > belong to headers."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>", "").alias("value")).where(F.trim("value") != "")
    seq = F.regexp_replace(F.regexp_extract("value", r"(?s)^[^\r\n]*\r?\n?(.*)$", 1), r"\s", "")
    return rows.select(F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1)).alias("name"), (F.upper(seq) if upper else seq).alias("seq"))


def write_fasta(df: DataFrame, path: str) -> None:
    df.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq")).write.text(path)


GFF = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"


def gff3(spark: SparkSession, path: str) -> DataFrame:
    """The nine fields, attributes as a map, and id and parents taken out of it."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=GFF, quote="")
    rows = rows.withColumn("attributes", F.expr("str_to_map(attributes, ';', '=')"))
    return rows.withColumn("id", F.expr("try_element_at(attributes, 'ID')")).withColumn("parents", F.split(F.expr("try_element_at(attributes, 'Parent')"), ","))


def gene_parts(annotation: DataFrame, part: str = "exon") -> DataFrame:
    """Parts of genes through their transcripts: gene, transcript, start, end, strand."""
    genes = annotation.where("type = 'gene'").select(F.col("id").alias("gene"))
    child = annotation.select("id", "type", "start", "end", "strand", F.explode_outer("parents").alias("parent"))
    transcripts = child.where("type in ('mRNA', 'transcript')").join(genes, F.col("parent") == F.col("gene")).select("gene", F.col("id").alias("transcript"))
    return child.where(F.col("type") == part).join(transcripts, F.col("parent") == F.col("transcript")).select("gene", "transcript", "start", "end", "strand")


def region_name(name: Column) -> Column:
    """chr:start-end, with or without thousands separators, as a struct."""
    plain = F.regexp_replace(name, ",", "")
    part = lambda k: F.regexp_extract(plain, r"^([^:]+):(\d+)-(\d+)$", k)
    return F.struct(part(1).alias("chr"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end"))


def regions(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated region list with a Region column."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select("*", region_name(F.col("Region")).alias("r")).select(*rows.columns, "r.*")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """BED or tagAlign: the fifth column is the score, 1 if missing."""
    p = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)")).select(F.split("value", r"\s+").alias("p"))
    return p.select(F.get("p", F.lit(0)).alias("chr"), F.get("p", F.lit(1)).try_cast("long").alias("start"), F.get("p", F.lit(2)).try_cast("long").alias("end"), F.get("p", F.lit(3)).alias("name"), F.coalesce(F.get("p", F.lit(4)).try_cast("double"), F.lit(1.0)).alias("score"))


def wig(spark: SparkSession, path: str) -> DataFrame:
    p = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|\s*$)")).select(F.split("value", r"\s+").alias("p"))
    return p.select(F.get("p", F.lit(0)).alias("chr"), F.get("p", F.lit(1)).try_cast("long").alias("start"), F.get("p", F.lit(2)).try_cast("long").alias("end"), F.get("p", F.lit(3)).try_cast("double").alias("count"))


def colour_usage(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rounds and what each channel shows in them: round, channel, label, kind (the label's leading letters), number."""
    rows = spark.read.csv(path, sep=sep, header=True)
    first, channels = rows.columns[0], rows.columns[1:]
    long = rows.unpivot([first], channels, "channel", "label").where("trim(label) <> ''")
    label = F.trim("label")
    return long.select(F.col(first).alias("round"), "channel", label.alias("label"), F.regexp_extract(label, "^([A-Za-z]+)", 1).alias("kind"), F.regexp_extract(label, r"(\d+)$", 1).try_cast("int").alias("number"))


def matrix(spark: SparkSession, path: str) -> DataFrame:
    """A labelled square matrix as rows (i, j, value)."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.unpivot([rows.columns[0]], rows.columns[1:], "j", "value").select(F.col(rows.columns[0]).alias("i"), "j", F.col("value").try_cast("double").alias("value"))


def write_matrix(df: DataFrame, labels: list[str], path: str) -> None:
    df.groupBy("i").pivot("j", labels).agg(F.first("value")).write.csv(path, sep="\t", header=True)


def trace_table(spark: SparkSession, path: str) -> DataFrame:
    """The published table: places in nm, region from the genomic coordinate, copy number; genes and transcription as arrays."""
    rows = spark.read.csv(path, sep="\t", header=True)
    get = lambda c: F.col(f"`{c}`")
    out = rows.select(
        get("Chromosome copy number").try_cast("long").alias("copy"), region_name(get("Genomic coordinate")).alias("r"),
        *[F.when(~F.isnan(v := get(f"{a}(nm)").try_cast("double")), v).alias(a.lower()) for a in "ZXY"],
        *[F.split(get(c), ";").alias(n) for c, n in (("Gene names", "genes"), ("Transcription", "transcription")) if c in rows.columns],
    )
    return out.select("*", "r.*").drop("r")


def encoding_scheme(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Blocks of rounds x regions for each colour: colour, block, hyb, region (place in the row), value (null where blank).

    The header names the colours; the next three rows give num_hyb, num_reg and num_color; then come the rows of the blocks. The file is
    one small table that is read whole, as its rows have an order."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("n", "line"))
    cells = lines.where("line <> ''").withColumn("cells", F.split("line", sep, -1))
    head = cells.where("n < 4").agg(F.map_from_entries(F.collect_list(F.struct(F.when(F.col("n") == 0, "colours").otherwise(F.trim(F.get("cells", F.lit(0)))), "cells"))).alias("h"))
    number = lambda k: F.get(F.col(f"h.{k}"), F.lit(1)).try_cast("int")
    rows = cells.where("n >= 4").crossJoin(F.broadcast(head))  # one row
    place = F.posexplode(F.col("cells")).alias("place", "value")
    rows = rows.select((F.col("n") - 4).alias("row"), number("num_hyb").alias("hybs"), number("num_reg").alias("regs"), F.col("h.colours").alias("colours"), place)
    colour = F.floor(F.col("place") / F.col("regs")).cast("int")
    return rows.where(colour < F.size("colours")).select(
        F.trim(F.get("colours", colour)).alias("colour"), F.floor(F.col("row") / F.col("hybs")).cast("int").alias("block"), (F.col("row") % F.col("hybs")).alias("hyb"),
        (F.col("place") % F.col("regs")).alias("region"), F.col("value").try_cast("int").alias("value"),
    )


def aligned_traces(spots: DataFrame, regions: DataFrame) -> DataFrame:
    """Traces from an aligner's table (chr, fiberidx, hyb, z_um, x_um, y_um), with a row without place for every region
    (chr, hyb) that a fibre lacks; nm."""
    fibres = spots.select("chr", "fiberidx").distinct().join(regions.select("chr", "hyb").distinct(), "chr")
    place = [(F.col(f"{c}_um") * 1000).alias(c) for c in "zxy"]
    return fibres.join(spots.select("chr", "fiberidx", "hyb", *place), ["chr", "fiberidx", "hyb"], "left")


def typed(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """A table with a header whose columns come in any order: those of ``schema``, cast; what does not fit is null. Whole numbers may be
    written as 1200.0 or 1e6."""
    rows = spark.read.csv(path, sep=sep, header=True)
    names = {c.strip(): c for c in rows.columns}
    fields = [f.strip().split(" ") for f in schema.split(",")]

    def cast(c: str, kind: str) -> Column:
        v = F.trim(F.col(f"`{names[c]}`"))
        return v.try_cast("double").try_cast(kind) if kind in ("int", "long") else v.try_cast(kind)

    return rows.select(*[(cast(c, kind) if c in names else F.lit(None).cast(kind)).alias(c) for c, kind in fields])


def region_positions(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return typed(spark, path, "id int, chr string, start long, end long, midpoint long", sep)


def chip_peaks(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return typed(spark, path, "chr string, start long, end long, midpoint double, fold double", sep)


def rna_info(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return typed(spark, path, "RNA_id string, gene_name string, chr string, strand string, start long, end long, midpoint double", sep)


def gene_info(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return typed(spark, path, "gene_id int, gene_name string, chr string, TSS_position long", sep)


def readouts(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return typed(spark, path, "Bit int, ReadoutName string", sep).select(F.col("Bit").alias("bit"), F.col("ReadoutName").alias("name"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of small files in their order: path, n (from 0), line. Each file is read whole."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split(F.rtrim("value"), r"\r?\n")).alias("n", "line"))
    return rows.where("line <> ''")


def positions(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Stage positions without a header: fov_id (the line's number), x, y."""
    cell = lambda k: F.get(F.split("line", sep), F.lit(k)).try_cast("double")
    return numbered_lines(spark, path).select(F.col("n").alias("fov_id"), cell(0).alias("x"), cell(1).alias("y"))


def microscope(spark: SparkSession, path: str) -> DataFrame:
    """transpose, flip_horizontal, flip_vertical; false where the file does not say."""
    rows = spark.read.schema("transpose boolean, flip_horizontal boolean, flip_vertical boolean").json(path, multiLine=True)
    return rows.select(*[F.coalesce(c, F.lit(False)).alias(c) for c in rows.columns])


def gff3_directives(spark: SparkSession, path: str) -> DataFrame:
    """The header's directives: name, value."""
    rows = spark.read.text(path).where("value like '##%' and value not like '###%'")
    return rows.select(F.regexp_extract("value", r"^##(\S+)", 1).alias("name"), F.trim(F.regexp_extract("value", r"^##\S+(.*)$", 1)).alias("value"))


def gff3_sections(spark: SparkSession, path: str) -> DataFrame:
    """The features of each section between ### lines: section, and the nine fields' line."""
    rows = numbered_lines(spark, path)
    cuts = rows.where("line like '###%'").groupBy("path").agg(F.array_sort(F.collect_list("n")).alias("cuts"))
    section = F.size(F.filter(F.coalesce("cuts", F.array().cast("array<int>")), lambda c: c < F.col("n")))
    return rows.where("line not like '#%'").join(cuts, "path", "left").select(section.alias("section"), "line")


def genes_by_name(annotation: DataFrame, names: list[str]) -> DataFrame:
    """Features whose id or Name attribute is one of the names."""
    return annotation.where(F.col("id").isin(names) | F.expr("try_element_at(attributes, 'Name')").isin(names))


def descendants(annotation: DataFrame, depth: int = 3) -> DataFrame:
    """Feature and ancestor, over up to ``depth`` parents: id, ancestor, distance."""
    step = annotation.select("id", F.explode("parents").alias("ancestor")).where("id is not null").distinct()
    out, last = step.withColumn("distance", F.lit(1)), step
    for k in range(2, depth + 1):
        last = last.join(step.select(F.col("id").alias("_at"), F.col("ancestor").alias("_up")), F.col("ancestor") == F.col("_at")).select("id", F.col("_up").alias("ancestor")).distinct()
        out = out.unionByName(last.withColumn("distance", F.lit(k)))
    return out


def packed_points(name: Column) -> Column:
    """Places written as [z x y];[z x y]; as an array of structs."""
    parts = F.regexp_extract_all(name, F.lit(r"\[([^\]]*)\]"), F.lit(1))
    number = lambda t, k: F.get(F.split(F.trim(t), r"[\s,]+"), F.lit(k)).try_cast("double")
    return F.transform(parts, lambda t: F.struct(*[number(t, k).alias(c) for k, c in enumerate("zxy")]))
