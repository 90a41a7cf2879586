"""File sources and sinks: JSON lines with aliases, aligned text files, TSV lexicons, shards, manifests, write-once tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXAMPLE = "id string, row_id string, dataset_row_id string, en string, en_clean string, vi string, vi_clean string, technical_tags array<string>"


def parse_examples(lines: DataFrame) -> DataFrame:
    """row_id, en, vi, technical_tags from JSON lines whose fields go by several names; ids become text."""
    x = lines.select(F.from_json("value", EXAMPLE).alias("r"))
    either = lambda *names: F.coalesce(*(F.col(f"r.{n}") for n in names))
    return x.select(either("dataset_row_id", "row_id", "id").alias("row_id"), either("en_clean", "en").alias("en"), either("vi_clean", "vi").alias("vi"), F.coalesce("r.technical_tags", F.array().cast("array<string>")).alias("technical_tags"))


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return parse_examples(spark.read.text(path))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(i, line) in file order, from 0. One file is read whole; its lines are numbered by position, not by partition."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("i", "line"))
    return whole.withColumn("i", F.col("i").cast("long"))


def read_aligned(spark: SparkSession, first: str, second: str) -> DataFrame:
    """Lines of two files side by side; a row without its other half has a null there."""
    a, b = read_lines(spark, first).withColumnRenamed("line", "first_line"), read_lines(spark, second).withColumnRenamed("line", "second_line")
    return a.join(b, "i", "full_outer")


def read_lexicon(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    """Tab-separated rows, comments and blank lines left out, the first column lower-cased."""
    lines = spark.read.text(path).filter("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parts = F.split("value", "\t")
    cells = [F.trim(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(names)]
    return lines.select(F.lower(cells[0]).alias(names[0]), *cells[1:])


def read_sheet(spark: SparkSession, path: str, names: tuple[str, ...], delimiter: str = ",", skip: int = 0) -> DataFrame:
    """A review sheet, a small file: `skip` lines and a byte order mark left out, cells as text. Its header must have
    `names`. Quoted cells may hold line breaks."""
    import csv
    import io

    text = (read_text(spark, path) or "").removeprefix("\ufeff")
    rows = list(csv.reader(io.StringIO(text.split("\n", skip)[-1] if skip else text, newline=""), delimiter=delimiter))
    if not rows or not set(names) <= set(rows[0]):
        raise ValueError(f"{path} lacks columns of {names}")
    width = len(rows[0])
    return spark.createDataFrame([(r + [None] * width)[:width] for r in rows[1:] if r], ", ".join(f"`{n}` string" for n in rows[0]))


def sheet_problems(sheet: DataFrame, ids: DataFrame, key: str, labels: tuple[str, ...], allowed=("yes", "no", "unclear")) -> DataFrame:
    """key, problem: ids that are blank, repeated, missing or not asked for, and labels that aren't allowed."""
    n = sheet.groupBy(key).agg(F.count("*").alias("_n"), *(F.bool_and(F.coalesce(F.col(c).isin(*allowed), F.lit(False))).alias(c) for c in labels))
    x = n.join(ids.select(F.col(key).alias("_id")).distinct(), F.col(key).eqNullSafe(F.col("_id")), "full_outer")
    here = F.col("_n").isNotNull()
    faults = F.array_compact(
        F.array(
            F.when(here & (F.trim(F.coalesce(key, F.lit(""))) == ""), "blank_id"),
            F.when(F.col("_n") > 1, "repeated"),
            F.when(~here, "missing"),
            F.when(here & F.col("_id").isNull(), "not_asked"),
            *(F.when(here & ~F.col(c), f"{c}_not_allowed") for c in labels),
        )
    )
    return x.select(F.coalesce(key, "_id").alias(key), F.explode(faults).alias("problem"))


def read_documents(spark: SparkSession, folder: str, schema: str, key: str = "id") -> DataFrame:
    """JSON documents, one a file; a damaged one, or one without its key, is skipped."""
    x = spark.read.text(folder, wholetext=True, pathGlobFilter="*.json").select(F.from_json("value", schema).alias("d")).select("d.*")
    return x.filter(F.col(key).isNotNull())


def read_cases(spark: SparkSession, path: str, case: str) -> DataFrame:
    """The cases of a JSON file {"cases": [...]}, in order, by the schema of one case; one without an id is an error."""
    x = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"cases array<struct<{case}>>")["cases"]).alias("i", "c"))
    return x.select("i", "c.*").withColumn("id", F.when(F.col("id").isNull(), F.raise_error(F.lit("a case without an id"))).otherwise(F.col("id")))


def read_shards(spark: SparkSession, path: str, schema: str, key: str, order: str) -> DataFrame:
    """Rows of all shards, of equal keys the one with the greatest `order`."""
    x = spark.read.schema(schema).json(path)
    last = x.groupBy(key).agg(F.max(F.struct(order, *[c for c in x.columns if c not in (order, key)])).alias("m"))
    return last.select(key, "m.*")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of the files under a folder."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.select(F.col("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_release(released: DataFrame, path: str) -> None:
    """Parquet and JSON by split, ordered by id within a file; an existing target is an error and nothing is written."""
    spark = released.sparkSession
    jvm = spark.sparkContext._jvm
    targets = [f"{path}/parquet", f"{path}/json"]
    for t in targets:
        p = jvm.org.apache.hadoop.fs.Path(t)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            raise FileExistsError(t)
    rows = released.repartition("split").sortWithinPartitions("split", "dataset_row_id")
    rows.write.partitionBy("split").mode("errorifexists").parquet(targets[0])
    rows.write.partitionBy("split").mode("errorifexists").json(targets[1])


def commit(spark: SparkSession, staged: str, final: str) -> None:
    """Rename a finished folder to its final name; fails if that exists."""
    jvm = spark.sparkContext._jvm
    a, b = (jvm.org.apache.hadoop.fs.Path(x) for x in (staged, final))
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(b) or not fs.rename(a, b):
        raise FileExistsError(final)


def _place(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none. Needs a file system with rename, such as HDFS or a shared folder."""
    p, fs = _place(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A new small file; an existing one is an error."""
    p, fs = _place(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file, then take its place."""
    staged = f"{path}.staged"
    p, fs = _place(spark, path)
    s, _ = _place(spark, staged)
    fs.delete(s, False)
    write_text(spark, staged, text)
    fs.delete(p, False)
    if not fs.rename(s, p):
        raise OSError(path)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _place(spark, path)
    fs.delete(p, True)


def write_or_verify(spark: SparkSession, path: str, text: str, ignore: str = r"(?!)") -> bool:
    """Whether the file was written. One that is there must have this text, but for what `ignore` matches."""
    import re

    there = read_text(spark, path)
    if there is None:
        write_text(spark, path, text)
    elif re.sub(ignore, "", there) != re.sub(ignore, "", text):
        raise ValueError(f"{path} has other content")
    return there is None


def write_if_changed(spark: SparkSession, path: str, text: str, ignore: str = r"(?!)") -> bool:
    """Whether the file was written: only if it differs in more than what `ignore` matches, such as its timestamp."""
    import re

    there = read_text(spark, path)
    if there is not None and re.sub(ignore, "", there) == re.sub(ignore, "", text):
        return False
    replace_text(spark, path, text)
    return True


def read_role(spark: SparkSession, paths: dict[str, str], role: str, open_roles: frozenset[str]) -> DataFrame:
    """The examples of a role; one that is not open in this stage is an error before anything is read."""
    if role not in open_roles or role not in paths:
        raise PermissionError(f"{role} is not open here")
    return read_examples(spark, paths[role])


def invalid_examples(rows: DataFrame, require_tags: bool) -> DataFrame:
    """row_id, problem: the first fault of each row that has one: no id, no text of a side, or no tags where they must be."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fault = F.when(blank("row_id"), "row_id").when(blank("en"), "en").when(blank("vi"), "vi")
    if require_tags:
        fault = fault.when(F.coalesce(F.size("technical_tags"), F.lit(0)) <= 0, "technical_tags")
    return rows.select("row_id", fault.alias("problem")).filter("problem is not null")


def tree_stats(spark: SparkSession, path: str) -> DataFrame:
    """files and bytes under a folder, without reading them."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return x.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def tree_hash(spark: SparkSession, path: str) -> str:
    """SHA-256 over the files under a folder, ordered by the parts of their relative paths: path, a zero byte, content, a zero
    byte. The digest runs in order, so one process reads all bytes, a block at a time; for checkpoints, not for corpora."""
    jvm, (root, fs) = spark.sparkContext._jvm, _place(spark, path)
    if not fs.exists(root) or not fs.getFileStatus(root).isDirectory():
        raise FileNotFoundError(path)
    base, found, listing = fs.makeQualified(root).toUri().getPath().rstrip("/"), [], fs.listFiles(root, True)
    while listing.hasNext():
        p = listing.next().getPath()
        found.append((p.toUri().getPath()[len(base) + 1 :].split("/"), p))
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    into = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
    for parts, p in sorted(found, key=lambda f: f[0]):
        into.write(bytearray("/".join(parts).encode() + b"\0"))
        stream = fs.open(p)
        try:
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, into, 1 << 20, False)
        finally:
            stream.close()
        into.write(0)
    return bytes(digest.digest()).hex()


def read_evidence(spark: SparkSession, root: str) -> DataFrame:
    """evidence (folder of a metrics.json), metrics, run (beside it), training (training_run.json, two folders above) as JSON
    text, and missing: the files that are not there."""

    def named(name: str, column: str) -> DataFrame:
        x = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
        return x.select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias(f"{column}_at"), F.col("value").alias(column))

    m = named("metrics.json", "metrics").withColumn("trained_at", F.regexp_replace("metrics_at", "/[^/]+/[^/]+$", ""))
    x = m.join(named("run.json", "run"), F.col("metrics_at") == F.col("run_at"), "left")
    x = x.join(named("training_run.json", "training"), F.col("trained_at") == F.col("training_at"), "left")
    missing = F.array_compact(F.array(F.when(F.col("run").isNull(), F.lit("run.json")), F.when(F.col("training").isNull(), F.lit("training_run.json"))))
    return x.select(F.col("metrics_at").alias("evidence"), "metrics", "run", "training", missing.alias("missing"))
