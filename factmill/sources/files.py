"""Source trees and compile databases as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import is_ignored, is_source, relativize


def scan(spark: SparkSession, root: str, language: str = "java") -> DataFrame:
    """(path, checksum, content, size, mtime, issue) of the source files under ``root``, by relative path.

    Paths are tested below the root only. Content that is not UTF-8 is null, with an issue, and the others are read.
    """
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    whole = F.lit(fs.makeQualified(base).toString().rstrip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.withColumn("path", relativize(F.regexp_replace("path", "^file:/+", "file:/"), F.regexp_replace(whole, "^file:/+", "file:/")))
    files = files.filter(is_source(F.col("path"), language) & ~is_ignored(F.col("path")))
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    return files.select(
        "path", F.sha2("content", 256).alias("checksum"), F.when(valid, F.decode("content", "UTF-8")).alias("content"), F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime"), F.when(~valid, "FILE.ENCODING").alias("issue"),
    )


def compile_commands(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """(path, arguments) of a compile database, for the files that an entry names by equality or as its end."""
    db = spark.read.option("multiLine", True).schema("file string, directory string, arguments array<string>, command string").json(path)
    given = F.coalesce("arguments", F.split("command", r"\s+"))
    entries = db.select(F.element_at(F.split("file", "/"), -1).alias("name"), F.col("file").alias("entry"), given.alias("arguments"))
    asked = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"))
    found = asked.join(entries, "name").filter((F.col("entry") == F.col("path")) | F.endswith("entry", F.concat(F.lit("/"), "path")))
    return found.groupBy("path").agg(F.min_by("arguments", "entry").alias("arguments"))


def clean_arguments(arguments, path):
    """Arguments without the compiler, `-c`, the source and `-o X`."""
    rest = F.slice(arguments, 2, F.greatest(F.size(arguments) - 1, F.lit(0)))
    kept = F.filter(rest, lambda x, i: (x != "-c") & (x != "-o") & ~(F.coalesce(F.get(rest, i - 1), F.lit("")) == "-o") & (x != path) & ~F.endswith(x, F.concat(F.lit("/"), path)))
    return kept


def response_tables(responses: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and issues of parser answers in JSON, exploded from their files."""
    entity = "struct<id:string,type:string,name:string,qualifiedName:string,signature:string,language:string>"
    relation = "struct<id:string,type:string,sourceId:string,targetId:string,externalTarget:string>"
    issue = "struct<severity:string,code:string,message:string>"
    schema = f"files array<struct<path:string,entities:array<{entity}>,relations:array<{relation}>,issues:array<{issue}>>>"
    files = responses.select(F.explode(F.from_json(column, schema)["files"]).alias("f")).select("f.*")
    of = lambda c: files.select("path", F.explode(c).alias("x")).select("path", "x.*")
    return of("entities"), of("relations"), of("issues")


def imported(spark: SparkSession, files: list[tuple[str, str | None]]) -> DataFrame:
    """A handful of sources as a table of files, for tests and small runs."""
    return spark.createDataFrame(files, "path string, content string").withColumn("checksum", F.sha2("content", 256))


# Folders that hold sources by convention, in order, and those that builds compile to.
STANDARD_ROOTS = ("src/main/java", "src/test/java", "src", "java")
BUILT = {"maven": ("target/classes", "target/test-classes"), "gradle": ("build/classes/java/main", "build/classes/java/test")}


def source_roots(files: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """(place, root): where sources are looked for, each root once at its first place.

    First the ``configured`` ones (place, root) in their order, then the conventional folders that hold a file; if there
    are none, the first folder of the least path that has one, and else the whole tree (an empty root).
    """
    spark = files.sparkSession
    standard = spark.createDataFrame([(10**9 + i, r) for i, r in enumerate(STANDARD_ROOTS)], "place long, root string")
    held = files.agg(*(F.coalesce(F.bool_or(F.startswith("path", F.lit(f"{r}/"))), F.lit(False)).alias(r) for r in STANDARD_ROOTS))
    held = held.select(F.explode(F.create_map(*(x for r in STANDARD_ROOTS for x in (F.lit(r), F.col(f"`{r}`"))))).alias("root", "there"))
    found = standard.join(held.filter("there").select("root"), "root").select("place", "root")
    if configured is not None:
        found = configured.filter("root <> ''").select(F.col("place").cast("long").alias("place"), "root").unionByName(found)
    first = files.agg(F.min(F.when(F.contains("path", F.lit("/")), F.col("path"))).alias("path"))
    last = first.select(F.lit(2 * 10**9).cast("long").alias("place"), F.coalesce(F.substring_index("path", "/", 1), F.lit("")).alias("root"))
    found = found.unionByName(last.join(found.limit(1).select(F.lit(True).alias("some")), F.lit(True), "left_anti"))
    once = found.groupBy("root").agg(F.min("place").alias("place"))
    return once.select((F.row_number().over(Window.orderBy("place")) - 1).alias("place"), "root")  # a few rows


def class_path(spark: SparkSession, root: str, strategy: str | None = None, manual: tuple[str, ...] = ()) -> list[str]:
    """Folders of compiled classes under ``root``: those that the build tool makes, if they are there, then the ``manual`` ones."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    built = [f"{root}/{x}" for x in BUILT.get((strategy or "").lower(), ()) if fs.exists(path(f"{root}/{x}"))]
    return list(dict.fromkeys([*built, *(f"{root}/{x}" for x in manual if x)]))
