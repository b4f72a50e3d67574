"""Sources: Markdown trees, evaluation files, token artifacts, stored points and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import VERSION, ConfigError, DataError
from tessera.operators.evaluation import cases
from tessera.operators.indexing import ensure_empty, payload_violations

CASE_SCHEMA = "case_id string, query string, target_chunk_id string, relevant_chunks array<struct<chunk_id:string>>, stress_type string"
ENTRY_SCHEMA = "chunk_id string, tokens array<string>"


def markdown(spark: SparkSession, root: str) -> DataFrame:
    """path (below ``root``), text of all *.md files, whole, at any depth."""
    base = resolved(spark, root)
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    full = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    # Schemes write the authority in different ways; what counts is the path behind it.
    plain = F.regexp_replace(full, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    inside = F.when(F.startswith(plain, F.lit(base)), F.substr(plain, F.lit(len(base) + 1)))
    outside = F.raise_error(F.concat(F.lit(f"not inside {base}: "), plain))
    return files.select(F.coalesce(inside, outside).alias("path"), F.col("value").alias("text"))


def resolved(spark: SparkSession, root: str) -> str:
    """The absolute path of an existing folder, with a slash at its end and without scheme and authority."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(where):
        raise DataError(f"there is no folder {root}")
    return store.makeQualified(where).toUri().getPath().rstrip("/") + "/"


def evaluation_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSON-lines file of either form; blank lines are skipped, any defective case is an error."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", CASE_SCHEMA).alias("c")).select("c.*")
    found = cases(parsed)
    ensure_empty(found.filter("error IS NOT NULL").select("case_id", "error"), "defective cases")
    ensure_empty(found.groupBy("case_id").count().filter("count > 1"), "repeated case ids")
    if found.isEmpty():
        raise DataError("no evaluation cases")
    return found.drop("error")


def token_artifact(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """chunk_id, tokens of an artifact whose header has the ``expected`` values and the right count."""
    header = spark.read.json(f"{path}/header").first()
    if header is None:
        raise DataError("the artifact has no header")
    for name, value in expected.items():
        if name not in header or header[name] != value:
            raise DataError(f"the artifact's {name} is {header[name] if name in header else None!r}, not {value!r}")
    entries = spark.read.schema(ENTRY_SCHEMA).json(f"{path}/entries")
    ensure_empty(entries.filter("chunk_id IS NULL OR chunk_id = '' OR tokens IS NULL OR exists(tokens, t -> t IS NULL)"), "defective entries")
    ensure_empty(entries.groupBy("chunk_id").count().filter("count > 1"), "repeated chunk ids")
    if (n := entries.count()) != header["chunk_count"]:
        raise DataError(f"{n} entries instead of {header['chunk_count']}")
    return entries


def points(spark: SparkSession, path: str, version: str, *columns: str) -> DataFrame:
    """Points of one version, its partition alone; ``columns`` limits what is read."""
    if not VERSION.fullmatch(version):
        raise ConfigError("an index version is 64 lower-case hexadecimal digits")
    found = spark.read.parquet(path).filter(F.col("index_version") == version)
    return found.select(*columns) if columns else found


def by_ids(points: DataFrame, asked: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``points`` of the ids in ``asked`` (``key``, position), in that order; a repeated or unknown id is an error."""
    ensure_empty(asked.groupBy(key).count().filter("count > 1"), "ids asked for twice")
    found = asked.join(points, key, "left")
    ensure_empty(found.groupBy(key).count().filter("count > 1"), "repeated points")
    ensure_empty(asked.join(points, key, "left_anti").select(key), "ids without a point")
    return found.orderBy("position")


CHUNK = (
    "chunk_id string, document_id string, section_id string, parent_section_id string, source_path string, chunk_order int,"
    " heading_path array<struct<level:int,text:string,line:int>>, text string, line_start int, line_end int, token_count int, index_version string"
)


def typed(points: DataFrame, dimensions: int, version: str) -> DataFrame:
    """Stored points as chunks with the types of ``CHUNK``, after the checks that a search relies on."""
    ensure_empty(payload_violations(points, dimensions, version), "unusable points")
    return points.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(CHUNK)])
