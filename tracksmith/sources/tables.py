"""Sources and sinks: exact schemas, numbered and tolerant JSON lines, directories of JSON, tiered sinks, digests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.storagelevel import StorageLevel

from tracksmith.functions.expr import stable_key


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, rows: int | None = None) -> DataFrame:
    """A table whose columns and row count must be the expected ones."""
    df = spark.read.parquet(path)
    if columns is not None and df.columns != columns:
        raise ValueError(f"columns are {df.columns}, not {columns}")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows, not {rows}")
    return df


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; a temporary one only where none is set and all is one machine."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("a cluster needs a shared folder in spark.checkpoint.dir")
        base = tempfile.mkdtemp(prefix="tracksmith-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def refuses_overwrite(df: DataFrame, path: str) -> bool:
    """Whether a second write to a path that exists is refused."""
    try:
        write_parquet(df, path)
    except AnalysisException:
        return True
    return False


def best_checkpoint(spark: SparkSession, path: str, step: str, metric: str) -> DataFrame:
    """(step, n, metric): each checkpoint folder path/step=.. with its mean metric, and whether it is the best (least step on a tie)."""
    runs = spark.read.parquet(path).groupBy(step).agg(F.count("*").alias("n"), F.round(F.avg(metric), 9).alias(metric))
    best = F.max_by(step, F.struct(metric, -F.col(step))).over(Window.partitionBy(F.lit(1)))  # a row a checkpoint
    return runs.select(step, "n", metric, (F.col(step) == best).alias("best"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of non-empty lines; line numbers start at 1 in each file.

    A file is one split (wholetext), so that numbers need no shuffle; use files of a bounded size.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = raw.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "text"))
    return lines.where(F.trim("text") != "").select("file", (F.col("at") + 1).cast("long").alias("line"), "text")


def tolerant(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """lines with `record` and `problem`: invalid_json, record_not_mapping or null."""
    parsed = F.try_parse_json("text")
    kind = F.schema_of_variant(parsed)
    out = lines.withColumn("problem", F.when(parsed.isNull(), "invalid_json").when(~F.startswith(kind, F.lit("OBJECT")), "record_not_mapping"))
    return out.withColumn("record", F.when(F.col("problem").isNull(), F.from_json("text", schema)))


def json_directory(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """One JSON document a file; an id in two files is an error."""
    df = spark.read.schema(schema).option("multiLine", "true").json(path)
    twice = df.groupBy(key).count().where("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"{key} occurs in more than one file")
    return df


def discover(spark: SparkSession, path: str, glob: str, kinds: dict[str, str]) -> DataFrame:
    """(file, kind, formal) of files by name, without manifests and summaries; kinds: name pattern (LIKE) -> kind."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    name = F.element_at(F.split("file", "/"), -1)
    kind = F.coalesce(*[F.when(name.like(p), F.lit(k)) for p, k in kinds.items()], F.lit("other"))
    return files.where(~name.isin("manifest.json", "summary.json")).select("file", kind.alias("kind"), F.contains("file", F.lit("evaluation")).alias("formal")).orderBy("file")


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines with nulls kept; many part files, by the output committer."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """zstd Parquet; refuses to overwrite unless told to. The committer makes the result appear at once."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_tiers(df: DataFrame, path: str, tier: str, mode: str = "errorifexists") -> None:
    """One folder a tier, in one pass."""
    df.write.mode(mode).partitionBy(tier).option("compression", "zstd").parquet(path)


def write_collection(outcomes: DataFrame, attempts: DataFrame, paths: dict[str, str], tier: str, mode: str = "errorifexists") -> None:
    """JSON lines of gold and silver outcomes, of those with neither tier (rejected), and of all attempts (diagnostics).

    paths: a folder for each of the four names, all different (else ValueError). A null tier is rejected. The outcomes are kept
    for the three writes, so that they are worked out once; a folder that exists already stops with mode errorifexists.
    """
    names = ("gold", "silver", "rejected", "diagnostics")
    if set(paths) != set(names) or len({p.rstrip("/") for p in paths.values()}) != len(names):
        raise ValueError(f"{', '.join(names)} need a folder each")
    own = F.when(F.col(tier).isin("gold", "silver"), F.col(tier)).otherwise("rejected")
    kept = outcomes.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for name in names[:3]:
            kept.where(own == name).write.mode(mode).json(paths[name])
    finally:
        kept.unpersist()
    attempts.write.mode(mode).json(paths["diagnostics"])


def option_lists(options: DataFrame, by: list[str], kind: str, option: str, seed: str, most: dict[str, int], left_out: tuple[str, ...] = ("type", "reason")) -> DataFrame:
    """options in a shuffled order: `place` from 0 within `by`, without the columns `left_out` and the kind.

    Of a kind in `most` only so many stay. Both the choice and the order are by hash of seed and option, which no layout changes;
    the same option of another kind hashes apart. Ties (an option twice) keep both.
    """
    hashed = options.withColumn("__h", stable_key(seed, F.concat_ws("|", *[F.col(c).cast("string") for c in by], kind, F.col(option).cast("string"))))
    limit = F.lit(None).cast("int")
    for k, n in most.items():
        limit = F.when(F.col(kind) == k, n).otherwise(limit)
    nth = F.row_number().over(Window.partitionBy(*by, kind).orderBy("__h"))
    kept = hashed.withColumn("__n", nth).where(limit.isNull() | (F.col("__n") <= limit))
    placed = kept.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.sha2("__h", 256), "__n")) - 1)
    return placed.drop("__h", "__n", kind, *left_out)


def write_csv(df: DataFrame, path: str, flat: str | None = None, keys: list[str] | None = None) -> None:
    """CSV with a header; a map column becomes a column for each key."""
    if flat:
        df = df.select(*[c for c in df.columns if c != flat], *[F.col(flat)[k].alias(f"{flat}_{k}") for k in keys or []])
    df.write.mode("errorifexists").option("header", "true").csv(path)


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, bytes, sha256) of files, for a manifest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def contract(spark: SparkSession, path: str, expected: dict) -> DataFrame:
    """(name, value) of a JSON configuration, one object a file, which must be what the program expects; values as JSON.

    Key order doesn't matter, what is missing, too much or different is an error that names it.
    """
    import json

    given = json.loads(spark.read.text(path, wholetext=True).first()["value"])  # one small file
    if not isinstance(given, dict):
        raise ValueError("the configuration is no object")
    off = sorted(k for k in given.keys() | expected.keys() if k not in given or k not in expected or given[k] != expected[k])
    if off:
        raise ValueError(f"not as expected: {', '.join(off)}")
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True, separators=(",", ":"))) for k, v in sorted(given.items())], "name string, value string")


def last_wins(tables: list[DataFrame], key: str) -> DataFrame:
    """Union of tables; of a key in several, the row of the last table."""
    union = None
    for k, t in enumerate(tables):
        t = t.withColumn("__at", F.lit(k))
        union = t if union is None else union.unionByName(t)
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__at")))
    return union.withColumn("__n", first).where("__n = 1").drop("__n", "__at")


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """A small table as Markdown; more than `most` rows are an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    line = lambda cells: "| " + " | ".join(str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line("---" for _ in df.columns), *map(line, rows)]) + "\n"
