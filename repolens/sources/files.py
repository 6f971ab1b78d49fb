"""Readers of source trees, Markdown, manifests and exported repository events; the snapshot sink of collections."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X
from ..operators import collections as C
from ..session import checkpoint


def walk(spark: SparkSession, root: str, project: str) -> DataFrame:
    """Files of a source tree a repository walk would take: (project_id, file_path, language, size, content).

    Names and sizes filter before contents are read. Bytes that aren't UTF-8 become U+FFFD. Directories to skip are judged
    below the root only.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file:")
    path = F.regexp_replace("path", r"^[a-z0-9]+:(?://[^/]*)?(?=/)", "")
    rel = F.substring(path, F.lit(len(base) + 2), F.length(path))
    return (
        raw.select(rel.alias("file_path"), F.col("length").alias("size"), "content").filter(X.is_walked("file_path", "size"))
        .select(F.lit(project).alias("project_id"), "file_path", X.language("file_path").alias("language"), "size", F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    )


def sorted_walk(files: DataFrame) -> DataFrame:
    """(project_id, file_path, place) of the files an index run takes, in the order of their paths. .tox is skipped like all directories that
    begin with a dot; repeated deliveries count once."""
    from pyspark.sql import Window as W

    taken = files.filter(X.is_walked("file_path", "size")).select("project_id", "file_path").distinct()
    return taken.withColumn("place", F.row_number().over(W.partitionBy("project_id").orderBy("file_path")))


def readable(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw(file_path, content binary) -> (file_path, content string, repaired) with bytes that aren't UTF-8 as U+FFFD, and the rejects
    (file_path, reason): files that could not be read, whose content is null."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    ok = raw.filter("content IS NOT NULL").select("file_path", text.alias("content"), (~F.is_valid_utf8(F.col("content").cast("string"))).alias("repaired"))
    return ok, raw.filter("content IS NULL").select("file_path", F.lit("unreadable").alias("reason"))


def markdown(spark: SparkSession, paths: str | list[str], required: bool = True) -> DataFrame:
    """(path, text) of whole Markdown files that aren't blank. A missing path is an error if required, else gives no rows."""
    try:
        df = spark.read.text(paths, wholetext=True)
        out = df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(X.strip("value") != "")
        return out
    except AnalysisException:
        if required:
            raise FileNotFoundError(str(paths)) from None
        return spark.createDataFrame([], "path string, text string")


#: Evaluation manifest: three lists of cases.
MANIFEST = """retrieval array<struct<query_id:string,query:string,project_id:string,expected_files:array<string>,expected_symbols:array<string>,expected_collection:string,tags:array<string>>>,
agent array<struct<query_id:string,query:string,project_id:string,must_contain:array<string>,must_not_contain:array<string>,min_confidence:double,max_latency_s:double,tags:array<string>>>,
wiki_quality array<struct<project_id:string,module_name:string,min_overall:double>>"""


def manifest(spark: SparkSession, path: str, kind: str = "retrieval") -> DataFrame:
    """Cases of one kind; none if the manifest is missing."""
    try:
        return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.inline(kind))
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST).select(F.inline(kind))


def module_tree(spark: SparkSession, text: str | None, project: str) -> DataFrame:
    """Stored module tree (JSON of name -> {path, components, children}) as rows (project_id, module, path, component_id); missing or
    broken JSON gives none. A tree is one small document of one project."""
    rows: list[tuple] = []

    def down(name: str, node: dict, above: list[str]) -> None:
        path = [*above, name]
        rows.extend((project, name, path, c) for c in node.get("components") or [None])
        for child, sub in (node.get("children") or {}).items():
            down(child, sub, path)

    try:
        tree = json.loads(text or "{}")
        for name, node in tree.items() if isinstance(tree, dict) else ():
            down(name, node, [])
    except (ValueError, AttributeError):
        rows = []
    return spark.createDataFrame(rows, "project_id string, module string, path array<string>, component_id string")


class ExportedEvents(DataSource):
    """Exports of a source-code host as JSON lines, a task a file: spark.read.format("scm_export").option("kind", ...).load(paths).

    kinds: issues (of the first `limit` entries of a file, those that are merge requests are dropped afterwards), pulls, comments (issue
    and review comments together; `system` marks notes the host wrote itself, which one host never tells), commits, diffs, contents.
    Paths are read with Spark's text reader by `exported`, which works with any file system.
    """

    FIELDS = {
        "issues": "number int, title string, description string, state string, author string, created_at string, web_url string",
        "pulls": "number int, title string, description string, state string, author string, source_branch string, target_branch string, created_at string, web_url string",
        "comments": "number int, author string, body string, created_at string, review boolean, system boolean",
        "diffs": "old_path string, new_path string, new_file boolean, renamed_file boolean, deleted_file boolean, diff string",
        "contents": "file_path string, ref string, content string",
        "commits": "sha string, message string, author_name string, author_email string, authored_date string, added array<string>, modified array<string>, removed array<string>",
    }

    @classmethod
    def name(cls) -> str:
        return "scm_export"

    def schema(self) -> str:
        return self.FIELDS[self.options.get("kind", "issues")]

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ExportReader(self.options, schema)


class _ExportReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.paths = [p for p in (options.get("paths") or options.get("path") or "").split(",") if p]
        self.kind, self.names = options.get("kind", "issues"), schema.fieldNames()
        self.limit = int(options["limit"]) if options.get("limit") else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in self.paths]

    def read(self, partition: InputPartition):
        with open(partition.value, encoding="utf-8", errors="replace") as f:
            yield from _records(f, self.kind, self.names, self.limit)


def _records(lines, kind: str, names: list[str], limit: int | None):
    """Rows of JSON lines; the limit counts entries before any are dropped."""
    n = 0
    for line in lines:
        if not line.strip():
            continue
        if limit is not None and n >= limit:
            return
        n += 1
        x = json.loads(line)
        if kind == "issues" and x.get("pull_request") is not None:
            continue
        user = x.get("user") or {}
        x.setdefault("author", user.get("login") if isinstance(user, dict) else user)
        x.setdefault("description", x.get("body"))
        x.setdefault("web_url", x.get("html_url"))
        if kind == "comments":
            x["review"] = bool(x.get("pull_request_review_id") or x.get("review"))
            x["system"] = bool(x.get("system"))
        yield tuple(x.get(n) for n in names)


def exported(spark: SparkSession, paths: str | list[str], kind: str = "issues", limit: int | None = None) -> DataFrame:
    """Rows of exports of a source-code host, from any file system Spark reads: a file is one row of text, so an export must fit one task."""
    from ..functions.batches import map_rows

    schema = ExportedEvents.FIELDS[kind]
    names = [f.split()[0] for f in schema.split(", ")]
    return map_rows(spark.read.text(paths, wholetext=True), lambda text: _records((text or "").split("\n"), kind, names, limit), schema)


def ordered_comments(comments: DataFrame) -> DataFrame:
    """Issue and review comments of a merge request in order of their creation, issue comments first where it is the same."""
    return comments.orderBy("created_at", "review")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


class Snapshot:
    """A keyed collection kept as a Parquet table partitioned by project. Changes rewrite the touched projects only."""

    def __init__(self, spark: SparkSession, path: str, key: str = "chunk_id", sort: str = "file_path", schema: str | None = None):
        self.spark, self.path, self.key, self.sort, self.schema = spark, path, key, sort, schema

    def create(self, schema: str) -> None:
        """Makes the table unless it is there; doing it again changes nothing. An empty table has no file that tells its
        columns, so the schema is kept (or given to the constructor)."""
        self.schema = schema
        if not self.exists():
            self.spark.createDataFrame([], schema).write.partitionBy("project_id").parquet(self.path)

    def exists(self) -> bool:
        return exists(self.spark, self.path)

    def read(self) -> DataFrame:
        reader = self.spark.read.schema(self.schema) if self.schema else self.spark.read
        return reader.parquet(self.path)

    def _write(self, df: DataFrame, projects: DataFrame) -> None:
        out = checkpoint(df)
        gone = [r.project_id for r in projects.join(out.select("project_id").distinct(), "project_id", "left_anti").collect()]
        out.sortWithinPartitions("project_id", self.sort).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(self.path)
        for p in gone:
            self.delete_project(p)

    def _touched(self, projects: DataFrame) -> DataFrame:
        return self.read().join(projects, "project_id", "left_semi")

    def upsert(self, new: DataFrame, *order: Column) -> None:
        projects = new.select("project_id").distinct()
        self._write(C.upsert(self._touched(projects), new, [self.key], *order), projects)

    def replace_files(self, touched: DataFrame, new: DataFrame) -> None:
        """Rows of touched(project_id, file_path) give way to new ones."""
        projects = touched.select("project_id").union(new.select("project_id")).distinct()
        self._write(C.replace(self._touched(projects), touched, new, ["project_id", "file_path"]), projects)

    def delete_files(self, touched: DataFrame) -> None:
        projects = touched.select("project_id").distinct()
        self._write(C.delete(self._touched(projects), touched, ["project_id", "file_path"]), projects)

    def delete_project(self, project: str) -> None:
        jvm = self.spark._jvm
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("project_id", project)
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def populated(self) -> bool:
        return self.exists() and not self.read().limit(1).isEmpty()
