"""Scans of text corpora, and sinks."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import safe_filename, safe_path


def scratch(spark: SparkSession) -> str:
    """A new folder that all machines see, deleted when the application ends: below ``spark.checkpoint.dir``, or on one machine a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="quernel-")
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    path = f"{root.rstrip('/')}/quernel-{uuid.uuid4().hex}"
    atexit.register(remove_at_end, spark, path)
    return path


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder when the application ends, if its session is still there."""
    if spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scan_markdown(spark: SparkSession, root: str, subdirs: list[str] = ()) -> DataFrame:
    """(path, name, dir, text, modified, bytes) of the Markdown files below ``root``, in one listing; only the whitelisted folders if any are named."""
    rows = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(root)
        .select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.element_at(F.split("path", "/"), -2).alias("dir"), F.col("content").cast("string").alias("text"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))
    )
    return rows.where(F.col("dir").isin(list(subdirs))) if subdirs else rows


#: Rows that the bounds of ranges are taken from, whatever the table.
BOUND_SAMPLE = 10_000


def running_sum(rows: DataFrame, order: str, value: Column, out_col: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to and including each one, in the order of a column without nulls.

    Rows are dealt out by ranges, whose bounds come from a bounded sample (the values with the least hashes); the ranges'
    totals, a row each, give the offsets, so that no task sees all rows. Rows of one place in the order are summed one
    after another, in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = [r[0] for r in rows.select(order).distinct().orderBy(F.xxhash64(order)).limit(BOUND_SAMPLE).orderBy(order).collect()]
    bounds = sorted({len(sample) * i // n for i in range(1, n)} - {0})
    part = F.size(F.filter(F.array(*(F.lit(sample[i]) for i in bounds)), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    parts = rows.withColumn("_value", value).withColumn("_part", part)
    totals = parts.groupBy("_part").agg(F.sum("_value").alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    own = F.sum("_value").over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_own", own).join(F.broadcast(base), "_part").withColumn(out_col, F.col("_base") + F.col("_own")).drop("_part", "_value", "_own", "_base")


def in_corpus_order(files: DataFrame, order: str = "path") -> DataFrame:
    """Adds ``seq``, the place in path order: the tie-breaker of retrieval."""
    return running_sum(files, order, F.lit(1).cast("long"), "seq")


def scan_raw(spark: SparkSession, root: str) -> DataFrame:
    """(path, ext, content, bytes) of html, txt, md and pdf files, in that order, then by path; README files are left out."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{html,txt,md,pdf}").load(root)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    rank = F.array_position(F.array(*map(F.lit, ("html", "txt", "md", "pdf"))), ext)
    return rows.where(~F.element_at(F.split("path", "/"), -1).rlike("(?i)^readme\\.")).select("path", ext.alias("ext"), "content", F.col("length").alias("bytes")).orderBy(rank, "path")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, last, line) of text files: lines numbered from 0 in each file, split and read by many tasks.

    A split's lines are numbered in its task; the counts of the splits, a row each, give the offsets.
    """
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    lines = spark.read.text(path).select(*where, F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    by = Window.partitionBy("file", "start")
    lines = lines.withColumn("n", F.row_number().over(by.orderBy("at")) - 1)
    counts = lines.groupBy("file", "start").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("all", F.sum("rows").over(Window.partitionBy("file"))).drop("rows")
    no = F.col("base") + F.col("n")
    return lines.join(base, ["file", "start"]).select("file", no.alias("line_no"), (no == F.col("all") - 1).alias("last"), "line")


def scan_jsonl(spark: SparkSession, path: str, schema: str, torn_tail: bool = False) -> DataFrame:
    """Rows of JSON lines with their ``line_no``. A bad line is an error, but for a torn last one of a file where that is allowed; blank lines are skipped."""
    rows = numbered_lines(spark, path).where("trim(line) <> ''")
    rows = rows.withColumn("j", F.from_json("line", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).withColumn("ok", F.expr("try_parse_json(line)").isNotNull())
    # a bad line that is not allowed stays, and fails where its fields are read
    error = F.raise_error(F.concat(F.lit("bad line "), F.col("line_no").cast("string")))
    kept = rows.where(F.col("ok") | ~(F.col("last") & F.lit(torn_tail))).withColumn("line_no", F.when(F.col("ok"), F.col("line_no").cast("int")).otherwise(error.cast("int")))
    return kept.select("line_no", "j.*")


def in_subdirs(files: DataFrame, subdirs: list[str]) -> DataFrame:
    """Files (with a relative ``path``) that lie in one of the whitelisted folders; those beside the folders are left out by that."""
    return files.where(F.split("path", "/")[0].isin(list(subdirs)) & (F.size(F.split("path", "/")) >= 2))


def read_file(files: DataFrame, path: str, roots: list[str]) -> DataFrame:
    """The file of a relative path below one of the roots; an unsafe or unknown path gives no row."""
    return files.where((F.col("path") == path) & safe_path("path", roots))


def count_tree(files: DataFrame, below: str = "") -> DataFrame:
    """(n): files below a folder, at any depth; an entry whose name begins with a dot, or that lies below one, is not counted."""
    root = below.rstrip("/") + "/" if below else ""
    return files.where(F.col("path").startswith(root)).agg(F.count_if(~F.substring("path", len(root) + 1, 1 << 30).rlike(r"(^|/)\.")).alias("n"))


def read_hot(spark: SparkSession, path: str) -> str:
    """The text of a small file that is read often; empty where it does not exist."""
    return "\n".join(r.line for r in numbered_lines(spark, path).orderBy("line_no").collect()) if exists(spark, path) else ""


#: Where an upload goes by its extension, and its most bytes (fixed values).
UPLOADS = {".md": "docs", ".html": "raw", ".txt": "raw", ".pdf": "raw"}
UPLOAD_BYTES = 10 * 1024 * 1024


def upload_outcome(files: DataFrame) -> DataFrame:
    """(name, status, reason, target) of uploads(name, bytes): unsafe names, other types and files over the cap are rejected, the rest is routed by type."""
    ext = F.lower(F.regexp_extract("name", r"^\.*[^.].*(\.[^.]+)$", 1))
    target = F.create_map(*(F.lit(x) for kv in UPLOADS.items() for x in kv))[ext]
    reason = F.when(~safe_filename("name"), "unsafe_name").when(target.isNull(), "unsupported_type").when(F.col("bytes") > UPLOAD_BYTES, "too_large")
    return files.select("name", F.when(reason.isNull(), "written").otherwise("rejected").alias("status"), reason.alias("reason"), F.when(reason.isNull(), target).alias("target"))


def tree(files: DataFrame, root: str, limit: int = 10_000) -> DataFrame:
    """(relpath, is_dir, bytes) in pre-order with parents first, hidden entries left out, ``limit`` rows, and whether it was cut."""
    rel = F.expr(f"substring(path, instr(path, '{root}') + {len(root) + 1})")
    rows = files.select(rel.alias("relpath"), F.col("bytes")).where(~F.col("relpath").rlike(r"(^|/)\."))
    parts = F.split("relpath", "/")
    dirs = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("d"), F.size(parts).alias("n")).where("n > 1")
    every = rows.select("relpath", F.lit(False).alias("is_dir"), "bytes").unionByName(dirs.select(F.col("d").alias("relpath"), F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("bytes")).distinct())
    cut = every.orderBy("relpath").limit(limit + 1)
    place = F.row_number().over(Window.orderBy("relpath"))
    return cut.withColumn("place", place).withColumn("truncated", F.max("place").over(Window.partitionBy(F.lit(1))) > limit).where(F.col("place") <= limit)


def stale(pages: DataFrame, index: DataFrame) -> DataFrame:
    """(stale): whether a page(modified) is newer than the index(modified), a table of one row or none; without pages never, without an index always."""
    newest, built = pages.agg(F.max("modified").alias("newest")), index.agg(F.max("modified").alias("built"))
    return newest.crossJoin(F.broadcast(built)).select((F.col("newest").isNotNull() & (F.col("built").isNull() | (F.col("newest") > F.col("built")))).alias("stale"))


def index_stale(pages: DataFrame, index_modified) -> bool:
    """``stale`` for a driver that knows when its index was built."""
    index = pages.sparkSession.createDataFrame([(index_modified,)] if index_modified is not None else [], "modified timestamp")
    return stale(pages, index).first().stale


def status(spark: SparkSession, path: str):
    """The file system's entry of a path, or none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getFileStatus(at) if fs.exists(at) else None


def stamp(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(time of change, files, bytes) of a path: what tells whether a table is still the one that was read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    sums = fs.getContentSummary(at)
    return fs.getFileStatus(at).getModificationTime(), sums.getFileCount(), sums.getLength()


def exists(spark: SparkSession, path: str) -> bool:
    return status(spark, path) is not None


class Loaded:
    """A table or index that a long-lived process holds, loaded anew only when the path's time of change has moved."""

    def __init__(self, spark: SparkSession, path: str, load: Callable[[str], object]):
        self.spark, self.path, self.load = spark, path, load
        self.seen: int | None = None
        self.value = None

    def reload_if_changed(self) -> bool:
        """Whether it was loaded just now; a path that does not exist leaves what is held."""
        now = status(self.spark, self.path)
        if now is None or now.getModificationTime() == self.seen:
            return False
        self.value = self.load(self.path)
        self.seen = now.getModificationTime()
        return True


def swap_in(df: DataFrame, path: str) -> None:
    """Write beside and move into place through Spark's file systems, so that readers see the old table or the new one."""
    new = f"{path}.new-{uuid.uuid4().hex}"
    df.write.parquet(new)
    move_in(df.sparkSession, new, path)


def move_in(spark: SparkSession, new: str, path: str) -> None:
    """Put a written folder in the place of another."""
    old = f"{path}.old-{uuid.uuid4().hex}"
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(new), at(path))
    fs.delete(at(old), True)


def append_capped(records: DataFrame, stored: int, cap: int = 1 << 20) -> DataFrame:
    """Records (with ``line``) that still fit below the cap of the store's bytes, in order of ``seq``."""
    return running_sum(records, "seq", (F.octet_length("line") + 1).cast("long"), "_sum").where(F.col("_sum") + stored <= cap).drop("_sum")


def append_new(rows: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not stored yet: appending them twice changes nothing."""
    return rows.dropDuplicates(key).join(stored.select(*key).distinct(), key, "left_anti")


def write_index(sections: DataFrame, terms: DataFrame, stats: DataFrame, path: str) -> None:
    """The retrieval index as tables: sections, terms in token order, one row of statistics."""
    sections.write.mode("overwrite").parquet(f"{path}/sections")
    terms.repartitionByRange("token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/terms")
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def indexed_sections(spark: SparkSession, path: str) -> int:
    """How many sections an index holds, by its row of statistics alone; 0 where there is none."""
    return spark.read.parquet(f"{path}/stats").first().n if exists(spark, f"{path}/stats") else 0


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{t}") for t in ("sections", "terms", "stats"))


def write_vectors(vectors: DataFrame, path: str, model: str, file_col: str | None = None) -> None:
    """A dense index: the vectors' table and one row of metadata (rows, files, model), written beside and moved into place."""
    spark = vectors.sparkSession
    new = f"{path}.parts-{uuid.uuid4().hex}"
    vectors.write.parquet(f"{new}/vectors")
    files = F.countDistinct(file_col) if file_col else F.lit(0).cast("long")
    meta = spark.read.parquet(f"{new}/vectors").agg(F.count("*").alias("rows"), files.alias("files")).withColumn("model", F.lit(model))
    meta.coalesce(1).write.parquet(f"{new}/metadata")
    move_in(spark, new, path)


def read_vectors(spark: SparkSession, path: str, model: str | None = None) -> tuple[DataFrame, dict] | None:
    """(vectors, metadata) of a dense index; none where there is none. An index without metadata, with other rows than
    these say, or of another model than asked for, is an error."""
    if not exists(spark, path):
        return None
    if not exists(spark, f"{path}/metadata"):
        raise ValueError(f"the index at {path} has no metadata")
    meta, vectors = spark.read.parquet(f"{path}/metadata").first().asDict(), spark.read.parquet(f"{path}/vectors")
    if vectors.count() != meta["rows"]:
        raise ValueError(f"the index at {path} does not hold the rows of its metadata")
    if model is not None and meta["model"] != model:
        raise ValueError(f"the index at {path} was built with {meta['model']}")
    return vectors, meta


#: Labels of a query set (fixed values).
SCENARIOS = ("factoid", "cross_doc", "version_conflict", "unanswerable")
OVERLAPS = ("high_overlap", "low_overlap")
LANGUAGES = ("en", "zh")
QUERY_SET = "query_id string, text string, scenario_stratum string, overlap_stratum string, language string, gold_section_ids array<string>, key_tokens array<string>, generating_family string, generation_notes string"
PARAPHRASES = "paraphrase_id string, paraphrase_type string, text string, gold_docs_section_id string, key_tokens_docs array<string>, key_tokens_wiki array<string>, generation_notes string"


def query_set(spark: SparkSession, text: str) -> DataFrame:
    """The validated queries of a YAML text (``queries``), in order: a missing field, an unknown label, an answerable query
    without a gold section or a gold section without key tokens is an error that names the query."""
    import yaml

    rows = []
    for entry in (yaml.safe_load(text) or {}).get("queries", []):
        missing = sorted({"query_id", "text", "scenario_stratum", "overlap_stratum", "language"} - entry.keys())
        if missing:
            raise ValueError(f"a query lacks {missing}: {entry.get('query_id')!r}")
        for field, known in (("scenario_stratum", SCENARIOS), ("overlap_stratum", OVERLAPS), ("language", LANGUAGES)):
            if entry[field] not in known:
                raise ValueError(f"query {entry['query_id']!r}: {field} is {entry[field]!r}, not one of {known}")
        gold, tokens = list(entry.get("gold_section_ids", [])), list(entry.get("key_tokens", []))
        if entry["scenario_stratum"] != "unanswerable" and not gold:
            raise ValueError(f"query {entry['query_id']!r}: no gold_section_ids")
        if gold and not tokens:
            raise ValueError(f"query {entry['query_id']!r}: no key_tokens")
        rows.append((entry["query_id"], entry["text"], entry["scenario_stratum"], entry["overlap_stratum"], entry["language"], gold, tokens, entry.get("generating_family", ""), entry.get("generation_notes", "")))
    return spark.createDataFrame(rows, QUERY_SET)


def paraphrase_set(spark: SparkSession, text: str) -> DataFrame:
    """The paraphrases of a YAML text (``paraphrases``), in order; a missing field is an error."""
    import yaml

    rows = []
    for entry in (yaml.safe_load(text) or {}).get("paraphrases", []):
        missing = sorted({"paraphrase_id", "paraphrase_type", "text", "gold_docs_section_id", "key_tokens_docs", "key_tokens_wiki"} - entry.keys())
        if missing:
            raise ValueError(f"a paraphrase lacks {missing}: {entry.get('paraphrase_id')!r}")
        rows.append((entry["paraphrase_id"], entry["paraphrase_type"], entry["text"], entry["gold_docs_section_id"], list(entry["key_tokens_docs"]), list(entry["key_tokens_wiki"]), entry.get("generation_notes", "")))
    return spark.createDataFrame(rows, PARAPHRASES)
