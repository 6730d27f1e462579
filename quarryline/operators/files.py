"""Line-wise reading and searching of files kept as rows (key, text)."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import lines, split_lines


def numbered(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, content), lines from 1."""
    return files.select(key, F.posexplode(lines(F.col(text))).alias("p", "content")).select(key, (F.col("p") + 1).alias("line"), "content")


def _holding(files: DataFrame, text: str, hit: str) -> DataFrame:
    """Files with a matching line: anchors hold at each line's ends."""
    return files.where(F.exists(lines(F.col(text)), lambda x: x.rlike(hit)))


def stripped(line: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def grep(files: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Lines that match, whatever the case. Files without a match yield no lines."""
    hit = "(?i)" + pattern
    return numbered(_holding(files, text, hit), key, text).where(F.col("content").rlike(hit)).withColumn("content", stripped(F.col("content")))


def matches(text: Column, pattern: str, around: int = 2) -> Column:
    """The lines that match as array of struct(line, content, context): context has the lines around, joined by line breaks."""
    hit, own = "(?i)" + pattern, lines(text)
    near = lambda i: F.array_join(F.slice(own, F.greatest(i + 1 - around, F.lit(1)), F.least(i, F.lit(around)) + around + 1), "\n")
    found = F.transform(own, lambda x, i: F.when(x.rlike(hit), F.struct((i + 1).alias("line"), stripped(x).alias("content"), near(i).alias("context"))))
    return F.filter(found, lambda x: x.isNotNull())


def grep_context(files: DataFrame, key: str, text: str, pattern: str, around: int = 2) -> DataFrame:
    """Matching lines with the lines around them. A line's neighbours are cut from its file's lines, so nothing is shuffled."""
    return files.select(key, F.explode(matches(F.col(text), pattern, around)).alias("m")).select(key, "m.line", "m.context")


# Extensions of the files that a project search reads.
SEARCHED = (
    ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".md", ".txt", ".html", ".css", ".scss",
    ".java", ".kt", ".go", ".rs", ".c", ".cpp", ".h", ".rb", ".php", ".swift", ".sql", ".sh", ".toml",
)


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM can compile the pattern."""
    try:
        spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except PySparkException:
        return False
    return True


def search_files(files: DataFrame, pattern: str, name_glob: str | None = None, most: int = 100, max_bytes: int = 1 << 20) -> DataFrame:
    """files (path, content) to the first ``most`` matches by path and line (path, line, content, context): no hidden names,
    no files over max_bytes. ValueError for a pattern that can't be compiled."""
    if not valid_pattern(files.sparkSession, "(?i)" + pattern):
        raise ValueError(f"Invalid regex pattern: {pattern}")
    name = P.name(F.col("path"))
    own = files.where(~name.startswith(".") & (F.octet_length(F.coalesce("content", F.lit(""))) <= max_bytes))
    own = own if name_glob is None else own.where(P.matches_any(name, [name_glob]))
    return own.select("path", F.explode(matches(F.col("content"), pattern)).alias("m")).select("path", "m.*").orderBy("path", "line").limit(most)


def search_project(files: DataFrame, pattern: str, name_glob: str | None = None, root: str = "", most: int = 100, cut: int = 200) -> DataFrame:
    """files (path, content) to the first ``most`` matches by path and line (path, line, content up to ``cut`` characters): of
    files with an extension of SEARCHED and no ignored part, below root if anything is. A pattern that can't be compiled is
    searched literally."""
    if not valid_pattern(files.sparkSession, "(?i)" + pattern):
        pattern = "\\Q" + pattern.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    name = P.name(F.col("path"))
    own = files.where(~P.ignored_any(F.col("path")) & F.lower(P.suffix(F.col("path"))).isin(*SEARCHED))
    own = own if name_glob is None else own.where(P.matches_any(name, [name_glob]))
    below = F.col("path").startswith(root.rstrip("/") + "/")
    if root.strip("./") and not files.where(below).isEmpty():
        own = own.where(below)
    return grep(own, "path", "content", pattern).select("path", "line", F.substring("content", 1, cut).alias("content")).orderBy("path", "line").limit(most)


def read_range(files: DataFrame, key: str, text: str, start: int, end: int) -> DataFrame:
    own = lines(F.col(text))
    part = F.slice(own, start, end - start + 1)
    return files.select(key, F.array_join(part, "\n").alias("content"), F.size(own).alias("total_lines"), F.size(part).alias("returned_lines"))


def prefixes(files: DataFrame, path: str, depth: int = 3) -> DataFrame:
    """(prefix, depth): distinct directories of the paths, down to depth."""
    parts = F.filter(F.split(F.col(path), "/"), lambda x: x != "")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    each = files.select(dirs.alias("d")).where("size(d) > 0").select("d", F.explode(F.sequence(F.lit(1), F.least(F.size("d"), F.lit(depth)))).alias("depth"))
    return each.select(F.array_join(F.expr("slice(d, 1, depth)"), "/").alias("prefix"), "depth").distinct()


def read_batch(wanted: DataFrame, files: DataFrame, missing: str = "File not found") -> DataFrame:
    """wanted (path) with content, lines, found and error of each file; a missing one has an error and no lines."""
    own = files.select("path", "content").where("content is not null")
    found = F.col("content").isNotNull()
    return wanted.join(own, "path", "left").select(
        "path", "content", F.when(found, F.size(lines(F.col("content")))).otherwise(0).alias("lines"), found.alias("found"), F.when(~found, F.lit(missing)).alias("error")
    )


# The most bytes and lines of a read, by tool, and the most paths of a batch.
TOOL_BYTES, TOOL_LINES = 10 * 1024 * 1024, 2000
PLAIN_BYTES, PLAIN_LINES = 100 * 1024, 500
MOST_PATHS = 10


def read(wanted: DataFrame, files: DataFrame, max_bytes: int = TOOL_BYTES, max_lines: int = TOOL_LINES, marker: str | None = None) -> DataFrame:
    """wanted (path, and start_line and end_line if lines are asked for: from 1, both included, null open) with content, total_lines, lines,
    truncated, size and error. Lines over max_lines are cut, and the marker, if any, follows. A missing file (or null content)
    and one over max_bytes have an error and its size, and null for the rest. Other columns of wanted stay."""
    ends = [F.col(c) if c in wanted.columns else F.lit(None).cast("int") for c in ("start_line", "end_line")]
    asked = wanted.select(*wanted.columns, *[c.alias(n) for c, n in zip(ends, ("_start", "_end"), strict=True)])
    have = files.where("content is not null").select("path", F.col("content").alias("_text"), F.octet_length("content").alias("_size"))
    both = asked.join(have, "path", "left")
    fits = F.col("_size") <= max_bytes
    both = both.withColumn("_all", F.when(fits, split_lines(F.col("_text")))).withColumn("_total", F.when(fits, F.size("_all")))
    # a start or end of 0 is as none; negative ones count from the end, as slices of a list do
    first = F.when(F.coalesce("_start", F.lit(0)) == 0, 1).otherwise(F.col("_start"))
    last = F.when(F.coalesce("_end", F.lit(0)) == 0, F.col("_total")).otherwise(F.col("_end"))
    low = F.when(first < 1, F.greatest(F.col("_total") + first - 1, F.lit(0))).otherwise(first - 1)
    high = F.when(last < 0, F.greatest(F.col("_total") + last, F.lit(0))).otherwise(last)
    both = both.withColumn("_part", F.when(fits, F.slice("_all", low + 1, F.greatest(high - low, F.lit(0)))))
    cut = fits & (F.size("_part") > max_lines)
    text = F.array_join(F.slice("_part", 1, max_lines), "\n")
    text = text if marker is None else F.when(cut, F.concat(text, F.lit(marker))).otherwise(text)
    error = F.when(F.col("_size").isNull(), F.concat(F.lit("File not found: "), F.coalesce("path", F.lit("")))).when(
        ~fits, F.concat(F.lit("File too large: "), F.col("_size").cast("string"), F.lit(f" bytes (max: {max_bytes})"))
    )
    return both.select(
        *wanted.columns, F.when(fits, text).alias("content"), F.col("_total").alias("total_lines"), F.when(fits, F.least(F.size("_part"), F.lit(max_lines))).alias("lines"),
        F.when(fits, cut).alias("truncated"), F.col("_size").alias("size"), error.alias("error"),
    )


def read_plain(wanted: DataFrame, files: DataFrame, max_lines: int = PLAIN_LINES) -> DataFrame:
    """As :func:`read`, with the smaller limits and a mark at a cut."""
    return read(wanted, files, PLAIN_BYTES, max_lines, "\n... (truncated)")


def read_batches(wanted: DataFrame, files: DataFrame, batch: str = "batch", most: int = MOST_PATHS) -> DataFrame:
    """wanted (batch, path) to a row a batch: files (array of path, content, lines, error in order of path; content '' and 0 lines
    with an error), count, successful, total_lines, error. A batch of more than ``most`` paths is not read: it has an error, its
    count, and null for the rest; its texts are never gathered."""
    n = wanted.groupBy(batch).agg(F.count(F.lit(1)).alias("count"))
    small = wanted.join(n.where(F.col("count") <= most), batch, "left_semi")
    each = read_plain(small.select(batch, "path"), files)
    one = F.struct("path", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("lines", F.lit(0)).alias("lines"), "error")
    done = each.groupBy(batch).agg(F.array_sort(F.collect_list(one)).alias("files"), F.count_if(F.col("error").isNull()).alias("successful"), F.sum(F.coalesce("lines", F.lit(0))).alias("total_lines"))
    error = F.when(F.col("count") > most, f"Maximum {most} files per batch")
    return n.join(done, batch, "left").select(batch, "files", "count", "successful", "total_lines", error.alias("error"))


def validate_structure(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(path, found) of the expected paths, each once."""
    once, have = wanted.select("path").distinct(), files.select("path").distinct().withColumn("found", F.lit(True))
    return once.join(have, "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("found"))
