"""Tables and scripts of users: checked readers, guarded CSV and JSON writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

# What the formats are called, and the caps of a table.
SEPARATORS = {"csv": ",", "tsv": "\t"}
CAPS = {"rows": 5_000, "columns": 128, "cell_chars": 512, "file_bytes": 10 * 2**20, "cell_bytes": 2 * 2**20}

# Signs at which a spreadsheet takes a text for a formula.
FORMULA_STARTS = r"^[=+\-@\t\r']"

# Heads of a journal directory's main parts.
MAJOR_FIELDS = ("Health Sciences", "Life Sciences", "Physical Sciences", "Social Sciences", "Arts & Humanities", "Engineering & Technology", "Environmental Sciences", "Business & Economics")


class Refused(ValueError):
    """A table that is not read; code says why."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def read_table(spark: SparkSession, path: str, caps: dict[str, int] | None = None) -> DataFrame:
    """A CSV or TSV file with a header as strings; caps, where given, refuse what goes beyond them."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in SEPARATORS:
        raise Refused("unsupported_format")
    try:
        size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    except AnalysisException as error:
        raise Refused("not_readable") from error
    if caps and size and size > caps["file_bytes"]:
        raise Refused("file_too_large")
    df = spark.read.csv(path, sep=SEPARATORS[kind], header=True, inferSchema=False, multiLine=True, escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not df.columns:
        raise Refused("no_table")
    if any(not c.strip() for c in df.columns):
        raise Refused("no_columns")
    if caps:
        if len(df.columns) > caps["columns"]:
            raise Refused("too_wide")
        cells = [F.col(f"`{c}`") for c in df.columns]
        wrong, most, n = df.limit(caps["rows"] + 1).agg(F.bool_or(F.concat_ws("", *cells).contains("\ufffd")), F.max(F.greatest(*(F.coalesce(F.octet_length(c), F.lit(0)) for c in (*cells, F.lit(""))))), F.count("*")).first()
        if wrong or any("\ufffd" in c for c in df.columns):
            raise Refused("encoding_not_utf8")
        if n > caps["rows"]:
            raise Refused("too_large")
        if (most or 0) > caps["cell_bytes"]:
            raise Refused("content_too_large")
        df = df.select(*(F.substring(c, 1, caps["cell_chars"]).alias(name) for c, name in zip(cells, df.columns, strict=True)))
    return df


def guarded(field: Column) -> Column:
    """A quoted CSV field that no spreadsheet takes for a formula."""
    text = F.coalesce(field, F.lit(""))
    text = F.when(text.rlike(FORMULA_STARTS), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def printed(value: Column) -> Column:
    """A number in its shortest form: 41, not 41.0; empty for null."""
    text = value.cast("string")
    return F.coalesce(F.regexp_replace(text, r"\.0$", ""), F.lit(""))


def summary_lines(summary: DataFrame) -> DataFrame:
    """The lines of a summary's CSV (alias, column, kind, statistic, level, value, note) in order, from the frames of
    plumbline.operators.stats.numeric_summary with an alias."""
    stats = ("n", "missing", "mean", "sd", "min", "q1", "median", "q3", "max")
    rows = summary.select("alias", "column", "reason", F.posexplode(F.array(*(F.struct(F.lit(s).alias("statistic"), printed(F.col(s)).alias("value")) for s in stats))).alias("at", "s"))
    note = F.when(F.col("s.value") == "", F.col("reason"))
    line = F.concat_ws(",", guarded(F.col("alias")), guarded(F.col("column")), guarded(F.lit("numeric")), guarded(F.col("s.statistic")), guarded(F.lit("")), F.col("s.value"), guarded(note))
    return rows.select("column", "at", line.alias("line"))


def write_lines(lines: DataFrame, path: str, header: str | None = None) -> None:
    """A text column as files with CRLF line ends."""
    if header:
        lines = lines.sparkSession.createDataFrame([(header,)], "line string").unionByName(lines.select("line"))
    lines.select("line").write.text(path, lineSep="\r\n")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def manifest(**parts: Column) -> Column:
    """A run's manifest as JSON, names in order."""
    return F.to_json(F.struct(*(parts[k].alias(k) for k in sorted(parts))))


def extraction_rows(extractions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """extractions (doc_id, statistics array<string>, refs array<struct<text, doi>>) as JSON rows, and as findings: an
    info for each statistic, a warning for each reference without a DOI."""
    stored = extractions.select("doc_id", F.lit("extraction").alias("kind"), F.to_json(F.struct("statistics", "refs")).alias("content"))
    info = F.transform("statistics", lambda s: F.struct(F.lit("info").alias("severity"), F.lit("statistic").alias("category"), s.alias("message")))
    warn = F.transform(F.filter("refs", lambda r: F.coalesce(r["doi"], F.lit("")) == ""), lambda r: F.struct(F.lit("warning").alias("severity"), F.lit("reference").alias("category"), r["text"].alias("message")))
    return stored, extractions.select("doc_id", F.inline(F.concat(info, warn)))


def script_outcomes(files: DataFrame) -> DataFrame:
    """files (path, text) of analysis scripts with kind, outcome (parsed, stored or rejected) and reason."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    reason = F.when(~kind.isin("sps", "jnl", "py", "r", "ipynb", "csv"), "unsupported_format").when(F.length("text") > 8 * 2**20, "too_large").when(F.coalesce("text", F.lit("")).rlike(r"^\s*$"), "empty")
    return files.select("path", kind.alias("kind"), F.when(reason.isNotNull(), "rejected").when(kind.isin("sps", "jnl"), "parsed").otherwise("stored").alias("outcome"), reason.alias("reason"))


def syntax_procedures(scripts: DataFrame) -> DataFrame:
    """scripts (path, text) of SPSS syntax: path, nth, kind (its first words, in capitals) and subcommands (name, value)
    of each command, which ends with a stop at a line's end or a blank line; comments are dropped."""
    text = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"(?m)^\s*\*.*?(\.\s*$|\z)|/\*.*?(\*/|$)", "")
    commands = F.filter(F.transform(F.split(text, r"\.[ \t]*(?:\n|\z)|\n[ \t]*\n"), lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), lambda c: c != "")
    rows = scripts.select("path", F.posexplode(commands).alias("nth", "command"))
    subs = F.transform(F.slice(F.split("command", r"\s/"), 2, 1_000_000), lambda s: F.struct(F.upper(F.regexp_extract(s, r"^\s*([A-Za-z]\w*)", 1)).alias("name"), F.trim(F.regexp_replace(s, r"^\s*[A-Za-z]\w*\s*=?\s*", "")).alias("value")))
    return rows.select("path", "nth", F.upper(F.regexp_extract("command", r"^([A-Za-z][A-Za-z-]*(?: [A-Za-z-]+)?)", 1)).alias("kind"), subs.alias("subcommands"))


def journal_directory(lines: DataFrame) -> DataFrame:
    """lines (file, at, line) of journal directories: title, category, issn_line, quartile, publisher and website of
    each entry. A line "ISSN:" makes an entry; its title is the last full line before, its category the last main head,
    and its details stand in the eleven lines after it, up to the next entry."""
    w = W.partitionBy("file").orderBy("at")
    t = F.trim("line")
    rows = lines.select("file", "at", t.alias("line"))
    rows = rows.withColumn("category", F.last(F.when(F.col("line").isin(*MAJOR_FIELDS), F.col("line")), ignorenulls=True).over(w))
    rows = rows.withColumn("title", F.last(F.when(F.col("line") != "", F.col("line")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("after", F.collect_list("line").over(w.rowsBetween(1, 11)))
    next_issn = F.array_position(F.transform("after", lambda x: x.startswith("ISSN:")), True).cast("int")
    own = F.when(next_issn > 0, F.slice("after", 1, next_issn - 1)).otherwise(F.col("after"))
    detail = lambda name: F.coalesce(F.trim(F.regexp_replace(F.try_element_at(F.filter(own, lambda x: x.startswith(f"{name}:")), F.lit(-1)), rf"(?i)^{name}:\s*", "")), F.lit(""))
    good = F.col("line").startswith("ISSN:") & F.col("title").isNotNull() & ~F.col("title").rlike(r"(?i)^ISSN:|^Publisher:|^Table of Contents|^Last Updated|^Verified and") & (F.length("title") <= 130)
    return rows.where(good).select("file", "at", "title", F.coalesce("category", F.lit("General")).alias("category"), F.col("line").alias("issn_line"), F.trim(F.regexp_extract("line", r"(?i)Quartile:\s*([^|]+)", 1)).alias("quartile"), detail("Publisher").alias("publisher"), detail("Website").alias("website"))


#: The columns of a t-test's CSV, and the statistics in their order.
T_TEST_HEADER = ("statistic", "group", "label", "value", "note")
T_TEST_STATISTICS = ("t", "df", "p", "mean_difference", "standard_error", "confidence_level", "ci_lower", "ci_upper", "cohens_d", "d_standardizer", "sd_ratio")


def t_test_lines(result: DataFrame, excluded: DataFrame | None = None, limitations: DataFrame | None = None) -> DataFrame:
    """nth and line of a t-test's CSV: the variant, its statistics, both groups, exclusions (code, n) and limitations
    (code). result: one row with variant, T_TEST_STATISTICS, standardizer, and level, n, mean and sd of each group as
    level1, n1 and so on. What could not be computed has an empty value; labels and codes are quoted, numbers are not."""
    def line(statistic: Column, group: Column, label: Column, value: Column, note: Column) -> Column:
        return F.concat_ws(",", guarded(statistic), guarded(group), guarded(label), value, guarded(note))

    empty = F.lit("")
    rows = [line(F.lit("variant"), empty, empty, empty, F.col("variant"))]
    for s in T_TEST_STATISTICS:
        note = F.col("standardizer") if s in ("cohens_d", "d_standardizer") else F.when(F.col("sd_ratio").isNull(), "not_computable") if s == "sd_ratio" else empty
        rows.append(line(F.lit(s), empty, empty, printed(F.col(s)), F.coalesce(note, empty)))
    for k in (1, 2):
        for s, value in (("level_index", F.lit(str(k - 1))), ("n", printed(F.col(f"n{k}"))), ("mean", printed(F.col(f"mean{k}"))), ("sd", printed(F.col(f"sd{k}")))):
            rows.append(line(F.lit(s), F.lit(str(k)), F.col(f"level{k}"), value, empty))
    out = result.select(F.posexplode(F.array(*rows)).alias("nth", "line"))
    for at, frame, make in ((1000, excluded, lambda: line(F.lit("excluded"), empty, empty, F.col("n").cast("string"), F.col("code"))), (2000, limitations, lambda: line(F.lit("limitation"), empty, empty, empty, F.col("code")))):
        if frame is not None:
            order = F.row_number().over(W.orderBy("code"))  # a few codes
            out = out.unionByName(frame.select((order + at).alias("nth"), make().alias("line")))
    return out


def run_manifest(outputs: DataFrame, settings: Column, codes: DataFrame, engine: str) -> DataFrame:
    """manifest: one JSON text on a run. outputs (name, line, nth) are hashed in their order and counted; codes (code) are
    listed distinct and sorted; settings is a struct. Names are in code-point order, so equal runs give equal bytes."""
    lines = outputs.groupBy("name").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line")).alias("bytes"), F.array_sort(F.collect_list(F.struct("nth", F.sha2(F.col("line").cast("binary"), 256).alias("h")))).alias("hashes"))
    files = lines.select(F.struct("bytes", "lines", "name", F.sha2(F.array_join(F.transform("hashes", lambda x: x["h"]), "\n").cast("binary"), 256).alias("sha256")).alias("f")).agg(F.sort_array(F.collect_list(F.struct("f.name", "f"))).alias("files"))
    listed = codes.agg(F.sort_array(F.collect_set("code")).alias("codes"))
    body = F.struct("codes", F.lit(engine).alias("engine"), F.transform("files", lambda x: x["f"]).alias("outputs"), settings.alias("settings"))
    return files.crossJoin(listed).select(F.to_json(body).alias("manifest"))  # one row each
