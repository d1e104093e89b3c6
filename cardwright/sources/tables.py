"""Sources and sinks of cards, vectors, pictures, answers and registries. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

CSV = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "multiLine": "true", "escape": '"', "quote": '"', "encoding": "UTF-8"}
TEXTS = ("name", "description", "category")
PICTURES = ("jpg", "jpeg", "png", "webp")


def read_cards(spark: SparkSession, path: str, label: bool = True) -> DataFrame:
    """id, name, description, category, label of CSV cards. All columns are read as strings by the file's own header;
    unnamed ones are left out, null texts are empty."""
    names = spark.read.options(**{**CSV, "multiLine": "false"}).csv(path).columns  # the header line alone is parsed
    schema = StructType([StructField(c, StringType()) for c in names])
    rows = spark.read.options(**CSV, enforceSchema="true", emptyValue="", nullValue="\0").schema(schema).csv(path)
    rows = rows.select(*[c for c in names if not c.startswith("Unnamed") and not c.startswith("_c")])
    out = [F.col("id").cast("string").alias("id"), *[F.coalesce(c, F.lit("")).alias(c) for c in TEXTS]]
    return rows.select(*out, *([F.col("label").try_cast("int").alias("label")] if label and "label" in names else []))


def write_table(df: DataFrame, path: str, compression: str = "none") -> str:
    """df as CSV with a header, of one format with what is read here; the path."""
    df.write.mode("overwrite").options(header="true", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", escape='"', quoteAll="true", compression=compression, nullValue="", emptyValue="").csv(path)
    return path


def read_known(spark: SparkSession, path: str) -> DataFrame:
    """The table of known duplicates: kind, key, label, n, category. Files may be gzipped; keys stay strings."""
    return spark.read.options(**CSV).schema("kind string, key string, label double, n long, category string").csv(path)


def aligned_vectors(ids: DataFrame, vectors: DataFrame, width: int) -> DataFrame:
    """ids (column id) with a vector for each: zeros where vectors (id, vector) has none."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), width)
    return ids.join(vectors.select("id", "vector"), "id", "left").withColumn("vector", F.coalesce("vector", zero))


def pictures_of(files: DataFrame) -> DataFrame:
    """id, files: of a table of paths, the pictures of each card in order of (length of the stem, stem). A picture lies in
    its card's folder, or is called id_number."""
    name = F.element_at(F.split("path", "/"), -1)
    stem, kind = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    folder = F.element_at(F.split("path", "/"), -2)
    flat = F.regexp_extract(stem, r"^(.+)_\d+$", 1)
    rows = files.select("path", stem.alias("stem"), kind.alias("kind"), F.when((folder == "images") & (flat != ""), flat).otherwise(folder).alias("id"))
    rows = rows.where(F.col("kind").isin(*PICTURES))
    ordered = F.array_sort(F.collect_list(F.struct(F.length("stem").alias("n"), "stem", "path")))  # a card has a few pictures
    return rows.groupBy("id").agg(F.transform(ordered, lambda x: x["path"]).alias("files"))


def list_pictures(spark: SparkSession, root: str) -> DataFrame:
    """pictures_of() the files below a folder; their content isn't read."""
    return pictures_of(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))


def incremental(done: DataFrame, wanted: DataFrame, made) -> DataFrame:
    """done and made(what is wanted and not yet done): one row per id, that which was there first."""
    fresh = made(wanted.join(done.select("id").distinct(), "id", "left_anti"))
    both = done.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("id", "_new")]
    first = both.groupBy("id").agg(F.min(F.struct("_new", *rest)).alias("_m"))
    return first.select("id", *[f"_m.{c}" for c in rest])


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of the rows of equal keys the first by order, whole."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_m"))
    return picked.select(*keys, *[F.col(f"_m._row.{c}").alias(c) for c in rest]).select(*df.columns)


def all_columns(*frames: DataFrame, fill: str = "") -> DataFrame:
    """All rows under the union of the columns, as strings, with fill for what a frame lacks."""
    texts = [df.select(*[F.col(c).cast("string").alias(c) for c in df.columns]) for df in frames]
    out = texts[0]
    for df in texts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out.na.fill(fill)


def upserted(old: DataFrame, new: DataFrame, key: str, manual: list[str]) -> DataFrame:
    """A registry (all strings) after an update: rows only old has stay, computed columns are new, manual ones keep what was
    filled in by hand."""
    names = list(dict.fromkeys([*new.columns, *manual, *old.columns]))
    a, b = (df.select(F.col(key), F.struct(*[F.col(c).cast("string").alias(c) for c in df.columns]).alias(side)) for df, side in ((old, "_old"), (new, "_new")))
    both = a.join(b, key, "full")

    def value(c: str) -> Column:
        was = F.col(f"_old.{c}") if c in old.columns else F.lit(None)
        now = F.col(f"_new.{c}") if c in new.columns else F.lit(None)
        if c in manual:
            return F.coalesce(F.when(F.trim(was) != "", was), now, F.lit(""))
        return F.coalesce(F.when(F.col("_new").isNotNull(), now).otherwise(was), F.lit(""))

    return both.select(key, *[value(c).alias(c) for c in names if c != key])


def questions(lines: DataFrame) -> DataFrame:
    """key, question of lines (column value) of the form key|question; blank lines and comments are skipped."""
    line = F.trim("value")
    parts = F.split(line, r"\|", 2)
    return lines.where((line != "") & ~line.startswith("#") & F.contains(line, F.lit("|"))).select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("question"))


ANSWER = "(?s)^<комментарий>(.*)<вердикт>(.*)$"
VERDICTS = ("бан", "не бан")


def faults(answers: DataFrame, expected: DataFrame, least: int = 50, most: int = 300) -> DataFrame:
    """One row with the number of each fault of answers (id, result): repeated ids, null results, ids that are missing or
    not expected, results of another form, other verdicts, comments out of bounds."""
    by_id = answers.groupBy("id").agg(F.count("*").alias("n")).join(expected.select("id").distinct().withColumn("_want", F.lit(1)), "id", "full")
    ids = by_id.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("n_duplicate"), F.count_if(F.col("n").isNull()).alias("n_missing"), F.count_if(F.col("_want").isNull()).alias("n_extra"))
    text = F.coalesce("result", F.lit(""))
    formed, said, size = text.rlike(ANSWER), F.regexp_extract(text, ANSWER, 2), F.length(F.regexp_extract(text, ANSWER, 1))
    rows = answers.agg(F.count_if(F.col("result").isNull()).alias("n_null"), F.count_if(~formed).alias("n_shape"), F.count_if(formed & ~said.isin(*VERDICTS)).alias("n_verdict"), F.count_if(formed & ~size.between(least, most)).alias("n_length"))
    return rows.join(F.broadcast(ids))  # a row each


def write_answers(answers: DataFrame, expected: DataFrame, path: str) -> str:
    """Write id, result as CSV, or raise an error that names the faults."""
    if answers.columns != ["id", "result"]:
        raise ValueError(f"columns must be id, result, not {answers.columns}")
    wrong = {k: n for k, n in faults(answers, expected).first().asDict().items() if n}
    if wrong:
        raise ValueError(f"answers with faults: {wrong}")
    return write_table(answers, path)
