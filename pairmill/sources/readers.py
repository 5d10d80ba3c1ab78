"""Readers: files of every kind into DataFrames with stated schemas."""

from __future__ import annotations

import hashlib
import io
import json
import tarfile
import zipfile
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIR = "anchor string, positive string, negative string"
CORPUS = "_id string, title string, text string, metadata string"
QUERIES = "_id string, text string, metadata string"
QRELS = "`query-id` string, `corpus-id` string, score int"


@dataclass(frozen=True)
class SourceSpec:
    """A named source: where it lies, how to read it, and which expressions make a pair."""

    name: str
    path: str
    format: str = "parquet"
    schema: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    anchor: str = "anchor"
    positive: str = "positive"
    negative: str | None = None
    weight: float = 1.0
    limit: int | None = None
    order: str | None = None

    def key(self) -> str:
        """Changes with any part of the spec, so a kept result is never that of another spec."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


def read(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    reader = spark.read.format(spec.format).options(**spec.options)
    df = (reader.schema(spec.schema) if spec.schema else reader).load(spec.path)
    if spec.limit is not None:  # a slice needs an order to be the same again
        df = df.orderBy(spec.order or df.columns[0]).limit(spec.limit)
    return df


def pairs(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """anchor, positive, negative of the rows in which the first two (and the third, if there is one) are filled."""
    third = F.expr(spec.negative) if spec.negative else F.lit(None)
    out = df.select(F.expr(spec.anchor).cast("string").alias("anchor"), F.expr(spec.positive).cast("string").alias("positive"), third.cast("string").alias("negative"))
    out = out.where("anchor is not null and anchor <> '' and positive is not null and positive <> ''")
    return out.where("negative is not null and negative <> ''") if spec.negative else out


def load_all(spark: SparkSession, specs: list[SourceSpec]) -> DataFrame:
    """Pairs of all sources with their names."""
    out = None
    for s in specs:
        one = pairs(read(spark, s), s).withColumn("source", F.lit(s.name))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], PAIR + ", source string")


def materialised(spark: SparkSession, spec: SourceSpec, folder: str) -> DataFrame:
    """The spec's pairs, computed once and then read from a folder named by the spec's key."""
    path = f"{folder}/{spec.name}-{spec.key()}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        pairs(read(spark, spec), spec).write.mode("overwrite").parquet(path)
    return spark.read.schema(PAIR).parquet(path)


def csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', sep=sep)


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, plain or gzipped; globs work."""
    return spark.read.schema(schema).json(path)


def qrels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=QRELS, sep="\t", header=True)


def benchmark(queries: DataFrame, rels: DataFrame) -> DataFrame:
    """query, relevant (array of _id, score) of each judged query; an unknown query's text is empty."""
    by = rels.groupBy(F.col("query-id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("corpus-id").alias("_id"), "score"))).alias("relevant"))
    return by.join(queries.select("_id", "text"), "_id", "left").select(F.coalesce("text", F.lit("")).alias("query"), "relevant")


def first_that_exists(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """JSON lines of the first path that is there."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return jsonl(spark, p, schema)
    raise FileNotFoundError(paths)


def zipped_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Every CSV file in zip archives; an archive is one task's work, read in pieces."""
    names = [f.split()[0].strip("`") for f in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for n in z.namelist():
                        if n.endswith(".csv"):
                            with z.open(n) as f:
                                for part in pd.read_csv(f, dtype=str, keep_default_na=False, na_values=[""], chunksize=10_000):
                                    yield part.reindex(columns=names)

    text = ", ".join(f"`{n}` string" for n in names)
    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, text)
    kinds = spark.createDataFrame([], schema).schema
    return out.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kinds])


def decoded(raw: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def tar_texts(spark: SparkSession, archives: str, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Texts of the files in tar.gz archives that the manifest lists, with its columns."""

    def run(batches):
        for pdf in batches:
            for content in pdf["content"]:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as tar:
                    for m in tar:
                        if m.isfile():
                            yield pd.DataFrame({"_path": [m.name], "text": [decoded(tar.extractfile(m).read())]})

    texts = spark.read.format("binaryFile").load(archives).select("content").mapInPandas(run, "_path string, text string")
    return texts.join(manifest.withColumnRenamed(key, "_path"), "_path").withColumnRenamed("_path", key)


def dated_before(paths: list[str], cut: str, pattern: str = r"(\d{4}-\d{2}-\d{2})") -> list[str]:
    """Baseline files and those whose date is not after the cut-off; names without a date are baseline."""
    import re

    found = [(re.search(pattern, p.rsplit("/", 1)[-1]), p) for p in paths]
    return [p for m, p in found if m is None or m[1] <= cut]


def repaired_records(lines: DataFrame, starts: list[str], sep: str, fields: int) -> DataFrame:
    """Records of a broken dump: file, record, fields (array).

    lines: file, line (ascending in a file), text. A line that begins with one
    of starts begins a record, others go on; breaks in the last field are
    written as \\n; records with another number of fields are dropped, and
    lines before the first record too. Files are worked on side by side.
    """
    begins = F.lit(False)
    for s in starts:
        begins = begins | F.startswith(F.col("text"), F.lit(s))
    by = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("record", F.sum(F.coalesce(begins, F.lit(False)).cast("long")).over(by)).where("record > 0")
    whole = numbered.groupBy("file", "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("raw"))
    parts = F.split("raw", F.concat(F.lit(r"\Q"), F.lit(sep), F.lit(r"\E")), fields)
    return whole.select("file", "record", F.transform(parts, lambda x: F.replace(x, F.lit("\n"), F.lit("\\n"))).alias("fields")).where(F.size("fields") == fields)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, text of text files; a file stays in one split so that lines can be numbered."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", "\r?\n").alias("t"))
    return whole.select("file", F.posexplode("t").alias("line", "text"))


ARTICLE = """
MedlineCitation struct<PMID: string, DateCompleted: struct<Year: int, Month: int, Day: int>,
  Article: struct<ArticleTitle: string, Abstract: struct<AbstractText: array<string>>, AuthorList: struct<Author: array<struct<LastName: string, ForeName: string>>>>>,
PubmedData struct<ReferenceList: struct<Reference: array<struct<Citation: string, ArticleIdList: struct<ArticleId: array<string>>>>>>
"""


def articles(spark: SparkSession, path: str) -> DataFrame:
    """pmid, title, abstract, year, authors, references of article XML; plain or gzipped, malformed ones dropped.

    Title and abstract are strings, so markup inside them is kept as it is.
    """
    df = spark.read.format("xml").options(rowTag="PubmedArticle", mode="DROPMALFORMED").schema(ARTICLE).load(path)
    a = F.col("MedlineCitation.Article")
    references = F.coalesce(F.col("PubmedData.ReferenceList.Reference"), F.array())
    ids = lambda r: F.transform(F.coalesce(r["ArticleIdList"]["ArticleId"], F.array()), lambda i: F.struct(r["Citation"].alias("citation"), F.try_to_number(i, F.lit("999999999999")).cast("int").alias("id")))
    return df.select(
        F.col("MedlineCitation.PMID").alias("pmid"),
        F.coalesce(a["ArticleTitle"], F.lit("")).alias("title"),
        F.coalesce(F.array_join(a["Abstract"]["AbstractText"], " "), F.lit("")).alias("abstract"),
        F.coalesce(F.col("MedlineCitation.DateCompleted.Year"), F.lit(0)).alias("year"),
        F.coalesce(F.transform(a["AuthorList"]["Author"], lambda x: F.concat_ws(" ", x["ForeName"], x["LastName"])), F.array().cast("array<string>")).alias("authors"),
        F.filter(F.flatten(F.transform(references, ids)), lambda x: x["id"].isNotNull()).alias("references"),
    )


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """file, term, definition of JSON files with a list Terms; one row a definition of a listed term."""
    df = spark.read.schema("Terms array<struct<Term: string, Definition: string>>").json(path, multiLine=True)
    return df.select(F.input_file_name().alias("file"), F.explode("Terms").alias("t")).select("file", F.col("t.Term").alias("term"), F.col("t.Definition").alias("definition"))


def vocabulary_of(files: DataFrame) -> DataFrame:
    """The same of many small files as rows (file, content): an object each, or a list of them."""
    each = F.explode(F.from_json(F.col("content").cast("string"), "array<struct<Terms: array<struct<Term: string, Definition: string>>>>"))
    return files.select("file", each.alias("x")).select("file", F.explode("x.Terms").alias("t")).select("file", F.col("t.Term").alias("term"), F.col("t.Definition").alias("definition"))


def concepts(spark: SparkSession, path: str) -> DataFrame:
    """label and first definition of pages of concepts."""
    df = spark.read.schema("concepts array<struct<prefLabel: string, definitions: array<struct<text: string>>>>").json(path, multiLine=True)
    c = df.select(F.explode("concepts").alias("c"))
    return c.select(F.col("c.prefLabel").alias("label"), F.try_element_at("c.definitions", F.lit(1))["text"].alias("definition")).where("definition is not null")


def flat_answers(df: DataFrame) -> DataFrame:
    """question, evidence pairs of nested annotations: qas(question[], answers[[answer(evidence[], highlighted_evidence[])]]). One row each."""
    qa = df.select(F.inline(F.arrays_zip(F.col("qas.question").alias("question"), F.col("qas.answers").alias("answers"))))
    a = qa.select("question", F.explode("answers").alias("answer"))
    text = F.array_join(F.array_distinct(F.coalesce(F.col("answer.highlighted_evidence"), F.col("answer.evidence"))), " ")
    return a.select("question", text.alias("evidence")).where("question <> '' and evidence <> ''").dropDuplicates()


def any_column_contains(df: DataFrame, needle: str) -> DataFrame:
    """column, n: rows whose column holds the needle, columns with some only."""
    counts = df.select(*[F.count_if(F.col(c).cast("string").contains(needle)).alias(c) for c in df.columns])
    pair: Column = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in df.columns])
    return counts.select(F.inline(pair)).where("n > 0")
