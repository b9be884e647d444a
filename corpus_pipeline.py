"""A training corpus from raw documents: five stages, each by one operator of ``loomline.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  ``run`` writes each stage's result as Parquet in the shared checkpoint folder and
reads it again for the next.  Stages give their operators numbered columns, so extra columns of any
name pass through; null texts and ids and repeated rows are treated as the operators state.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm import bpe, langid, mixing, near_dedup, secrets
from loomline.llm.common import cut, ensure_checkpoint_dir, remove, scratch, sent, table

#: A text below this score is far from its language, but only if it also scores less than ``USUAL`` times what is
#: usual there: clean texts in alphabets score 0.4 and more, those in scripts of thousands of characters under 0.2.
LEAST_SCORE, USUAL = 0.2, 0.5
#: Keys of rows that go which are sent to all tasks, at most; beyond, the documents are shuffled to meet them.
KEYS = 200_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The same rows with columns c0, c1, ..., and the new name of each old one."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _placed(docs: DataFrame, column: str) -> DataFrame:
    """The same rows with each one's place in the order in which its files were written, whatever order they are read in.

    The place comes from the number in a part file's name and the row's place in that file; rows that are not
    read from files are numbered as they come.
    """
    try:
        files = docs.metadataColumn("_metadata")
        rows = docs.select("*", files["file_path"].alias(f"{column}_file"), files["row_index"].alias(f"{column}_row"))
    except AnalysisException:
        return cut(docs.withColumn(column, F.monotonically_increasing_id()))
    path = F.col(f"{column}_file")
    counts = rows.groupBy(path).agg((F.max(f"{column}_row") + 1).alias("n"))
    number = F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1).try_cast("long")
    before = Window.orderBy(number, path).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(path.alias(f"{column}_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(f"{column}_start"))
    joined = rows.join(sent(cut(starts)), path == F.col(f"{column}_of"))
    return joined.select(*docs.columns, (F.col(f"{column}_start") + F.col(f"{column}_row")).alias(column))


def _without(keyed: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key is not among ``gone``, without the key."""
    return keyed.join(sent(cut(gone.withColumnRenamed("row", "gone")), KEYS), F.col("row") == F.col("gone"), "left_anti").drop("row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the corpus itself labels; those without letters or far from all go.

    What is usual is the median score of a language's labelled texts of like length (its octave), or the lowest of
    these medians where there is no text of that length.  Without any labels nothing is known, and all documents stay.
    Null and empty texts have no letters; repeated rows and null ids are judged alike by their texts, texts of any
    length whole; an empty table stays empty; extra columns of any name are kept.
    """
    rows, name = _numbered(docs)
    learned = langid.learn(rows, name["text"], name["lang"])
    if learned.isEmpty():
        return docs
    keyed = _placed(rows, "row").withColumn("octave", F.floor(F.log2(F.char_length(name["text"]).cast("double"))))
    # Decisions are made on short rows and brought to the documents by their places.
    found = cut(langid.identify(keyed, learned, name["text"], keep=("row", name["lang"], "octave")))
    own = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col(name["lang"]) == F.col("lang_pred")))
    medians = cut(own.groupBy(F.col("lang_pred").alias("lang"), F.col("octave").alias("long")).agg(F.percentile_approx("score", 0.5).alias("median")))
    lowest = medians.groupBy(F.col("lang").alias("low_lang")).agg(F.min("median").alias("lowest"))
    scored = found.join(sent(medians), (F.col("lang_pred") == F.col("lang")) & (F.col("octave") == F.col("long")), "left")
    scored = scored.join(sent(lowest), F.col("lang_pred") == F.col("low_lang"), "left")
    usual = F.coalesce("median", "lowest", F.lit(0.0))
    gone = scored.where((F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < F.least(F.lit(LEAST_SCORE), USUAL * usual)))
    return _without(keyed.select("row", *name.values()), gone.select("row")).toDF(*docs.columns)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Of a group the row with the least id stays; null ids come last.  Texts without words, null or empty, are no
    duplicates of anything and all stay; repeated rows are one group; texts of any length are compared whole; an
    empty table stays empty; extra columns of any name are kept.
    """
    rows, name = _numbered(docs)
    id_col, text_col = name["doc_id"], name["text"]
    # Rows are told apart by their places, as ids may be null or repeated.
    keyed = _placed(rows, "row")
    marked = near_dedup.near_duplicates(keyed, percent=80, words=5, id_col="row", text_col=text_col).select(F.col("row").alias("marked"), "component_id")
    # Of each component the row with the least id stays; rows without an id come last, ties go by place.
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col("row"))
    placed = cut(keyed.select("row", id_col).join(marked, F.col("row") == F.col("marked")).select("row", id_col, "component_id"))
    stays = placed.groupBy("component_id").agg(F.min_by("row", order).alias("stays")).select("stays")
    return _without(keyed, placed.join(stays, F.col("row") == F.col("stays"), "left_anti").select("row")).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and ``n_chars`` brought in line.

    Null and empty texts stay, a null ``n_chars`` stays null; repeated rows and null ids are treated alike, texts of
    any length whole; an empty table stays empty; extra columns of any name are kept.
    """
    rows, name = _numbered(docs)
    clean = secrets.redact(rows, name["text"])
    if "n_chars" in name:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn(name["n_chars"], F.when(F.col(name["n_chars"]).isNotNull(), F.char_length(name["text"])).cast(kind))
    return clean.toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in an order whose every stretch holds the sources in their target weights.

    Files are written in that order; ``bpe_encode`` turns it into the column ``position``.  A null source is a source;
    null and repeated ids and repeated rows each get a place; texts are not looked at; an empty table stays empty;
    extra columns of any name are kept.
    """
    rows, name = _numbered(docs)
    mixed = mixing.mix_sources(rows, id_col=name["doc_id"], source_col=name["source"], keep=tuple(c for c in name.values() if c not in (name["doc_id"], name["source"])))
    mixed = mixed.withColumnRenamed("source", name["source"])
    return mixed.orderBy("position").select(*name.values()).toDF(*docs.columns)


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, digests of them and of what they decode to, and its place in the mix.

    Null and empty texts have no ids; repeated rows and null ids each give a row; texts of any length are encoded
    whole; an empty table gives no rows; extra columns are not read.
    """
    rows, name = _numbered(docs)
    rows = _placed(rows, "place").withColumn("key", F.struct(F.col(name["doc_id"]).alias("doc_id"), F.col("place").alias("position")))
    coded = bpe.encode_and_decode(rows, public_tokenizers.path("word_bpe_49k.json"), "key", name["text"])
    return coded.select("key.doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "key.position")


STAGES = [
    ("language_id", language_id),
    ("minhash_dedup", minhash_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("bpe_encode", bpe_encode),
]

#: SQL expresses neither profiles, signatures, automata nor byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; the result is read from the last stage's files.

    Once a stage's files are written, what was computed on the way and the files of the stage before are removed.
    """
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus_pipeline_{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        with scratch():
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, f"{folder}/{before}")
        docs, before = spark.read.parquet(f"{folder}/{name}"), name
    return docs
