"""Queries over the operators for training data, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..runtime import table
from .leakage import leaks
from .packing import pack
from .questions import overlap_counts, overlapping_pairs, prepare
from .resolution import resolve_organisations, resolve_people
from .subjects import assign_subjects
from .vectors import exact_neighbours, most_similar


def _questions(spark: SparkSession, root: str) -> DataFrame:
    return prepare(table(spark, root, "gold_questions"), "question_no", "split", "kg_id", "question", "gold_sparql")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return overlapping_pairs(_questions(spark, root)).select("question_a", "question_b").distinct()


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Overlaps with train per evaluation split and source, and how many of them only edits bring together."""
    return overlap_counts(_questions(spark, root)).withColumnRenamed("source", "kg_id")


def _people(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    providers = table(spark, root, "healthcare_providers")
    hospitals = resolve_organisations(providers, "record_id", "hospital_affiliation")
    return hospitals, resolve_people(providers, "record_id", "full_name", "city", "state", "phone", "hospital_affiliation", "npi", hospitals)


def _pairs(df: DataFrame, field: str, row: str) -> DataFrame:
    """All pairs of an entity's rows; an entity's rows are few."""
    a, b = df.select("entity", F.col(row).alias("id_a")), df.select("entity", F.col(row).alias("id_b"))
    return a.join(b, "entity").filter("id_a < id_b").select(F.lit(field).alias("field"), "id_a", "id_b")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    hospitals, people = _people(spark, root)
    sponsors = resolve_organisations(table(spark, root, "clinical_trials"), "trial_row", "sponsor")
    return _pairs(people, "full_name", "row_id").unionByName(_pairs(hospitals, "hospital_affiliation", "row_id")).unionByName(_pairs(sponsors, "sponsor", "row_id"))


def p5_entities(spark: SparkSession, root: str) -> DataFrame:
    """Each record with its person: one row a record, however many copies there are."""
    return _people(spark, root)[1].select(F.col("row_id").alias("record_id"), F.col("entity").alias("person_id"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    near = most_similar(table(spark, root, "entity_semantic_chunk"), "chunk_id", "embedding", F.col("embed_model"), k=10, min_cosine=0.90)
    return near.select(F.least("id", "neighbour").alias("chunk_a"), F.greatest("id", "neighbour").alias("chunk_b")).distinct()


def p7_recall(spark: SparkSession, root: str) -> DataFrame:
    """Recall of the orderings against brute force for every vector whose id is divisible by 100, among neighbours of at least 0.90 and 0.95."""
    chunks = table(spark, root, "entity_semantic_chunk")
    near = most_similar(chunks, "chunk_id", "embedding", F.col("embed_model"), k=10, min_cosine=0.90).select("id", "neighbour", F.lit(1).alias("found"))
    true = exact_neighbours(chunks, "chunk_id", "embedding", F.col("embed_model"), F.col("chunk_id") % 100 == 0).filter("cosine >= 0.90")
    both = true.join(near, ["id", "neighbour"], "left").select(F.inline(F.array(*[F.struct(F.lit(c).alias("min_cosine"), (F.col("cosine") >= c).alias("counts"), "found") for c in (0.90, 0.95)]))).filter("counts")
    return both.groupBy("min_cosine").agg(F.count("*").alias("n_true"), F.count("found").alias("n_found"), F.round(F.count("found") / F.count("*"), 4).alias("recall"))


#: Contexts are those of the model with the shortest context of at least so many tokens, or of the longest there is.
LEAST_CONTEXT = 2048


def _packed(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    length = F.col("context_length")
    capacity = table(spark, root, "llm_models").agg(F.coalesce(F.min(F.when(length >= LEAST_CONTEXT, length)), F.max(length))).first()[0]
    return pack(table(spark, root, "documents"), "doc_id", "text", capacity), capacity


def p8_contexts(spark: SparkSession, root: str) -> DataFrame:
    """Each piece of a document with its place in a context of the model."""
    return _packed(spark, root)[0]


def p8_report(spark: SparkSession, root: str) -> DataFrame:
    """Per bucket: contexts, pieces, cuts, the least number of contexts that any packing needs, and the share of room that is used."""
    packed, capacity = _packed(spark, root)
    least = F.ceil(F.sum("n_tokens") / capacity)
    return packed.groupBy("bucket").agg(F.countDistinct("context_id").alias("n_contexts"), F.count("*").alias("n_pieces"), F.count_if(F.col("piece") > 0).alias("n_cuts"), least.alias("n_least"), F.round(F.sum("n_tokens") / (F.countDistinct("context_id") * capacity), 4).alias("fill"))


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leaks(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "passage", "answer")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id")


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    """Leaked items per benchmark: items, documents, those that hold the answer, too, longest stretch."""
    found = _leaks(spark, root).join(table(spark, root, "eval_items").select("item_id", "benchmark"), "item_id")
    return found.groupBy("benchmark").agg(F.countDistinct("item_id").alias("n_items"), F.countDistinct("doc_id").alias("n_documents"), F.count_if("with_answer").alias("n_with_answer"), F.max("n_words").alias("longest"))


def _subjects(spark: SparkSession, root: str) -> DataFrame:
    return assign_subjects(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "subject_labels"), "doc_id", "subject", table(spark, root, "subject_areas"), "subject", "source")


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _subjects(spark, root).select("doc_id", "subject")


def p10_composition(spark: SparkSession, root: str) -> DataFrame:
    """Documents by subject."""
    return _subjects(spark, root).groupBy("subject").agg(F.count("*").alias("n_documents"), F.round(F.avg("share"), 4).alias("mean_share"))


QUERIES = {f.__name__: f for f in (p3_found, p3_report, p5_found, p5_entities, p7_found, p7_recall, p8_contexts, p8_report, p9_found, p9_report, p10_found, p10_composition)}
ORACLE: dict[str, str] = {}
