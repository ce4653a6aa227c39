"""Text keys and embedding tables: one unit-length vector per distinct text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsemart.operators.vectors import dot, text_vectors

MODEL = "hashed-words-and-pairs-768"


def diagnosis_texts(diagnoses: DataFrame) -> DataFrame:
    return (
        diagnoses.filter(F.col("description").isNotNull()).select("icd_code", "icd_version", "description").distinct()
    )


def medication_texts(medications: DataFrame) -> DataFrame:
    label = F.concat(F.col("medication_name"), F.lit(" ("), F.col("drug_class"), F.lit(")"))
    return (
        medications.filter(F.col("medication_name").isNotNull())
        .select("ndc_code", "medication_name", "drug_class").distinct()
        .withColumn("label", label)
    )


def embedded(keys: DataFrame, text: str) -> DataFrame:
    """Keys with the vector of their text; equal texts share one computed vector."""
    texts = keys.select(F.col(text).alias("_text")).distinct()
    vectors = text_vectors(texts, "_text", "_text")
    return (
        keys.join(vectors, F.col(text) == F.col("_text")).drop("_text").withColumn("model_used", F.lit(MODEL))
    )


def note_embeddings(notes: DataFrame) -> DataFrame:
    vectors = text_vectors(notes.filter(F.col("note_text").isNotNull()), "note_id", "note_text")
    return (
        notes.select("note_id", "patient_id", "encounter_id", "note_type").join(vectors, "note_id")
        .withColumn("model_used", F.lit(MODEL))
    )


def described(embeddings: DataFrame) -> DataFrame:
    """The vector as text, ``cell:weight`` in hundred-thousandths of the cells not zero, with its length, largest weight and norm."""
    e = F.col("embedding")
    printed = F.transform(
        e, lambda x, i: F.when(x != 0, F.concat_ws(":", i, F.round(x.cast("double") * 100000).cast("int")))
    )
    return embeddings.select(
        *[c for c in embeddings.columns if c != "embedding"],
        F.size(e).alias("dimensions"),
        F.size(F.filter(e, lambda x: x != 0)).alias("filled"),
        F.round(F.array_max(e).cast("double"), 5).alias("top_weight"),
        F.round(F.sqrt(dot(e, e)), 3).alias("norm"),
        F.array_join(printed, " ").alias("cells"),
    )
