"""Features, training sets, embeddings, history and note queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pulsemart.functions import text as tx
from pulsemart.operators.history import merge_versions, stored_versions, versions
from pulsemart.operators.knn import nearest_of
from pulsemart.plans import embeddings as em, features as f, notes as n
from pulsemart.plans.health import Health
from pulsemart.sources import bridge, lookups
from pulsemart.sources.store import shared_folder, table_counts
from pulsemart.sources.versions import VersionedTable

TRACKED = ["address", "marital_status", "primary_language"]
MODEL_COLUMNS = ["model_id", "model_name", "model_version", "model_type", "task", "target_platform",
                 "training_dataset", "description"]


def _features(h: Health):
    return f.patient_clinical_features(
        h.dim_patient, h.fact_diagnosis, h.fact_medication, h.fact_encounter, h.fact_lab_result, h.as_of
    )


def _rehab(h: Health):
    return f.cardiac_rehab_features(
        h.fact_rehab_session, h.fact_rehab_referral, h.as_of, sized_by=h.raw_rehab_sessions
    )


def _catalogue(h: Health):
    models = lookups.lookup(h.spark, lookups.MODELS, MODEL_COLUMNS)
    retrained = models.filter(F.col("model_id") == "MDL-003").withColumn("description", F.lit("Retrained"))
    sizes = table_counts({
        "HEALTH_TRANSFORM_DB.MEDICATIONS.FACT_MEDICATION": h.fact_medication,
        "HEALTH_AI_READY_DB.FEATURE_STORE.PATIENT_CLINICAL_FEATURES": h.dim_patient,
        "HEALTH_AI_READY_DB.TRAINING_DATASETS.MORTALITY_PREDICTION_V1": h.dim_patient,
    })
    return f.catalogue_with_sizes(f.upsert_models(models, retrained), sizes).select(*MODEL_COLUMNS, "training_rows")


def _nearest(h: Health):
    """Five neighbours of every vector whose id is divisible by 50, among all vectors."""
    return nearest_of(bridge.star(h.spark, h.sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, "vec_id", "embedding", 5)[0]


def _tfidf_summaries(h: Health):
    notes = h.raw_clinical_notes
    total = notes.filter(F.col("note_text").isNotNull()).agg(F.count("*")).scalar()
    return n.tfidf_summaries(notes, n.document_frequencies(notes), total)


def _merged_history(h: Health):
    """The history of patients from a stored dimension into which three loads are merged, the last one first."""
    table = VersionedTable(h.spark, f"{shared_folder(h.spark)}/tables/dim_patient-{uuid.uuid4().hex}", "patient_id")
    load = F.pmod(F.xxhash64("patient_id", "record_id"), F.lit(3))
    for number in (2, 0, 1):
        merge_versions(table, h.raw_patients.where(load == number), TRACKED)
    return stored_versions(table, TRACKED)


QUERIES = {
    "t9_merged_history": _merged_history,
    "t9_patient_history": lambda h: versions(h.raw_patients, "patient_id", TRACKED),
    "l1_patient_clinical_features": _features,
    "l2_diagnosis_features": lambda h: f.diagnosis_block(h.fact_diagnosis),
    "l3_medication_features": lambda h: f.medication_block(h.fact_medication),
    "l4_encounter_features": lambda h: f.encounter_block(h.fact_encounter),
    "l5_lab_features": lambda h: f.lab_block(h.fact_lab_result),
    "l6_cardiac_rehab_features": _rehab,
    "l7_mortality_training_set": lambda h: f.mortality_training_set(_features(h), h.fact_encounter, h.as_of),
    "l8_adverse_event_training_set": lambda h: f.adverse_event_training_set(_rehab(h), h.as_of),
    "l9_model_catalogue": _catalogue,
    "l10_diagnosis_texts": lambda h: em.diagnosis_texts(h.fact_diagnosis),
    "l10_medication_texts": lambda h: em.medication_texts(h.fact_medication),
    "l11_diagnosis_embeddings": lambda h: em.described(
        em.embedded(em.diagnosis_texts(h.fact_diagnosis), "description")
    ),
    "l11_medication_embeddings": lambda h: em.described(em.embedded(em.medication_texts(h.fact_medication), "label")),
    "l12_note_embeddings": lambda h: em.described(em.note_embeddings(h.raw_clinical_notes)),
    "x1_note_summaries": lambda h: n.summaries(h.raw_clinical_notes),
    "x1_tfidf_summaries": _tfidf_summaries,
    "x2_note_sentiment": lambda h: n.sentiment(h.raw_clinical_notes),
    "x3_sentiment_counts": lambda h: n.sentiment_counts(n.sentiment(h.raw_clinical_notes)),
    "x4_note_entities": lambda h: n.entities(h.raw_clinical_notes),
    "x4_entity_spans": lambda h: n.entity_spans(h.raw_clinical_notes),
    "x5_risk_second_opinion": lambda h: n.risk_opinions(h.fact_rehab_referral),
    "x6_risk_agreement": lambda h: n.agreement(n.risk_opinions(h.fact_rehab_referral)),
    "x7_note_previews": lambda h: h.raw_clinical_notes.select(
        "note_id", "note_type", n.preview(F.col("note_text"), 200).alias("note_preview")
    ),
    "x8_nearest_vectors": _nearest,
    "k6_newest_notes": lambda h: n.newest(h.raw_clinical_notes, 15).select(
        "note_id", "note_type", "patient_id", "authored_at"
    ),
    "v4_note_functions": lambda h: h.raw_clinical_notes.select(
        "note_id", n.sentiment_label(n.sentiment_score(F.col("note_text"))).alias("tone"),
        F.size(tx.words(F.col("note_text"))).alias("words"),
    ),
    "f23_risk_case_text": lambda h: n.risk_prompt(h.fact_rehab_referral),
}
