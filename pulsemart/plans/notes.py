"""Clinical notes: previews, extractive summaries, tone, entities, and a second risk opinion."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from pulsemart.functions import rules, text as tx
from pulsemart.functions.numbers import count_where
from pulsemart.operators.latest import latest_by
from pulsemart.sources import lookups as L

# Small clinical lexicons.
POSITIVE = ["improved", "improving", "stable", "tolerated", "good", "successfully", "comfortably", "uncomplicated",
            "effort", "adherence", "increasing"]
NEGATIVE = ["pain", "acute", "dyspnea", "dizziness", "palpitations", "stenosis", "recurrent", "bleeding", "negative",
            "symptoms"]
DIAGNOSIS_TERMS = ["stemi", "nstemi", "heart failure", "atrial fibrillation", "chest pain", "dyspnea", "palpitations"]
MEDICATION_TERMS = ["aspirin", "atorvastatin", "heparin", "diltiazem", "metoprolol", "diuretic"]
PROCEDURE_TERMS = ["pci", "catheterization", "echocardiogram", "stress echo", "treadmill exercise"]
VITAL_PATTERN = "((?:HR|BP|RPE|SpO2|LVEF) [0-9]+(?:/[0-9]+)?%?)"
FOLLOW_UP_PATTERN = "(Follow up [^.]*)"


def newest(notes: DataFrame, n: int) -> DataFrame:
    return notes.filter(F.col("note_text").isNotNull()).orderBy(F.desc("authored_at"), "note_id").limit(n)


def preview(text: Column, length: int) -> Column:
    return F.left(text, F.lit(length))


def summaries(notes: DataFrame, keep: int = 3) -> DataFrame:
    """The ``keep`` sentences whose words are most frequent in their own note, in reading order.

    A sentence scores the mean in-note frequency of its words, in thousandths.
    """
    # Notes are dealt by id once; words, scores and the cut share that partitioning.
    texts = notes.filter(F.col("note_text").isNotNull()).select("note_id", "note_text").repartition("note_id").select(
        "note_id", tx.sentences(F.col("note_text")).alias("sentences")
    )
    used = texts.select("note_id", F.posexplode("sentences").alias("position", "sentence")).select(
        "note_id", "position", F.explode(tx.words(F.col("sentence"))).alias("word")
    )
    places = used.groupBy("note_id", "word").agg(F.count("*").alias("f"), F.collect_list("position").alias("positions"))
    scores = (
        places.select("note_id", "f", F.explode("positions").alias("position"))
        .groupBy("note_id", "position")
        .agg(F.floor(F.sum("f") * 1000 / F.count("*")).alias("score"))
    )
    best = latest_by(scores, "note_id", [F.desc("score"), F.asc("position")], keep)
    chosen = best.groupBy("note_id").agg(F.array_sort(F.collect_list("position")).alias("chosen"))
    return texts.join(chosen, "note_id").select(
        "note_id", F.concat_ws(" ", F.transform("chosen", lambda p: F.get("sentences", p))).alias("summary")
    )


def document_frequencies(notes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """word, notes: in how many notes a word stands; with ``known``, the frequencies of earlier notes added on."""
    words = F.explode(F.array_distinct(tx.words(F.col("note_text")))).alias("word")
    counted = notes.filter(F.col("note_text").isNotNull()).select(words).groupBy("word").agg(F.count("*").alias("notes"))
    if known is None:
        return counted
    return counted.unionByName(known.select("word", "notes")).groupBy("word").agg(F.sum("notes").alias("notes"))


WIDESPREAD = 10_000  # a word is widespread if one note in so many has it
WIDESPREAD_WORDS = 100_000  # of these, so many at most go to every task


def tfidf_summaries(notes: DataFrame, frequencies: DataFrame, total: Column, keep: int = 3) -> DataFrame:
    """The ``keep`` sentences that say most of what other notes do not, none repeating another, in reading order.

    A word weighs its count in the note times the logarithm of ``total`` notes over those that have it, in
    thousandths; a sentence weighs the mean of its words. Sentences are chosen one after another, and each
    loses the share of its different words that a chosen one has already. Texts are dealt once, by note, and their
    words stay with them: the frequencies of widespread words go to every task, a bounded table, and only pairs of
    a note and another word are exchanged, there and back.
    """
    kept = notes.filter(F.col("note_text").isNotNull() & F.col("note_id").isNotNull()).select("note_id", "note_text")
    texts = kept.repartition("note_id").select("note_id", tx.sentences(F.col("note_text")).alias("sentences"))
    known = frequencies.filter(F.col("word").isNotNull()).select("word", "notes")
    widespread = known.filter(F.col("notes") * WIDESPREAD >= total).orderBy(F.desc("notes"), "word").limit(WIDESPREAD_WORDS)
    others = (
        kept.select("note_id", F.explode(F.array_distinct(tx.words(F.col("note_text")))).alias("word"))
        .join(F.broadcast(widespread), "word", "left_anti")
        .join(known, "word")
        .groupBy("note_id")
        .agg(F.collect_list(F.struct(F.lit(None).cast("int").alias("position"), "word", "notes")).alias("others"))
    )

    def words_at(sentence: Column, position: Column) -> Column:
        nothing = F.lit(None).cast("long").alias("notes")
        return F.transform(tx.words(sentence), lambda w: F.struct(position.alias("position"), w.alias("word"), nothing))

    # The frequencies of other words come as entries without a position, so each word of a note meets its own.
    spoken = F.flatten(F.transform("sentences", words_at))
    used = texts.join(others, "note_id", "left").select(
        "note_id", F.explode(F.when(F.col("others").isNull(), spoken).otherwise(F.concat(spoken, "others"))).alias("used")
    )
    places = used.groupBy("note_id", F.col("used.word").alias("word")).agg(
        F.count("used.position").alias("f"), F.collect_list("used.position").alias("positions"), F.max("used.notes").alias("other")
    )
    met = places.join(F.broadcast(widespread), "word", "left").withColumn("notes", F.coalesce("notes", "other"))
    weight = F.round(F.log(total / F.col("notes")) * 1000).cast("long") * F.col("f")
    weighed = met.filter("notes is not null").select("note_id", "word", weight.alias("weight"), "positions")
    scored = (
        weighed.select("note_id", "word", "weight", F.explode("positions").alias("position"))
        .groupBy("note_id", "position")
        .agg(F.floor(F.sum("weight") / F.count("*")).alias("score"), F.collect_set("word").alias("words"))
    )
    listed = scored.groupBy("note_id").agg(F.collect_list(F.struct("position", "score", "words")).alias("open"))

    def best(column: str, covered: Column) -> Column:
        """The sentence of most weight without its share of words in ``covered``, a list of word sets."""
        def left(s: Column) -> Column:
            shared = F.array_max(F.transform(covered, lambda w: F.size(F.array_intersect(s["words"], w)) * 100))
            share = F.coalesce(F.floor(shared / F.size(s["words"])), F.lit(0))
            return F.struct((s["score"] * (100 - share)).alias("value"), (-s["position"]).alias("place"))

        return -F.array_max(F.transform(column, left))["place"]

    chosen = listed.withColumn("chosen", F.array().cast("array<int>")).withColumn("covered", F.array().cast("array<array<string>>"))
    for _ in range(keep):
        chosen = chosen.withColumn("_next", best("open", F.col("covered")))
        taken = F.filter("open", lambda s: s["position"] == F.col("_next"))
        chosen = chosen.select(
            "note_id", F.filter("open", lambda s: s["position"] != F.col("_next")).alias("open"),
            F.when(F.col("_next").isNull(), F.col("chosen")).otherwise(F.array_append("chosen", F.col("_next"))).alias("chosen"),
            F.concat("covered", F.transform(taken, lambda s: s["words"])).alias("covered"),
        )
    return texts.join(chosen.select("note_id", F.array_sort("chosen").alias("chosen")), "note_id").select(
        "note_id", F.concat_ws(" ", F.transform("chosen", lambda p: F.get("sentences", p))).alias("summary")
    )


def sentiment_score(text: Column) -> Column:
    """(positive - negative) / (positive + negative) lexicon words, 0 without any."""
    good, bad = tx.count_of(text, POSITIVE), tx.count_of(text, NEGATIVE)
    return F.coalesce((good - bad) / F.nullif(good + bad, F.lit(0)), F.lit(0.0))


def sentiment_label(score: Column) -> Column:
    return rules.first_match([(score > 0.2, "POSITIVE"), (score < -0.2, "NEGATIVE")], "NEUTRAL")


def sentiment(notes: DataFrame) -> DataFrame:
    scored = notes.filter(F.col("note_text").isNotNull()).withColumn(
        "sentiment_score", sentiment_score(F.col("note_text"))
    )
    return scored.select(
        "note_id", "note_type", "patient_id", preview(F.col("note_text"), 200).alias("note_preview"),
        "sentiment_score", sentiment_label(F.col("sentiment_score")).alias("sentiment_label"),
    )


def sentiment_counts(scored: DataFrame) -> DataFrame:
    return scored.groupBy("sentiment_label").agg(F.count("*").alias("notes"))


def entities(notes: DataFrame) -> DataFrame:
    """Diagnoses, drugs, vital signs, procedures and follow-up of each whole note, as JSON."""
    text = F.col("note_text")
    found = F.struct(
        tx.terms_in(text, DIAGNOSIS_TERMS).alias("diagnoses"),
        tx.terms_in(text, MEDICATION_TERMS).alias("medications"),
        F.regexp_extract_all(text, F.lit(VITAL_PATTERN), F.lit(1)).alias("vitals"),
        tx.terms_in(text, PROCEDURE_TERMS).alias("procedures"),
        F.regexp_extract(text, FOLLOW_UP_PATTERN, 1).alias("follow_up"),
    )
    return notes.filter(text.isNotNull()).select(
        "note_id", "note_type", "patient_id", F.to_json(found).alias("extracted_entities")
    )


def phrase_index() -> dict[str, tuple[str, str]]:
    """Lower-case phrase -> (kind, code) from the code tables: full names, their categories, drugs without dose."""
    def plain(name: str) -> str:
        return " ".join(re.sub("[^a-z0-9]", " ", name.lower()).split())

    index: dict[str, tuple[str, str]] = {}
    for code, name, _ in L.DIAGNOSES:
        index[plain(name)] = ("DIAGNOSIS", code)
    for category in sorted({category for _, _, category in L.DIAGNOSES} - {"COMORBIDITY", "CARDIAC_DEVICE"}):
        index.setdefault(plain(category.replace("_", " ")), ("DIAGNOSIS", category))
    for name, drug_class in L.MEDICATIONS:
        words = [w for w in plain(name).split() if not w[0].isdigit() and len(w) > 2]
        for phrase in (plain(name), " ".join(words), words[0]):
            index.setdefault(phrase, ("MEDICATION", drug_class))
    for code, name, *_ in L.LAB_TESTS:
        index.setdefault(plain(name), ("LABORATORY", code))
    return index


NEGATION = "(?i)(?:^|[^a-z])(?:no|not|never|without|denies|denied)(?:[^a-z.!?][^.!?\n]*)?$"
LOOK_BACK = 40  # characters before a phrase in which a negation of the same sentence counts


def entity_spans(notes: DataFrame, index: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """note_id, kind, code, mention, start, negated: every phrase of the code tables in each whole note.

    ``start`` counts characters from 0. At one place the longest phrase counts, and spans do not overlap.
    Signs between words count as blanks. The index is a fixed list, so it travels as one pattern: a scan over
    the note, without an exchange and without listing its words.
    """
    index = index or phrase_index()
    listed = "|".join(sorted(index, key=lambda p: (-len(p), p)))
    pattern = F.lit(f"(?<![a-z0-9])({listed})(?![a-z0-9])")
    blanked = F.regexp_replace(F.col("note_text"), "[^A-Za-z0-9]", " ")
    texts = notes.filter(F.col("note_text").isNotNull()).select("note_id", "note_text", F.lower(blanked).alias("blanked"))
    parts = texts.select(
        "note_id", "note_text", F.regexp_extract_all("blanked", pattern, F.lit(1)).alias("found"),
        F.split("blanked", f"(?<![a-z0-9])(?:{listed})(?![a-z0-9])", -1).alias("gaps"),
    ).filter(F.size("found") > 0)
    widths = F.zip_with(F.slice("gaps", F.lit(1), F.size("found")), "found", lambda g, f: F.struct(F.length(g).alias("g"), F.length(f).alias("f")))
    placed = parts.withColumn("widths", widths).select("note_id", "note_text", "widths", F.posexplode("found").alias("nth", "phrase"))
    before = F.aggregate(F.slice("widths", F.lit(1), F.col("nth")), F.lit(0), lambda total, w: total + w["g"] + w["f"])
    start = before + F.get("widths", F.col("nth"))["g"]
    kinds = F.create_map(*[F.lit(x) for p, (kind, code) in index.items() for x in (p, f"{kind} {code}")])
    spans = placed.withColumn("start", start).withColumn("known", F.try_element_at(kinds, F.col("phrase")))
    back = F.least(F.col("start"), F.lit(LOOK_BACK))
    ahead = F.substring(F.col("note_text"), F.col("start") - back + 1, back)
    return spans.select(
        "note_id", F.substring_index("known", " ", 1).alias("kind"), F.substring_index("known", " ", -1).alias("code"),
        F.substring(F.col("note_text"), F.col("start") + 1, F.length("phrase")).alias("mention"), "start",
        ahead.rlike(NEGATION).alias("negated"),
    )


def risk_opinions(referrals: DataFrame) -> DataFrame:
    """The stored risk next to a second rule set that also weighs the diagnosis."""
    lvef, mets = F.col("lvef_percent"), F.col("gxt_peak_mets")
    severe = F.col("qualifying_diagnosis").isin("STEMI", "HFrEF", "CABG")
    opinion = rules.first_match(
        [
            ((lvef < 40) | (mets < 5), "HIGH"),
            ((lvef >= 50) & (mets >= 7) & ~severe, "LOW"),
        ],
        "MODERATE",
    )
    return referrals.select(
        "referral_id", "patient_id", "qualifying_diagnosis", "lvef_percent", "gxt_peak_mets",
        F.col("computed_risk").alias("rule_based_risk"), opinion.alias("second_opinion"),
    )


def risk_prompt(referrals: DataFrame) -> DataFrame:
    """The one-line case description used to ask for a second opinion."""
    return referrals.select(
        "referral_id",
        F.concat(
            F.lit("LVEF: "), F.col("lvef_percent").cast("string"), F.lit("%, Peak METs: "),
            F.col("gxt_peak_mets").cast("string"), F.lit(", Diagnosis: "), F.col("qualifying_diagnosis"),
        ).alias("case_text"),
    )


def agreement(opinions: DataFrame) -> DataFrame:
    """Share of referrals whose stored risk occurs in the second opinion."""
    same = F.contains(F.col("second_opinion"), F.trim("rule_based_risk"))
    return opinions.agg(
        F.count("*").alias("referrals"), count_where(same).alias("agreeing"),
        F.round(F.avg(F.when(same, 1.0).otherwise(0.0)) * 100, 2).alias("agreement_pct"),
    )
