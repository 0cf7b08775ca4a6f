"""What became of claims after a revision: states of revised claims, outcomes, pair outcomes, tiers, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the outcomes that count as good and as bad for a claim, and those that are open.
GOOD = ("ERROR_CORRECTED_CANDIDATE", "ERROR_REMOVED_BY_DELETION_CANDIDATE")
KEPT = ("FACTUAL_RETAINED_CANDIDATE", "FACTUAL_PRESERVED_AFTER_CHANGE_CANDIDATE")
HARM = ("FACTUAL_DAMAGED_CANDIDATE", "FACTUAL_DELETED_CANDIDATE")


def revised_state(size: Column, complete: Column, wrong: Column, right: Column) -> Column:
    """State of a list of revised claims from its aggregates: its size, all ok, any NON_FACTUAL, all FACTUAL."""
    return (
        F.when(size == 0, "NO_REVISED_CLAIM")
        .when(~complete, "INCOMPLETE")
        .when(wrong, "CONTAINS_NON_FACTUAL")
        .when(right, "ALL_FACTUAL")
        .otherwise("UNKNOWN_OR_MIXED")
    )


def link_revised(initial: DataFrame, revised: DataFrame, key: str, ids: str, revised_key: str) -> DataFrame:
    """``initial`` with ``revised_claims`` and ``state``: its list of ids is opened, looked up and reduced again.

    ``revised`` has the key, status and prediction. An id that is not there makes the list incomplete. A null
    list is an empty one. The lists are opened before the join, so a claim with many ids is spread.
    """
    opened = initial.select(key, F.explode_outer(ids).alias("wanted"))
    found = revised.select(F.col(revised_key).alias("got"), F.col("status"), F.upper("prediction").alias("said"))
    rows = opened.join(found, F.col("wanted") == F.col("got"), "left")
    ok = F.col("got").isNotNull() & F.coalesce(F.col("status") == "ok", F.lit(False))
    reduced = rows.groupBy(key).agg(
        F.count("wanted").alias("revised_claims"),
        F.bool_and(ok | F.col("wanted").isNull()).alias("complete"),
        F.bool_or(F.coalesce(ok & (F.col("said") == "NON_FACTUAL"), F.lit(False))).alias("wrong"),
        F.bool_and(F.coalesce(F.col("said") == "FACTUAL", F.lit(False))).alias("right"),
    )
    state = revised_state(F.col("revised_claims"), F.col("complete"), F.col("wrong"), F.col("right"))
    return initial.join(reduced.select(key, "revised_claims", state.alias("state")), key)


def provisional(label: Column, relation: Column) -> Column:
    """Transition of a claim before its revised claims are judged."""
    factual = label == "FACTUAL"
    return (
        F.when(relation == "PRESENT_UNEXTRACTED", "EXTRACTION_OMISSION")
        .when(~label.isin("FACTUAL", "NON_FACTUAL") | label.isNull(), "ANCHOR_REVIEW")
        .when(relation == "EQUIVALENT", F.when(factual, "FACTUAL_RETAINED").otherwise("ERROR_RETAINED"))
        .when(relation == "ABSENT", F.when(factual, "FACTUAL_DELETED").otherwise("ERROR_REMOVED"))
        .otherwise("FACTUALITY_REQUIRED")
    )


def outcome(label: Column, relation: Column, state: Column) -> Column:
    """Outcome of a claim from its label, its relation to the revision and the state of its revised claims."""
    factual = label == "FACTUAL"
    equal = relation == "EQUIVALENT"
    return (
        F.when(relation == "PRESENT_UNEXTRACTED", "UNRESOLVED_EXTRACTION_OMISSION")
        .when(~label.isin("FACTUAL", "NON_FACTUAL") | label.isNull(), "UNRESOLVED_UNKNOWN_INITIAL_ANCHOR")
        .when(relation == "ABSENT", F.when(factual, "FACTUAL_DELETED_CANDIDATE").otherwise("ERROR_REMOVED_BY_DELETION_CANDIDATE"))
        .when(state.isin("INCOMPLETE", "UNKNOWN_OR_MIXED"), "UNRESOLVED_REVISED_FACTUALITY")
        .when((state == "ALL_FACTUAL") & equal, F.when(factual, "FACTUAL_RETAINED_CANDIDATE").otherwise("SILVER_LABEL_DISAGREEMENT_CANDIDATE"))
        .when(state == "ALL_FACTUAL", F.when(factual, "FACTUAL_PRESERVED_AFTER_CHANGE_CANDIDATE").otherwise("ERROR_CORRECTED_CANDIDATE"))
        .when((state == "CONTAINS_NON_FACTUAL") & factual, "FACTUAL_DAMAGED_CANDIDATE")
        .when(state == "CONTAINS_NON_FACTUAL", F.when(equal, "ERROR_RETAINED_CANDIDATE").otherwise("ERROR_STILL_PRESENT_AFTER_CHANGE_CANDIDATE"))
        .otherwise("UNRESOLVED_ALIGNMENT_OR_FACTUALITY")
    )


def pair_outcome(label: Column, validity: Column, sufficiency: Column, correctness: Column, stance: Column) -> Column:
    """Outcome of one question and claim from the four labels of its evaluation."""
    good = correctness.isin("CORRECT", "PARTIALLY_CORRECT")
    partial = F.when(correctness == "PARTIALLY_CORRECT", "PARTIAL_").otherwise("")
    supports, challenges = stance == "SUPPORTS_CLAIM", stance == "CHALLENGES_CLAIM"
    return (
        F.when(validity == "INVALID", "INVALID_ALIGNMENT")
        .when(correctness == "UNVERIFIABLE", "UNVERIFIABLE")
        .when((sufficiency == "INSUFFICIENT") | (correctness == "INSUFFICIENT"), "INSUFFICIENT_ANSWER")
        .when((label == "FACTUAL") & supports & good, F.concat(partial, F.lit("CORRECT_CONFIRMATION")))
        .when((label == "FACTUAL") & challenges, "FALSE_CHALLENGE")
        .when((label == "NON_FACTUAL") & challenges & good, F.concat(partial, F.lit("CORRECT_CHALLENGE")))
        .when((label == "NON_FACTUAL") & supports, "FALSE_CONFIRMATION")
        .when(stance == "MIXED", "MIXED_STANCE")
        .when(stance == "NO_POSITION", "NO_POSITION")
        .otherwise("INCORRECT_OR_INCONSISTENT")
    )


def tier(inherited: Column, status: Column, prediction: Column, other_status: Column, other: Column, flagged: Column) -> Column:
    """How well a prediction is attested; ``inherited`` is the binary label of an equal claim, if there is one."""
    binary = lambda p: p.isin("FACTUAL", "NON_FACTUAL")
    confirmed = (other_status == "ok") & binary(other) & (other == prediction) & ~flagged
    return (
        F.when(binary(inherited), "GOLD_INHERITED")
        .when(confirmed, "CROSS_MODEL_CONFIRMED")
        .when((status == "ok") & binary(prediction), "SILVER_ONLY")
        .otherwise("UNRESOLVED")
    )


def mechanism(result: Column, asked: Column, usable: Column, challenged: Column, acted: Column) -> Column:
    """Why a wrong claim was or was not corrected, the first that applies."""
    return (
        F.when(result == "ERROR_CORRECTED_CANDIDATE", "STRICT_CORRECTION")
        .when(result == "ERROR_REMOVED_BY_DELETION_CANDIDATE", "DELETION")
        .when(result == "SILVER_LABEL_DISAGREEMENT_CANDIDATE", "EVALUATOR_LABEL_CONFLICT")
        .when(result.isin("UNRESOLVED_REVISED_FACTUALITY", "UNRESOLVED_EXTRACTION_OMISSION"), "FINAL_FACTUALITY_UNRESOLVED")
        .when(~asked, "PLANNER_MISS")
        .when(~usable, "VERIFICATION_NOT_EVALUABLE")
        .when(~challenged, "VERIFICATION_DID_NOT_PRODUCE_SUPPORTED_CHALLENGE")
        .when(~acted, "REVISION_OMISSION_AFTER_CHALLENGE")
        .otherwise("REVISION_UNSUCCESSFUL_AFTER_CHALLENGE")
    )
