"""Study-level records aggregated to programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.operators.ordered import order_statistics, quantiles
from eventide.session import spread, stable

VERIFIED = "verified"
#: Probes (program and cutoff) of one task, about.
PROBES_A_TASK = 100_000


def verified(studies: DataFrame) -> DataFrame:
    return studies.filter(F.col("verification_status") == VERIFIED)


def program_aggregates_v1(programs: DataFrame, studies: DataFrame) -> DataFrame:
    """Counts, distinct species and models, best and upper-median effect, any-flags and mean flags.

    The upper median is the element at position n // 2 of the sorted effects. Programs without
    verified studies keep a row with zero studies and null measures.
    """
    v = verified(studies)
    stats = v.groupBy("program_id").agg(
        F.count(F.lit(1)).alias("n_animal_studies"),
        F.count_distinct(F.when(F.col("species") != "", F.col("species"))).alias("n_species"),
        F.count_distinct(F.when(F.col("disease_model") != "", F.col("disease_model"))).alias("n_models"),
        F.max("effect_size").alias("best_effect_size"),
        F.max(F.when(F.col("survival_benefit") == 1, 1).otherwise(0)).alias("any_survival_benefit"),
        F.avg("randomized").alias("pct_studies_randomized"),
        F.avg("blinded").alias("pct_studies_blinded"),
    )
    med = order_statistics(
        v, ["program_id"], "effect_size", {"median_effect_size": lambda n: F.floor(n / 2).cast("long")}
    ).drop("n_values")
    out = programs.select("program_id").join(stats, "program_id", "left").join(med, "program_id", "left")
    return out.withColumn("n_animal_studies", F.coalesce("n_animal_studies", F.lit(0).cast("long")))


def program_aggregates_v2(studies: DataFrame) -> DataFrame:
    """True median effect, smallest p-value, any-flags (unknown counts as no), means of known flags and
    scores, and the metadata of the first study."""
    v = verified(studies)
    any_flag = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) > 0).cast("int"))
    stats = v.groupBy("program_id").agg(
        F.count(F.lit(1)).alias("n_animal_studies"),
        F.count_distinct("species").alias("n_species"),
        F.count_distinct("disease_model").alias("n_models"),
        F.max("effect_size").alias("best_effect_size"),
        F.min("p_value").alias("min_p_value"),
        any_flag("survival_benefit").alias("survival_benefit_any"),
        F.avg("randomized").alias("pct_studies_randomized"),
        F.avg("blinded").alias("pct_studies_blinded"),
        F.avg("face_validity").alias("mean_face_validity"),
        F.min_by("disease_model", "study_id").alias("first_model"),
    )
    med = quantiles(v, ["program_id"], "effect_size", {"median_effect_size": 0.5}).drop("n_values")
    return stats.join(med, "program_id", "left")


def preclinical_as_of(events: DataFrame, studies: DataFrame, key: str = "program_id", cutoff: str = "cutoff") -> DataFrame:
    """Per event, the evidence of its program that was public at its cutoff: `preclinical_evidence_found` (0/1),
    `n_preclinical_publications` (studies of any status), `n_animal_studies` and the upper median effect of verified ones.

    A study without a publication date is never public; an event without program or cutoff has no evidence. Events that share
    program and cutoff are one probe, and equal effects of a day are one row, before the two are joined by program. The number of
    tasks follows the number of probes, so the groups that a task holds do not grow with the tables.
    """
    probes = stable(events.select(key, cutoff).filter(F.col(key).isNotNull() & F.col(cutoff).isNotNull()).distinct())
    n_probes = probes.count()
    probes = spread(probes, key, rows=n_probes, a_task=PROBES_A_TASK)
    good = F.coalesce(F.col("verification_status") == VERIFIED, F.lit(False))
    dated = studies.select(key, "publication_date", "verification_status", "effect_size").filter(f"publication_date is not null and {key} is not null")
    dated = spread(dated, key, rows=n_probes, a_task=PROBES_A_TASK)
    daily = dated.groupBy(key, "publication_date", F.when(good, F.col("effect_size")).alias("_effect")).agg(
        F.count("*").alias("_n"), F.count(F.when(good, 1)).alias("_v")
    )
    seen = probes.join(daily, key).filter(F.col("publication_date") <= F.col(cutoff))
    by_effect = seen.groupBy(key, cutoff, "_effect").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
    ordered = Window.partitionBy(key, cutoff).orderBy(F.col("_effect").asc_nulls_last())
    known = F.when(F.col("_effect").isNotNull(), F.col("_v")).otherwise(0)
    walked = by_effect.withColumns({
        "_upto": F.sum(known).over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        "_known": F.sum(known).over(Window.partitionBy(key, cutoff)),
    })
    middle = F.floor(F.col("_known") / 2)
    hit = F.col("_effect").isNotNull() & (middle < F.col("_upto")) & (middle >= F.col("_upto") - F.col("_v"))
    found = walked.groupBy(key, cutoff).agg(
        F.sum("_n").alias("n_preclinical_publications"), F.sum("_v").alias("n_animal_studies"), F.max(F.when(hit, F.col("_effect"))).alias("median_effect_size")
    )
    none = F.lit(0).cast("long")
    return events.join(found, [key, cutoff], "left").select(
        "catalyst_id", F.coalesce((F.col("n_preclinical_publications") > 0).cast("int"), F.lit(0)).alias("preclinical_evidence_found"),
        F.coalesce("n_preclinical_publications", none).alias("n_preclinical_publications"), F.coalesce("n_animal_studies", none).alias("n_animal_studies"), "median_effect_size",
    )
