"""Label recovery: known labels are carried to rows of the same exact content key.

Labelled and target rows are relations of one shape: partition, rollout_id, row_hash (what names a row), key, instance_id, lang,
resolved.  Evidence and references of a key are rows, never arrays, so a key with any number of them is no single value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest, language, resolved, resolved_is_valid

REFERENCE = ["partition", "rollout_id", "row_hash"]


def content_key(*parts: Column) -> Column:
    return digest("label-key/1", *parts)


def classified(rows: DataFrame, languages: list[str]) -> DataFrame:
    """Adds lang in canonical form and row_class: ineligible (language), known (label) or target.  A label that is none fails the query."""
    y = F.when(resolved_is_valid(F.col("resolved")), resolved(F.col("resolved"))).otherwise(F.raise_error(F.lit("a label must be true, false or unknown")).cast("boolean"))
    c = language(F.col("lang"))
    return rows.withColumns({"lang": c, "label": y}).withColumn(
        "row_class", F.when(~F.coalesce(F.col("lang").isin(*languages), F.lit(False)), "ineligible").when(F.col("label").isNotNull(), "known").otherwise("target")
    )


def label_keys(observed: DataFrame) -> DataFrame:
    """key, n_labels, n_true, label, langs of each labelled key: label is null where true and false both occur.

    observed: key, lang, label.  Counted by key, language and label first, so a hot key is one small row a task; langs then has
    at most one entry for each of the eligible languages.
    """
    small = observed.where("key is not null and label is not null").groupBy("key", "lang", "label").agg(F.count(F.lit(1)).alias("n"))
    per = small.groupBy("key").agg(
        F.sum("n").alias("n_labels"), F.coalesce(F.sum(F.when(F.col("label"), F.col("n"))), F.lit(0)).alias("n_true"), F.min("label").alias("low"), F.max("label").alias("high"), F.collect_set("lang").alias("langs")
    )
    return per.select("key", "n_labels", "n_true", F.when(F.col("low") == F.col("high"), F.col("low")).alias("label"), "langs")


def observations(labelled: DataFrame, targets: DataFrame, languages: list[str]) -> DataFrame:
    """REFERENCE, key, lang, label of the known rows of both relations, each different row once."""
    known = [classified(r, languages).where("row_class = 'known' and key is not null").select(*REFERENCE, "key", "lang", "label") for r in (labelled, targets)]
    return known[0].unionByName(known[1]).distinct()


def recover(labelled: DataFrame, targets: DataFrame, languages: list[str]) -> DataFrame:
    """Every different target row with outcome: candidate or request, the label, and n_labels of its key.

    A row is a candidate if all labels of its key agree and at least one is of a row of its own language; every other row is a
    request, one for its key.  Rows of one key must agree in instance and language, which contradictions() shows.
    """
    keys = label_keys(observations(labelled, targets, languages)).withColumnRenamed("label", "known")
    rows = classified(targets, languages).where("row_class = 'target' and key is not null").select(*REFERENCE, "key", "instance_id", "lang").distinct()
    j = rows.join(keys, "key", "left")
    label = F.when(F.array_contains("langs", F.col("lang")), F.col("known"))
    return j.select(*REFERENCE, "key", "instance_id", "lang", F.when(label.isNull(), "request").otherwise("candidate").alias("outcome"), label.alias("label"), F.coalesce("n_labels", F.lit(0)).alias("n_labels"))


def evaluation_requests(targets: DataFrame, languages: list[str]) -> DataFrame:
    """REFERENCE, key, instance_id, lang, patch, patch_sha256 of target rows whose label is still unknown; a known label or another
    language fails the query, since such rows need no evaluation.  targets also has patch."""
    c = classified(targets, languages)
    still = F.when(F.col("row_class") == "target", F.col("lang")).otherwise(F.raise_error(F.concat(F.lit("no request can be made of a row that is "), "row_class")).cast("string"))
    return c.select(*REFERENCE, "key", "instance_id", still.alias("lang"), "patch", F.sha2("patch", 256).alias("patch_sha256")).distinct()


def requests(recovered: DataFrame) -> DataFrame:
    """key, n_targets, first_partition, first_rollout of the keys that need an evaluation: one request serves all its targets."""
    first = F.min(F.struct(*REFERENCE)).alias("f")
    return recovered.where("outcome = 'request'").groupBy("key").agg(F.count(F.lit(1)).alias("n_targets"), first).select("key", "n_targets", F.col("f.partition").alias("first_partition"), F.col("f.rollout_id").alias("first_rollout"))


def conflicts(labelled: DataFrame, targets: DataFrame, languages: list[str]) -> DataFrame:
    """key, n_true, n_false of the labelled keys that some target has and whose labels disagree."""
    keys = label_keys(observations(labelled, targets, languages)).where("label is null")
    wanted = classified(targets, languages).where("row_class = 'target'").select("key").distinct()
    return keys.join(wanted, "key", "left_semi").select("key", "n_true", (F.col("n_labels") - F.col("n_true")).alias("n_false"))


def evidence_of(keys: DataFrame, observed: DataFrame) -> DataFrame:
    """key, label, REFERENCE, place of the observations of the keys; place orders those of a key and label from 1.

    Places are counted in sorted partitions of the whole relation, so no key's evidence is gathered in one task.
    """
    from .decisions import row_numbers

    rows = row_numbers(observed.join(keys.select("key").distinct(), "key", "left_semi").select("key", "label", *REFERENCE).distinct(), ["key", "label", *REFERENCE])
    first = rows.groupBy("key", "label").agg(F.min("row_index").alias("_from"))
    return rows.join(first, ["key", "label"]).select("key", "label", *REFERENCE, (F.col("row_index") - F.col("_from") + 1).alias("place"))


def contradictions(targets: DataFrame, languages: list[str]) -> DataFrame:
    """key of the target keys whose rows disagree in instance or language; there must be none before results are published."""
    rows = classified(targets, languages).where("row_class = 'target' and key is not null").select("key", F.struct("instance_id", "lang").alias("x"))
    return rows.groupBy("key").agg(F.min("x").alias("low"), F.max("x").alias("high")).where("low <> high").select("key")


def accounting(rows: DataFrame, languages: list[str], partition: str = "partition") -> DataFrame:
    """partition, n_rows, n_ineligible, n_known, n_target and whether they add up."""
    c = classified(rows, languages)
    out = c.groupBy(partition).agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col("row_class") == k).alias(f"n_{k}") for k in ("ineligible", "known", "target")])
    return out.withColumn("closes", F.col("n_rows") == F.col("n_ineligible") + F.col("n_known") + F.col("n_target"))


def counters(labelled: DataFrame, targets: DataFrame, languages: list[str]) -> DataFrame:
    """One row: rows of both relations, and what became of the targets; n_lost must be 0.

    n_lost is the number of target rows that are no ineligible, known, candidate, queued or repeated row: those without a key.
    """
    r = recover(labelled, targets, languages)
    one = F.lit(1).alias("k")
    a = labelled.agg(F.count(F.lit(1)).alias("n_labelled"), one)
    c = classified(targets, languages)
    b = c.agg(F.count(F.lit(1)).alias("n_targets"), F.count_if(F.col("row_class") == "ineligible").alias("n_ineligible"), F.count_if(F.col("row_class") == "known").alias("n_known"), F.count_if((F.col("row_class") == "target") & F.col("key").isNotNull()).alias("n_open"), one)
    keys = r.groupBy("key", "outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("t"))
    cand = F.col("outcome") == "candidate"
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    d = keys.agg(
        n(F.when(cand, F.col("n"))).alias("n_candidates"), F.count_if(cand).alias("n_candidate_keys"), n(F.when(cand, F.col("t"))).alias("n_resolved"), n(F.when(cand, F.col("n") - F.col("t"))).alias("n_unresolved"),
        F.count_if(~cand).alias("n_requests"), n(F.when(~cand, F.col("n"))).alias("n_queued"), one,
    )
    e = conflicts(labelled, targets, languages).agg(F.count(F.lit(1)).alias("n_conflicts"), one)
    out = a.join(b, "k").join(d, "k").join(e, "k").drop("k")
    out = out.withColumn("n_repeated", F.col("n_open") - F.col("n_candidates") - F.col("n_queued"))
    return out.withColumn("n_lost", F.col("n_targets") - F.col("n_ineligible") - F.col("n_known") - F.col("n_candidates") - F.col("n_queued") - F.col("n_repeated")).drop("n_open")
