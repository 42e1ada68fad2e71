"""Prescription checks: drug names, units, doses and interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatehouse.functions.bind import explode_rows
from gatehouse.operators.findings import base_verdict, pick

# Severity order and unit synonyms.
RX_RANK = {"low": 0, "moderate": 1, "major": 2, "contraindicated": 3}
UNITS = {
    "mcg": ["microgram", "micrograms", "μg", "ug", "mcg"],
    "mg": ["milligram", "milligrams", "mg"],
    "g": ["gram", "grams", "g"],
    "ml": ["milliliter", "milliliters", "millilitre", "millilitres", "ml", "cc"],
    "units": ["unit", "units", "u", "iu", "international unit", "international units"],
}
DIMENSION = {"mg": "mass", "mcg": "mass", "g": "mass", "ml": "volume", "units": "unit"}

FINDINGS = ["patient_id", "pos", "kind", "severity", "drug", "other_drug", "message"]


def _key(c: str) -> Column:
    return F.lower(F.trim(F.col(c)))


def drug_aliases(meds: DataFrame) -> DataFrame:
    """Every brand and generic name once: generic names beat brands and earlier rows beat later ones."""
    generic = meds.select(F.lower(F.trim("generic")).alias("alias"), "generic", F.lit(0).alias("rank"), "med_pos")
    brand = meds.select(F.explode("brands").alias("alias"), "generic", F.lit(1).alias("rank"), "med_pos").withColumn("alias", _key("alias"))
    # A generic seen after a brand of the same spelling overwrites it, the other way round it does not.
    return generic.unionByName(brand).groupBy("alias").agg(
        F.min_by("generic", F.struct("rank", F.when(F.col("rank") == 0, -F.col("med_pos")).otherwise(F.col("med_pos")))).alias("generic"))


def resolve_drugs(rx: DataFrame, meds: DataFrame) -> DataFrame:
    """``rx``: ``patient_id, pos, name, dose, unit, freq``.  Adds ``generic`` and ``known``."""
    keyed = rx.withColumn("alias", _key("name"))
    return keyed.join(drug_aliases(meds).withColumnRenamed("generic", "found"), "alias", "left").select(
        *rx.columns, F.coalesce("found", "alias").alias("generic"), F.col("found").isNotNull().alias("known"))


def canonical_unit(unit: Column) -> Column:
    low = F.lower(F.trim(unit))
    out = None
    for name, words in UNITS.items():
        out = F.when(low.isin(words), name) if out is None else out.when(low.isin(words), name)
    return out.otherwise(low)


def _with_reference(rx: DataFrame, meds: DataFrame) -> DataFrame:
    """One lookup per prescription: names and reference values are joined on the small side first."""
    ref = drug_aliases(meds).withColumnRenamed("generic", "found").join(meds.select(
        F.col("generic").alias("found"), "unit_type", "canonical_unit", "max_daily", "max_mg_per_kg"), "found")
    return rx.withColumn("alias", _key("name")).join(ref, "alias", "left").select(
        *rx.columns, F.coalesce("found", "alias").alias("generic"), F.col("found").isNotNull().alias("known"),
        "unit_type", "canonical_unit", "max_daily", "max_mg_per_kg")


def _unit_issue() -> Column:
    unit = canonical_unit(F.col("unit"))
    want = F.col("canonical_unit")
    swap = ((want == "mcg") & (unit == "mg")) | ((want == "mg") & (unit == "mcg"))
    return (
        F.when(F.col("unit").isNull() | ~F.col("known") | (unit == want), F.lit(None).cast("string"))
        .when(~unit.isin(list(UNITS)), "unrecognised unit")
        .when(swap, "magnitude error of 1000")
        .when(pick(DIMENSION, unit) == F.col("unit_type"), "not the canonical unit")
        .otherwise("wrong dimension")
    )


_ISSUE = "struct<kind:string,severity:string,message:string>"


def _issue(when: Column, kind: str, severity: Column | str, message: Column | str) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.when(when, F.struct(F.lit(kind).alias("kind"), c(severity).alias("severity"), c(message).alias("message"))).cast(_ISSUE)


def _unknown() -> Column:
    return _issue(~F.col("known"), "dose", "low", "not in the reference table")


def _unit() -> Column:
    issue = F.col("unit_issue")
    return _issue(issue.isNotNull(), "unit", F.when(issue == "unrecognised unit", "moderate").otherwise("major"), issue)


def _doses() -> list[Column]:
    """Only where the unit raised no finding; a missing unit is taken as canonical."""
    daily = F.when(F.col("unit_issue").isNull() & F.col("known"), F.col("dose") * F.col("freq"))
    top = F.col("max_daily")
    return [
        _issue(daily >= 2 * top, "dose", "contraindicated", "at least twice the maximum daily dose"),
        _issue((daily > top) & (daily < 2 * top), "dose", "major", "above the maximum daily dose"),
        _issue(daily > F.col("max_mg_per_kg") * F.col("weight_kg"), "dose", "major", "above the maximum dose by weight"),
    ]


def _per_prescription(rx: DataFrame, meds: DataFrame, patients: DataFrame | None, issues: list[Column]) -> DataFrame:
    ready = _with_reference(rx, meds).withColumn("unit_issue", _unit_issue())
    if patients is not None:
        ready = ready.join(patients.select("patient_id", "weight_kg"), "patient_id", "left")
    found = F.filter(F.array(*issues), lambda x: x.isNotNull())
    return explode_rows(ready, ["patient_id", "pos", F.col("generic").alias("drug")], found, "i").select(
        "patient_id", "pos", "i.kind", "i.severity", "drug", F.lit(None).cast("string").alias("other_drug"), "i.message")


def unknown_drug_findings(rx: DataFrame, meds: DataFrame) -> DataFrame:
    return _per_prescription(rx, meds, None, [_unknown()])


def unit_findings(rx: DataFrame, meds: DataFrame) -> DataFrame:
    return _per_prescription(rx, meds, None, [_unit()])


def dose_findings(rx: DataFrame, meds: DataFrame, patients: DataFrame) -> DataFrame:
    return _per_prescription(rx, meds, patients, _doses())


def worst_pairs(pairs: DataFrame) -> DataFrame:
    """Each unordered pair once (``a <= b``) with its worst severity."""
    key = pairs.select(F.least("drug_a", "drug_b").alias("a"), F.greatest("drug_a", "drug_b").alias("b"), "severity", "pair_pos")
    return key.groupBy("a", "b").agg(
        F.min_by("severity", F.struct(-pick(RX_RANK, F.col("severity")), F.col("pair_pos"))).alias("severity"))


def pair_table(pairs: DataFrame) -> DataFrame:
    """Both directions of every pair."""
    worst = worst_pairs(pairs)
    return worst.unionByName(worst.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "severity"))


def interaction_pairs(rx: DataFrame, meds: DataFrame, pairs: DataFrame) -> DataFrame:
    """Interacting positions ``i < j`` of one patient.

    A prescription is first widened by its drug's few partners, so the self join is an equi-join on
    patient and partner drug: pairs that do not interact are never formed.
    """
    drugs = resolve_drugs(rx, meds).select("patient_id", "pos", "generic")
    wanted = drugs.join(pair_table(pairs), F.col("generic") == F.col("a")).select(
        "patient_id", F.col("pos").alias("pos_a"), F.col("generic").alias("drug"), F.col("b").alias("generic"), "severity")
    return wanted.join(drugs, ["patient_id", "generic"]).where("pos_a < pos").select(
        "patient_id", F.col("pos_a").alias("pos"), F.lit("interaction").alias("kind"), "severity", "drug",
        F.col("generic").alias("other_drug"), F.concat_ws(" + ", "drug", "generic").alias("message"))


def interaction_counts(rx: DataFrame, meds: DataFrame, pairs: DataFrame) -> DataFrame:
    """``patient_id, severity, n``: how many interacting pairs, without forming them.

    Prescriptions are counted per patient and drug first, so a patient holding a third of all rows brings
    one row per distinct drug to the join.
    """
    per = resolve_drugs(rx, meds).groupBy("patient_id", "generic").agg(F.count(F.lit(1)).alias("k"))
    left = per.join(worst_pairs(pairs), F.col("generic") == F.col("a")).select("patient_id", "a", F.col("k").alias("ka"), F.col("b").alias("generic"), "severity")
    n = F.when(F.col("a") == F.col("generic"), F.floor(F.col("ka") * (F.col("ka") - 1) / 2)).otherwise(F.col("ka") * F.col("k"))
    return left.join(per, ["patient_id", "generic"]).select("patient_id", "severity", n.alias("n")).where("n > 0")


def rx_findings(rx: DataFrame, meds: DataFrame, pairs: DataFrame, patients: DataFrame) -> DataFrame:
    """All findings: one pass over the prescriptions for names, units and doses, and the interaction join."""
    return _per_prescription(rx, meds, patients, [_unknown(), _unit(), *_doses()]).unionByName(interaction_pairs(rx, meds, pairs))


def _verdicts(counted: DataFrame, patients: DataFrame, threshold: str) -> DataFrame:
    agg = counted.groupBy("patient_id").agg(
        F.max(pick(RX_RANK, F.col("severity"))).alias("worst"), F.sum("n").alias("n"),
        *[F.sum(F.when(F.col("severity") == s, F.col("n"))).alias(f"n_{s}") for s in RX_RANK])
    return patients.select("patient_id").join(agg, "patient_id", "left").select(
        "patient_id", base_verdict(F.col("n"), F.col("worst"), threshold, "block", RX_RANK).alias("verdict"),
        F.coalesce("n", F.lit(0)).alias("total_findings"), *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in RX_RANK])


def rx_verdicts(findings: DataFrame, patients: DataFrame, threshold: str = "major") -> DataFrame:
    """Verdicts of a findings table."""
    return _verdicts(findings.select("patient_id", "severity", F.lit(1).cast("long").alias("n")), patients, threshold)


def _of_severity(severity: str) -> Column:
    return F.size(F.filter("issues", lambda x: x["severity"] == severity))


def rx_check(rx: DataFrame, meds: DataFrame, pairs: DataFrame, patients: DataFrame, threshold: str = "major") -> DataFrame:
    """Verdicts straight from prescriptions, read once: interactions are counted, not listed, and there is no self join.

    Findings and prescriptions are counted per patient and drug, so a patient with a third of all rows is as many rows as he has drugs.  Each of these then
    asks its drug's few partners: a drug that the patient has meets what was asked of it in one sum.
    """
    # Ids compress well, so partitions joined by their bytes hold very many rows; what meets the patients in a shuffle keeps this number of them.
    patients = patients.select("patient_id", "weight_kg").repartition(int(patients.sparkSession.conf.get("spark.sql.shuffle.partitions")), "patient_id")
    ready = _with_reference(rx, meds).withColumn("unit_issue", _unit_issue()).join(patients.select("patient_id", "weight_kg"), "patient_id", "left")
    found = ready.withColumn("issues", F.filter(F.array(_unknown(), _unit(), *_doses()), lambda x: x.isNotNull()))
    own = [F.sum(_of_severity(s)).alias(f"own_{s}") for s in RX_RANK]
    per = found.groupBy("patient_id", "generic").agg(F.count(F.lit(1)).alias("k"), *own)
    partners = worst_pairs(pairs).groupBy(F.col("a").alias("generic")).agg(F.collect_list(F.struct("b", "severity")).alias("partners"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    entry = lambda drug, held, asks, twice, severity: F.struct(drug.alias("drug"), held.alias("held"), asks.alias("asks"), twice.alias("twice"), severity.alias("severity"))
    k, self = F.col("k"), F.col("generic")
    asked = F.transform(F.coalesce("partners", F.array().cast("array<struct<b:string,severity:string>>")), lambda p: entry(
        p["b"], zero, F.when(p["b"] == self, zero).otherwise(k), F.when(p["b"] == self, F.floor(k * (k - 1) / 2)).otherwise(zero), p["severity"]))
    sent = explode_rows(per.join(partners, "generic", "left"), ["patient_id", *[f"own_{s}" for s in RX_RANK]], F.concat(F.array(entry(self, k, zero, zero, none)), asked), "e")
    of = lambda s, c: F.sum(F.when(F.col("e.severity") == s, F.col(f"e.{c}")).otherwise(0))
    # A drug's own findings stand in the row that says how often the patient has it.
    met = sent.groupBy("patient_id", "e.drug").agg(F.sum("e.held").alias("held"), *[of(s, "asks").alias(f"asks_{s}") for s in RX_RANK],
                                                   *[(of(s, "twice") + F.sum(F.when(F.col("e.severity").isNull(), F.col(f"own_{s}")).otherwise(0))).alias(f"own_{s}") for s in RX_RANK])
    sums = met.groupBy("patient_id").agg(*[F.sum(F.col("held") * F.col(f"asks_{s}") + F.col(f"own_{s}")).alias(f"n_{s}") for s in RX_RANK])
    joined = patients.select("patient_id").join(sums, "patient_id", "left").select("patient_id", *[F.coalesce(f"n_{s}", F.lit(0)).alias(f"n_{s}") for s in RX_RANK])
    total = sum((F.col(f"n_{s}") for s in RX_RANK), F.lit(0))
    worst = F.greatest(*[F.when(F.col(f"n_{s}") > 0, rank) for s, rank in RX_RANK.items()])
    return joined.select("patient_id", base_verdict(total, worst, threshold, "block", RX_RANK).alias("verdict"), total.alias("total_findings"), *[f"n_{s}" for s in RX_RANK])
