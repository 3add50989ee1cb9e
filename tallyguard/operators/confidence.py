"""Any number of model probabilities reduced to one banded assessment."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyguard.functions.bands import band_for, band_label, band_rank
from tallyguard.functions.staging import once
from tallyguard.functions.text import percent
from tallyguard.policy import SPLIT_SPREAD


COLUMNS = {
    "probabilities": "map<string,double>", "confidence_mean": "double",
    "confidence_spread": "double", "confidence_bands": "map<string,string>",
    "confidence_band": "string", "confidence_label": "string", "confidence_rank": "int",
    "is_split": "boolean", "agreement": "string",
}


def with_assessment(df: DataFrame, probabilities: Column) -> DataFrame:
    """Adds the assessment of a model -> probability map as flat ``COLUMNS``.

    All are null where there are no scores. The mean is taken in map order, so
    equal input gives equal bits.
    """
    out = once(df, _p=F.when(F.size(probabilities) > 0, probabilities))
    out = out.drop("probabilities").withColumnRenamed("_p", "probabilities")
    values = F.map_values("probabilities")
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    out = once(
        out, confidence_mean=total / F.size(values),
        confidence_spread=F.array_max(values) - F.array_min(values),
        confidence_bands=F.transform_values("probabilities", lambda _, p: band_for(p)))
    out = once(out, confidence_band=band_for(F.col("confidence_mean")),
               _kinds=F.size(F.array_distinct(F.map_values("confidence_bands"))))
    split = F.col("confidence_spread") >= SPLIT_SPREAD
    agreement = F.when(split, "split").when(F.col("_kinds") == 1, "unanimous").otherwise("aligned")
    band = F.col("confidence_band")
    return out.withColumns({
        "confidence_label": band_label(band), "confidence_rank": band_rank(band),
        "is_split": split, "agreement": F.when(band.isNotNull(), agreement)}).drop("_kinds")


def model_list(probabilities: Column) -> Column:
    """'LogReg 55%, RBF-SVM 60%' in name order."""
    return F.array_join(F.transform(
        F.array_sort(F.map_entries(probabilities)),
        lambda e: F.concat(e["key"], F.lit(" "), percent(e["value"]))), ", ")


def summary(label: Column, mean: Column, probabilities: Column) -> Column:
    return F.concat(label, F.lit(" ("), percent(mean), F.lit(" mean): "),
                    model_list(probabilities))
