"""Quantities recorded in different units (problem 2): weights in kilograms with the unit they stand in.

1. A multi-pattern automaton finds unit spellings beside the number in value and in valueuom.
2. Each row votes for the weights its number could mean: one vote where the text names the unit, a vote for
   the named unit and smaller ones for the others where only valueuom does, or nothing does (field context).
   Votes are counted per encounter in bins of the logarithm, so an encounter is a bounded histogram however
   many rows it has, and the count is combined before the shuffle.
3. The best supported bin is the encounter's weight; a row takes the unit that agrees with it.
4. Conversion factors are a four-row table joined by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.grouped import change_points, map_groups
from cohortloom.operators.unitscan import KG_OF, build, scan
from cohortloom.sources.tables import reading, shared_folder

#: Width of a histogram bin in the natural logarithm of kilograms, and the bins on each side that agree.
BIN, REACH = 0.02, 9
#: A unit agrees if its weight is within this distance (natural logarithm) of the encounter's weight.
AGREE = 0.32

UNITS = list(KG_OF)

_FOUND = "row_id bigint, hadm_id bigint, itemid bigint, field_unit string, number double, in_value string, in_uom string"


def named_units(rows: DataFrame) -> DataFrame:
    """Adds the units named in value (in_value) and in valueuom (in_uom); corrects pounds with ounces.

    Input: row_id, hadm_id, itemid, field_unit, number, value, valueuom. Nulls name no unit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build()
        for b in batches:
            numbers = b.column("number").to_numpy(zero_copy_only=False).copy()
            found = []
            for name in ("value", "valueuom"):
                coded = b.column(name).dictionary_encode()  # every text of a batch is scanned once
                hits = [*(scan(text, automaton) for text in coded.dictionary.to_pylist()), (None, None)]
                found.append([hits[k] for k in coded.indices.fill_null(len(hits) - 1).to_pylist()])
            for i, (_, whole) in enumerate(found[0]):
                if whole is not None:
                    numbers[i] = whole
            in_value, in_uom = ([unit for unit, _ in f] for f in found)
            keep = [b.column(c) for c in ("row_id", "hadm_id", "itemid", "field_unit")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(numbers, from_pandas=True), pa.array(in_value, pa.string()), pa.array(in_uom, pa.string())], ["row_id", "hadm_id", "itemid", "field_unit", "number", "in_value", "in_uom"])

    return rows.select("row_id", "hadm_id", "itemid", "field_unit", "number", "value", "valueuom").mapInArrow(run, _FOUND)


def factors(df: DataFrame) -> DataFrame:
    """The conversion table: unit, factor."""
    return df.sparkSession.createDataFrame(list(KG_OF.items()), "unit string, factor double")


def encounter_weights(found: DataFrame) -> DataFrame:
    """The best supported weight in kilograms of each encounter: hadm_id, centre (natural logarithm).

    Votes weigh more for a unit that is told or that the field names; of equally supported weights the least
    counts.
    """
    vote = (
        F.when(F.col("in_value").isNotNull(), F.when(F.col("unit") == F.col("in_value"), 1.5))
        .when(F.col("in_uom").isNotNull(), F.when(F.col("unit") == F.col("in_uom"), 1.0).otherwise(F.when(F.col("unit") == F.col("field_unit"), 0.3).otherwise(0.1)))
        .otherwise(F.when(F.col("unit") == F.col("field_unit"), 0.8).otherwise(0.1))
    )
    bins = (
        found.filter("hadm_id is not null")
        .crossJoin(F.broadcast(factors(found)))
        .withColumn("vote", vote)
        .filter("vote is not null")
        .groupBy("hadm_id", F.floor(F.log(F.col("number") * F.col("factor")) / BIN).alias("bin"))
        .agg(F.sum("vote").alias("votes"))
    )

    def work(t: pa.Table) -> pa.Table:
        hadm, at, votes = (t.column(c).to_numpy(zero_copy_only=False) for c in ("hadm_id", "bin", "votes"))
        first = change_points([hadm])
        cuts = [*first.tolist(), len(hadm)]
        centre = np.zeros(len(first))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            x, v = at[a:b], votes[a:b]
            total = np.append(0, np.cumsum(v))
            lo, hi = np.searchsorted(x, x - REACH), np.searchsorted(x, x + REACH, side="right")
            score = np.round(total[hi] - total[lo], 9)
            best = int(np.argmax(score))
            lo, hi = lo[best], hi[best]
            half = np.searchsorted(np.cumsum(v[lo:hi]), v[lo:hi].sum() / 2)
            centre[k] = (x[lo:hi][min(half, hi - lo - 1)] + 0.5) * BIN
        return pa.table({"hadm_id": hadm[first], "centre": centre})

    return map_groups(bins, ["hadm_id"], ["bin"], work, "hadm_id bigint, centre double")


def weights_in_kg(chartevents: DataFrame, static_fields: DataFrame, salts: int = 8) -> DataFrame:
    """Every weight row with a number above 0: row_id, hadm_id, itemid, field_unit, number, unit, kg.

    ``chartevents`` needs row_id, hadm_id, itemid, value, valuenum, valueuom; ``static_fields`` field_name and
    itemid. A unit in value decides. Else a unit in valueuom does if its weight agrees with the encounter's;
    else the unit that agrees best does, the field's own first. Rows without a number, of 0 or below, are
    left out; an unknown encounter (null hadm_id) is judged by the row alone; repeated rows all count.

    ``chartevents`` is scanned once: the weight rows, a small share, are written to the shared folder with the
    units that their texts name, and both the votes and the result read them there.
    """
    fields = static_fields.filter(F.col("field_name").isin("weight_kg", "weight_lb", "weight_oz")).select("itemid", F.substring("field_name", 8, 2).alias("field_unit")).na.drop().distinct()
    rows = (
        chartevents.select("row_id", "hadm_id", "itemid", "value", "valuenum", "valueuom")
        .join(fields, "itemid")
        .withColumn("number", reading())
        .filter("number > 0")
    )
    path = f"{shared_folder(chartevents.sparkSession)}/weights"
    named_units(rows).write.parquet(path)
    found = chartevents.sparkSession.read.parquet(path)
    centres = encounter_weights(found).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = found.withColumn("salt", F.pmod(F.coalesce("row_id", F.lit(0)), F.lit(salts)).cast("int"))
    off = {u: F.abs(F.log(F.col("number") * KG_OF[u]) - F.col("centre")) for u in UNITS}
    own = F.coalesce(*[F.when(F.col("field_unit") == u, off[u]) for u in UNITS])
    told = F.coalesce(*[F.when(F.col("in_uom") == u, off[u]) for u in UNITS])
    nearest = F.array_min(F.array(*[F.struct(off[u].alias("d"), F.lit(u).alias("u")) for u in UNITS]))["u"]
    unit = (
        F.when(F.col("in_value").isNotNull(), F.col("in_value"))
        .when(F.col("centre").isNull(), F.coalesce("in_uom", "field_unit"))
        .when(told <= AGREE, F.col("in_uom"))
        .when(own <= AGREE, F.col("field_unit"))
        .otherwise(nearest)
    )
    return (
        salted.join(centres, ["hadm_id", "salt"], "left")
        .withColumn("unit", unit)
        .join(F.broadcast(factors(found)), "unit")
        .select("row_id", "hadm_id", "itemid", "field_unit", "number", "unit", (F.col("number") * F.col("factor")).alias("kg"))
    )
