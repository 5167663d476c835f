"""Queries of the operators of this folder (problems 4, 7, 8 and 9), over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.bpe import encode
from cohortloom.llm.languages import corrections, passages
from cohortloom.llm.leaks import leaked_items, remove_leaks
from cohortloom.llm.pairs import PairTable, code_baskets
from cohortloom.sources.tables import table


def _pair_table(spark: SparkSession, d: str) -> PairTable:
    """Two updates: the diagnoses arrive first, then every basket that has procedures changes."""
    diagnoses, procedures = table(spark, d, "diagnoses_icd"), table(spark, d, "procedures_icd")
    pairs = PairTable(spark)
    first, both = code_baskets(diagnoses, None), code_baskets(diagnoses, procedures)
    pairs.update(None, first)
    pairs.update(first, both)
    return pairs


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pair_table(spark, d).scores().select("code_a", "code_b", "n_ab", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    s = _pair_table(spark, d).scores(least=5)
    wide = [F.col(c).cast("decimal(19,0)") for c in ("n_ab", "total", "n_a", "n_b")]  # products of counts may pass a long
    return s.filter((200 * F.col("n_ab") >= F.col("total")) & (wide[0] * wide[1] >= 3 * wide[2] * wide[3])).select("code_a", "code_b")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return remove_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return corrections(passages(table(spark, d, "documents"), table(spark, d, "lang_samples"))).select("doc_id", "seg", "lang")


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return passages(table(spark, d, "documents"), table(spark, d, "lang_samples"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p4_found, p4_pairs, p7_ids, p8_found, p8_clean, p9_found, p9_passages)}

_BASKETS = """given as (
  select hadm_id, 'd:' || upper(regexp_replace(icd9_code, '[.\\s\\x{A0}]', '', 'g')) as item from diagnoses_icd
  union all select hadm_id, 'p:' || upper(regexp_replace(icd9_code, '[.\\s\\x{A0}]', '', 'g')) from procedures_icd),
baskets as (select distinct hadm_id, item from given where hadm_id is not null and length(item) > 2),
total as (select count(distinct hadm_id) as n from baskets),
items as (select item, count(*) as n from baskets group by item),
pairs as (select a.item as code_a, b.item as code_b, count(*) as n_ab from baskets a join baskets b on a.hadm_id = b.hadm_id and a.item < b.item group by all)"""

ORACLE: dict[str, str] = {
    "p4_found": f"""
with {_BASKETS}
select code_a, code_b from pairs join items x on x.item = code_a join items y on y.item = code_b cross join total t
where n_ab >= 5 and 200 * n_ab >= t.n and n_ab * t.n >= 3 * x.n * y.n""",
    "p4_pairs": f"""
with {_BASKETS}
select code_a, code_b, n_ab, x.n as n_a, y.n as n_b, round(n_ab * t.n / (cast(x.n as double) * y.n), 6) as lift
from pairs join items x on x.item = code_a join items y on y.item = code_b cross join total t""",
}
