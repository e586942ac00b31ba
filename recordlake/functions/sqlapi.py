"""The most used expressions for SQL users (UD1) and a table function over texts (UD4)."""
from __future__ import annotations

from pyspark.sql import SparkSession

from recordlake.functions import lexicons as lx
from recordlake.functions import text as t


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register_functions(spark: SparkSession) -> list[str]:
    """Creates temporary SQL functions; returns their names."""
    fold = f"translate(lower(s), '{t.ACCENTED}', '{t.BASE}')"
    scalar = {
        "rl_fold": ("s STRING", "STRING", fold),
        "rl_plain": ("s STRING", "STRING", f"trim(regexp_replace({fold}, '[^a-z0-9 ]+', ' '))"),
        "rl_squeeze": ("s STRING", "STRING", f"trim(regexp_replace(s, {_literal('(?U)' + chr(92) + 's+')}, ' '))"),
        "rl_document_id": ("s STRING", "STRING", "substring(sha2(s, 256), 1, 12)"),
        "rl_digit_share": ("s STRING", "DOUBLE",
                           f"length(regexp_replace(s, {_literal('[^' + chr(92) + 'p{Nd}]')}, '')) / greatest(length(s), 1)"),
    }
    for name, (args, returns, body) in scalar.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {returns} RETURN {body}")
    euro, pct = _literal(t.uni(lx.EURO)), _literal(lx.PERCENT)
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION rl_amounts(s STRING)
      RETURNS TABLE(kind STRING, raw STRING) RETURN
      SELECT 'eur', trim(e) FROM explode(regexp_extract_all(s, {euro}, 0)) AS x(e)
      UNION ALL SELECT 'pct', trim(p) FROM explode(regexp_extract_all(s, {pct}, 0)) AS y(p)""")
    return [*scalar, "rl_amounts"]
