"""The text functions as temporary SQL functions, so plain ``spark.sql`` users have them; no Python runs in them."""
from __future__ import annotations

from pyspark.sql import SparkSession

from dossierflow.functions.text import ABBREVIATION_DOT, SENTENCE_BREAK, STOPWORDS


def register(spark: SparkSession) -> None:
    quoted = lambda p: "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"
    held = f"regexp_replace(trim(s), {quoted(ABBREVIATION_DOT)}, '$1$2\u0001')"
    words = "filter(split(df_norm(s), ' '), w -> w <> '')"
    define = {
        "df_norm(s STRING) RETURNS STRING": r"trim(regexp_replace(lower(s), '[^\\p{L}\\p{N}]+', ' '))",
        "df_words(s STRING) RETURNS ARRAY<STRING>": words,
        "df_stem(s STRING) RETURNS STRING": "regexp_replace(s, '(?:ing|ed|es|s|en|n)$', '')",
        "df_has_word(s STRING, w STRING) RETURNS BOOLEAN": "contains(concat(' ', df_norm(s), ' '), concat(' ', df_norm(w), ' '))",
        "df_sentence_count(s STRING) RETURNS INT": f"size(filter(split(regexp_replace({held}, {quoted(SENTENCE_BREAK)}, '$1\u0002$2'), '\u0002'), x -> trim(x) <> ''))",
    }
    for lang, stop in STOPWORDS.items():
        listed = ", ".join("'" + w + "'" for w in stop)
        define[f"df_votes_{lang}(s STRING) RETURNS INT"] = rf"size(filter(split(lower(s), '[^\\p{{L}}]+'), w -> w IN ({listed})))"
    for head, body in define.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
