"""DuckDB twins of the streaming queries (the batch answer)."""

from __future__ import annotations

from tessera.plans.oracle_profile import NUMERIC_TEXT


def stream_profile(cap: int = 1000) -> str:
    """The big-file summary of all columns of events.  Timestamps never parse
    as numbers, and as they differ when their text does they count as they are."""
    parts = []
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props"):
        text = f"trim(CAST({c} AS VARCHAR))"
        num = f"CASE WHEN regexp_full_match({text}, '{NUMERIC_TEXT}') THEN TRY_CAST({text} AS DOUBLE) END"
        parts.append(f"""SELECT '{c}' AS attribute, count(*) AS n_rows, count(*) FILTER (WHERE coalesce({text}, '') = '') AS n_null,
  count(*) FILTER (WHERE {text} <> '' AND ({num}) IS NULL) AS bad, min({num}) AS lo, max({num}) AS hi,
  count(DISTINCT {num}) AS n_num, count(DISTINCT CASE WHEN {text} <> '' THEN {text} END) AS n_text FROM events""")
    union = "\nUNION ALL\n".join(parts)
    return f"""SELECT attribute, CASE WHEN bad = 0 THEN lo END AS min, CASE WHEN bad = 0 THEN hi END AS max, n_null,
  CASE WHEN n > {cap} THEN '> {cap}' ELSE CAST(n AS VARCHAR) END AS n_uniq, n_null / n_rows AS perc_null, n_rows
FROM (SELECT *, CASE WHEN bad = 0 THEN n_num ELSE n_text END + CAST(n_null > 0 AS INTEGER) AS n FROM ({union}))"""


SQL = {
    "stream_value_counts":
        "SELECT event_type AS value, count(*) AS n FROM events GROUP BY event_type",
    "stream_label_counts":
        "SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type",
    "stream_profile": stream_profile(),
}
