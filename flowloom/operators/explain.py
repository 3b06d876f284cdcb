"""What speaks for an alert, as numbers and as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.config import SETTINGS

# The wording of reports, which must equal that of reports they are compared with.
ACTION = "Review session; correlate source IP against recent alerts."


def top_attributions(values: Column, k: int = SETTINGS.explain_top_k) -> Column:
    """The k entries of greatest absolute value of a map name -> attribution, as (name, value), ties by name."""
    entries = F.map_entries(values)
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("name"), e["value"].alias("value"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))


def listed(pairs: Column) -> Column:
    """`name(+0.123), ...` of (name, value) pairs."""
    return F.array_join(F.transform(pairs, lambda e: F.format_string("%s(%+.3f)", e["name"], e["value"])), ", ")


def path_text(edges: Column) -> Column:
    """`A -> B(w=0.12) -> C(w=0.30)` of (src, dst, weight) in order, or the single-event mark."""
    steps = F.transform(edges, lambda e: F.format_string("%s(w=%.2f)", e["dst"], e["weight"]))
    return F.when(F.size(edges) == 0, "<single-event session>").otherwise(F.concat_ws(" -> ", F.array(F.get(edges, F.lit(0))["src"]), steps))


def alert_report(df: DataFrame, action: str = ACTION) -> DataFrame:
    """(session_id, report); df has session_id, risk, tier, predicted_class, forest_top, boosting_top, token_top, path, sp_t, tc_t."""
    text = F.concat_ws(
        "\n",
        F.format_string("Alert for Session %s (%s)", "session_id", "predicted_class"),
        F.format_string("  Risk_t: %.3f [%s]", "risk", "tier"),
        F.concat(F.lit("  RF top features:   "), listed(F.col("forest_top"))),
        F.concat(F.lit("  XGBoost top features: "), listed(F.col("boosting_top"))),
        F.concat(F.lit("  LSTM token attributions: "), listed(F.col("token_top"))),
        F.format_string("  Sequential pattern prior SP_t: %.3f", "sp_t"),
        F.format_string("  Temporal consistency TC_t: %.3f", "tc_t"),
        F.concat(F.lit("  Graph path: "), path_text(F.col("path"))),
        F.lit(f"  Recommended action: {action}"),
    )
    return df.select("session_id", text.alias("report"))
