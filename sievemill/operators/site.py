"""Site rollup: one row per site from page reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def _any(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def _domains(df: DataFrame, by: list[str], name: str, values: Column) -> DataFrame:
    """One row per site with its distinct values: duplicates go before anything is collected."""
    distinct = df.select(*by, F.explode(values).alias("v")).distinct()
    return distinct.groupBy(*by).agg(F.array_sort(F.collect_list("v")).alias(name))


def rollup(reports: DataFrame, site: str | None = None) -> DataFrame:
    """One row of 22 features per site (column site), or for all reports as one site, also when there are none.

    Counts and flags are partial aggregates, so a large site is no large group; domains are made distinct by
    (site, domain) first.  reports is read once for each list of domains and once for the rest: keep it.
    """
    by = [site] if site else []
    if not site:
        reports = reports.withColumn("_all", F.lit(1))
    keys = by or ["_all"]
    w, s, t = (F.col(f"{x}.features") for x in ("web_code", "scripts", "text"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    numbers = reports.groupBy(*by) if by else reports.groupBy()
    out = numbers.agg(
        *([] if by else [F.lit(1).alias("_all")]),
        F.count(F.lit(1)).alias("page_count"),
        total(w["form_count"]).alias("form_count"),
        F.count_if(w["has_off_domain_form_action"]).alias("pages_with_off_domain_form_action"),
        _any(w["has_password_form"]).alias("any_password_form"),
        _any(w["has_payment_form"]).alias("any_payment_form"),
        _any(w["has_insecure_form_action"]).alias("any_insecure_form_action"),
        F.count_if(w["has_meta_refresh"]).alias("pages_with_meta_refresh"),
        F.count_if(w["meta_refresh_off_domain"]).alias("pages_with_meta_refresh_off_domain"),
        F.count_if(w["hidden_element_count"] > 0).alias("pages_with_hidden_elements"),
        F.coalesce(F.max(s["max_suspicious_score"]), F.lit(0)).alias("max_suspicious_script_score"),
        _any(s["uses_eval"]).alias("any_eval_script"),
        _any(s["uses_redirect"]).alias("any_redirect_script"),
        *[total(t[f"{x}_hit_count"]).alias(f"total_{x}_hits") for x in ("urgency", "money", "credential", "threat")],
        _any(t["has_zero_width"]).alias("any_zero_width_text"),
        _any(t["mixed_script_word_count"] > 0).alias("any_mixed_script_text"),
    )
    external = F.filter("scripts.external_scripts", lambda e: e["off_domain"])
    lists = {
        "external_script_domains": F.transform(external, lambda e: e["domain"]),
        "known_tracker_domains": F.transform(F.filter(external, lambda e: e["origin"] == "known-tracker"), lambda e: e["domain"]),
        "third_party_resource_domains": F.col("web_code.resources.third_party_domains"),
        "external_link_domains": F.col("web_code.links.external_domains"),
    }
    for name, values in lists.items():
        out = out.join(_domains(reports, keys, name, values), keys, "left")
    return out.withColumns({n: F.coalesce(n, F.array().cast("array<string>")) for n in lists}).drop("_all")
