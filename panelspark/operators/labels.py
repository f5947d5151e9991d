"""Display names, groups and name matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.session import written

# Components of a decomposition that are not shocks.
NON_SHOCKS = ("mean", "initial_conditions", "Initial_values", "constant")
INITIAL = ("Initial_values", "initial_conditions")

# Display names of the policy table.
POLICY_LABELS = {
    "y": "PIB total (y)",
    "y_m": "Output formal (y_m)",
    "y_u": "Output informal (y_u)",
    "underground_share": "Quota submergida (y_u/y)",
    "c": "Consum (c)",
    "inv": "Inversió (inv)",
    "G_c": "Recaptació IS (G_c)",
    "G_h": "Recaptació IRPF (G_h)",
    "G_s": "Cotitzacions (G_s)",
    "TE": "Evasió fiscal (TE)",
    "G_total": "Recaptació total (G)",
    "ecv": "ECV benestar (%)",
}
# Shock groups of the historical decomposition, in stacking order.
SHOCK_GROUPS = [
    ("Productivitat", ["eps_a", "eps_b"]),
    ("Fiscal", ["eps_c", "eps_h", "eps_s"]),
    ("Inspeccio", ["eps_p"]),
    ("Tecnologia inv.", ["eps_x"]),
    ("Laboral", ["eps_xi_h"]),
]
SHOCKS = [code for _, codes in SHOCK_GROUPS for code in codes]
# Parameter groups of the estimation report.
PARAM_GROUPS = {
    "structural": ["alpha", "delta_k", "alpha_u", "phi", "xi", "gamma_pct", "p_ss"],
    "persistence": ["rho_a", "rho_b", "rho_c", "rho_s", "rho_h", "rho_xi_h", "rho_x", "rho_p"],
    "variance": ["var_eps_a", "var_eps_b", "var_eps_c", "var_eps_s", "var_eps_h", "var_eps_xi_h",
                 "var_eps_x", "var_eps_p"],
}


def lookup(col: Column, table: dict) -> Column:
    """Value of a driver-side table at ``col``; null for unknown codes."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), col)


def relabel(df: DataFrame, col: str, labels: dict | DataFrame, name: str = "label", key: str = "code",
            text: str = "label") -> DataFrame:
    """Code to display name; a code without a name keeps itself.

    A dict becomes a map literal.  A DataFrame ``(code, label)`` of any size is
    joined, and Spark broadcasts it only if its files are small enough.
    """
    if isinstance(labels, dict):
        return df.withColumn(name, F.coalesce(lookup(F.col(col), labels), F.col(col)))
    names = labels.select(F.col(key).alias("_code"), F.col(text).alias("_text"))
    joined = df.join(names, df[col] == names["_code"], "left")
    return joined.withColumn(name, F.coalesce(F.col("_text"), F.col(col))).drop("_code", "_text")


def select_params(draws: DataFrame, groups: dict | DataFrame, col: str = "param") -> DataFrame:
    """Keep the parameters named in ``groups`` and label each with its group.

    ``groups`` is a dict of lists, or a table ``(param, group)``; a parameter of several groups of a table comes once in each.
    """
    if isinstance(groups, DataFrame):
        members = written(groups.select(F.col("param").alias(col), "group").distinct(), "groups")    # one row per parameter and group
        return draws.join(members, col).select(*draws.columns, "group")
    member = {p: g for g, ps in groups.items() for p in ps}
    return draws.filter(F.col(col).isin(*member)).withColumn("group", lookup(F.col(col), member))


def is_component_shock(col: Column) -> Column:
    return ~col.isin(*NON_SHOCKS)


def match_shock_name(col: Column, canonical: list) -> Column:
    """Canonical name of a decorated one (``eps_a₍ₓ₎`` to ``eps_a``), or null.

    The name must start with the canonical one and continue only with
    decoration (no letter, digit or underscore); the longest match wins.
    """
    names = F.array(*[F.lit(c) for c in canonical])

    def fits(c: Column) -> Column:
        rest = F.substring(col, F.length(c) + 1, F.length(col))
        return F.startswith(col, c) & ~rest.rlike("[A-Za-z0-9_]")

    longest = F.array_max(F.transform(
        F.filter(names, fits), lambda c: F.struct(F.length(c).alias("len"), c.alias("name"))))
    return longest["name"]
