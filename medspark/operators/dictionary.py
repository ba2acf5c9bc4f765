"""Star-joined product dictionary.

A fact-like base table LEFT JOINed to lookups; the same lookup may be joined
several times under different aliases (unit of measure: unit, unit dose,
strength numerator, strength denominator).  Catalyst does not remove unused
left joins, so the builder only adds the lookups whose columns are asked for.
Lookup sides are left to the planner: broadcast when small by its size
estimate or by AQE's runtime statistics, shuffle join otherwise.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Lookup:
    """One LEFT JOIN: ``on`` maps qualified left columns ("a.id") to the
    lookup's key names; ``take`` maps lookup columns to output names."""
    alias: str
    table: DataFrame
    on: Mapping[str, str]
    take: Mapping[str, str] = field(default_factory=dict)


def star_join(base: DataFrame, base_alias: str, base_take: Mapping[str, str], lookups: Sequence[Lookup],
              columns: Sequence[str] | None = None, cast_to_string: Sequence[str] = ()) -> DataFrame:
    """``base LEFT JOIN l1 ... LEFT JOIN ln`` selecting aliased columns.

    ``columns`` (output names) restricts the result; lookups contributing no
    requested column and not needed by a later lookup's key are skipped.
    """
    wanted = set(columns) if columns is not None else None
    needed_aliases: set[str] = set()
    for lk in reversed(lookups):
        uses = wanted is None or any(o in wanted for o in lk.take.values()) or lk.alias in needed_aliases
        if uses:
            needed_aliases.add(lk.alias)
            needed_aliases.update(k.split(".", 1)[0] for k in lk.on)
    out = base.alias(base_alias)
    selected = [(f"{base_alias}.{src}", dst) for src, dst in base_take.items()]
    for lk in lookups:
        if lk.alias not in needed_aliases:
            continue
        t = lk.table.alias(lk.alias)
        cond = None
        for left_col, right_col in lk.on.items():
            c = F.col(left_col) == F.col(f"{lk.alias}.{right_col}")
            cond = c if cond is None else cond & c
        out = out.join(t, cond, "left")
        selected += [(f"{lk.alias}.{src}", dst) for src, dst in lk.take.items()]
    cols = []
    for src, dst in selected:
        if wanted is not None and dst not in wanted:
            continue
        c = F.col(src)
        if dst in cast_to_string:
            c = c.cast("string")
        cols.append(c.alias(dst))
    return out.select(*cols)


def product_dictionary(vmp: DataFrame, dform: DataFrame, form: DataFrame, dfindicator: DataFrame,
                       unitofmeasure: DataFrame, vpi: DataFrame, vtm: DataFrame, bnf: DataFrame,
                       columns: Sequence[str] | None = None) -> DataFrame:
    """J1 with the dm+d layout: product, form, form indicator, unit of measure
    (four roles), ingredient strength (fans out per ingredient), moiety and
    the prescribing-name lookup.  Product ids are output as text (P2)."""
    lookups = [
        Lookup("b", dform, {"a.id": "vmp"}, {"form": "form_cd"}),
        Lookup("c", form, {"b.form": "cd"}, {"descr": "form_descr"}),
        Lookup("d", dfindicator, {"a.df_ind": "cd"}, {"descr": "df_descr"}),
        Lookup("e", unitofmeasure, {"a.udfs_uom": "cd"}, {"descr": "udfs_descr"}),
        Lookup("f", unitofmeasure, {"a.unit_dose_uom": "cd"}, {"descr": "unit_dose_descr"}),
        Lookup("g", vpi, {"a.id": "vmp"}, {"strnt_nmrtr_val": "strnt_nmrtr_val",
                                           "strnt_dnmtr_val": "strnt_dnmtr_val"}),
        Lookup("h", unitofmeasure, {"g.strnt_nmrtr_uom": "cd"}, {"descr": "strnt_nmrtr_uom"}),
        Lookup("i", unitofmeasure, {"g.strnt_dnmtr_uom": "cd"}, {"descr": "strnt_dnmtr_descr"}),
        Lookup("j", vtm, {"a.vtm": "id"}, {"nm": "vtmnm"}),
        Lookup("k", bnf, {"a.bnf_code": "presentation_code"}, {"presentation": "bnf_presentation"}),
    ]
    base_take = {"id": "vmp_snomed_code", "nm": "vmp_product_name", "vtm": "vtmid", "df_ind": "df_ind_cd",
                 "udfs": "udfs", "bnf_code": "bnf_code"}
    return star_join(vmp, "a", base_take, lookups, columns, cast_to_string=("vmp_snomed_code",))
