"""From a CSV file to a synthetic CSV, a summary CSV and a text report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from twinframe.operators.profile import ColumnProfile, apply_types, collect_profile, profile_text, split_by_kind
from twinframe.plans.report import FidelityReport, fidelity_report
from twinframe.plans.synthesize import synthesize
from twinframe.sources.csv import ROW_INDEX, output_paths, read_csv, write_csv, write_text
from twinframe.sources.scratch import release, scratch_scope


@dataclass(frozen=True)
class LooseTable:
    """An imported CSV: typed rows with ``row_idx``, and the profile that typed them."""

    rows: DataFrame
    profile: DataFrame
    columns: list[ColumnProfile]


def import_csv(spark: SparkSession, path: str, sep: str = ",", multi_line: bool | None = None) -> LooseTable:
    """Read, clean, profile and type a CSV; fails when any row is malformed.

    The typed rows are written once, so that what follows reads columns instead of text; the text
    itself isn't kept.
    """
    with scratch_scope(spark) as keep:
        raw = read_csv(spark, path, sep, multi_line)
        profiled = keep(profile_text(raw, ROW_INDEX))
        columns = collect_profile(profiled)
        return LooseTable(keep(apply_types(raw, columns)), profiled, columns)


def synthesize_table(loose: LooseTable, target_size: int, seed: int, **search: object) -> DataFrame:
    """A synthetic copy of an imported table, written once: sinks and report read the same rows.

    What the search writes on its way is deleted with it.
    """
    names = [c.column for c in loose.columns]
    numeric, _ = split_by_kind(loose.columns)
    with scratch_scope(loose.rows.sparkSession) as keep:
        return keep(synthesize(loose.rows, target_size, seed, [ROW_INDEX], names, numeric=numeric, **search))


def synthesize_csv(
    spark: SparkSession, path: str, target_size: int, seed: int, folder: str, sep: str = ","
) -> FidelityReport:
    """Import a CSV, synthesize ``target_size`` rows, compare, and write all three results."""
    loose = import_csv(spark, path, sep)
    made = synthesize_table(loose, target_size, seed)
    report = fidelity_report(loose.rows, made, profiled=loose.profile)
    paths = output_paths(folder, path)
    write_csv(made, paths["synthetic"])
    write_text(report.text(), paths["report"])
    # one row per column, in header order
    write_csv(report.stats_summary_text().orderBy("ordinal").coalesce(1).drop("ordinal"), paths["summary"])
    return report


def reset(spark: SparkSession, *tables: DataFrame) -> None:
    """Drop what executors hold of the given tables, and delete all intermediate tables of the run.

    Results written by the sinks stay; imported and synthesized tables can't be read any more.
    """
    for table in tables:
        table.unpersist()
    release(spark)
