"""The refresh job: land the agency files, clean and label them, write a snapshot."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.dedup import shared_keys
from caseloom.operators.places import Place
from caseloom.operators.summary import roll_up
from caseloom.plans.steps import CROSS, ORDER, SHARED, clean_values, infer_step, mark_cross_source, settle_duplicates
from caseloom.rules.book import Rule
from caseloom.rules.industries import all_industries
from caseloom.sources import snapshot as S
from caseloom.sources.harmonise import harmonise, tagged
from caseloom.sources.readers import number_placed, read_placed
from caseloom.sources.registry import SourceSpec


def land(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """One source in canonical columns, tagged, each row with its place in the files."""
    return harmonise(tagged(read_placed(spark, spec.path, spec.encoding, spec.multi_line), spec.tag))


def _labelled(spark: SparkSession, spec: SourceSpec, raw: str, work: str, places: list[Place], industries: list[Rule],
              loose: bool, flag_only: bool) -> DataFrame:
    """A landed source cleaned and labelled, each half written: what compares rows reads them three times.

    Row numbers come from the landed copy, so they are settled before any "first" row is chosen, the files are
    read once, and a lost executor repeats no parsing.
    """
    landed = S.write_rows(land(spark, spec), raw)
    cleaned = S.write_rows(clean_values(number_placed(landed, spec.rank), loose), f"{work}/cleaned")
    kept = settle_duplicates(cleaned, flag_only, split=True)
    return S.write_rows(S.with_start_year(infer_step(kept, places, industries)), f"{work}/labelled")


def _remarked(rows: DataFrame, known: DataFrame) -> DataFrame | None:
    """The rows of a source with new marks, or None if the ones they have still hold."""
    narrow = rows.select(*CROSS, *ORDER, rows[SHARED].alias("_was"))
    if mark_cross_source(narrow, known).where(f"_was != {SHARED}").isEmpty():
        return None
    return mark_cross_source(rows.drop(SHARED), known)


def refresh_snapshot(spark: SparkSession, root: str, specs: list[SourceSpec], as_of: date,
                     places: list[Place] | None = None, industries: list[Rule] | None = None,
                     max_age_days: int = S.MAX_AGE_DAYS, force: bool = False, loose: bool = False,
                     keep: int = 2, flag_only: bool = False) -> S.Snapshot:
    """The current snapshot, with every source renewed that is missing, too old, or made from other files or
    settings than it would be now; ``force`` renews all.

    Only such sources are landed, cleaned and labelled. Which cases several sources report is counted over the keys of
    all; a source that is not renewed is rewritten, from its own labelled rows, only if that changes one of its
    marks, and else carried over as it lies. Sources that are no longer asked for are left out. With ``flag_only`` no
    duplicate goes: the rows carry the flags of ``clean_step`` instead.

    Every run writes folders of its own, so no reader meets a half-written state and nothing of an
    earlier run of the same day survives in it. The new snapshot is registered when it is complete;
    only then do folders go that none but older snapshots than the ``keep`` newest use, and those that served this run alone.
    """
    places, industries = places or [], industries or all_industries()
    wanted = {s.tag: s for s in specs if s.include}
    current = S.latest(spark, root)
    old = {s.tag: s for s in current.sources} if current else {}
    prints = {t: S.fingerprint(spark, s.path, repr((s, loose, flag_only, places, industries))) for t, s in wanted.items()}

    def due(tag: str) -> bool:
        known = old.get(tag)
        return force or known is None or known.fingerprint != prints[tag] or as_of - known.taken_on > timedelta(days=max_age_days)

    renewed = [t for t in wanted if due(t)]
    if current and not renewed and set(old) == set(wanted):
        return current
    if not wanted:
        raise ValueError("no source is switched on")
    run = S.new_run(as_of)
    raw, work, cases = (f"{root}/{kind}/{run}" for kind in ("raw", "unique", "cases"))
    tables = {t: _labelled(spark, wanted[t], f"{raw}/{t}", f"{work}/{t}", places, industries, loose, flag_only) if t in renewed else old[t].read(spark)
              for t in wanted}
    known = S.write_rows(shared_keys(list(tables.values()), CROSS), f"{work}/shared")
    states = []
    for tag, rows in tables.items():
        marked = mark_cross_source(rows, known) if tag in renewed else _remarked(rows, known)
        if marked is None:
            states.append(old[tag])
            continue
        S.write_partitioned(marked, f"{cases}/{tag}", S.CASES_BY)
        taken, landed = (as_of, f"{raw}/{tag}") if tag in renewed else (old[tag].taken_on, old[tag].raw)
        # a roll-up has one row per state and year, whatever the number of cases
        rolled = S.write_rows(roll_up(spark.read.schema(marked.schema).parquet(f"{cases}/{tag}").where(F.col(SHARED) == 0), list(S.ROLLED_BY)).coalesce(1),
                              f"{root}/rolled/{run}/{tag}")
        states.append(S.SourceState(tag, prints[tag], taken, f"{cases}/{tag}", landed, marked.schema.json(), f"{root}/rolled/{run}/{tag}", rolled.schema.json()))
    snapshot = S.Snapshot(as_of, cases, raw, tuple(states))
    S.register(spark, root, snapshot, run)
    S.remove(spark, [work])
    S.expire(spark, root, keep)
    return snapshot
