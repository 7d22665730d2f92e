"""The report job: options in, named tables out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.blanks import is_blank
from caseloom.operators import group as G
from caseloom.operators import summary as S
from caseloom.operators import topk as K
from caseloom.operators.dedup import distinct_rows
from caseloom.operators.filters import in_state, masked, not_from, organisation, significant
from caseloom.operators.places import region_zips
from caseloom.plans.steps import NAMES, ORDER, SHARED, across_sources, fill_step, scope_step
from caseloom.rules.book import Rule
from caseloom.rules.industries import labels_for
from caseloom.session import materialise
from caseloom.sources.export import write_csv
from caseloom.sources.layout import HOME_STATE, SOURCE
from caseloom.sources.registry import tags_off

# fixed values: request keys, default region and span, columns of each kind of table
REQUIRED = ("target_city", "target_industry", "target_organization", "includeFedData",
            "includeStateJudgements", "includeStateCases", "infer_zip", "prevailing_wage_report",
            "signatories_report", "open_cases_only", "include_tables", "include_summaries",
            "only_sig_summaries", "include_top_viol_tables", "use_assumptions", "infer_by_naics",
            "YEAR_START", "YEAR_END")
HOME = "California"
SPAN_YEARS = 4
FIGURES = ["violtn_cnt", "ee_violtd_cnt", "bw_amt", "records", "ee_pmt_recv"]
HEADER = ["legal_nm", "trade_nm", "cty_nm", *FIGURES, "naics_desc"]
PREVAILING_HEADER = [*HEADER, "juris_or_proj_nm", "Note"]
REPEAT_HEADER = [*HEADER, "street_addr"]
AGENCY_HEADER = [*FIGURES, "juris_or_proj_nm"]
OWNER_HEADER = [*FIGURES, "Jurisdiction_region_or_General_Contractor"]
MULTI_HEADER = [*HEADER, "agencies", "agency_names", "street_addr"]
IDENTIFYING = ["legal_nm", "trade_nm", "street_addr", "case_id_1", "DIR_Case_Name"]


@dataclass(frozen=True)
class ReportOptions:
    target_state: str = ""
    target_county: str = ""
    target_city: str = ""
    target_industry: str = ""
    target_organization: str = ""
    include_federal: bool = False
    include_state_judgements: bool = False
    include_state_cases: bool = False
    infer_zip: bool = False
    infer_by_naics: bool = False
    use_assumptions: bool = True
    open_cases_only: bool = False
    prevailing_wage_report: bool = False
    signatories_report: bool = False
    include_tables: bool = False
    include_summaries: bool = False
    only_significant: bool = False
    include_top_tables: bool = False
    year_start: date | None = None
    year_end: date | None = None

    def normalise(self, as_of: date) -> ReportOptions:
        """Defaults and mutual rules; the most specific region wins."""
        o = self
        if not (o.include_federal or o.include_state_judgements or o.include_state_cases):
            o = replace(o, include_federal=True, include_state_judgements=True, include_state_cases=True)
        if not (o.include_tables or o.include_top_tables):
            o = replace(o, include_top_tables=True)
        if o.only_significant:
            o = replace(o, include_summaries=True)
        if o.include_summaries:
            o = replace(o, include_tables=True)
        if o.include_state_judgements or o.include_state_cases:
            o = replace(o, infer_zip=True, infer_by_naics=True)
        if o.target_city:
            o = replace(o, target_state="", target_county="")
        elif o.target_county:
            o = replace(o, target_state="")
        elif not o.target_state:
            o = replace(o, target_state=HOME)
        start = o.year_start or _years_before(as_of, SPAN_YEARS)
        return replace(o, target_industry=o.target_industry or "All NAICS", year_start=start,
                       year_end=o.year_end or as_of)


def _years_before(day: date, years: int) -> date:
    try:
        return day.replace(year=day.year - years)
    except ValueError:  # 29 February
        return day.replace(year=day.year - years, day=28)


def options_from(request: dict[str, object]) -> ReportOptions:
    """Options of a request; a request that lacks a required key is refused."""
    missing = [k for k in REQUIRED if k not in request]
    if missing:
        raise ValueError("missing: " + ", ".join(missing))

    def on(key: str) -> bool:
        return str(request.get(key, 0)).strip() in ("1", "True", "true")

    def day(key: str) -> date | None:
        text = str(request[key]).strip().replace("/", "-")
        return None if text in ("", "today") else date.fromisoformat(text)

    return ReportOptions(
        str(request.get("target_state", "")), str(request.get("target_county", "")), str(request["target_city"]),
        str(request["target_industry"]), str(request["target_organization"]), on("includeFedData"),
        on("includeStateJudgements"), on("includeStateCases"), on("infer_zip"), on("infer_by_naics"), True,
        on("open_cases_only"), on("prevailing_wage_report"), on("signatories_report"), on("include_tables"),
        on("include_summaries"), on("only_sig_summaries"), on("include_top_viol_tables"), day("YEAR_START"),
        day("YEAR_END"))


@dataclass(frozen=True)
class Lookups:
    """What a report needs besides cases: the tables that turn a region into zips (or the zips
    themselves), and signatory name lists."""

    zips: DataFrame | None = None
    signatories: list[Rule] = field(default_factory=list)
    #: dim_city, dim_county and dim_state as ``region_zips`` takes them
    regions: tuple[DataFrame, DataFrame, DataFrame] | None = None

    def zips_of(self, o: ReportOptions) -> DataFrame | None:
        """Zips of the region asked for; the whole home state needs none."""
        if self.zips is not None or o.target_state == HOME:
            return self.zips
        if self.regions is None:
            raise ValueError(f"no region tables to find {o.target_city or o.target_county or o.target_state} in")
        return region_zips(*self.regions, state=o.target_state, county=o.target_county, city=o.target_city)


def scoped_rows(cases: DataFrame, options: ReportOptions, lookups: Lookups) -> DataFrame:
    """The cases one report is about: of the sources and the region its options name.

    A source that is switched off goes before duplicates across sources are settled, or its
    cases would displace those of the sources that stay.
    """
    o = options
    home = HOME_STATE if o.target_state == HOME else None
    off = tags_off(o.include_federal, o.include_state_cases, o.include_state_judgements)
    return scope_step(cases.where(not_from(SOURCE, off)), lookups.zips_of(o), labels_for(o.target_industry), F.lit(o.year_start), F.lit(o.year_end),
                      lookups.signatories, home_state=home, with_generic=o.infer_zip, by_code_only=not o.infer_by_naics)


def filled_rows(scoped: DataFrame, options: ReportOptions, as_of: date) -> DataFrame:
    return fill_step(scoped, F.lit(as_of), options.use_assumptions, options.open_cases_only)


def presented(filled: DataFrame, o: ReportOptions, lookups: Lookups) -> tuple[DataFrame, DataFrame]:
    """All rows and those of the chosen organisation, names masked, full copies dropped.

    Names are matched before they are masked. Without an organisation the two are one table.
    Rows are unique per (case, violation) by now, so only masking can make copies, and only
    masked rows are compared; with no name lists, or a report that shows them, none are.
    """
    def shown(df: DataFrame) -> DataFrame:
        if o.signatories_report or not lookups.signatories:
            return df
        hidden = masked(df.where("Signatory = 1"), "Signatory", IDENTIFYING)
        return df.where("Signatory <> 1").unionByName(
            distinct_rows(hidden, ignoring=ORDER, order=ORDER, keep="last"))

    rows = shown(filled)
    return rows, shown(filled.where(organisation(NAMES, o.target_organization))) if o.target_organization else rows


#: Tables of repeat groups: the key they are grouped by and what they show.
REPEATS = {
    "repeat_addresses": ("street_addr", REPEAT_HEADER), "repeat_legal_names": ("legal_nm", REPEAT_HEADER),
    "repeat_trade_names": ("trade_nm", REPEAT_HEADER), "repeat_agencies": ("juris_or_proj_nm", AGENCY_HEADER),
    "repeat_owners": ("Jurisdiction_region_or_General_Contractor", OWNER_HEADER),
}

#: What the tables show or group by of an employer's first case.
CARRIED = ["trade_nm", "cty_nm", "zip_cd", "industry", "naics_desc", "street_addr", "juris_or_proj_nm", "Note", "Prevailing", "Signatory",
           "backwage_owed"]


def report_tables(rows: DataFrame, chosen: DataFrame, everything: DataFrame, o: ReportOptions,
                  only: set[str] | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """The tables in report order, or ``only`` some of them. Each reads ``rows`` or ``chosen``, overview and coverage
    ``everything``: the cases of the home state, or roll-ups of them.

    Employers are grouped once per set of rows, with the columns the tables show; ``keep`` holds on
    to what several tables read.
    """
    grouped: dict[int, DataFrame] = {}

    def picked(df: DataFrame, header: list[str]) -> DataFrame:
        header = [*header, "Signatory"] if o.signatories_report and "Signatory" not in header else header
        return df.select(*[f"`{c}`" for c in header if c in df.columns])

    def ranked(df: DataFrame, by: str, tie: str, n: int, header: list[str]) -> DataFrame:
        return K.formatted(picked(K.top(df, by, tie, n), header), ["bw_amt", "ee_violtd_cnt", "ee_pmt_recv", "violtn_cnt"])

    def employers(of: DataFrame) -> DataFrame:
        if id(of) not in grouped:
            grouped[id(of)] = keep(G.group_by_key(of, "legal_nm", ORDER, carry=[c for c in CARRIED if c in of.columns]))
        return grouped[id(of)]

    def agencies(of: DataFrame, **more: list[str]) -> DataFrame:
        return G.multi_agency(of, "legal_nm", "juris_or_proj_nm", ORDER, **more)

    def fine() -> DataFrame:
        return G.sums_by(employers(chosen), ["cty_nm", "zip_cd", "industry", "legal_nm"], [*FIGURES, "backwage_owed"])

    def cities() -> DataFrame:
        per_city = S.city_summary(G.sums_by(fine(), ["cty_nm", "legal_nm"], [*FIGURES, "backwage_owed"]),
                                  agencies(chosen, within=["cty_nm"]))
        return per_city.where(significant("cases", "stolen")) if o.only_significant else per_city

    def violators(flag: str) -> DataFrame:
        return employers(rows).where(F.col(flag) == 1)

    overall: list[tuple[DataFrame, DataFrame]] = []

    def whole(part: int) -> DataFrame:
        if not overall:
            overall.append((S.overview_and_coverage_of if "first" in everything.columns else S.overview_and_coverage)(everything, keep))
        return overall[0][part]

    repeated: list[DataFrame] = []

    def repeats() -> DataFrame:
        """All five tables of repeat groups at once."""
        if not repeated:
            repeated.append(keep(G.repeat_tables(rows, [key for key, _ in REPEATS.values()], ORDER, K.TOP_REPEATS)))
        return repeated[0]

    def two_way(df: DataFrame, outer: str, inner: str, label: str) -> DataFrame:
        return K.two_way(G.subtotals(df, outer, inner, FIGURES, label), outer, inner, label, FIGURES)

    make: dict[str, Callable[[], DataFrame]] = {
        "overview": lambda: whole(0),
        "coverage": lambda: whole(1),
        "summary": lambda: S.report_summary(chosen, employers(chosen), agencies(chosen)),
        "date_range": lambda: chosen.agg(F.min("findings_start_date").alias("first"), F.max("findings_start_date").alias("last")),
        "totals": lambda: S.totals(chosen, {"ee_violtd_cnt": "employees", "bw_amt": "back_wages", "violtn_cnt": "violations"}),
        "status": lambda: S.status_shares(chosen, "Case Status").orderBy(F.desc("cases"), "status"),
        "cases": lambda: chosen,
    }
    if o.include_tables:
        make["by_industry_and_city"] = lambda: two_way(employers(chosen), "industry", "cty_nm", "COUNTYWIDE")
        make["by_zip_and_industry"] = lambda: two_way(employers(chosen), "zip_cd", "industry", "ZIPCODEWIDE")
    if o.include_summaries:
        make["cities"] = cities
        make["zips"] = lambda: S.zip_summary(fine(), labels_for(o.target_industry) is None)
        make["by_city_and_industry"] = lambda: two_way(fine(), "cty_nm", "industry", "CITYWIDE")
    if o.include_top_tables:
        for name, by in (("top_by_amount", "bw_amt"), ("top_by_employees", "ee_violtd_cnt"), ("top_by_records", "records")):
            make[name] = lambda by=by: ranked(employers(rows), by, "legal_nm", K.TOP_VIOLATORS, HEADER)
        for name, (key, header) in REPEATS.items():
            make[name] = lambda key=key, header=header: ranked(G.repeats_of(repeats(), key), "records", key, K.TOP_REPEATS, header)
        make["multi_agency"] = lambda: ranked(agencies(rows, carry=["trade_nm", "cty_nm", "naics_desc", "street_addr"]),
                                              "records", "legal_nm", K.TOP_REPEATS, MULTI_HEADER)
    for flag, wanted in (("Prevailing", o.prevailing_wage_report), ("Signatory", o.signatories_report)):
        if wanted:
            make[f"{flag.lower()}_headline"] = lambda flag=flag: S.headline(violators(flag))
            make[f"{flag.lower()}_violators"] = lambda flag=flag: K.listing(
                picked(violators(flag), [*PREVAILING_HEADER, flag]), "legal_nm")
    return {name: table() for name, table in make.items() if only is None or name in only}


class Report(dict[str, DataFrame]):
    """Tables by name, and what they are drawn from until it is released."""

    def __init__(self, tables: dict[str, DataFrame], kept: list[DataFrame]) -> None:
        super().__init__(tables)
        self.kept = kept

    def release(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()


def build_report(cases: DataFrame, options: ReportOptions, as_of: date, lookups: Lookups | None = None,
                 reliable: bool = False, only: set[str] | None = None, rolled: DataFrame | None = None) -> Report:
    """Named tables of one report, in order.

    ``rolled``, from ``read_rollup``, has the cases that no other source reports rolled up; with it overview and
    coverage read some hundred rows and the cases that several sources report, not the whole home state.

    The cases in scope are settled once, since filling gaps reads them for its means and again
    for its rows; so are the rows on show and their employers, which two dozen aggregates read.
    ``release`` lets go of them when the tables are written.
    """
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(materialise(df, reliable))
        return kept[-1]

    o = options.normalise(as_of)
    lookups = lookups or Lookups()
    rows, chosen = presented(filled_rows(keep(scoped_rows(cases, o, lookups)), o, as_of), o, lookups)
    same = rows is chosen
    rows = keep(rows)
    chosen = rows if same else keep(chosen)
    home = in_state("st_cd", HOME_STATE)
    if rolled is None or SHARED not in cases.columns:
        everything = across_sources(cases.where(home))
    else:
        # whether ids and violations are given at all is asked of all cases; only the marked ones are read for more
        reported_twice = across_sources(cases.where(home)).where(F.col(SHARED) == 1)
        everything = rolled.where(home).select("cases", *S.ROLLED, "first", "last").unionByName(S.roll_up(reported_twice, []))
    return Report(report_tables(rows, chosen, everything, o, only, keep), kept)


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Writes every table, then lets go of what they were drawn from."""
    for name, table in tables.items():
        write_csv(table, f"{path}/{name}")
    if isinstance(tables, Report):
        tables.release()


def has_records(rows: DataFrame, key: str = "legal_nm") -> bool:
    """Whether there is anything to report; reads until the first such row."""
    return bool(rows.where(~is_blank(key)).limit(1).count())
