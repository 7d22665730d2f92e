"""The canonical case table: columns, types, defaults, and the headers that feed them."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, COUNT, AMOUNT = T.StringType(), T.DoubleType(), T.DecimalType(18, 2)

# order of rows: the source's rank, then the position in its files
ROW = "_row"
SOURCE = "source"
# where a landed row was read: file, part of the file, and a number that grows inside the part without gaps
PART = ("_path", "_block")
PLACE = (*PART, "_at")

# fixed values: canonical columns with type and default
COLUMNS: dict[str, tuple[T.DataType, object]] = {
    "case_id_1": (TEXT, ""), "juris_or_proj_nm": (TEXT, ""),
    "Jurisdiction_region_or_General_Contractor": (TEXT, ""), "legal_nm": (TEXT, ""),
    "trade_nm": (TEXT, ""), "Businesstype": (TEXT, ""), "Liabilitytype": (TEXT, ""),
    "street_addr": (TEXT, ""), "cty_nm": (TEXT, ""), "st_cd": (TEXT, ""), "zip_cd": (TEXT, "0"),
    "naic_cd": (TEXT, ""), "naics_desc": (TEXT, ""), "industry": (TEXT, ""), "trade2": (TEXT, ""),
    "violation": (TEXT, ""), "violation_code": (TEXT, ""), "violtn_cnt": (COUNT, 0),
    "ee_violtd_cnt": (COUNT, 0), "bw_amt": (AMOUNT, 0), "ee_pmt_recv": (AMOUNT, 0),
    "cmp_assd_cnt": (AMOUNT, 0), "Interest_Payments_Recd": (AMOUNT, 0), "interest_owed": (AMOUNT, 0),
    "wages_owed": (AMOUNT, 0), "backwage_owed": (AMOUNT, 0), "findings_start_date": (T.DateType(), None),
    "findings_end_date": (T.DateType(), None), "Case Status": (TEXT, ""), "Case Stage": (TEXT, ""),
    "Closure Disposition": (TEXT, ""), "Closure Disposition - Other Reason": (TEXT, ""),
    "Reason For Closing": (TEXT, ""), "Note": (TEXT, ""), "Prevailing": (T.IntegerType(), 0),
    "Signatory": (T.IntegerType(), 0), "signatory_industry": (TEXT, ""), "dbra_cl_violtn_cnt": (COUNT, 0),
}

# fixed values: source headers that carry a canonical column as it is
RENAMED: dict[str, str] = {
    "trade": "industry",
    "case_violtn_cnt": "violtn_cnt",
    "Jurisdiction_or_Project_Name": "juris_or_proj_nm",
    "Primary Address City": "cty_nm",
    "Primary Address State": "st_cd",
    "NAICS Code": "naic_cd",
    "naics_desc.": "naics_desc",
    "Interest Payments Rec'd": "Interest_Payments_Recd",
    "Case Issue Type": "violation",
    "DIR Office": "Jurisdiction_region_or_General_Contractor",
}

# fixed values: alternative headers of a text column, in the order they are consulted
FILLED: dict[str, tuple[str, ...]] = {
    "case_id_1": ("case_id_1", "Case Number", "case_id", "Case #:", "Judgment Name", "DIR_Case_Name"),
    "trade_nm": ("trade_nm", "Account - DBA", "Sub Contractor"),
    "legal_nm": ("legal_nm", "Employer", "legal_name", "Defendant Name", "Defendant/Employer Name",
                 "Prime Contractor"),
    "street_addr": ("street_addr", "street_addr_1_txt", "Primary Address Street", "Defendant Address"),
    "naics_desc": ("naics_desc", "NAICS Code Title", "NAICS Industry", "Industry (NAICS)",
                   "naics_code_description"),
    "Case Status": ("Case Status", "Case Stage", "Closure Disposition", "Judgment Status"),
    "findings_start_date": ("findings_start_date", "Date of Docket", "Date Filed", "Date Docketed:",
                            "Judgment Entry Date"),
    "findings_end_date": ("findings_end_date", "Case Closed Date", "Date Closed:"),
}

# fixed values: alternative amounts, of which the largest or the first non-zero one counts
LARGEST = {"bw_amt": ("bw_amt", "Judgment Total", "bw_atp_amt", "EE(s) Amt Assessed")}
NONZERO = {"ee_pmt_recv": ("ee_pmt_recv", "EE Payments Rec'd", "total_CWPA_amount_collected",
                           "EE_Payments_Received")}

# fixed values: columns known to be wrong at the source
UNUSED = ("Balance Due to Employee(s)", "Interest Balance Due")

# fixed values: sources that only hold cases of the home state, and that state
HOME_SOURCES = ("DLSE_J-23", "DLSE_J-5413", "DLSE_WageClaim", "DIR_DLSE", "DLSE")
HOME_STATE = "CA"

# fixed values: measures cleaned as numbers
MEASURED = ("bw_amt", "ee_violtd_cnt", "ee_pmt_recv", "Interest_Payments_Recd", "cmp_assd_cnt",
            "violtn_cnt", "dbra_cl_violtn_cnt")
