"""Wages, interest and balances. Null amounts stay null; nothing is clipped into existence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseloom.functions.numbers import money

# fixed values: yearly rate, days a year is counted as, overpayment tolerance, rounding slack
YEARLY_RATE = 0.07
DAYS_PER_YEAR = 365
OPEN_BALANCE_RATIO = "1.05"
OPEN_BALANCE_SLACK = "-0.001"


def floor_zero(c: Column) -> Column:
    """Negative becomes zero; null stays null (``greatest`` would turn it into zero)."""
    return F.when(c < 0, F.lit(0)).otherwise(c)


def wages_owed(amount: Column | str = "bw_amt", paid: Column | str = "ee_pmt_recv") -> Column:
    return floor_zero(money(amount) - money(paid))


def interest_owed(owed: Column, days: Column, paid: Column) -> Column:
    """Daily compound interest up to the reporting date, less interest already paid."""
    growth = F.pow(F.lit(1 + YEARLY_RATE / DAYS_PER_YEAR), days)
    accrued = owed.cast("double") * growth - owed.cast("double")
    return money(floor_zero(accrued - floor_zero(paid).cast("double")))


def total_owed(wages: Column, penalty: Column, interest: Column) -> Column:
    return wages + penalty + interest


def still_open(amount: Column, paid: Column) -> Column:
    """More than five percent is still owed, and the balance is not negative."""
    amount, paid = (F.coalesce(money(c), F.lit(0).cast("decimal(18,2)")) for c in (amount, paid))
    return ((amount >= paid * F.lit(OPEN_BALANCE_RATIO).cast("decimal(3,2)"))
            & (amount - paid >= F.lit(OPEN_BALANCE_SLACK).cast("decimal(4,3)")))
