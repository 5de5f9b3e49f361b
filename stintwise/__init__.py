"""stintwise: seasonal performance analytics on Spark DataFrames."""

from .spec import BASKETBALL, CUSTOMER, SUPPLIER, Measure, SeasonSpec

__all__ = ["BASKETBALL", "CUSTOMER", "SUPPLIER", "Measure", "SeasonSpec"]
