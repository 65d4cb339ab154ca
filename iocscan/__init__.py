"""Indicator-of-compromise scanning on Spark DataFrames.

``scan`` matches a DataFrame of artifacts (files, or any table with a path and
a content column) against content rules, filename patterns, a watch-list of
names and a list of digests, and returns one DataFrame of findings.
"""

from iocscan.api import ScanResult, scan
from iocscan.session import prepare

__all__ = ["ScanResult", "prepare", "scan"]
