"""Columns of stock and industry snapshots, with the names they have in files and here."""

from __future__ import annotations

# The columns of the snapshot files, in their order, and the names used in this package.
STOCK_NAMES = {
    "Rank": "rank", "Ticker": "ticker", "Sector": "sector", "Industry": "industry", "Exchange": "exchange", "Relative Strength": "rs", "Percentile": "percentile",
    "1M_RS_Percentile": "p1m", "3M_RS_Percentile": "p3m", "6M_RS_Percentile": "p6m", "1M_RS_Rank": "r1m", "3M_RS_Rank": "r3m", "6M_RS_Rank": "r6m",
    "Price": "price", "MarketCap": "market_cap", "Float": "float_shares", "ShortFloatPct": "short_float_pct", "PctFrom52WkHigh": "pct_from_high",
    "AvgVol10": "avg_vol10", "AvgVol30": "avg_vol30", "AvgVol50": "avg_vol50", "RevenueGrowth": "revenue_growth", "date": "date", "commit_hash": "commit_hash",
}
INDUSTRY_NAMES = {k: STOCK_NAMES[k] for k in ("Rank", "Industry", "Sector", "Relative Strength", "Percentile", "1M_RS_Percentile", "3M_RS_Percentile", "6M_RS_Percentile", "1M_RS_Rank", "3M_RS_Rank", "6M_RS_Rank", "date", "commit_hash")} | {"Tickers": "tickers"}
#: Columns that are numbers whatever a file says; what does not parse is null.
NUMERIC = ("rank", "rs", "percentile", "p1m", "p3m", "p6m", "r1m", "r3m", "r6m", "price", "market_cap", "float_shares", "short_float_pct", "pct_from_high", "avg_vol10", "avg_vol30", "avg_vol50", "revenue_growth")
#: Percentile columns and the rank columns made of them.
HORIZONS = {"p1m": "r1m", "p3m": "r3m", "p6m": "r6m"}
#: Natural keys of the two histories, besides the date.
STOCK_KEY, INDUSTRY_KEY = "ticker", "industry"
