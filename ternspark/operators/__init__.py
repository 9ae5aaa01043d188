"""Filters, outliers, ternary coordinates, statistics, quality and chart data. DataFrame in, DataFrame out."""
