"""Relational and statistical operators over DataFrames.

aggregates  A1-A16, O1-O5   totals, counts, stats, daily sums, top-k, previews, counts beside rows
filters     P9-P12, P19-P20 entity / selection / active / date-window / finite-row predicates
joins       J1-J5           key mapping, dimension join, anti-join audit, labels, actuals overlay
waves       W1-W3           direction classes and UP+ PLATEAU* DOWN+ wave detection
ranking     (support)       exact global positions and average ranks without one-task sorts
regression  P17, M1, M4-M5  log features, standardisation, log-log OLS fit and prediction
cluster     M2-M3           deterministic Lloyd k-means and the pyspark.ml path
forecast    M6-M9           history series, future dates, level-1 and level-2 forecasts
profile     E1-E8           column info, overview, numeric summary, top values, histogram,
                            correlations, missing values, and the full report
guards      P23             required-column checks
"""
