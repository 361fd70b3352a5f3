"""touchline: outcome models and time-to-event analysis of match-like tables on Spark.

Sub-packages
    sources    readers with declared columns
    functions  column expressions and the scalar tail probabilities used on the driver
    operators  DataFrame in, DataFrame (or small fitted model) out
    plans      the end-to-end frames and the catalogue of registered queries
"""
