"""Training-data operators: archives, quality, licences, packing, near duplicates, pseudonyms, language, quotes, lines, benchmarks.

Nothing else in the package imports this one. Every operator takes and returns DataFrames; state that has to be kept
between jobs goes to the folder named by ``spark.checkpoint.dir``.
"""
