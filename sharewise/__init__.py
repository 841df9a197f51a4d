"""sharewise: estimate the share of positives in document collections with Spark.

The package is a set of ``DataFrame -> DataFrame`` operators.  Every operator takes
``keys``, the grouping columns (replicate, member, class weight, batch ...) that ride
along, so that one Spark job serves all replicates at once.
"""
