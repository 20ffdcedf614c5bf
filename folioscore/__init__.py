"""Quality measurement of machine-read text on Spark: page-layout sources, similarity metrics, keyed statistics."""
