"""The registered queries: library calls on the driver's tables with their SQL."""

FAMILIES = ["source_queries", "column_queries", "profile_queries", "drift_queries", "sample_queries", "transform_queries",
            "metric_queries", "cluster_queries", "selection_queries", "model_queries"]


def load():
    from importlib import import_module
    for family in FAMILIES:
        import_module(f"workload.{family}")
    return import_module("workload.registry")
