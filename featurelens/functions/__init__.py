from featurelens.functions.expressions import (  # noqa: F401
    bucket_tree, is_missing, null_if_missing, unit_hash, coerce_number,
)
