from featurelens.sources.readers import (  # noqa: F401
    load_datasets, load_source, materialise_filtered, preview, read_csv, read_json,
    read_parquet, read_tsv, read_with_options, reload_selected, working_sample,
)
from featurelens.sources.writers import (  # noqa: F401
    load_model, save_model, write_assignments, write_predictions, write_profile,
)
