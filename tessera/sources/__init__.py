from tessera.sources.tables import TABLES, load_table, load_tables  # noqa: F401
from tessera.sources.files import (  # noqa: F401
    read_csv_strings, read_csv_inferred, read_headerless, parse_dictionary,
    load_dataset, save_dataset,
)
from tessera.sources.records import read_json_records, records_from_json_column  # noqa: F401
