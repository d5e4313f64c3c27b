from stratamart.sources.tables import Tables  # noqa: F401
from stratamart.sources.raw import RAW_TABLES, raw_source  # noqa: F401
