"""spendlens — marketing analytics (campaigns, ads, orders) on Spark DataFrames.

    import spendlens as sl
    t = sl.read_model(spark, "/data/marketing")
    sl.reports.budget_alerts(t, 85.0)
    admitted, rejected = sl.admit_ads(requests, t.campaign)
"""

from .operators import reports, views, writes  # noqa: F401
from .operators.admission import admission_decisions, admit_ads  # noqa: F401
from .operators.digest import digest_match  # noqa: F401
from .operators.text import formatted_lines, parse_report_lines, report_lines, report_text  # noqa: F401
from .session import cluster_conf, get_spark  # noqa: F401
from .sources.model import read_model, read_model_tables, save_model_tables, write_model  # noqa: F401
from .tables import Tables  # noqa: F401

__version__ = "0.1.0"
