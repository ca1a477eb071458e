"""vitrine: a Spark-native product-catalog engine.

Pages and site rules come in as DataFrames; products, prices, ids and
categories are derived with Column expressions; each run is compared with the
stored catalog and merged into a new table version. Every heavy step is a
DataFrame plan that Catalyst optimises; Python runs only inside the HTML
element step and caller-supplied embedding functions.
"""

from vitrine.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
