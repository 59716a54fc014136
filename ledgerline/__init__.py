"""ledgerline: Spark-native player, token-economy and revenue analytics.

Every operator is a plain function from DataFrames (plus parameters) to a lazy
DataFrame.  Nothing is collected to the driver; Catalyst plans the work.
"""

from ledgerline.session import get_spark, checkpoint_dir, cut_lineage

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage"]
