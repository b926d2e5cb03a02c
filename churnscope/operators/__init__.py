"""DataFrame -> DataFrame building blocks."""

from churnscope.operators import asof, campaign, drift, features, ledger_ops, metrics, model

__all__ = ["asof", "campaign", "drift", "features", "ledger_ops", "metrics", "model"]
